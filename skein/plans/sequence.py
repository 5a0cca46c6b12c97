"""Sequence analytics over events (sessions: users) and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import vocab
from skein.operators import sequences

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

#: A session's events in order.
ORDER = ["ts", "event_id"]


@query("""
SELECT conv_id, turn, md5(q) AS question_md5 FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations) WHERE role = 'assistant'""")
def carry_forward_query(conversations):
    """WIN1, JN21, SRC7-8: each answer with the question before it."""
    out = sequences.carry_forward(conversations, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("text")), "question")
    return out.where("role = 'assistant'").select("conv_id", "turn", F.md5(F.col("question").cast("binary")).alias("question_md5"))


_FILL = "CASE WHEN event_type <> 'error' THEN CAST(floor(value * 1000) AS BIGINT) ELSE 0 END"
_TURNS = f"""
turns AS (SELECT event_id, user_id, ts, event_type, CAST(sum(CASE WHEN same AND n > 1 THEN 0 ELSE 1 END) OVER w AS BIGINT) AS turn, coalesce(last_value(CASE WHEN fill > 0 THEN fill END IGNORE NULLS) OVER w, 0) AS total, coalesce(first_value(CASE WHEN fill > 0 THEN fill END IGNORE NULLS) OVER w, 0) AS floor
FROM (SELECT *, {_FILL} AS fill, event_type IS NOT DISTINCT FROM lag(event_type) OVER o AS same, row_number() OVER o AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def _turns(events):
    fill = F.when(F.col("event_type") != "error", F.floor(F.col("value") * 1000)).otherwise(0)
    return sequences.turns(events, "user_id", ORDER, F.col("event_type"), fill)


@query(f"WITH {_TURNS} SELECT event_id, turn, total, floor, greatest(0, total - floor) AS working FROM turns")
def turn_fuel(events):
    """WIN6-8, PRJ19: a user's events as a session; the type stands for the request id, the value for the fill."""
    return _turns(events).select("event_id", "turn", "total", "floor", "working")


@query("""
WITH r AS (SELECT *, event_type = 'error' AS e, CAST(json_extract(props, '$.k') AS VARCHAR) AS t FROM events),
b AS (SELECT *, CASE WHEN e AND lag(e) OVER w AND t <> '' AND t = lag(t) OVER w THEN 0 ELSE 1 END AS broken FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(broken) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run_no ORDER BY ts, event_id) AS run FROM i)
SELECT event_id, run, CASE WHEN run >= 2 THEN 'tool_thrash' ELSE 'tool_error' END AS event FROM n WHERE e""")
def error_thrash(events):
    """WIN9: runs of errors on one target."""
    target = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return sequences.error_runs(events, "user_id", ORDER, F.col("event_type") == "error", target).select("event_id", "run", "event")


_EDITS = "SELECT user_id, event_id, event_type AS o, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


@query(f"""
WITH e AS (SELECT * FROM ({_EDITS}) WHERE n IS NOT NULL AND n <> o), f AS (SELECT user_id, o, n, min(event_id) AS at FROM e GROUP BY ALL)
SELECT e.event_id, e.o AS old, e.n AS new FROM e WHERE EXISTS (SELECT 1 FROM f WHERE f.user_id = e.user_id AND f.o = e.n AND f.n = e.o AND f.at < e.event_id)""")
def edit_revert(events):
    """WIN10: a change of type as an edit; one that undoes an earlier one of the user."""
    from pyspark.sql import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy(*ORDER))
    edits = events.select("user_id", "event_id", F.col("event_type").alias("old"), nxt.alias("new")).where("new is not null and new != old")
    return sequences.reverts(edits, ["user_id"], "event_id", "old", "new").select("event_id", "old", "new")


_BAND = "CASE " + " ".join(f"WHEN working < {top} THEN '{name}'" for name, top in vocab.BANDS[:-1]) + f" ELSE '{vocab.BANDS[-1][0]}' END"


@query(f"""
WITH {_TURNS}, w AS (SELECT *, greatest(0, total - floor) * 10 AS working FROM turns), b AS (SELECT unnest([{", ".join(repr(n) for n, _ in vocab.BANDS)}]) AS band),
t AS (SELECT {_BAND} AS band, count(*) AS turns, count(*) FILTER (event_type = 'error') AS events FROM w GROUP BY 1),
j AS (SELECT band, coalesce(turns, 0) AS turns, coalesce(events, 0) AS events FROM b LEFT JOIN t USING (band)), o AS (SELECT sum(events) / sum(turns) * 1000 AS overall FROM j)
SELECT band, turns, events, round(rate, 4) AS rate, CASE WHEN turns = 0 THEN '' WHEN rate > 1.5 * overall THEN 'elevated' WHEN rate < 0.5 * overall THEN 'quiet' ELSE '' END AS flag
FROM (SELECT *, CASE WHEN turns > 0 THEN events / turns * 1000 ELSE 0.0 END AS rate FROM j), o""")
def band_rates(events):
    """AGG14, AGG16, PRJ18: errors per 1000 turns by fuel band."""
    rows = _turns(events).withColumn("working", F.col("working") * 10)
    bands = events.sparkSession.createDataFrame([(n,) for n, _ in vocab.BANDS], "band string")
    out = sequences.band_report(rows, rows.where("event_type = 'error'"), bands)
    return out.select("band", "turns", "events", F.round("rate", 4).alias("rate"), "flag")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(events):
    """STR7: days."""
    return events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("started"), "event_type", "n", "total")


@query("""
WITH b AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM b)
SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(events):
    """STR7: sessions parted by an hour."""
    return sequences.sessions(events, "user_id", "ts", 3600)


@query("SELECT user_id, event_type, date_trunc('hour', ts) AS hour, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_events(events):
    """STR4, MUT14: one event a user, type and hour: the first."""
    return events.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.min("event_id").alias("event_id"))


@query("""
WITH t AS (SELECT epoch_us(max(ts)) AS now FROM events)
SELECT user_id, event_id, CASE WHEN s < 90 THEN s || 's' WHEN s < 5400 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || 'm' END AS age FROM (SELECT user_id, event_id, (now - epoch_us(ts)) // 1000000 AS s FROM events, t)""")
def event_ages(events):
    """DTM2: how long ago, as text."""
    from skein.functions import scoring

    last = events.agg(F.max("ts").alias("now"))  # one row
    seconds = F.floor((scoring.micros(F.col("now")) - scoring.micros(F.col("ts"))) / 1_000_000)
    return events.join(F.broadcast(last)).select("user_id", "event_id", scoring.format_age(seconds).alias("age"))
