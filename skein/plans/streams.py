"""Streams over the driver's tables: written in chunks, streamed one after another from one checkpoint, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import degradation
from skein.sources import writers
from skein.streaming import stateful

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


def in_chunks(rows: DataFrame, by: str, path: str, run, chunks: int = 3, last: DataFrame | None = None, made=lambda rows: rows) -> None:
    """Writes what is made of rows chunk by chunk in the order of a number, starting the stream `run` after each: state goes on from its checkpoint. last: rows for the end.

    A chunk of a table in that order lies in few of its tasks: its rows are dealt out anew, so that all cores write and read it.
    """
    low, high = rows.agg(F.min(by), F.max(by)).first()
    bounds = [] if low is None else [low - (low - high - 1) * k // chunks for k in range(chunks + 1)]
    parts = [made(rows.where((F.col(by) >= start) & (F.col(by) < end)).repartition(by)) for start, end in zip(bounds, bounds[1:])]
    for part in [*parts, *([last] if last is not None else [])]:
        part.write.mode("append").parquet(path)
        run().awaitTermination()


def transcript_of(events: DataFrame) -> DataFrame:
    """Events as lines of fifty transcripts (stem, line_no, line): clicks are calls, errors and half of the purchases results, sign-ups edits, the other purchases compactions."""
    k, n = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    usage = F.struct(F.floor(F.col("value") * 1000).alias("input_tokens"))
    request = F.floor(n / 3).cast("string").alias("requestId")
    call = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), (k % 7).cast("string")).alias("id"), F.lit("Edit").alias("name"), F.struct(F.concat(F.lit("f"), (k % 3).cast("string")).alias("file_path")).alias("input"))
    result = lambda wrong: F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("c"), (k % 7).cast("string")).alias("tool_use_id"), F.lit(wrong).alias("is_error"), F.concat(F.lit("r"), n.cast("string")).alias("content"))
    user, assistant = F.lit("user").alias("type"), F.lit("assistant").alias("type")
    kinds = {
        "click": F.struct(assistant, request, F.struct(usage.alias("usage"), F.array(call).alias("content")).alias("message")),
        "view": F.struct(assistant, request, F.struct(usage.alias("usage"), F.when(n % 3 == 0, "max_tokens").otherwise("end_turn").alias("stop_reason")).alias("message")),
        "error": F.struct(user, F.struct(F.array(result(True)).alias("content")).alias("message")),
        "signup": F.struct(user, F.struct((n % 4 == 0).alias("interrupted"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("filePath"), F.concat(F.lit("v"), (k % 4).cast("string")).alias("oldString"), F.concat(F.lit("v"), (n % 4).cast("string")).alias("newString")).alias("toolUseResult")),
    }
    bound = F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), F.struct(F.lit("auto").alias("trigger"), (k * 100).alias("preTokens"), k.alias("postTokens")).alias("compactMetadata"))
    line = F.when(n % 2 == 0, F.to_json(F.struct(user, F.struct(F.array(result(False)).alias("content")).alias("message")))).otherwise(F.to_json(bound))
    for kind, struct in kinds.items():
        line = F.when(F.col("event_type") == kind, F.to_json(struct)).otherwise(line)
    return events.select((F.col("user_id") % 50).cast("string").alias("stem"), n.alias("line_no"), line.alias("line"))


_DEGRADED = """
WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS session, event_id AS seq, event_type AS kind, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type IN ('click', 'view') AS main FROM events),
m AS (SELECT *, CASE WHEN main THEN CAST(floor(value * 1000) AS BIGINT) ELSE 0 END AS fill, CASE WHEN main THEN seq // 3 END AS request FROM e),
t AS (SELECT *, CAST(main AND request IS DISTINCT FROM last_value(request IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS starts,
  coalesce(last_value(CASE WHEN fill > 0 THEN fill END IGNORE NULLS) OVER w, 0) AS total, coalesce(first_value(CASE WHEN fill > 0 THEN fill END IGNORE NULLS) OVER w, 0) AS floor FROM m WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn, greatest(0, total - floor) AS working FROM t),
r AS (SELECT f.*, c.k AS called, CASE WHEN c.k IS NULL THEN '' ELSE 'f' || (c.k % 3) END AS target FROM (SELECT *, k % 7 AS id FROM f WHERE kind = 'error' OR kind = 'purchase' AND seq % 2 = 0) f ASOF LEFT JOIN (SELECT session AS s2, seq AS at, k % 7 AS id2, k FROM e WHERE kind = 'click') c ON f.session = c.s2 AND f.id = c.id2 AND f.seq > c.at),
b AS (SELECT *, CASE WHEN kind = 'error' AND lag(kind) OVER w = 'error' AND target <> '' AND target = lag(target) OVER w THEN 0 ELSE 1 END AS broken FROM r WINDOW w AS (PARTITION BY session ORDER BY seq)),
i AS (SELECT *, sum(broken) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run_no FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY session, run_no ORDER BY seq) AS run FROM i),
s AS (SELECT *, 'f' || (k % 3) AS file, k % 4 AS old, seq % 4 AS new FROM f WHERE kind = 'signup'),
g AS (SELECT session, file, old, new, min(seq) AS at FROM s GROUP BY ALL)
SELECT session, seq, CASE WHEN run >= 2 THEN 'tool_thrash' ELSE 'tool_error' END AS event, CASE WHEN called IS NULL THEN '' ELSE 'Edit' END AS tool, target, 'r' || seq AS detail, turn, working, total FROM n WHERE kind = 'error'
UNION ALL SELECT session, seq, 'interrupted', '', file, 'tool call interrupted', turn, working, total FROM s WHERE seq % 4 = 0
UNION ALL SELECT session, seq, 'edit_revert', 'Edit', file, 'edit reverts an earlier edit to this file', turn, working, total FROM s WHERE EXISTS (SELECT 1 FROM g WHERE g.session = s.session AND g.file = s.file AND g.old = s.new AND g.new = s.old AND g.at < s.seq)
UNION ALL SELECT session, seq, 'truncation', '', '', 'assistant stop_reason=max_tokens', turn, working, total FROM f WHERE kind = 'view' AND seq % 3 = 0
UNION ALL SELECT session, seq, 'compact_boundary', 'auto', '', 'pre=' || (k * 100) || ' post=' || k, turn, CASE WHEN k > 0 THEN greatest(0, k * 100 - floor) ELSE working END, CASE WHEN k > 0 THEN k * 100 ELSE total END FROM f WHERE kind = 'purchase' AND seq % 2 = 1"""


@query(_DEGRADED)
def degradation_events(events):
    """STR1, WIN6-10, JN20, PRJ20, DTM3: users' events as transcripts, all six kinds of events by windows and joins."""
    return degradation.events(degradation.parse(transcript_of(events)))


@query(_DEGRADED)
def degradation_stream(events):
    """STR1, WIN6-10, JN20: the same by a stream with state, started anew for each third of the records."""
    spark = events.sparkSession
    stateful.use_rocksdb(spark)
    path = writers.scratch(spark, "degradation")

    def run():
        lines = spark.readStream.schema("stem string, line_no long, line string").parquet(f"{path}/in")
        out = stateful.degradation(degradation.fields(lines))
        with stateful.few_keys(spark, 50):
            return out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").format("parquet").trigger(availableNow=True).start(f"{path}/out")

    in_chunks(events, "event_id", f"{path}/in", run, made=transcript_of)
    return spark.read.schema(stateful.DEGRADED).parquet(f"{path}/out")


@query("""
SELECT resource, o_orderkey AS holder, o_orderdate AS since, o_orderdate + INTERVAL 5 DAY AS expired FROM (SELECT resource, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY resource ORDER BY o_orderdate, o_orderkey) AS after FROM (SELECT *, o_custkey % 100 AS resource FROM orders))
WHERE after IS NULL OR after > o_orderdate + INTERVAL 5 DAY""")
def lease_expiries(orders):
    """STR5, CRD2: orders as leases of a hundred resources for five days; timers tell which ran out."""
    spark = orders.sparkSession
    stateful.use_rocksdb(spark)
    path = writers.scratch(spark, "leases")
    schema = "resource long, holder long, at timestamp, second long"
    claims = orders.select((F.col("o_custkey") % 100).alias("resource"), F.col("o_orderkey").alias("holder"), F.col("o_orderdate").cast("timestamp").alias("at")).withColumn("second", F.unix_seconds("at"))
    end = spark.sql("select -1L as resource, -1L as holder, timestamp'2100-01-01 00:00:00' as at, 0L as second")  # moves the watermark on

    def run():
        out = stateful.expiries(spark.readStream.schema(schema).parquet(f"{path}/in"), 5 * 86_400_000)
        with stateful.few_keys(spark, 101):
            return out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").format("parquet").trigger(availableNow=True).start(f"{path}/out")

    in_chunks(claims, "second", f"{path}/in", run, last=end)
    return spark.read.schema(stateful.EXPIRED).parquet(f"{path}/out")


@query("""
WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT c.user_id AS "key", c.event_id AS call_id, r.event_id AS result_id FROM c LEFT JOIN r ON c.user_id = r.user_id AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 6 HOUR""")
def answered_calls(events):
    """JN20, STR3: clicks as calls and purchases as results, two streams that meet within six hours; calls without a result too."""
    spark = events.sparkSession
    stateful.use_rocksdb(spark)
    path = writers.scratch(spark, "answered")
    end = spark.sql("select -1L as key, -1L as id, timestamp'2100-01-01 00:00:00' as at")
    for kind in ("click", "purchase"):
        own = events.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
        own.write.parquet(f"{path}/{kind}")

    def run():
        calls, results = (spark.readStream.schema("key long, id long, at timestamp").parquet(f"{path}/{kind}") for kind in ("click", "purchase"))
        out = stateful.answered(calls.toDF("key", "call_id", "called"), results.toDF("key", "result_id", "given"), "6 hours")
        return out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").format("parquet").trigger(availableNow=True).start(f"{path}/out")

    run().awaitTermination()
    for kind in ("click", "purchase"):
        end.write.mode("append").parquet(f"{path}/{kind}")
    run().awaitTermination()
    back = spark.read.schema("key long, call_id long, called timestamp, result_id long, given timestamp").parquet(f"{path}/out")
    return back.where("key >= 0").select("key", "call_id", "result_id")


@query("SELECT o_custkey, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY o_custkey")
def merged_batches(orders):
    """MUT1, KG6, STR2: orders in five micro-batches, merged into buckets of customers; one batch comes again and changes nothing."""
    spark = orders.sparkSession
    path = writers.scratch(spark, "merged")
    rows = orders.select("o_custkey", F.lit(1).cast("long").alias("orders"), F.col("o_orderkey").alias("keys"), F.col("o_orderdate").alias("first"), F.col("o_orderdate").alias("last"))
    for k in range(5):
        rows.where(F.col("keys") % 5 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    how = {"key": "o_custkey", "add": ["orders", "keys"], "least": ["first"], "greatest": ["last"]}
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stateful.merge_stream(stream, f"{path}/target", f"{path}/checkpoint", **how).awaitTermination()
    stateful.merge_into(spark, f"{path}/target", rows.where(F.col("keys") % 5 == 4), 4, **how)
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in rows.dtypes)).parquet(f"{path}/target/table").select(*rows.columns)
