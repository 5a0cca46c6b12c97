"""Stored sketches, included files and records of incidents over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import vocab
from skein.operators import extraction, sketches
from skein.sources import folders, writers

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS span, count(*) AS n, true AS distinct_near, true AS median_near, true AS high_near FROM events GROUP BY 1")
def sketched_weeks(events):
    """AGG4, AGG15, AGG18: sketches a day, stored, united by week; whether they are within their bounds of the exact figures: 5 % of the users, 3 % of ranks."""
    spark = events.sparkSession
    path = writers.scratch(spark, "sketches")
    sketches.daily(events, F.to_date("ts"), "user_id", "value").write.parquet(path)
    week = lambda c: F.date_trunc("week", c).cast("date")
    told = sketches.spans(spark.read.parquet(path), week("day"))
    exact = events.groupBy(week("ts").alias("span")).agg(F.count_distinct("user_id").alias("users"), F.count("value").alias("values"))
    # a value's rank lies between the shares of smaller values and of values up to it
    ranks = events.withColumn("span", week("ts")).join(told.select("span", "quantiles"), "span").groupBy("span").agg(*[f(c).alias(f"{name}{k}") for k in (0, 1) for name, f in (("below", lambda q: F.count_if(F.col("value") < q)), ("upto", lambda q: F.count_if(F.col("value") <= q))) for c in [F.col("quantiles")[k]]])
    near = lambda k, q: (F.col(f"below{k}") / F.col("values") <= q + 0.03) & (F.col(f"upto{k}") / F.col("values") >= q - 0.03)
    out = told.join(exact, "span").join(ranks, "span")
    return out.select("span", "n", (F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users")).alias("distinct_near"), near(0, 0.5).alias("median_near"), near(1, 0.9).alias("high_near"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS f, (o_orderkey * 31) % 997 AS t FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 = 0),
w AS (SELECT DISTINCT o_custkey AS file, 0 AS depth FROM orders WHERE o_custkey % 25 = 0 UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON w.file = e.f WHERE w.depth < 60)
SELECT file, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY file""")
def included_from(orders):
    """SRC19: what is reached from every twenty-fifth customer along orders as inclusions, which run in circles."""
    edges = orders.where("o_orderstatus = 'P' and o_orderkey % 3 = 0").select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") * 31 % 997).alias("target"))
    return folders.walk(orders.where("o_custkey % 25 = 0").select(F.col("o_custkey").alias("file")), edges)


@query("""
WITH RECURSIVE n AS (SELECT max(doc_id) + 1 AS n FROM documents), e AS (SELECT doc_id AS f, (doc_id * 7 + 1) % n AS t FROM documents, n WHERE doc_id % 11 <> 0 OR doc_id = 0 UNION ALL SELECT doc_id, (doc_id * 3 + 2) % n FROM documents, n WHERE doc_id % 2 = 0),
w AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS depth UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON w.id = e.f WHERE w.depth < 100), r AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
SELECT '/home/u/f' || id || '.sh' AS file, 'go' || id AS name, 'Alias ''go' || id || ''' executes: ping 10.0.0.' || (id % 250) || ' (IP: 10.0.0.' || (id % 250) || ')' AS fact_text, CAST(depth AS BIGINT) AS depth FROM r JOIN documents ON id = doc_id
UNION ALL SELECT '/home/u/f' || id || '.sh', 'run_' || lang, 'Function ''run_' || lang || ''' is defined in f' || id || '.sh', CAST(depth AS BIGINT) FROM r JOIN documents ON id = doc_id WHERE id % 5 = 0""")
def alias_walk(documents):
    """SRC19: texts as shell files that include each other, in circles too; aliases with addresses and functions of what is reached from the first."""
    last = documents.agg((F.max("doc_id") + 1).alias("n"))  # one row
    rows = documents.join(F.broadcast(last))
    d, name = F.col("doc_id"), lambda n: F.concat(F.lit("f"), n.cast("string"), F.lit(".sh"))
    first = F.when((d % 11 != 0) | (d == 0), F.concat(F.lit("source "), name((d * 7 + 1) % F.col("n"))))
    second = F.when(d % 2 == 0, F.concat(F.lit(". $HOME/"), name((d * 3 + 2) % F.col("n"))))
    alias = F.concat(F.lit("  alias go"), d.cast("string"), F.lit("='ping 10.0.0."), (d % 250).cast("string"), F.lit("'"))
    function = F.when(d % 5 == 0, F.concat(F.lit("run_"), "lang", F.lit("() {")))
    written = F.array(F.lit("# alias no='no'"), first, second, alias, function, F.lit("alias ls='ls -l'"))
    lines = rows.select(F.concat(F.lit("/home/u/"), name(d)).alias("file"), F.explode(written).alias("line")).where("line is not null")
    return folders.alias_facts(lines, lines.where("file = '/home/u/f0.sh'").select("file"), blocked=("ls",), home="/home/u")


_SYMPTOM = "|".join(f"(?:{p})" for p in vocab.INCIDENT_FAMILIES["symptom"][0])
_PREVENT = "|".join(f"(?:{p})" for p in vocab.INCIDENT_FAMILIES["prevention"][0])
#: What each text goes on with: a fence, headings, bullets and numbers.
_STORY = ("", "```", "error in the fence that nobody counts", "```", "## After the outage", "- **Timeouts** of the node {n} were stuck", "1. We added an alert for the disk {n}", "# Silent failure", "**Retries hid it.** all along")


def _cleaned(c: str) -> str:
    c = rf"regexp_replace({c}, '^[*\->]+\s*', '')"
    c = rf"regexp_replace({c}, '^[0-9]+\.\s+', '')"
    c = rf"regexp_replace({c}, '\*\*([^*]+)\*\*', '\1', 'g')"
    c = rf"regexp_replace({c}, '\[([^\]]+)\]\([^)]+\)(?:\{{[^}}]*\}})?', '\1', 'g')"
    return rf"regexp_replace(regexp_replace({c}, '`([^`]+)`', '\1', 'g'), '^\s+|\s+$', '', 'g')"


def _family_sql(name: str, pattern: str, where: str) -> str:
    return f"""
{name}_c AS (SELECT doc_id, n, {_cleaned("line")} AS item FROM m WHERE {where} AND fences % 2 = 0 AND line <> '' AND NOT starts_with(line, '```') AND NOT starts_with(line, '|') AND NOT starts_with(line, '![') AND NOT regexp_matches(line, '^#{{1,3}}\\s+') AND regexp_matches(lower(line), '{pattern}')),
{name}_s AS (SELECT doc_id, min(n) AS n, CASE WHEN length(item) <= 180 THEN item WHEN length(regexp_extract(item, '^([^.!?]+[.!?])', 1)) > 20 THEN trim(regexp_extract(item, '^([^.!?]+[.!?])', 1)) ELSE item[1:150] END AS item FROM {name}_c WHERE length(item) >= 15 GROUP BY ALL),
{name}_d AS (SELECT doc_id, item, min(n) AS n FROM {name}_s GROUP BY ALL), {name}_r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM {name}_d)"""


_BODY = "text || chr(10) || replace('" + "\n".join(_STORY) + "', '{n}', CAST(doc_id AS VARCHAR))"


@query(rf"""
WITH l AS (SELECT doc_id, string_split({_BODY}, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS raw FROM l),
m AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, sum(CAST(starts_with(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS fences,
  last_value(CASE WHEN regexp_matches(raw, '^#{{1,3}}\s+.') THEN lower(raw) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS head FROM u),
{_family_sql("s", _SYMPTOM, "true")}, {_family_sql("p", _PREVENT, "regexp_matches(coalesce(head, ''), 'prevention|after|fix|lesson|going forward')")}
SELECT doc_id, coalesce((SELECT string_agg(item, chr(10) ORDER BY k) FROM s_r WHERE s_r.doc_id = documents.doc_id AND k <= 6), '') AS symptom, coalesce((SELECT string_agg(item, chr(10) ORDER BY k) FROM p_r WHERE p_r.doc_id = documents.doc_id AND k <= 6), '') AS prevention, 'Retries hid it (all along)' AS bold FROM documents""")
def incident_items(documents):
    """TXT13-14, TXT16-17: texts that go on as the story of an incident: symptoms from all lines, preventions below their heading, bold items below theirs."""
    story = F.replace(F.lit("\n".join(_STORY)), F.lit("{n}"), F.col("doc_id").cast("string"))
    docs = documents.select("doc_id", F.concat_ws("\n", "text", story).alias("body"))
    families = {k: v for k, v in vocab.INCIDENT_FAMILIES.items() if k in ("symptom", "prevention")}
    rows = extraction.incident(docs, families=families)
    return rows.select("doc_id", *[F.array_join(k, "\n").alias(k) for k in families], F.array_join(extraction.bold_items(F.col("body")), "\n").alias("bold"))
