"""Aggregates over documents, labels, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import vocab
from skein.functions import scoring
from skein.operators import analytics

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

AS_OF = "2024-06-01 00:00:00"


_WEIGHT = f"""
SELECT o_orderpriority AS domain, greatest(1, o_orderkey % 4) * CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE exp(-0.005 * ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400000000.0)) END
  * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.6 ELSE 0.9 END * CASE WHEN o_custkey % 7 = 0 THEN 1.2 WHEN o_custkey % 7 = 1 THEN 0.3 ELSE 1.0 END * CASE WHEN o_custkey % 3 = 0 THEN 1.5 ELSE 1.0 END * CASE WHEN o_custkey % 5 = 0 THEN 0.7 ELSE 1.0 END AS w FROM orders"""
_MATURE = f"SELECT domain, count(*) AS facts, CASE WHEN count(*) < 20 THEN 0.0 ELSE least(1.0, sum(w) / count(*)) END AS score FROM ({_WEIGHT}) GROUP BY domain"


def _maturity(orders):
    status = F.col("o_orderstatus")
    weight = analytics.fact_weight(
        F.when(status == "F", "finding").when(status == "O", "auto-mined").otherwise("compaction"),
        F.when(F.col("o_custkey") % 7 == 0, "confirmed").when(F.col("o_custkey") % 7 == 1, "refuted").otherwise("none"),
        F.when(F.col("o_custkey") % 5 == 0, "autonomous").otherwise("human"),
        F.when(F.col("o_custkey") % 3 == 0, 2).otherwise(1),
        F.col("o_orderkey") % 4,
        scoring.age_days(F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp"), 0.0),
    )
    return analytics.maturity(orders.withColumn("domain", F.col("o_orderpriority")), "domain", weight)


@query(f"SELECT domain, facts, round(score, 6) AS score, CASE WHEN score >= 0.45 THEN 'LIVE' WHEN score >= 0.25 THEN 'warm' ELSE 'cold' END AS state FROM ({_MATURE})")
def maturity(orders):
    """AGG7-8: orders as facts, priorities as domains."""
    return _maturity(orders).withColumn("score", F.round("score", 6))


@query(f"""
WITH v AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', 'quality']) AS domain), s AS (SELECT domain, coalesce(facts, 0) AS facts, coalesce(score, 0.0) AS score FROM v LEFT JOIN ({_MATURE}) USING (domain)),
n AS (SELECT *, CASE domain WHEN 'quality' THEN 0.7 WHEN '1-URGENT' THEN 0.7 ELSE 0.6 END AS need_score, CASE domain WHEN 'quality' THEN 100 WHEN '1-URGENT' THEN 50 ELSE 50 END AS need_facts FROM s)
SELECT domain, facts, CASE WHEN score >= need_score AND facts >= need_facts THEN 'READY' WHEN score >= 0.8 * need_score AND facts >= 0.8 * need_facts THEN 'MARGINAL' ELSE 'NOT READY' END AS state FROM n""")
def readiness(orders):
    """AGG9: a vocabulary of four domains, one without facts."""
    vocabulary = orders.sparkSession.createDataFrame([(d,) for d in ("1-URGENT", "2-HIGH", "3-MEDIUM", "quality")], "domain string")
    needed = {"quality": (0.70, 100), "1-URGENT": (0.70, 50)}
    return analytics.readiness(_maturity(orders).drop("state"), vocabulary, "domain", needed, vocab.READINESS_DEFAULT).select("domain", "facts", "state")


@query("""
SELECT state, count(*) AS n FROM (SELECT CASE WHEN list_contains(p, 'click') AND list_contains(p, 'purchase') THEN 'both' WHEN list_contains(p, 'click') THEN 'a_only' WHEN list_contains(p, 'purchase') THEN 'b_only' ELSE 'neither' END AS state
FROM (SELECT user_id, date_trunc('day', ts) AS day, list(DISTINCT event_type) AS p FROM events GROUP BY ALL)) GROUP BY state""")
def governor_states(events):
    """AGG10: a user's day as a fact, its event types as principals."""
    days = events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.collect_set("event_type").alias("p"))  # five types at most
    return analytics.principal_states(days, "p", "click", "purchase").groupBy("state").agg(F.count("*").alias("n"))


@query("""
SELECT count(*) AS facts, count(*) FILTER (quality IS NULL) AS unverified, count(*) FILTER (toxic = 1) AS rejected, count(*) FILTER (quality = 1 AND toxic = 0) AS confirmed, count(*) FILTER (n_chars < 200) AS short, count(*) FILTER (source = 'src0') AS one_source,
  (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)) AS repeated_groups FROM documents LEFT JOIN labels USING (doc_id)""")
def corpus_audit(documents, labels):
    """AGG11."""
    rows = documents.select("doc_id", "n_chars", "source").join(labels, "doc_id", "left")
    counts = rows.agg(
        F.count("*").alias("facts"),
        F.count_if(F.col("quality").isNull()).alias("unverified"),
        F.count_if(F.col("toxic") == 1).alias("rejected"),
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("confirmed"),
        F.count_if(F.col("n_chars") < 200).alias("short"),
        F.count_if(F.col("source") == "src0").alias("one_source"),
    )
    groups = documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_groups"))
    return counts.join(F.broadcast(groups))


@query("SELECT source AS scope, count(*) AS n, CAST(sum(quality) AS BIGINT) AS wins, round(sum(quality) / count(*), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source")
def winrates(documents, labels):
    """AGG13."""
    return analytics.win_rates(documents.select("doc_id", "source").join(labels, "doc_id"), "source", "quality")


@query("SELECT lang, count(*) AS facts, max(doc_id) AS newest, count(DISTINCT source) AS sessions FROM documents GROUP BY lang")
def suggest_coverage(documents):
    """AGG4, AGG18, JN9."""
    return documents.groupBy("lang").agg(F.count("*").alias("facts"), F.max("doc_id").alias("newest"), F.count_distinct("source").alias("sessions"))


@query("SELECT coalesce(lang, '*') AS lang, coalesce(quality, -1) AS quality, count(*) AS n, CAST(grouping(lang) AS INTEGER) AS g_lang, CAST(grouping(quality) AS INTEGER) AS g_quality FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (lang), (quality), ())")
def grouping_sets_stats(documents, labels):
    """AGG5: four roll-ups in one pass."""
    rows = documents.select("doc_id", "lang").join(labels, "doc_id")
    out = rows.groupingSets([["lang", "quality"], ["lang"], ["quality"], []], "lang", "quality")
    counted = out.agg(F.count("*").alias("n"), F.grouping("lang").cast("int").alias("g_lang"), F.grouping("quality").cast("int").alias("g_quality"))
    return counted.na.fill({"lang": "*", "quality": -1})


@query("SELECT event_type, CAST(floor(quantile_cont(value, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(value, 0.9)) AS BIGINT) AS p90, CAST(floor(quantile_cont(value, 0.99)) AS BIGINT) AS p99 FROM events GROUP BY event_type")
def percentiles(events):
    """AGG15."""
    return events.groupBy("event_type").agg(*[analytics.int_percentile("value", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99)])


@query("""
WITH c AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY)
SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean, round(avg(value) FILTER (event_type = 'purchase'), 6) AS mean_purchase, CAST(floor(100 * count(*) FILTER (event_type = 'error') / count(*)) AS BIGINT) AS error_percent FROM c""")
def telemetry_summary(events):
    """AGG6, AGG17, DTM5: the last seven days."""
    last = events.agg(F.max("ts").alias("now"))  # one row
    recent = events.join(F.broadcast(last)).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS"))
    error = F.count_if(F.col("event_type") == "error")
    return recent.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), error.alias("errors"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("mean_purchase"), F.floor(F.lit(100) * error / F.count("*")).alias("error_percent"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def busiest(events):
    """AGG17, SRT3: ten users."""
    return events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT lang, array_to_string(list_sort(list(source || '=' || n)), ',') AS histogram, CAST(sum(n) AS BIGINT) AS total, round(sum(chars) / sum(n), 4) AS mean_chars FROM (SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY ALL) GROUP BY lang")
def snapshot(documents):
    """AGG12, AGG24, SNK7: a histogram a domain, from a two-level aggregate."""
    each = documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    listed = F.array_sort(F.collect_list(F.concat("source", F.lit("="), F.col("n").cast("string"))))  # an entry a source
    return each.groupBy("lang").agg(F.array_join(listed, ",").alias("histogram"), F.sum("n").alias("total"), F.round(F.sum("chars") / F.sum("n"), 4).alias("mean_chars"))


@query()
def approx_distinct(events):
    """HyperLogLog counts beside AGG4 (rows only)."""
    return events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("users"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def month_partitions(orders):
    """DTM4: rows a month partition."""
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2024-09-02' GROUP BY ALL""")
def pricing_summary(lineitem):
    """A wide grouped aggregate over the largest table, with a pushed-down filter."""
    rows = lineitem.where(F.col("l_shipdate") <= F.lit("2024-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))
