"""Leases, cursors, overlaps and divergence, replayed over orders, events and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import markdown, sequences

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

TTL = 60 * 86_400


@query(f"""
WITH RECURSIVE c AS (SELECT o_orderpriority || ':' || (o_orderkey % 500) AS resource, o_orderkey AS id, o_custkey % 4 AS holder, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS t,
  row_number() OVER (PARTITION BY o_orderpriority || ':' || (o_orderkey % 500) ORDER BY o_orderdate, o_orderkey, o_custkey % 4) AS n FROM orders),
r AS (SELECT resource, id, n, true AS won, holder, t AS since, false AS renewed FROM c WHERE n = 1 UNION ALL
  SELECT c.resource, c.id, c.n, c.holder = r.holder OR c.t - r.since > {TTL}, CASE WHEN c.holder = r.holder OR c.t - r.since > {TTL} THEN c.holder ELSE r.holder END, CASE WHEN c.holder = r.holder OR c.t - r.since > {TTL} THEN c.t ELSE r.since END, c.holder = r.holder FROM r JOIN c ON c.resource = r.resource AND c.n = r.n + 1)
SELECT resource, id, won, holder, renewed FROM r""")
def lease_replay(orders):
    """CRD1-3: orders as claims; a lease lasts sixty days, its holder renews it."""
    claims = orders.select(F.concat("o_orderpriority", F.lit(":"), (F.col("o_orderkey") % 500).cast("string")).alias("resource"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("holder"), F.col("o_orderdate").alias("at"))
    return sequences.replay_leases(claims, TTL)


@query("""
WITH c AS (SELECT user_id, min(ts) + INTERVAL 20 DAY AS cursor FROM events GROUP BY user_id),
r AS (SELECT e.user_id, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS place, count(*) OVER (PARTITION BY e.user_id) AS n FROM events e JOIN c USING (user_id) WHERE e.ts > c.cursor)
SELECT user_id, count(*) AS shown, max(ts) AS new_cursor, any_value(n) > 6 AS overflow FROM r WHERE place <= 6 GROUP BY user_id""")
def cursor_delta(events):
    """CRD6, JN26, STR3: six unseen events a reader, and where its cursor goes."""
    cursors = events.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 20 DAYS")).alias("cursor"))
    return sequences.deltas(events, cursors, "user_id", "ts", "event_id")


@query("""
WITH t AS (SELECT s_suppkey AS k, s_nationkey AS h, unnest(list_distinct(list_filter(regexp_split_to_array(lower(s_name || ' ' || n_name), '[-_:./ \\t\\n]+'), lambda x: length(x) >= 4 AND x NOT IN ('supplier', 'united')))) AS token FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT a.k AS a, b.k AS b, count(*) AS shared FROM t a JOIN t b ON a.token = b.token AND a.k < b.k AND a.h <> b.h GROUP BY ALL""")
def overlap_claims(supplier, nation):
    """JN16, PRJ28: suppliers as claims, their nation as the holder."""
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("resource", F.concat_ws(" ", "s_name", "n_name"))
    return markdown.overlapping(rows, "s_suppkey", "s_nationkey", markdown.significant(F.col("resource"), ("supplier", "united")))


@query("""
WITH a AS (SELECT DISTINCT url AS p, sha256(html) AS h FROM pages WHERE page_id % 5 <> 0), b AS (SELECT DISTINCT url AS p, CASE WHEN page_id % 7 = 0 THEN sha256(html || '!') ELSE sha256(html) END AS h FROM pages WHERE page_id % 4 <> 0)
SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.h IS NULL THEN 'only_right' WHEN b.h IS NULL THEN 'only_left' WHEN a.h = b.h THEN 'same' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.p = b.p""")
def tree_divergence(pages):
    """JN17, SET2: two trees of pages; some are missing, some changed."""
    left = pages.where("page_id % 5 != 0").select("url", F.sha2(F.col("html").cast("binary"), 256).alias("h")).distinct()
    changed = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    right = pages.where("page_id % 4 != 0").select("url", F.sha2(changed.cast("binary"), 256).alias("h")).distinct()
    return markdown.divergence(left, right, "url", "h")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AND count(*) > 1 AS agree, count(*) AS heads FROM orders GROUP BY o_custkey")
def remote_heads(orders):
    """JN18: whether all remotes show the same head."""
    return orders.groupBy("o_custkey").agg(((F.count_distinct("o_orderstatus") == 1) & (F.count("*") > 1)).alias("agree"), F.count("*").alias("heads"))


@query("""
SELECT s.n_name, CASE WHEN c.customers IS NULL THEN 'UNCHECKABLE' WHEN c.customers >= s.suppliers * 10 THEN 'OK' ELSE 'STALE' END AS state
FROM (SELECT n_nationkey, n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) s LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY 1) c ON n_nationkey = c_nationkey""")
def drift_check(nation, supplier, customer):
    """JN23: what is asserted (`at least`) against what is found; three outcomes."""
    asserted = nation.join(supplier.groupBy("s_nationkey").agg(F.count("*").alias("suppliers")), F.col("n_nationkey") == F.col("s_nationkey"), "left").na.fill(0, ["suppliers"])
    found = customer.where("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    state = F.when(F.col("customers").isNull(), "UNCHECKABLE").when(F.col("customers") >= F.col("suppliers") * 10, "OK").otherwise("STALE")
    return asserted.join(found, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", state.alias("state"))
