"""Validity over time: lines of orders as a log that opens and ends edges, asked at orders' dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import temporal

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

_LOG = """SELECT l_suppkey AS subject, l_partkey % 50 AS object, l_shipdate AS t, l_linestatus = 'O' AS adds FROM lineitem"""
_INTERVALS = f"""
l AS (SELECT subject, object, t, bool_or(adds) AS adds FROM ({_LOG}) GROUP BY ALL),
s AS (SELECT *, coalesce(lag(adds) OVER (PARTITION BY subject, object ORDER BY t), false) AS was FROM l),
i AS (SELECT subject, object, t AS valid_from, nxt AS valid_to FROM (SELECT *, lead(t) OVER (PARTITION BY subject, object ORDER BY t) AS nxt FROM s WHERE adds <> was) WHERE adds)"""


def _log(lineitem):
    return lineitem.select(F.col("l_suppkey").alias("subject"), (F.col("l_partkey") % 50).alias("object"), F.col("l_shipdate").alias("t"), (F.col("l_linestatus") == "O").alias("adds"))


@query(f"WITH {_INTERVALS} SELECT * FROM i")
def edge_intervals(lineitem):
    """KG5, KG8: open lines open the edge of a supplier and a kind of part, finished ones end it."""
    return temporal.intervals(_log(lineitem), ["subject", "object"], "t", "adds")


@query(f"""WITH {_INTERVALS}, q AS (SELECT DISTINCT l_orderkey, l_suppkey AS subject, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, q.subject, count(*) AS edges, min(object) AS least, min(valid_from) AS since FROM q JOIN i ON q.subject = i.subject AND valid_from <= o_orderdate AND (valid_to IS NULL OR o_orderdate < valid_to) GROUP BY ALL""")
def edges_as_of(lineitem, orders):
    """KG10: which edges of its suppliers held at each order's date."""
    edges = temporal.intervals(_log(lineitem), ["subject", "object"], "t", "adds")
    asked = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.col("l_suppkey").alias("subject"), "o_orderdate").distinct()
    held = temporal.as_of(asked, edges, ["subject"], "o_orderdate")
    return held.groupBy("l_orderkey", "subject").agg(F.count("*").alias("edges"), F.min("object").alias("least"), F.min("valid_from").alias("since"))


@query("""
WITH d AS (SELECT o_custkey, o_orderdate AS a, o_orderdate + INTERVAL 90 DAY AS b FROM orders),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM d),
p AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT o_custkey, min(a) AS valid_from, max(b) AS valid_to FROM p GROUP BY o_custkey, part""")
def merged_validity(orders):
    """KG5: an order holds for ninety days; a customer's orders that overlap or touch, as one."""
    rows = orders.select("o_custkey", F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("valid_to"))
    return temporal.merged(rows, ["o_custkey"])
