"""The entity graph over lineitem (entities in documents of one order) and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

#: Entities of the driver's texts: addresses, hosts, numbers of networks, tokens.
PATTERNS = {"mail": r"\b([a-z0-9_.]+@[a-z0-9.]+)", "host": r"@([a-z0-9]+)\.example", "ip": r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", "secret": '"([0-9a-f]{40})"'}
_ENTITIES = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{kind}' AS type, generate_subscripts(n, 1) AS pos, lower(unnest(n)) AS name FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 1) AS n FROM documents)" for k, (kind, p) in enumerate(PATTERNS.items()))


@query(f"""
SELECT doc_id AS id, type, name, type || ':' || name AS entity_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, min(pos), name) AS place FROM ({_ENTITIES}) WHERE name <> '' GROUP BY doc_id, k, type, name""")
def kg_entities(documents):
    """KG1-2."""
    return graph.entities(documents, "doc_id", "text", PATTERNS)


_PAIRS = """
f AS (SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE n <= 8)"""


@query(f"WITH {_PAIRS} SELECT a.l_partkey AS subject, b.l_partkey AS object, count(*) AS weight FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL")
def cooccurrence_edges(lineitem):
    """KG6-7, JN14: parts of an order, eight at most."""
    return graph.cooccurrence(lineitem, "l_orderkey", "l_partkey")


@query(f"WITH {_PAIRS}, e AS (SELECT a.l_partkey AS s, b.l_partkey AS o, count(*) AS weight FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL) SELECT s AS subject, o AS object, weight FROM e ORDER BY weight DESC, s, o LIMIT 10")
def kg_heaviest(lineitem):
    """AGG20: the ten heaviest edges."""
    return graph.cooccurrence(lineitem, "l_orderkey", "l_partkey").orderBy(F.desc("weight"), "subject", "object").limit(10)


@query("""
SELECT l_partkey, domain, CAST(votes AS BIGINT) AS votes FROM (SELECT l_partkey, o_orderpriority AS domain, count(*) AS votes, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END, count(*) DESC, o_orderpriority) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE n = 1""")
def entity_majority(lineitem, orders):
    """KG9, JN4, WIN4: a part's most frequent priority; 5-LOW stands for `general`."""
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", F.col("o_orderpriority").alias("domain"))
    return graph.majority(rows, "l_partkey", "domain", weak="5-LOW")


_TRIPLES = "SELECT DISTINCT l_suppkey AS subject, 'ships' AS predicate, l_partkey AS object, date_trunc('month', l_shipdate) AS valid_from, CASE WHEN l_linestatus = 'F' THEN date_trunc('month', l_shipdate) + INTERVAL 1 MONTH END AS valid_to FROM lineitem"


def _triples(lineitem):
    month = F.date_trunc("month", "l_shipdate")
    return lineitem.select(F.col("l_suppkey").alias("subject"), F.lit("ships").alias("predicate"), F.col("l_partkey").alias("object"), month.alias("valid_from"), F.when(F.col("l_linestatus") == "F", F.add_months(month, 1).cast("timestamp")).alias("valid_to")).distinct()


@query(f"""
WITH t AS ({_TRIPLES}) SELECT entity, dir, count(*) AS edges, count(valid_to) AS closed, min(valid_from) AS since FROM (SELECT subject AS entity, 'out' AS dir, valid_from, valid_to FROM t UNION ALL SELECT object, 'in', valid_from, valid_to FROM t) GROUP BY ALL""")
def timeline_union(lineitem):
    """KG10-11, SET1: each entity's edges from both ends."""
    return graph.timeline(_triples(lineitem)).groupBy("entity", "dir").agg(F.count("*").alias("edges"), F.count("valid_to").alias("closed"), F.min("valid_from").alias("since"))


@query(f"""
WITH t AS ({_TRIPLES}) SELECT * FROM (SELECT subject AS entity, 'out' AS dir, predicate, object AS other, valid_from, valid_to FROM t UNION ALL SELECT object, 'in', predicate, subject, valid_from, valid_to FROM t) WHERE entity = 7 ORDER BY valid_from NULLS LAST, dir, other, valid_to NULLS LAST""")
def full_timeline(lineitem):
    """KG11, SET1, SRT6: all of one entity's edges from both ends in time, undated ones last."""
    return graph.timeline(_triples(lineitem)).where("entity = 7").orderBy(F.col("valid_from").asc_nulls_last(), "dir", "other", F.col("valid_to").asc_nulls_last())


@query("""
SELECT o_custkey, o_orderdate, o_orderstatus, n FROM (SELECT o_custkey, date_trunc('month', o_orderdate) AS o_orderdate, CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'closed' ELSE 'open' END AS o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate))""")
def triple_validity(orders):
    """KG5, KG8: one row a customer and month; closed once all its orders are."""
    month = F.date_trunc("month", "o_orderdate")
    return orders.groupBy("o_custkey", month.alias("month")).agg(F.when(F.count_if(F.col("o_orderstatus") != "F") == 0, "closed").otherwise("open").alias("o_orderstatus"), F.count("*").alias("n")).select("o_custkey", F.col("month").alias("o_orderdate"), "o_orderstatus", "n")


@query("""
WITH once AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS e FROM lineitem), n AS (SELECT count(DISTINCT d) AS n FROM once), df AS (SELECT e, count(*) AS df FROM once GROUP BY e),
rare AS (SELECT e, ln(n / df) AS idf FROM df, n WHERE df > 1 AND df <= greatest(2, floor(n * 0.2))), size AS (SELECT d, count(*) AS size FROM once GROUP BY d), own AS (SELECT d, e, idf FROM once JOIN rare USING (e)),
p AS (SELECT a.d AS source, b.d AS target, count(*) AS shared, sum(a.idf) AS weight FROM own a JOIN own b ON a.e = b.e AND a.d <> b.d GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT source, target, shared, round(weight / log2(size + 2), 6) AS score FROM p JOIN size ON target = d)
SELECT source, target, shared, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM s) WHERE rank <= 4""")
def export_links(lineitem):
    """KG13, JN13: orders as notes, parts as entities."""
    return graph.related(lineitem, "l_orderkey", "l_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def orphan_entities(part, lineitem):
    """JN5: parts that were never in a large line."""
    return graph.unlinked(part.select("p_partkey"), lineitem.where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def embedded_live(documents, embeddings):
    """JN1, JN6: facts with a vector."""
    return documents.join(embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT l_suppkey, o_orderpriority, count(DISTINCT l_orderkey) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def entity_votes(lineitem, orders):
    """AGG25, JN3."""
    return graph.votes(lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "l_suppkey", "l_orderkey", "o_orderpriority")


@query("SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def kg_stats(nation, region, customer, supplier):
    """AGG20: entities by type and place, each counted before the join."""
    c = customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = supplier.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))
