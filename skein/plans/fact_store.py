"""The fact store over documents (facts), labels (outcomes) and orders (confirmations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import vocab
from skein.functions import scoring, text
from skein.operators import facts

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

AS_OF = "2024-06-01 00:00:00"


@query("""
SELECT text_hash, min(doc_id) AS doc_id, count(*) AS confirmations, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs
FROM (SELECT *, sha256(text) AS text_hash FROM documents) GROUP BY text_hash""")
def corroborate_merge(documents):
    """AGG19, MUT1: equal texts are one fact, confirmed by all their sources."""
    rows = documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), F.array("source").alias("sources"), F.array("lang").alias("langs"))
    out = facts.merge_duplicates(rows, "text_hash", "doc_id", ["sources", "langs"])
    return out.select("text_hash", "doc_id", "confirmations", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("sources", "langs")])


_TOKENS = r"list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+')), lambda x: x <> '' AND x NOT IN " + repr(vocab.CONTRADICTION_STOP) + ")"
#: A tenth of the texts say that something was undone, in the words that count.
_TOLD = "CASE doc_id % 20 WHEN 3 THEN text || ' was rolled-back today' WHEN 7 THEN 'It is broken: ' || text ELSE text END"


@query(rf"""
WITH a AS (SELECT item_id AS new_id, {_TOKENS.format("text")} AS w FROM benchmark), b AS (SELECT doc_id AS old_id, {_TOKENS.format(_TOLD)} AS w FROM documents),
l AS (SELECT new_id, list_has_any(w, {list(vocab.NEGATIONS)}) AS n, unnest(w) AS t FROM a), r AS (SELECT old_id, list_has_any(w, {list(vocab.NEGATIONS)}) AS n, unnest(w) AS t FROM b),
p AS (SELECT new_id, old_id, count(*) AS shared FROM l JOIN r ON l.t = r.t AND l.n <> r.n GROUP BY ALL HAVING count(*) >= 5)
SELECT new_id, min(old_id) AS conflict_with, count(*) AS conflicts FROM p GROUP BY new_id""")
def contradictions_all(benchmark, documents):
    """PRJ13, JN11: questions as new facts of every domain against all texts, of which a tenth say that something was undone."""
    new = benchmark.select(F.col("item_id").alias("id"), F.lit("any").alias("domain"), "text")
    told = F.when(F.col("doc_id") % 20 == 3, F.concat("text", F.lit(" was rolled-back today"))).when(F.col("doc_id") % 20 == 7, F.concat(F.lit("It is broken: "), "text")).otherwise(F.col("text"))
    old = documents.select(F.col("doc_id").alias("id"), F.lit("any").alias("domain"), told.alias("text"))
    return facts.contradictions(new, old)


@query("""
SELECT doc_id, round(priority, 6) AS priority FROM (SELECT doc_id, (1 - CASE WHEN toxic = 1 THEN 0.3 ELSE 0.5 END) * (0.4 + quality * 0.3) AS priority FROM documents JOIN labels USING (doc_id)) ORDER BY round(priority, 6) DESC, doc_id LIMIT 50""")
def review_queue(documents, labels):
    """SRT2: the fifty facts most worth a review."""
    confidence = F.when(F.col("toxic") == 1, 0.3).otherwise(0.5)
    priority = F.round((1 - confidence) * (0.4 + F.col("quality") * 0.3), 6).alias("priority")
    return documents.join(labels, "doc_id").select("doc_id", priority).orderBy(F.desc("priority"), "doc_id").limit(50)


_DECAY = f"""
SELECT o_orderkey, o_orderpriority, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400000000.0 AS age,
  CASE o_orderstatus WHEN 'F' THEN 'finding' WHEN 'O' THEN 'auto-mined' ELSE 'compaction' END AS prov,
  CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.6 ELSE 0.9 END AS pw, CASE WHEN starts_with(o_orderpriority, '1') THEN 'live' ELSE 'operational' END AS kind,
  CASE WHEN o_custkey % 3 = 0 THEN 1.5 ELSE 1.0 END AS cross_model, CASE WHEN o_custkey % 5 = 0 THEN 0.7 ELSE 1.0 END AS reliability, o_orderkey % 9 AS cc, CASE WHEN o_custkey % 7 = 0 THEN 1.2 WHEN o_custkey % 7 = 1 THEN 0.3 ELSE 1.0 END AS om FROM orders"""
_SCORED = f"""
SELECT *, round(greatest(0.1, least(1.0, greatest(pw * reliability * cross_model, 0.4) * om * (0.3 + 0.7 * CASE WHEN kind = 'live' THEN exp(-0.02 * 3.0 * age) WHEN prov = 'finding' THEN 1.0 ELSE exp(-0.02 * age) END)
  * (0.5 + 0.5 * (least(log2(greatest(1, cc) + 1), 3.0) / 3.0)))), 7) AS score FROM ({_DECAY})"""


def _scored(orders):
    status = F.col("o_orderstatus")
    provenance = F.when(status == "F", "finding").when(status == "O", "auto-mined").otherwise("compaction")
    age = scoring.age_days(F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp"))
    score = facts.decayed_score(
        provenance,
        F.when(F.col("o_custkey") % 5 == 0, "autonomous").otherwise("human"),
        F.when(F.col("o_custkey") % 7 == 0, "confirmed").when(F.col("o_custkey") % 7 == 1, "refuted").otherwise("none"),
        F.when(F.col("o_orderpriority").startswith("1"), "live").otherwise("operational"),
        F.when(F.col("o_custkey") % 3 == 0, 2).otherwise(1),
        F.lit(0.4),
        F.col("o_orderkey") % 9,
        age,
        places=7,
    )
    return orders.withColumn("score", score)


@query(f"SELECT o_orderkey, score FROM ({_SCORED})")
def decay_scores(orders):
    """MUT9-10, MTH5: orders as facts last seen on their date."""
    return _scored(orders).select("o_orderkey", "score")


@query(f"""
WITH s AS ({_SCORED}), a AS (SELECT round(pw, 1) AS bucket, count(*) AS n FROM s GROUP BY 1), b AS (SELECT round(score, 1) AS bucket, count(*) AS n FROM s GROUP BY 1)
SELECT CAST(bucket AS DOUBLE) AS bucket, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL JOIN b USING (bucket)""")
def rescore_hist(orders):
    """AGG21, MUT10: tenths before (the provenance's weight) and after."""
    before = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.6).otherwise(0.9)
    return facts.histogram_change(_scored(orders).withColumn("pw", before), "pw", "score")


@query("""
WITH f AS (SELECT o_orderkey AS id, o_custkey AS cluster, o_orderkey % 5 AS confirmations, o_orderstatus = 'F' AS verified, o_totalprice AS score, CASE WHEN o_orderkey % 4 = 0 THEN 'confirmed' ELSE 'auto' END AS review_state FROM orders),
one AS (SELECT *, CASE WHEN review_state = 'auto' AND confirmations >= 2 AND NOT verified THEN 'pending' ELSE review_state END AS state FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY verified DESC, confirmations DESC, score DESC, id) AS place, count(*) OVER (PARTITION BY cluster) AS members, max(confirmations) OVER (PARTITION BY cluster) AS most FROM one),
t AS (SELECT *, members > 1 AND most >= 3 AND place > 1 AND state = 'auto' AS loser FROM r)
SELECT CASE WHEN state <> review_state THEN 1 WHEN loser THEN 2 ELSE 0 END AS tier, CASE WHEN loser THEN 'pending' ELSE state END AS state, count(*) AS n FROM t GROUP BY ALL""")
def demote_counts(orders):
    """MUT11, WIN5: a customer's orders are a cluster."""
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"), (F.col("o_orderkey") % 5).alias("confirmations"), (F.col("o_orderstatus") == "F").alias("verified"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 4 == 0, "confirmed").otherwise("auto").alias("review_state"))
    return facts.demote(rows).groupBy("tier", "state").agg(F.count("*").alias("n"))


@query("""
SELECT coalesce(o.k, d.k) AS k, coalesce(d.total, o.total) AS total, coalesce(o.first, d.first) AS first, coalesce(o.n, 0) + coalesce(d.n, 0) AS n,
  CASE WHEN o.k IS NULL THEN 'inserted' WHEN d.k IS NULL THEN 'kept' ELSE 'updated' END AS status
FROM (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS total, min(o_orderkey) AS first, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o
FULL JOIN (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS total, min(o_orderkey) AS first, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) d ON o.k = d.k""")
def outcome_upsert(orders):
    """MUT1, MUT13: closed orders are the old table, open ones the delta."""
    own = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.max("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first"), F.count("*").alias("n"))
    return facts.upsert(own("F"), own("O"), "k", ["total"], ["first"], ["n"]).select("k", "total", "first", "n", "status")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins(events):
    """SNK2, WIN3."""
    return facts.last_wins(events, "user_id", F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreviewed(documents, labels):
    """JN7-8, MUT3: documents without a verdict."""
    return facts.not_in(documents, labels, "doc_id").select("doc_id", "source")


@query("""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'confirmed' ELSE 'auto' END AS review_state, CASE WHEN toxic = 1 THEN 0.5 WHEN quality = 1 THEN 1.0 ELSE 0.5 END AS confidence, CASE WHEN toxic = 1 THEN 'rejected' END AS outcome
FROM documents LEFT JOIN labels USING (doc_id)""")
def verdicts(documents, labels):
    """MUT7: labels as a reviewer's verdicts."""
    rows = documents.select("doc_id", F.lit("auto").alias("review_state"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("outcome"))
    given = labels.select("doc_id", F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "confirmed").alias("verdict"))
    return facts.verdicts(rows, given, "doc_id")


@query("SELECT doc_id, least(c, CASE WHEN same THEN 0.3 ELSE 1.0 END) AS confidence, CASE WHEN same OR c < 0.5 THEN 'pending' ELSE 'auto' END AS state FROM (SELECT doc_id, CASE WHEN contains(text, 'example.com') THEN 0.85 ELSE 0.5 END AS c, count(*) OVER (PARTITION BY text) > 1 AS same FROM documents)")
def insert_states(documents):
    """MUT2: a conflict (here: an equal text) caps confidence and asks for a review."""
    equal = documents.groupBy(F.xxhash64("text").alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("s")).agg(F.count("*").alias("n")).where("n > 1")
    joined = documents.withColumn("own", F.sha2(F.col("text").cast("binary"), 256)).join(equal.select("s", "n"), F.col("own") == F.col("s"), "left")
    confidence, state = facts.review_state(F.when(F.col("text").contains("example.com"), 0.85).otherwise(0.5), F.col("n"))
    return joined.select("doc_id", confidence.alias("confidence"), state.alias("state"))


@query("SELECT lang, doc_id, CAST(rank AS BIGINT) AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 20")
def top_per_domain(documents):
    """WIN2, SRT10: the twenty longest facts of each domain."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    return documents.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 20").select("lang", "doc_id", "rank")


@query("SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 50000")
def char_budget(documents):
    """WIN13: what fits 50 000 characters of each source, in order."""
    from pyspark.sql import Window

    used = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return documents.withColumn("used", used).where("used <= 50000").select("source", "doc_id", "used")


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[a-z0-9_.]+@[a-z0-9.]+'))) AS BIGINT) AS addresses, substr(sha256(lower(text)), 1, 16) AS k FROM documents WHERE contains(text, '@')")
def mined_addresses(documents):
    """HSH2: addresses in texts."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9_.]+@[a-z0-9.]+"), 0))
    return documents.where(F.col("text").contains("@")).select("doc_id", F.size(found).cast("long").alias("addresses"), text.fact_key(F.col("text"), lower=True).alias("k"))
