"""What a question is given: documents as facts, questions as tasks, labels as reviews, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import vocab
from skein.functions import scoring
from skein.operators import evaluation, injection

from .ranking import _RANKED, _nearest
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

_PLAIN = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\f\r]+'), lambda x: x <> '')"
SKILLS = {"fact": ("en",), "les": ("fr", "es")}

#: Facts, tasks and vectors out of the driver's tables: types, states and gaps follow from ids, so all factors occur.
_INPUT = rf"""
facts AS (SELECT doc_id AS id, lang AS domain, text, ['finding', 'procedure', 'observation', 'operational'][1 + doc_id % 4] AS fact_type, coalesce(quality * 0.9, 0.2) AS stored, CASE WHEN toxic = 1 THEN 'pending' ELSE 'auto' END AS review, source AS agent, CAST(doc_id % 50 AS DOUBLE) AS gap_days, sha256(text) AS digest
  FROM documents LEFT JOIN labels USING (doc_id)),
d AS (SELECT id, {_PLAIN} AS w FROM facts), size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({_PLAIN}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT qid, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean)))) AS bm25 FROM p JOIN df USING (term) JOIN q USING (term), size GROUP BY qid, id),
dp AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) WHERE term IN {vocab.DECISION_WORDS} GROUP BY ALL), dd AS (SELECT term, count(*) AS df FROM dp GROUP BY term),
ti AS (SELECT id, sum(tf * ln(n / df)) AS tfidf FROM dp JOIN dd USING (term), size GROUP BY id),
ag AS (SELECT digest FROM facts GROUP BY digest HAVING count(DISTINCT agent) >= 2),
co AS (SELECT a.item_id AS qid, f.vec_id AS id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) AS cosine FROM benchmark a JOIN embeddings e ON e.vec_id = a.item_id CROSS JOIN embeddings f)"""
_PHRASES = r"""list_filter(list_transform(regexp_extract_all(b.text, '''([^'']{3,60})''', 1) || regexp_extract_all(b.text, '"([^"]{3,60})"', 1), lambda p: lower(trim(p))), lambda p: length(p) >= 3)"""
_SHARE = "CASE WHEN len({0}) = 0 THEN 0.0 ELSE len(list_filter({0}, lambda x: contains(lower(f.text), x))) / len({0}) END"
_FAVOURED = " OR ".join(f"(contains(lower(b.text), '{k}') AND domain IN ({', '.join(map(repr, ds))}))" for k, ds in SKILLS.items())
_SCORED = rf"""{_INPUT},
x AS (SELECT bm.qid, f.id, f.text, f.digest, greatest(1, length(f.text) // 4) AS tokens, 0.3 * coalesce(tfidf, 0) + 0.7 * bm25 AS base, cosine,
  (1 + 0.3 * {_SHARE.format(_PHRASES)}) * (1 + 0.2 * {_SHARE.format(f"regexp_extract_all(lower(b.text), '{vocab.ENTITY_NAMES}')")}) AS asked,
  exp(-ln(2) / 90.0 * gap_days) * CASE fact_type WHEN 'finding' THEN 1.3 WHEN 'procedure' THEN 1.2 WHEN 'observation' THEN 0.5 ELSE 1.0 END * CASE WHEN review = 'pending' THEN 0.6 ELSE 1.0 END * CASE WHEN {_FAVOURED} THEN 1.8 ELSE 1.0 END AS factor,
  CASE WHEN stored > 0.35 THEN 0.8 + 0.4 * stored ELSE 1.0 END * CASE WHEN ag.digest IS NOT NULL THEN 1.5 ELSE 1.0 END AS repeated
  FROM bm JOIN facts f USING (id) JOIN benchmark b ON b.item_id = bm.qid LEFT JOIN ti ON ti.id = f.id LEFT JOIN ag ON ag.digest = f.digest LEFT JOIN co ON co.qid = bm.qid AND co.id = f.id),
s AS (SELECT qid, id, digest, tokens, round(CASE WHEN cosine IS NULL THEN base WHEN cosine < 0.3 THEN base * 0.1 ELSE base * 0.4 + cosine * 0.6 END * asked * factor * least(repeated, 1.4), 6) AS score FROM x)"""


def _cosines(tasks, embeddings):
    """qid, id, cosine of the stated questions that have a vector, against all vectors."""
    asked = tasks.join(embeddings, F.col("qid") == F.col("vec_id")).select("qid", F.col("embedding").alias("qv"))
    return embeddings.select(F.col("vec_id").alias("id"), "embedding").join(asked).select("qid", "id", scoring.dot(F.col("embedding"), F.col("qv")).alias("cosine"))


def _scored(documents, benchmark, labels, embeddings):
    rows = documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), "text", F.col("source").alias("agent")).join(labels.withColumnRenamed("doc_id", "id"), "id", "left")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("finding", "procedure", "observation", "operational")]), (F.col("id") % 4 + 1).cast("int"))
    facts = rows.select("id", "domain", "text", kind.alias("fact_type"), F.coalesce(F.col("quality") * 0.9, F.lit(0.2)).alias("stored"), F.when(F.col("toxic") == 1, "pending").otherwise("auto").alias("review"), "agent", (F.col("id") % 50).cast("double").alias("gap_days"))
    tasks = benchmark.select(F.col("item_id").alias("qid"), "text")
    vectors = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return injection.score_facts(facts, tasks, vectors, SKILLS, cap=1.4).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORED} SELECT qid, id, score, tokens FROM s")
def injection_scores(documents, benchmark, labels, embeddings):
    """RET1-4, TXT2-4, MTH3, MTH8, JN25: every fact's score for every question: keyword blend, cosine, factors of question, type, review, age and repetition."""
    return _scored(documents, benchmark, labels, embeddings).select("qid", "id", "score", "tokens")


#: Facts of a young domain: exempt from floors and budget.
_YOUNG = "id % 97 = 0"


@query(f"""
WITH RECURSIVE {_SCORED},
ok AS (SELECT *, {_YOUNG} AS free, score / tokens AS priority FROM s WHERE {_YOUNG} OR (score > 0 AND tokens <= 2000 AND score / tokens >= 0.04)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, digest, free ORDER BY priority DESC, id) AS copy FROM ok) WHERE copy = 1),
c AS (SELECT qid, id, tokens, free, digest, row_number() OVER (PARTITION BY qid ORDER BY priority DESC, id) AS n FROM one),
fold(qid, n, remaining, spent, kept, id, tokens, took, seen) AS (SELECT DISTINCT qid, CAST(0 AS BIGINT), CAST(2000 AS BIGINT), false, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false, CAST([] AS VARCHAR[]) FROM c UNION ALL
  SELECT qid, n, remaining - CASE WHEN take THEN tokens ELSE 0 END, spent OR (take AND NOT free AND remaining - tokens <= 0), kept + CAST(take AS BIGINT), id, tokens, take, CASE WHEN take THEN list_append(seen, digest) ELSE seen END
  FROM (SELECT c.qid, CAST(c.n AS BIGINT) AS n, fold.remaining, fold.spent, fold.kept, c.id, CAST(c.tokens AS BIGINT) AS tokens, c.free, c.digest, fold.seen, NOT fold.spent AND (c.free OR c.tokens <= fold.remaining) AND fold.kept < 8 AND NOT list_contains(fold.seen, c.digest) AS take FROM fold JOIN c ON c.qid = fold.qid AND c.n = fold.n + 1))
SELECT qid, kept AS place, id, tokens FROM fold WHERE took""")
def injected(documents, benchmark, labels, embeddings):
    """RET1, RET12, SRT1, WIN12: what each question is given within 2000 tokens, of equal texts one; facts of a young domain are exempt. The oracle folds step by step."""
    scored = _scored(documents, benchmark, labels, embeddings).withColumn("young", F.col("id") % 97 == 0)
    return injection.inject(scored, 2000, bootstrap="young")


_STOP = "(" + ", ".join(repr(w) for w in injection.FILE_STOP) + ")"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_ \t\n\f\r]', ' ', 'g'), '[ \t\n\f\r]+'), lambda x: x <> ''))"
_FILES = rf"""
files AS (SELECT doc_id AS id, ['feedback', 'domain', 'project', 'user', 'reference'][1 + doc_id % 5] AS type, source AS name, CASE WHEN doc_id % 17 = 0 THEN 'Hard Gate of ' || lang ELSE lang END AS description, text AS body FROM documents),
q AS (SELECT item_id AS qid, unnest(list_filter({_WORDS}, lambda x: x NOT IN {_STOP})) AS term FROM benchmark),
d AS (SELECT id, {_PLAIN.replace("lower(text)", "lower(name || ' ' || description || ' ' || body)")} AS w FROM files),
p AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT qid, id, sum(ln(((SELECT count(*) FROM files) + 1) / (df + 1) + 0.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / 200))) AS w FROM p JOIN df USING (term) JOIN q USING (term) GROUP BY qid, id),
f AS (SELECT qid, id, type, hard, round(CASE WHEN hard THEN w * 1.5 ELSE w END, 6) AS score FROM s JOIN (SELECT *, contains(lower(description), 'hard gate') OR (type IN ('feedback', 'domain') AND contains(body, 'HARD GATE')) AS hard FROM files) USING (id))"""
_MOST = "CASE type WHEN 'feedback' THEN 3 WHEN 'domain' THEN 2 ELSE 1 END"


def _files(documents, benchmark):
    kind = F.element_at(F.array(*[F.lit(x) for x in injection.FILE_TYPES]), (F.col("doc_id") % 5 + 1).cast("int"))
    files = documents.select(F.col("doc_id").alias("id"), kind.alias("type"), F.col("source").alias("name"), F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("Hard Gate of "), "lang")).otherwise(F.col("lang")).alias("description"), F.col("text").alias("body"))
    return injection.file_scores(files, benchmark.select(F.col("item_id").alias("qid"), "text")).withColumn("score", F.round("score", 6))


def _gated(base: str) -> str:
    return f"""
g AS ({base}), n AS (SELECT *, row_number() OVER (PARTITION BY qid, type, hard AND type = 'feedback' ORDER BY score DESC, id) AS n FROM g),
k AS (SELECT * FROM n WHERE ((hard AND type = 'feedback') OR n <= {_MOST}) AND score > 1.0)
SELECT qid, id, type, hard, score, CAST(row_number() OVER (PARTITION BY qid, type ORDER BY score DESC, id) AS BIGINT) AS place FROM k"""


@query(f"WITH {_FILES}, {_gated('SELECT * FROM f WHERE score > 3.0')}")
def memory_files(documents, benchmark):
    """RET11: the best notes of each type for a question, by keywords alone; hard gates of feedback aren't counted."""
    return injection.gate_files(_files(documents, benchmark))


_COSINE = "c AS (SELECT a.item_id AS qid, v.vec_id AS id, round(abs(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))), 9) * 4 AS cosine FROM benchmark a JOIN embeddings e ON e.vec_id = a.item_id CROSS JOIN embeddings v)"
_LEAST = "CASE type WHEN 'feedback' THEN 0.30 WHEN 'domain' THEN 0.40 WHEN 'project' THEN 0.50 WHEN 'user' THEN 0.30 ELSE 0.40 END"


@query(
    f"WITH {_FILES}, {_COSINE}, "
    + _gated(f"SELECT qid, id, type, hard, round(CASE WHEN cosine IS NULL THEN score * 0.5 WHEN cosine < {_LEAST} THEN 0.2 * score + 0.8 * cosine * cosine * 40 ELSE 0.3 * score + 0.7 * cosine * cosine * 60 END, 9) AS score FROM f LEFT JOIN c USING (qid, id) WHERE cosine IS NULL OR cosine >= {_LEAST} OR (hard AND cosine >= 0.2)")
)
def memory_files_semantic(documents, benchmark, embeddings):
    """RET11: the same with vectors as the gate; the driver's are far apart, so cosines count fourfold."""
    tasks = benchmark.select(F.col("item_id").alias("qid"))
    cosines = _cosines(tasks, embeddings).select("qid", "id", (F.round(F.abs("cosine"), 9) * 4).alias("cosine"))
    gated = injection.gate_files(_files(documents, benchmark), cosines)
    return gated.withColumn("score", F.round("score", 9)).select("qid", "id", "type", "hard", "score", "place")


_UNITS = r"""
u AS (SELECT conv_id * 100 + turn AS unit, conv_id AS session, list_filter(regexp_split_to_array(lower(text), '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM conversations),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM u),
p AS (SELECT unit, term, count(*) AS tf, any_value(l) AS l FROM (SELECT unit, len(w) AS l, unnest(w) AS term FROM u) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY ALL)"""
_HYBRID = rf"""{_UNITS},
q AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_ \t\n\f\r]', ' ', 'g'), '[ \t\n\f\r]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT unit, sum(tf * ln(n / df)) AS s FROM p JOIN df USING (term), size WHERE term IN {vocab.DECISION_WORDS} GROUP BY unit),
b AS (SELECT qid, unit, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / greatest(mean, 1))))) AS s FROM p JOIN df USING (term) JOIN q USING (term), size GROUP BY qid, unit),
r AS (SELECT item_id AS qid, u.unit, session, round(0.3 * coalesce(t.s, 0) + 0.7 * coalesce(b.s, 0), 6) AS score FROM benchmark CROSS JOIN u LEFT JOIN t ON t.unit = u.unit LEFT JOIN b ON b.unit = u.unit AND b.qid = item_id),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM r),
o AS (SELECT qid, session, row_number() OVER (PARTITION BY qid ORDER BY min(rank), session) AS rank FROM k GROUP BY qid, session)"""


def _sessions(conversations, benchmark):
    units = conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("unit"), F.col("conv_id").alias("session"), "text")
    return evaluation.rank_shared(units, benchmark.select(F.col("item_id").alias("qid"), "text"))


@query(f"WITH {_HYBRID} SELECT qid, session, CAST(rank AS BIGINT) AS rank FROM o")
def ranked_conversations(conversations, benchmark):
    """RET10, WIN18: all conversations by their best turn, for each question."""
    return _sessions(conversations, benchmark)


@query(f"""
WITH {_HYBRID}, gold AS (SELECT DISTINCT b.item_id AS qid, c.conv_id AS session FROM benchmark b JOIN conversations c ON c.conv_id % 3 = b.item_id % 3)
SELECT qid, round(coalesce(1 / min(rank), 0), 6) AS reciprocal_rank, CAST(count(*) FILTER (rank <= 5) > 0 AS INTEGER) AS hit, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall FROM gold LEFT JOIN o USING (qid, session) GROUP BY qid""")
def session_scores(conversations, benchmark):
    """WIN17, SET5, AGG23: the ranking of all conversations against gold ones (those of a question's remainder)."""
    asked = benchmark.select(F.col("item_id").alias("qid"), (F.col("item_id") % 3).alias("part"))
    gold = conversations.select(F.col("conv_id").alias("session"), (F.col("conv_id") % 3).alias("part")).distinct().join(asked, "part").drop("part")
    scored = evaluation.session_scores(_sessions(conversations, benchmark), gold, 5)
    return scored.select("qid", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "hit", F.round("recall", 6).alias("recall"))


@query(f"WITH {_RANKED}, o AS (SELECT qid, label AS session, min(rank) AS first FROM ranked WHERE rank <= 50 GROUP BY qid, label) SELECT qid, session, row_number() OVER (PARTITION BY qid ORDER BY first, session) AS rank FROM o")
def ranked_labels(embeddings):
    """RET10, WIN18: vectors as units, labels as sessions: of the fifty nearest each label once, in order."""
    near = _nearest(embeddings, 50).join(embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("session")), "id")
    return evaluation.ranked_sessions(near.select("qid", "session", "rank"))
