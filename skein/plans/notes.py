"""Notes with pointers, skills, suggestions and evaluation sets over the driver's tables: texts are notes and outputs, parts are skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import evaluation, health, ingest, injection, markdown, pointers, routing

from .ranking import _WORDS
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

#: A text is the home `domain/n7.md` of a note (even ids) or a file of another folder; another text's bullet points at it.
_BULLETS = """b AS (SELECT doc_id AS id, doc_id * 3 + 1 AS t, doc_id % 4 AS kind, CASE doc_id % 4 WHEN 3 THEN '[pin] ' ELSE '' END AS pin FROM documents),
f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'domain/n' || doc_id || '.md' ELSE 'other/n' || doc_id || '.md' END AS path FROM documents)"""


def _notes(documents):
    d, n = F.col("doc_id"), lambda c: c.cast("string")
    name = F.concat(F.lit("n"), n(d * 3 + 1), F.lit(".md"))
    target = F.when(d % 4 == 0, name).otherwise(F.concat(F.lit("domain/"), name))
    line = F.concat(F.lit("- "), F.when(d % 4 == 3, "[pin] ").otherwise(""), F.lit("fixed `lease-"), n(d), F.lit("` and **quorum"), n(d), F.lit("** → "), target, F.lit(" §Lease rules"))
    lines = markdown.lines(documents.select(d.alias("id"), line.alias("text")), "id", "text")
    path = F.concat(F.when(d % 2 == 0, "domain/n").otherwise("other/n"), n(d), F.lit(".md"))
    # a home tells of the bullet that points at it, but every fifth
    owner = ((d - 1) / 3).cast("long")
    told = F.when(d % 5 != 0, F.concat(F.lit("\nlease-"), n(owner), F.lit(" after quorum"), n(owner))).otherwise("")
    heading = F.when(d % 7 == 0, "# Other things").otherwise("# Leases and rules")
    texts = documents.select(path.alias("path"), F.concat(heading, told).alias("text"))
    return lines, pointers.resolve(pointers.pointers(lines), texts), texts


_FOUND = f"""{_BULLETS}, p AS (SELECT b.*, CASE WHEN kind = 0 THEN 'n' || t || '.md' ELSE 'domain/n' || t || '.md' END AS target, doc_id, path AS there FROM b LEFT JOIN f ON doc_id = t),
r AS (SELECT *, CASE WHEN target = there THEN 'ok' WHEN doc_id IS NULL OR kind <> 0 THEN 'dangling' ELSE 'unqualified' END AS state FROM p)"""


@query(f"WITH {_FOUND} SELECT id, target, 'Lease rules' AS anchor, state, CASE WHEN state IN ('ok', 'unqualified') THEN there END AS path FROM r")
def note_pointers(documents):
    """TXT23-24, LNT4-5, JN22: pointers of bullets with their anchors, and whether what they name is there."""
    return _notes(documents)[1].select("id", "target", "anchor", "state", "path")


@query(f"WITH {_FOUND} SELECT id, target, 'Lease rules' AS anchor FROM r WHERE state IN ('ok', 'unqualified') AND doc_id % 7 = 0")
def missing_anchors(documents):
    """TXT26, LNT5: anchors whose words begin no word of a heading of the target."""
    _, found, texts = _notes(documents)
    return pointers.anchor_missing(found, texts).select("id", "target", "anchor")


_EVICT = f"{_FOUND}, e AS (SELECT id, state IN ('ok', 'unqualified') AND doc_id % 5 <> 0 AND kind <> 3 AS evict FROM r)"


@query(f"WITH {_EVICT} SELECT id, coalesce(evict, false) AS evict FROM e")
def evictable_bullets(documents):
    """PRJ29, JN27, TXT22, TXT25, LNT6: bullets whose identifiers stand in the files that they point at; pinned ones stay."""
    return pointers.evictable(*_notes(documents)).select("id", "evict")


@query(f"WITH {_EVICT} SELECT id, CASE WHEN evict THEN 'archive' ELSE 'stays' END AS part FROM e")
def rolled_notes(documents):
    """SNK9: lines that stay and lines for the archive."""
    lines, found, texts = _notes(documents)
    stay, gone = pointers.roll(lines, pointers.evictable(lines, found, texts))
    return stay.select("id", F.lit("stays").alias("part")).unionByName(gone.select("id", F.lit("archive").alias("part")))


_SIZED = """s AS (SELECT path, CASE WHEN text = '' THEN 0 ELSE len(string_split(CASE WHEN text[-1:] = chr(10) THEN text[:-2] ELSE text END, chr(10))) END AS lines, octet_length(encode(text)) AS bytes, CASE WHEN lang IN ('en', 'de') THEN 3 ELSE 10 END AS warn, CASE WHEN lang IN ('en', 'de') THEN 8 ELSE 20 END AS error
  FROM (SELECT lang || '/n' || doc_id || '.md' AS path, lang, text FROM documents)), z AS (SELECT *, CASE WHEN lines >= error THEN 'RED' WHEN lines >= warn THEN 'YELLOW' ELSE 'GREEN' END AS status FROM s)"""


def _sized(documents):
    limits = documents.sparkSession.createDataFrame([("en", 3, 8), ("de", 3, 8), ("other", 10, 20)], "kind string, warn long, error long")
    path = F.concat(F.col("lang"), F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    return health.sizes(documents.select(path.alias("path"), "text"), limits)


@query(f"WITH {_SIZED} SELECT path, CAST(lines AS BIGINT) AS lines, CAST(bytes AS BIGINT) AS bytes, status FROM z")
def note_sizes(documents):
    """LNT8, PRJ23: lines and bytes of notes by their folder's limits."""
    return _sized(documents)


@query(f"""WITH {_SIZED} SELECT 'drift-2024-01-02.md' AS name, path, 'lines' AS "check", CAST(lines AS VARCHAR) AS detail FROM z WHERE status <> 'GREEN' UNION ALL
SELECT 'drift-2024-01-02.md', path, 'bytes', CAST(bytes AS VARCHAR) FROM z WHERE path = 'en/n0.md' AND bytes >= {health.BYTE_WARN}""")
def drift_findings(documents):
    """LNT8, LNT12: findings of all notes as a dated report."""
    return health.drift_report(health.health(_sized(documents), "en/n0.md"), F.to_date(F.lit("2024-01-02"))).select("name", "path", "check", "detail")


@query("""
WITH l AS (SELECT doc_id AS line_no, '- ' || text[1:80] AS line, 'dns' IN (CASE doc_id % 3 WHEN 0 THEN 'dns' END) AS net, doc_id % 9 = 0 AS universal FROM documents)
SELECT line_no, 'networking' AS domain FROM l WHERE net AND NOT universal""")
def misplaced_bullets(documents):
    """LNT9: bullets of the common note that belong into a domain's; universal rules stay."""
    told = F.when(F.col("doc_id") % 3 == 0, "- the DNS of it").otherwise("- xyzzy")
    line = F.concat(told, F.when(F.col("doc_id") % 9 == 0, ", never touch").otherwise(""))
    return health.misplaced(documents.select(F.col("doc_id").alias("line_no"), line.alias("line"))).select("line_no", "domain")


#: Parts as skills.
_TERMS = ("small", "ring", "economy")
_GLOBS = ("src/**/*.py", "src/b*/**", "**")
_PATHS = ("src/building/a.py", "src/auto/b.txt", "docs/x.py")


def _skills(part):
    k = F.col("p_partkey")
    gate = F.when(k % 10 == 0, "always").when(k % 10 == 1, "hard").otherwise("reference")
    glob = lambda g: F.struct(F.lit(text.glob_pattern(g)).alias("pattern"), F.lit(float(text.glob_specificity(g))).alias("specificity"))
    none = F.array().cast("array<struct<pattern:string,specificity:double>>")
    globs = F.when(k % 7 == 0, F.array(glob(_GLOBS[0]), glob(_GLOBS[2]))).when(k % 7 == 1, F.array(glob(_GLOBS[1]))).otherwise(none)
    name = lambda c: F.concat(F.lit("k"), c.cast("string"))
    skills = part.select(name(k).alias("name"), gate.alias("gate"), F.col("p_size").cast("long").alias("tokens"), F.col("p_name").alias("trigger"), F.lit("").alias("description"), F.lower("p_brand").alias("domain"), F.lower("p_type").alias("body"), globs.alias("globs"), F.array(name(k + 1)).alias("also_load"))
    files = part.sparkSession.createDataFrame([(p,) for p in _PATHS], "path string")
    return skills, routing.skill_scores(skills, F.array(*[F.lit(t) for t in _TERMS]), files)


def _glob_points(which: tuple[str, ...]) -> float:
    import re

    return sum(max((float(text.glob_specificity(g)) for g in which if re.search(text.glob_pattern(g), p)), default=0.0) for p in _PATHS)


_SCORES = f"""
s AS (SELECT 'k' || p_partkey AS name, p_partkey AS k, CASE p_partkey % 10 WHEN 0 THEN 'always' WHEN 1 THEN 'hard' ELSE 'reference' END AS gate, CAST(p_size AS BIGINT) AS tokens,
  CASE p_partkey % 7 WHEN 0 THEN {_glob_points((_GLOBS[0], _GLOBS[2]))} WHEN 1 THEN {_glob_points((_GLOBS[1],))} ELSE 0.0 END AS path_score,
  len(list_filter({list(_TERMS)}, lambda t: list_contains(string_split(lower(p_name), ' '), t))) AS own, len(list_filter({list(_TERMS)}, lambda t: list_contains(string_split(lower(p_type), ' '), t))) AS body FROM part),
x AS (SELECT *, path_score * 10.0 + own * 3.0 + body * 0.5 AS base FROM s),
y AS (SELECT *, CASE WHEN gate = 'hard' THEN greatest(base, 0.5) * 1.5 ELSE base END / greatest(1, tokens) AS score, CASE WHEN path_score > 0 THEN 'path-glob' WHEN gate = 'hard' AND own = 0 AND body = 0 THEN 'gate-floor' WHEN own > 0 THEN 'keyword' WHEN body > 0 THEN 'body-keyword' ELSE 'none' END AS signal FROM x)"""


@query(f"WITH {_SCORES} SELECT name, round(score, 9) AS score, signal FROM y WHERE gate <> 'always'")
def scored_skills(part):
    """RET13, TXT19-20, SET4: skills by paths, words of the front and of the body, gates, for each token."""
    return _skills(part)[1].where("gate != 'always'").select("name", F.round("score", 9).alias("score"), "signal")


@query(f"""
WITH RECURSIVE {_SCORES}, c AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS n FROM y WHERE gate <> 'always' AND score > 0),
fold(n, room, name, took) AS (SELECT CAST(0 AS BIGINT), CAST(60 AS BIGINT), CAST(NULL AS VARCHAR), false UNION ALL SELECT c.n, room - CASE WHEN tokens <= room THEN tokens ELSE 0 END, c.name, tokens <= room FROM fold JOIN c ON c.n = fold.n + 1),
p AS (SELECT name FROM fold WHERE took), rest AS (SELECT min(room) AS room FROM fold),
h AS (SELECT DISTINCT 'k' || (s.k + 1) AS name FROM p JOIN s ON s.name = p.name)
SELECT name, 'always' AS why FROM s WHERE gate = 'always' UNION ALL SELECT name, 'score' FROM p
UNION ALL SELECT h.name, 'also' FROM h JOIN s ON s.name = h.name, rest WHERE s.tokens <= room AND h.name NOT IN (SELECT name FROM p) AND gate <> 'always'""")
def chosen_skills(part):
    """RET14, JN24: always-gated skills, the best within sixty tokens, and what those load."""
    return routing.select_skills(_skills(part)[1], 60).select("name", "why")


@query(f"WITH {_SCORES} SELECT name, CAST(row_number() OVER (ORDER BY score DESC, name) AS BIGINT) AS place FROM y WHERE gate <> 'always' AND score > 0 ORDER BY score DESC, name LIMIT 5")
def recommended_skills(part):
    """RET18, SRT8: the five best."""
    return injection.recommend(_skills(part)[1]).select("name", "place")


@query("SELECT 'k' || p_partkey AS name, CASE p_partkey WHEN 7 THEN 'guide' ELSE 'also' END AS part, lower(p_type) AS body FROM part WHERE p_partkey IN (7, 8)")
def primed_session(part):
    """RET18: a session's skill and what it loads along."""
    return injection.prime(_skills(part)[0], " K7 ", ("k7", "k9"))


@query(f"""
WITH w AS (SELECT item_id AS qid, unnest({_WORDS}) AS term, unnest(range(1, len({_WORDS}) + 1)) AS n FROM benchmark), f AS (SELECT qid, term, min(n) AS n FROM w WHERE length(term) >= 4 GROUP BY qid, term),
q AS (SELECT qid, term FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n) AS k FROM f) WHERE k <= 10),
h AS (SELECT DISTINCT qid, doc_id AS id, lang, n_chars % 1000 AS score FROM documents JOIN q ON contains(lower(text), term)),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM h), v AS (SELECT qid, lang AS domain, count(*) AS votes FROM b WHERE k <= 20 GROUP BY qid, lang),
c AS (SELECT qid, domain FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, domain) AS k FROM v) WHERE k = 1)
SELECT item_id AS qid, CASE WHEN item_id % 5 = 0 THEN 'net' WHEN item_id % 5 = 1 THEN 'sto' ELSE coalesce(domain, 'hint') END AS domain, CASE WHEN item_id % 5 = 0 THEN 'keyword' WHEN item_id % 5 = 1 THEN 'entity' WHEN domain IS NOT NULL THEN 'corpus' ELSE 'hint' END AS source FROM benchmark LEFT JOIN c ON c.qid = item_id""")
def suggested_domains(documents, benchmark):
    """RET16-17, JN10: the domain of a question by keyword, entity, texts or hint, in this order."""
    facts = documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), "text", (F.col("n_chars") % 1000).alias("score"))
    asked = benchmark.select(F.col("item_id").alias("qid"), "text")
    told = lambda rest, domain: asked.where(F.col("qid") % 5 == rest).select("qid", F.lit(domain).alias("domain"))
    entity = told(1, "sto").unionByName(told(0, "never"))
    return routing.suggest(asked, told(0, "net"), entity, routing.corpus_domains(facts, asked), F.lit("hint")).withColumnRenamed("by", "source")


@query("""
SELECT o_orderkey AS name FROM orders WHERE epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate) < 48 * 3600 AND o_orderkey % 4000 <= 3000 AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1""")
def picked_handoff(orders):
    """RET19: the newest handoff whose skill the task names, if it isn't too long."""
    rows = orders.select(F.col("o_orderkey").alias("name"), F.col("o_orderpriority").alias("skill"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 4000).alias("tokens"))
    return routing.pick_handoff(rows, F.array(F.lit("urgent")), "2000-01-01 00:00:00").select("name")


@query("SELECT doc_id AS qid, lang AS name, CAST(greatest(1, length(lang) * 9 // 4) AS BIGINT) AS tokens FROM documents WHERE doc_id % 3 = 0")
def named_procedures(documents):
    """RET20: the procedures that tasks' scopes name."""
    scope = F.concat(F.when(F.col("doc_id") % 3 == 0, "scope:").otherwise("other:"), F.col("lang"))
    files = documents.select(F.col("lang").alias("name"), F.repeat("lang", F.lit(9)).alias("text")).distinct()
    return injection.sops(documents.select(F.col("doc_id").alias("qid"), scope.alias("scope")), files)


@query(r"""
SELECT doc_id AS qid, (CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'und') AS INTEGER) + CAST(contains(lower(text), 'les') AS INTEGER)) >= 2 AS passed, contains(lower(text), '@mail') AS warned, len(regexp_extract_all(text, '\n<!-- ')) AS entries FROM documents""")
def scored_outputs(documents):
    """RET21: texts as outputs of cases: two of three terms, none that must not stand there."""
    rows = documents.select(F.col("doc_id").alias("qid"), "text")
    terms = lambda *xs: F.array(*[F.lit(x) for x in xs])
    cases = documents.select(F.col("doc_id").alias("qid"), terms("the", "UND", "les").alias("required"), terms("@mail").alias("anti"), F.lit(2).cast("long").alias("min_hits"))
    return evaluation.score_cases(rows, cases).select("qid", "passed", "warned", "entries")


_TERM_SQL = "list_filter(regexp_split_to_array(lower(text), '[ \t\n\f\r]+'), lambda x: length(x) >= 6)"


@query(f"""
WITH q AS (SELECT item_id AS qid, list_distinct({_TERM_SQL}) AS terms FROM benchmark), t AS (SELECT qid, unnest(terms) AS term FROM q),
h AS (SELECT qid, doc_id FROM documents, t WHERE contains(lower(text), term) GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT qid, count(*) AS n FROM h GROUP BY qid)
SELECT q.qid, coalesce(n, 0) AS n_relevant, doc_id AS relevant_id FROM q LEFT JOIN n ON n.qid = q.qid LEFT JOIN h ON h.qid = q.qid""")
def exported_set(documents, benchmark):
    """SNK12, SET3, RET8: an evaluation set: a row a question and relevant text; questions without one stay."""
    terms = F.array_distinct(F.filter(text.plain_words(F.col("text")), lambda w: F.length(w) >= 6))
    cases = benchmark.select(F.col("item_id").alias("qid"), terms.alias("terms"))
    out = evaluation.export_set(evaluation.relevant(documents.select(F.col("doc_id").alias("id"), "text"), cases), cases)
    return out.select("qid", "n_relevant", "relevant_id")


@query(f"""
SELECT doc_id AS uuid, CAST(row_number() OVER (ORDER BY doc_id % 9 <> 0, NOT (doc_id % 2 = 0 AND text <> ''), lpad(CAST(n_chars AS VARCHAR), 9, '0'), doc_id) AS BIGINT) AS place FROM documents WHERE doc_id % 4 <> 0 ORDER BY place LIMIT 50""")
def review_places(documents):
    """SRT5, PRJ14: the next fifty summaries: changes of state first, then those with signal, then by time."""
    section = F.when(F.col("doc_id") % 2 == 0, ingest.SIGNAL[0]).otherwise("other")
    rows = documents.select(F.col("doc_id").alias("uuid"), ingest.has_signal(section, F.col("text")).alias("signal"), (F.col("doc_id") % 9 == 0).alias("state_change"), F.lpad(F.col("n_chars").cast("string"), 9, "0").alias("timestamp"), (F.col("doc_id") % 4 == 0).alias("reviewed"))
    return ingest.review_order(rows).select("uuid", "place")


@query("""
WITH s AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS uuid, o_orderstatus = 'F' AS reviewed FROM orders), h AS (SELECT count(*) AS n FROM s WHERE starts_with(uuid, md5('7')[1:16]))
SELECT uuid, reviewed OR (n = 1 AND starts_with(uuid, md5('7')[1:16])) AS reviewed FROM s, h""")
def done_sessions(orders):
    """MUT15: the one staged row that a prefix means is reviewed."""
    from hashlib import md5

    staged = orders.select(F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("uuid"), (F.col("o_orderstatus") == "F").alias("reviewed"))
    return ingest.mark_reviewed(staged, md5(b"7").hexdigest()[:16].upper(), "2024-01-02").select("uuid", "reviewed")


@query(r"""
SELECT doc_id AS id, strftime(TIMESTAMP '2024-01-01 10:20:30' + INTERVAL 1 SECOND * doc_id, '%Y-%m-%dT%H-%M-%S') || '_' || CASE WHEN doc_id % 6 = 0 THEN 'nouuid' ELSE regexp_replace(source[1:8], '[^0-9A-Za-z]', '', 'g') END || '.json' AS name FROM documents""")
def staged_files(documents):
    """SNK1: file names of staged entries: safe letters only."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704104430) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    rows = documents.select(F.col("doc_id").alias("id"), stamp.alias("timestamp"), F.when(F.col("doc_id") % 6 == 0, "../").otherwise(F.col("source")).alias("uuid"), F.lit(False).alias("reviewed"), F.col("text").alias("body"))
    return ingest.staged_names(rows).select("id", "name")
