"""Text scalars, classifiers and hashing over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import text

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

#: Keywords that occur in the driver's invented texts; the shipped vocabulary hardly does.
PROBE = {"alpha": ("the", "tion", "hea"), "beta": ("que", "les", "eaux"), "gamma": ("und", "keit", "sch"), "delta": ("ción", "los", "ado"), "epsilon": ("mail", "token", "example.com")}


def _hits(col: str, keys) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{k}') AS INTEGER)" for k in keys) + ")"


_HITS_SQL = ", ".join(f"{_hits('low', ks)} AS h_{d}" for d, ks in PROBE.items())


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def doc_tokens_est(documents):
    """TXT5."""
    return documents.select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS parts FROM documents),
c AS (SELECT doc_id, unnest(range(0, greatest(1, CAST(ceil(len(parts) / 170.0) AS BIGINT)))) AS chunk_no, text, parts FROM w)
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no,
  md5(CASE WHEN len(parts) <= 170 THEN text ELSE array_to_string(list_slice(parts, chunk_no * 170 + 1, chunk_no * 170 + 170), ' ') END) AS chunk_md5 FROM c""")
def doc_chunks(documents):
    """TXT6, RET7: windows of 170 words."""
    return documents.select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_no", "chunk")).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha256(source || ':' || substr(text, 1, 200)), 1, 16) AS mined_key, substr(sha256(lower(text)), 1, 32) AS text_key FROM documents")
def fact_keys(documents):
    """HSH1-2."""
    t = F.col("text")
    return documents.select("doc_id", F.sha2(t.cast("binary"), 256).alias("content_hash"), text.fact_key(F.concat("source", F.lit(":"), F.substring(t, 1, 200))).alias("mined_key"), text.fact_key(t, lower=True, size=32).alias("text_key"))


@query("SELECT doc_id, CAST(list_reduce([0] || list_transform(string_split(md5(text), ''), lambda d: instr('0123456789abcdef', d) - 1), lambda a, d: (a * 16 + d) % 100) AS BIGINT) AS bucket FROM documents")
def sample_md5(documents):
    """PRJ6: the bucket that a sampling rate is compared with."""
    return documents.select("doc_id", text.md5_mod(F.col("text")).cast("long").alias("bucket"))


@query(r"""
SELECT page_id, length(html) >= 500 AND (starts_with(head, '<!doctype html') OR starts_with(head, '<html') OR (contains(head, '<head') AND contains(head, '<body'))) AS is_html,
  md5(bare) AS text_md5, CAST(length(bare) AS BIGINT) AS text_chars
FROM (SELECT page_id, html, lower(substr(ltrim(html), 1, 2000)) AS head,
  trim(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \t\n\f\r]+', ' ', 'g')) AS bare FROM pages)""")
def html_strip(pages):
    """TXT9, and markup taken off."""
    bare = text.strip_html(F.col("html"))
    return pages.select("page_id", text.is_html(F.col("html")).alias("is_html"), F.md5(bare.cast("binary")).alias("text_md5"), F.length(bare).cast("long").alias("text_chars"))


def _redact_sql(col: str) -> str:
    """The masks in order. RE2 has no lookahead: a value that is masked already is taken out of the way for the assignments."""
    for p in vocab.SECRET_PATTERNS:
        col = f"regexp_replace({col}, '{p}', '[REDACTED]', 'g')"
    col = f"regexp_replace({col}, '([:=]\\s*[''\"]?)\\[REDACTED\\]', '\\1;REDACTED;', 'g')"
    assignment = vocab.SECRET_ASSIGNMENT.replace(r"(?!\[REDACTED\])", "").replace("'", "''")
    return "replace(regexp_replace(" + col + ", '" + assignment + r"', '\1=[REDACTED]', 'g'), ';REDACTED;', '[REDACTED]')"


@query(f"""
SELECT doc_id, text <> masked AS changed, md5(CASE WHEN length(masked) > 600 THEN substr(masked, 1, 600) || '…[+' || (length(masked) - 600) || ' chars]' ELSE masked END) AS redacted_md5
FROM (SELECT doc_id, text, {_redact_sql("text")} AS masked FROM documents)""")
def secret_scan(documents):
    """TXT18: the whole text is masked, then cut; each text is masked once."""
    masked = documents.select("doc_id", "text", text.redact(F.col("text"), most=1 << 30).alias("masked"))
    return masked.select("doc_id", (F.col("text") != F.col("masked")).alias("changed"), F.md5(text.shorten(F.col("masked"), vocab.REDACT_MOST).cast("binary")).alias("redacted_md5"))


@query(r"""
SELECT page_id, CAST(len(q) AS BIGINT) AS phrases, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_filter(q, lambda p: contains(lower(url), lower(p)))) / len(q), 6) END AS share
FROM (SELECT page_id, url, regexp_extract_all(html, '"([^"]{3,60})"', 1) AS q FROM pages)""")
def quoted_phrases(pages):
    """TXT2-3."""
    q = text.quoted(F.col("html"))
    return pages.select("page_id", F.size(q).cast("long").alias("phrases"), F.round(text.phrase_share(q, F.col("url")), 6).alias("share"))


_DECISION = " OR ".join(f"contains(lower(text), '{w}')" for w in vocab.DECISION_WORDS)
_FINDING = "(?i)(" + "|".join(vocab.FINDING_PATTERNS) + ")"


@query(f"""
SELECT conv_id, turn, kind, round(CASE WHEN finding THEN greatest(s, 0.85) ELSE s END, 4) AS score, finding FROM (
  SELECT conv_id, turn, kind, CASE WHEN {_DECISION} THEN least(1.0, base + 0.15) ELSE base END AS s, regexp_matches(text, '{_FINDING}') AS finding FROM (
    SELECT *, CASE WHEN role = 'system' THEN 'summary' WHEN role = 'assistant' AND length(text) > 100 THEN 'reasoning' WHEN role = 'assistant' THEN 'other' ELSE 'user' END AS kind,
      CASE WHEN role = 'system' THEN 1.0 WHEN role = 'assistant' AND length(text) > 100 THEN 0.65 WHEN role = 'assistant' THEN 0.0 ELSE 0.55 END AS base FROM conversations))""")
def classify_turns(conversations):
    """PRJ1-3: kind and base score by role, boosted by decision words, raised by findings."""
    t, role = F.col("text"), F.col("role")
    kind = F.when(role == "system", "summary").when((role == "assistant") & (F.length(t) > 100), "reasoning").when(role == "assistant", "other").otherwise("user")
    base = F.when(kind == "summary", 1.0).when(kind == "reasoning", 0.65).when(kind == "other", 0.0).otherwise(0.55)
    boosted, finding = text.boost(t, base), text.is_finding(t)
    return conversations.select("conv_id", "turn", kind.alias("kind"), F.round(F.when(finding, F.greatest(boosted, F.lit(vocab.FINDING_SCORE))).otherwise(boosted), 4).alias("score"), finding.alias("finding"))


_FAILED = " OR ".join("contains(lower(text), '" + w.replace("'", "''") + "')" for w in vocab.FAILURE_WORDS)


_TRIGGERS = [f"WHEN regexp_matches(head, '{p}') THEN CASE WHEN trim(regexp_extract(head, '{p}', 1)) <> '' THEN trim(regexp_extract(head, '{p}', 1)) ELSE 'Unknown trigger' END" for p in vocab.TRIGGERS]


@query(rf"""
SELECT conv_id, turn, CAST(len(s) AS BIGINT) AS steps, ok AS is_procedure, CASE WHEN ok THEN md5(s[len(s)]) END AS resolution_md5, CASE WHEN ok THEN done END AS complete,
  CASE WHEN ok THEN CASE {" ".join(_TRIGGERS)} ELSE 'Unknown trigger' END END AS trigger, CASE WHEN ok AND done THEN greatest(0.55, 0.70) WHEN ok THEN greatest(0.55, 0.50) ELSE 0.55 END AS score
FROM (SELECT *, substr(text, 1, 500) AS head, len(s) >= 3 AND ({_FAILED}) AS ok, regexp_matches(text, '(?i)(?:{"|".join(vocab.RESOLUTIONS)})') AS done
  FROM (SELECT conv_id, turn, text, regexp_extract_all(text, '(?m){vocab.STEP}', 1) AS s FROM conversations))""")
def procedures(conversations):
    """PRJ4-5: steps, trigger, resolution and whether it came to an end; the score that an instruction (0.55) gets by it."""
    rows = conversations.select("conv_id", "turn", text.steps(F.col("text")).alias("s"), text.procedure(F.col("text")).alias("p"))
    return rows.select("conv_id", "turn", F.size("s").cast("long").alias("steps"), F.col("p").isNotNull().alias("is_procedure"), F.md5(F.col("p.resolution").cast("binary")).alias("resolution_md5"), F.col("p.complete").alias("complete"), F.col("p.trigger").alias("trigger"), text.procedure_score(F.col("p"), F.lit(0.55)).alias("score"))


_HEDGES = " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INTEGER)" for p in vocab.HEDGES)


@query(rf"""
SELECT doc_id, CASE WHEN regexp_matches(text, '({"|".join(vocab.OBSERVED)})') THEN 0.85 WHEN ({_HEDGES}) >= 2 THEN 0.25 WHEN ({_HEDGES}) = 1 THEN 0.40 WHEN lang IN ('nodes', 'storage', 'networking') THEN 0.45 ELSE 0.50 END AS confidence FROM documents""")
def confidence_scores(documents):
    """PRJ12 (DEF6 fixed)."""
    return documents.select("doc_id", text.confidence(F.col("text"), F.col("lang")).alias("confidence"))


_SEEDS = ", ".join(f"CASE WHEN regexp_matches(head, '{p}') THEN {s} ELSE 0.0 END" for p, s in vocab.SEED_PATTERNS)
_NOISE = "(?i)(" + "|".join(vocab.NOISE_HEADS).replace("'", "''") + ")"
_NO_ISSUER = vocab.NARRATION.replace(r"(?!\s+encrypt\b)", "").replace("'", "''")
_TERMS = "|".join(vocab.VERDICT_TERMS)


def noise_sql(col: str) -> str:
    """PRJ10 in DuckDB. RE2 has no lookahead: the certificate issuer's name is changed first, letter for letter."""
    issuer = rf"regexp_replace(substr({col}, 1, 80), '(?i)\blet([''’]s\s+encrypt\b)', 'lxt\1', 'g')"
    early = rf"regexp_matches(substr({issuer}, 1, 60), '(?is)^.{{0,39}}{_NO_ISSUER}')"
    verdict = rf"regexp_matches(substr({col}, 1, 200), '(?is){vocab.VERDICT_QUOTED}') OR (regexp_matches({col}, '(?i){vocab.VERDICT_OPENER}') AND regexp_matches({col}, '(?i)(?:{_TERMS})'))"
    return f"(regexp_matches(substr({col}, 1, 200), '{_NOISE}') OR {early} OR {verdict})"


@query(rf"""
SELECT doc_id, {noise_sql("text")} AS noise, CAST(greatest(0.4, {_SEEDS}) AS DOUBLE) AS seed
FROM (SELECT doc_id, text, lower(substr(text, 1, 500)) AS head FROM documents)""")
def noise_and_seeds(documents):
    """PRJ10-11."""
    return documents.select("doc_id", text.is_noise(F.col("text")).alias("noise"), text.seeded_score(F.col("text")).alias("seed"))


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN h_{d} > 0 THEN '{d}' END" for d in PROBE) + "], lambda x: x IS NOT NULL)"
_TOP = f"greatest({', '.join(f'h_{d}' for d in PROBE)})"
_BEST = "CASE WHEN " + _TOP + " = 0 THEN 'general' " + " ".join(f"WHEN h_{d} = {_TOP} THEN '{d}'" for d in PROBE) + " END"


@query(f"SELECT doc_id, array_to_string({_TAGS}, ',') AS tags, {_BEST} AS best FROM (SELECT doc_id, {_HITS_SQL} FROM (SELECT doc_id, lower(text) AS low FROM documents))")
def domain_tags(documents):
    """PRJ7-8: all domains with a keyword, and the best one; a text's hits are counted once."""
    hits = documents.select("doc_id", text.domain_hits(F.col("text"), PROBE).alias("h"))
    return hits.select("doc_id", F.array_join(text.found_domains(F.col("h")), ",").alias("tags"), text.top_domain(F.col("h")).alias("best"))


@query(f"""
WITH h AS (SELECT item_id, {_HITS_SQL} FROM (SELECT item_id, lower(text) AS low FROM benchmark)),
s AS (SELECT item_id, unnest([{", ".join(f"struct_pack(pos := {k}, domain := '{d}', hits := h_{d}, n := {len(ks)})" for k, (d, ks) in enumerate(PROBE.items()))}]) AS x FROM h),
r AS (SELECT item_id, x.domain AS domain, x.hits / x.n AS score, row_number() OVER (PARTITION BY item_id ORDER BY x.hits / x.n DESC, x.pos) AS rank FROM s WHERE x.hits > 0),
k AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM r WHERE rank <= 3)
SELECT item_id, domain, CAST(rank AS BIGINT) AS rank, round(score, 3) AS score,
  CAST(CASE WHEN rank = 1 THEN 4000 WHEN rank = n THEN least(4000, CASE WHEN n = 2 THEN 6000 ELSE 3000 END) ELSE least(4000, 6000 // (n - 1)) END AS BIGINT) AS budget FROM k""")
def route_domains(benchmark):
    """RET15: the three best domains of a question and their character budgets (10 000 in all, 4 000 at most each)."""
    total, most, files = 10_000, 4_000, 3
    each = benchmark.select("item_id", F.posexplode(text.domain_hits(F.col("text"), PROBE, whole_short=False)).alias("pos", "d")).where("d.hits > 0").select("item_id", "pos", "d.domain", (F.col("d.hits") / F.col("d.keywords")).alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "pos")).cast("long")).where(F.col("rank") <= files)
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    second = F.least(F.lit(most), F.floor(F.lit(total - most) / F.greatest(F.lit(1), F.col("n") - 1)))
    third = F.least(F.lit(most), F.lit(total - most) - second)
    budget = F.when(F.col("rank") == 1, most).when(F.col("rank") == 2, second).otherwise(third)
    return ranked.select("item_id", "domain", "rank", F.round("score", 3).alias("score"), budget.cast("long").alias("budget"))


@query("""
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, md5(line) AS line_md5 FROM (
  SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(lower(line), 'example.com') OR contains(lower(line), 'token')""")
def delta_lines(documents):
    """PRJ9: the lines with a keyword."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where(text.any_of(F.lower("line"), ("example.com", "token"))).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256(props) AS args_sha256 FROM events")
def json_props(events):
    """HSH3-5: a value out of JSON text, and its hash."""
    return events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"), F.sha2(F.col("props").cast("binary"), 256).alias("args_sha256"))


_GLOBS = ("**/en/*", "**/*.html", "*/*/de/**", "http*/**", "**/fr/1*")


@query(rf"""
SELECT page_id, CAST(round(greatest({", ".join(f"CASE WHEN regexp_matches(path, '{text.glob_pattern(g)}') THEN {text.glob_specificity(g)} ELSE 0.0 END" for g in _GLOBS)}) * 10, 4) AS DOUBLE) AS score
FROM (SELECT page_id, replace(url, '://', '/') AS path FROM pages)""")
def glob_scores(pages):
    """TXT19-20, RET13: the most specific glob that fits a path, ten points a segment."""
    path = F.replace(F.col("url"), F.lit("://"), F.lit("/"))
    best = F.greatest(*[F.when(path.rlike(text.glob_pattern(g)), F.lit(text.glob_specificity(g))).otherwise(F.lit(0.0)) for g in _GLOBS])
    return pages.select("page_id", F.round(best * 10, 4).alias("score"))
