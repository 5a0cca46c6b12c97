"""Line operators over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import markdown

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

_LINES = "l AS (SELECT doc_id AS id, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


@query(f"""
WITH {_LINES}, h AS (SELECT *, last_value(CASE WHEN length(line) <= 60 AND ends_with(line, '.') THEN line END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM l)
SELECT id, md5(heading) AS heading_md5, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM h GROUP BY id, heading""")
def section_outline(documents):
    """WIN14, LNT10: short lines as headings."""
    rows = markdown.lines(documents, "doc_id", "text")
    out = markdown.outline(rows, F.when((F.length("line") <= 60) & F.col("line").endswith("."), F.col("line")))
    return out.groupBy("id", "heading").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")).select("id", F.md5(F.col("heading").cast("binary")).alias("heading_md5"), "lines", "chars")


@query(rf"""
WITH {_LINES}, s AS (SELECT id, line_no, CAST(length(regexp_replace(line, '\[[^\]]*\]\([^)]*\)', '', 'g')) AS BIGINT) AS size FROM l)
SELECT id, line_no, size, CASE WHEN size > 600 THEN 'RED' ELSE 'YELLOW' END AS status FROM s WHERE size > 350""")
def line_lints(documents):
    """LNT1-2, PRJ23."""
    return markdown.long_lines(markdown.lines(documents, "doc_id", "text"), 350, 600).select("id", "line_no", "size", "status")


_OPENING = "array_to_string(list_slice(list_filter(regexp_split_to_array(lower(line), '[ \\t\\r\\f]+'), lambda x: x <> ''), 1, 6), ' ')"


@query(f"""
WITH {_LINES}, o AS (SELECT id, line_no, {_OPENING} AS opening FROM l WHERE len(list_filter(regexp_split_to_array(lower(line), '[ \\t\\r\\f]+'), lambda x: x <> '')) >= 6),
f AS (SELECT *, min(line_no) OVER (PARTITION BY id, opening) AS first_line FROM o) SELECT id, line_no, first_line, md5(opening) AS opening_md5 FROM f WHERE line_no > first_line""")
def prune_duplicates(documents):
    """WIN16, LNT11."""
    out = markdown.repeated_openings(markdown.lines(documents, "doc_id", "text"))
    return out.select("id", "line_no", "first_line", F.md5(F.col("opening").cast("binary")).alias("opening_md5"))


_IDS = r"SELECT DISTINCT doc_id AS bullet, token, strong FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS token, true AS strong FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}{14,}')), false FROM documents)"


@query(f"""
WITH t AS ({_IDS}), r AS (SELECT token FROM t GROUP BY token HAVING count(*) BETWEEN 2 AND 3), o AS (SELECT * FROM t WHERE token IN (SELECT token FROM r)),
p AS (SELECT a.bullet AS a, b.bullet AS b, count(*) FILTER (a.strong) AS strong, count(*) FILTER (NOT a.strong) AS weak FROM o a JOIN o b ON a.token = b.token AND a.bullet < b.bullet GROUP BY ALL)
SELECT * FROM (SELECT *, CASE WHEN strong >= 2 THEN 'same-ids' WHEN strong >= 1 AND weak >= 2 THEN 'same-id+symbols' WHEN weak >= 4 THEN 'same-symbols' END AS kind FROM p) WHERE kind IS NOT NULL""")
def dup_bullets(documents):
    """LNT3, JN12, TXT21: documents as bullets; numbers are strong identifiers, long words weak ones."""
    strong = documents.select(F.col("doc_id").alias("bullet"), F.explode(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), 0)).alias("token"), F.lit(True).alias("strong"))
    weak = documents.select(F.col("doc_id").alias("bullet"), F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{14,}"), 0)).alias("token"), F.lit(False).alias("strong"))
    return markdown.duplicate_pairs(strong.unionByName(weak))


@query(f"WITH {_LINES} SELECT id, line_no, CAST(length(line) AS BIGINT) AS size FROM l ORDER BY length(line) DESC, id, line_no LIMIT 25")
def heaviest_lines(documents):
    """SRT7."""
    return markdown.lines(documents, "doc_id", "text").select("id", "line_no", F.length("line").cast("long").alias("size")).orderBy(F.desc("size"), "id", "line_no").limit(25)


@query("SELECT lang AS listed, CASE WHEN s IS NULL THEN 'missing' ELSE 'listed' END AS state FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN (SELECT DISTINCT lang AS s FROM documents WHERE source = 'src0') ON lang = s")
def index_completeness(documents):
    """SET6, LNT7: what an index (here: one source) leaves out."""
    active = documents.select("lang").distinct()
    index = documents.where("source = 'src0'").select("lang").distinct()
    missing = active.join(index, "lang", "left_anti").select(F.col("lang").alias("listed"), F.lit("missing").alias("state"))
    return active.join(index, "lang", "left_semi").select(F.col("lang").alias("listed"), F.lit("listed").alias("state")).unionByName(missing)
