"""DuckDB SQL for the operators that it can express: the joins by brute force, archives and url rules by their laws."""

from __future__ import annotations

import string

from . import url_filter

_LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

#: Every text's distinct five-word shingles, all pairs with a shingle in common, links by exact counts, all that is reachable.
NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id"""

#: All pairs of vectors.
NEAR_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT id, id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT c.id AS vec_id, count(e.b) AS n_links, any_value(root) AS component_id, c.id = any_value(root) AS kept FROM c LEFT JOIN e ON e.a = c.id GROUP BY c.id"""

# five bits of the 160 at a time, out of hex digits
_BITS = "(instr('0123456789abcdef', substr(h, 5 * k // 4 + 1, 1)) - 1) * 16 + CASE WHEN 5 * k // 4 + 2 <= 40 THEN instr('0123456789abcdef', substr(h, 5 * k // 4 + 2, 1)) - 1 ELSE 0 END"
_BASE32 = f"array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_BITS}) >> (3 - (5 * k) % 4)) % 32 + 1, 1)), '')"

#: Digests in base32; of equal payloads the largest id is the response.
WARC = f"""
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS last FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))"""

_RULES = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in _RULES]
_RULE = "CASE " + " ".join(f"{f} '{h + p}'" for f, (_, h, p) in zip(_FITS, _RULES, strict=True)) + " END"
_RULED = "CASE " + " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(_FITS, _RULES, strict=True)) + " END"

#: Where pages have no links between hosts (so the driver's), a host's rank is its seed's: most of its pages are blocked, or not.
URL_FILTERS = f"""
WITH u AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {_RULE} AS rule, {_RULED} AS ruled FROM u),
h AS (SELECT host, 2 * count(*) FILTER (ruled = 'block') > count(*) AS bad FROM r WHERE host <> '' GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN h ON h.host = r.host"""

#: SQL can't express the others: tokenizers, trained models, images, bin packing, a search for a capacity. Tests hold those against brute force.
ORACLE_SQL: dict[str, str] = {"op4_ngram_jaccard_join": NGRAM_JOIN, "op5_embedding_near_dedup": NEAR_DEDUP, "op8_warc": WARC, "op9_url_filters": URL_FILTERS}
