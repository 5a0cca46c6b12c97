"""Answers of services, files of folders, commits and texts of notes, all made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import bloat, curation, extraction, graph, ingest, markdown
from skein.sources import folders, remote, transcripts, writers

from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

_S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
_NOW = "2000-01-01 00:00:00"


@query("SELECT page_id AS id, ['jsonl', 'json', 'markdown', 'unknown'][1 + page_id % 4] AS kind FROM pages")
def file_formats(pages):
    """SRC10: formats by a path's ending, in any case."""
    ending = F.element_at(F.array(*[F.lit(x) for x in (".JSONL", ".json", ".Md", ".txt")]), (F.col("page_id") % 4 + 1).cast("int"))
    return pages.select(F.col("page_id").alias("id"), transcripts.detect_format(F.concat("url", ending)).alias("kind"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE md5(trim(text)) END AS question_md5 FROM conversations WHERE trim(text) <> ''")
def operator_questions(conversations):
    """SRC11: what stands in a query's tags, else the text without reminders; only a reminder is no question."""
    t = F.col("turn") % 3
    raw = F.when(t == 0, F.concat(F.lit("<info>x</info><USER_QUERY>"), "text", F.lit("</user_query> more"))).when(t == 1, F.concat(F.lit("<system-reminder>no\nno</system-reminder>"), "text")).otherwise("<system-reminder>only</system-reminder>")
    return conversations.where(F.trim("text") != "").select("conv_id", "turn", F.md5(transcripts.operator_query(raw).cast("binary")).alias("question_md5"))


@query("SELECT o_orderkey AS path FROM orders WHERE epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate) >= 4 * 3600 AND o_totalprice >= 100000")
def cold_orders(orders):
    """SRC13-15: files that are old and large enough."""
    listing = orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("timestamp").alias("file_modification_time"), F.col("o_totalprice").cast("long").alias("file_size"))
    return folders.cold_files(listing, _NOW, 4.0, 100_000).select("path")


@query("SELECT doc_id AS session, CASE WHEN contains(lower(text), 'the') THEN 'a' WHEN contains(lower(text), 'und') THEN 'b' ELSE 'general' END AS domain FROM documents WHERE doc_id % 3 <> 0")
def retired_sessions(documents):
    """SRC16: sessions that weren't processed, with their best domain."""
    events = documents.select(F.col("doc_id").alias("session"), F.col("text").alias("body"))
    return transcripts.retire(events, events.where("session % 3 = 0").select("session"), {"a": ("the",), "b": ("und",)}).select("session", "domain")


@query("""
SELECT 'f' || doc_id AS file, CAST(0 AS BIGINT) AS place, 'a.b' AS path, CAST(doc_id AS VARCHAR) AS leaf FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'f' || doc_id, 1, 'l[0]', lang FROM documents WHERE doc_id % 5 <> 0""")
def yaml_values(documents):
    """SRC18: leaves of YAML files by their paths; secrets, templates and broken files are left out."""
    good = F.concat(F.lit("a:\n  b: "), _S("doc_id"), F.lit("\n  token: z\nl: ["), "lang", F.lit(", '{{t}}']"))
    value = F.when(F.col("doc_id") % 5 == 0, "a: [").otherwise(good)
    return folders.yaml_leaves(documents.select(F.concat(F.lit("f"), _S("doc_id")).alias("file"), value.alias("value")))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang END AS name, CASE WHEN doc_id % 3 = 0 THEN source END AS other FROM documents")
def front_fields(documents):
    """SRC20-21: scalar fields of a note's front matter, null where there is none."""
    head = F.concat_ws("\n", F.lit("x: 1"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("name: '"), "lang", F.lit("' "))), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("other: "), "source")))
    return folders.front_matter(documents.select(F.col("doc_id").alias("id"), head.alias("head")), "name", "other").select("id", "name", "other")


@query("SELECT c_custkey AS id, 'a' AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, 'b' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def merged_registries(customer, orders):
    """SRC22-23, SRC28: two registries, of which the first one's rows stay."""
    return folders.merge_registries(customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("a").alias("v")), orders.select(F.col("o_custkey").alias("id"), F.lit("b").alias("v")).distinct(), key="id")


@query("""
SELECT CAST(conv_id AS VARCHAR) AS stem, turn AS line_no, md5(q) AS query_md5, md5(text) AS response_md5 FROM (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lag(text) OVER w AS q FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'""")
def recorded_pairs(conversations):
    """SRC24: lines of a terminal's dialogue; an answer right after a question."""
    said = F.when(F.col("role") == "user", "USER: ").when(F.col("role") == "assistant", "ASSISTANT: ").otherwise("SYSTEM: ")
    lines = conversations.select(_S("conv_id").alias("stem"), F.col("turn").alias("line_no"), F.concat(said, "text").alias("line"))
    out = transcripts.paired_lines(lines)
    return out.select("stem", "line_no", F.md5(F.col("query").cast("binary")).alias("query_md5"), F.md5(F.col("response").cast("binary")).alias("response_md5"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS BIGINT) AS seq, role AS subject, md5(text) AS body_md5 FROM conversations WHERE turn % 4 <> 3 AND length(text) >= 20")
def recorded_answers(conversations):
    """SRC25: answers of an endpoint as turns; failed ones give none."""
    answer = F.when(F.col("turn") % 4 == 3, F.lit('{"error": 1}')).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))))
    turns = conversations.select(_S("conv_id").alias("stem"), F.col("turn").cast("int").alias("line_no"), F.lit("2024").alias("ts"), F.col("role").alias("query"), answer.alias("answer"), F.lit(5).cast("long").alias("latency_ms"))
    return transcripts.simple_turns(remote.recorded(turns, "m", "chat")).select("session", "seq", "subject", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_orderstatus = 'F', (o_orderdate, o_orderkey)) AS success, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 2) AS cost_usd FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey""")
def fetched_outcomes(orders):
    """SRC26: outcomes in a service's answers, of each key the last; those without a key are left out."""
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lpad(_S("o_orderkey"), 12, "0"))
    one = F.struct(F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit(" "), _S("o_custkey"))).otherwise("").alias("key"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("cost_usd"), at.alias("at"))
    answers = orders.select(F.to_json(F.struct(F.array(one).alias("recent"))).alias("answer"))
    return remote.outcomes(answers).select("key", "status", "success", F.round("cost_usd", 2).alias("cost_usd"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS session, CASE WHEN o_custkey % 2 = 0 THEN 'discovery' ELSE 'decision' END AS type, o_orderpriority AS subject FROM orders WHERE o_orderstatus = 'F'""")
def fetched_flows(orders):
    """SRC27: finished flows and their logs out of answers, as lines that the flow parser reads."""
    flow = F.struct(_S("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("running").alias("status"))
    listed = orders.select(F.to_json(F.struct(F.struct(F.array(flow).alias("flows")).alias("data"))).alias("answer"))
    agent = F.array(F.struct(F.lit("1").alias("id"), F.col("o_orderpriority").alias("task"), F.lit("r").alias("result")))
    report = F.array(F.struct(F.lit("2").alias("id"), F.lit("report").alias("type"), F.lit("m").alias("message")))
    logs = F.when(F.col("o_custkey") % 2 == 0, F.to_json(F.struct(F.struct(agent.alias("agentLogs")).alias("data")))).otherwise(F.to_json(F.struct(F.struct(report.alias("messageLogs")).alias("data"))))
    lines = remote.flow_lines(remote.finished_flows(listed), orders.select(_S("o_orderkey").alias("id"), logs.alias("answer")).where("answer is not null"))
    found = transcripts.flow_logs(lines)
    priority = orders.select(_S("o_orderkey").alias("session"), "o_orderpriority")
    return found.join(priority, "session").select("session", "type", F.when(F.col("type") == "decision", F.col("o_orderpriority")).otherwise(F.col("subject")).alias("subject"))


@query("""
SELECT event_id AS ts, event_type AS event, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'Bash' END AS tool, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 's' || user_id END AS session, CASE WHEN user_id % 4 = 0 THEN 'no-git' ELSE sha256('git@' || user_id || chr(10))[1:12] END AS project FROM events""")
def observed_calls(events):
    """SRC32: tool calls as a hook sees them; what isn't told is unknown, a project is digits of its remote's hash."""
    payload = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.to_json(F.struct(F.lit("Bash").alias("tool_name"), F.concat(F.lit("s"), _S("user_id")).alias("session_id"))))
    where = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("git@"), _S("user_id")))
    return remote.observations(events.select(F.col("event_id").alias("ts"), F.col("event_type").alias("event"), payload.alias("payload"), where.alias("remote")))


@query("""
WITH c AS (SELECT o_custkey AS domain, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS body FROM orders WHERE epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate) < 40 * 86400 GROUP BY 1)
SELECT c_custkey AS domain, coalesce('c' || c.body, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey END, CASE WHEN c_custkey % 3 = 1 THEN 'f' || c_custkey END) AS body, CASE WHEN c.body IS NOT NULL THEN 'cache' WHEN c_custkey % 3 = 0 THEN 'probe' WHEN c_custkey % 3 = 1 THEN 'fallback' END AS source FROM customer LEFT JOIN c ON domain = c_custkey""")
def known_landscapes(customer, orders):
    """SRC30, STR5: of each domain a fresh cache row, else a probe's answer, else the fallback's."""
    cache = orders.select(F.col("o_custkey").alias("domain"), F.struct("o_orderdate", "o_orderkey").alias("ts"), F.col("o_orderkey").alias("body"))
    # of a domain's rows of one instant the largest
    last = cache.groupBy("domain", F.col("ts.o_orderdate").cast("timestamp").alias("at")).agg(F.max("body").alias("body")).select("domain", F.col("at").alias("ts"), F.concat(F.lit("c"), _S("body")).alias("body"))
    told = lambda rest, letter: customer.where(F.col("c_custkey") % 3 == rest).select(F.col("c_custkey").alias("domain"), F.concat(F.lit(letter), _S("c_custkey")).alias("body"))
    return remote.landscapes(customer.select(F.col("c_custkey").alias("domain")), last, told(0, "p"), told(1, "f"), F.lit(_NOW).cast("timestamp"), 40 * 86400)


@query("""
SELECT 'f' || doc_id AS domain, CAST(n - 1 AS INTEGER) AS line_no, trim(ls[n][3:]) AS fact_text FROM (SELECT doc_id, string_split('- ' || replace(text, '. ', chr(10) || '- '), chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS n) WHERE starts_with(ls[n], '- ')""")
def demo_bullets(documents):
    """SRC33: the bullets of a bundled corpus, a fact each."""
    body = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit(". "), F.lit("\n- ")))
    return folders.bullets(documents.select(F.concat(F.lit("f"), _S("doc_id")).alias("stem"), body.alias("body")))


@query("""
SELECT domain, CAST(n AS INTEGER) AS n, '- ' || id AS line FROM (SELECT o_orderpriority AS domain, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 7""")
def memory_bullets(orders):
    """SNK6: the best facts a domain as bullets of a report."""
    return writers.memory_lines(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), _S("o_orderkey").alias("text"), F.col("o_totalprice").alias("score")), 7)


@query("SELECT o_orderkey AS fact_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def staged_rest(orders, lineitem):
    """SNK10: what is still to be promoted."""
    return writers.staging_rest(orders.select(F.col("o_orderkey").alias("fact_key")), lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("fact_key")))


@query("""
WITH a AS (SELECT 'c' || p_partkey AS path, p_brand AS h FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT 'c' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS h FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'only_left' WHEN a.path IS NULL THEN 'only_right' WHEN a.h = b.h THEN 'same' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def generated_commands(part):
    """SNK13, PRJ27: generated commands against those that are there."""
    path = F.concat(F.lit("c"), _S("p_partkey"))
    left = part.where("p_partkey % 5 != 0").select(path.alias("p"), F.col("p_brand").alias("h"))
    right = part.where("p_partkey % 7 != 0").select(path.alias("p"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("h"))
    return markdown.divergence(left, right, "p", "h").select("path", "state")


@query("""
SELECT doc_id AS session, 'd' || (doc_id % 3) AS domain, '[distillation] Move ' || lang || chr(10) || 'constraints: no ' || source || '; keep' AS fact_text FROM documents WHERE doc_id % 4 <> 0""")
def distilled_intents(documents):
    """PRJ15, MUT6: clarified intents in fenced JSON as facts; one without constraints or questions is none."""
    intent = F.to_json(F.struct(F.concat(F.lit("Move "), "lang").alias("objective"), F.when(F.col("doc_id") % 4 != 0, F.array(F.concat(F.lit("no "), "source"), F.lit("keep"))).alias("constraints"), F.array(F.lit("a.md"), F.concat(F.lit("domain/d"), _S(F.col("doc_id") % 3), F.lit(".md#x"))).alias("context_refs")))
    message = F.concat(F.lit("so:\n```json\n"), intent, F.lit("\n```\ndone"))
    return ingest.promote_intents(documents.select(F.col("doc_id").alias("session"), message.alias("text"))).select("session", "domain", "fact_text")


@query("""
SELECT conv_id AS session, md5(CASE WHEN role = 'user' THEN '[decision] ' || role || ': ' || trim(text) ELSE '[tool:' || role || '] ' || trim(text[1:300]) END) AS fact_md5, CAST(CASE WHEN role = 'user' THEN 0.6 ELSE 0.4 END AS DOUBLE) AS score FROM conversations WHERE trim(text) <> ''""")
def promoted_events(conversations):
    """MUT5: facts of typed events: a decision's subject and description, or a tool's first 300 characters."""
    events = conversations.where(F.trim("text") != "").select(F.col("conv_id").alias("session"), F.when(F.col("role") == "user", "decision").otherwise("discovery").alias("type"), F.col("role").alias("subject"), F.col("text").alias("body"), F.lit(None).cast("string").alias("fact_key"))
    return ingest.promote_events(events).select("session", F.md5(F.col("fact_text").cast("binary")).alias("fact_md5"), "score")


@query("""
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'architecture' ELSE 'incident' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'storage' WHEN 1 THEN 'security' ELSE 'unknown' END AS class, CASE WHEN doc_id % 5 = 0 THEN 'storage' ELSE 'infrastructure' END AS domain, CASE WHEN doc_id % 6 = 0 THEN 'cascade' WHEN doc_id % 6 = 1 THEN 'multi-step' ELSE 'simple' END AS complexity FROM documents""")
def record_kinds(documents):
    """PRJ26: incident or architecture, class of failure, domain by tags, complexity by headings."""
    d = F.col("doc_id")
    title = F.when(d % 3 == 0, "our design and platform").otherwise("an outage")
    body = F.concat(F.when(d % 4 == 0, "the pvc on a disk\n").when(d % 4 == 1, "rbac\n").otherwise("zzz\n"), F.when(d % 6 == 0, F.repeat(F.lit("## h\n"), F.lit(8))).when(d % 6 == 1, F.repeat(F.lit("# Act 1\n"), F.lit(2))).otherwise("# h\n"))
    tags = F.when(d % 5 == 0, F.array(F.lit("Storage"))).otherwise(F.array(F.lit("none")))
    return documents.select(d.alias("id"), bloat.record_type(title, tags, body).alias("kind"), bloat.failure_class(body).alias("class"), bloat.tag_domain(tags).alias("domain"), bloat.complexity(body).alias("complexity"))


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN greatest(o_orderdate, TIMESTAMP '1990-01-01') END AS DATE) AS newest FROM orders")
def bullet_dates(orders):
    """PRJ30: the newest date that a bullet tells."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("- on "), day)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("- 1990-01-01, then "), day, F.lit(" (not 2022-13-40)"))).otherwise("- none")
    return orders.select(F.col("o_orderkey").alias("id"), text.newest_date(line, F.lit("2024-01-10").cast("date")).alias("newest"))


@query("""
WITH c AS (SELECT o_custkey AS repo, o_orderkey AS sha, o_orderdate AS t, o_orderkey % 3 AS k FROM orders),
f AS (SELECT *, last_value(CASE WHEN k = 0 THEN sha END IGNORE NULLS) OVER w AS feat, last_value(CASE WHEN k = 0 THEN t END IGNORE NULLS) OVER w AS since FROM c WINDOW w AS (PARTITION BY repo ORDER BY t, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(repo AS VARCHAR) AS repo, CAST(sha AS VARCHAR) AS fix, CAST(feat AS VARCHAR) AS feature FROM f WHERE k = 1 AND epoch(t) - epoch(since) <= 48 * 3600""")
def fixes_after_features(orders):
    """SRC31, WIN11: fixes within 48 hours of the feature before them, in histories of commits."""
    subject = F.when(F.col("o_orderkey") % 3 == 0, "feat: x").when(F.col("o_orderkey") % 3 == 1, "fix: y").otherwise("docs: z")
    rows = orders.select(_S("o_custkey").alias("repo"), F.lpad(_S("o_orderkey"), 12, "0").alias("sha"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"), subject.alias("subject"))
    found = folders.revert_pairs(rows)
    bare = lambda c: F.regexp_replace(c, "^0+(?=.)", "")
    return found.where("kind = 'fix_after_feat'").select("repo", bare("by").alias("fix"), bare("sha").alias("feature"))


@query("SELECT doc_id AS id, CAST(n AS BIGINT) AS line_no, CASE WHEN n = 5 THEN '# B' ELSE '# A' END AS heading, n IN (2, 3) AS fenced FROM documents, (SELECT unnest(range(1, 6)) AS n)")
def fenced_lines(documents):
    """WIN14-15: the heading above each line; one in a fence is none."""
    body = F.lit("# A\n```\n# no\n```\n# B")
    rows = markdown.lines(documents.select(F.col("doc_id").alias("id"), body.alias("text")), "id", "text")
    fenced = markdown.outline(rows, F.lit(None).cast("string"), F.col("line").startswith("```")).drop("heading")
    return markdown.outline(fenced, F.when(~F.col("fenced") & F.col("line").startswith("#"), F.col("line"))).select("id", F.col("line_no").cast("long").alias("line_no"), "heading", "fenced")


@query("SELECT doc_id AS id, md5(trim(text, ' ')) AS section_md5 FROM documents")
def numbered_sections(documents):
    """TXT1: the body of a numbered section, up to the next numbered capital."""
    body = F.concat(F.lit("1. One:\nx\n2. Two things\n"), "text", F.lit("\n3. Three\ny"))
    return documents.select(F.col("doc_id").alias("id"), F.md5(text.section(body, "Two").cast("binary")).alias("section_md5"))


@query("SELECT doc_id AS id, doc_id % 2 = 0 AS is_binary, CASE WHEN doc_id % 2 = 0 THEN '[binary content stripped: 1000 bytes]' ELSE lang END AS stripped FROM documents")
def stripped_values(documents):
    """TXT10-11: binary values give placeholders."""
    value = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("\x01\x02ab"), F.lit(250))).otherwise(F.col("lang"))
    return documents.select(F.col("doc_id").alias("id"), bloat.is_binary(value).alias("is_binary"), bloat.strip_value(value).alias("stripped"))


@query("SELECT doc_id AS id, 'The outage of ' || lang || ' came from one disk of the rack.' AS objective FROM documents")
def told_objectives(documents):
    """TXT15: the first sentence of the opening paragraphs, past headings, fences and short ones."""
    body = F.concat(F.lit("# T\nshort one.\n\n```\nin a fence that is long enough to be told about.\n```\n\nThe outage of "), "lang", F.lit(" came\nfrom one `disk` of the rack. More.\n\n"), "text")
    return documents.select(F.col("doc_id").alias("id"), extraction.objective(body).alias("objective"))


@query("SELECT doc_id AS id, '---' || chr(10) || 'a: 1' || chr(10) || 'z: ' || lang || chr(10) || '---' || chr(10) || 'x' AS text FROM documents")
def without_key(documents):
    """TXT27: a front matter without a key and its indented lines."""
    body = F.concat(F.lit("---\na: 1\nk:\n  - x\n\ty\nz: "), "lang", F.lit("\n---\nx"))
    return documents.select(F.col("doc_id").alias("id"), text.without_front_key(body, "k").alias("text"))


_PATHS = "SELECT doc_id AS id, lang || '/' || CASE WHEN doc_id % 3 = 0 THEN 'n' || (doc_id // 6) ELSE 'u' || doc_id END AS bare FROM documents"


@query(f"SELECT id, CASE WHEN count(*) OVER (PARTITION BY string_split(bare, '/')[2]) > 1 THEN bare ELSE string_split(bare, '/')[2] END AS target FROM ({_PATHS})")
def note_targets(documents):
    """TXT28: how notes are linked: by their bare names where only one has it."""
    d = F.col("doc_id")
    name = F.when(d % 3 == 0, F.concat(F.lit("n"), _S(F.floor(d / 6)))).otherwise(F.concat(F.lit("u"), _S(d)))
    return graph.link_targets(documents.select(d.alias("id"), F.concat("lang", F.lit("/"), name, F.lit(".md")).alias("path")))


@query(f"""
WITH r AS (SELECT doc_id AS id, doc_id % 3 AS k, '{graph.FOOTER_BEGIN}' || chr(10) || '**Related:** [[t' || (doc_id + 1) || ']]' || chr(10) || '{graph.FOOTER_END}' || chr(10) AS foot FROM documents)
SELECT id, CASE k WHEN 0 THEN 'note' || chr(10) || chr(10) || foot WHEN 1 THEN 'note' || chr(10) || chr(10) ELSE 'note' END AS text, k <> 2 AS changed FROM r""")
def note_footers(documents):
    """SNK8: footers of related notes are set, removed, or left alone."""
    d = F.col("doc_id")
    old = F.concat(F.lit(f"note\n\n{graph.FOOTER_BEGIN}\n**Related:** [[old]]\n{graph.FOOTER_END}\n"))
    notes = documents.select(d.alias("id"), F.when(d % 3 == 1, old).otherwise("note").alias("text"))
    ranked = documents.where("doc_id % 3 = 0").select(d.alias("source"), (d + 1).alias("target"), F.lit(1).cast("long").alias("rank"))
    targets = documents.select((d + 1).alias("id"), F.concat(F.lit("t"), _S(d + 1)).alias("target"))
    return graph.footers(notes, ranked, targets)


@query("""
SELECT doc_id AS id, 'web-api' AS subject, 'runs_on' AS predicate, 'k8s-n' || (doc_id % 5) AS object FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'db' || lang, 'uses_storage', 'block-fast' FROM documents WHERE doc_id % 2 = 1""")
def told_relations(documents):
    """KG3: relations by their verbs; what runs on something else than a node isn't told."""
    d = F.col("doc_id")
    told = F.when(d % 2 == 0, F.concat(F.lit("the Web-API runs on K8S-n"), _S(d % 5), F.lit("; the mail-api runs on node-1"))).otherwise(F.concat(F.lit("db"), "lang", F.lit(" uses block-fast")))
    return graph.relations(documents.select(d.alias("id"), told.alias("text")), "id", "text")


_EDGES = "SELECT 'svc' || (o_custkey % 40) AS subject, 'runs_on' AS predicate, 'node' || (o_orderkey % 30) AS object, o_orderdate AS valid_from, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 60 DAY END AS valid_to FROM orders"


@query(f"""
WITH t AS ({_EDGES}), n AS (SELECT 'node' || n AS entity FROM (SELECT unnest(range(0, 30)) AS n) WHERE contains('node' || n, 'ode1'))
SELECT entity, 'in' AS dir, subject AS other, valid_from FROM n JOIN t ON object = entity WHERE valid_from <= TIMESTAMP '1999-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1999-06-01')""")
def found_entities(orders):
    """KG10, KG15: entities by a part of their names, with the edges that held at an instant."""
    subject, obj = F.concat(F.lit("svc"), _S(F.col("o_custkey") % 40)), F.concat(F.lit("node"), _S(F.col("o_orderkey") % 30))
    at = F.col("o_orderdate").cast("timestamp")
    triples = orders.select(subject.alias("subject"), F.lit("runs_on").alias("predicate"), obj.alias("object"), at.alias("valid_from"), F.when(F.col("o_orderstatus") == "F", at + F.expr("interval 60 days")).alias("valid_to"))
    names = orders.sparkSession.range(30).select(F.concat(F.lit("node"), _S("id")).alias("entity_id"), F.concat(F.lit("Node"), _S("id")).alias("name"))
    return graph.find(names, triples, "ODE1", "1999-06-01 00:00:00").select("entity", "dir", "other", "valid_from")


@query("""
WITH m AS (SELECT doc_id AS id, regexp_extract_all(text, '[A-Z][a-z]{9,}') AS a, regexp_extract_all(text, '[0-9]{3,}') AS b FROM documents WHERE doc_id % 4 <> 0)
SELECT DISTINCT id, 'agent:' || lower(unnest(a)) AS entity_id FROM m UNION SELECT DISTINCT id, 'number:' || unnest(b) FROM m""")
def newly_indexed(documents):
    """KG12, STR2: the entities of texts that weren't indexed before."""
    links, _, _ = graph.index_new(documents, documents.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "text", {"agent": "[A-Z][a-z]{9,}", "number": "[0-9]{3,}"})
    return links.select("id", "entity_id")


@query("""
WITH s AS (SELECT o_orderpriority AS domain, o_orderkey AS id, round(o_totalprice / 600000, 6) AS s, o_orderkey % 7 AS c FROM orders), f AS (SELECT *, round(s * (1 + 0.1 * c), 6) AS worth FROM s WHERE s > 0.15 ORDER BY worth DESC, id LIMIT 30), p AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY worth DESC, id) AS place FROM f)
SELECT id, domain FROM p WHERE place <= 3""")
def highlighted_facts(orders):
    """SRT4, SNK6: the best facts of each domain by score and confirmations."""
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), F.round(F.col("o_totalprice") / 600000, 6).alias("score"), (F.col("o_orderkey") % 7).alias("confirmations"))
    return curation.highlights(rows, 3).select("id", "domain")
