"""Operators on literal rows, with the rows that they have to give, written out by hand."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import scoring, text
from skein.operators import bloat, curation, degradation, evaluation, facts, graph, health, ingest, injection, markdown, pointers, pool, routing
from skein.sources import folders, remote, transcripts, writers

QUERIES: dict = {}
NOW = dt.datetime(2024, 1, 2)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (dt.date, dt.datetime)):
        return f"{'TIMESTAMP' if isinstance(x, dt.datetime) else 'DATE'} '{x}'"
    return "'" + str(x).replace("'", "''") + "'"


def case(columns: str, *expected: tuple) -> Callable:
    """Registers a function of a session; its rows must be the expected ones. Columns: names by spaces."""
    names = columns.split()
    values = ", ".join("(" + ", ".join(_literal(x) for x in row) + ")" for row in expected)
    sql = f"SELECT * FROM (VALUES {values}) t({', '.join(f'"{n}"' for n in names)})"

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark).select(*names)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = (run, sql)
        return f

    return put


def _lines(spark: SparkSession, **files) -> DataFrame:
    """stem, line_no, line of transcripts given as lists of texts or objects."""
    rows = [(stem, f"/{stem}.jsonl", n, x if isinstance(x, str) else json.dumps(x)) for stem, xs in files.items() for n, x in enumerate(xs)]
    return spark.createDataFrame(rows, "stem string, file string, line_no int, line string")


# -- transcripts --------------------------------------------------------------------------


@case("session seq type subject size", ("s1", 0, "decision", "1. First", 129), ("s1", 1, "decision", "2. Second", 130))
def case_summaries(spark):
    """SRC1, SRC2, SRC12: summaries cut at numbered headings; short parts and broken lines drop out."""
    lines = _lines(spark, s1=[{"isCompactSummary": True, "message": {"content": [{"type": "text", "text": "1. First\n" + "a" * 120 + "\n2. Second\n" + "b" * 120 + "\n3. No"}]}}, {"isCompactSummary": False, "message": {"content": "c" * 300}}, "{isCompactSummary"])
    return transcripts.compact_summaries(lines).withColumn("size", F.length("body").cast("long"))


@case("session seq subject size", ("s", 0, "a", 600), ("s", 2000, "d", 700))
def case_results(spark):
    """SRC2: results without an error and of a useful length, each content once."""
    block = lambda i, n, error=False: {"type": "tool_result", "tool_use_id": i, "is_error": error, "content": "r" * n}
    lines = _lines(spark, s=[{"message": {"content": [block("a", 600), block("b", 600, True), block("c", 400)]}}, {"message": {"content": [block("e", 6000)]}}, {"message": {"content": [block("d", 700)]}}])
    return transcripts.tool_results(lines).withColumn("size", F.length("body").cast("long"))


@case("type subject body", ("decision", "Plan", "d"), ("discovery", "ls", "out"))
def case_thoughts(spark):
    """SRC3: thoughts are decisions, calls without a secret discoveries."""
    call = lambda name, out: {"name": name, "args": {"b": "1"}, "result": [{"functionResponse": {"response": {"output": out}}}]}
    doc = {"sessionId": "s", "messages": [{"thoughts": [{"subject": "Plan", "description": "d"}, {"subject": "Prioritizing File Exploration", "description": "x"}], "toolCalls": [call("ls", "out"), call("env", "MY_TOKEN=1")]}]}
    return transcripts.thought_documents(spark.createDataFrame([("f", json.dumps(doc))], "file string, value string"))


@case("session seq type subject", ("7", 1, "discovery", "task"), ("7", 2, "discovery", "stdout"), ("7", 4, "discovery", "q"), ("7", 5, "decision", "report"))
def case_flows(spark):
    """SRC4-5: logs of a flow by kind; input and short output say nothing."""
    lines = _lines(spark, f=[{"_meta": {"id": "7"}}, {"_log_type": "agentLogs", "task": "task", "result": "r"}, {"_log_type": "terminalLogs", "type": "stdout", "text": "x" * 60}, {"_log_type": "terminalLogs", "type": "stdin", "text": "y" * 60}, {"_log_type": "searchLogs", "query": "q", "result": "r"}, {"_log_type": "messageLogs", "type": "report", "message": "m"}, {"_log_type": "messageLogs", "type": "ask", "message": "m"}])
    return transcripts.flow_logs(lines)


@case("session seq subject body", ("t", 0, "q", "long enough an answer"))
def case_simple_turns(spark):
    """SRC6."""
    return transcripts.simple_turns(_lines(spark, t=[{"query": "q", "response": "long enough an answer"}, {"query": "q", "response": "short"}, "{"]))


@case("session seq subject body", ("c", 2, "why?", "because"), ("c", 4, "why?", "still"))
def case_answers(spark):
    """SRC7, SRC11, JN21: final answers with the question before them; reminders are no question."""
    return transcripts.answered_turns(_lines(spark, c=[{"type": "user", "content": "<user_query>why?</user_query>"}, {"type": "assistant", "content": "thinking", "tool_calls": [1]}, {"type": "assistant", "content": "because"}, {"type": "user", "content": "<system-reminder>x</system-reminder>"}, {"type": "assistant", "content": "still"}]))


@case("session seq subject body", ("r", 1, "ask", "tell"))
def case_rollouts(spark):
    """SRC8: dated rollouts, with typed blocks."""
    say = lambda role, t: {"payload": {"role": role, "content": [{"type": "text", "text": t}]}}
    return transcripts.answered_turns(_lines(spark, r=[say("user", "ask"), say("assistant", "tell")]), "$.payload.role", "$.payload.content", tools=None)


@case("path kind", ("a.JSONL", "jsonl"), ("b.json", "json"), ("c.md", "markdown"), ("d", "unknown"))
def case_formats(spark):
    """SRC10."""
    return spark.createDataFrame([("a.JSONL",), ("b.json",), ("c.md",), ("d",)], "path string").withColumn("kind", transcripts.detect_format(F.col("path")))


@case("stem line_no query response", ("p", 1, "a", "b"))
def case_pairs(spark):
    """SRC24: an answer right after a question."""
    return transcripts.paired_lines(_lines(spark, p=["USER: a", "ASSISTANT: b", "ASSISTANT: c", "USER: d"]))


@case("session domain", ("new", "security"), ("new2", "general"))
def case_retire(spark):
    """SRC16: sessions that weren't processed, by domain."""
    events = spark.createDataFrame([("new", "vault tls and dns"), ("old", "vault"), ("new2", "nothing")], "session string, body string")
    return transcripts.retire(events, spark.createDataFrame([("old",)], "session string"), vocab.DOMAIN_KEYWORDS)


def _blocks(spark):
    long = "The scheduler keeps its state in a ring of shards and moves them when a member leaves, which takes a while on a busy day. " * 2
    intent = '```json\n[{"objective": "Move the cache", "constraints": ["no downtime", "keep keys"], "context_refs": ["notes.md", "domain/storage.md#x"]}, {"objective": "no more"}]\n```'
    rows = [("a", 0, "assistant", intent), ("b", 0, "assistant", long), ("b", 1, "user", "please look at how the scheduler moves its shards"), ("c", 0, "assistant", long), ("d", 0, "assistant", long), ("e", 0, "user", "a message that is long enough to be kept")]
    blocks = spark.createDataFrame(rows, "session string, seq long, kind string, text string")
    return blocks, spark.createDataFrame([("c",)], "session string"), spark.createDataFrame([("d",)], "session string"), F.when(F.col("kind") == "assistant", 0.65).otherwise(0.55)


@case("session domain fact_text score provenance", ("a", "storage", "[distillation] Move the cache\nconstraints: no downtime; keep keys", 0.75, "distillation"))
def case_extra_intents(spark):
    """SRC17, PRJ15, MUT6: intents in fenced lists; one without constraints or questions is none."""
    blocks, summaries, known, base = _blocks(spark)
    return ingest.scan_extra(blocks, summaries, known, base)[0]


@case("session section place", ("b", "key_concepts", 1), ("b", "primary_request", 1))
def case_extra_mined(spark):
    """SRC17, MUT18: sessions that are known, compacted or gave intents aren't mined; without a concept nothing is staged."""
    blocks, summaries, known, base = _blocks(spark)
    return ingest.scan_extra(blocks, summaries, known, base)[1]


@case("id intents", (1, 0), (2, 1), (3, 1), (4, 0), (5, 2))
def case_intents(spark):
    """PRJ15: bare objects count only where no fence has one; an objective alone is none."""
    rows = [(1, '{"objective": "x"}'), (2, 'see {"objective": "x", "open_questions": []} there'), (3, '```\n{"objective": "a", "escalate_if": ["b"]}\n``` and {"objective": "c", "constraints": []}'), (4, "```json\n{broken\n```"), (5, '```json\n[{"objective": "a", "constraints": []}, {"objective": "b", "constraints": []}]\n```')]
    return spark.createDataFrame(rows, "id long, t string").select("id", F.size(text.clarified_intents(F.col("t"))).cast("long").alias("intents"))


@case("fact_text score outcome", ("[decision] Use raft: it is simple", 0.6, "confirmed"), ("[decision] Stop", 0.6, "confirmed"), ("[tool:ls] a b", 0.4, "confirmed"), ("[tool:env]", 0.4, "confirmed"))
def case_promoted_events(spark):
    """MUT5: decisions and tool results as facts."""
    rows = [("s", "decision", " Use raft ", "it is simple", None), ("s", "decision", "Stop", "", None), ("s", "discovery", "ls", " a b ", "k"), ("s", "discovery", "env", None, None)]
    return ingest.promote_events(spark.createDataFrame(rows, "session string, type string, subject string, body string, fact_key string"), F.lit("confirmed"))


@case("session seq event tool target turn working total", ("S", 3, "tool_error", "Bash", "ls /x", 1, 0, 100), ("S", 4, "tool_thrash", "Bash", "ls /x", 1, 0, 100), ("S", 6, "tool_error", "Bash", "ls /x", 2, 50, 150), ("S", 7, "edit_revert", "Edit", "f.py", 2, 50, 150), ("S", 8, "interrupted", "", "g.py", 2, 50, 150), ("S", 9, "compact_boundary", "auto", "", 2, 800, 900), ("S", 10, "truncation", "", "", 3, 200, 300), ("S", 11, "tool_error", "", "", 3, 200, 300))
def case_degradation(spark):
    """STR1, JN20, PRJ19-20, DTM3: errors and runs of them on one target, reverts, interruptions, compaction and truncation, each at its fuel."""
    return degradation.events(_session(spark))


def _session(spark):
    usage = lambda n: {"input_tokens": n, "cache_read_input_tokens": 0}
    call = lambda i: {"type": "tool_use", "id": i, "name": "Bash", "input": {"command": "ls /x"}}
    result = lambda i, error=True: {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "is_error": error, "content": "no such file"}]}}
    edit = lambda old, new: {"type": "user", "toolUseResult": {"filePath": "f.py", "oldString": old, "newString": new}}
    return degradation.parse(
        _lines(
            spark,
            s=[
                {"sessionId": "S", "type": "assistant", "requestId": "r1", "timestamp": "2024-01-01T00:00:00Z", "message": {"usage": usage(100), "content": [call("a"), call("b"), call("c")]}},
                {"type": "assistant", "requestId": "r1", "message": {"usage": usage(100), "content": []}},
                edit("x", "y"),
                result("a"),
                result("b"),
                {"type": "assistant", "requestId": "r2", "timestamp": "bad", "message": {"usage": usage(150), "content": [call("d")]}},
                {"type": "user", "message": {"content": [*result("c", False)["message"]["content"], *result("d")["message"]["content"]]}},
                edit("y", "x"),
                {"type": "user", "toolUseResult": {"interrupted": True, "filePath": "g.py"}},
                {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "auto", "preTokens": 900, "postTokens": 50}},
                {"type": "assistant", "requestId": "r3", "timestamp": "1970-01-01T00:01:00Z", "message": {"usage": usage(300), "stop_reason": "max_tokens", "content": []}},
                result("zzz"),
                "{broken",
            ],
        )
    )


@case("session turn ts working total floor", ("S", 1, 1704067200.0, 0, 100, 100), ("S", 2, 0.0, 50, 150, 100), ("S", 3, 60.0, 200, 300, 100))
def case_fuel(spark):
    """WIN6-8, STR1, DTM3: one turn a request; no time is 0."""
    return degradation.turns(_session(spark))


@case("name tool_key", ("Bash", "ls"), ("Read", "/a"), ("Grep", '{"a":1,"b":[2]}'), ("Write", ""))
def case_targets(spark):
    """PRJ20: a command, a file, else the canonical input."""
    rows = [("Bash", '{"command": "ls"}'), ("Read", '{"file_path": "/a", "x": 1}'), ("Grep", '{"b": [2], "a": 1}'), ("Write", "{}")]
    return spark.createDataFrame(rows, "name string, i string").select("name", text.tool_target(F.col("name"), F.col("i")).alias("tool_key"))


# -- texts ----------------------------------------------------------------------------------


@case(
    "id noise",
    *[(1, True), (2, False), (3, True), (4, False), (5, True), (6, True), (7, False), (8, True), (9, False), (10, True), (11, True), (12, False)],
)
def case_noise(spark):
    """PRJ10: planning prose, the certificate issuer, verdicts quoted and authored, and where each no longer counts."""
    texts = [
        "Let me find out why the lease expired",
        "Let's Encrypt certificate renewed on ingress",
        "let's encrypt the disk? No: let's look at it first",
        "x" * 39 + " let me see why",
        "x" * 38 + " let me see why",
        "fact 39 = stale. Verdict: reject.",
        "The operator may reject the claim about fact 39 = later",
        "is my own prior verdict: fact 3941 = a restatement. keep via agent-review",
        "fact 12 = a long assessment that goes on and on without any term at its end",
        "**Fact 12 = " + "an assessment " * 20 + "Verdict: keep.",
        "Fact 12 = wait. Deferred for 14 days",
        "etcd needs three members",
    ]
    return spark.createDataFrame(list(enumerate(texts, 1)), "id long, t string").select("id", text.is_noise(F.col("t")).alias("noise"))


_KEY = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc"


@case(
    "id masked",
    (1, "a [REDACTED]"),
    (2, "k [REDACTED] z"),
    (3, "[REDACTED]"),
    (4, "token=[REDACTED]"),
    (5, '{"token":"[REDACTED]"}'),
    (6, "secret=[REDACTED] x"),
    (7, "[REDACTED] [REDACTED] sk-short"),
    (8, "x" * 600 + "…[+50 chars]"),
    (9, "Authorization: [REDACTED]"),
)
def case_redaction(spark):
    """TXT18: keys without an end, values that begin with a bracket, masked values, both kinds of sk- keys, the cut."""
    texts = ["a " + _KEY, "k " + _KEY + "\n-----END RSA PRIVATE KEY----- z", "ghp_" + "a" * 12, "token: abcdef123", '{"token":"[REDACTED]"}', "secret=[abcdefgh x", "sk-ant-" + "a" * 16 + " sk-" + "b" * 20 + " sk-short", "x" * 650, "Authorization: Bearer " + "q" * 20]
    return spark.createDataFrame(list(enumerate(texts, 1)), "id long, t string").select("id", text.redact(F.col("t")).alias("masked"))


@case("id masked", (1, '{"a":{"api_key":"[REDACTED]","n":[{"password":"[REDACTED]"},2]},"z":1}'), (2, '{"cmd":"token=[REDACTED]"}'), (3, "not json"))
def case_redacted_args(spark):
    """TXT18, HSH3: masks by key at any depth, sorted, then by pattern."""
    rows = [(1, '{"z": 1, "a": {"n": [{"password": {"x": 1}}, 2], "api_key": "k"}}'), (2, '{"cmd": "token=abcdefgh"}'), (3, "not json")]
    return spark.createDataFrame(rows, "id long, t string").select("id", text.redact(text.masked_json(F.col("t"))).alias("masked"))


@case("id trigger resolution complete score", (1, "disk full", "restart it", True, 0.7), (2, "the node left", "watch", False, 0.55), (3, "Unknown trigger", "c", False, 0.55), (4, None, None, None, 0.55), (5, None, None, None, 0.55))
def case_procedures(spark):
    """PRJ4-5: what set it off, how it ended, and its score."""
    texts = ["Symptom: disk full\n1. look\n2. clean\n3. restart it\nIt failed, the fix was a larger disk", "After the node left, it timed out\n1. a\n 2. b\n3. watch", "1. a\n2. b\n3. c\nerror", "1. a\n2. b\nerror", "1. a\n2. b\n3. c\nall fine"]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "id long, t string").withColumn("p", text.procedure(F.col("t")))
    return rows.select("id", F.col("p.trigger").alias("trigger"), F.col("p.resolution").alias("resolution"), F.col("p.complete").alias("complete"), text.procedure_score(F.col("p"), F.lit(0.55)).alias("score"))


@case("uuid label changed", ("mined-extra-0123456789", "mined-extra-01234567", False), ("mined-abcdefghij", "mined-abcdefgh", True), ("abcdefghij", "abcdefgh", True), (None, "?", False))
def case_labels(spark):
    """PRJ21-22: ids as shown, and verbs of a change of state as whole words."""
    rows = [("mined-extra-0123456789", "promotedly"), ("mined-abcdefghij", "we Scaled Down it"), ("abcdefghij", "the old node was decommissioned."), (None, "")]
    return spark.createDataFrame(rows, "uuid string, t string").select("uuid", text.display_id(F.col("uuid")).alias("label"), text.state_change(F.col("t")).alias("changed"))


@case("agent origin grp bytes", ("researcher-agent", "cluster", "research", 10485760), ("Dev", "cluster", "shared", 2097152), ("x", "local", "shared", 5242880), ("y", "cluster", "shared", 2097152))
def case_agents(spark):
    """PRJ16-17."""
    rows = spark.createDataFrame([("researcher-agent", "cluster"), ("Dev", "cluster"), ("x", "local"), ("y", "cluster")], "agent string, origin string")
    return rows.select("agent", "origin", text.principal(F.col("agent"), {"researcher-agent": "research"}, "shared").alias("grp"), text.session_threshold(F.col("origin"), F.col("agent")).alias("bytes"))


@case("id newest", (1, dt.date(2024, 1, 3)), (2, dt.date(2023, 12, 30)), (3, dt.date(2022, 5, 6)), (4, None), (5, None))
def case_bullet_dates(spark):
    """PRJ30: the newest stamp; December under a heading of January is last year's; what isn't a date doesn't count."""
    day = dt.date(2024, 1, 10)
    rows = [(1, "- 12-30 and 01-03", day), (2, "- since 12-30, v 13-45", day), (3, "- on 2022-05-06 (not 2022-13-40)", day), (4, "- none", day), (5, "- 01-03", None)]
    return spark.createDataFrame(rows, "id long, t string, d date").select("id", text.newest_date(F.col("t"), F.col("d")).alias("newest"))


@case("id body", (1, "---\na: 1\n---\nx"), (2, "---\na: 1\nb:\n  - c\n---\nx"), (3, "k: 1\nx"), (4, "---\n---\nk: 1"))
def case_front_keys(spark):
    """TXT27: a key with its indented lines; other keys and the body stay."""
    texts = ["---\na: 1\nk:\n  - x\n\ty\n---\nx", "---\na: 1\nb:\n  - c\n---\nx", "k: 1\nx", "---\nk : [1]\n---\nk: 1"]
    return spark.createDataFrame(list(enumerate(texts, 1)), "id long, t string").select("id", text.without_front_key(F.col("t"), "k").alias("body"))


@case("id phrases names", (1, "split brain|on node", "k8s-r1|web-api|k8s-r1"), (2, "", ""))
def case_question_parts(spark):
    """TXT2, TXT4: phrases in both kinds of quotes, trimmed; names with their repeats."""
    rows = [(1, "fix \"Split Brain\" and 'on node ' on K8S-r1 for web-api, k8s-r1 \"ab\""), (2, "plain")]
    out = spark.createDataFrame(rows, "id long, t string").select("id", text.quoted_any(F.col("t")).alias("p"), text.entity_names(F.col("t")).alias("n"))
    return out.select("id", F.array_join(F.sort_array("p", False), "|").alias("phrases"), F.array_join("n", "|").alias("names"))


@case("id section words routed clean", (1, "body of two", "a b_c größe", "a b_c gr e", "go see the docs"))
def case_tokenisers(spark):
    """TXT1, TXT7, TXT8, TXT13."""
    rows = [(1, "1. One:\nx\n2. Two things\nbody of two\n3. Three", "A, b_c; Größe", "- **go** see [the docs](http://x)")]
    out = spark.createDataFrame(rows, "id long, t string, w string, m string")
    return out.select("id", text.section(F.col("t"), "Two").alias("section"), F.array_join(text.words(F.col("w")), " ").alias("words"), F.array_join(text.router_tokens(F.col("w")), " ").alias("routed"), text.clean_markdown(F.col("m")).alias("clean"))


@case(
    "id stripped",
    (1, "[image stripped: 431 bytes]"),
    (2, "[HTML response stripped: 615 bytes]"),
    (3, "[binary content stripped: 1000 bytes]"),
    (4, "aaaaa\n...\n[stripped 20 bytes]\n...\nbbbbb"),
    (5, "plain"),
    (6, "<html> short"),
)
def case_stripped(spark):
    """TXT9-11: images, markup and binary give placeholders; the rest keeps head and tail."""
    texts = [(1, "see data:image/png;base64," + "A" * 405, 2000), (2, "  <!DOCTYPE html>" + "x" * 598, 2000), (3, "\x00\x01ab" * 250, 2000), (4, "a" * 15 + "b" * 15, 10), (5, "plain", 10), (6, "<html> short", 2000)]
    rows = spark.createDataFrame(texts, "id long, t string, n long")
    return rows.select("id", F.when(F.col("n") == 10, bloat.strip_value(F.col("t"), 10)).otherwise(bloat.strip_value(F.col("t"), 2000)).alias("stripped"))


@case("at size", (0, 37), (1, 5000), (2, 2))
def case_pruned_entry(spark):
    """TXT12: errors stay whole."""
    block = "array<struct<type:string,text:string,is_error:boolean>>"
    rows = [(False, [("tool_result", "\x00" * 5000, False), ("tool_result", "\x00" * 5000, True), ("text", "ok", None)])]
    pruned = bloat.strip_entries(spark.createDataFrame(rows, f"is_summary boolean, blocks {block}"))
    return pruned.select(F.posexplode("blocks").alias("p", "b")).select(F.col("p").cast("long").alias("at"), F.length("b.text").cast("long").alias("size"))


@case("stem kind failure_class domain complexity objective fix terms", ("s", "incident", "control_plane", "infrastructure", "simple", "The outage began in the etcd cluster.", "check the fix of the disk|repair it by restarting", ""), ("t", "architecture", "unknown", "storage", "multi-step", vocab.NO_OBJECTIVE, "", "Silent retries (hid the cause)"))
def case_records(spark):
    """PRJ26, TXT14-17: votes over title, tags and body; classes; structure; the first sentence; items outside of fences."""
    rows = [("s", "Debugging", ["Ops"], "# T\n\nThe outage began in the etcd cluster. More about quorum.\n\n- **check** the `fix` of the disk\n```\n- not this fix of the disk\n```\n1. repair it by restarting"), ("t", "Our stack", ["Storage"], "## A\n\nWe build a platform. It has a design.\n\n## B\n**Elsewhere bold**\n## Lessons\n**Silent retries.** hid the cause\n## D\n")]
    out = bloat.records(spark.createDataFrame(rows, "stem string, title string, tags array<string>, body string"), "title", "tags")
    return out.withColumn("fix", F.array_join("fix", "|")).withColumn("terms", F.array_join("terms", "|"))


@case("id days factor", (1, 30.0, 0.5), (2, 2.0, 1.0))
def case_ages(spark):
    """DTM1, MTH4: an unknown age is 30 days; half after 90."""
    rows = spark.createDataFrame([(1, None, 90.0), (2, NOW - dt.timedelta(days=2), 0.0)], "id long, at timestamp, gap double")
    return rows.select("id", scoring.age_days(F.col("at"), F.lit(NOW)).alias("days"), F.round(scoring.half_life(F.col("gap")), 9).alias("factor"))


@case("id free capped floored", (1, 3.0, 2.4, 2.0), (2, 1.0, 1.0, 1.0))
def case_boost_cap(spark):
    """MTH8: no cap, a cap of 1.2, and one under 1, which is 1."""
    rows = spark.createDataFrame([(1, 3.0, 1.5), (2, 1.0, 1.0)], "id long, s double, r double")
    return rows.select("id", *[F.round(injection.cap_boost(F.col("s"), F.col("r"), cap), 9).alias(name) for name, cap in (("free", None), ("capped", 1.2), ("floored", 0.5))])


# -- remote sources -------------------------------------------------------------------------


@case("key scope success cost_usd at", ("a", "s2", True, 0.5, "2"), ("b", None, False, 0.0, None))
def case_outcomes(spark):
    """SRC26: outcomes by key, the last of each; those without a key are left out."""
    first = {"recent": [{"key": " a ", "scope": "s1", "success": False, "at": "1"}, {"key": "", "success": True}, {"key": "b"}], "count": 3}
    second = {"recent": [{"key": "a", "scope": "s2", "success": True, "cost_usd": 0.5, "at": "2"}]}
    return remote.outcomes(spark.createDataFrame([(json.dumps(x),) for x in (first, second)] + [("{broken",)], "answer string"))


@case("session seq type subject", ("7", 1, "discovery", "task"), ("7", 2, "decision", "report"))
def case_fetched_flows(spark):
    """SRC27: finished flows and their logs, as lines that the flow parser reads."""
    listed = {"data": {"flows": [{"id": "7", "status": "finished", "title": "t", "createdAt": "c"}, {"id": "8", "status": "running"}]}}
    logs = {"data": {"agentLogs": [{"id": "1", "task": "task", "result": "r"}], "terminalLogs": [], "messageLogs": [{"id": "2", "type": "report", "message": "m"}]}}
    flows = remote.finished_flows(spark.createDataFrame([(json.dumps(listed),)], "answer string"))
    return transcripts.flow_logs(remote.flow_lines(flows, spark.createDataFrame([("7", json.dumps(logs))], "id string, answer string")))


@case("session seq subject body", ("r", 0, "why?", "because it is so, they say"))
def case_recorded(spark):
    """SRC25: answers of an endpoint as turns; a failed one gives none."""
    answer = {"choices": [{"message": {"content": "because it is so, they say"}}]}
    rows = [("r", 0, "2024", "why?", json.dumps(answer), 5), ("r", 1, "2024", "how?", '{"error": 1}', 5)]
    return transcripts.simple_turns(remote.recorded(spark.createDataFrame(rows, "stem string, line_no int, ts string, query string, answer string, latency_ms long"), "m", "chat"))


@case("event tool session project", ("pre", "Bash", "s1", "no-git"), ("post", "unknown", "unknown", "e6d8e0b7de2b"))
def case_observations(spark):
    """SRC32: tool calls as a hook sees them."""
    rows = [("t", "pre", '{"tool_name": "Bash", "session_id": "s1"}', None), ("t", "post", "{broken", "git@host:a.git")]
    return remote.observations(spark.createDataFrame(rows, "ts string, event string, payload string, remote string"))


@case("domain body source", ("a", "cached", "cache"), ("b", "probed", "probe"), ("c", "file", "fallback"), ("d", None, None))
def case_landscapes(spark):
    """SRC30, STR5: a fresh cache row, else a probe, else the fallback."""
    names = spark.createDataFrame([(x,) for x in "abcd"], "domain string")
    cache = spark.createDataFrame([("a", NOW, "cached"), ("a", NOW - dt.timedelta(seconds=9), "older"), ("b", NOW - dt.timedelta(days=1), "stale")], "domain string, ts timestamp, body string")
    body = lambda *rows: spark.createDataFrame(rows, "domain string, body string")
    return remote.landscapes(names, cache, body(("a", "x"), ("b", "probed")), body(("b", "y"), ("c", "file")), F.lit(NOW), 300)


# -- folders and writers --------------------------------------------------------------------


@case("stem name body", ("a", "x", "- one\n- two"), ("b", None, "---\nopen"))
def case_front_matter(spark):
    """SRC20-21: scalar fields of a front matter; without an end there is none."""
    docs = spark.createDataFrame([("a", "name: 'x'\nother: y", "- one\n- two"), ("b", None, "---\nopen")], "stem string, head string, body string")
    return folders.front_matter(docs, "name")


@case("domain line_no fact_text", ("a", 0, "one"), ("a", 2, "two"))
def case_bullets(spark):
    """SRC33."""
    return folders.bullets(spark.createDataFrame([("a", "- one\ntext\n- two")], "stem string, body string"))


@case("file place path leaf", ("f", 0, "a.b", "1"), ("f", 1, "l[0]", "x"))
def case_yaml_leaves(spark):
    """SRC18: secrets, templates and broken files are left out."""
    return folders.yaml_leaves(spark.createDataFrame([("f", "a:\n  b: 1\n  token: z\nl: [x, '{{t}}']"), ("g", "a: [")], "file string, value string"))


@case("name addresses", ("web", "10.0.0.1,10.0.0.2"), ("db_up", ""))
def case_aliases(spark):
    """SRC19: aliases and functions with the addresses they hold."""
    lines = spark.createDataFrame([("alias web='ssh 10.0.0.1 && ping 10.0.0.2'",), ("db_up() {",), ("echo 10.0.0.3",)], "line string")
    return folders.aliases(lines).withColumn("addresses", F.array_join("addresses", ","))


@case("path", ("cold",))
def case_cold_files(spark):
    """SRC13-15: old and large enough."""
    rows = [("cold", NOW - dt.timedelta(hours=5), 100), ("warm", NOW - dt.timedelta(hours=3), 100), ("small", NOW - dt.timedelta(hours=9), 1)]
    return folders.cold_files(spark.createDataFrame(rows, "path string, file_modification_time timestamp, file_size long"), NOW, 4.0, 10)


@case("id v", (1, "a"), (2, "b"))
def case_registries(spark):
    """SRC22-23, SRC28: the first source's row stays."""
    return folders.merge_registries(spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "id long, v string"), key="id")


@case("kind by sha", ("fix_after_feat", "2", "1"), ("revert", "4", "1"))
def case_commits(spark):
    """SRC31, WIN11: reverts by subject, and fixes within 48 hours of the feature before them."""
    rows = [("r", "1", "2024-01-01", "feat: x"), ("r", "2", "2024-01-02", "fix: x"), ("r", "3", "2024-01-09", "fix: y"), ("r", "4", "2024-01-10", 'Revert "feat: x"')]
    return folders.revert_pairs(spark.createDataFrame(rows, "repo string, sha string, at string, subject string"))


@case("name state_change", ("2024-01-02T03-04-05_abcdef12.json", True), ("----------tmp-x_nouuid.json", False), ("unknown_a.json", None))
def case_staged_names(spark):
    """SNK1, PRJ22: names that can't leave their folder."""
    rows = [("2024-01-02T03:04:05.999Z", "abcdef1234", False, "it was migrated"), ("../../../.tmp/x", "../../..", False, "same"), (None, "a", True, "deleted")]
    return ingest.staged_names(spark.createDataFrame(rows, "timestamp string, uuid string, reviewed boolean, body string"))


@case("fact_key", ("b",))
def case_staging_rest(spark):
    """SNK10."""
    return writers.staging_rest(spark.createDataFrame([("a",), ("b",)], "fact_key string"), spark.createDataFrame([("a",)], "fact_key string"))


@case("domain n line", ("a", 1, "- y"), ("a", 2, "- x"), ("b", 1, "- z"))
def case_memory_lines(spark):
    """SNK6: the best facts a domain, as bullets."""
    return writers.memory_lines(spark.createDataFrame([(1, "a", "x", 0.5), (2, "a", "y", 0.9), (3, "a", "w", 0.1), (4, "b", "z", 0.2)], "id long, domain string, text string, score double"), 2)


@case("id domain place", (3, "a", 1), (1, "a", 2), (4, "b", 1))
def case_highlights(spark):
    """SRT4, SNK6: by score and confirmations, over the floor."""
    rows = [(1, "a", 0.9, 0), (2, "a", 0.5, 1), (3, "a", 0.8, 5), (4, "b", 0.2, None), (5, "b", 0.15, 90)]
    return curation.highlights(spark.createDataFrame(rows, "id long, domain string, score double, confirmations long"), 2)


@case("path verdict", ("/a/b", "inside"), ("/a/../b", "outside"), ("/ab", "outside"), ("/a", "inside"))
def case_guarded_paths(spark):
    """SNK11."""

    def verdict(path):
        try:
            writers.guard_path(path, "/a")
            return "inside"
        except ValueError:
            return "outside"

    return spark.createDataFrame([(p, verdict(p)) for p in ("/a/b", "/a/../b", "/ab", "/a")], "path string, verdict string")


@case("path state", ("a", "same"), ("b", "differs"), ("c", "only_left"), ("d", "only_right"))
def case_commands(spark):
    """SNK13, PRJ27: generated commands against those that are there."""
    tree = lambda *rows: spark.createDataFrame(rows, "p string, h string")
    return markdown.divergence(tree(("a", "1"), ("b", "1"), ("c", "1")), tree(("a", "1"), ("b", "2"), ("d", "1")), "p", "h")


# -- facts and curation ---------------------------------------------------------------------


@case("id", (1,), (2,))
def case_live(spark):
    """PRJ25."""
    return facts.live(spark.createDataFrame([(1, None, None), (2, None, "confirmed"), (3, None, "rejected"), (4, NOW, None)], "id long, tombstoned_at timestamp, outcome string"))


@case("source position state", ("s", 0, "exists"), ("s", 1, "would-insert"), ("s", 2, "would-insert"))
def case_reconcile_dry(spark):
    """MUT12: what would be inserted; a tombstoned fact is gone."""
    return curation.reconcile(*_sources(spark), promote=False)[0]


@case("fact_key fact_text provenance score", ("reconcile:s:1", "two", "source-registry:s", 0.5), ("reconcile:s:2", "three", "source-registry:s", 0.5))
def case_reconcile(spark):
    """MUT12: the rows to insert."""
    return curation.reconcile(*_sources(spark), promote=True)[1]


def _sources(spark):
    sources = spark.createDataFrame([("s", 0, "one"), ("s", 1, "two"), ("s", 2, "three")], "source string, position long, text string")
    return sources, spark.createDataFrame([("reconcile:s:0", None), ("reconcile:s:1", NOW)], "fact_key string, tombstoned_at timestamp")


@case("uuid reviewed", ("aabbc1", True), ("aabbd2", True), ("xabbee", True))
def case_done(spark):
    """MUT15: of two that a prefix fits, the one that isn't reviewed is meant."""
    return ingest.mark_reviewed(_staged(spark), "AABB", NOW)


@case("n", (0,))
def case_done_ambiguous(spark):
    """MUT15: a short prefix means nothing, and one that two open rows share neither."""
    both = spark.createDataFrame([("aabb1", False), ("aabb2", False)], "uuid string, reviewed boolean")
    found = ingest.resolve_prefix(_staged(spark), "aab").unionByName(ingest.resolve_prefix(both, "aabb"))
    return found.agg(F.count("*").alias("n"))


def _staged(spark):
    return spark.createDataFrame([("aabbc1", False), ("aabbd2", True), ("xabbee", True)], "uuid string, reviewed boolean")


@case("uuid place", ("c", 1), ("a", 2), ("d", 3), ("b", 4))
def case_review_order(spark):
    """SRT5, PRJ14: changes of state first, then signal, then time; reviewed ones are out."""
    rows = [("a", "key_concepts", "x", False, "2", False), ("b", "files_changed", "x", False, "1", False), ("c", "primary_request", "", True, "9", False), ("d", "errors_fixes", "y", False, "3", False), ("e", "errors_fixes", "y", True, "0", True)]
    summaries = spark.createDataFrame(rows, "uuid string, section string, body string, state_change boolean, timestamp string, reviewed boolean")
    return ingest.review_order(summaries.withColumn("signal", ingest.has_signal(F.col("section"), F.col("body"))))


@case("id changed text", (1, True, "new and New"), (2, False, "none"))
def case_rename(spark):
    """MUT19."""
    return ingest.rename(spark.createDataFrame([(1, "old and Old"), (2, "none")], "id long, text string"), "old", "new")


@case("id status", (1, "kept"), (2, "newest"))
def case_reopened(spark):
    """MUT8: the newest state of each key."""
    rows = [(1, "kept", NOW), (2, "older", NOW - dt.timedelta(days=1)), (2, "newest", NOW)]
    return pool.latest_state(spark.createDataFrame(rows, "id long, status string, at timestamp"), "id", "at")


@case("id expired", (1, True), (2, False), (3, False), (4, False))
def case_expired(spark):
    """STR5: live facts that weren't seen for long; others and tombstoned ones aren't touched."""
    rows = [(1, "live", NOW - dt.timedelta(days=100), None), (2, "live", NOW - dt.timedelta(days=1), None), (3, "operational", NOW - dt.timedelta(days=100), None), (4, "live", NOW - dt.timedelta(days=100), NOW)]
    return curation.expire(spark.createDataFrame(rows, "id long, fact_type string, last_seen timestamp, tombstoned_at timestamp"), F.lit(NOW), 30)


@case("key", ("fresh",))
def case_cache(spark):
    """STR5: a cache's rows for as long as they last."""
    rows = [("fresh", NOW - dt.timedelta(seconds=10)), ("stale", NOW - dt.timedelta(seconds=999))]
    return curation.cached(spark.createDataFrame(rows, "key string, ts timestamp"), F.lit(NOW), 300)


@case("id conflict_with conflict_text", (1, 2, "y" * 120), (3, 9, None))
def case_conflicts(spark):
    """JN19: the other text as a reviewer sees it."""
    rows = [(1, "x", "pending", 2), (2, "y" * 200, "auto", None), (3, "z", "pending", 9)]
    return curation.conflicts(spark.createDataFrame(rows, "id long, text string, review_state string, conflict_with long"))


@case("k count", ("b", 3), ("a", 2))
def case_contested(spark):
    """SRT9."""
    rows = [("a", None), ("a", None), ("b", None), ("b", None), ("b", None), ("c", None), ("d", NOW), ("d", None)]
    return curation.contested(spark.createDataFrame(rows, "k string, tombstoned_at timestamp"), "k")


@case("qid id tier place", (1, 7, 0, 1), (1, 5, 0, 2), (1, 6, 1, 3))
def case_evidence(spark):
    """SET7: linked facts first, each fact once, up to the most."""
    linked = spark.createDataFrame([(1, 5, 0.1), (1, 7, 0.9)], "qid long, id long, score double")
    matched = spark.createDataFrame([(1, 7, 0.9), (1, 6, 0.8), (1, 8, 0.2)], "qid long, id long, score double")
    return curation.evidence(linked, matched, 3)


@case("findings_open pool_open pool_taken sessions", (2, 1, 2, 3))
def case_status(spark):
    """AGG26."""
    s = lambda *xs: spark.createDataFrame([(x,) for x in xs], "status string")
    return curation.status_counts(s("open", "reviewing", "closed"), s("open", "taken", "taken", "done"), s("a", "b", "c"))


@case("harness sessions", ("x", 2), ("y", 1))
def case_roster_counts(spark):
    """AGG26."""
    return curation.harness_counts(spark.createDataFrame([("x",), ("x",), ("y",)], "harness string"))


@case("session pid", ("near", 30))
def case_own_session(spark):
    """CRD10: the living session nearest above a process, by its chain of parents."""
    processes = spark.createDataFrame([(50, 40), (40, 30), (30, 20), (20, 1), (60, 50)], "pid long, parent long")
    chain = curation.ancestry(processes, spark.createDataFrame([(50,)], "pid long"))
    registry = spark.createDataFrame([("dead", 40, False), ("near", 30, True), ("far", 20, True), ("other", 60, True)], "session string, pid long, alive boolean")
    return curation.own_session(registry, chain)


# -- graph ------------------------------------------------------------------------------------


@case("subject predicate object", ("web-api", "runs_on", "k8s-1"), ("web-api", "uses_storage", "block-fast"))
def case_relations(spark):
    """KG3."""
    docs = spark.createDataFrame([(1, "the web-api runs on k8s-1 and web-api uses block-fast"), (2, "nothing")], "id long, text string")
    return graph.relations(docs, "id", "text")


_PATTERNS = {"svc": r"\b(?:postgres|etcd)\b", "ns": r"in namespace (\w+)|-n (\w+)", "agent": r"\b(bot)\b"}


def _notes(spark):
    rows = [(1, "etcd in namespace prod by bot"), (2, "bot: " + "x" * 400 + " etcd -n prod"), (3, "Postgres etcd"), (4, "etcd in namespace the " + "y" * 400 + " -n prod")]
    return spark.createDataFrame(rows, "id long, text string").withColumn("text", F.lower("text"))


@case("id entity_id first_at", (1, "svc:etcd", 0), (1, "ns:prod", 5), (1, "agent:bot", 26), (2, "agent:bot", 0), (2, "svc:etcd", 406), (2, "ns:prod", 411), (3, "svc:postgresql", 0), (3, "svc:etcd", 9), (4, "svc:etcd", 0), (4, "ns:prod", 423))
def case_mentions(spark):
    """KG1-2: whole matches and first groups, aliases, stop words, offsets of the match."""
    return graph.mentions(_notes(spark), "id", "text", _PATTERNS, {"postgres": "postgresql"}, ("the",)).withColumn("first_at", F.col("first_at").cast("long"))


@case("subject predicate object weight first", ("ns:prod", "mentioned_with", "svc:etcd", 2, 1), ("svc:etcd", "co_occurs_with", "svc:postgres", 1, 3))
def case_index_new(spark):
    """KG6-7, KG12, STR2: unindexed texts only; agents don't pair, nor what is far apart."""
    return graph.index_new(_notes(spark), spark.createDataFrame([(9,)], "id long"), "id", "text", _PATTERNS, stop=("the",))[1]


@case("subject predicate object weight first", ("a", "p", "b", 5, 1), ("a", "p", "c", 1, 9))
def case_add_edges(spark):
    """KG6, STR2."""
    edges = lambda *rows: spark.createDataFrame(rows, "subject string, predicate string, object string, weight long, first long")
    return graph.add_edges(edges(("a", "p", "b", 2, 1)), edges(("a", "p", "b", 3, 7), ("a", "p", "c", 1, 9)))


@case("name valid", ("a", True), ("b", False), ("c", True), ("d", False))
def case_patterns(spark):
    """KG14: a configuration's patterns over the built-in ones; broken ones are left out, `none` leaves only the own."""
    good, bad = graph.load_patterns({"a": "x", "d": "z"}, {"b": "(", "c": "y", "d": "["})
    assert set(graph.load_patterns({"a": "x"}, {"c": "y"}, "none")[0]) == {"c"}
    return spark.createDataFrame([(n, True) for n in good] + [(n, False) for n in bad], "name string, valid boolean")


@case("entity dir other", ("node:1", "in", "svc:a"))
def case_find(spark):
    """KG8, KG10, KG15: by a part of the name, as of a time; a closed edge is gone after it."""
    triples = spark.createDataFrame([("svc:a", "runs_on", "node:1", NOW, None), ("svc:b", "runs_on", "node:1", NOW, None)], "subject string, predicate string, object string, valid_from timestamp, valid_to timestamp")
    closed = graph.invalidate(triples, "svc:b", "runs_on", "node:1", dt.datetime(2024, 2, 1))
    return graph.find(spark.createDataFrame([("node:1", "NODE one")], "entity_id string, name string"), closed, "node", dt.datetime(2024, 3, 1))


@case("id target", (1, "a/x"), (2, "b/x"), (3, "y"))
def case_link_targets(spark):
    """TXT28."""
    return graph.link_targets(spark.createDataFrame([(1, "a/x.md"), (2, "b/x.md"), (3, "b/y.md")], "id long, path string"))


_FOOT = graph.FOOTER_BEGIN + "\n**Related:** {}\n" + graph.FOOTER_END + "\n"


@case("id text changed", (1, "one\n\n" + _FOOT.format("[[b$1]] · [[c]]"), True), (2, "two\n\n" + _FOOT.format("[[a]]"), True), (3, "three\n\n", True), (4, "four", False), (5, "five\n\n" + _FOOT.format("[[a]]"), False))
def case_footers(spark):
    """SNK8: footers are added, replaced, removed, or left when they are right."""
    notes = spark.createDataFrame([(1, "one\n\n\n"), (2, "two\n\n" + _FOOT.format("[[old]]")), (3, "three\n\n" + _FOOT.format("[[old]]")), (4, "four"), (5, "five\n\n" + _FOOT.format("[[a]]"))], "id long, text string")
    ranked = spark.createDataFrame([(1, 12, 1), (1, 13, 2), (2, 11, 1), (5, 11, 1)], "source long, target long, rank long")
    return graph.footers(notes, ranked, spark.createDataFrame([(11, "a"), (12, "b$1"), (13, "c")], "id long, target string"))


# -- routing and injection --------------------------------------------------------------------


def _skills(spark):
    glob = lambda *ps: [(text.glob_pattern(p), text.glob_specificity(p)) for p in ps]
    rows = [
        ("a", "always", 10, "", "", "", "rules", [], []),
        ("p", "reference", 10, "", "", "", "paths", glob("src/**/*.py", "**"), ["d"]),
        ("k", "reference", 10, "etcd backup", "", "", "restore", [], []),
        ("h", "hard", 10, "", "", "", "", [], []),
        ("d", "reference", 10, "", "", "", "deps", [], []),
    ]
    skills = spark.createDataFrame(rows, "name string, gate string, tokens long, trigger string, description string, domain string, body string, globs array<struct<pattern:string,specificity:double>>, also_load array<string>")
    return skills, routing.skill_scores(skills, F.array(F.lit("etcd"), F.lit("restore")), spark.createDataFrame([("src/x/y.py",)], "path string"))


@case("name score signal", ("p", 0.5, "path-glob"), ("k", 0.35, "keyword"), ("h", 0.075, "gate-floor"), ("d", 0.0, "none"))
def case_skill_scores(spark):
    """RET13, TXT19-20, SET4: paths, words of the front and of the body, gates."""
    return _skills(spark)[1].where("gate != 'always'").withColumn("score", F.round("score", 6))


@case("name why", ("a", "always"), ("p", "score"), ("k", "score"), ("h", "score"), ("d", "also"))
def case_selected_skills(spark):
    """RET14, JN24: by score within the budget, then what those load."""
    return routing.select_skills(_skills(spark)[1], 45)


@case("name place", ("p", 1), ("k", 2), ("h", 3))
def case_recommended(spark):
    """RET18, SRT8."""
    return injection.recommend(_skills(spark)[1])


@case("name part body", ("p", "guide", "paths"), ("d", "also", "deps"))
def case_primed(spark):
    """RET18: only types that are allowed."""
    skills = _skills(spark)[0]
    return injection.prime(skills, " P ", ("p", "k")).unionByName(injection.prime(skills, "h", ("p", "k")))


@case("qid domain source", (1, "net", "corpus"), (2, "hint", "hint"), (3, "sec", "keyword"), (4, "sto", "entity"))
def case_suggested(spark):
    """RET16-17, JN10: keyword, entity, corpus, hint, in this order."""
    rows = [(1, "net", "route table changed", 0.5), (2, "net", "route flaps", 0.4), (3, "sto", "route to disk", 0.9)]
    asked = spark.createDataFrame([(1, "which route failed"), (2, "zzzz"), (3, "route"), (4, "xyz")], "qid long, text string")
    corpus = routing.corpus_domains(spark.createDataFrame(rows, "id long, domain string, text string, score double"), asked)
    told = lambda *xs: spark.createDataFrame(xs, "qid long, domain string")
    return routing.suggest(asked, told((3, "sec")), told((4, "sto"), (3, "x")), corpus, F.lit("hint")).withColumnRenamed("by", "source")


@case("name", ("new",))
def case_handoff(spark):
    """RET19."""
    rows = spark.createDataFrame([("old", "etcd", dt.datetime(2023, 12, 1), 10), ("new", "etcd ops", dt.datetime(2024, 1, 1), 10), ("big", "etcd", NOW, 9000)], "name string, skill string, at timestamp, tokens long")
    return routing.pick_handoff(rows, F.array(F.lit("etcd")), NOW)


@case("qid name tokens", (1, "deploy", 2), (2, "deploy", 2))
def case_sops(spark):
    """RET20."""
    scopes = spark.createDataFrame([(1, "scope:deploy"), (1, "scope:none"), (1, "deploy"), (2, "scope:deploy")], "qid long, scope string")
    return injection.sops(scopes, spark.createDataFrame([("deploy", " 12345678 ")], "name string, text string"))


@case("qid passed hits missing anti entries warned", (1, True, "etcd", "raft", "mysql", 2, True), (2, False, "", "etcd|raft", "", 0, False))
def case_scored_cases(spark):
    """RET21."""
    outputs = spark.createDataFrame([(1, "x ETCD\n<!-- a\n<!-- b mysql"), (2, "nothing")], "qid long, text string")
    cases = spark.createDataFrame([(q, ["etcd", "raft"], ["MySQL"], 1) for q in (1, 2)], "qid long, required array<string>, anti array<string>, min_hits long")
    out = evaluation.score_cases(outputs, cases)
    return out.select("qid", "passed", F.array_join("hits", "|").alias("hits"), F.array_join("missing", "|").alias("missing"), F.lower(F.array_join("anti_hits", "|")).alias("anti"), "entries", "warned")


@case("qid n_relevant relevant_id", (1, 2, 10), (1, 2, 12), (2, 0, None))
def case_exported_set(spark):
    """RET8, SNK12, SET3: facts with two terms, inside of words too; a question without any stays."""
    rows = spark.createDataFrame([(10, "the Etcdctl raft log"), (11, "etcd only"), (12, "rafting with etcd")], "id long, text string")
    cases = spark.createDataFrame([(1, ["etcd", "raft"]), (2, ["ab"])], "qid long, terms array<string>")
    return evaluation.export_set(evaluation.relevant(rows, cases), cases)


# -- pool and coordination ----------------------------------------------------------------------


def _claims(spark):
    rows = [("r1", "s1", 1, NOW - dt.timedelta(hours=5), 3600, None, None, "n1"), ("r2", "s2", 2, NOW, 3600, None, None, "n2"), ("r3", "s1", 3, NOW, 3600, None, None, "n3")]
    return spark.createDataFrame(rows, "resource string, session_id string, pid long, created_at timestamp, ttl_sec long, released_at timestamp, released_reason string, note string")


@case("resource void", ("r1", "expired"), ("r2", None), ("r3", "holder-dead"))
def case_claims(spark):
    """CRD2, PRJ24, JN15: why a claim no longer holds; a process that isn't listed isn't dead."""
    return pool.active_claims(_claims(spark), NOW, spark.createDataFrame([(3, False)], "pid long, alive boolean"))


@case("resource reason", ("r1", "steal"), ("r2", None), ("r3", None))
def case_released(spark):
    """CRD3."""
    return pool.release(_claims(spark), F.col("resource") == "r1", NOW, "steal").withColumnRenamed("released_reason", "reason")


@case("id title", ("handoff:r3", "n3"))
def case_handoff_tasks(spark):
    """CRD9: open claims as tasks."""
    return pool.handoff_tasks(pool.release(_claims(spark), F.col("resource") == "r1", NOW, "steal"), "s1", NOW)


@case("session_id claims", ("s1", 2), ("s9", 0))
def case_roster(spark):
    """CRD7: sessions with their claims."""
    return pool.roster(spark.createDataFrame([("s1",), ("s9",)], "session_id string"), _claims(spark))[0]


@case("resource", ("r2",))
def case_orphans(spark):
    """CRD7, JN15: claims of sessions that are gone."""
    return pool.roster(spark.createDataFrame([("s1",), ("s9",)], "session_id string"), _claims(spark))[1]


def _tasks(spark):
    rows = [("b", "open", NOW, None, None, None), ("a", "open", NOW, None, None, None), ("c", "taken", NOW, "x", NOW, 7)]
    return spark.createDataFrame(rows, "id string, status string, created_at timestamp, taken_by string, taken_at timestamp, taken_pid long")


@case("id status taken_by", ("a", "taken", "me"), ("b", "open", None), ("c", "taken", "x"))
def case_taken(spark):
    """CRD5: the oldest open task, ties by id."""
    return pool.take_first(_tasks(spark), "me", NOW)


@case("id status", ("a", "open"), ("b", "open"), ("c", "open"))
def case_dead_tasks(spark):
    """CRD5."""
    return pool.reopen_dead(_tasks(spark), spark.createDataFrame([(7, False)], "taken_pid long, alive boolean"))


def _findings(spark):
    return spark.createDataFrame([("abc", "new", None, None, None), ("abd", "new", None, None, NOW)], "id string, status string, reviewer string, updated_at timestamp, synced_at timestamp")


@case("id status reviewer", ("abc", "ok", "me"), ("abd", "new", None))
def case_findings(spark):
    """CRD4, MUT7: a prefix that only one finding has; an ambiguous one changes nothing."""
    return pool.review_findings(pool.review_findings(_findings(spark), "ab", "bad", "me", NOW), "abc", "ok", "me", NOW)


@case("way id", ("pull", "xyz"), ("push", "abc"))
def case_sync(spark):
    """CRD8: by id, once."""
    rows = _findings(spark)
    pull, push = pool.sync(rows, rows.where("id = 'abd'").withColumn("id", F.lit("xyz")))
    return pull.select(F.lit("pull").alias("way"), "id").unionByName(push.select(F.lit("push").alias("way"), "id"))


# -- notes ----------------------------------------------------------------------------------------


def _pointers(spark):
    body = "- fixed `etcd-lease` and **quorum loss** #42 → domain/net.md §Lease rules\n- see net.md and gone.md\n- a.md [pin] → domain/net.md"
    lines = markdown.lines(spark.createDataFrame([(1, body)], "id long, text string"), "id", "text")
    found = pointers.resolve(pointers.pointers(lines), spark.createDataFrame([("domain/net.md",), ("x/a.md",), ("y/a.md",)], "path string"))
    return lines, found, spark.createDataFrame([("domain/net.md", "# Leases\nthe etcd-lease after quorum loss")], "path string, text string")


@case("line_no target state", (1, "domain/net.md", "ok"), (2, "gone.md", "dangling"), (2, "net.md", "unqualified"), (3, "a.md", "ambiguous"), (3, "domain/net.md", "ok"))
def case_pointers(spark):
    """TXT23-24, LNT4-5."""
    return _pointers(spark)[1]


@case("line_no anchor", (1, "Lease rules"))
def case_anchors(spark):
    """TXT26, JN22, LNT5: an anchor's words must begin words of a heading."""
    _, found, texts = _pointers(spark)
    return pointers.anchor_missing(found, texts)


@case("line_no evict", (1, True), (2, False), (3, False))
def case_evictable(spark):
    """PRJ29, JN27, TXT22, TXT25, LNT6."""
    return pointers.evictable(*_pointers(spark))


@case("part line_no", ("stays", 2), ("stays", 3), ("archive", 1))
def case_rolled(spark):
    """SNK9."""
    lines, found, texts = _pointers(spark)
    stay, gone = pointers.roll(lines, pointers.evictable(lines, found, texts))
    return stay.select(F.lit("stays").alias("part"), "line_no").unionByName(gone.select(F.lit("archive").alias("part"), "line_no"))


@case("line_no heading fenced", (1, "# A", False), (2, "# A", True), (3, "# A", True), (4, "# A", False), (5, "# B", False))
def case_fences(spark):
    """WIN14-15: a heading in a fence is none."""
    rows = markdown.lines(spark.createDataFrame([(1, "# A\n```\n# no\n```\n# B")], "id long, text string"), "id", "text")
    fenced = markdown.outline(rows, F.lit(None).cast("string"), F.col("line").startswith("```")).drop("heading")
    return markdown.outline(fenced, F.when(~F.col("fenced") & F.col("line").startswith("#"), F.col("line")))


def _sized(spark):
    notes = spark.createDataFrame([("INDEX.md", "x" * 17_000), ("domain/a.md", "l\n" * 30), ("domain/b.md", "l\n" * 12 + "l"), ("skills/c.md", ""), ("z.md", "l\n" * 3)], "path string, text string")
    return health.sizes(notes, spark.createDataFrame([("domain", 10, 20), ("other", 2, 5)], "kind string, warn long, error long"))


@case("path lines bytes status", ("INDEX.md", 1, 17000, "GREEN"), ("domain/a.md", 30, 60, "RED"), ("domain/b.md", 13, 25, "YELLOW"), ("skills/c.md", 0, 0, "GREEN"), ("z.md", 3, 6, "YELLOW"))
def case_sizes(spark):
    """LNT8, PRJ23: limits by kind, from the limit on."""
    return _sized(spark)


@case("path check_name level detail", ("domain/a.md", "lines", "RED", "30"), ("domain/b.md", "lines", "YELLOW", "13"), ("z.md", "lines", "YELLOW", "3"), ("INDEX.md", "bytes", "YELLOW", "17000"), ("domain/net.md", "anchor", "YELLOW", "Lease rules"))
def case_health(spark):
    """LNT8: all findings in one relation."""
    _, found, texts = _pointers(spark)
    missing = health.finding(pointers.anchor_missing(found, texts), "anchor", F.lit("YELLOW"), F.col("anchor"), F.col("target"), F.col("line_no"))
    return health.health(_sized(spark), "INDEX.md", missing).withColumnRenamed("check", "check_name")


@case("name path", ("drift-2024-01-02.md", "domain/a.md"), ("drift-2024-01-02.md", "domain/b.md"), ("drift-2024-01-02.md", "z.md"), ("drift-2024-01-02.md", "INDEX.md"))
def case_drift_report(spark):
    """LNT12."""
    return health.drift_report(health.health(_sized(spark), "INDEX.md"), F.lit(NOW).cast("date"))


@case("line_no domain line", (1, "networking", "- the DNS of vault"), (5, "storage", "* nfs mounts"))
def case_misplaced(spark):
    """LNT9: the first domain of a bullet; universal rules and prose stay."""
    rows = [(1, "- the DNS of vault"), (2, "dns in prose"), (3, "- never touch dns"), (4, "- nothing"), (5, "  * nfs mounts")]
    return health.misplaced(spark.createDataFrame(rows, "line_no long, line string").withColumn("line", F.trim("line")))
