"""Transcript formats as DataFrames of typed events.

Files are read whole where the order of lines counts (Spark's text rows have none across
splits). JSON is parsed into VARIANT after a substring filter on the raw line, so most lines are
never parsed. Broken lines give nulls and drop out. Every parser returns `EVENT` columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text

EVENT = ("session", "seq", "type", "subject", "body", "fact_key")


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """SRC1, SRC9: file, stem, line_no, line of all files below a path."""
    whole = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(path, wholetext=True)
    named = whole.select(F.input_file_name().alias("file"), "value").withColumn("stem", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1))
    return named.select("file", "stem", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("trim(line) != ''")


def first_of_stem(rows: DataFrame) -> DataFrame:
    """SRC1, WIN3: of files with one stem the first by name."""
    first = rows.groupBy("stem").agg(F.min("file").alias("f"))
    return rows.join(first, "stem").where("file = f").drop("f")


def detect_format(path: Column) -> Column:
    """SRC10."""
    low = F.lower(path)
    return F.when(low.endswith(".jsonl"), "jsonl").when(low.endswith(".json"), "json").when(low.endswith(".md"), "markdown").otherwise("unknown")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def blocks_text(content: Column) -> Column:
    """SRC12: a string, or the joined texts of typed blocks."""
    blocks = F.from_json(F.to_json(content), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "")
    return F.when(F.schema_of_variant(content) == "STRING", _get(content, "$")).otherwise(joined)


def _event(session, seq, kind, subject, body, key) -> list[Column]:
    return [c.alias(n) for c, n in zip((session, seq.cast("long"), F.lit(kind), subject, body, key), EVENT, strict=True)]


def compact_summaries(lines: DataFrame, least: int = 100) -> DataFrame:
    """SRC1-2: summaries, cut at numbered headings; parts of over `least` characters are decisions."""
    parsed = lines.where(F.col("line").contains("isCompactSummary")).withColumn("v", F.try_parse_json("line")).where(_get(F.col("v"), "$.isCompactSummary", "boolean"))
    body = parsed.withColumn("t", blocks_text(F.try_variant_get("v", "$.message.content", "variant")))
    parts = body.select("stem", "line_no", F.posexplode(F.split("t", r"\n(?=\d+\.\s)")).alias("part", "p")).where(F.length("p") > least)
    return parts.select(*_event(F.col("stem"), F.col("line_no") * 1000 + F.col("part"), "decision", F.substring_index("p", "\n", 1), F.col("p"), text.fact_key(F.concat("stem", F.lit(":"), F.substring("p", 1, 200)))))


def tool_results(lines: DataFrame, least: int = 500, most: int = 5000) -> DataFrame:
    """SRC2: results without an error, of a useful length, once a content."""
    parsed = lines.where(F.col("line").contains("tool_result")).withColumn("v", F.try_parse_json("line"))
    kind = "array<struct<type:string,tool_use_id:string,is_error:boolean,content:string>>"
    each = parsed.select("stem", "line_no", F.posexplode(F.from_json(F.to_json(F.try_variant_get("v", "$.message.content", "variant")), kind)).alias("at", "b")).where("b.type = 'tool_result' and not coalesce(b.is_error, false)")
    good = each.where((F.length("b.content") > least) & (F.length("b.content") < most) & ~text.is_noise(F.col("b.content")))
    out = good.select(*_event(F.col("stem"), F.col("line_no") * 1000 + F.col("at"), "discovery", F.col("b.tool_use_id"), F.col("b.content"), text.fact_key(F.col("b.content"))))
    return out.dropDuplicates(["fact_key"])


def thought_documents(files: DataFrame, stop_subjects: tuple[str, ...] = ("prioritizing file exploration",), secrets: tuple[str, ...] = ("_TOKEN=", "password=", "secret=")) -> DataFrame:
    """SRC3: one JSON document a file (file, value): thoughts are decisions, tool calls discoveries."""
    kind = "struct<sessionId:string,messages:array<struct<thoughts:array<struct<subject:string,description:string>>,toolCalls:array<struct<name:string,args:map<string,string>,result:array<struct<functionResponse:struct<response:struct<output:string>>>>>>>>>"
    doc = files.select(F.from_json("value", kind).alias("d")).select(F.col("d.sessionId").alias("s"), F.posexplode("d.messages").alias("m_no", "m"))
    thoughts = doc.select("s", "m_no", F.posexplode("m.thoughts").alias("at", "t")).where(~F.lower("t.subject").isin(*stop_subjects))
    decisions = thoughts.select(*_event(F.col("s"), F.col("m_no") * 1000 + F.col("at"), "decision", F.col("t.subject"), F.col("t.description"), text.fact_key(F.col("t.subject"))))
    calls = doc.select("s", "m_no", F.posexplode("m.toolCalls").alias("at", "c")).withColumn("out", F.col("c.result")[0]["functionResponse"]["response"]["output"])
    args = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("c.args"))))
    calls = calls.where(F.col("out").isNotNull() & ~text.any_of(F.col("out"), secrets))
    found = calls.select(*_event(F.col("s"), F.col("m_no") * 1000 + 500 + F.col("at"), "discovery", F.col("c.name"), F.col("out"), text.fact_key(F.concat_ws(":", "c.name", args))))
    return decisions.unionByName(found)


def flow_logs(lines: DataFrame, least: int = 50) -> DataFrame:
    """SRC4-5: a `_meta` line, then logs tagged by `_log_type`; executors, terminals, searches and reports."""
    v = lines.withColumn("v", F.try_parse_json("line"))
    meta = v.where(F.col("line").contains('"_meta"')).select("stem", _get(F.col("v"), "$._meta.id").alias("flow"))
    rows = v.join(meta, "stem").withColumn("log", _get(F.col("v"), "$._log_type")).where("log is not null")
    col = lambda p: _get(F.col("v"), p)
    body = F.when(F.col("log") == "agentLogs", col("$.result")).when(F.col("log") == "terminalLogs", col("$.text")).when(F.col("log") == "searchLogs", col("$.result")).otherwise(col("$.message"))
    subject = F.when(F.col("log") == "agentLogs", col("$.task")).when(F.col("log") == "searchLogs", col("$.query")).otherwise(col("$.type"))
    ok = F.when(F.col("log") == "terminalLogs", (col("$.type") == "stdout") & (F.length(body) >= least)).when(F.col("log") == "messageLogs", col("$.type").isin("thoughts", "report", "done")).otherwise(body.isNotNull())
    kind = F.when(F.col("log") == "messageLogs", "decision").otherwise("discovery")
    picked = rows.where(ok).select(F.col("flow").alias("session"), F.col("line_no").cast("long").alias("seq"), kind.alias("type"), subject.alias("subject"), body.alias("body"))
    return picked.withColumn("fact_key", text.fact_key(F.concat_ws(":", "session", "body"))).select(*EVENT)


def simple_turns(lines: DataFrame, least: int = 20) -> DataFrame:
    """SRC6: one turn a line; answers of `least` characters and more."""
    v = lines.withColumn("v", F.try_parse_json("line"))
    q, r = _get(F.col("v"), "$.query"), _get(F.col("v"), "$.response")
    return v.where(F.length(r) >= least).select(*_event(F.col("stem"), F.col("line_no"), "discovery", q, r, text.fact_key(F.concat(F.lit("turn:"), F.substring(q, 1, 100)))))


def operator_query(raw: Column) -> Column:
    """SRC11: what stands in <user_query>, else the text without reminders; null if nothing is left."""
    inner = F.regexp_extract(raw, r"(?is)<user_query>(.*?)</user_query>", 1)
    rest = F.regexp_replace(raw, r"(?is)<[a-z_-]+reminder>.*?</[a-z_-]+reminder>", "")
    return F.nullif(F.trim(F.when(inner != "", inner).otherwise(rest)), F.lit(""))


def answered_turns(lines: DataFrame, role: str = "$.type", content: str = "$.content", user: str = "user", assistant: str = "assistant", tools: str | None = "$.tool_calls", skip: tuple[str, ...] = ()) -> DataFrame:
    """SRC7-8, WIN1: final answers with the last question before them. The paths make it fit the directory
    layout (defaults) and dated rollouts (`$.payload.role`, `$.payload.content`, no tools)."""
    v = lines.withColumn("v", F.try_parse_json("line"))
    body = blocks_text(F.try_variant_get("v", content, "variant"))
    rows = v.select("stem", "line_no", _get(F.col("v"), role).alias("role"), body.alias("body"), (F.try_variant_get("v", tools, "variant").isNotNull() if tools else F.lit(False)).alias("calls"))
    asked = operator_query(F.col("body"))
    for prefix in skip:
        asked = F.when(~F.col("body").startswith(prefix), asked)
    before = Window.partitionBy("stem").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("q", F.last(F.when(F.col("role") == user, asked), ignorenulls=True).over(before))
    answers = rows.where((F.col("role") == assistant) & ~F.col("calls") & F.col("q").isNotNull() & (F.trim("body") != ""))
    return answers.select(*_event(F.col("stem"), F.col("line_no"), "discovery", F.col("q"), F.col("body"), text.fact_key(F.concat_ws(":", "stem", "q"))))


def paired_lines(lines: DataFrame) -> DataFrame:
    """SRC24: USER: and ASSISTANT: lines; a pair is an answer right after a question."""
    role = F.when(F.col("line").startswith("USER:"), "user").when(F.col("line").startswith("ASSISTANT:"), "assistant")
    rows = lines.withColumn("role", role).where("role is not null").withColumn("body", F.trim(F.regexp_replace("line", "^(USER|ASSISTANT):", "")))
    w = Window.partitionBy("stem").orderBy("line_no")
    rows = rows.withColumn("q", F.when(F.lag("role").over(w) == "user", F.lag("body").over(w)))
    return rows.where("role = 'assistant' and q is not null").select("stem", "line_no", F.col("q").alias("query"), F.col("body").alias("response"))


def retire(events: DataFrame, processed: DataFrame, domains: dict) -> DataFrame:
    """SRC16: sessions that weren't processed, each event with its best domain."""
    return events.join(processed.select("session").distinct(), "session", "left_anti").withColumn("domain", text.best_domain(F.col("body"), domains))
