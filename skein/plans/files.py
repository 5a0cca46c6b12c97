"""Writers and readers of files: the driver's tables are written to a scratch folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import vocab
from skein.functions import text
from skein.sources import folders, transcripts, writers
from skein.streaming import folds

from .registry import registrar
from .texts import _redact_sql

QUERIES: dict = {}
query = registrar(QUERIES)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE (o_orderkey % 10) / 10 >= 0.55 GROUP BY 1")
def corpus_partitions(orders):
    """SNK3, DTM4: entries over the score floor, written in month partitions and read back by partition."""
    path = writers.scratch(orders.sparkSession, "corpus")
    writers.write_corpus(orders.select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 10 / 10).alias("score")), path, "o_orderdate")
    # months are names, not dates
    back = orders.sparkSession.read.schema("o_orderkey long, o_orderdate timestamp, score double, month string").parquet(path)
    return back.groupBy("month").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""
SELECT lang AS domain, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), 'token') GROUP BY lang""")
def delta_files(documents):
    """SNK4: lines with a keyword, appended to a folder a domain."""
    path = writers.scratch(documents.sparkSession, "deltas")
    lines = documents.select(F.col("lang").alias("domain"), F.explode(F.split("text", "\n")).alias("line")).where(F.lower("line").contains("token"))
    writers.write_deltas(lines, path)
    back = writers.read_deltas(documents.sparkSession, path)
    return back.groupBy("domain").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


_ASKED = """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q, text, role FROM conversations"""


@query(f"SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, md5(trim(q)) AS subject_md5, md5(text) AS body_md5 FROM ({_ASKED}) WHERE role = 'assistant' AND q IS NOT NULL AND trim(q) <> '' AND trim(text) <> ''")
def transcript_files(conversations):
    """SRC1, SRC7, SRC9: conversations as transcripts, found, read line by line and parsed."""
    path = writers.scratch(conversations.sparkSession, "sessions")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("content"), "conv_id", "turn"))
    conversations.select((F.col("conv_id") % 8).alias("part"), "conv_id", "turn", line.alias("value")).repartition("part").sortWithinPartitions("conv_id", "turn").select("part", "value").write.partitionBy("part").option("compression", "none").text(path)
    lines = transcripts.read_lines(conversations.sparkSession, path, "*.txt")
    told = F.get_json_object("line", "$.conv_id")
    lines = lines.withColumn("stem", told).withColumn("line_no", F.get_json_object("line", "$.turn").cast("int"))
    answers = transcripts.answered_turns(lines)
    return answers.select("session", "seq", F.md5(F.col("subject").cast("binary")).alias("subject_md5"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS entries, CAST(sum(CASE WHEN role <> 'system' AND length(text) > 400 THEN 400 + length('...[stripped  bytes]...') + 4 + length(CAST(length(text) - 400 AS VARCHAR)) ELSE length(text) END) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def archived_entries(conversations):
    """SNK5, TXT11-12: sessions stripped to 400 characters a block, summaries whole, written by session and read back."""
    path = writers.scratch(conversations.sparkSession, "archive")
    block = F.struct(F.lit("text").alias("type"), "text", F.lit(False).alias("is_error"))
    entries = conversations.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), (F.col("role") == "system").alias("is_summary"), F.array(block).alias("blocks"))
    writers.archive(entries, path, 400)
    back = conversations.sparkSession.read.schema("session string, seq long, is_summary boolean, blocks array<struct<type:string,text:string,is_error:boolean>>").json(path)
    return back.groupBy("session").agg(F.count("*").alias("entries"), F.sum(F.length(F.col("blocks")[0]["text"])).alias("chars"))


@query("""
SELECT lang AS name, doc_id % 16 AS part, sha256(string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents GROUP BY ALL""")
def tree_fingerprints(documents):
    """SRC29, PRJ27: all texts as the files of a tree, some of each language in one, by their digests; a folder that is left out holds copies."""
    spark = documents.sparkSession
    path = writers.scratch(spark, "tree")
    rows = documents.select("lang", (F.col("doc_id") % 16).alias("part"), "doc_id", F.regexp_replace("text", "\n", " ").alias("value"))
    for folder in ("kept", ".git"):
        # a file a folder: a partition has all of it, in order
        dealt = rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "doc_id")
        dealt.select("lang", "part", "value").write.partitionBy("lang", "part").option("maxRecordsPerFile", 0).text(f"{path}/{folder}")
    found = folders.fingerprints(spark, path).where(F.col("path").contains("/part-"))
    return found.select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("name"), F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long").alias("part"), "digest")


@query(f"""
SELECT event_type, count(*) AS rows, count(DISTINCT line) AS lines FROM (SELECT event_type, {_redact_sql("'token: ' || event_type || 'abcdef ' || (event_id % 3)")} AS line FROM events) GROUP BY event_type""")
def event_log(events):
    """STR8, MUT20: events streamed to an append-only log, masked before they are stored, twice with one checkpoint: nothing is stored again."""
    spark = events.sparkSession
    path = writers.scratch(spark, "log")
    line = F.concat(F.lit("token: "), "event_type", F.lit("abcdef "), (F.col("event_id") % 3).cast("string"))
    events.select("event_id", "event_type", line.alias("line")).write.parquet(f"{path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("event_id long, event_type string, line string").parquet(f"{path}/in")
        folds.append_log(stream, f"{path}/out", f"{path}/checkpoint", lambda df: df.withColumn("line", text.redact(F.col("line"), vocab.REDACT_MOST))).awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("line").alias("lines"))
