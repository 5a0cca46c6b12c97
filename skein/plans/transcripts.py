"""Conversations as transcripts of six formats: written as files of lines, read in byte ranges by the source, parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources import datasource, transcripts, writers

from .files import _ASKED
from .registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

#: Bytes of a range: small, so that each file is read in several.
RANGE = "65536"


def formatted(conversations: DataFrame) -> DataFrame:
    """fmt, conv_id, turn, value: a sixth of the conversations in each format, a line a turn; flows begin with a line about themselves."""
    session, turn, role, text = F.col("conv_id").cast("string").alias("sessionId"), F.col("turn"), F.col("role"), F.col("text")
    message = F.struct(text.alias("content")).alias("message")
    thought = F.array(F.struct(F.array(F.struct(role.alias("subject"), text.alias("description"))).alias("thoughts"))).alias("messages")
    report = F.struct(session, turn, F.lit("messageLogs").alias("_log_type"), F.lit("report").alias("type"), text.alias("message"))
    terminal = F.struct(session, turn, F.lit("terminalLogs").alias("_log_type"), F.lit("stdout").alias("type"), text.alias("text"))
    payload = F.struct(role.alias("role"), F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text"))).alias("content")).alias("payload")
    kinds = [
        F.to_json(F.struct(session, turn, F.lit(True).alias("isCompactSummary"), message)),
        F.to_json(F.struct(session, turn, thought)),
        F.when(role == "assistant", F.to_json(terminal)).otherwise(F.to_json(report)),
        F.to_json(F.struct(session, turn, role.alias("query"), text.alias("response"))),
        F.to_json(F.struct(session, turn, role.alias("type"), text.alias("content"))),
        F.to_json(F.struct(session, turn, payload)),
    ]
    fmt = (F.col("conv_id") % 6).alias("fmt")
    rows = conversations.select(fmt, "conv_id", "turn", F.element_at(F.array(*kinds), (F.col("conv_id") % 6 + 1).cast("int")).alias("value"))
    flows = conversations.where("conv_id % 6 = 2").select("conv_id").distinct()
    meta = F.to_json(F.struct(session, F.lit(-1).alias("turn"), F.struct(F.concat(F.lit("flow-"), session).alias("id")).alias("_meta")))
    return rows.unionByName(flows.select(fmt, "conv_id", F.lit(-1).cast(dict(conversations.dtypes)["turn"]).alias("turn"), meta.alias("value")))


def _lines(spark, path: str, fmt: int) -> DataFrame:
    raw = spark.read.format("transcripts").option("path", f"{path}/fmt={fmt}").option("split_bytes", RANGE).load()
    return raw.withColumn("stem", F.get_json_object("line", "$.sessionId")).withColumn("line_no", F.get_json_object("line", "$.turn").cast("int"))


@query(f"""
WITH c AS (SELECT *, CAST(conv_id AS VARCHAR) AS s, length(text) AS n FROM conversations), a AS (SELECT conv_id, turn, text FROM ({_ASKED}) WHERE role = 'assistant' AND q IS NOT NULL AND trim(q) <> '' AND trim(text) <> '')
SELECT fmt, session, CAST(seq AS BIGINT) AS seq, type, md5(body) AS body_md5 FROM (
SELECT 0 AS fmt, s AS session, turn * 1000 AS seq, 'decision' AS type, text AS body FROM c WHERE conv_id % 6 = 0 AND n > 100
UNION ALL SELECT 1, s, 0, 'decision', text FROM c WHERE conv_id % 6 = 1
UNION ALL SELECT 2, 'flow-' || s, turn, CASE WHEN role = 'assistant' THEN 'discovery' ELSE 'decision' END, text FROM c WHERE conv_id % 6 = 2 AND (role <> 'assistant' OR n >= 50)
UNION ALL SELECT 3, s, turn, 'discovery', text FROM c WHERE conv_id % 6 = 3 AND n >= 20
UNION ALL SELECT conv_id % 6, CAST(conv_id AS VARCHAR), turn, 'discovery', text FROM a WHERE conv_id % 6 >= 4)""")
def transcript_formats(conversations):
    """SRC1-8, SRC12: events of six formats out of files that are read in several ranges each."""
    spark = conversations.sparkSession
    datasource.register(spark)
    path = writers.scratch(spark, "formats")
    formatted(conversations).repartition("fmt").sortWithinPartitions("fmt", "conv_id", "turn").select("fmt", "value").write.partitionBy("fmt").option("compression", "none").text(path)
    if conversations.isEmpty():  # no folders to read
        for fmt in range(6):
            spark.createDataFrame([], "value string").write.text(f"{path}/fmt={fmt}")
    of = lambda fmt: _lines(spark, path, fmt)
    parsed = [
        transcripts.compact_summaries(of(0)),
        transcripts.thought_documents(of(1).select(F.col("line").alias("value"))),
        transcripts.flow_logs(of(2)),
        transcripts.simple_turns(of(3)),
        transcripts.answered_turns(of(4)),
        transcripts.answered_turns(of(5), role="$.payload.role", content="$.payload.content", tools=None),
    ]
    out = None
    for fmt, events in enumerate(parsed):
        own = events.select(F.lit(fmt).cast("long").alias("fmt"), "session", "seq", "type", F.md5(F.col("body").cast("binary")).alias("body_md5"))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT role, count(*) AS lines, count(DISTINCT conv_id) AS sessions, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def transcript_stream(conversations):
    """SRC1, STR4: lines of transcripts as a stream, in two runs from one checkpoint; what is read once isn't read again."""
    spark = conversations.sparkSession
    datasource.register(spark)
    path = writers.scratch(spark, "lines")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    for half in (0, 1):
        conversations.where(F.col("conv_id") % 2 == half).select(line.alias("value")).write.mode("append").option("compression", "none").text(f"{path}/in")
        stream = spark.readStream.format("transcripts").option("path", f"{path}/in").option("split_bytes", RANGE).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    back = spark.read.schema(datasource.SCHEMA).parquet(f"{path}/out")
    told = back.select(F.from_json("line", "conv_id long, turn int, role string, text string").alias("t")).select("t.*")
    return told.groupBy("role").agg(F.count("*").alias("lines"), F.count_distinct("conv_id").alias("sessions"), F.sum(F.length("text")).alias("chars"))
