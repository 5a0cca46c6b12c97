"""What services answer, as tables: outcomes, flows with their logs, recorded turns, observed tool calls, probed landscapes.

Requests are the caller's: each function takes the answers (JSON text) that a driver fetched, a bounded list, or lines of a
log. Nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUTCOME = "struct<key:string,scope:string,model:string,status:string,result_status:string,success:boolean,summary:string,cost_usd:double,verdicts:array<string>,at:string>"
_FLOW = "struct<id:string,status:string,title:string,createdAt:string>"


def outcomes(answers: DataFrame) -> DataFrame:
    """SRC26: outcomes of tasks in answers (answer); rows without a key are left out, of a key in several answers the last stays (by at).

    The result is a delta for facts.upsert.
    """
    rows = answers.select(F.explode(F.from_json("answer", f"struct<recent:array<{_OUTCOME}>>").getField("recent")).alias("r")).select("r.*")
    rows = rows.withColumn("key", F.trim("key")).where("key != ''")
    last = rows.groupBy("key").agg(F.max_by(F.struct("scope", "model", "status", "result_status", "success", "summary", "cost_usd", "verdicts"), F.coalesce("at", F.lit(""))).alias("r"), F.max("at").alias("at"))
    return last.select("key", "r.scope", "r.model", "r.status", "r.result_status", F.coalesce("r.success", F.lit(False)).alias("success"), F.substring(F.coalesce("r.summary", F.lit("")), 1, 500).alias("summary"), F.coalesce("r.cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("r.verdicts", F.array().cast("array<string>")).alias("verdicts"), "at")


def finished_flows(answer: DataFrame, flow: str | None = None) -> DataFrame:
    """SRC27: flow ids to fetch: the one asked for, or all that are finished (answer: the service's list of flows)."""
    rows = answer.select(F.explode(F.from_json("answer", f"struct<data:struct<flows:array<{_FLOW}>>>").getField("data").getField("flows")).alias("f")).select("f.*")
    return rows.where(F.col("id") == flow) if flow else rows.where("status = 'finished'")


def flow_lines(flows: DataFrame, logs: DataFrame) -> DataFrame:
    """SRC27: flows and their logs as lines for transcripts.flow_logs (stem, line_no, line): a `_meta` line, then each log tagged by its kind.

    flows: of finished_flows; logs: id, answer.
    """
    kinds = ("agentLogs", "terminalLogs", "searchLogs", "messageLogs")
    stem = F.concat(F.lit("flow-"), "id")
    meta = flows.select(stem.alias("stem"), F.lit(0).alias("kind"), F.lit(0).alias("at"), F.to_json(F.struct(F.struct("id", "status", "title", "createdAt").alias("_meta"))).alias("line"))
    parsed = logs.select("id", F.from_json("answer", "struct<data:map<string,array<map<string,string>>>>").getField("data").alias("d"))
    out = meta
    for k, kind in enumerate(kinds, 1):
        each = parsed.select("id", F.posexplode(F.col("d")[kind]).alias("at", "m"))
        tagged = F.to_json(F.map_concat("m", F.create_map(F.lit("_log_type"), F.lit(kind))))
        out = out.unionByName(each.select(stem.alias("stem"), F.lit(k).alias("kind"), "at", tagged.alias("line")))
    from pyspark.sql import Window

    return out.select("stem", (F.row_number().over(Window.partitionBy("stem").orderBy("kind", "at")) - 1).alias("line_no"), "line")


def recorded(turns: DataFrame, model: str, session_type: str) -> DataFrame:
    """SRC25: turns (stem, line_no, ts, query, answer, latency_ms) as lines for transcripts.simple_turns; a failed answer gives none.

    answer: the completion as the endpoint sent it; without a usage its words are counted.
    """
    kind = "struct<choices:array<struct<message:struct<content:string>>>,usage:struct<completion_tokens:bigint>>"
    rows = turns.withColumn("a", F.from_json("answer", kind)).withColumn("response", F.try_element_at("a.choices", F.lit(1))["message"]["content"]).where("response is not null")
    words = F.size(F.filter(F.split(F.trim("response"), r"\s+"), lambda w: w != ""))
    tokens = F.coalesce("a.usage.completion_tokens", words.cast("long"))
    line = F.to_json(F.struct("ts", "query", "response", F.lit(model).alias("model"), tokens.alias("tokens"), "latency_ms", F.lit(session_type).alias("session_type")))
    return rows.select("stem", "line_no", line.alias("line"))


def observations(calls: DataFrame) -> DataFrame:
    """SRC32: a hook's input (ts, event, payload, remote) as log rows: tool and session, `unknown` where they aren't told; the project is 12 digits of its remote's hash."""
    told = lambda path: F.coalesce(F.get_json_object("payload", path), F.lit("unknown"))
    project = F.when(F.coalesce("remote", F.lit("")) == "", "no-git").otherwise(F.substring(F.sha2(F.concat("remote", F.lit("\n")).cast("binary"), 256), 1, 12))
    return calls.select("ts", "event", told("$.tool_name").alias("tool"), told("$.session_id").alias("session"), project.alias("project"))


def landscapes(domains: DataFrame, cache: DataFrame, probes: DataFrame, fallback: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """SRC30, STR5: what is known of each domain: a fresh cache row, else a probe's answer, else the fallback's; and which of them it is.

    domains: domain; cache: domain, ts, body; probes, fallback: domain, body.
    """
    from skein.operators.curation import cached

    fresh = cached(cache, as_of, seconds).groupBy("domain").agg(F.max_by("body", "ts").alias("c"))
    out = domains.join(fresh, "domain", "left").join(probes.select("domain", F.col("body").alias("p")), "domain", "left").join(fallback.select("domain", F.col("body").alias("f")), "domain", "left")
    source = F.when(F.col("c").isNotNull(), "cache").when(F.col("p").isNotNull(), "probe").when(F.col("f").isNotNull(), "fallback")
    return out.select("domain", F.coalesce("c", "p", "f").alias("body"), source.alias("source"))
