"""Small state changes of the fact store: reconciled sources, expiry, conflicts to look at, counts for a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(sources: DataFrame, facts: DataFrame, promote: bool) -> tuple[DataFrame, DataFrame]:
    """MUT12: what becomes of each source's curated facts (source, position, text): `exists`, `inserted` or `would-insert`; and the rows to insert.

    facts: fact_key, tombstoned_at. A key that only a tombstoned fact has may be inserted again.
    """
    keyed = sources.withColumn("fact_key", F.concat(F.lit("reconcile:"), "source", F.lit(":"), F.col("position").cast("string")))
    live = facts.where("tombstoned_at is null").select(F.col("fact_key").alias("k")).distinct()
    told = keyed.join(live, F.col("fact_key") == F.col("k"), "left").withColumn("state", F.when(F.col("k").isNotNull(), "exists").otherwise("inserted" if promote else "would-insert")).drop("k")
    new = told.where("state = 'inserted'").select("fact_key", F.lit("general").alias("domain"), F.col("text").alias("fact_text"), F.concat(F.lit("source-registry:"), "source").alias("provenance"), F.lit(0.5).alias("score"), F.lit("operational").alias("fact_type"))
    return told.select("source", "position", "fact_key", "state"), new


def expire(facts: DataFrame, as_of: Column, days: float | None) -> DataFrame:
    """STR5: live facts not seen for `days` are tombstoned, to be restored at will; without `days` nothing is."""
    if days is None:
        return facts.withColumn("expired", F.lit(False))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 86_400_000_000.0
    old = F.coalesce((F.col("fact_type") == "live") & F.col("tombstoned_at").isNull() & (age > days), F.lit(False))
    return facts.withColumn("expired", old).withColumn("tombstoned_at", F.when(F.col("expired"), as_of.cast("timestamp")).otherwise(F.col("tombstoned_at")))


def cached(cache: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """STR5: rows of a cache (key, ts, ...) that are still fresh."""
    return cache.where(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) < seconds)


def conflicts(facts: DataFrame) -> DataFrame:
    """JN19: each pending fact with the text it is in conflict with, as a reviewer sees it (120 characters); null where that fact is gone."""
    other = facts.select(F.col("id").alias("_id"), F.substring("text", 1, 120).alias("conflict_text"))
    return facts.where("review_state = 'pending'").join(other, F.col("conflict_with") == F.col("_id"), "left").select("id", "conflict_with", "conflict_text")


def contested(facts: DataFrame, key: str, most: int = 5) -> DataFrame:
    """SRT9: the keys that most live facts share."""
    counts = facts.where("tombstoned_at is null").groupBy(key).agg(F.count("*").alias("count")).where("count > 1")
    return counts.orderBy(F.desc("count"), key).limit(most)


def evidence(linked: DataFrame, matched: DataFrame, most: int) -> DataFrame:
    """SET7: facts for an answer (qid, id, score): linked ones first, then matched ones that aren't among them, up to `most` a question."""
    both = linked.select("qid", "id", "score", F.lit(0).alias("tier")).unionByName(matched.select("qid", "id", "score", F.lit(1).alias("tier")))
    once = both.groupBy("qid", "id").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("b"))
    w = Window.partitionBy("qid").orderBy("b.tier", "b.s", "id")
    return once.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("qid", "id", F.col("b.tier").alias("tier"), "place")


def status_counts(findings: DataFrame, tasks: DataFrame, sessions: DataFrame) -> DataFrame:
    """AGG26: one row: open findings, open and taken tasks, sessions."""
    f = findings.agg(F.count_if(F.col("status").isin("open", "reviewing")).alias("findings_open"))
    t = tasks.agg(F.count_if(F.col("status") == "open").alias("pool_open"), F.count_if(F.col("status") == "taken").alias("pool_taken"))
    return f.join(F.broadcast(t)).join(F.broadcast(sessions.agg(F.count("*").alias("sessions"))))


def harness_counts(sessions: DataFrame) -> DataFrame:
    """AGG26: live sessions by harness."""
    return sessions.groupBy("harness").agg(F.count("*").alias("sessions"))


def ancestry(processes: DataFrame, start: DataFrame, most: int = 24) -> DataFrame:
    """CRD10: pid, depth of a process and those above it, up to the first one (pid 1 isn't listed) and `most` of them.

    processes: pid, parent; start: pid. One host's table is small, and the chain has `most` steps at most.
    """
    chain = start.select("pid", F.lit(0).alias("depth"))
    level = chain
    parents = processes.select(F.col("pid").alias("p"), "parent")
    for _ in range(most - 1):
        level = level.join(parents, F.col("pid") == F.col("p")).where("parent > 1").select(F.col("parent").alias("pid"), (F.col("depth") + 1).alias("depth"))
        if level.isEmpty():
            break
        chain = chain.unionByName(level)
    return chain.groupBy("pid").agg(F.min("depth").alias("depth"))


def own_session(registry: DataFrame, chain: DataFrame) -> DataFrame:
    """CRD10: the registered session nearest above a process; living ones first. registry: session, pid, alive."""
    hits = registry.join(chain, "pid")
    order = [F.when(F.col("alive"), 0).otherwise(1), "depth", "session"]
    return hits.orderBy(*order).limit(1).select("session", "pid")


def highlights(facts: DataFrame, per_domain: int, least: float = 0.15) -> DataFrame:
    """SRT4, SNK6: the best facts (id, domain, score, confirmations) of each domain among the first 10 * per_domain by score * (1 + confirmations / 10)."""
    worth = F.col("score") * (1.0 + 0.1 * F.coalesce("confirmations", F.lit(0)))
    first = facts.where(F.col("score") > least).withColumn("worth", F.round(worth, 6)).orderBy(F.desc("worth"), "id").limit(10 * per_domain)  # a report
    return first.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("worth"), "id")).cast("long")).where(F.col("place") <= per_domain)
