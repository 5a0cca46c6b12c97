"""Findings, a pool of tasks and syncs as state transitions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_claims(claims: DataFrame, as_of, alive: DataFrame | None = None) -> DataFrame:
    """CRD2, PRJ24, JN15: open claims with why they are void: `holder-dead` (known to be), `expired`, or null.

    alive: pid, alive; a pid that isn't listed is unknown, which isn't dead.
    """
    out = claims.where("released_at is null")
    out = out.join(alive, "pid", "left") if alive is not None else out.withColumn("alive", F.lit(None).cast("boolean"))
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    return out.withColumn("void", F.when(F.col("alive") == F.lit(False), "holder-dead").when((F.col("ttl_sec") > 0) & (age > F.col("ttl_sec")), "expired"))


def release(claims: DataFrame, resource: Column, as_of, reason: str) -> DataFrame:
    """CRD3, DEF18: whoever holds it."""
    hit = resource & F.col("released_at").isNull()
    return claims.withColumn("released_reason", F.when(hit, reason).otherwise(F.col("released_reason"))).withColumn("released_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("released_at")))


def take_first(tasks: DataFrame, taker: str, as_of) -> DataFrame:
    """CRD5: the oldest open task is taken; all others stay."""
    first = tasks.where("status = 'open'").agg(F.min(F.struct("created_at", "id")).alias("f")).select(F.col("f.id").alias("first"))  # one row
    out = tasks.join(F.broadcast(first), F.col("id") == F.col("first"), "left")
    mine = F.col("first").isNotNull()
    return out.withColumn("status", F.when(mine, "taken").otherwise(F.col("status"))).withColumn("taken_by", F.when(mine, taker).otherwise(F.col("taken_by"))).withColumn("taken_at", F.when(mine, F.lit(as_of).cast("timestamp")).otherwise(F.col("taken_at"))).drop("first")


def reopen_dead(tasks: DataFrame, alive: DataFrame) -> DataFrame:
    """CRD5: tasks taken by a process known to be dead are open again. alive: taken_pid, alive."""
    out = tasks.join(alive, "taken_pid", "left")
    dead = (F.col("status") == "taken") & (F.col("alive") == F.lit(False))
    # both at once: the new status says nothing about who was dead
    return out.withColumns({"status": F.when(dead, "open").otherwise(F.col("status")), "taken_by": F.when(~F.coalesce(dead, F.lit(False)), F.col("taken_by"))}).drop("alive")


def sync(local: DataFrame, remote: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """CRD8: what to pull and what to push: idempotent by id."""
    return remote.join(local.select(key), key, "left_anti"), local.where("synced_at is null").join(remote.select(key), key, "left_anti")


def handoff_tasks(claims: DataFrame, session: str, as_of) -> DataFrame:
    """CRD9: a session's open claims as pool tasks."""
    own = claims.where((F.col("session_id") == session) & F.col("released_at").isNull())
    return own.select(F.concat(F.lit("handoff:"), "resource").alias("id"), F.col("note").alias("title"), "resource", F.lit("open").alias("status"), F.lit(session).alias("created_by"), F.lit(as_of).cast("timestamp").alias("created_at"))


def roster(sessions: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CRD7, JN15: live sessions with their claims counted, and claims of sessions that are gone."""
    counts = claims.where("released_at is null").groupBy("session_id").agg(F.count("*").alias("claims"), F.sort_array(F.collect_list("resource")).alias("resources"))
    return sessions.join(counts, "session_id", "left").na.fill(0, ["claims"]), claims.where("released_at is null").join(sessions.select("session_id"), "session_id", "left_anti")


def review_findings(findings: DataFrame, prefix: str, status: str, reviewer: str, as_of) -> DataFrame:
    """CRD4: findings whose id begins so, if only one does; an ambiguous prefix changes nothing."""
    hits = findings.where(F.col("id").startswith(prefix)).agg(F.count("*").alias("hits"))  # one row
    hit = F.col("id").startswith(prefix) & (F.col("hits") == 1)
    out = findings.join(F.broadcast(hits))
    return out.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("reviewer", F.when(hit, reviewer).otherwise(F.col("reviewer"))).withColumn("updated_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))).drop("hits")


def latest_state(rows: DataFrame, key: str, at: str) -> DataFrame:
    """MUT7-8: the newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")
