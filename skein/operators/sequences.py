"""Order-dependent operators: carries, folds, runs and windows over a session's rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scoring


def carry_forward(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """WIN1, JN21: the last value that isn't null before each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def turns(rows: DataFrame, session: str, order: list[str], request: Column, fill: Column) -> DataFrame:
    """WIN6-8: turn number (a new one where the request changes), floor (first fill), current and working fill."""
    w = Window.partitionBy(session).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_r", request).withColumn("_f", F.when(fill > 0, fill))
    out = out.withColumn("turn", F.sum(F.when(F.col("_r").eqNullSafe(F.lag("_r").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).over(so_far))
    out = out.withColumn("total", F.coalesce(F.last("_f", ignorenulls=True).over(so_far), F.lit(0))).withColumn("floor", F.coalesce(F.first("_f", ignorenulls=True).over(so_far), F.lit(0)))
    return out.withColumn("working", F.greatest(F.lit(0), F.col("total") - F.col("floor"))).drop("_r", "_f")


def error_runs(rows: DataFrame, session: str, order: list[str], error: Column, target: Column) -> DataFrame:
    """WIN9: length so far of a run of errors on one target; any success, or another target, ends it. An empty target never extends one."""
    w = Window.partitionBy(session).orderBy(*order)
    out = rows.withColumn("_e", error).withColumn("_t", target)
    broken = F.when(F.col("_e") & F.lag("_e").over(w) & (F.col("_t") != "") & (F.col("_t") == F.lag("_t").over(w)), 0).otherwise(1)
    out = out.withColumn("_run", F.sum(broken).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("run", F.row_number().over(Window.partitionBy(session, "_run").orderBy(*order)).cast("long"))
    return out.where("_e").withColumn("event", F.when(F.col("run") >= 2, "tool_thrash").otherwise("tool_error")).drop("_e", "_t", "_run")


def reverts(edits: DataFrame, keys: list[str], order: str, old: str, new: str) -> DataFrame:
    """WIN10: edits that undo an earlier edit of the same target: the first inverse's place decides."""
    firsts = edits.groupBy(*keys, F.col(old).alias("_o"), F.col(new).alias("_n")).agg(F.min(order).alias("_at")).withColumnsRenamed({k: f"_{k}" for k in keys})
    match = (F.col(old) == F.col("_n")) & (F.col(new) == F.col("_o")) & (F.col(order) > F.col("_at"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return edits.join(firsts, match, "left_semi")


def band_report(turn_rows: DataFrame, events: DataFrame, bands: DataFrame) -> DataFrame:
    """AGG14, AGG16: turns and events a band, events per 1000 turns, and how that compares with all bands together."""
    t = turn_rows.groupBy(scoring.band(F.col("working")).alias("band")).agg(F.count("*").alias("turns"))
    e = events.groupBy(scoring.band(F.col("working")).alias("band")).agg(F.count("*").alias("events"))
    joined = bands.join(t, "band", "left").join(e, "band", "left").na.fill(0, ["turns", "events"])  # five rows
    total = joined.agg((F.sum("events") / F.sum("turns") * 1000).alias("overall"))
    rate = F.when(F.col("turns") > 0, F.col("events") / F.col("turns") * 1000).otherwise(0.0)
    out = joined.join(F.broadcast(total)).withColumn("rate", rate)
    flag = F.when(F.col("turns") == 0, "").when(F.col("rate") > 1.5 * F.col("overall"), "elevated").when(F.col("rate") < 0.5 * F.col("overall"), "quiet").otherwise("")
    return out.withColumn("flag", flag)


def sessions(rows: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """STR7: sessions parted by a gap, numbered in order."""
    w = Window.partitionBy(key).orderBy(ts)
    new = F.when(scoring.micros(F.col(ts)) - scoring.micros(F.lag(ts).over(w)) <= gap_seconds * 1_000_000, 0).otherwise(1)
    out = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def replay_leases(claims: DataFrame, ttl_seconds: int) -> DataFrame:
    """CRD1-2 offline: claims (resource, holder, at, id) in order; a claim wins if the resource is free, expired or its holder's own.

    Returns every claim with whether it was won, and the holder after it. A task reads its resources' claims in order and
    keeps only the lease that stands, so a resource's history may be of any length.
    """
    rows = claims.select("resource", F.unix_seconds(F.col("at").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"), F.col("holder").cast("long").alias("holder"))
    ordered = rows.repartition("resource").sortWithinPartitions("resource", "at", "id", "holder")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resource, holder, since, begun = None, None, 0, False
        for b in batches:
            out = []
            for res, at, claim, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or res != resource:
                    resource, holder, since, begun = res, None, 0, True
                renewed = holder == own
                won = holder is None or renewed or at - since > ttl_seconds
                if won:
                    holder, since = own, at
                out.append((res, claim, won, holder, renewed))
            names = ("resource", "id", "won", "holder", "renewed")
            kinds = (b.schema.field(0).type, pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=list(names))

    kind = dict(rows.dtypes)["resource"]
    return ordered.mapInArrow(replay, f"resource {kind}, id long, won boolean, holder long, renewed boolean")


def deltas(events: DataFrame, cursors: DataFrame, key: str, ts: str, id_col: str, most: int = 6) -> DataFrame:
    """CRD6, JN26, STR3: what each reader hasn't seen, `most` rows at a time; the new cursor stops at the last row shown if more are left."""
    unseen = events.join(cursors, key).where(F.col(ts) > F.col("cursor"))
    w = Window.partitionBy(key).orderBy(ts, id_col)
    ranked = unseen.withColumn("place", F.row_number().over(w)).withColumn("left", F.count("*").over(Window.partitionBy(key)))
    return ranked.where(F.col("place") <= most).groupBy(key).agg(F.count("*").alias("shown"), F.max(ts).alias("new_cursor"), (F.first("left") > most).alias("overflow"))
