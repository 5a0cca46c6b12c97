"""Validity intervals out of a log of changes, and as-of joins of many instants with many intervals.

An interval holds from its start up to, but not including, its end; a null start or end is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.writers import scratch

#: Pairs that a key may list for its comparison by the key alone.
PAIRS = 2**22
#: Levels of buckets: 2^LEVELS of the smallest width span all of time.
LEVELS = 22


def intervals(log: DataFrame, keys: list[str], at: str, adds: str) -> DataFrame:
    """KG5, KG8: keys, valid_from, valid_to of a log of changes; `adds`: whether a row opens the edge or ends it.

    Opening what is open and ending what isn't open change nothing. Changes of one instant: ends come first, so an edge that is ended
    and opened then goes on. A null instant opens from ever; an end without one is left out. Only changes of state are kept, so
    an edge's history is a window over its own changes; keys may be null.
    """
    rows = log.where(F.col(adds) | F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.col(adds).alias("_add"))
    # of one instant's changes the last decides, if there was one to end or open
    each = rows.groupBy(*keys, "_at").agg(F.bool_or("_add").alias("_add"))
    w = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first())
    turned = each.withColumn("_was", F.coalesce(F.lag("_add").over(w), F.lit(False))).where(F.col("_add") != F.col("_was"))
    out = turned.withColumn("valid_to", F.lead("_at").over(w)).where("_add")
    return out.select(*keys, F.col("_at").alias("valid_from"), "valid_to")


def merged(rows: DataFrame, keys: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """KG5: intervals of a key that overlap or touch, as one."""
    w = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first(), F.col(end).asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    open_, reach = F.bool_or(F.col(end).isNull()).over(before), F.max(end).over(before)
    apart = F.row_number().over(w).eqNullSafe(1) | (~F.coalesce(open_, F.lit(False)) & (F.col(start) > reach))
    parts = rows.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = F.when(F.bool_or(F.col(end).isNull()), None).otherwise(F.max(end))
    starts = F.when(F.bool_or(F.col(start).isNull()), None).otherwise(F.min(start))
    return parts.groupBy(*keys, "_part").agg(starts.alias(start), ends.alias(end)).drop("_part")


def _cover(first: Column, last: Column) -> Column:
    """The (level, bucket) nodes of a binary tree over buckets that cover first to last, each bucket once: two a level at most.

    A node of a level that lies within the span is taken if its parent doesn't: only the level's outermost ones can be.
    """

    def of(level: Column) -> Column:
        width = F.pow(F.lit(2), level).cast("long")
        low, high = F.ceil(first / width), F.floor((last + 1) / width) - 1
        nodes = F.array_distinct(F.array(low, high))

        def outermost(n: Column) -> Column:
            parent = F.floor(n / 2)
            return (low <= high) & ((level == LEVELS) | (parent * 2 * width < first) | ((parent * 2 + 2) * width - 1 > last))

        return F.transform(F.filter(nodes, outermost), lambda n: F.struct(level.alias("level"), n.cast("long").alias("bucket")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of))


def as_of(instants: DataFrame, rows: DataFrame, keys: list[str], at: str, start: str = "valid_from", end: str = "valid_to", width_seconds: int = 86_400, pairs: int = PAIRS) -> DataFrame:
    """KG10: instants with the intervals of equal keys that hold then: their columns side by side, no row for an instant without one.

    Both sides are written once, as their keys are counted first. A key with at most `pairs` pairs of an instant and an interval is joined by the
    key alone, so its rows go through one exchange. Of a key with more, time is cut into buckets, which a binary tree gathers. An interval stands at the few nodes that cover it, an instant at the nodes
    above it; each pair meets at exactly one. So a long or open interval costs a few rows and a hot key is spread over
    time, where a join on the key alone lists all its intervals for all its instants. Other columns of both sides are kept, and have to differ.
    """
    spark, path = instants.sparkSession, scratch(instants.sparkSession, "as-of")
    own = [f"_{k}" for k in keys]
    instants.where(F.col(at).isNotNull()).write.parquet(f"{path}/instants")
    rows.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < F.col(end))).withColumnsRenamed(dict(zip(keys, own, strict=True))).write.parquet(f"{path}/spans")
    asked, spans = spark.read.parquet(f"{path}/instants"), spark.read.parquet(f"{path}/spans")

    def same(left: list[str], right: list[str]) -> Column:
        met = F.lit(True)
        for a, b in zip(left, right, strict=True):
            met = met & F.col(a).eqNullSafe(F.col(b))
        return met

    held = same(keys, own) & (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    sizes = asked.groupBy(*keys).agg(F.count("*").alias("_n")).join(spans.groupBy(*own).agg(F.count("*").alias("_m")), same(keys, own))
    sizes.where(F.col("_n") * F.col("_m") > pairs).select(F.struct(*keys).alias("_hot")).write.parquet(f"{path}/hot")
    hot = spark.read.parquet(f"{path}/hot")
    if hot.isEmpty():
        return asked.join(spans, held).drop(*own)
    names = [f"_hot.{k}" for k in keys]
    few = asked.join(hot, same(keys, names), "left_anti").join(spans.join(hot, same(own, names), "left_anti"), held).drop(*own)
    many = _by_time(asked.join(hot, same(keys, names), "left_semi"), spans.join(hot, same(own, names), "left_semi"), held, at, start, end, width_seconds)
    return few.unionByName(many.drop(*own))


def _by_time(asked: DataFrame, spans: DataFrame, held: Column, at: str, start: str, end: str, width_seconds: int) -> DataFrame:
    """Instants and intervals that meet at the nodes of the tree over time, where `held`."""
    least, most = F.lit(0).cast("long"), F.lit(2**LEVELS - 1).cast("long")

    def place(c: str) -> Column:
        bucket = F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width_seconds) + 2 ** (LEVELS - 1)
        return F.when(F.col(c).isNotNull(), F.greatest(least, F.least(most, bucket)).cast("long"))  # greatest and least pass over nulls

    nodes = spans.withColumn("_node", F.explode(_cover(F.coalesce(place(start), least), F.coalesce(place(end), most))))
    above = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.alias("level"), F.floor(F.col("_place") / F.pow(F.lit(2), level)).cast("long").alias("bucket")))
    asked = asked.withColumn("_place", place(at)).withColumn("_above", F.explode(above)).drop("_place")
    # levels that no interval stands at need no instants: as few as levels
    levels = nodes.select(F.col("_node.level").alias("_level")).distinct()
    asked = asked.join(levels, F.col("_above.level") == F.col("_level"), "left_semi")
    return asked.join(nodes, (F.col("_above") == F.col("_node")) & held).drop("_above", "_node")
