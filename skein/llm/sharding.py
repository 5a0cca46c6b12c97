"""Operator 10 [native], sharding: minimax contiguous partition of ordered atomic groups.

Equal texts form a group that is never split; groups are ordered by the hash of their text. The
smallest capacity that a greedy filling of the groups in this order can meet is found by binary
search, exactly, without a list of all groups on the driver:
1. The driver gets the sums of at most 2^bits granules of neighbouring hashes. Filling them as atoms
   gives an upper bound of the capacity, filling them as if they could be cut anywhere a lower one.
2. Only granules in which a cut may fall for a capacity between the bounds are split by `more`
   further bits of the hash, until the bounds meet. A granule of one group is an atom.
Cuts are hash values, so every row finds its shard by comparing its hash with them.

Slots need no sort of a whole shard: rows of a granule are numbered within salts of about
SALT_ROWS rows, and the counts before are added.

Defined results: a null text counts 0 bytes and has the crc of an empty text; rows with a null
or repeated id are placed like any other row; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a salt that are numbered together, at least; the salts of all rows together at most.
SALT_ROWS, SALTS = 256, 1 << 16


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which filling the sizes in order, greedily, takes at most `shards` shards."""
    low, high = max(max(sizes, default=0), -(-sum(sizes) // shards)), sum(sizes)

    def needs(capacity: int) -> int:
        n, room = 1, capacity
        for x in sizes:
            if x > room:
                n, room = n + 1, capacity
            room -= x
        return n

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needs(middle) <= shards else (middle + 1, high)
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, in order."""
    capacity, out, shard, room = smallest_capacity(sizes, shards), [], 0, None
    room = capacity
    for x in sizes:
        if x > room:
            shard, room = shard + 1, capacity
        room -= x
        out.append(shard)
    return out


class Item(NamedTuple):
    first: int  # smallest hash of its rows
    size: int
    atom: bool  # one group
    bits: int  # that its key has
    key: int


def _reach(ends: list[int], items: list[Item], start: int, capacity: int, divisible: bool) -> int:
    """The farthest place (bytes from the first) that a shard from `start` may end at."""
    goal = start + capacity
    k = bisect.bisect_right(ends, goal)
    if k == len(ends):
        return ends[-1]
    whole = ends[k - 1] if k else 0
    return goal if divisible and not items[k].atom else max(start, whole)


def _places(ends: list[int], items: list[Item], shards: int, capacity: int, divisible: bool) -> list[int]:
    at, out = 0, []
    for _ in range(shards):
        at = _reach(ends, items, at, capacity, divisible)
        out.append(at)
    return out


def _least(ends: list[int], items: list[Item], shards: int, divisible: bool) -> int:
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _places(ends, items, shards, middle, divisible)[-1] == ends[-1] else (middle + 1, high)
    return low


def exact_cuts(items: list[Item], shards: int, finer: Callable[[list[Item]], list[Item]]) -> tuple[int, list[int]]:
    """The smallest capacity over groups, and the first hash of every shard but the first.

    finer: what given items are made of, by more bits of the hash.
    """
    items = sorted(items)
    if not items:
        return 0, []
    while True:
        ends, total = [], 0
        for x in items:
            total += x.size
            ends.append(total)
        low, high = (_least(ends, items, shards, d) for d in (True, False))
        if low == high:
            break
        # a true cut lies between where atoms stop at the lower bound and where divisible ones reach at the upper
        split = set()
        for a, z in zip(_places(ends, items, shards, low, False), _places(ends, items, shards, high, True), strict=True):
            k = bisect.bisect_right(ends, a)
            while k < len(items) and ends[k] - items[k].size < z + 1:
                if not items[k].atom:
                    split.add(k)
                k += 1
        items = sorted([x for k, x in enumerate(items) if k not in split] + finer([items[k] for k in sorted(split)]))
    starts, at = [], 0
    for place in _places(ends, items, shards, low, False):
        if place < ends[-1] and place > at:
            starts.append(items[bisect.bisect_right(ends, place)].first)
        at = place
    return low, starts


def shard_documents(df: DataFrame, shards: int = 24, bits: int = 16, more: int = 8, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; law `bytes`."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialize(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )

    def items(of: DataFrame, bits: int) -> list[Item]:
        sums = of.groupBy(F.shiftright("text_hash", 64 - bits).alias("key")).agg(F.sum("size").alias("bytes"), F.min("text_hash").alias("first"), F.max("text_hash").alias("last"))
        return [Item(r["first"], r["bytes"], r["first"] == r["last"], bits, r["key"]) for r in sums.collect()]

    def finer(coarse: list[Item]) -> list[Item]:
        out = []
        for own in sorted({x.bits for x in coarse}):
            keys = spark.createDataFrame([(x.key,) for x in coarse if x.bits == own], "coarse long")
            inside = rows.join(F.broadcast(keys), F.shiftright("text_hash", 64 - own) == F.col("coarse"), "left_semi")  # keys: granules around the cuts
            out += items(inside, min(64, own + more))
        return out

    _, starts = exact_cuts(items(rows, bits), shards, finer)  # one row a granule: 2^bits at most
    shard = sum((F.when(F.col("text_hash") >= x, 1).otherwise(0) for x in starts), F.lit(0)).cast("int")
    rows = rows.withColumn("shard", shard).withColumn("granule", F.shiftright("text_hash", 64 - bits))
    counted = sorted((r["shard"], r["granule"], r["n"]) for r in rows.groupBy("shard", "granule").agg(F.count("*").alias("n")).collect())  # 2^bits rows and a few
    most = max(SALT_ROWS, -(-sum(n for *_, n in counted) // SALTS))
    placed, now, before = [], -1, 0
    for s, granule, n in counted:
        before = before if s == now else 0
        now = s
        placed.append((s, granule, before, -(-n // most)))
        before += n
    places = spark.createDataFrame(placed, "shard int, granule long, before long, salts int")
    salted = rows.join(F.broadcast(places), ["shard", "granule"]).withColumn("salt", F.pmod("row", F.col("salts").cast("long")))
    number = F.row_number().over(Window.partitionBy("shard", "granule", "salt").orderBy("text_hash", "doc_id", "row"))
    numbered = salted.withColumn("number", number)
    # only granules with more than one salt have counts before a row's own salt
    counts = salted.where("salts > 1").groupBy("shard", "granule", "salt").count()
    running = F.sum("count").over(Window.partitionBy("shard", "granule").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    earlier = counts.select("shard", "granule", "salt", running.alias("earlier"))
    # salts that count: SALTS and one a granule with several, at most
    return numbered.join(F.broadcast(earlier), ["shard", "granule", "salt"], "left").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.coalesce("earlier", F.lit(0)) + F.col("number") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
