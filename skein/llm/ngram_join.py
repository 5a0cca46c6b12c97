"""Operator 4, n-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

1. Texts with equal shingle sets form a class; its smallest id represents it.
2. Narrowing, without loss. If two sets link, they share so many of their smallest hashes that
   each has at least `need` of its own `probe` smallest ones in common with some other text
   (`probe_sizes`). Maps send these hashes, cut to 40 bits and sorted, as a few binary blocks a
   batch and hash range; a range's task only tells which occur twice. Most texts end here. What is
   left of one text a class goes through the same again with all hashes, of which t must recur.
3. The representatives left, of which any two that link share one of their first
   |x| - ceil(t|x|) + 1 hashes, fall into clusters: components over those shared hashes.
4. A cluster is a tile; a large one is cut by size band (ratio 1/t) and salt, and each pair of
   neighbouring cuts is a tile, so no task grows with a cluster. A cut is stored once as a file, which
   its tiles' tasks read, so what moves doesn't grow with the number of tiles. In a tile sets are in order of
   size; the differing bits of two bitmaps bound the overlap from above, and what passes is
   intersected exactly on sorted arrays. Sets that a tile has already joined aren't compared
   again, so a tile of n sets gives at most n - 1 links.
5. Components over these links.

Defined results: an empty or null text, or one without words, has an empty set and links with
nothing; rows with a null id are left out; rows that repeat an id count once (of unequal texts
the one with the smaller set key counts); other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, join_groups, materialize, new_folder, small, utf8
from .components import connected_components
from .files import read_all, write_file
from .shingles import shingle_sets

#: Sets in one cut of a large cluster; 64-bit words of a bitmap.
CUT, WORDS = 1024, 32
#: Hashes of a narrowing in a task, and in a range, about; tasks at most, ranges a task at least.
TASK, TASKS, RANGES = 1_000_000, 20_000, 8
_CUT_BITS = 40
#: Pairs of cuts that a task compares, about.
PAIRS = 4


def overlap_needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set it links with."""
    return -(-n * percent // 100)


def probe_sizes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of its smallest hashes a set of n is probed by, and how many of those must occur elsewhere.

    Sets x and y with an overlap of o have their l smallest common hashes among the first
    l + |x| - o of x and l + |y| - o of y. With l a quarter of the size, and a partner at
    least percent of the size, a quarter of that many must be found.
    """
    least = overlap_needed(n, percent)
    probe = np.minimum(n, n - least + np.maximum(1, n // 4))
    return probe, np.maximum(1, least // 4)


def shingle_keys(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set; null if empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary())])

    def run(batches):
        for b in small(batches):
            sizes, keys = [], []
            for own in shingle_sets(*utf8(b.column(1)), n):
                sizes.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            yield batch({"doc_id": b.column(0), "n_shingles": sizes, "set_key": keys}, schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary")


def shared_counts(rows: DataFrame, sets_of, percent: int, hashes: int, probe_all: bool = False) -> DataFrame:
    """doc_id, shared: how many of a row's probe hashes occur in another row too; ids with none are left out.

    rows: doc_id and what sets_of (a function of an Arrow batch) makes its sets from. probe_all: all hashes are probed.
    Rows travel as blocks: one a batch and range on the way out, one a range and batch on the way back. A task holds one
    range at a time; tasks and ranges grow with the number of hashes (about `hashes`), so a range's size doesn't. In a block a hash
    has its row's number in the batch beside it (two bytes); the ids of a batch go once to where its counts are gathered. So a task that runs
    again has to read its rows in the same order, as it does from files.
    """
    parts = min(TASKS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hashes // TASK)))
    ranges = max(RANGES * parts, -(-hashes // TASK))
    block = pa.schema([("range", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("which", pa.binary())])
    answer = pa.schema([("batch", pa.int64()), ("ids", pa.binary()), ("which", pa.binary()), ("counts", pa.binary())])
    counted = pa.schema([("doc_id", pa.int64()), ("shared", pa.int64())])

    def blocks(batches):
        task = TaskContext.get().partitionId()
        for number, b in enumerate(small(batches, 5000)):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            parts, whose = [], []
            for k, own in enumerate(sets_of(b)):
                probe = len(own) if probe_all or not len(own) else int(probe_sizes(np.array([len(own)]), percent)[0][0])
                parts.append(own[:probe])
                whose.append(np.full(probe, k, np.int64))
            if not parts:
                continue
            hashes, whose = np.concatenate(parts), np.concatenate(whose)
            order = np.argsort(hashes)
            hashes, whose = hashes[order], whose[order]
            # ranges are equal slices of the 32 high bits; 40 bits below the 12 highest tell hashes apart within one
            which = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            low = (hashes >> np.uint64(64 - _CUT_BITS - 12)) & np.uint64((1 << _CUT_BITS) - 1)
            bounds = np.searchsorted(which, np.arange(ranges + 1))
            # the batch's ids, as if of a range below 0
            out = [(-1 - (task + number) % ranges, task << 32 | number, None, ids.tobytes())]
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                a, z = bounds[r], bounds[r + 1]
                out.append((r, task << 32 | number, low[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _CUT_BITS // 8].tobytes(), whose[a:z].astype("<u2").tobytes()))
            yield batch(dict(zip(block.names, zip(*out, strict=True), strict=True)), block)

    def groups(batches):
        """The rows of each value of the first column."""
        now, kept = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != now and kept:
                    yield now, kept
                    kept = []
                now = row[0]
                kept.append(row[1:])
        if kept:
            yield now, kept

    def shared(batches):
        for r, kept in groups(batches):
            if r < 0:
                for number, _, ids in kept:
                    yield batch({"batch": [number], "ids": [ids], "which": [None], "counts": [None]}, answer)
                continue
            hashes, sizes = [], []
            for _, low, which in kept:
                wide = np.zeros((len(which) // 2, 8), np.uint8)
                wide[:, : _CUT_BITS // 8] = np.frombuffer(low, np.uint8).reshape(-1, _CUT_BITS // 8)
                hashes.append(wide.view("<u8").ravel())
                sizes.append(len(wide))
            joined = np.concatenate(hashes)
            order = np.argsort(joined)
            joined = joined[order]
            same = np.zeros(len(joined), bool)
            same[1:] = joined[1:] == joined[:-1]
            same[:-1] |= same[1:]
            found = np.zeros(len(joined), bool)
            found[order] = same
            for (number, _, which), one in zip(kept, np.split(found, np.cumsum(sizes)[:-1]), strict=True):
                counts = np.bincount(np.frombuffer(which, "<u2")[one])
                some = np.flatnonzero(counts)
                while len(some):  # a text has few hashes in a range: a byte holds most counts, the rest comes in a further row
                    yield batch({"batch": [number], "ids": [None], "which": [some.astype("<u2").tobytes()], "counts": [np.minimum(counts[some], 255).astype(np.uint8).tobytes()]}, answer)
                    counts[some] -= np.minimum(counts[some], 255)
                    some = np.flatnonzero(counts)

    def gather(batches):
        for _, kept in groups(batches):
            ids = np.frombuffer(next(x for x, _, _ in kept if x is not None), "<i8")
            total = np.zeros(len(ids), np.int64)
            for _, which, counts in kept:
                if which is not None:
                    total[np.frombuffer(which, "<u2")] += np.frombuffer(counts, np.uint8)  # each row once a block
            # of rows that repeat an id all counts are summed, as they always were
            own, back = np.unique(ids[total > 0], return_inverse=True)
            yield batch({"doc_id": own, "shared": np.bincount(back, total[total > 0], len(own)).astype(np.int64)}, counted)

    dealt = rows.mapInArrow(blocks, "range int, batch long, hashes binary, which binary").repartition(parts, "range").sortWithinPartitions("range")
    back = dealt.mapInArrow(shared, "batch long, ids binary, which binary, counts binary").repartition(parts, "batch").sortWithinPartitions("batch")
    return back.mapInArrow(gather, "doc_id long, shared long").groupBy("doc_id").agg(F.max("shared").alias("shared"))


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64 * WORDS bits a set; a hash sets the bit of its low bits."""
    out = np.zeros((len(sets), WORDS * 64), bool)
    for k, own in enumerate(sets):
        out[k, (own & np.uint64(WORDS * 64 - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def link_tile(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what is linked in a tile, as a forest. side: 0 and 1 are compared with each other only, 2 with all of 2."""
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    ids, side, sizes, sets = ids[order], side[order], sizes[order], [sets[k] for k in order]
    bits, parent, out = bitmaps(sets), list(range(len(sets))), []
    groups = len(sets)
    for k in range(len(sets)):
        if groups == 1:
            break
        # larger ones that a ratio of the sizes allows
        last = int(np.searchsorted(sizes, sizes[k] * 100 // percent, "right"))
        if last <= k + 1:
            continue
        n = sizes[k + 1 : last]
        most = (sizes[k] + n - np.bitwise_count(bits[k + 1 : last] ^ bits[k]).sum(1, dtype=np.int64)) // 2
        near = np.flatnonzero((100 * most >= percent * (sizes[k] + n - most)) & ((side[k + 1 : last] != side[k]) | (side[k] == 2))) + k + 1
        root = _find(parent, k)
        for j in near.tolist():
            other = _find(parent, j)
            if other == root:
                continue
            at = np.searchsorted(sets[j], sets[k])
            both = int((sets[j][np.minimum(at, len(sets[j]) - 1)] == sets[k]).sum())
            if 100 * both >= percent * (len(sets[j]) + len(sets[k]) - both):
                parent[other] = root
                groups -= 1
                out.append((int(ids[k]), int(ids[j])))
    return out


def _cuts(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """doc_id, component, band, salt, total (sets of the cluster), hashes: a cluster of up to CUT sets is one cut; a larger one has cuts by size band and salt."""
    banded = sets.select("doc_id", "n").join(clusters, F.col("doc_id") == F.col("node")).select("doc_id", "component", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int").alias("band"))
    sizes = banded.groupBy("component", "band").count()
    whole = sizes.groupBy("component").agg(F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("count") / CUT).cast("int").alias("cuts")))).alias("cuts"))
    # a cluster has one entry a band: bounded by the logarithm of the longest text
    at = join_groups(banded, whole, ["component"], "total", sets.count(), "inner")
    large = F.col("total") > CUT
    salt = F.pmod(F.xxhash64("doc_id"), F.try_element_at("cuts", F.col("band")).cast("long")).cast("int")
    placed = at.select("doc_id", "component", F.when(large, F.col("band")).otherwise(0).alias("band"), F.when(large, salt).otherwise(0).alias("salt"), "total")
    return placed.join(sets.select("doc_id", "hashes"), "doc_id")


def _stored(cuts: DataFrame, folder: str) -> DataFrame:
    """component, band, salt, path: a file a cut, which tasks read for each of its tiles; so a set is stored once, in however many tiles it is."""

    def store(key, group):
        path = f"{folder}/{uuid.uuid4().hex}"  # new to each attempt
        with pa.BufferOutputStream() as out:
            with pa.ipc.new_file(out, group.schema) as f:
                f.write_table(group)
            write_file(path, out.getvalue().to_pybytes())
        return pa.table({"component": pa.array([key[0].as_py()], pa.int64()), "band": pa.array([key[1].as_py()], pa.int32()), "salt": pa.array([key[2].as_py()], pa.int32()), "path": [path]})

    return cuts.select("component", "band", "salt", "doc_id", "hashes").groupBy("component", "band", "salt").applyInArrow(store, "component long, band int, salt int, path string")


def ngram_components(df: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: a row per distinct id that is not null."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = materialize(shingle_keys(docs, n), "keys")
    one = materialize(keys.groupBy("doc_id").agg(F.min_by(F.struct("n_shingles", "set_key"), F.coalesce("set_key", F.lit(b""))).alias("s")).select("doc_id", "s.*"), "keys")
    classes = one.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("members"))
    total = keys.agg(F.sum("n_shingles").alias("n"), F.count("*").alias("rows")).first()
    # a set is probed by less than half of its hashes
    shared = shared_counts(docs, lambda b: shingle_sets(*utf8(b.column(1)), n), percent, (total["n"] or 0) // 2)
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 4))
    left = materialize(classes.join(shared, F.col("rep") == F.col("doc_id")).where(F.col("shared") >= need).select("doc_id", "set_key"), "left")

    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("n", pa.int64()), ("hashes", pa.binary())])

    def whole(batches):
        for b in small(batches):
            own = list(shingle_sets(*utf8(b.column(1)), n))
            yield batch({"doc_id": b.column(0), "set_key": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own], "n": [len(x) for x in own], "hashes": [x.tobytes() for x in own]}, schema)

    found = docs.join(left.select("doc_id"), "doc_id", "left_semi").mapInArrow(whole, "doc_id long, set_key binary, n long, hashes binary")
    # rows that repeat an id: the one that counts, once
    sets = materialize(found.join(left.select(F.col("doc_id").alias("d"), F.col("set_key").alias("k")), (F.col("doc_id") == F.col("d")) & (F.col("set_key") == F.col("k"))).drop("d", "k").dropDuplicates(["doc_id"]), "sets")
    # once more among those left, by all their hashes: percent of them must occur in another set
    again = shared_counts(sets.select("doc_id", "hashes"), lambda b: [np.frombuffer(x, "<u8") for x in b.column(1).to_pylist()], percent, sets.agg(F.sum("n")).first()[0] or 0, probe_all=True)
    sets = materialize(sets.join(again, "doc_id").where(F.col("shared") >= F.ceil(F.col("n") * percent / 100)).drop("shared"), "sets")

    first = pa.schema([("h", pa.int64()), ("doc_id", pa.int64())])

    def prefixes(batches):
        for b in batches:
            hs, ids = [], []
            for doc, size, hashes in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                p = size - -(-size * percent // 100) + 1
                hs.append(np.frombuffer(hashes, "<i8")[:p])
                ids.append(np.full(p, doc, np.int64))
            if hs:
                yield batch({"h": np.concatenate(hs), "doc_id": np.concatenate(ids)}, first)

    prefix = materialize(sets.select("doc_id", "n", "hashes").mapInArrow(prefixes, "h long, doc_id long"), "prefix")
    low = prefix.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    near = join_groups(prefix, low, ["h"], "c", prefix.count(), "inner").where("doc_id != first").select("doc_id", "first").distinct()
    clusters = connected_components(near, "doc_id", "first")
    cuts = materialize(_cuts(sets, clusters, percent), "cuts")
    small_ones, large_ones = cuts.where(F.col("total") <= CUT), cuts.where(F.col("total") > CUT)

    edges = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def found_links(out):
        return batch({"src": [x for x, _ in out], "dst": [y for _, y in out]}, edges)

    def link(batches):
        """Of rows in order of their cluster."""
        now, ids, own = None, [], []

        def close():
            return link_tile(np.array(ids), own, np.full(len(ids), 2), percent) if len(ids) > 1 else []

        for b in batches:
            out = []
            for component, doc, hashes in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if component != now:
                    out += close()
                    now, ids, own = component, [], []
                ids.append(doc)
                own.append(np.frombuffer(hashes, "<u8"))
            if out:
                yield found_links(out)
        if out := close():
            yield found_links(out)

    def load(path):
        table = pa.ipc.open_file(pa.py_buffer(read_all(path))).read_all()
        return table.column("doc_id").to_pylist(), [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]

    def link_cuts(batches):
        """Of pairs of cuts; a cut with itself has all its pairs compared, two only those across."""
        path, a = None, None
        for b in batches:
            for left, right in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                if left != path:
                    path, a = left, load(left)
                other = ([], []) if left == right else load(right)
                side = np.full(len(a[0]), 2) if left == right else np.repeat([0, 1], [len(a[0]), len(other[0])])
                if out := link_tile(np.array(a[0] + other[0]), a[1] + other[1], side, percent) if len(side) > 1 else []:
                    yield found_links(out)

    links = small_ones.repartition(max(tasks, -(-sets.count() // CUT)), "component").sortWithinPartitions("component").select("component", "doc_id", "hashes").mapInArrow(link, "src long, dst long")
    if not large_ones.isEmpty():
        stored = materialize(_stored(large_ones, new_folder(spark, "cuts-stored")), "cuts-stored")
        right = stored.select("component", F.col("band").alias("b2"), F.col("salt").alias("s2"), F.col("path").alias("right"))
        near_cuts = ((F.col("b2") == F.col("band")) & (F.col("s2") >= F.col("salt"))) | (F.col("b2") == F.col("band") + 1)
        pairs = materialize(stored.join(right, "component").where(near_cuts).select(F.col("path").alias("left"), "right"), "cut-pairs")
        # a task has a few pairs that share their left cut
        parts = max(1, -(-pairs.count() // PAIRS))
        dealt = pairs.repartition(parts, "left", F.pmod(F.xxhash64("right"), F.lit(-(-stored.count() // PAIRS)))).sortWithinPartitions("left")
        links = links.unionByName(dealt.mapInArrow(link_cuts, "src long, dst long"))
    joined = connected_components(links)
    labels = classes.join(joined, F.col("rep") == F.col("node"), "left").select("set_key", "members", F.coalesce("component", "rep").alias("c"))
    out = join_groups(one, materialize(labels, "labels"), ["set_key"], "members", total["rows"])
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
