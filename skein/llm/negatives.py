"""Operator 13, hard negatives: exact top lists by inner product, with a pivot table that brackets scores before they are computed.

A row x gets one more component, sqrt(M^2 - |x|^2), where M is the largest norm; a query q gets a zero. Then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so a larger inner product is a smaller distance, and distances to a few pivots bracket it:
| |q - p| - |x - p| | <= |q - x| <= |q - p| + |x - p|.

1. Pivots are chosen far apart out of a bounded sample. Every row's distances to them are stored: the pivot table.
2. Rows are dealt into blocks by their nearest pivot, large ones split by a hash; a block is a file of the shared folder with its rows'
   pivot distances and their ranges. Queries (the anchors) are dealt into blocks likewise.
3. A task has an anchor block and a run of row blocks, nearest ranges first. A block whose ranges can't hold anything better than
   what an anchor has is not read; in a block that is read, rows whose brackets can't be better are left out; survivors
   are compared exactly, by integers. A task gives each anchor's few best, which are merged.
4. Positives are the best rows of the anchor's label. Their scores give bands; negatives are the best rows of other labels in each
   band, found by a second walk, in which both ends of the brackets prune.

Where vectors have no structure the brackets prune little and the pairs of blocks grow as anchors times rows, by matrix
products of their survivors.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; only vectors of the
same length are compared; rows that repeat an id count once (the smallest label, then the shortest vector, then the first by its bytes); an anchor without another
row of its label, or a positive without a negative in its band (so every one with a negative score), gives no rows; an empty table gives no rows;
other columns of the input are ignored. A score beyond 2^62 is an error.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, materialize, new_folder
from .files import read_all, write_file

#: Rows in a block; anchors in a block; row blocks that a task walks at most; pivots, and the sample they are chosen from.
BLOCK, ANCHORS, RUN, PIVOTS, SAMPLE = 8192, 256, 8, 16, 2048
#: Rows compared with an anchor block at a time.
SOME = 1024
#: What distances may be off by in rounding, for each unit of M.
SLACK = 1e-9


def prepared(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: float) -> DataFrame:
    """id, label, dim, v (binary, doubles that are whole numbers): a row per distinct id that takes part."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", pa.binary())])

    def run(batches):
        for b in batches:
            column = b.column(2)
            lengths = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            vectors = [None] * len(lengths)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                x = flat[starts[at][:, None] + np.arange(dim)]
                finite = np.isfinite(x).all(1)
                for k, row in zip(at[finite].tolist(), np.floor(scale * x[finite]) + 0.0, strict=True):
                    vectors[k] = row.tobytes()
            kept = pa.array([v is not None for v in vectors], pa.bool_())
            yield batch({"id": b.column(0), "label": b.column(1), "dim": lengths, "v": pa.array(vectors, pa.binary())}, schema).filter(kept)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    whole = rows.where("id is not null and label is not null and v is not null").mapInArrow(run, "id long, label long, dim int, v binary")
    return whole.groupBy("id").agg(F.min(F.struct("label", "dim", "v")).alias("r")).select("id", "r.*")


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def exact(queries: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly where asked: doubles hold them below 2^53, else Python's integers."""
    bound = np.sqrt((queries**2).sum(1).max(initial=0.0)) * np.sqrt((rows**2).sum(1).max(initial=0.0))
    if bound < 2**52:
        return (queries @ rows.T).astype(np.int64)
    whole = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in r] for r in rows], object).T
    if any(abs(x) >= 2**62 for x in whole[asked]):
        raise OverflowError("inner products of 2^62 or more")
    return np.where(asked, whole, 0).astype(np.int64)


class Pivots:
    """Pivots of one length of vectors, M, and the distances to them."""

    def __init__(self, sample: np.ndarray, most: int, norm: float):
        self.norm = norm
        full = self.augmented(sample)
        chosen, far = [0], np.linalg.norm(full - full[0], axis=1)
        while len(chosen) < min(most, len(full)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(full - full[chosen[-1]], axis=1))
        self.points = full[chosen]
        self.slack = SLACK * max(1.0, norm)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.norm**2 - np.einsum("ij,ij->i", x, x)))])

    def _far(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.linalg.norm(x - p, axis=1) for p in self.points], 1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._far(self.augmented(x))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self._far(np.column_stack([q, np.zeros(len(q))]))

    def score(self, q2: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The inner product at a distance; q2: squared norms of the queries."""
        return (q2 + self.norm**2 - distance * distance) / 2

    def upper(self, q2: np.ndarray, dq: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """No score of each query (rows) is higher, over rows whose pivot distances lie from low to high (columns)."""
        gap = np.zeros((len(dq), len(low)))
        for p in range(dq.shape[1]):
            d = dq[:, p, None]
            np.maximum(gap, np.maximum(low[None, :, p] - d, d - high[None, :, p]), out=gap)
        return self.score(q2[:, None], np.maximum(0.0, gap - self.slack)) + self._round()

    def lower(self, q2: np.ndarray, dq: np.ndarray, high: np.ndarray) -> np.ndarray:
        """No score of each query is lower, over rows whose pivot distances are high at most."""
        far = np.full((len(dq), len(high)), np.inf)
        for p in range(dq.shape[1]):
            np.minimum(far, dq[:, p, None] + high[None, :, p], out=far)
        return self.score(q2[:, None], far + self.slack) - self._round()

    def _round(self) -> float:
        return 1e-12 * self.norm**2 + 1e-9


def _dump(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(path: str) -> dict:
    with np.load(io.BytesIO(read_all(path))) as f:
        return {k: f[k] for k in f.files}


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))


class Tops:
    """The k best of each list so far, and the least score that still matters to it."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.score, self.ids = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.least = least.astype(np.float64)

    def add(self, a: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[a], score]), np.concatenate([self.ids[a], ids])
        at = best_of(score, ids, self.k)
        self.score[a], self.ids[a] = score[at], ids[at]
        if len(at) == self.k:
            self.least[a] = max(self.least[a], score[at[-1]])


def walk(queries: dict, blocks, pivots: Pivots, k: int, lists: list[list[tuple[int, int]]] | None, seen: dict | None = None) -> list[Tops]:
    """The best rows of each query over blocks: (path, low, high of the pivot distances).

    lists None: one list a query, of the other rows of its label. Else of each query some (low, high): a list each, of rows of
    other labels with scores from low to high.
    """
    ids, label, q, dq = queries["ids"], queries["label"], queries["x"], queries["far"]
    q2 = np.einsum("ij,ij->i", q, q)
    same = lists is None
    bands = [[(-(2**62), 2**62)]] * len(ids) if same else lists
    tops = [Tops(len(own), k, np.array([low for low, _ in own])) for own in bands]
    live = np.array([len(own) > 0 for own in bands])
    high = np.array([max((h for _, h in own), default=-(2**62)) for own in bands], np.float64)
    bounds = [pivots.upper(q2, dq, low[None], top[None])[:, 0] for _, low, top in blocks]
    # first where most could be found
    for at in np.argsort([-b[live].max(initial=-np.inf) for b in bounds], kind="stable").tolist():
        path, _, top = blocks[at]
        least = np.array([t.least.min(initial=np.inf) for t in tops])
        go = live & (bounds[at] >= least)
        if not same:
            go &= pivots.lower(q2, dq, top[None])[:, 0] <= high
        if not go.any():
            continue
        block = _load(path)
        if seen is not None:
            seen["read"] = seen.get("read", 0) + 1
        who = np.flatnonzero(go)
        for s in range(0, len(block["ids"]), SOME):
            part = slice(s, s + SOME)
            far, own_ids, own_label, x = block["far"][part], block["ids"][part], block["label"][part], block["x"][part]
            least = np.array([tops[a].least.min(initial=np.inf) for a in who])
            keep = pivots.upper(q2[who], dq[who], far, far) >= least[:, None]
            keep &= (own_label[None] == label[who, None]) == same
            if same:
                keep &= own_ids[None] != ids[who, None]
            else:
                keep &= pivots.lower(q2[who], dq[who], far) <= high[who, None]
            rows = np.flatnonzero(keep.any(0))
            if not len(rows):
                continue
            if seen is not None:
                seen["pairs"] = seen.get("pairs", 0) + int(keep.sum())
            some = np.flatnonzero(keep.any(1))
            score = exact(q[who[some]], x[rows], keep[np.ix_(some, rows)])
            for place, a in zip(some.tolist(), who[some].tolist(), strict=True):
                mine = keep[place, rows]
                scores, names = score[np.searchsorted(some, place), mine], own_ids[rows[mine]]
                for n, (lo, hi) in enumerate(bands[a]):
                    fit = (scores >= max(lo, tops[a].least[n])) & (scores <= hi)
                    if fit.any():
                        tops[a].add(n, scores[fit], names[fit])
    return tops


def band(positive: int) -> tuple[int, int] | None:
    """Whole scores s with 80 * positive <= 100 * s <= 100 * positive."""
    low = -(-80 * positive // 100)
    return (low, positive) if low <= positive else None


def mine(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, scale: float = 256.0, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", block: int = BLOCK, anchors: int = ANCHORS, pivot_count: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors: ids divisible by `every`. label: another column than `label`."""
    spark = df.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(prepared(df, id_col, F.col("label") if label is None else label, vector_col, scale), "whole")
    pivots = _pivots(rows, pivot_count)
    if not pivots:
        return spark.createDataFrame([], empty)
    placed_schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", pa.binary()), ("home", pa.int32()), ("far", pa.binary())])

    def place(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                far = pivots[dim].of_rows(matrix(own.column(3), dim))
                yield batch(dict(zip(placed_schema.names, [*own.columns, far.argmin(1), [r.tobytes() for r in far]], strict=True)), placed_schema)

    # written, so that the ranges hold for the very distances that are stored
    placed = materialize(rows.mapInArrow(place, "id long, label long, dim int, v binary, home int, far binary"), "pivot-table")
    sizes = placed.groupBy("dim", "home").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("asked"))
    parts = sizes.select("dim", "home", F.ceil(F.col("n") / block).cast("int").alias("parts"))  # a row a pivot
    folder = new_folder(spark, "negatives")

    def build(key, group):
        dim = key[0].as_py()
        x, far = matrix(group.column("v"), dim), matrix(group.column("far"), len(pivots[dim].points))
        order = np.argsort(group.column("id").to_numpy())
        path = f"{folder}/{uuid.uuid4().hex}"  # new to each attempt
        write_file(path, _dump(ids=group.column("id").to_numpy()[order], label=group.column("label").to_numpy()[order], x=x[order], far=far[order]))
        return pa.table({"dim": pa.array([dim], pa.int32()), "path": [path], "low": [far.min(0).tobytes()], "high": [far.max(0).tobytes()]})

    dealt = placed.join(F.broadcast(parts), ["dim", "home"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")))
    # a block is bounded: about `block` rows by a hash of distinct ids
    blocks = materialize(dealt.groupBy("dim", "home", "part").applyInArrow(build, "dim int, path string, low binary, high binary"), "blocks")

    of_dim = {r["dim"]: r["asked"] for r in sizes.groupBy("dim").agg(F.sum("asked").alias("asked")).collect()}  # a row a length
    some = {dim: max(1, -(-n // anchors)) for dim, n in of_dim.items()}
    groups = spark.createDataFrame(list(some.items()), "dim int, groups int")
    asked = placed.where(F.col("id") % every == 0).join(F.broadcast(groups), "dim").withColumn("grp", F.pmod(F.xxhash64("id"), F.col("groups").cast("long")).cast("int"))

    def ask(key, group):
        dim = key[0].as_py()
        q = matrix(group.column("v"), dim)
        path = f"{folder}/{uuid.uuid4().hex}"
        write_file(path, _dump(ids=group.column("id").to_numpy(), label=group.column("label").to_numpy(), x=q, far=pivots[dim].of_queries(q)))
        return pa.table({"dim": pa.array([dim], pa.int32()), "grp": pa.array([key[1].as_py()], pa.int32()), "queries": [path]})

    queries = materialize(asked.select("dim", "grp", "id", "label", "v").groupBy("dim", "grp").applyInArrow(ask, "dim int, grp int, queries string"), "queries")
    # the stated queries against all rows, in blocks: each block once an anchor block
    repeated = blocks.join(F.broadcast(groups), "dim").withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    tiles = materialize(repeated.join(queries, ["dim", "grp"]).withColumn("run", F.pmod(F.xxhash64("path"), F.lit(_runs(blocks, RUN)))), "tiles")
    found_schema = pa.schema([("grp", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    found_ddl = "grp int, anchor_id long, positive_id long, positive_score long, id long, score long"

    def compared(second: bool):
        def run(key, group):
            dim, grp = key[0].as_py(), key[1].as_py()
            asked_rows = _load(group.column("queries")[0].as_py())
            near = [(p, np.frombuffer(lo, np.float64), np.frombuffer(hi, np.float64)) for p, lo, hi in zip(group.column("path").to_pylist(), group.column("low").to_pylist(), group.column("high").to_pylist(), strict=True)]
            named = [[None]] * len(asked_rows["ids"])
            lists = None
            if second:
                given = _load(group.column("bands")[0].as_py())
                named = [[(int(p), int(s)) for p, s in zip(given["id"][given["anchor"] == a], given["score"][given["anchor"] == a], strict=True) if band(int(s))] for a in asked_rows["ids"]]
                lists = [[band(s) for _, s in own] for own in named]
            tops = walk(asked_rows, near, pivots[dim], negatives if second else positives, lists)
            out = {name: [] for name in found_schema.names}
            for anchor, own, top in zip(asked_rows["ids"].tolist(), named, tops, strict=True):
                for n, what in enumerate(own):
                    for i, s in zip(top.ids[n].tolist(), top.score[n].tolist(), strict=True):
                        for name, value in zip(found_schema.names, (grp, anchor, what and what[0], what and what[1], i, s), strict=True):
                            out[name].append(value)
            return pa.table([pa.array(out[f.name], f.type) for f in found_schema], schema=found_schema)

        return run

    first = tiles.groupBy("dim", "grp", "run").applyInArrow(compared(False), f"{found_ddl}")
    best = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    chosen = materialize(first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).select("anchor_id", "id", "score"), "positives")

    def bands(key, group):
        path = f"{folder}/{uuid.uuid4().hex}"
        write_file(path, _dump(anchor=group.column("anchor_id").to_numpy(), id=group.column("id").to_numpy(), score=group.column("score").to_numpy()))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "grp": pa.array([key[1].as_py()], pa.int32()), "bands": [path]})

    # an anchor block has `anchors` times `positives` of them, about
    where = chosen.join(asked.select(F.col("id").alias("anchor_id"), "dim", "grp"), "anchor_id")
    banded = materialize(where.groupBy("dim", "grp").applyInArrow(bands, "dim int, grp int, bands string"), "bands")
    second = tiles.join(banded, ["dim", "grp"]).groupBy("dim", "grp", "run").applyInArrow(compared(True), found_ddl)
    ranked = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return second.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _runs(blocks: DataFrame, most: int) -> int:
    return max(1, -(-blocks.count() // most))


def _pivots(rows: DataFrame, most: int) -> dict[int, Pivots]:
    """The pivots of each length of vectors. The driver gets a sample of SAMPLE rows a length, and a norm."""
    out = {}
    norms = rows.select("dim", "id", "v").mapInArrow(_norms, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm")).collect()
    for r in sorted(norms, key=lambda r: r["dim"]):
        sample = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        out[r["dim"]] = Pivots(np.frombuffer(b"".join(bytes(s["v"]) for s in sample), np.float64).reshape(-1, r["dim"]), most, r["norm"])
    return out


def _norms(batches):
    schema = pa.schema([("dim", pa.int32()), ("norm", pa.float64())])
    for b in batches:
        dims = b.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            x = matrix(b.filter(pa.array(dims == dim)).column(2), dim)
            yield batch({"dim": [dim], "norm": [float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))]}, schema)
