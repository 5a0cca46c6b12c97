"""Hard negatives against all scores, the brackets against exact scores, pruning on vectors in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import negatives
from skein.llm.queries import op13_hard_negatives


def brute(rows, every=100, k=5):
    """rows: (id, label, vector) that take part."""
    out = []
    for a, label, q in rows:
        if a % every:
            continue
        scored = sorted(((-int(sum(int(x) * int(y) for x, y in zip(q, v))), i, other) for i, other, v in rows if i != a and len(v) == len(q)))
        pos = [(i, -s) for s, i, other in scored if other == label][:k]
        for p, ps in pos:
            own = [(i, -s) for s, i, other in scored if other != label and 80 * ps <= -100 * s <= 100 * ps][:k]
            out += [(a, p, n, i, ps, s) for n, (i, s) in enumerate(own, 1)]
    return sorted(out)


def whole(v):
    return np.floor(256 * np.asarray(v, np.float64))


def got(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    taken = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], whole(r["embedding"])) for r in rows if r["label"] is not None and r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    want = brute(taken)
    assert want and got(op13_hard_negatives(spark, "/root/testdata/sf0.01")) == want


@pytest.mark.parametrize("block", [3, 50, 8192])
def test_odd_rows(spark, block):
    rng = np.random.default_rng(block)
    rows = [(k, int(k % 3), (rng.normal(size=4) + (k % 5)).tolist()) for k in range(60)]
    rows += [(100 + k, k % 2, [1.0, 0.0, 1.0, 0.5]) for k in range(40)]  # equal vectors of both labels
    rows += [(200, 1, [0.0] * 4), (300, 0, [-1.0, -1.0, -1.0, -1.0]), (400, 7, [1.0, 2.0, 3.0, 4.0]), (500, 1, [1.0, 2.0]), (501, 1, [2.0, 2.0]), (502, 0, [2.0, 1.0])]
    rows += [(600, None, [1.0] * 4), (700, 1, None), (800, 1, [1.0, None, 1.0, 1.0]), (900, 1, [1.0, float("nan"), 1.0, 1.0]), (1000, 1, [1.0, float("inf"), 1.0, 1.0]), (1100, 1, []), (None, 1, [1.0] * 4), (5, 2, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit("x")).withColumn("dim", F.lit(1))
    taken = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and (i not in taken or (label, len(v), whole(v).tobytes()) < (taken[i][0], len(taken[i][1]), taken[i][1].tobytes())):
            taken[i] = label, whole(v)
    want = brute([(i, *r) for i, r in taken.items()], every=10)
    assert want and got(negatives.mine(df, every=10, block=block, anchors=4)) == want
    assert negatives.mine(df.limit(0)).count() == 0 and negatives.mine(df.where("vec_id is null")).count() == 0


def test_large_numbers_are_exact(spark):
    rows = [(0, 0, [1e9, 3.0]), (1, 0, [1e3, 5.0]), (2, 1, [1e3, 4.99]), (3, 1, [1e3, -5.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(negatives.mine(df)) == brute([(i, label, whole(v)) for i, label, v in rows])


def test_brackets_hold():
    rng = np.random.default_rng(3)
    x, q = np.floor(256 * rng.normal(size=(400, 8))), np.floor(256 * rng.normal(size=(50, 8)))
    x[:40] = x[0]
    q[:5] = x[:5]
    pivots = negatives.Pivots(x, 6, float(np.sqrt((x**2).sum(1).max())))
    far, dq, q2 = pivots.of_rows(x), pivots.of_queries(q), (q**2).sum(1)
    score = q @ x.T
    assert (pivots.upper(q2, dq, far, far) >= score).all() and (pivots.lower(q2, dq, far) <= score).all()
    assert (pivots.upper(q2, dq, far.min(0)[None], far.max(0)[None]) >= score.max(1)[:, None]).all()


def test_clusters_are_pruned(tmp_path):
    """Of vectors in clusters most blocks are never read, and few pairs are compared."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 40
    own = np.repeat(np.arange(20), 300)
    x = np.floor(256 * (centres[own] + rng.normal(size=(6000, 16)) * 0.5))
    label = rng.integers(0, 3, 6000)
    pivots = negatives.Pivots(x[::5], 16, float(np.sqrt((x**2).sum(1).max())))
    far = pivots.of_rows(x)
    blocks = []
    for c in range(20):
        at = np.flatnonzero(own == c)
        path = str(tmp_path / f"{c}")
        negatives.write_file(path, negatives._dump(ids=at, label=label[at], x=x[at], far=far[at]))
        blocks.append((path, far[at].min(0), far[at].max(0)))
    asked = np.arange(0, 300, 10)  # all of one cluster
    queries = {"ids": asked, "label": label[asked], "x": x[asked], "far": pivots.of_queries(x[asked])}
    seen = {}
    tops = negatives.walk(queries, blocks, pivots, 5, None, seen)
    for a, top in zip(asked, tops, strict=True):
        s = x @ x[a]
        fit = np.flatnonzero((label == label[a]) & (np.arange(6000) != a))
        assert top.ids[0].tolist() == fit[np.lexsort((fit, -s[fit]))[:5]].tolist()
    assert seen["read"] <= 10 and seen["pairs"] < 0.3 * 6000 * len(asked)
