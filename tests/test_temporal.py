"""Intervals out of logs, their merging and as-of joins, against plain Python on random and odd rows."""

import datetime
import random

from pyspark.sql import functions as F

from skein.operators import temporal

T0 = datetime.datetime(2024, 1, 1)
HOUR = datetime.timedelta(hours=1)


def moment(h):
    return None if h is None else T0 + HOUR * h


def test_intervals_equal_a_state_machine(spark):
    rng = random.Random(1)
    log = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), rng.random() < 0.5) for _ in range(400)]
    want = set()
    for key in ("a", "b", None):
        own = {}
        for k, h, add in log:
            if k == key and (add or h is not None):
                own[h] = own.get(h, False) or add
        since, is_open = None, False
        for h in sorted(own, key=lambda h: (h is not None, h or 0)):
            if own[h] and not is_open:
                since, is_open = h, True
            elif not own[h] and is_open:
                want.add((key, moment(since), moment(h)))
                is_open = False
        if is_open:
            want.add((key, moment(since), None))
    df = spark.createDataFrame([(k, moment(h), a) for k, h, a in log], "k string, t timestamp, adds boolean")
    got = temporal.intervals(df, ["k"], "t", "adds").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert temporal.intervals(df.limit(0), ["k"], "t", "adds").count() == 0


def test_as_of_equals_all_pairs(spark):
    rng = random.Random(2)
    spans = [(k, rng.choice(["x", "y", None]), rng.choice([None, *range(-2000, 2000)]), rng.choice([None, *range(-2000, 2000)])) for k in range(150)] + [(900, "x", None, None), (901, "x", 5, 5), (902, "x", 24, 48), (902, "x", 24, 48)]
    asked = [(k, rng.choice(["x", "y", None]), rng.choice([None, *range(-2100, 2100)])) for k in range(150)] + [(900, "x", 24), (901, "x", 48)]
    rows = spark.createDataFrame([(k, g, moment(a), moment(b)) for k, g, a, b in spans], "edge long, k string, valid_from timestamp, valid_to timestamp")
    instants = spark.createDataFrame([(k, g, moment(h)) for k, g, h in asked], "asked long, k string, t timestamp")
    want = sorted((i, e) for i, g, h in asked for e, g2, a, b in spans if h is not None and g == g2 and (a is None or a <= h) and (b is None or h < b) and (a is None or b is None or a < b))
    for width in (3600, 86_400, 10_000_000):
        got = temporal.as_of(instants, rows, ["k"], "t", width_seconds=width)
        assert sorted((r["asked"], r["edge"]) for r in got.select("asked", "edge").collect()) == want
    far = spark.createDataFrame([(1, "x", datetime.datetime(1, 2, 3), datetime.datetime(9000, 1, 1))], rows.schema)
    assert temporal.as_of(instants.where("k = 'x'"), far, ["k"], "t", width_seconds=1).count() == sum(g == "x" and h is not None for _, g, h in asked)


def test_covers_are_small_and_exact(spark):
    pairs = [(a, b) for a in (0, 1, 2, 5, 1000, 2**21) for b in (a, a + 1, a + 7, 2**22 - 1) if b >= a]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", temporal._cover(F.col("a"), F.col("b")).alias("n")).collect():
        runs = sorted((n["bucket"] << n["level"], (n["bucket"] + 1) << n["level"]) for n in r["n"])
        assert runs[0][0] == r["a"] and runs[-1][1] == r["b"] + 1 and all(x[1] == y[0] for x, y in zip(runs, runs[1:]))
        assert len(runs) <= 2 * temporal.LEVELS


def test_merged_intervals(spark):
    rows = [("a", 0, 2), ("a", 2, 3), ("a", 5, 6), ("a", 5, 9), ("a", 7, 8), ("b", None, 1), ("b", 0, 4), ("c", 3, None), ("c", 9, 10), ("d", None, None), (None, 1, 2)]
    df = spark.createDataFrame([(k, moment(a), moment(b)) for k, a, b in rows], "k string, valid_from timestamp, valid_to timestamp")
    want = {("a", 0, 3), ("a", 5, 9), ("b", None, 4), ("c", 3, None), ("d", None, None), (None, 1, 2)}
    assert {tuple(r) for r in temporal.merged(df, ["k"]).collect()} == {(k, moment(a), moment(b)) for k, a, b in want}


def test_as_of_is_the_same_by_key_and_by_time(spark):
    """Keys of few pairs meet by the key alone, with no row a level of the tree; hot ones by time; null keys either way."""
    rng = random.Random(3)
    spans = [(k, rng.choice(["x", "x", "x", "y", None]), rng.choice([None, *range(-50, 50)]), rng.choice([None, *range(-50, 50)])) for k in range(80)]
    asked = [(k, rng.choice(["x", "x", "x", "y", None]), rng.choice([None, *range(-60, 60)])) for k in range(80)]
    rows = spark.createDataFrame([(k, g, moment(a), moment(b)) for k, g, a, b in spans], "edge long, k string, valid_from timestamp, valid_to timestamp")
    instants = spark.createDataFrame([(k, g, moment(h)) for k, g, h in asked], "asked long, k string, t timestamp")
    want = sorted((i, e) for i, g, h in asked for e, g2, a, b in spans if h is not None and g == g2 and (a is None or a <= h) and (b is None or h < b) and (a is None or b is None or a < b))
    for pairs in (0, 500, temporal.PAIRS):
        got = temporal.as_of(instants, rows, ["k"], "t", pairs=pairs)
        assert sorted((r["asked"], r["edge"]) for r in got.select("asked", "edge").collect()) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("_above" in plan) == (pairs < temporal.PAIRS)
