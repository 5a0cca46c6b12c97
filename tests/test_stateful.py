"""Merging of batches that come again, targets of calls, and states of streams."""

import json
import random
import uuid

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import degradation
from skein.plans import streams
from skein.sources import writers
from skein.streaming import stateful

HOW = {"key": "k", "add": ["n"], "least": ["low"], "greatest": ["high"]}


def back(spark, path):
    return {r["k"]: (r["n"], r["low"], r["high"]) for r in spark.read.schema("k string, n long, low long, high long").parquet(f"{path}/table").collect()}


def test_batches_merge_once(spark):
    path = writers.scratch(spark, f"merge-{uuid.uuid4().hex}")
    first = spark.createDataFrame([("a", 1, 5, 5), ("a", 2, 3, 9), ("b", 1, 1, 1), (None, 4, 0, 0)], "k string, n long, low long, high long")
    second = spark.createDataFrame([("b", 10, 7, 7), ("c", 1, 2, 2)], first.schema)
    assert stateful.merge_into(spark, path, first, 0, **HOW) >= 1
    assert back(spark, path) == {"a": (3, 3, 9), "b": (1, 1, 1), None: (4, 0, 0)}
    assert stateful.merge_into(spark, path, second, 1, **HOW) >= 1
    want = {"a": (3, 3, 9), "b": (11, 1, 7), "c": (1, 2, 2), None: (4, 0, 0)}
    assert back(spark, path) == want
    for batch, n in ((second, 1), (first, 0)):  # again, the older one too where its buckets have gone on
        stateful.merge_into(spark, path, batch, n, **HOW)
    assert back(spark, path) == want
    assert stateful.merge_into(spark, path, first.limit(0), 2, **HOW) == 0


def test_untouched_buckets_stay(spark):
    path = writers.scratch(spark, f"merge-{uuid.uuid4().hex}")
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("n"), "id", F.col("id").alias("high")).withColumnRenamed("id", "low")
    stateful.merge_into(spark, path, rows, 0, **HOW)
    files = lambda: {r[0] for r in spark.read.parquet(f"{path}/table").select(F.input_file_name()).distinct().collect()}
    before = files()
    assert stateful.merge_into(spark, path, rows.where("k = '7'"), 1, **HOW) == 1
    assert len(before - files()) == 1


def test_targets_equal_the_expression(spark):
    calls = [("Bash", '{"command": "' + "x" * 200 + '"}'), ("Edit", '{"file_path": "a/b"}'), ("Read", "{}"), ("Other", '{"b": 1, "a": [1, 2]}'), ("", "{}"), ("Bash", '{"other": 1}')]
    df = spark.createDataFrame(calls, "name string, inputs string")
    got = df.select("name", "inputs", text.tool_target(F.col("name"), F.col("inputs")).alias("t")).collect()
    assert [r["t"] for r in got] == [stateful.target_of(*c) for c in calls]


class Store:
    """A session's state in a dict, as a handle gives it."""

    def __init__(self):
        self.names = {}

    def getMapState(self, name, *_):
        return Kept(self.names.setdefault(name, {}))

    getValueState = getMapState


class Kept:
    def __init__(self, rows):
        self.rows = rows

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.rows[()] = value


def transcript(rng, stem, n):
    """Lines of all kinds, with several blocks, ids that come again or are missing, and nulls."""
    some = lambda *of: rng.choice(of)
    for at in range(n):
        kind = some("assistant", "assistant", "user", "user", "edit", "system")
        entry = {"type": {"edit": "user"}.get(kind, kind)} | some({}, {}, {"sessionId": some("s1", "s2")})
        if kind == "assistant":
            calls = [{"type": some("tool_use", "tool_use", "text"), "name": some("Edit", "Bash", "Other", None), "input": {some("file_path", "command"): some("a", "b", "x" * 220)}} | some({"id": some("c1", "c2", "c3")}, {"id": some("c1", "c2")}, {}) for _ in range(rng.randrange(3))]
            entry |= {"requestId": some("r1", "r2", None), "isSidechain": some(False, False, True), "message": {"content": calls, "stop_reason": some("max_tokens", "end_turn", None)} | some({"usage": {"input_tokens": some(0, 50, 90)}}, {"usage": {"input_tokens": 7, "cache_read_input_tokens": 4}}, {})}
        elif kind == "user":
            blocks = [{"type": some("tool_result", "tool_result", "text"), "is_error": some(True, True, False, None), "content": some("bad", "é" * 170, None)} | some({"tool_use_id": some("c1", "c2", "c3", "c9")}, {"tool_use_id": some("c1", "c2")}, {}) for _ in range(rng.randrange(4))]
            entry |= {"message": {"content": blocks}, "toolUseResult": {"interrupted": some(True, False, False)}}
        elif kind == "edit":
            entry |= {"toolUseResult": {"interrupted": some(True, False, False), "filePath": some("f", "g" * 210, "", None), "oldString": some("1", "2", None), "newString": some("1", "2", "3")}}
        else:
            entry |= {"subtype": some("compact_boundary", "other"), "compactMetadata": some({}, {"trigger": some("auto", None), "preTokens": some(0, 60, 500, None), "postTokens": 9})}
        yield stem, at, json.dumps(entry)


def test_events_of_a_stream_in_parts_are_those_of_the_batch(spark):
    """Micro-batches of one record, of some and of all, each a session's rows out of order: the events are the batch operator's."""
    rng = random.Random(5)
    lines = [x for k in range(12) for x in transcript(rng, f"t{k}", 60)]
    df = spark.createDataFrame(lines, "stem string, line_no long, line string")
    want = sorted(tuple(r) for r in degradation.events(degradation.parse(df)).select(*degradation.EVENT).collect())
    assert {r[2] for r in want} == {"tool_error", "tool_thrash", "edit_revert", "interrupted", "truncation", "compact_boundary"}
    rows = stateful.parts(degradation.fields(df)).toPandas()
    for width in (1, 7, 60):
        got = []
        for stem, own in rows.groupby("stem"):
            store = Store()
            for _, part in own.groupby(own["seq"] // width):
                fold = stateful.Degradation()  # anew for each micro-batch: only the state goes on
                fold.init(store)
                shuffled = part.sample(frac=1, random_state=width)
                half = len(shuffled) // 2
                for out in fold.handleInputRows((stem,), iter([shuffled[:half], shuffled[half:]]), None):
                    got += out.itertuples(index=False, name=None)
        assert sorted(got) == want


def test_state_has_no_more_partitions_than_keys(spark, tmp_path, monkeypatch):
    """Each starts a store and a worker a micro-batch: with the session's 200, these were most of the seconds."""
    monkeypatch.setattr(streams.writers, "scratch", lambda *_: f"file://{tmp_path}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        events = spark.sql("select id as event_id, id as user_id, 'error' as event_type, 0.5D as value, '{\"k\": 1}' as props from range(9)")
        assert streams.degradation_stream(events).count() == 9
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([d for d in (tmp_path / "checkpoint/state/0").iterdir() if d.name.isdigit()]) == 50


def test_chunks_of_a_sorted_table_are_dealt_out(spark, tmp_path):
    """A third of a table in order of its number lies in a third of its tasks: the files that a stream reads were as few."""

    class Run:
        def awaitTermination(self):
            files.append(sorted(len(pq.read_table(f, columns=["n"])) for f in tmp_path.glob("*.parquet")))

    files = []
    rows = spark.range(0, 600_000, 1, 6).select(F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    streams.in_chunks(rows, "n", f"file://{tmp_path}", Run)
    assert [sum(f) for f in files] == [200_000, 400_000, 600_000]
    assert len([n for n in files[0] if n > 30_000]) == 4
