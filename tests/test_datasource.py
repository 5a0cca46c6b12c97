"""The transcript source: every line once whatever the ranges, pushed filters, and a stream over files that grow."""

import io
import random

import pytest

from skein.sources import datasource


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_ranges_have_every_line_once(block, monkeypatch):
    monkeypatch.setattr(datasource, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(40):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 2, 30]))) for _ in range(rng.randrange(8))]
        data = b"\n".join(parts) + rng.choice([b"", b"\n"])
        want, at = [], 0
        for part in data.split(b"\n"):
            if at < len(data):
                want.append((at, part))
            at += len(part) + 1
        for size in (1, 2, 7, 1000):
            got = [x for start in range(0, len(data), size) for x in datasource.lines(io.BytesIO(data), start, min(start + size, len(data)))]
            assert [x for x in got if x[1]] == [x for x in want if x[1]]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    for k in range(3):
        (tmp_path / "a" / f"s{k}.jsonl").write_bytes("".join(f'{{"n": {n}, "t": "ü{"x" * (n * 7 % 90)}"}}\r\n\n' for n in range(200)).encode())
    (tmp_path / "other.bin").write_bytes(b"no\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    return tmp_path


def test_read_in_ranges(spark, folder):
    datasource.register(spark)
    whole = spark.read.format("transcripts").option("path", str(folder)).load()
    cut = spark.read.format("transcripts").option("path", str(folder)).option("split_bytes", 500).load()
    assert cut.rdd.getNumPartitions() > 30 and whole.rdd.getNumPartitions() == 3
    rows = sorted(tuple(r) for r in cut.collect())
    assert rows == sorted(tuple(r) for r in whole.collect()) and len(rows) == 600
    assert all(r[3].startswith('{"n": ') and r[3].endswith('"}') for r in rows)
    data = (folder / "a" / "s1.jsonl").read_bytes()
    assert all(data[r[2] :].startswith(r[3].encode()) for r in rows if r[1] == "s1")


def test_filters_are_pushed(spark, folder):
    datasource.register(spark)
    load = lambda: spark.read.format("transcripts").option("path", str(folder)).option("push", True).load()
    one = load().where("stem = 's1'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 200
    assert load().where("stem in ('s0', 's2') and contains(line, '\"n\": 7,')").count() == 2
    assert load().where("stem = 's1' and stem = 's2'").count() == 0
    assert load().where("contains(line, 'ü') and offset > 0").count() == 597
    reader = datasource.TranscriptReader({"path": str(folder), "push": "true"})
    left = list(reader.pushFilters([datasource.EqualTo(("stem",), "s1"), datasource.EqualTo(("offset",), 3), datasource.StringContains(("line",), "ü")]))
    assert left == [datasource.EqualTo(("offset",), 3)] and len(reader.partitions()) == 1


def test_plans_of_one_load_do_not_mix(spark, folder):
    datasource.register(spark)
    df = spark.read.format("transcripts").option("path", str(folder)).load()
    some = df.where("contains(line, '\"n\": 7,')")
    assert df.join(some.select("stem").distinct(), "stem").count() == 600 and some.count() == 3 and df.count() == 600


def test_stream_follows_growing_files(spark, tmp_path):
    datasource.register(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        stream = spark.readStream.format("transcripts").option("path", str(source)).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out)).awaitTermination()
        return sorted((r["stem"], r["line"]) for r in spark.read.schema(datasource.SCHEMA).parquet(str(out)).collect())

    (source / "a.jsonl").write_text("one\ntw")  # half a line waits
    assert run() == [("a", "one")]
    with (source / "a.jsonl").open("a") as f:
        f.write("o\nthree\n")
    (source / "b.jsonl").write_text("four\n")
    want = [("a", "one"), ("a", "three"), ("a", "two"), ("b", "four")]
    assert run() == want
    assert run() == want  # nothing new
