"""Late arrivals against a layout that is made anew in plain Python, on the driver's sales and on odd rows."""

import collections
import datetime
import hashlib
import math
import os
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skein.llm import maintenance
from skein.llm.common import new_folder

EPOCH, DAY = datetime.datetime(1970, 1, 1), datetime.timedelta(days=1)
COLUMNS = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def day(t):
    return -1 if t is None else (t - EPOCH).days


def us(t):
    return "" if t is None else str((t - EPOCH) // datetime.timedelta(microseconds=1))


def ordered(x):
    return (x is not None, x if x is not None else 0)


def copied(rows):
    out = list(rows)
    for r in rows:
        if r["sale_id"] is None:
            continue
        h = zlib.crc32(str(r["sale_id"]).encode())
        if h % 3 == 0 and day(r["sold_at"]) % 7 == 0:
            out.append(r | {"total": None if r["total"] is None else r["total"] + 1, "sold_at": r["sold_at"] + DAY * (h % 2), "arrived_at": None if r["arrived_at"] is None else r["arrived_at"] + DAY * (1 + h % 97)})
    return out


def layout(rows, size):
    best = {}
    for r in rows:
        rank = tuple(ordered(r[c]) for c in ("arrived_at", "client_id", "status", "total", "sold_at", "priority"))
        if r["sale_id"] not in best or rank > best[r["sale_id"]][0]:
            best[r["sale_id"]] = rank, r
    days = collections.defaultdict(list)
    for _, r in best.values():
        days[day(r["sold_at"])].append(r)
    files = {}
    for d, own in days.items():
        own.sort(key=lambda r: (ordered(r["sold_at"]), ordered(r["sale_id"])))
        for k in range(0, len(own), size):
            files[d, k // size] = own[k : k + size]
    return files, {k: r for k, (_, r) in best.items()}


def expected(rows, limit=datetime.datetime(2024, 4, 10)):
    size = 1 + len(rows) // 700
    rows = copied(rows)
    late = [r["arrived_at"] is None or r["arrived_at"] >= limit for r in rows]
    start, had = layout([r for r, x in zip(rows, late, strict=True) if not x], size)
    end, best = layout(rows, size)
    late_rows = {id(r) for r, x in zip(rows, late, strict=True) if x}
    dirty = set()
    for key, r in best.items():
        if id(r) in late_rows:
            dirty.add(day(r["sold_at"]))
            if key in had:
                dirty.add(day(had[key]["sold_at"]))
    out = {}
    for (d, k), own in end.items():
        cents = sum(0 if r["total"] is None else math.floor(100 * r["total"] + 0.5) for r in own)
        crc = sum(zlib.crc32(f"{'' if r['sale_id'] is None else r['sale_id']}:{us(r['sold_at'])}:{us(r['arrived_at'])}".encode()) for r in own)
        ids = hashlib.sha256(",".join("" if r["sale_id"] is None else str(r["sale_id"]) for r in own).encode()).hexdigest()
        out[d, k] = (len(own), cents, crc, ids, d in dirty)
    return out, end, start, dirty


def check(got, want, end):
    assert {(r["day"], r["file_no"]): (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in got} == want
    assert len(got) == len(want) and len({r["path"] for r in got}) == len(got)
    for r in got:
        assert r["columns"] == ",".join(COLUMNS)
        table = pq.ParquetFile(r["path"].removeprefix("file:")).read()
        assert table.column_names == COLUMNS
        assert table.to_pylist() == [{c: x[c] for c in COLUMNS} for x in end[r["day"], r["file_no"]]]
    if got:
        root = got[0]["path"].removeprefix("file:").split("/day=")[0]
        there = {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}
        assert there == {"/" + r["path"].removeprefix("file:").lstrip("/") for r in got}


def odd_rows():
    t = datetime.datetime(2024, 4, 1, 3)
    late = datetime.datetime(2024, 5, 1)
    rows = [(k, 1, "x", float(k), t + DAY * (k % 3), t, 0) for k in range(40)]
    rows += [(k, 1, "y", float(k), t + DAY * (k % 5), late, 0) for k in range(0, 40, 4)]  # other days, later
    rows += [(k, 2, "z", 1.5, t + DAY * 9, late, 0) for k in (100, 101)]  # new keys on a new day
    rows += [(7, 9, "old", 3.0, t + DAY * 20, t - DAY, 0)]  # never kept
    rows += [(8, 1, "tie", None, t, t, 5), (8, 1, "tie", None, t, t, 5), (None, 1, None, None, None, None, None), (None, 3, "n", 2.25, t, t, None), (9, 1, "n", -0.375, None, late, 1)]
    return [dict(zip(COLUMNS, r, strict=True)) for r in rows]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_odd_rows(spark, zone):
    rows = odd_rows()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)
        want, end, _, _ = expected(rows)
        check(maintenance.sales_layout(df).collect(), want, end)
        assert maintenance.sales_layout(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sales(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/sales.parquet")
    rows = [r.asDict() for r in df.collect()]
    want, end, start, dirty = expected(rows)
    got = maintenance.sales_layout(df).collect()
    check(got, want, end)
    assert any(not r["rewritten"] for r in got) and any(r["rewritten"] for r in got)


def test_untouched_files_and_repeats(spark):
    """Clean days keep their very files; replacing the same days again changes no row; surplus files go."""
    t = datetime.datetime(2024, 1, 1)
    rows = [(k, k % 3, "a", 1.0, t + DAY * (k % 4), t, 0) for k in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    layout_ = maintenance.create(df, new_folder(spark, "layout-test"), 7)
    root = layout_.folder.removeprefix("file://")

    def files():
        return {os.path.relpath(os.path.join(d, f), root): (open(os.path.join(d, f), "rb").read(), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}

    before = files()
    assert len(before) == 4 * 3
    late = spark.createDataFrame([(k, 0, "b", 2.0, t + DAY, t + DAY * 2, 0) for k in range(0, 60, 4)] + [(1, 1, "late but older", 0.0, t, t - DAY, 0)], SCHEMA)
    changes = maintenance.deltas(spark, layout_, late)
    assert sorted(r["_weight"] for r in changes.collect()) == [-1] * 15 + [1] * 15
    first = (t - EPOCH).days
    days = maintenance.maintain(spark, layout_, late)
    assert sorted(r["day"] for r in days.collect()) == [first, first + 1]
    after = files()
    kept = [f for f in before if f"day={first + 2}/" in f or f"day={first + 3}/" in f]
    assert kept and all(after[f] == before[f] for f in kept) and len([f for f in after if f"day={first}/" in f]) == 1
    assert not [f for f in before if f"day={first}/" in f and f in after]
    rows_ = {tuple(r) for r in layout_.read(spark).collect()}
    assert len(rows_) == 80
    again = layout_.read(spark).where(F.col("day").isin(first, first + 1)).collect()
    maintenance.replace_days(spark, layout_, days, spark.createDataFrame(again, layout_.read(spark).schema))
    assert {tuple(r) for r in layout_.read(spark).collect()} == rows_
    assert maintenance.maintain(spark, layout_, late).count() == 0  # nothing arrives later than what is stored


def test_other_columns(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, t, 1, "x"), (1, t, t + DAY, 2, None)], "sale_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, weight int, `a b` string")
    layout_ = maintenance.create(df, new_folder(spark, "layout-test"), 7)
    got = layout_.read(spark).collect()
    assert [tuple(r)[:5] for r in got] == [(1, t, t + DAY, 2, None)]
    with pytest.raises(ValueError, match="day"):
        maintenance.create(df.withColumnRenamed("weight", "Day"), new_folder(spark, "layout-test"), 7)
