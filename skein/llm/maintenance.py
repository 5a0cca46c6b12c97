"""Operator 11, late arrivals: a layout of files a day is kept as a view of the latest row of each key, by signed deltas.

A layout is a folder `day=D/file_no=K/` with one Parquet file each: the latest-arrived row of each key, a day's rows sorted by
time and key and cut into files of a fixed number of rows. Late rows change it in six steps:

1. The late rows' latest row of each key meets the stored row of the key.
2. Where it arrived later, it is a winner: minus the old row (if one is stored), plus the new row.
3. The days of these deltas are dirty. Only their files are read again.
4. Their stored rows (weight 1) and the deltas are consolidated: weights of equal rows are summed, what is left has weight 1.
5. The rows are ranked anew within their days and written to the shared folder, before any file of the layout is touched.
6. The dirty days' files are replaced; no other file is opened for writing.

Ranks are made without bringing a day together: rows are dealt by ranges of (day, time, key), numbered within their range and day,
and the ranges' counts are summed up. A hot day spans many ranges. A key's rows meet as maxima that each task has made
before, so a hot key costs a row a task. The driver gets a number of rows, and the list of replaced folders.

A maintenance that is lost after step 5 is repeated from the table of step 5 (`replace_days`): replacing is the same each time.
One writer at a time works on a layout.

Defined results: rows with a null key are one key's; a null time has day -1, and sorts first; a null arrival is the earliest and is
late (it isn't before the limit); of rows that arrived at the same time the largest by the other columns in order is kept; rows
that are equal in all columns are one; -0.0 is 0.0 once rewritten; an empty table makes a layout without files.
Columns other than those named keep their names, types and order, whatever they are, but `day` and `file_no`, which are an error.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, materialize, new_folder

_DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Layout:
    """What a layout is made of: its folder, rows a file, and the names of its columns."""

    folder: str
    file_rows: int
    schema: str
    key: str = "sale_id"
    time: str = "sold_at"
    arrived: str = "arrived_at"

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, day long, file_no long").parquet(self.folder)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970, of a time without a zone as if in UTC; whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp_ntz":
        day = F.unix_date(F.to_date(c)).cast("long")
        return ((day * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_micros(c)


def day_of(df: DataFrame, name: str) -> Column:
    """Whole days since 1970; -1 for a null time."""
    us = micros(df, name)
    plain = dict(df.dtypes)[name] == "timestamp_ntz"
    day = F.unix_date(F.to_date(F.col(name))) if plain else F.round((us - F.pmod(us, F.lit(_DAY_US))) / _DAY_US)
    return F.coalesce(day.cast("long"), F.lit(-1).cast("long"))


def latest(rows: DataFrame, key: str, arrived: str) -> DataFrame:
    """The latest-arrived row of each key; tasks send their own latest only."""
    others = [c for c in rows.columns if c not in (key, arrived)]
    best = rows.groupBy(key).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in (arrived, *others)])).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col(f"_best.`{c}`").alias(c) for c in rows.columns])


def filed(rows: DataFrame, layout: Layout) -> DataFrame:
    """rows (with day) and their file_no, as a table in the shared folder."""
    order = [F.col("day"), F.col(layout.time).asc_nulls_first(), F.col(layout.key).asc_nulls_first()]
    ranges = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    own = W.partitionBy("_range", "day").orderBy(*order[1:])
    numbered = materialize(ranges.withColumn("_place", F.row_number().over(own).cast("long") - 1), "numbered")
    counts = numbered.groupBy("day", "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy("day").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("day", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = numbered.join(starts, ["day", "_range"])
    return placed.withColumn("file_no", F.expr(f"(_start + _place) div {layout.file_rows}")).drop("_range", "_place", "_start")


def _write(rows: DataFrame, layout: Layout, mode: str) -> None:
    """A file for each (day, file_no), written by one task, streaming; of a replaced one Spark puts the new folder in place."""
    order = ["day", "file_no", F.col(layout.time).asc_nulls_first(), F.col(layout.key).asc_nulls_first()]
    dealt = rows.repartition("day", "file_no").sortWithinPartitions(*order)
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy("day", "file_no").parquet(layout.folder)


def create(rows: DataFrame, folder: str, file_rows: int, key: str = "sale_id", time: str = "sold_at", arrived: str = "arrived_at") -> Layout:
    """Writes the layout of the rows into a new folder."""
    if {"day", "file_no"} & {c.lower() for c in rows.columns}:
        raise ValueError("the layout's folders are named day and file_no: rename those columns")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    layout = Layout(folder, file_rows, schema, key, time, arrived)
    best = latest(rows, key, arrived)
    _write(filed(best.withColumn("day", day_of(best, time)), layout), layout, "error")
    return layout


def deltas(spark: SparkSession, layout: Layout, late: DataFrame) -> DataFrame:
    """The signed rows (_weight -1 and 1, with their days) by which late rows change the layout."""
    new = latest(late, layout.key, layout.arrived)
    new = new.withColumn("day", day_of(new, layout.time))
    columns = [*late.columns, "day"]
    old = layout.read(spark).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("old"))
    pairs = new.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("new")).join(old, F.col(f"new.`{layout.key}`").eqNullSafe(F.col(f"old.`{layout.key}`")), "left")

    def rank(side: str) -> Column:
        return F.struct(*[f"{side}.`{c}`" for c in (layout.arrived, *(c for c in late.columns if c not in (layout.key, layout.arrived)))])

    winners = pairs.where(F.col("old").isNull() | (rank("new") > rank("old")))
    signed = F.array(F.struct(F.lit(-1).alias("_weight"), F.col("old").alias("row")), F.struct(F.lit(1).alias("_weight"), F.col("new").alias("row")))
    return winners.select(F.inline(signed)).where("row is not null").select("row.*", "_weight")


def consolidated(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows whose weights add up to more than nothing: the stored ones weigh 1 each."""
    columns = stored.columns
    both = stored.withColumn("_weight", F.lit(1)).unionByName(changes)
    return both.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum("_weight").alias("_weight")).where("_weight > 0").select(*[F.col(f"`{c}`") for c in columns])


def replace_days(spark: SparkSession, layout: Layout, days: DataFrame, rows: DataFrame) -> None:
    """Puts rows (with day, file_no) in the place of all files of the days. May be repeated, after a loss too."""
    had = layout.read(spark).join(days, "day", "left_semi").select("day", "file_no").distinct()
    surplus = had.join(rows.select("day", "file_no").distinct(), ["day", "file_no"], "left_anti").collect()  # folders, as few as files
    _write(rows, layout, "overwrite")
    system = spark._jvm.org.apache.hadoop.fs
    root = system.Path(layout.folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in surplus:
        store.delete(system.Path(root, f"day={r['day']}/file_no={r['file_no']}"), True)


def maintain(spark: SparkSession, layout: Layout, late: DataFrame) -> DataFrame:
    """Makes the layout that of its rows and the late ones; returns the dirty days."""
    changes = materialize(deltas(spark, layout, late), "deltas")
    days = materialize(changes.select("day").distinct(), "dirty-days")
    stored = layout.read(spark).drop("file_no").join(days, "day", "left_semi")
    stored = stored.select(*[F.col(f"`{c}`") for c in changes.columns if c != "_weight"])
    rows = materialize(filed(consolidated(stored, changes), layout), "refiled")
    replace_days(spark, layout, days, rows)
    return days


def _cents(amount: Column) -> Column:
    whole = F.floor(100 * amount.cast("double") + 0.5)
    return F.when(amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")), F.lit(0).cast("long")).otherwise(whole.cast("long"))


def described(spark: SparkSession, layout: Layout, dirty: DataFrame, amount: str = "total") -> DataFrame:
    """A row a file, of what is read back from it: its figures, the digest of its keys in the file's order, whether its day was replaced."""
    rows = layout.read(spark)
    columns = ",".join(c for c in rows.columns if c not in ("day", "file_no"))
    text = [F.coalesce(micros(rows, c).cast("string"), F.lit("")) for c in (layout.time, layout.arrived)]
    crc = F.crc32(F.concat_ws(":", F.coalesce(F.col(layout.key).cast("string"), F.lit("")), *text).cast("binary"))
    read = rows.select("day", "file_no", F.col("_metadata.row_index").alias("place"), F.col(layout.key).cast("string").alias("key"), _cents(F.col(amount)).alias("cents"), crc.alias("crc"))
    schema = pa.schema([("day", pa.int64()), ("file_no", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())])

    def digest(batches):
        """Files come one after another, their rows in order: one digest is open at a time."""
        now, open_ = None, None
        for b in batches:
            day, number, _, keys, cents, crcs = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(day):
                end = at
                while end < len(day) and day[end] == day[at] and number[end] == number[at]:
                    end += 1
                own = (day[at], number[at])
                if own != now:
                    if open_:
                        yield batch(dict(zip(schema.names, [[x] for x in (*now, *open_[:3], open_[3].hexdigest())], strict=True)), schema)
                    now, open_ = own, [0, 0, 0, hashlib.sha256()]
                open_[3].update((("," if open_[0] else "") + ",".join(k or "" for k in keys[at:end])).encode())
                open_[0] += end - at
                open_[1] += sum(cents[at:end])
                open_[2] += sum(crcs[at:end])
                at = end
        if open_:
            yield batch(dict(zip(schema.names, [[x] for x in (*now, *open_[:3], open_[3].hexdigest())], strict=True)), schema)

    figures = read.repartition("day", "file_no").sortWithinPartitions("day", "file_no", "place").mapInArrow(digest, "day long, file_no long, n_rows long, cents long, rows_crc long, ids_sha256 string")
    paths = rows.select("day", "file_no", F.col("_metadata.file_path").alias("path")).distinct()
    out = figures.join(paths, ["day", "file_no"]).join(dirty.select("day", F.lit(True).alias("rewritten")), "day", "left")
    return out.select("day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(columns).alias("columns"), "ids_sha256", F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


def with_copies(sales: DataFrame) -> DataFrame:
    """The rows of a shop's sales and, for a third of the sales on every seventh day, a copy that arrives later with another total and perhaps day."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    chosen = sales.where((F.pmod(h, F.lit(3)) == 0) & (F.pmod(day_of(sales, "sold_at"), F.lit(7)) == 0))

    def later(name: str, days: Column) -> Column:
        return (F.col(name) + F.make_dt_interval(days.cast("int"))).cast(dict(sales.dtypes)[name]).alias(name)

    changed = {"total": (F.col("total") + 1).alias("total"), "sold_at": later("sold_at", F.pmod(h, F.lit(2))), "arrived_at": later("arrived_at", 1 + F.pmod(h, F.lit(97)))}
    return sales.unionByName(chosen.select(*[changed.get(c, F.col(f"`{c}`")) for c in sales.columns]))


def sales_layout(sales: DataFrame, limit: str = "2024-04-10 00:00:00") -> DataFrame:
    """The layout of early sales made that of all sales: a row a file."""
    spark = sales.sparkSession
    rows = with_copies(sales)
    early = F.coalesce(F.col("arrived_at") < F.lit(limit).cast(dict(sales.dtypes)["arrived_at"]), F.lit(False))
    layout = create(rows.where(early), new_folder(spark, f"sales-{uuid.uuid4().hex[:6]}"), 1 + sales.count() // 700)
    return described(spark, layout, maintain(spark, layout, rows.where(~early)))
