"""What the operators share: a shared folder, written tables and views of Arrow text as bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a temporary one only where that is unset and all runs in one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(sc, "_skein_shared", None)
        if folder is None:
            folder = sc._skein_shared = "file://" + tempfile.mkdtemp(prefix="skein-")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that the JVM and a Python worker hold as one Arrow batch while a table is written.
ARROW_ROWS = 4096
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs at most the running stage, and rows that
    depend on task-local state (ranks, file offsets) are fixed from here on. What the write has shuffled is
    removed at its end, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    rows, cleanup = spark.conf.get(_BATCH), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_BATCH, str(min(ARROW_ROWS, int(rows)) if int(rows) > 0 else ARROW_ROWS))
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
        spark.conf.set(_CLEANUP, cleanup)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more rows than this part of all, and than so many, is dealt out over several tasks; not in a table of few rows.
HOT, HOT_ROWS, FEW_ROWS = 1024, 256, 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "left", sizes: DataFrame | None = None) -> DataFrame:
    """rows joined with groups (a row a key; size: how many of the total rows have it); no task gets much more than a HOT-th of the rows for one key.

    Keys with more rows than that - HOT of them at most, so their list is broadcast - are salted,
    and their row of groups is repeated once a salt. Rows with a null key find nothing. sizes: keys and
    sizes of the groups, where groups would be costly to compute for them.
    """
    if (total or 0) <= FEW_ROWS:
        return rows.join(groups, keys, how)
    salts = F.ceil(F.col(size) / max(HOT_ROWS, -(-(total or 0) // HOT))).cast("int")
    hot = (groups if sizes is None else sizes).where(salts > 1).select(*keys, salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts").cast("long")).cast("int"), F.lit(0)))
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt", "_salts")


def _give_back() -> None:
    """Returns memory to the system that the worker's earlier tasks have freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small(batches, rows: int = 2048):
    """The rows of Arrow batches, some at a time: what is made of them in Python is bounded by that."""
    _give_back()
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    _give_back()


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its n + 1 offsets into them; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, most: int):
    """Runs (first, last) of texts with at most `most` bytes together, one text at least."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
