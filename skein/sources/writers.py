"""Writers: versioned tables, corpus partitions, staged records, guarded paths."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def guard_path(path: str, root: str) -> str:
    """SNK11: the path, if it lies below the root."""
    import posixpath

    full = posixpath.normpath(path)
    if not (full + "/").startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{path} is outside {root}")
    return full


def publish(df: DataFrame, root: str, keep: str | None = None) -> str:
    """SNK9, §2.10: writes a new version of a table beside the old ones and then names it as the current one.

    Readers of the version before aren't disturbed. One writer at a time: `keep` is the version that the caller read, and publishing
    fails if another has been named before it begins, but two that begin together both win.
    """
    spark = df.sparkSession
    if keep is not None and current(spark, root) != keep:
        raise RuntimeError("the table has a newer version")
    version = f"v{time.time_ns()}"
    df.write.parquet(f"{root}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{root}/_current")
    return version


def current(spark: SparkSession, root: str) -> str:
    return spark.read.parquet(f"{root}/_current").agg(F.max("version")).first()[0]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current(spark, root)}")


def write_corpus(entries: DataFrame, path: str, at: str, least_score: float = 0.55) -> None:
    """SNK3, DTM4: kept entries in month partitions, append only."""
    kept = entries.where(F.col("score") >= least_score).withColumn("month", F.date_format(F.col(at), "yyyy-MM"))
    kept.write.mode("append").partitionBy("month").parquet(path)


def write_deltas(lines: DataFrame, path: str) -> None:
    """SNK4: lines fanned out by domain, as text."""
    lines.select("domain", F.col("line").alias("value")).write.mode("append").partitionBy("domain").text(path)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """What write_deltas wrote: domain, value; a folder without a line gives no rows."""
    back = spark.read.option("lineSep", "\n").text(path)
    return back.select("domain", "value") if "domain" in back.columns else back.select(F.lit(None).cast("string").alias("domain"), "value")


def staging_rest(staged: DataFrame, promoted: DataFrame, key: str = "fact_key") -> DataFrame:
    """SNK10: what is still to be promoted."""
    return staged.join(promoted.select(key).distinct(), key, "left_anti")


def memory_lines(facts: DataFrame, per_domain: int, most_lines: int = 180) -> DataFrame:
    """SNK6: the best facts a domain as markdown bullets, within a total (a bounded report)."""
    from pyspark.sql import Window

    best = facts.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "id"))).where(F.col("n") <= per_domain)
    return best.orderBy("domain", "n").limit(most_lines).select("domain", "n", F.concat(F.lit("- "), F.col("text")).alias("line"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below `spark.checkpoint.dir`; a temporary one only where that is unset and all runs in one process."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(sc, "_skein_scratch", None)
        if root is None:
            root = sc._skein_scratch = "file://" + tempfile.mkdtemp(prefix="skein-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a write in this block has shuffled is removed at its end, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes df as a Parquet table and reads it back; nothing that the write shuffled stays on disk."""
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def archive(entries: DataFrame, path: str, most: int = 2000) -> None:
    """SNK5: sessions' entries (session, seq, is_summary, blocks) with their bloat stripped, as JSON lines by session, in order."""
    from skein.operators.bloat import strip_entries

    pruned = strip_entries(entries, most).repartition("session").sortWithinPartitions("session", "seq")
    pruned.write.partitionBy("session").json(path)
