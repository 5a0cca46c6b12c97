"""Stateful streams: degradation of sessions, leases that run out by timers, calls that meet their results.

State is kept in RocksDB, which `transformWithState` needs: call `use_rocksdb` before a query starts. Rows of a micro-batch are put in order
within their key; batches of a key are in order of arrival.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of queries that start from here on is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


@contextmanager
def few_keys(spark: SparkSession, keys: int):
    """Queries that start in here keep their state in one partition a key at most: each starts a store and a worker a micro-batch, rows or not."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(keys, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def target_of(name: str, inputs: str | None) -> str:
    """What `functions.text.tool_target` gives, of one call."""
    try:
        given = json.loads(inputs or "{}")
    except ValueError:
        given = inputs
    said = lambda k: given.get(k) or "" if isinstance(given, dict) else ""
    if name == "Bash":
        return said("command")[:160]
    if name in ("Edit", "Write", "Read", "NotebookEdit"):
        return said("file_path")
    return given[:120] if isinstance(given, str) else json.dumps(given, sort_keys=True, separators=(",", ":"), ensure_ascii=False)[:120]


DEGRADED = "session string, seq long, event string, tool string, target string, detail string, turn long, working long, total long"


def last_up_to(known: np.ndarray) -> np.ndarray:
    """The place of the last known row up to each row, itself included; -1 where there is none."""
    return np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))


class Degradation(StatefulProcessor):
    """All six kinds of events of a session's records, as `operators.degradation.events` gives them.

    Rows are `parts`. State of a session: open calls by id (with a time to live), which pairs of old and new were edited in which file,
    the run of errors, and the fuel. A call that was asked longer ago than the time to live is forgotten: its result then has no tool
    and target. What a micro-batch holds itself is worked out by columns; the state is asked for what came before it.
    """

    def __init__(self, call_ttl_ms: int | None = None):
        self.ttl = call_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", "id string", "tool string, target string", self.ttl)
        self.edits = handle.getMapState("edits", "file string, old string, new string", "seq long")
        self.now = handle.getValueState("now", "told string, turn long, request string, asked boolean, floor long, total long, run long, target string")

    def _answered(self, part, ids, names, inputs):
        """Places of the results, and tool and target of the last call before each; calls go to the state."""
        met = np.flatnonzero((part == "call") | (part == "result"))
        codes, _ = pd.factorize(ids[met])
        met, codes = (x[np.argsort(codes, kind="stable")] for x in (met, codes))
        call = part[met] == "call"
        tools, targets = np.full(len(part), "", object), np.full(len(part), "", object)
        for i in met[call]:
            tools[i] = names[i] or ""
            targets[i] = target_of(tools[i], inputs[i])
        before = last_up_to(call)
        own = (before >= 0) & (codes[before] == codes)
        answered = own & ~call
        for x in (tools, targets):
            x[met[answered]] = x[met[before[answered]]]
        asked = {}
        for i in met[~own & (codes >= 0)]:
            name = ids[i]
            if name not in asked:
                asked[name] = self.calls.getValue((name,)) if self.calls.containsKey((name,)) else ("", "")
            tools[i], targets[i] = asked[name]
        for name, i in dict(zip(ids[met[call]], met[call])).items():  # a name's last call
            self.calls.updateValue((name,), (tools[i], targets[i]))
        return np.sort(met[~call]), tools, targets

    def _undone(self, files, olds, news, seqs):
        """Places of edits that reverse an earlier one; edits go to the state."""
        known, first, out = {}, {}, []
        for i in np.flatnonzero(pd.notna(olds)):
            back, own = (files[i], news[i], olds[i]), (files[i], olds[i], news[i])
            for edit in (back, own):
                if edit not in known:
                    known[edit] = self.edits.containsKey(edit)
            if known[back]:
                out.append(i)
            if not known[own]:
                known[own], first[own] = True, int(seqs[i])
        for edit, seq in first.items():
            self.edits.updateValue(edit, (seq,))
        return np.array(out, dtype=int)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told, turn, request, asked, floor, total, run, target = self.now.get() if self.now.exists() else (None, 0, None, False, 0, 0, 0, "")
        records = pd.concat(list(rows)).sort_values(["seq", "at"], kind="stable")
        r = {c: records[c].to_numpy() for c in records.columns}
        del records
        n = len(r["seq"])

        said = last_up_to(pd.notna(r["told"]))
        session = r["told"][said]
        session[said < 0] = told if told is not None else key[0]
        told = session[-1] if said[-1] >= 0 else told

        answers = np.flatnonzero(pd.notna(r["request"]))
        starts = np.zeros(n, dtype=np.int64)
        if len(answers):
            own = r["request"][answers]
            starts[answers] = own != np.concatenate([np.array([request], object), own[:-1]])
            starts[answers[0]] |= not asked
            request, asked = own[-1], True
        turns = turn + np.cumsum(starts)

        known = r["fill"] > 0
        filled = last_up_to(known)
        totals = np.where(filled >= 0, r["fill"][filled], total)
        floors = np.full(n, floor, dtype=np.int64)
        if not floor and known.any():
            floors[known.argmax():] = r["fill"][known.argmax()]
        working = np.maximum(0, totals - floors)

        results, tools, targets = self._answered(r["part"], r["id"], r["name"], r["input"])
        wrong, on = r["error"][results], targets[results]
        if len(results):
            goes_on = wrong & np.concatenate([[run > 0], wrong[:-1]]) & (on != "") & (on == np.concatenate([np.array([target], object), on[:-1]]))
            place, begun = np.arange(len(results)), last_up_to(~goes_on)
            runs = np.where(begun >= 0, place - begun + 1, place + 1 + run)
            run, target = (int(runs[-1]), on[-1]) if wrong[-1] else (0, "")
        else:
            runs = np.zeros(0, dtype=np.int64)

        def tell(at, event, tool, on, detail, working=working, total=totals):
            return pd.DataFrame({"session": session[at], "seq": r["seq"][at], "event": event, "tool": tool, "target": [x[:200] for x in on], "detail": detail, "turn": turns[at], "working": working[at], "total": total[at]})

        other = np.flatnonzero(pd.notna(r["other"]))
        pre = r["pre"]
        undone = self._undone(r["file"], r["old"], r["new"], r["seq"])
        bad = results[wrong]
        out = [
            tell(bad, np.where(runs[wrong] >= 2, "tool_thrash", "tool_error"), tools[bad], targets[bad], r["content"][bad]),
            tell(other, r["other"][other], r["tool"][other], r["file"][other], r["detail"][other], np.where(pre != 0, np.maximum(0, pre - floors), working), np.where(pre != 0, pre, totals)),
            tell(undone, "edit_revert", "Edit", r["file"][undone], "edit reverts an earlier edit to this file"),
        ]
        self.now.update((told, int(turns[-1]), request, asked, int(floors[-1]), int(totals[-1]), run, target))
        yield pd.concat(out)


def parts(fields: DataFrame) -> DataFrame:
    """`operators.degradation.fields` as flat rows: one a block, one for a record without; what isn't a block's stands in a record's first row only.

    part: call or result. request: of answers. other: interrupted, truncation or compact_boundary, with its tool, file and detail.
    """
    rows = fields.select("*", F.posexplode_outer("blocks").alias("_at", "b")).drop("blocks").withColumn("at", F.coalesce("_at", F.lit(0)))
    first, user, none = F.col("at") == 0, F.col("type") == "user", F.lit("")
    call = F.col("main") & (F.col("b.type") == "tool_use") & F.col("b.id").isNotNull()
    result = user & (F.col("b.type") == "tool_result")
    error = F.coalesce(result & F.col("b.is_error"), F.lit(False))
    stopped, cut = first & user & F.col("interrupted"), first & F.col("main") & (F.col("stop") == "max_tokens")
    bound = first & (F.col("type") == "system") & (F.col("subtype") == "compact_boundary")
    edit = first & user & (F.col("file") != "") & F.col("old").isNotNull() & F.col("new").isNotNull()
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return rows.select(
        "stem",
        "seq",
        "at",
        F.when(first, F.col("told")).alias("told"),
        F.when(first & F.col("main"), F.coalesce("request", none)).alias("request"),
        F.when(first, F.col("fill")).otherwise(0).cast("long").alias("fill"),
        F.when(call, "call").when(result, "result").alias("part"),
        F.when(call, F.col("b.id")).when(result, F.col("b.tool_use_id")).alias("id"),
        F.when(call, F.col("b.name")).alias("name"),
        F.when(call, F.col("b.input")).alias("input"),
        error.alias("error"),
        F.when(error, F.substring(F.coalesce("b.content", F.lit("None")), 1, 160)).alias("content"),
        F.when(stopped, "interrupted").when(cut, "truncation").when(bound, "compact_boundary").alias("other"),
        F.when(bound, F.when(F.col("trigger") != "", F.col("trigger")).otherwise("?")).otherwise(none).alias("tool"),
        F.when(stopped | edit, F.coalesce("file", none)).otherwise(none).alias("file"),
        F.when(stopped, "tool call interrupted").when(cut, "assistant stop_reason=max_tokens").when(bound, F.substring(F.concat(F.lit("pre="), said("pre"), F.lit(" post="), said("post")), 1, 200)).alias("detail"),
        F.when(bound, F.coalesce("pre", F.lit(0))).otherwise(0).cast("long").alias("pre"),
        F.when(edit, F.col("old")).alias("old"),
        F.when(edit, F.col("new")).alias("new"),
    )


def degradation(fields: DataFrame, call_ttl_ms: int | None = None) -> DataFrame:
    """STR1, WIN6-10, JN20: events of a stream of `operators.degradation.fields`, each with the fuel at which it happened."""
    mode = "ProcessingTime" if call_ttl_ms else "None"
    return parts(fields).groupBy("stem").transformWithStateInPandas(Degradation(call_ttl_ms), DEGRADED, "Append", mode)


EXPIRED = "resource long, holder long, since timestamp, expired timestamp"


class Leases(StatefulProcessor):
    """The lease that stands on a resource; a timer at its end gives its expiry without another row."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "holder long, since long")

    def _frame(self, rows):
        made = [(r, h, pd.Timestamp(since, unit="us"), pd.Timestamp(since + self.ttl * 1000, unit="us")) for r, h, since in rows]
        return pd.DataFrame(made, columns=["resource", "holder", "since", "expired"]).astype({"since": "datetime64[us]", "expired": "datetime64[us]"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over = []
        holder, since = self.lease.get() if self.lease.exists() else (None, None)
        if since is not None:
            self.handle.deleteTimer((since + self.ttl * 1000) // 1000)
        for at, own in pd.concat(list(rows)).sort_values(["at_us", "holder"])[["at_us", "holder"]].itertuples(index=False):
            if since is not None and at - since > self.ttl * 1000:
                over.append((key[0], holder, since))
            holder, since = int(own), int(at)
        self.lease.update((holder, since))
        self.handle.registerTimer((since + self.ttl * 1000) // 1000)
        yield self._frame(over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        holder, since = self.lease.get()
        if (since + self.ttl * 1000) // 1000 != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.lease.clear()
        yield self._frame([(key[0], holder, since)])


def expiries(claims: DataFrame, ttl_ms: int, late: str = "1 day") -> DataFrame:
    """STR5, CRD2: leases (resource, holder, at) that no later claim renewed or took within their time: by a timer once the watermark has passed their end."""
    rows = claims.select(F.col("resource").cast("long"), F.col("holder").cast("long"), F.col("at").cast("timestamp").alias("at")).withColumn("at_us", F.unix_micros("at"))
    return rows.withWatermark("at", late).groupBy("resource").transformWithStateInPandas(Leases(ttl_ms), EXPIRED, "Append", "EventTime")


def answered(calls: DataFrame, results: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """JN20, STR3: calls (key, call_id, called) with the results (key, result_id, given) that come within a time after them; a call
    without one is a row with nulls, once the watermarks have passed the end of its time."""
    c = calls.withWatermark("called", late).alias("c")
    r = results.withColumnRenamed("key", "result_key").withWatermark("given", late).alias("r")
    met = F.expr(f"key = result_key and given >= called and given <= called + interval {within}")
    return c.join(r, met, "left_outer").drop("result_key")


def merge_into(spark: SparkSession, path: str, batch: DataFrame, batch_id: int, key: str, add: list[str], least: list[str], greatest: list[str], buckets: int = 16) -> int:
    """MUT1, KG6, STR2: merges a batch's rows into a table of hash buckets; only touched buckets are written. Returns how many.

    A bucket's rows carry the last batch that went into it, so a batch that comes again - after a loss between two buckets too -
    changes nothing where it was merged before. Rows of a key are summed up before they meet the table: a hot key is a row.
    The merged buckets are written beside the table first; Spark then puts each whole bucket in the old one's place.
    """
    sums = [F.sum(c).alias(c) for c in add] + [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in greatest]
    columns = [key, *add, *least, *greatest]
    own = batch.groupBy(key).agg(*sums).select(*columns)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = own.withColumn("bucket", bucket)
    staged = f"{path}/_staged/{batch_id}"
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{staged}/delta")
    kinds = ", ".join(f"`{c}` {t}" for c, t in own.dtypes)
    new = spark.read.schema(f"{kinds}, bucket int").parquet(f"{staged}/delta")
    touched = new.select("bucket").distinct()
    spark.createDataFrame([], f"{kinds}, batch long, bucket int").write.mode("append").partitionBy("bucket").parquet(f"{path}/table")
    table = spark.read.schema(f"{kinds}, batch long, bucket int").parquet(f"{path}/table").join(touched, "bucket", "left_semi")
    done = table.groupBy("bucket").agg(F.max("batch").alias("batch")).where(F.col("batch") >= batch_id).select("bucket")
    table, new = (df.join(done, "bucket", "left_anti") for df in (table, new))
    merged = table.select(*columns, "bucket").unionByName(new).groupBy(key, "bucket").agg(*sums).withColumn("batch", F.lit(batch_id).cast("long"))
    merged.select(*columns, "batch", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{staged}/merged")
    ready = spark.read.schema(f"{kinds}, batch long, bucket int").parquet(f"{staged}/merged")
    count = ready.select("bucket").distinct().count()
    ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/table")
    return count


def merge_stream(stream: DataFrame, path: str, checkpoint: str, **how):
    """A running query that merges each micro-batch (`merge_into`); what is there is merged, then it ends."""
    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(lambda batch, n: merge_into(spark, path, batch, n, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
