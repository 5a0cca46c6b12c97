"""Streams: event-time windows, deduplication, per-session folds and cursors.

The batch operators in skein.operators.sequences are the reference for what these give on a finished stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """STR7: counts a window and key; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def gaps(events: DataFrame, ts: str, key: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """STR7: session windows."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def once(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """STR4: each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def error_runs(events: DataFrame, session: str = "user_id", order: tuple[str, str] = ("ts", "event_id"), idle_ms: int | None = None) -> DataFrame:
    """STR1, WIN9: errors of each session with the length of their run so far.

    events: session, ts, event_id, is_error, target. The state is the run's length and target. Rows of a
    micro-batch are put in order; order across batches is that of arrival.
    """
    out = f"{session} long, event_id long, run long, event string"

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, target = state.get if state.exists else (0, "")
        rows = pd.concat(list(batches)).sort_values(list(order))
        found = []
        for event, error, on in zip(rows["event_id"], rows["is_error"], rows["target"], strict=True):
            if not error:
                run, target = 0, ""
                continue
            run, target = (run + 1 if run and on and on == target else 1), on or ""
            found.append((key[0], event, run, "tool_thrash" if run >= 2 else "tool_error"))
        state.update((run, target))
        yield pd.DataFrame(found, columns=[session, "event_id", "run", "event"])

    return events.groupBy(session).applyInPandasWithState(fold, out, "run long, target string", "append", GroupStateTimeout.NoTimeout)


def cursors(events: DataFrame, session: str = "user_id", most: int = 6) -> DataFrame:
    """STR3, CRD6: new events for each reader, `most` at a time; what overflows stays in the state for the next batch."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        waiting += sorted(int(x) for b in batches for x in b["event_id"])
        shown, rest = waiting[:most], waiting[most:]
        state.update((rest,))
        yield pd.DataFrame({session: [key[0]] * len(shown), "event_id": shown, "overflow": [bool(rest)] * len(shown)})

    return events.groupBy(session).applyInPandasWithState(fold, f"{session} long, event_id long, overflow boolean", "waiting array<bigint>", "append", GroupStateTimeout.NoTimeout)


def append_log(events: DataFrame, path: str, checkpoint: str, redact=None, once: bool = True):
    """STR8, MUT20: an append-only log; `redact` masks rows before they are stored. Returns the running query, which ends with what is there (`once`) or goes on."""
    writer = (redact(events) if redact else events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet")
    return (writer.trigger(availableNow=True) if once else writer).start(path)
