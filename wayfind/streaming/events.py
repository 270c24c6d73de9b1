"""Streaming over events: windows, sessions, once-only and rationed calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counts_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by event type; a stream drops what is later than the watermark."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key; a stream remembers keys as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def rationed(calls: DataFrame, per_hour: int, per_day: int) -> DataFrame:
    """caller, call_id, at, admitted of a stream calls(caller, call_id, at).

    The calls of a caller in one trigger are judged in order of time, to the microsecond.
    The state holds the last day's admitted times, and goes when a caller has been silent
    for two days.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["at", "call_id"], kind="stable")
        out = []
        for at in pdf["at"].map(lambda t: int(t.value // 1000)):
            kept = [t for t in kept if t > at - 86_400_000_000]
            ok = len(kept) < per_day and sum(t > at - 3_600_000_000 for t in kept) < per_hour
            if ok:
                kept.append(at)
            out.append(ok)
        state.update((kept,))
        state.setTimeoutDuration(172_800_000)
        yield pdf.assign(admitted=out)[["caller", "call_id", "at", "admitted"]]

    return calls.groupBy("caller").applyInPandasWithState(admit, "caller long, call_id long, at timestamp, admitted boolean", "kept array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
