"""Bursts and rates of an event stream (rec_id, ts timestamp). Late events are dropped behind the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_islands(events: DataFrame, gap_micros: int, delay: str, min_n: int = 2) -> DataFrame:
    """(rec_id, start, stop, n) of runs of events less than the gap apart. A session also joins events that are just the gap apart, so it is one microsecond shorter."""
    gap = f"{gap_micros - 1} microseconds"
    runs = events.withWatermark("ts", delay).groupBy("rec_id", F.session_window("ts", gap))
    return runs.agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n")).where(F.col("n") >= min_n).select("rec_id", "start", "stop", "n")


def stream_rates(events: DataFrame, window: str, delay: str) -> DataFrame:
    """(rec_id, start, stop, n) of events in windows that follow one another."""
    cells = events.withWatermark("ts", delay).groupBy("rec_id", F.window("ts", window)).agg(F.count("*").alias("n"))
    return cells.select("rec_id", F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n")


def stream_refractory(events: DataFrame, dead_time: int) -> DataFrame:
    """(rec_id, t) of events (rec_id, t in microseconds) kept: the first, then each that is at least dead_time after the last kept.

    The state of a recording is the last time kept. Events of a batch are sorted first; one that comes in a later batch than its
    time asks for, before the last kept, is dropped.
    """
    kind = events.schema["rec_id"].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for f in frames for t in f["t"].tolist()):
            if last is None or t - last >= dead_time:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"rec_id": [key[0]] * len(kept), "t": pd.Series(kept, dtype="int64")})

    known = events.select("rec_id", "t").where("rec_id IS NOT NULL AND t IS NOT NULL")
    return known.groupBy("rec_id").applyInPandasWithState(run, f"rec_id {kind}, t long", "last long", "append", GroupStateTimeout.NoTimeout)
