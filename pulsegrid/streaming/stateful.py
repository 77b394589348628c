"""Thinning and change alarms of event streams in event time, by a state of their own for each recording.

Events wait in the state until the watermark has passed them, then they are taken in order of time, whatever order they came in. What
comes out is what the batch operators give for the same events, as long as none is later than the watermark allows; later ones are
left out by Spark. A recording that is silent for `keep` is forgotten, and begins anew if it comes back.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.functions import SECOND
from pulsegrid.operators.signal import cusum

#: Events of neighbouring buckets that share one entry of the state: each entry costs calls from Python to Spark.
ENTRY = 4_096


class _InOrder(StatefulProcessor):
    """Keeps events (t, v) until the watermark has passed them and hands them on in order.

    They wait in buckets of `span` microseconds; buckets that follow one another and have few events wait in the entry of the first.
    """

    def __init__(self, keep: int, span: int):
        self.keep, self.span = keep, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "ts array<long>, vs array<double>")
        self.last = handle.getValueState("last", "t long, before double, up double, down double, n long")

    def _entries(self) -> set[int]:
        return {b for (b,) in self.waiting.keys()}

    def _held(self, bucket: int) -> list[tuple[int, float]]:
        ts, vs = self.waiting.getValue((bucket,))
        return list(zip(ts, vs, strict=True))

    def _hold(self, bucket: int, events: list[tuple[int, float]]) -> None:
        self.waiting.updateValue((bucket,), ([int(t) for t, _ in events], [float(v) for _, v in events]))

    def _hold_all(self, events: list[tuple[int, float]], entries: set[int]) -> None:
        """Adds events to the entries there are, and tells entries of new ones."""
        by_bucket: dict[int, list] = {}
        for e in events:
            by_bucket.setdefault(e[0] // self.span, []).append(e)
        packs: list[dict[int, list]] = []
        size = 0
        for bucket in sorted(by_bucket):
            size += len(by_bucket[bucket])
            if packs and size <= ENTRY:
                packs[-1][bucket] = by_bucket[bucket]
            else:
                packs.append({bucket: by_bucket[bucket]})
                size = len(by_bucket[bucket])
        for pack in packs:
            first = next(iter(pack))
            old = self._held(first) if first in entries else []
            if old and len(old) + sum(map(len, pack.values())) > ENTRY:
                for bucket, own in pack.items():
                    before = old if bucket == first else self._held(bucket) if bucket in entries else []
                    self._hold(bucket, before + own)
            else:
                self._hold(first, old + [e for own in pack.values() for e in own])
                pack = {first: None}
            entries.update(pack)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = self._entries()
        for f in rows:
            self._hold_all(list(zip(f["t"].tolist(), f["v"].tolist(), strict=True)), entries)
        yield from self._ripe(key, timerValues, entries)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ripe(key, timerValues, self._entries())

    def _ripe(self, key: tuple, timer, entries: set[int]) -> list[pd.DataFrame]:
        """Takes the events that no earlier one can precede any more; a timer wakes the state for the next, or forgets it."""
        passed = timer.getCurrentWatermarkInMs() * 1000
        ripe = [b for b in entries if b * self.span < passed]
        if len(ripe) > 1 and len(ripe) == len(entries):  # all in a few calls
            held = [e for _, (ts, vs) in self.waiting.iterator() for e in zip(ts, vs, strict=True)]
        else:
            held = [e for b in ripe for e in self._held(b)]
        held.sort()
        at = bisect_left(held, passed, key=lambda e: e[0])
        now, later = held[:at], held[at:]
        if now:  # else the entries stay as they are
            if len(ripe) == len(entries):
                self.waiting.clear()
            else:
                for b in ripe:
                    self.waiting.removeKey((b,))
            entries.difference_update(ripe)
            self._hold_all(later, entries)
        rest = [b * self.span for b in entries if b * self.span >= passed] + [t for t, _ in later[:1]]
        out = self.take(key, now) if now else None
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if rest:
            self.handle.registerTimer(min(rest) // 1000 + 1)
        elif self.last.exists():
            end = self.last.get()[0] + self.keep
            if end < passed:
                self.last.clear()
            else:
                self.handle.registerTimer(end // 1000 + 1)
        return [] if out is None or out.empty else [out]

    def close(self) -> None:
        pass


class _Thinning(_InOrder):
    def __init__(self, keep: int, span: int, step: int):
        super().__init__(keep, span)
        self.step = step

    def take(self, key: tuple, now: list[tuple[int, float]]) -> pd.DataFrame:
        last, kept = self.last.get()[0] if self.last.exists() else None, []
        for t, _ in now:
            if last is None or t - last >= self.step:
                kept.append(t)
                last = t
        self.last.update((last, 0.0, 0.0, 0.0, 0))
        return pd.DataFrame({"rec_id": [key[0]] * len(kept), "t": pd.Series(kept, dtype="int64")})


class _Changes(_InOrder):
    def __init__(self, keep: int, span: int, threshold: float, drift: float):
        super().__init__(keep, span)
        self.threshold, self.drift = threshold, drift

    def take(self, key: tuple, now: list[tuple[int, float]]) -> pd.DataFrame:
        _, before, up, down, n = self.last.get() if self.last.exists() else (0, 0.0, 0.0, 0.0, 0)
        alarms, _, state = cusum([v for _, v in now], (before if n else None, up, down, 1, 1), self.threshold, self.drift)
        self.last.update((now[-1][0], *state[:3], n + len(now)))
        return pd.DataFrame({"rec_id": [key[0]] * len(alarms), "t": pd.Series([now[i][0] for i in alarms], dtype="int64"), "v": pd.Series([now[i][1] for i in alarms], dtype="float64")})


def _dealt(events: DataFrame, delay: str, value: str | None):
    v = F.lit(0.0) if value is None else F.col(value).cast("double")
    known = events.where("rec_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    own = known.select("rec_id", F.unix_micros("ts").alias("t"), v.alias("v"), "ts")
    return (own if value is None else own.where("v IS NOT NULL AND NOT isnan(v)")).groupBy("rec_id")


def thinned(events: DataFrame, dead_time: int, delay: str, keep: int = 24 * 3600 * SECOND, strict: bool = False, span: int = 60 * SECOND) -> DataFrame:
    """(rec_id, t) kept of a stream of events (rec_id, ts timestamp): the first, then each at least dead_time (strict: more) after the last kept.

    An event is decided once the watermark, `delay` behind the latest event, has passed it. keep, in microseconds, has to be more than the
    dead time; events wait in entries of `span` microseconds. Needs the RocksDB state store.
    """
    kind = events.schema["rec_id"].dataType.simpleString()
    step = dead_time + 1 if strict else max(1, dead_time)
    if keep < step:
        raise ValueError("a state must be kept longer than the dead time")
    return _dealt(events, delay, None).transformWithStateInPandas(_Thinning(keep, span, step), f"rec_id {kind}, t long", "Append", "EventTime")


def change_alarms(events: DataFrame, value: str, delay: str, threshold: float, drift: float, keep: int = 24 * 3600 * SECOND, span: int = 60 * SECOND) -> DataFrame:
    """(rec_id, t, v) of the events of a stream (rec_id, ts timestamp, value) at which a sum of changes of value passes the threshold.

    Values are taken as they are: standardise them beforehand by what is known of the recording. Of equal times the smaller value comes
    first; null and NaN values are left out. Needs the RocksDB state store.
    """
    kind = events.schema["rec_id"].dataType.simpleString()
    return _dealt(events, delay, value).transformWithStateInPandas(_Changes(keep, span, threshold, drift), f"rec_id {kind}, t long, v double", "Append", "EventTime")
