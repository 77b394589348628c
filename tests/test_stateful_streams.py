"""Streams in event time, in shuffled order of arrival, against the batch operators."""

import random
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest

from pulsegrid.operators.signal import cusum
from pulsegrid.streaming import stateful as T

START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(spark, tmp_path, batches, make):
    """What make(stream) gives for batches of (rec_id, seconds, v)."""
    for rows in batches:
        frame = spark.createDataFrame([(r, START + timedelta(seconds=s), v) for r, s, v in rows], "rec_id string, ts timestamp, v double")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rec_id string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    make(stream).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    return spark.table("streamed").collect()


def second(r):
    return r.t / 1e6 - START.timestamp()


def test_thinning_of_shuffled_arrivals(spark, tmp_path, rocks):
    rng, rows = random.Random(1), []
    for rec in ("a", "b"):
        rows += [(rec, rng.randrange(1000), 0.0) for _ in range(150)]
    rows.sort(key=lambda r: r[1] + rng.randrange(60))  # up to a minute late
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[("z", 5000, 0.0)], [("late", 20, 0.0), ("z", 5001, 0.0)]]
    got = run(spark, tmp_path, batches, lambda s: T.thinned(s, 20_000_000, "100 seconds"))
    want = []
    for rec in ("a", "b"):
        last = None
        for t in sorted({s for r, s, _ in rows if r == rec}):
            if last is None or t - last >= 20:
                want.append((rec, t))
                last = t
    assert sorted((r.rec_id, second(r)) for r in got) == sorted(want)


def test_alarms_of_shuffled_arrivals_and_forgotten_state(spark, tmp_path, rocks):
    rng = random.Random(2)
    x = {s: (s // 50) % 2 * 3.0 + rng.random() for s in range(400)}
    rows = sorted((("a", s, v) for s, v in x.items()), key=lambda r: r[1] + rng.randrange(30))
    back = [("a", 100_000 + s, 7.0 * (s > 2)) for s in range(5)]  # after the state was forgotten, the first value is no change
    batches = [rows[:130], rows[130:260], rows[260:], [("z", 90_000, 0.0)], [("z", 90_001, 0.0)], back, [("z", 200_000, 0.0)]]
    got = run(spark, tmp_path, batches, lambda s: T.change_alarms(s, "v", "60 seconds", 2.0, 0.2, keep=3600 * 1_000_000))
    alarms, _, _ = cusum([x[s] for s in range(400)], (None, 0.0, 0.0, 0, 0), 2.0, 0.2)
    assert len(alarms) > 5 and sorted(second(r) for r in got) == [*map(float, alarms), 100_003.0]


def test_keep_is_longer_than_the_dead_time(spark):
    with pytest.raises(ValueError, match="longer"):
        T.thinned(spark.readStream.format("rate").load().selectExpr("'a' AS rec_id", "timestamp AS ts"), 10, "1 second", keep=5)


def test_few_events_of_many_buckets_wait_in_few_entries():
    """A month of events in buckets of a day: one entry is written and read, not one for each day; later events stay."""
    day = 86_400_000_000
    calls = []

    class Entries(dict):
        def keys(self):
            return iter(list(super().keys()))

        def getValue(self, k):
            calls.append("get")
            return self[k]

        def updateValue(self, k, v):
            calls.append("update")
            self[k] = v

        def iterator(self):
            return iter(list(self.items()))

        def removeKey(self, k):
            calls.append("remove")
            del self[k]

        def containsKey(self, k):
            calls.append("contains")
            return k in self

    class Last:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, v):
            self.value = v

    class Handle:
        getMapState = lambda self, *a: Entries()
        getValueState = lambda self, *a: Last()
        listTimers = lambda self: []
        deleteTimer = registerTimer = lambda self, t: None

    class Timer:
        at = 0

        def getCurrentWatermarkInMs(self):
            return self.at // 1000

    state, timer = T._Thinning(60 * day, day, 1), Timer()
    state.init(Handle())
    times = [k * day // 2 for k in range(60)]
    frame = pd.DataFrame({"t": times[::-1], "v": [0.0] * 60})
    assert list(state.handleInputRows(("a",), iter([frame]), timer)) == []
    timer.at = 20 * day
    first = pd.concat(state.handleExpiredTimer(("a",), timer, None))["t"].tolist()
    timer.at = 40 * day
    rest = pd.concat(state.handleExpiredTimer(("a",), timer, None))["t"].tolist()
    assert first == [t for t in times if t < 20 * day] and first + rest == times
    assert len(calls) <= 8
