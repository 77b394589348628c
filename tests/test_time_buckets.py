"""Thinning by time buckets, alarms by blocks, and runs by chunks, against one pass over everything."""

import random

import numpy as np
import pytest

from pulsegrid.operators import events as E
from pulsegrid.operators import runs as R
from pulsegrid.operators import signal as G
from pulsegrid.plans import detection as D


def thinned(times, step):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= step:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize(("dead", "strict", "width"), [(10, False, 10), (10, True, 35), (100, False, 50), (7, False, 1000), (1, False, 3), (0, True, 5)])
def test_refractory_by_buckets(spark, dead, strict, width):
    rng = random.Random(width)
    times = {"even": list(range(-300, 900, 3)), "dense": [rng.randrange(-50, 2000) for _ in range(1500)], "rare": [5, 5, 7000, -9000], None: [1, 2, 50]}
    rows = [(r, t) for r, ts in times.items() for t in ts] + [("even", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    got = sorted(map(tuple, E.refractory(spark.createDataFrame(rows, "rec_id string, t long").repartition(3), dead, strict, width).collect()), key=str)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    step = dead + 1 if strict else max(1, dead)
    assert got == sorted(((r, t) for r, ts in times.items() for t in thinned(ts, step)), key=str)


def test_a_bucket_is_a_step_function():
    rng = random.Random(3)
    for _ in range(300):
        step, start = rng.randrange(1, 30), rng.randrange(-100, 100)
        times = sorted(start + rng.randrange(120) for _ in range(rng.randrange(1, 60)))
        own, cut = E.Thinning(start, step), rng.randrange(len(times) + 1)
        for part in (times[:cut], times[cut:]):
            if part:
                own.add(np.array(part))
        for last in (None, *range(start - 2 * step, start)):
            kept = thinned([t for t in times if last is None or t >= last + step], step)
            assert E.leaving(last, own.firsts, own.exits(), step) == (kept[-1] if kept else last)


@pytest.mark.parametrize("rounds", [1, 6])
def test_alarms_by_blocks(spark, monkeypatch, rounds):
    """Series cut into blocks of seven values, in rounds and through one task, have the alarms and starts of one pass."""
    monkeypatch.setattr(G, "ROUNDS", rounds)
    rng = np.random.default_rng(2)
    own = {"a": rng.normal(size=400), "b": np.repeat([0.0, 5.0, 0.0, 5.0], 40), "c": np.arange(60.0), "d": np.array([1.0, 2.0])}
    rows = [(r, i, float(v)) for r, x in own.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "rec_id string, i long, v double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    forth = G.change_points(frame, ["rec_id"], "i", "v", 1.0, 0.05, starts=True).collect()
    back = G.change_points(frame, ["rec_id"], "i", "v", 1.0, 0.05, backwards=True, starts=True).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for got, turned in ((forth, False), (back, True)):
        want = set()
        for r, x in own.items():
            z = (x - x.mean()) / x.std()
            z, n = (z[::-1] if turned else z).tolist(), len(z)
            alarms, starts, _ = G.cusum(z, (None, 0.0, 0.0, 0, 0), 1.0, 0.05)
            place = (lambda i, n=n: n - 1 - i) if turned else (lambda i: i)
            want |= {(r, place(i), place(s)) for i, s in zip(alarms, starts, strict=True)}
        assert len(want) > 20 and {(r.rec_id, r.i, r.start) for r in got} == want


def test_changes_have_ends(spark):
    x = np.concatenate([np.zeros(50), np.linspace(0, 9, 10), np.full(60, 9.0), np.linspace(9, 4, 5), np.full(30, 4.0)]) + np.random.default_rng(0).normal(size=155) * 0.05
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("flat", i, 1.0) for i in range(9)], "rec_id string, i long, v double")
    got = G.changes(frame, ["rec_id"], "i", "v", 1.0, 0.05).orderBy("alarm").collect()
    assert [r.rec_id for r in got] == ["a"] * len(got) and 2 <= len(got) <= 4
    assert abs(got[0].start - 50) <= 3 and got[0].stop >= got[0].alarm and sum(r.amp for r in got) == pytest.approx(4, abs=1.5)
    last = got[-1]
    assert abs(last.start - 119) <= 3 and abs(last.stop - 124) <= 3 and last.amp < 0


def signal(spark, sizes, seed=5):
    """Samples (rec_id, i, v) with loud, flat and straight parts, and the same as chunks of different lengths."""
    rng, rows = np.random.default_rng(seed), []
    for rec, n in sizes.items():
        x = rng.normal(size=n)
        x[n // 5 : n // 4] *= 6
        x[n // 3 : n // 3 + n // 20] = 9.0
        x[n // 2 : n // 2 + n // 15] = np.linspace(8, 20, n // 15)
        x[-n // 9 :] -= 5 * (np.arange(n // 9 + (n % 9 > 0)) % 7 == 0)[: len(x[-n // 9 :])]
        rows += [(rec, i, float(v)) for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "rec_id string, i long, v double").repartition(3)
    return samples, G.to_chunks(samples, 64, 10.0)


def test_runs_by_chunks(spark):
    samples, chunks = signal(spark, {"a": 1000, "b": 333, "c": 64})
    sort = lambda df: sorted(map(tuple, df.collect()))
    assert sort(R.at_or_above(chunks, 1.0)) == sort(E.threshold_runs(samples, 1.0).select("rec_id", "first", "last"))
    loud = (10.0, 0.8, 2.0, 1.0, 0.3, 0.5, 0.05)
    want = sort(D.loud_stretches(samples, *loud))
    assert want and sort(R.loud_stretches(chunks, *loud)) == want
    points = (10.0, 0.4, 0.5, 1e-2, 0.3, 1.5)
    want = sort(D.saturation_points(samples, *points))
    assert want and sort(D.chunked_saturation_points(chunks, *points)) == want
    stats = {r.rec_id: r for r in R.moments(chunks).collect()}
    own = {r.rec_id: r for r in samples.groupBy("rec_id").agg({"v": "avg"}).collect()}
    assert {r: stats[r].mean for r in stats} == pytest.approx({r: own[r]["avg(v)"] for r in own})


@pytest.mark.parametrize("polarity", ["pos", "neg", "mix"])
def test_amplitude_events_by_chunks(spark, polarity):
    samples, chunks = signal(spark, {"a": 1000, "b": 333, "c": 64, "d": 200})
    marks = spark.createDataFrame([("a", t * 100_000) for t in (3, 70, 71, 400, 655, 990)] + [("b", 40 * 100_000)] + [("d", t * 100_000) for t in (-50, 10, 500)] + [("a", None)], "rec_id string, t long")
    timed = samples.selectExpr("rec_id", "i * 100000L AS t", "v")
    want = sorted(map(tuple, D.amplitude_events(timed, marks.where("t IS NOT NULL"), 250_000, 700_000, 1.2, polarity).collect()))
    assert want and sorted(map(tuple, R.amplitude_events(chunks, marks, 250_000, 700_000, 1.2, polarity).collect())) == want
