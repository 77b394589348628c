"""Threshold choice, masks and events of signals, against NumPy on small signals."""

import numpy as np
import pytest

from pulsegrid.functions import SECOND
from pulsegrid.operators import signal as G
from pulsegrid.plans import detection as D


def samples(spark, v, order="i"):
    return spark.createDataFrame([("r", k, float(x)) for k, x in enumerate(v)], f"rec_id string, {order} long, v double")


def counts(spark, n):
    return spark.createDataFrame([("r", k / 10, c) for k, c in enumerate(n)], "rec_id string, threshold double, n long")


def chosen(n, mode):
    n, at = np.array(n), np.arange(len(n)) / 10
    keep = (n > n.min()) & (n < n.max())
    d, at = np.diff(n[keep]), at[keep]
    if not len(d):
        return []
    ids = np.flatnonzero(d >= np.sort(d)[-int(np.ceil(len(d) * 35 / 100))])
    if mode == "firstcross":
        return [at[ids[0]]]
    runs = np.split(ids, np.flatnonzero(np.diff(ids) > 1) + 1)
    best = max(runs, key=lambda r: (r[-1] - r[0], -r[0]))
    return [at[best[0] + int(np.ceil((best[-1] - best[0]) / 2))]]


@pytest.mark.parametrize("mode", ["firstcross", "bump"])
def test_choose_threshold(spark, mode):
    for n in ([50, 50, 40, 31, 30, 29, 29, 20, 10, 9, 3, 0, 0], [9, 5, 5, 5, 0], [3, 3, 0]):
        assert [r.threshold for r in D.choose_threshold(counts(spark, n), mode=mode).collect()] == pytest.approx(chosen(n, mode))
    with pytest.raises(ValueError, match="mode"):
        D.choose_threshold(counts(spark, [1]), mode="other")


def test_refractory_counts(spark):
    peaks = spark.createDataFrame([("r", 0, 1.0), ("r", 5, 3.0), ("r", 12, 2.0)], "rec_id string, t long, v double")
    assert {r.threshold: r.n for r in D.refractory_counts(peaks, 10, [0.5, 1.5, 2.5, 3.5]).collect()} == {0.5: 2, 1.5: 1, 2.5: 1, 3.5: 0}


def test_plateau_centers(spark):
    got = D.plateau_centers(samples(spark, [0, 5, 5, 5, 1, 5, 0, 5, 5], "t")).collect()
    assert sorted(r.t for r in got) == [2, 7]


def test_amplitude_events(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=400)
    v[[100, 101, 102, 180, 300]] -= 12
    none = samples(spark, [], "t").select("rec_id", "t")
    assert sorted(r.t for r in D.amplitude_events(samples(spark, v, "t"), none, 5, 3).collect()) == [100, 180, 300]
    found = spark.createDataFrame([("r", 50), ("r", 178), ("r", 350)], "rec_id string, t long")
    assert sorted(r.t for r in D.amplitude_events(samples(spark, v, "t"), found, 5, 3).collect()) == [100, 300]
    assert D.amplitude_events(samples(spark, -v, "t"), none, 5, 3, polarity="pos").count() == 3


def test_loud_stretches(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=6000)
    v[2000:2100] += 30  # loud, without a crossing
    v[4000:4100] += 30 * (-1.0) ** np.arange(100)  # loud, with many
    (got,) = D.loud_stretches(samples(spark, v), 50.0).collect()
    assert abs(got["first"] - 2000) < 30 and abs(got["last"] - 2100) < 30
    assert D.loud_stretches(samples(spark, np.zeros(50)), 50.0).count() == 0


def test_saturation_points(spark):
    v = np.random.default_rng(8).normal(size=5000)
    v[1000:1010] = 40.0  # flat
    v[3000:3040] = -np.linspace(50, 60, 40)  # straight, not flat
    v[4000] = 60.0  # a spike
    got = sorted((r.i, r.kind) for r in D.saturation_points(samples(spark, v), 500.0).collect())
    assert got == [(1000, "stump"), (3038, "tooth")]


def test_detect(spark):
    rng, sr = np.random.default_rng(9), 500
    v = rng.normal(size=30 * sr) * 0.1
    at = np.arange(3, 28, 2.5)
    for t in at:
        k = int(t * sr)
        v[k - 50 : k + 50] += np.hanning(100) * np.sin(np.arange(100) * 2 * np.pi * 12 / sr) * 4
    chunks = G.to_chunks(samples(spark, v), 5000, sr)
    got = [r.t / SECOND for r in D.detect(chunks, threshold=2.0).where("kind = 'spectral'").orderBy("t").collect()]
    assert all(min(abs(t - g) for g in got) < 0.2 for t in at) and all(min(abs(t - g) for t in at) < 0.3 for g in got)


def test_chunks_are_made_once(spark):
    """Masks and events read chunks several times, so they are written first; what made them is not in the plan of the result."""
    chunks = spark.range(3, 9).selectExpr("'r' AS rec_id", "id - 3 AS chunk_id", "(id - 3) * 32 AS i0", "1.0D AS sr", "transform(sequence(0, 31), x -> CAST(hash(x + id * 32) % 100 AS double)) AS v")
    for made in (D.chunked_masks(chunks, 1.0, loud={"window": 4.0}), D.detect(chunks, 16, 0.1, 0.4, threshold=0.5)):
        made.collect()
        assert "Range (3, 9" not in made._jdf.queryExecution().optimizedPlan().toString()
