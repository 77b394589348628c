"""Mixtures of many recordings at once against one recording alone, a plain version, and planted waveforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import mixtures as X


def planted(recordings, n, seed=0, width=20):
    """Rows (rec_id, i, v) of two shapes of waveform with noise, and which of them each is."""
    rng, rows, truth = np.random.default_rng(seed), [], {}
    at = np.arange(width)
    shapes = [4 * np.exp(-((at - 8) ** 2) / 6), 1.5 * np.sin(at / 2)]
    for r in range(recordings):
        for i in range(n + r % 3):
            k = int(rng.random() < 0.4)
            truth[f"r{r}", i] = k
            rows.append((f"r{r}", i, (shapes[k] * (1 + 0.1 * rng.normal()) + 0.3 * rng.normal(size=width)).tolist()))
    return rows, truth


SCHEMA = "rec_id string, i long, v array<double>"


def told(fits):
    return {(r.rec_id, r.components, r.clusters): r for r in fits.models.collect()}


def test_moments_merge_exactly():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) + 1e6
    of = lambda y: (len(y), y.mean(axis=0), (y - y.mean(axis=0)).T @ (y - y.mean(axis=0)))
    n, mean, products = X.merge_moments(X.merge_moments(of(x[:7]), of(x[7:8])), of(x[8:]))
    assert n == 50 and np.allclose(mean, x.mean(axis=0)) and np.allclose(products / 50, np.cov(x.T, bias=True), rtol=1e-6)


def test_each_recording_gets_what_it_gets_alone(spark):
    rows, truth = planted(12, 60)
    grid = [(2, 2), (3, 3)]
    snips = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole = told(X.fit(snips, grid))
    assert len(whole) == 24
    for rec in ("r0", "r7"):
        for key, r in told(X.fit(snips.where(F.col("rec_id") == rec).coalesce(1), grid)).items():
            assert r.loglik == pytest.approx(whole[key].loglik, rel=1e-9) and r.mu == pytest.approx(whole[key].mu, rel=1e-6, abs=1e-8) and r.n == whole[key].n
    fits = X.fit(snips, [(2, 2)])
    got = {(r.rec_id, r.i): r.label for r in X.by_height(X.clusters(snips, fits)).collect()}
    assert got.keys() == truth.keys()
    assert np.mean([(got[k] == 2) == (truth[k] == 1) for k in truth]) > 0.99  # the higher waveform is the first


def test_rounds_over_blocks_equal_one_block(spark):
    """A recording of many blocks, fitted in rounds, gives what one block gives in its task; and what a plain loop gives."""
    rows, _ = planted(2, 150, seed=3)
    snips = spark.createDataFrame(rows, SCHEMA).repartition(4)
    apart, together = X.fit(snips, [(2, 2)], block=32), X.fit(snips, [(2, 2)])
    a, b = told(apart), told(together)
    for key, r in a.items():
        assert r.round == b[key].round and r.mean_ll == pytest.approx(b[key].mean_ll, rel=1e-9) and r.cov == pytest.approx(b[key].cov, rel=1e-6)
    x = np.array([r.s for r in X.scores(snips.where("rec_id = 'r0'"), together.axes).collect()])
    assert x.mean(axis=0) == pytest.approx([0, 0], abs=1e-9) and x.std(axis=0, ddof=1) == pytest.approx([1, 1])
    r = b["r0", 2, 2]
    w, mu, cov = np.array(r.w), np.array(r.mu).reshape(2, 2), np.array(r.cov).reshape(2, 2, 2)
    for _ in range(50):  # at its end the model hardly moves
        d = np.array([[w[k] * np.exp(-0.5 * (p - mu[k]) @ np.linalg.inv(cov[k]) @ (p - mu[k])) / (2 * np.pi * np.sqrt(np.linalg.det(cov[k]))) for k in range(2)] for p in x])
        g = d / d.sum(axis=1, keepdims=True)
        w, mu = g.mean(axis=0), (g.T @ x) / g.sum(axis=0)[:, None]
        cov = np.array([((x - mu[k]) * g[:, k : k + 1]).T @ (x - mu[k]) / g[:, k].sum() for k in range(2)])
    assert mu.ravel() == pytest.approx(r.mu, abs=0.02) and np.log(d.sum(axis=1)).mean() == pytest.approx(r.mean_ll, abs=1e-3)


def test_odd_recordings(spark):
    flat = [("flat", i, [1.0, 1.0, 1.0]) for i in range(5)] + [("one", 0, [1.0, 2.0, 3.0]), ("none", 0, None), (None, 1, [1.0, 1.0, 1.0])]
    copies = [("copies", i, [float(i % 2), 0.0, 1.0]) for i in range(10)]
    snips = spark.createDataFrame(flat + copies, SCHEMA)
    fits = X.fit(snips, [(2, 3)])
    assert {r.rec_id: len(r.w) for r in fits.models.collect()} == {"flat": 1, "one": 1, "copies": 2}
    got = {(r.rec_id, r.i): r.cluster for r in X.clusters(snips, fits).collect()}
    assert got["none", 0] is None and got[None, 1] is None and got["one", 0] == 0 and len({got["copies", i] for i in (0, 2)}) == 1 and got["copies", 0] != got["copies", 1]
    assert X.fit(snips.limit(0), [(1, 2)]).models.count() == 0
