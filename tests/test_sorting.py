"""Snippets and sorting by waveform on planted waveforms."""

import numpy as np
import pytest

from pulsegrid.operators import signal as G
from pulsegrid.plans import sorting as S


def chunks(spark, v, length=500):
    df = spark.createDataFrame([("r", k, float(x)) for k, x in enumerate(v)], "rec_id string, i long, v double")
    return G.to_chunks(df, length, 500.0)


def events(spark, at):
    return spark.createDataFrame([("r", int(i)) for i in at], "rec_id string, i long")


def test_snippets(spark):
    v = np.random.default_rng(3).normal(size=2600)
    at = [5, 60, 498, 502, 1000, 1999, 2590]
    got = {r.i: (r.center, r.v) for r in S.snippets(chunks(spark, v), events(spark, at + [60]), 500, 20, 50, 100).collect()}
    assert sorted(got) == at
    for i in at:
        lo = max(0, i - 20)
        c = lo + int(np.argmin(v[lo : i + 21]))
        if c - 50 < 0 or c + 100 > len(v):
            assert got[i] == (None, None)
        else:
            assert got[i][0] == c and got[i][1] == pytest.approx(v[c - 50 : c + 100].tolist())


def test_sort_events(spark):
    rng, n = np.random.default_rng(4), 60_000
    v = rng.normal(size=n) * 0.05
    at = np.arange(500, n - 500, 1000)
    big = at[::2]
    for i in at:
        v[i - 20 : i + 60] -= (6 if i in big else 2) * np.hanning(80) * (1 + 0.1 * rng.normal())
    twin = at[4] + 30
    snips = S.snippets(chunks(spark, v), events(spark, [*at, twin]), 500, 25, 50, 100)
    limits = {"before": 900, "after": 1250, "around": 1000}
    got = {r.i: r for r in S.sort_events(snips, limits, noise=(2,), doublet=45, clusters=2, components=1, rounds=2).collect()}
    assert len(got) == len(at) + 1
    assert {got[i].label for i in big} == {1} and {got[i].label for i in at[1::2]} == {2}
    assert got[at[1]].is_noise and not got[at[0]].is_noise
    assert got[at[4]].is_doublet != got[twin].is_doublet  # one of both stays
