"""Percentiles by cells are the exact ones."""

import numpy as np
import pytest

from pulsegrid.operators import maps as M


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=997), "b": np.repeat([-2.5, 0.0, 7.0], 50), None: rng.pareto(0.5, 400), "one": np.array([-3.0]), "tiny": rng.normal(size=200) * 1e-300, "huge": rng.normal(size=50) * 1e300}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.g: r.p for r in M.percentiles(frame, "v", ["g"], shares).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.percentile(x, [100 * s for s in shares]).tolist(), rel=1e-12)
    normed = {(r.g, r.v): r.normed for r in M.percentile_norm(frame, "v", ["g"], 0, 1).collect()}
    assert len(normed) == len({(g, v) for g, v in rows}) and normed["none", None] is None and normed["one", -3.0] is None
    assert normed["b", 0.0] == pytest.approx(2.5 / 9.5)


def test_infinities_and_frequent_values(spark):
    """Infinities are values like others, and equal values are counted, not ranked one by one."""
    inf = float("inf")
    rows = [("a", x) for x in [0.0] * 5000 + [1.0, 2.0, inf]] + [("b", x) for x in (-inf, -inf, 3.0, inf)] + [("c", inf), ("d", None), ("d", float("nan"))]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r.g: r.p for r in M.percentiles(frame, "x", ["g"], [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got["a"] == [0.0, 0.0, 0.0, inf] and got["c"] == [inf] * 4 and set(got) == {"a", "b", "c"}
    assert got["b"][0] == -inf and got["b"][3] == inf and got["b"][1] == -inf
    assert {r.x: r.normed for r in M.percentile_norm(frame.where("g = 'a'"), "x", ["g"], 0.0, 0.9999).distinct().collect()}[0.0] == 0.0
