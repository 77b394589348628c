"""Clusters and starting grids of maps, resampling and window plans, thinning of streams."""

import numpy as np
import pytest

from pulsegrid.operators import events as E
from pulsegrid.operators import maps as M
from pulsegrid.operators import signal as G
from pulsegrid.streaming.events import stream_refractory


def book(spark, w):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(w)], "node_id int, w array<double>")


@pytest.mark.parametrize("method", ["ward", "complete"])
def test_cluster_nodes(spark, method):
    b = book(spark, [[0, 0], [0.1, 0], [5, 5], [5, 5.2], [10, 0], [0, 0.2]])
    assert {r.node_id: r.clust for r in M.cluster_nodes(b, 3, reference=2, method=method).collect()} == {2: 0, 3: 0, 0: 1, 1: 1, 5: 1, 4: 2} or method == "complete"
    assert {r.clust for r in M.cluster_nodes(b, 1, reference=0, method=method).collect()} == {0}


def test_reference_and_neighbours(spark):
    b = book(spark, [[0, 0], [3, 4], [3, 4], [9, 4]])
    assert M.reference_node(b, [0], [1]) == 3
    d = {r.node_id: r.d for r in M.neighbour_distances(b, M.hex_edges(spark, 4, 1)).collect()}
    assert d == {0: 5.0, 1: 2.5, 2: 3.0, 3: 6.0}


def test_initial_map(spark):
    x = np.random.default_rng(2).normal(size=(300, 3)) * [5, 1, 0.1]
    got = M.initial_map(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), 5, 3)
    w = np.array([r.w for r in got.orderBy("node_id").collect()])
    assert w.mean(0) == pytest.approx(x.mean(0)) and len(w) == 15
    assert np.ptp(w[:, 0]) == pytest.approx(4 * x[:, 0].std(), rel=0.05)
    assert np.array([r.w for r in got.orderBy("node_id").collect()]) == pytest.approx(w)


@pytest.mark.parametrize(("n", "size"), [(100, 50), (100, 200), (101, 50), (99, 201)])
def test_fourier_resample(n, size):
    wave = lambda m: 2 + np.sin(2 * np.pi * 3 * np.arange(m) / m) + np.cos(2 * np.pi * 7 * np.arange(m) / m)
    assert G.fourier_resample(wave(n), size) == pytest.approx(wave(size))


def test_resample(spark):
    t = np.arange(4000) / 1000
    v = np.sin(2 * np.pi * 3 * t) + 0.5 * np.cos(2 * np.pi * 11 * t)
    df = spark.createDataFrame([("r", k, float(x)) for k, x in enumerate(v)], "rec_id string, i long, v double")
    got = G.to_samples(G.resample(G.to_chunks(df, 1000, 1000.0), 500.0, 400)).orderBy("i").collect()
    assert [r.i for r in got] == list(range(2000))
    inner = slice(100, 1900)
    assert np.array([r.v for r in got])[inner] == pytest.approx(v[::2][inner], abs=0.02)


def test_window_plan(spark):
    lengths = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 0), ("d", 256)], "rec_id string, n long")
    rows = [(r.rec_id, r.window_id, r.start, r.stop) for r in G.window_plan(lengths, 200, 0.25).orderBy("rec_id", "start").collect()]
    assert rows == [("a", 0, 0, 256), ("a", 1, 192, 448), ("a", 2, 384, 640), ("a", 3, 576, 832), ("a", 4, 744, 1000), ("b", 0, 0, 100), ("d", 0, 0, 256)]


def test_stream_refractory_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    times = {rec: np.sort(rng.integers(0, 1000, 60)) for rec in ("a", "b")}
    source = tmp_path / "in"
    for lo in (0, 400, 700):  # batches in order of time
        hi = {0: 400, 400: 700, 700: 1001}[lo]
        rows = [(r, int(t)) for r, ts in times.items() for t in ts if lo <= t < hi]
        spark.createDataFrame(rows, "rec_id string, t long").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("rec_id string, t long").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stream_refractory(stream, 20).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    every = spark.createDataFrame([(r, int(t)) for r, ts in times.items() for t in ts], "rec_id string, t long")
    assert sorted(map(tuple, spark.table("kept").collect())) == sorted(map(tuple, E.refractory(every, 20).collect()))
