"""Small literal cases, with the results worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import SECOND, log_guard
from pulsegrid.operators import bursts as B
from pulsegrid.operators import events as E
from pulsegrid.operators import intervals as I
from pulsegrid.operators import maps as M
from pulsegrid.plans.analysis import Params, analyse


def us(x):
    return round(x * SECOND)


def intervals(spark, rows, *more):
    return spark.createDataFrame([("r", us(a), us(b), *m) for a, b, *m in rows], ", ".join(["rec_id string, start long, stop long", *more]))


def points(spark, ts):
    return spark.createDataFrame([("r", us(t)) for t in ts], "rec_id string, t long")


def pairs(df, *more):
    return sorted((r["start"] / SECOND, r["stop"] / SECOND, *(r[m] for m in more)) for r in df.collect())


def bounds(spark, lo, hi):
    return spark.createDataFrame([("r", us(lo), us(hi))], "rec_id string, lo long, hi long")


def test_union_and_complement(spark):
    a = intervals(spark, [(300, 400), (550, 700), (1000, 1100), (5000, 5600), (410, 460), (690, 720), (740, 790), (800, 1050), (1060, 1070), (0, 600)])
    b = bounds(spark, 0, 5000)
    assert pairs(I.clip(I.interval_union(a), b)) == [(0, 720), (740, 790), (800, 1100)]
    assert pairs(I.interval_complement(a, b)) == [(720, 740), (790, 800), (1100, 5000)]
    assert pairs(I.interval_union(I.interval_union(a))) == pairs(I.interval_union(a))


def test_analyzed_duration(spark):
    got = I.analyzed_duration(bounds(spark, 0, 4784.398), intervals(spark, [(2978.61, 3348.16), (4153.07, 4157.07)]), us(300)).first()
    assert got["dur"] == us(4110.848)


def test_bursts_and_singlets(spark):
    ev = points(spark, [0, 1, 3.5, 10, 11, 14.4, 15, 30])
    assert pairs(E.gap_islands(ev, us(2.5))) == [(0, 1), (10, 11), (14.4, 15)]
    assert pairs(E.bursts(ev, us(2.5), us(3.5)), "b_n") == [(0, 1, 2), (10, 15, 4)]
    assert sorted(r.t for r in E.singlets(ev, us(2.5)).collect()) == [us(3.5), us(30)]
    assert E.bursts(points(spark, [0, 50, 99]), us(2.5), us(3.5)).count() == 0
    assert E.bursts(ev.limit(0), us(2.5), us(3.5)).count() == 0


def test_islands_across_buckets(spark, monkeypatch):
    ev = points(spark, [x * 0.7 for x in range(40)] + [100, 101])
    want = pairs(E.gap_islands(ev, us(1)), "n")
    monkeypatch.setattr(E, "BUCKET", 3)
    assert pairs(E.gap_islands(ev, us(1)), "n") == want == [(0, 27.3, 40)]


def test_refractory(spark):
    assert sorted(r.t / SECOND for r in E.refractory(points(spark, [0, 0.4, 0.9, 1.1, 1.5, 2.2, 5]), us(1)).collect()) == [0, 1.1, 2.2, 5]


def test_threshold_runs(spark):
    samples = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate([0, 1, 2, 0, 3, 0, 1, 1])], "rec_id string, i long, v double")
    assert sorted((r["first"], r["last"]) for r in E.threshold_runs(samples, 1.0).collect()) == [(1, 2), (4, 4), (6, 7)]


def test_mask_fusion(spark):
    got = I.fuse_masks(intervals(spark, [(100, 110)]), points(spark, [150, 400]), us(3), us(2), us(100))
    assert pairs(got) == [(97, 152), (398, 402)]


def test_predators(spark):
    state = intervals(spark, [(0, 100, "IIP")], "state string")
    assert pairs(I.insert_predators(state, intervals(spark, [(40, 60)]), "art", us(10)), "state") == [(0, 40, "IIP"), (40, 60, "art"), (60, 100, "IIP")]
    assert pairs(I.insert_predators(state, intervals(spark, [(40, 50)]), "art", us(10)), "state") == [(0, 100, "IIP")]


def test_running_rms(spark):
    samples = spark.createDataFrame([("r", i, 2.0) for i in range(4)], "rec_id string, t long, v double")
    assert [r.rms for r in E.running_rms(samples, 4).orderBy("t").collect()] == pytest.approx([(8 / 4) ** 0.5, (12 / 4) ** 0.5, 2.0, (12 / 4) ** 0.5])


def test_log_guard(spark):
    assert [r[0] for r in spark.createDataFrame([(100.0,), (0.0,), (-1.0,)], "x double").select(log_guard(F.col("x"))).collect()] == [2.0, 1e-5, 1e-5]


def test_features_reject_unknown_names(spark):
    with pytest.raises(ValueError, match="unknown"):
        B.burst_features(points(spark, [1]), intervals(spark, [(0, 1)]), ["nothing"])
    with pytest.raises(ValueError, match="unknown"):
        Params.of(nothing=1)


def test_analysis_of_one_recording(spark):
    ev = points(spark, [919.578, 921.264, 923.258, 923.682, 2000, 2001, 2002, 2003, 2004, 2004.01, 3000])
    book = spark.createDataFrame([(0, [5.0, 1.0], 0, 1.0), (1, [50.0, 9.0], 1, 0.0)], "node_id int, w array<double>, clust int, si double")
    variables = [{"pos": i, "name": n, "is_log": False, "factor": 1.0, "mean": 0.0, "std": 1.0} for i, n in enumerate(("b_n", "isi_mean"))]
    got = analyse(ev, bounds(spark, 0, 4784.398), intervals(spark, [(2990, 3010)]), points(spark, []), book, variables, Params.of(offset=us(300)))
    assert [(r.b_n, round(r.dur, 3), r.rank, r.si) for r in got["bursts"].orderBy("start").collect()] == [(4, 4.104, None, None), (5, 4.0, 0, 1.0)]
    assert got["diagnostics"].first()["n_events"] == 9 and pairs(got["masks"]) == [(2987, 3013)]


def test_severity(spark):
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [0.0, 2.5])], "node_id int, w array<double>")
    assert {r.node_id: r.si for r in M.severity(book, 0).collect()} == {0: 1.0, 1: 0.0, 2: 0.5}


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_of_very_long_intervals(spark, monkeypatch, closed):
    """Short and long intervals, each pair once; one of 31 years does not become millions of entries."""
    monkeypatch.setattr(I, "COARSE", 4)
    rng = random.Random(closed)
    make = lambda n: [("r", s, s + rng.choice([0, 3, 9, 40, 41, 300, 2000])) for s in (rng.randrange(3000) for _ in range(n))]
    a, b = make(80), make(80)
    frame = lambda rows: spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "rec_id string, start long, stop long, k long")
    got = sorted((r.k, r.b_k) for r in I.overlap_join(frame(a), frame(b), 10, closed).collect())
    assert got == sorted((i, j) for i, (_, s, e) in enumerate(a) for j, (_, x, y) in enumerate(b) if (s <= y and x <= e if closed else s < y and x < e))
    monkeypatch.undo()
    years = frame([("r", 0, 31 * 365 * 86_400_000_000)])
    assert I.overlap_join(years, frame([("r", 5 * 10**14, 5 * 10**14 + 10), ("r", -20, -10)]), 60_000_000, closed).count() == 1


def test_codebooks_of_many_nodes_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    book = [(i, [rng.random() for _ in range(3)]) for i in range(90)] + [(500, [0.5, 0.5, 0.5]), (400, [0.5, 0.5, 0.5])]
    vectors = spark.createDataFrame([([rng.random() for _ in range(3)],) for _ in range(40)] + [([0.5, 0.5, 0.5],)], "v array<double>")
    nodes = spark.createDataFrame(book, "node_id int, w array<double>")
    whole = [tuple(r) for r in B.project(vectors, nodes, second=True).orderBy("v").collect()]
    monkeypatch.setattr(B, "MOST_NODES", 20)
    parts = [tuple(r) for r in B.project(vectors, nodes, second=True).orderBy("v").collect()]
    assert parts == whole and ([0.5, 0.5, 0.5], 400, 0.0, 500) in whole
    assert [tuple(r) for r in B.project(vectors, nodes).orderBy("v").collect()] == [r[:3] for r in whole]


def test_map_training_by_hand(spark):
    """Batch rounds: nodes become means of all vectors, weighted by the distance on the grid to their nearest node."""
    rng = random.Random(8)
    xs = [[rng.gauss(0, 1), rng.gauss(0, 2)] for _ in range(120)]
    book = {k: [rng.gauss(0, 1), rng.gauss(0, 1)] for k in range(6)}
    got = {r.node_id: r.w for r in M.train_map(spark.createDataFrame([(x,) for x in xs], "v array<double>"), spark.createDataFrame(list(book.items()), "node_id int, w array<double>"), 3, rounds=3, radius=2.0).collect()}
    place = {i: (x, y) for i, x, y in M.hex_nodes(3, 2)}
    for k in range(3):
        reach = max(0.4, 2.0 * (1 - k / 3))
        near = [min(book, key=lambda i: (sum((a - b) ** 2 for a, b in zip(x, book[i], strict=True)), i)) for x in xs]
        fresh = {}
        for i in book:
            h = [math.exp(-((place[i][0] - place[n][0]) ** 2 + (place[i][1] - place[n][1]) ** 2) / (2 * reach**2)) for n in near]
            fresh[i] = [sum(w * x[d] for w, x in zip(h, xs, strict=True)) / sum(h) for d in range(2)]
        book = fresh
    assert all(got[i] == pytest.approx(book[i]) for i in book)
