import random

import numpy as np
import pytest

from pulsegrid.operators import events as E
from pulsegrid.operators import signal as S


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("dead", "strict"), [(50, False), (50, True), (0, False), (0, True)])
def test_refractory_of_one_dense_run(spark, small_batches, dead, strict):
    rng = random.Random(dead)
    rows = [(r, rng.randrange(3000)) for r in ("a", "b", None) for _ in range(600)] + [("a", None), ("c", None)]
    got = E.refractory(spark.createDataFrame(rows, "rec_id string, t long").repartition(3), dead, strict)
    want = []
    for rec in ("a", "b", None):
        last = None
        for t in sorted({t for r, t in rows if r == rec and t is not None}):
            if last is None or (t - last > dead if strict else t - last >= dead):
                want.append((rec, t))
                last = t
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "collect_list" not in plan(got) and "MapInArrow" in plan(got)  # no array holds a run


def test_change_points_of_long_groups(spark, small_batches):
    rng = np.random.default_rng(0)
    own = {r: np.cumsum(rng.normal(size=300)).round(3) for r in ("a", "b", None)} | {"flat": np.full(40, 0.1), "one": np.array([3.0])}
    rows = [(r, i, float(v)) for r, x in own.items() for i, v in enumerate(x)] + [("gap", i, None if i == 3 else float(i % 5 * 10)) for i in range(20)]
    got = S.change_points(spark.createDataFrame(rows, "rec_id string, i long, v double").repartition(3), ["rec_id"], "i", "v", 1.0, 0.05)
    want = {(r, i) for r in ("a", "b", None) for i, _, _ in S.cusum_alarms((own[r] - own[r].mean()) / own[r].std(), 1.0, 0.05)}
    assert len(want) > 10 and {tuple(r) for r in got.collect()} == want
    assert "FlatMapGroupsInPandas" not in plan(got) and "collect_list" not in plan(got)  # no frame or array holds a group


def test_running_frames_of_one_long_recording(spark):
    """nearest, next_after and amplitude_events of one recording of 300,000 samples; frames that end at the last row would take hours."""
    from pulsegrid.plans import detection as D

    n = 300_000
    samples = spark.range(n).selectExpr("'r' AS rec_id", "id * 10 AS t", "CAST(id % 101 AS double) AS v")
    marks = samples.where("t % 1000 = 0").select("rec_id", "t")
    near = E.nearest(samples.select("rec_id", "t"), marks).selectExpr("count(*) AS n", "sum(abs(dt)) AS d", "max(abs(dt)) AS m").first()
    assert tuple(near) == (n, sum(10 * min(i % 100, 100 - i % 100) for i in range(n - 99)) + sum(10 * (i % 100) for i in range(n - 99, n)), 990)
    assert E.next_after(samples.select("rec_id", "t"), marks).where("next_t IS NULL").count() == 100
    assert D.amplitude_events(samples, marks, 100, 5, 1.5, "pos").count() > 1000
