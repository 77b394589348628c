"""Neighbours and running frames of samples by spans, against one pass over each recording."""

import math
import random

import pytest

from pulsegrid.operators import events as E


def series():
    rng = random.Random(8)
    rows = [("even", 10 * i, float(rng.randrange(-4, 5))) for i in range(400)]
    rows += [("odd", t, rng.gauss(0, 1)) for t in rng.sample(range(-3000, 3000), 300)]
    rows += [("one", 5, 1.0), ("tied", 7, 1.0), ("tied", 7, 3.0), ("tied", 99, 2.0), ("tied", 100, 2.0), (None, 1, 1.0), (None, 50, 2.0), (None, 300, 1.0)]
    return rows


def by_recording(rows):
    out = {}
    for r in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])):
        out.setdefault(r[0], []).append(r[1:])
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(series(), "rec_id string, t long, v double").repartition(3)


@pytest.mark.parametrize("span", [1, 37, 500, E.SPAN])
def test_sides(frame, span):
    got = {(r.rec_id, r.t, r.v): (r._p, r._n, r._i) for r in E.with_sides(frame, span=span).collect()}
    want = {}
    for rec, own in by_recording(series()).items():
        for i, (t, v) in enumerate(own):
            want[rec, t, v] = (own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None, i + 1)
    assert got == want


def test_sides_of_nulls_and_nothing(spark, frame):
    odd = spark.createDataFrame([("a", None, 5.0), ("a", 1, None), ("a", 900, 2.0), ("a", 900, 2.0)], "rec_id string, t long, v double")
    assert sorted((r._i, r._p, r._n) for r in E.with_sides(odd, span=10).collect()) == [(1, None, None), (2, 5.0, 2.0), (3, None, 2.0), (4, 2.0, None)]
    assert E.with_sides(frame.limit(0)).count() == 0 and E.running_rms(frame.limit(0), 5).count() == 0


@pytest.mark.parametrize(("kind", "sign"), [("max", 1), ("min", -1)])
def test_extrema_by_spans(frame, kind, sign):
    want = {(rec, own[i]) for rec, own in by_recording(series()).items() for i in range(1, len(own) - 1) if sign * own[i - 1][1] < sign * own[i][1] > sign * own[i + 1][1]}
    got = E.local_extrema(frame, kind, span=64)
    assert {(r.rec_id, (r.t, r.v)) for r in got.collect()} == want and got.columns == frame.columns
    over = {(rec, x) for rec, x in want if sign * x[1] > sign * 1.5}
    assert {(r.rec_id, (r.t, r.v)) for r in E.local_extrema(frame, kind, threshold=1.5, at="peak", span=64).collect()} == over


@pytest.mark.parametrize(("width", "rows"), [(1, 4), (4, 16), (7, 16), (50, 10)])
def test_running_rms_by_blocks(frame, width, rows):
    got = {(r.rec_id, r.t, r.v): r.rms for r in E.running_rms(frame, width, span=300, rows=rows).collect()}
    n = 0
    for rec, own in by_recording(series()).items():
        for i, (t, v) in enumerate(own):
            near = own[max(0, i - width // 2) : i + (width - 1) // 2 + 1]
            assert got[rec, t, v] == pytest.approx(math.sqrt(sum(x * x for _, x in near) / width)), (rec, t)
            n += 1
    assert len(got) == n


def test_line_length_and_singlets_by_spans(frame):
    each = by_recording(series())
    lengths = {r.rec_id: r.ll for r in E.line_length(frame, span=90).collect()}
    assert lengths.keys() == each.keys()
    for rec, own in each.items():
        assert lengths[rec] == pytest.approx(sum(abs(b[1] - a[1]) for a, b in zip(own, own[1:], strict=False)))
    alone = {(r.rec_id, r.t, r.v) for r in E.singlets(frame, 20, span=90).collect()}
    want = {(rec, *own[i]) for rec, own in each.items() if len(own) > 1 for i in range(len(own)) if all(abs(own[j][0] - own[i][0]) >= 20 for j in (i - 1, i + 1) if 0 <= j < len(own))}
    assert alone == want


def test_no_window_holds_a_recording_of_samples(frame):
    """The only windows by recording are those over the short rows of spans."""
    plan = E.local_extrema(frame)._jdf.queryExecution().optimizedPlan().toString()
    whole = [x for x in plan.splitlines() if "Window" in x and "_span" not in x]
    assert whole and all("_own" in x for x in whole)
