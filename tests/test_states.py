"""State segmentation: each level on literal cases worked out by hand, and what holds for every recording."""

import numpy as np

from pulsegrid import queries as Q
from pulsegrid.functions import SECOND
from pulsegrid.operators import intervals as I
from pulsegrid.plans import states as S

P = S.StateParams()


def table(spark, rows, more):
    return spark.createDataFrame([("r", round(a * SECOND), round(b * SECOND), *m) for a, b, *m in rows], f"rec_id string, start long, stop long, {more}")


def seen(df, *more):
    return sorted((r["start"] / SECOND, r["stop"] / SECOND, r["state"], *(r[m] for m in more)) for r in df.collect())


def bounds(spark, lo, hi):
    return spark.createDataFrame([("r", lo * SECOND, hi * SECOND)], "rec_id string, lo long, hi long")


def test_severe_periods(spark):
    bursts = table(spark, [(100, 110, 0), (200, 210, 1), (250, 260, 2), (400, 410, 0)], "rank int")
    assert seen(S.severe_periods(bursts, bounds(spark, 0, 1000), P)) == [(0, 100, "temp"), (100, 210, "IP"), (210, 400, "temp"), (400, 410, "IP"), (410, 1000, "temp")]
    assert seen(S.severe_periods(bursts.limit(0), bounds(spark, 0, 9), P)) == [(0, 9, "temp")]


def test_severe_periods_of_the_query_join_bursts_within_the_scaled_gap(spark, tmp_path):
    """Bursts of five events ten days apart are one IP, as a gap of 180 s is 15 days here; 16 days apart they are two."""
    first, hour, day = 1_704_067_200, 3600, 86_400
    times = [a + k * hour for a in (0, 10 * day, 26 * day + 4 * hour) for k in range(5)]
    rows = [(k, t, 1, "view", 1.0) for k, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double")
    frame.selectExpr("event_id", f"timestamp_seconds({first} + t) AS ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.start // SECOND - first, r.stop // SECOND - first, r.state) for r in Q.severe_periods(spark, str(tmp_path)).collect())
    two = 10 * day + 4 * hour
    assert got == [(0, two, "IP"), (two, two + 16 * day, "temp"), (two + 16 * day, two + 16 * day + 4 * hour, "IP")]


def test_falling_changes():
    assert S.falling_changes(np.array([1.0] * 10 + [-1.0] * 10), 1.5, 0.1) == [10]
    assert S.falling_changes(np.array([-1.0] * 10 + [1.0] * 10), 1.5, 0.1) == []
    assert S.falling_changes(np.zeros(1), 1.5, 0.1) == []
    # two falls with a rise between them
    assert S.falling_changes(np.array([1.0] * 5 + [-1.0] * 5 + [1.0] * 5 + [-1.0] * 5), 1.5, 0.1) == [5, 15]


def test_split_period():
    even = np.array([(50 * SECOND * k, 50 * SECOND * k + SECOND) for k in range(1, 20)])
    assert S.split_period(0, 951 * SECOND + 49 * SECOND, even, P)[0][2] == "IIP"  # even gaps: no change
    late = np.array([(x * SECOND, x * SECOND) for x in [100, 200, 300, 400, 410, 420, 430]])
    assert S.split_period(0, 440 * SECOND, late, P) == [(0, 400 * SECOND, "IIP"), (400 * SECOND, 440 * SECOND, "preUp")]
    early = np.array([(x * SECOND, x * SECOND) for x in [10, 20, 30, 40, 140, 240, 340]])
    assert S.split_period(0, 440 * SECOND, early, P) == [(0, 40 * SECOND, "postUp"), (40 * SECOND, 440 * SECOND, "IIP")]
    quiet = np.array([(x * SECOND, x * SECOND) for x in [150, 300, 450]])
    assert S.split_period(0, 600 * SECOND, quiet, P) == [(0, 150 * SECOND, "depr"), (150 * SECOND, 600 * SECOND, "IIP")]


def test_break_periods_without_bursts(spark):
    temp = table(spark, [(0, 100, "temp"), (100, 130, "IP"), (130, 400, "temp")], "state string")
    assert seen(S.break_periods(temp, table(spark, [(100, 130, 0)], "rank int"), P)) == [(0, 100, "IIP"), (100, 130, "IP"), (130, 400, "depr")]


def test_nibble(spark):
    s = table(spark, [(0, 1000, "IIP"), (1000, 1100, "IP"), (1100, 1200, "postUp"), (1200, 2000, "IIP"), (2000, 2100, "preUp")], "state string")
    assert seen(S.nibble(s, P)) == [(0, 180, "void"), (180, 1000, "IIP"), (1000, 1100, "IP"), (1100, 1200, "postUp"), (1200, 1800, "IIP"), (1800, 2000, "void"), (2000, 2100, "void")]
    # a protected state shortens the buffer, states beside art are void unless they are long IIP
    s = table(spark, [(0, 50, "postUp"), (50, 100, "IP"), (100, 150, "IIP"), (150, 170, "art"), (170, 500, "IIP"), (500, 900, "depr")], "state string")
    assert seen(S.nibble(s, P)) == [(0, 50, "void"), (50, 100, "IP"), (100, 150, "void"), (150, 170, "art"), (170, 500, "IIP"), (500, 900, "depr")]


def test_integrity_and_merge(spark):
    s = table(spark, [(0, 5, "void"), (5, 9, "IIP"), (9, 12, "IIP"), (12, 20, "depr"), (20, 30, "void"), (30, 40, "IP")], "state string")
    flagged = S.with_integrity(s)
    assert [r[3:] for r in seen(flagged, "begins", "ends")] == [(None, None), (False, True), (True, True), (True, True), (None, None), (False, False)]
    assert seen(S.merge_states(flagged), "begins", "ends")[1] == (5, 12, "IIP", False, True)


def test_validate_increases(spark):
    s = S.with_integrity(table(spark, [(0, 1000, "IIP"), (1000, 1100, "preUp"), (1100, 1200, "IP"), (1200, 1300, "postUp")], "state string"))
    t = [100 * k + 1 for k in range(10)] + [1001] + [1201, 1202, 1203]
    events = spark.createDataFrame([("r", x * SECOND) for x in t], "rec_id string, t long")
    assert [r[2] for r in seen(S.validate_increases(s, events, P))] == ["IIP", "IIP", "IP", "postUp"]
    short = S.StateParams(least_iip=1001 * SECOND)
    assert [r[2:] for r in seen(S.validate_increases(s, events, short), "begins", "ends")] == [("void", None, None), ("void", None, None), ("IP", True, True), ("void", None, None)]


def test_join_dense(spark):
    s = S.with_integrity(table(spark, [(0, 100, "postUp"), (100, 200, "IIP"), (200, 300, "preUp"), (300, 310, "IP"), (310, 400, "IIP")], "state string"))
    medium = table(spark, [(120, 140, 2), (320, 330, 2)], "rank int")
    assert seen(S.join_dense(s, medium, P), "begins", "ends") == [(0, 300, "Mdense", False, True), (300, 310, "IP", True, True), (310, 400, "IIP", True, False)]


def test_recordings_are_covered(spark, sf_dir):
    made = Q.state_segments(spark, sf_dir)
    ends = I.bounds_of(Q.train(spark, sf_dir)).where("hi > lo")
    assert made.count() > ends.count()
    assert I.coverage(made, ends).where("NOT covered").count() == 0
    assert made.groupBy("rec_id", "state_id").count().where("count > 1").count() == 0


def test_empty_recordings(spark):
    none = table(spark, [], "rank int")
    events = none.selectExpr("rec_id", "start AS t")
    made = S.segment(events, none, bounds(spark, 0, 2000), none.drop("rank"))
    assert seen(made) == [(0, 2000, "void")]
