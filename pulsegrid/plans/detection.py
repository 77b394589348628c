"""From signals to events and masks: the threshold of spectral peaks, events by amplitude, loud and saturated stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import SECOND
from pulsegrid.operators import events as E
from pulsegrid.operators import intervals as I
from pulsegrid.operators import runs as R
from pulsegrid.operators import signal as G
from pulsegrid.operators.intervals import REC
from pulsegrid.sources.scratch import kept

#: Thresholds at which peaks are counted.
THRESHOLDS = [round(-0.5 + 0.05 * k, 2) for k in range(131)]


def choose_threshold(counts: DataFrame, percent: float = 35.0, mode: str = "firstcross") -> DataFrame:
    """(rec_id, threshold) from (rec_id, threshold, n), where the count falls least.

    Counts equal to a recording's least or largest are left out; of the steps between the others those in the top `percent` are
    shallow. firstcross: the threshold before the first shallow step; bump: the one in the middle of the first longest run of them.
    Recordings with fewer than two counts left give no row.
    """
    if mode not in ("firstcross", "bump"):
        raise ValueError(f"unknown mode: {mode}")
    rec = Window.partitionBy(REC)
    w = rec.orderBy("threshold")
    inner = counts.withColumn("_lo", F.min("n").over(rec)).withColumn("_hi", F.max("n").over(rec)).where("n > _lo AND n < _hi")
    steps = inner.withColumn("_d", F.lead("n").over(w) - F.col("n")).withColumn("_i", F.row_number().over(w)).where("_d IS NOT NULL")
    place = F.row_number().over(rec.orderBy(F.desc("_d")))
    last = F.ceil(F.count("*").over(rec) * percent / 100.0)
    ranked = steps.withColumn("_place", place).withColumn("_last", last)
    cut = F.min(F.when(F.col("_place") <= F.col("_last"), F.col("_d"))).over(rec)
    shallow = ranked.withColumn("_cut", cut).where("_d >= _cut")
    if mode == "firstcross":
        return shallow.groupBy(REC).agg(F.min("threshold").alias("threshold"))
    runs = shallow.withColumn("_run", F.col("_i") - F.row_number().over(w)).groupBy(REC, "_run").agg(F.min("_i").alias("_a"), F.max("_i").alias("_z"))
    best = runs.groupBy(REC).agg(F.max_by(F.struct("_a", "_z"), F.struct(F.col("_z") - F.col("_a"), -F.col("_a"))).alias("_b"))
    middle = best.select(REC, (F.col("_b._a") + F.ceil((F.col("_b._z") - F.col("_b._a")) / 2)).alias("_i"))
    return inner.withColumn("_i", F.row_number().over(w)).join(middle, [REC, "_i"]).select(REC, "threshold")


def refractory_counts(peaks: DataFrame, dead_time: int, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(rec_id, threshold, n): events left at each threshold after thinning, of peaks (rec_id, t, v); n is zero where none is left.

    A peak is dealt to the thresholds it exceeds, a fixed number; thinning then runs in all of them at once.
    """
    steps = F.array(*map(F.lit, thresholds))
    dealt = peaks.select(REC, "t", F.explode(F.filter(steps, lambda s: s < F.col("v"))).alias("threshold"))
    keyed = dealt.select(F.struct(REC, "threshold").alias(REC), "t")
    left = E.refractory(keyed, dead_time).groupBy(REC).agg(F.count("*").alias("n")).select(f"{REC}.*", "n")
    every = peaks.select(REC).distinct().select(REC, F.explode(steps).alias("threshold"))
    return every.join(left, [REC, "threshold"], "left").select(REC, "threshold", F.coalesce("n", F.lit(0)).alias("n"))


def plateau_centers(samples: DataFrame, order: str = "t", value: str = "v") -> DataFrame:
    """(rec_id, order) of the middle sample of each run of two or more samples at a recording's largest value."""
    top = F.max(value).over(Window.partitionBy(REC))
    numbered = samples.withColumn("_i", F.row_number().over(Window.partitionBy(REC).orderBy(order))).withColumn("_top", top).where(F.col(value) == F.col("_top"))
    run = F.col("_i") - F.row_number().over(Window.partitionBy(REC).orderBy("_i"))
    whole = numbered.withColumn("_run", run).groupBy(REC, "_run").agg(F.sort_array(F.collect_list(order)).alias("_ts")).where(F.size("_ts") > 1)
    return whole.select(REC, F.get("_ts", F.floor((F.size("_ts") - 1) / 2).cast("int")).alias(order))


def padded(power: DataFrame, lengths: DataFrame, width: int) -> DataFrame:
    """Power (rec_id, i, v) of windows by their middle sample, and zeros for the samples of the recording (rec_id, n) that are the middle of none."""
    before = (width - 1) // 2
    ends = F.array(F.sequence(F.lit(0).cast("long"), F.least(F.lit(before), F.col("n")) - 1), F.sequence(F.greatest(F.col("n") - (width - 1 - before), F.lit(0)), F.col("n") - 1))
    zeros = lengths.where(f"n >= {width}").select(REC, F.explode(F.flatten(ends)).alias("i"), F.lit(0.0).alias("v"))
    return power.select(REC, (F.col("i") + before).alias("i"), "v").unionByName(zeros)


def spectral_events(power: DataFrame, dead_time: int, percent: float = 35.0, mode: str = "firstcross", threshold: float | None = None, standardised: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, thresholds) of band power (rec_id, t, v): thinned peaks whose next sample exceeds the threshold, which is chosen unless given.

    Power is standardised by recording first unless it is `standardised`.
    """
    z = power.where("v IS NOT NULL").select(REC, "t", "v") if standardised else E.zscore(power, "v", REC).where("z IS NOT NULL").select(REC, "t", F.col("z").alias("v"))
    near = E.with_sides(z)
    flat = (F.col("v") == F.col("_p")) | (F.col("v") == F.col("_n"))
    border = F.col("_p").isNull() | F.col("_n").isNull()
    tops = near.withColumn("_flat", F.coalesce(flat, F.lit(False))).where(F.expr("_p < v AND v > _n") | F.col("_flat") | border)
    tops = kept(tops.select(REC, "t", "v", "_p", "_n", "_i", "_flat"), "peaks")  # few of the samples; what follows reads them several times
    level = F.col("_flat") & (F.col("v") == F.max("v").over(Window.partitionBy(REC)))
    runs = tops.withColumn("_level", level).where("_level").withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(REC).orderBy("_i")))
    lists = runs.groupBy(REC, "_run").agg(F.sort_array(F.collect_list("t")).alias("_ts")).where(F.size("_ts") > 1)
    centers = lists.select(REC, F.get("_ts", F.floor((F.size("_ts") - 1) / 2).cast("int")).alias("t"), F.lit(float("inf")).alias("v"))
    peaks = tops.where("_p < v AND v > _n").select(REC, "t", F.col("_n").alias("v")).unionByName(centers)
    if threshold is None:
        chosen = choose_threshold(refractory_counts(peaks, dead_time), percent, mode)
    else:
        chosen = peaks.select(REC).distinct().withColumn("threshold", F.lit(float(threshold)))
    over = peaks.join(chosen, REC).where(F.col("v") > F.col("threshold"))
    return E.refractory(over, dead_time), chosen


def amplitude_events(samples: DataFrame, events: DataFrame, margin: int, dead_time: int, limit: float = 4.5, polarity: str = "neg") -> DataFrame:
    """(rec_id, t): crossings of +-limit deviations by samples (rec_id, t, v) away from the events found so far.

    Free are samples more than margin from the events on both sides, between the first and the last event; without events, all.
    A crossing counts that is the first, or more than dead_time of free samples after the crossing before.
    """
    w = Window.partitionBy(REC).orderBy("t", "_side")
    rows = samples.select(REC, "t", "v", F.lit(1).alias("_side")).unionByName(events.select(REC, "t", F.lit(None).cast("double").alias("v"), F.lit(0).alias("_side")))
    own = F.when(F.col("_side") == 0, F.col("t"))
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(REC).orderBy(F.desc("t"), F.desc("_side"))
    after = F.last(own, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_b", before).withColumn("_a", after).where("_side = 1 AND v IS NOT NULL")
    none = F.col("_b").isNull() & F.col("_a").isNull()
    free = placed.where(none | ((F.col("t") - F.col("_b") > margin) & (F.col("_a") - F.col("t") > margin)))
    z = E.zscore(free, "v", REC)
    time = Window.partitionBy(REC).orderBy("t")
    spent = F.coalesce(F.when(F.col("_b").eqNullSafe(F.lag("_b").over(time)), F.col("t") - F.lag("t").over(time)), F.lit(0))
    clock = z.withColumn("_spent", spent).withColumn("_clock", F.sum("_spent").over(time.rowsBetween(Window.unboundedPreceding, 0)))
    hit = {"pos": F.col("z") > limit, "neg": F.col("z") < -limit, "mix": F.abs("z") > limit}[polarity]
    gap = F.col("_clock") - F.lag("_clock").over(time)
    return clock.where(hit).withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > dead_time)).select(REC, "t")


def loud_stretches(samples: DataFrame, sr: float, window: float = 1.0, high: float = 4.0, low: float = 2.0, high_time: float = 0.5, low_time: float = 1.2, crossing: float = 0.12, order: str = "i") -> DataFrame:
    """(rec_id, first, last) of samples (rec_id, i, v): suggested masks of high power and few zero crossings.

    Runs of the standardised running power at or above low, of at least low_time, that hold a run at or above high of more than
    high_time and in which non-negative runs of samples are crossing or more apart on average (or do not occur).
    """
    power = E.zscore(E.running_rms(samples, int(sr * window), order), "rms", REC)
    w = Window.partitionBy(REC).orderBy(order)

    def starts(c: Column) -> Column:
        return (c & ~F.coalesce(F.lag(c).over(w), F.lit(False))).cast("long")

    loud = F.coalesce(F.col("z") >= high, F.lit(False))
    marked = power.withColumn("_high", loud).withColumn("_up", F.col("v") >= 0).withColumn("_low", F.coalesce(F.col("z") >= low, F.lit(False)))
    marked = marked.withColumn("_run", F.sum(starts(F.col("_low"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_peak", F.sum(starts(F.col("_high"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_low")
    inside = Window.partitionBy(REC, "_run").orderBy(order)
    up = (F.col("_up") & ~F.coalesce(F.lag("_up").over(inside), F.lit(False))).cast("long")
    peaks = marked.withColumn("_cross", up).groupBy(REC, "_run", "_peak").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum("_cross").alias("_c"), F.sum(F.col("_high").cast("long")).alias("_h"))
    runs = peaks.groupBy(REC, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("_c").alias("_c"), F.max("_h").alias("_h"))
    length = F.col("last") - F.col("first")
    rare = (F.col("_c") == 0) | (length / F.col("_c") >= crossing * sr)
    return runs.where((F.col("_h") - 1 > high_time * sr) & (length >= low_time * sr) & rare).select(REC, "first", "last")


def chunked_saturation_points(chunks: DataFrame, sr: float, stump_time: float = 0.008, tooth_time: float = 0.03, stump_width: float = 1e-3, tooth_bend: float = 1e-2, limit: float = 5.0) -> DataFrame:
    """saturation_points of chunks: runs are found chunk by chunk, and only the samples of runs become rows."""
    inside = R.samples_of(chunks, R.beyond(chunks, limit))
    runs = inside.select(REC, F.col("side").alias("_side"), F.col("first").alias("_run"), "i", F.col("i").alias("_i"), "v")
    return _points_of_runs(runs, int(stump_time * sr), int(tooth_time * sr), stump_width, tooth_bend, "i")


def chunked_masks(chunks: DataFrame, sr: float, stretch_margin: int = 3 * SECOND, point_margin: int = 2 * SECOND, min_distance: int = 100 * SECOND, loud: dict | None = None, saturated: dict | None = None) -> DataFrame:
    """suggested_masks of chunks, which are written once, as both kinds of mask read them several times."""
    chunks = kept(chunks, "chunks")
    return _fused(R.loud_stretches(chunks, sr, **(loud or {})), chunked_saturation_points(chunks, sr, **(saturated or {})), sr, stretch_margin, point_margin, min_distance)


def saturation_points(samples: DataFrame, sr: float, stump_time: float = 0.008, tooth_time: float = 0.03, stump_width: float = 1e-3, tooth_bend: float = 1e-2, limit: float = 5.0, order: str = "i") -> DataFrame:
    """(rec_id, i, kind): in long runs beyond limit deviations, the largest sample of those that are flat (stump) or straight (tooth).

    Flat: enough samples strictly within stump_width of one of them. Straight: enough neighbours of one sign with second
    differences of at most tooth_bend. A point that is both is a stump.
    """
    stump, tooth = int(stump_time * sr), int(tooth_time * sr)
    z = E.zscore(samples, "v", REC)
    w = Window.partitionBy(REC).orderBy(order)
    side = F.when(F.col("z") >= limit, 1).when(F.col("z") <= -limit, -1)
    sided = z.withColumn("_side", side).withColumn("_i", F.row_number().over(w)).where("_side IS NOT NULL")
    of_side = Window.partitionBy(REC, "_side").orderBy("_i")
    runs = sided.withColumn("_run", F.col("_i") - F.row_number().over(of_side))
    return _points_of_runs(runs, stump, tooth, stump_width, tooth_bend, order)


def _points_of_runs(runs: DataFrame, stump: int, tooth: int, stump_width: float, tooth_bend: float, order: str) -> DataFrame:
    """(rec_id, order, kind) of samples (rec_id, _side, _run, _i, order, v) of runs, of which the last is the border."""
    runs = runs.withColumn("_x", F.abs("v"))
    run = Window.partitionBy(REC, "_side", "_run")
    inside = runs.withColumn("_n", F.count("*").over(run)).withColumn("_place", F.row_number().over(run.orderBy("_i")))
    inside = inside.where(F.col("_place") < F.col("_n"))  # the last sample of a run is its border
    reach = f"{stump_width * (1 - 1e-12)!r}D"
    near = F.expr(f"count(*) OVER (PARTITION BY {REC}, _side, _run ORDER BY _x RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)")
    bend = F.abs(F.lead("v", 2).over(run.orderBy("_i")) - 2 * F.lead("v").over(run.orderBy("_i")) + F.col("v"))
    told = inside.withColumn("_near", near).withColumn("_straight", bend <= tooth_bend)
    straight = F.coalesce("_straight", F.lit(False))
    told = told.withColumn("_new", (straight & ~F.coalesce(F.lag(straight).over(run.orderBy("_i")), F.lit(False))).cast("int"))
    told = told.withColumn("_tooth", F.when(straight, F.sum("_new").over(run.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))))
    length = F.count("_tooth").over(Window.partitionBy(REC, "_side", "_run", "_tooth"))
    told = told.withColumn("_long", F.when(F.col("_tooth").isNotNull(), length))
    found = told.groupBy(REC, "_side", "_run", "_n").agg(F.max_by(order, F.struct("_x", -F.col("_i"))).alias(order), F.max("_near").alias("_near"), F.max("_long").alias("_long"))
    kind = F.when((F.col("_n") - 1 > stump) & (F.col("_near") >= stump), "stump").when((F.col("_n") - 1 > tooth) & (F.col("_long") >= tooth - 1), "tooth")
    return found.select(REC, order, kind.alias("kind")).where("kind IS NOT NULL")


def detect(chunks: DataFrame, width: int = 128, low: float = 4.0, high: float = 40.0, dead_time: int = 83_333, margin: int = SECOND // 5, limit: float = 4.5, polarity: str = "neg", threshold: float | None = None, scope: str = "recording") -> DataFrame:
    """(rec_id, t, kind) of chunked signals: events by band power (spectral) and by amplitude (amp), times from the recording's first sample.

    Power is standardised over the windows there are and padded to the recording's length with zeros. Chunks are written once, as all steps read them.
    """
    chunks = kept(chunks, "chunks")
    rate = chunks.groupBy(REC).agg(F.first("sr").alias("_sr"), F.max(F.col("i0") + F.size("v")).alias("n"))
    at = (F.col("i") * SECOND / F.col("_sr")).cast("long").alias("t")
    bands = padded(G.band_power(chunks, width, low, high, scope=scope), rate.select(REC, "n"), width)
    spectral, _ = spectral_events(bands.join(rate, REC).select(REC, at, "v"), dead_time, threshold=threshold, standardised=True)
    spectral = kept(spectral, "spectral")  # read by both kinds
    by_size = R.amplitude_events(chunks, spectral, margin, dead_time, limit, polarity)
    return spectral.withColumn("kind", F.lit("spectral")).unionByName(by_size.withColumn("kind", F.lit("amp")))


def suggested_masks(samples: DataFrame, sr: float, stretch_margin: int = 3 * SECOND, point_margin: int = 2 * SECOND, min_distance: int = 100 * SECOND, loud: dict | None = None, saturated: dict | None = None) -> DataFrame:
    """(rec_id, start, stop) in microseconds of samples (rec_id, i, v): loud stretches and saturation points with their margins, fused."""
    return _fused(loud_stretches(samples, sr, **(loud or {})), saturation_points(samples, sr, **(saturated or {})), sr, stretch_margin, point_margin, min_distance)


def _fused(stretches: DataFrame, points: DataFrame, sr: float, stretch_margin: int, point_margin: int, min_distance: int) -> DataFrame:
    step = SECOND / sr
    stretches = stretches.select(REC, (F.col("first") * step).cast("long").alias("start"), (F.col("last") * step).cast("long").alias("stop"))
    points = points.select(REC, (F.col("i") * step).cast("long").alias("t"))
    return I.fuse_masks(stretches, points, stretch_margin, point_margin, min_distance)
