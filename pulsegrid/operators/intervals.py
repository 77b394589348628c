"""Interval algebra on tables (rec_id, start, stop, ...) with start <= stop, times in whole microseconds.

All windows are partitioned by rec_id and ordered by time, so operators that follow one another share one shuffle and sort.
Rows with a null key or bound take no part in set operations.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REC = "rec_id"


def _order(*by: str):
    return Window.partitionBy(REC).orderBy(*by)


def expand(intervals: DataFrame, before: int, after: int) -> DataFrame:
    """Intervals with a margin on both sides; a table of points has its t instead of start and stop."""
    start, stop = ("t", "t") if "t" in intervals.columns else ("start", "stop")
    rest = [c for c in intervals.columns if c not in ("t", "start", "stop")]
    return intervals.select(*rest, (F.col(start) - before).alias("start"), (F.col(stop) + after).alias("stop"))


def interval_union(intervals: DataFrame, gap: int = 0, touch: bool = True) -> DataFrame:
    """(rec_id, start, stop) of the union; intervals at most `gap` apart are joined too (with touch=False: less than that apart).

    A new group begins where start lies beyond the largest stop so far. With rec_id and bounds known, order and overlaps are free.
    """
    known = intervals.select(REC, "start", "stop").where(f"{REC} IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL")
    so_far = F.max("stop").over(_order("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") - so_far
    new = F.coalesce((apart > gap) if touch else (apart >= gap), F.lit(True)).cast("int")
    grouped = known.withColumn("_new", new).withColumn("_group", F.sum("_new").over(_order("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(REC, "_group").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_group")


def merge_gaps(intervals: DataFrame, max_gap: int) -> DataFrame:
    """Intervals of which each begins less than max_gap after the one before are merged."""
    return interval_union(intervals, gap=max_gap, touch=False)


def interval_complement(intervals: DataFrame, bounds: DataFrame) -> DataFrame:
    """(rec_id, start, stop) of what the union leaves free within bounds (rec_id, lo, hi); recordings without intervals are free as a whole."""
    met = interval_union(intervals).join(bounds, REC).where("stop >= lo AND start <= hi")
    inside = met.select(REC, F.greatest("start", "lo").alias("start"), F.least("stop", "hi").alias("stop"))  # points too
    edges = bounds.select(REC, F.col("hi").alias("start"), F.col("hi").alias("stop"), F.col("lo"))
    rows = inside.withColumn("lo", F.lit(None).cast("long")).unionByName(edges)
    before = F.lag("stop").over(_order("start", "stop"))
    first = F.max("lo").over(Window.partitionBy(REC))
    return rows.select(REC, F.coalesce(before, first).alias("_from"), F.col("start").alias("_to")).where("_to > _from").select(REC, F.col("_from").alias("start"), F.col("_to").alias("stop"))


def clip(intervals: DataFrame, bounds: DataFrame) -> DataFrame:
    """Intervals within bounds (rec_id, lo, hi), all other columns kept; what is left empty goes."""
    return (
        intervals.join(bounds, REC)
        .withColumn("start", F.greatest("start", "lo"))
        .withColumn("stop", F.least("stop", "hi"))
        .where("stop > start")
        .drop("lo", "hi")
    )


def interval_subtract(a: DataFrame, b: DataFrame, width: int = 3_600_000_000) -> DataFrame:
    """The remnants of each interval of a outside all of b, with a's other columns.

    What b leaves free of the span of a's intervals meets a in an overlap join by time buckets of `width`.
    """
    span = a.groupBy(REC).agg(F.min("start").alias("lo"), F.max("stop").alias("hi"))
    met = overlap_join(a, interval_complement(b, span), width)
    rest = [c for c in a.columns if c not in (REC, "start", "stop")]
    return met.select(REC, F.greatest("start", "b_start").alias("start"), F.least("stop", "b_stop").alias("stop"), *rest)


def insert_predators(states: DataFrame, predators: DataFrame, label: str, min_duration: int) -> DataFrame:
    """(rec_id, start, stop, state) with predators strictly longer than min_duration put in place of what they cover of disjoint states.

    All borders are sorted together once; between two neighbouring ones the last state and predator begun tell what holds there.
    """
    kept = interval_union(predators.where(F.col("stop") - F.col("start") > min_duration))

    def borders(df: DataFrame, own: str, other: str, name) -> DataFrame:
        kind = "struct<a: bigint, z: bigint, state: string>"
        held = F.struct(F.col("start").alias("a"), F.col("stop").alias("z"), name.alias("state")).cast(kind)
        ends = F.array(F.struct(F.col("start").alias("t"), held.alias(own)), F.struct(F.col("stop").alias("t"), F.lit(None).cast(kind).alias(own)))
        return df.where("stop > start").select(REC, F.inline(ends)).withColumn(other, F.lit(None).cast(kind))

    both = borders(states, "_s", "_p", F.col("state")).unionByName(borders(kept, "_p", "_s", F.lit(label)))
    w = _order("t")
    last = {c: F.last(c, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)) for c in ("_s", "_p")}
    parts = both.select(REC, "t", F.lead("t").over(w).alias("_next"), last["_s"].alias("_s"), last["_p"].alias("_p")).where("_next > t")
    taken = F.coalesce(F.col("_p.z") > F.col("t"), F.lit(False))
    left = parts.withColumn("_taken", taken).where(F.col("_taken") | (F.col("_s.z") > F.col("t")))
    named = left.select(REC, F.when(F.col("_taken"), F.col("_p.a")).otherwise(F.col("t")).alias("_key"), F.when(F.col("_taken"), F.col("_p.state")).otherwise(F.col("_s.state")).alias("state"), F.col("t").alias("start"), F.col("_next").alias("stop"))
    return named.groupBy(REC, "_key", "state").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(REC, "start", "stop", "state")


#: An interval of more buckets than this is dealt to coarse ones, each as long as so many buckets.
COARSE = 1024


def overlap_join(a: DataFrame, b: DataFrame, width: int, closed: bool = False) -> DataFrame:
    """Pairs of overlapping intervals, b's columns prefixed with b_; closed: touching ones too.

    Each interval is dealt to the time buckets of `width` that it meets and pairs meet within a bucket, so a recording is spread
    over many tasks; a pair is kept in the first bucket that both reach only. Long intervals (of more than COARSE buckets) are dealt to
    coarse buckets, where they meet short and long ones under keys of their own; short ones never meet one another there.
    """
    coarse = width * COARSE

    def dealt(df: DataFrame, start: str, stop: str, as_long: int, as_short: int) -> DataFrame:
        first, last = F.expr(f"{start} div {width}"), F.expr(f"{stop} div {width}")
        wide = F.sequence(F.expr(f"{start} div {coarse}"), F.expr(f"{stop} div {coarse}"))
        key = lambda mode: lambda n: F.struct(F.lit(mode).alias("mode"), n.alias("n"))
        long = F.concat(F.transform(wide, key(as_long)), F.transform(wide, key(3)))
        short = F.concat(F.transform(F.sequence(first, F.when(last - first <= COARSE, last).otherwise(first)), key(0)), F.transform(wide, key(as_short)))
        return df.withColumn("_bucket", F.explode(F.when(last - first > COARSE, long).otherwise(short)))

    b_ = b.select(*(F.col(c).alias(c if c == REC else f"b_{c}") for c in b.columns))
    meet = (F.col("start") <= F.col("b_stop")) & (F.col("b_start") <= F.col("stop")) if closed else (F.col("start") < F.col("b_stop")) & (F.col("b_start") < F.col("stop"))
    begin = lambda size: F.greatest(F.expr(f"start div {size}"), F.expr(f"b_start div {size}"))
    once = F.col("_bucket.n") == F.when(F.col("_bucket.mode") == 0, begin(width)).otherwise(begin(coarse))
    return dealt(a, "start", "stop", 1, 2).join(dealt(b_, "b_start", "b_stop", 2, 1), [REC, "_bucket"]).where(meet & once).drop("_bucket")


def assign(events: DataFrame, intervals: DataFrame, keep: Iterable[str] = (), t: str = "t") -> DataFrame:
    """events with start and stop of the interval that holds t, both ends included (null: none), and its columns `keep`.

    Intervals are disjoint. Both tables are sorted together once by time and the last interval begun is carried forward, so the
    cost is that of one sort, however many events and intervals a recording has.
    """
    keep = list(keep)
    own = F.struct(F.col("start"), F.col("stop"), *keep)
    a = events.select(F.col(REC), F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*events.columns).alias("_e"), F.lit(None).cast(_struct(intervals, keep)).alias("_i"))
    b = intervals.where(f"{REC} IS NOT NULL").select(F.col(REC), F.col("start").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(events.select(F.struct(*events.columns)).schema[0].dataType).alias("_e"), own.alias("_i"))
    last = F.last("_i", ignorenulls=True).over(_order("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("_i", last).where("_side = 1")
    held = F.col("_t") <= F.col("_i.stop")
    return both.select("_e.*", *(F.when(held, F.col(f"_i.{c}")).alias(c) for c in ("start", "stop", *keep)))


def _struct(df: DataFrame, keep: list[str]):
    return df.select(F.struct("start", "stop", *keep)).schema[0].dataType


def mask_samples(samples: DataFrame, masks: DataFrame, value: str = "v") -> DataFrame:
    """samples (rec_id, t, value) with value null strictly between start and stop of a mask; where masks only touch their border is not masked."""
    placed = assign(samples, interval_union(masks, touch=False))
    return placed.withColumn(value, F.when(~F.coalesce((F.col("t") > F.col("start")) & (F.col("t") < F.col("stop")), F.lit(False)), F.col(value))).drop("start", "stop")


def with_neighbours(intervals: DataFrame) -> DataFrame:
    """intervals with the bounds of the one before and the one after in the recording (prev_start, prev_stop, next_start, next_stop; null: none)."""
    w = _order("start", "stop")
    return intervals.select("*", F.lag("start").over(w).alias("prev_start"), F.lag("stop").over(w).alias("prev_stop"), F.lead("start").over(w).alias("next_start"), F.lead("stop").over(w).alias("next_stop"))


def clean_events(events: DataFrame, masks: DataFrame) -> DataFrame:
    """Events that no mask holds (both ends of a mask count as masked)."""
    return assign(events, interval_union(masks)).where("start IS NULL").drop("start", "stop")


def contain_join(events: DataFrame, intervals: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Events with the disjoint interval that holds them; events in none are left out."""
    return assign(events, intervals, keep).where("start IS NOT NULL")


def analyzed_duration(bounds: DataFrame, masks: DataFrame, offset: int = 0) -> DataFrame:
    """(rec_id, dur): what of lo + offset to hi is not masked, masks being clipped to it."""
    own = bounds.select(REC, (F.col("lo") + offset).alias("lo"), "hi").where("hi > lo")
    masked = clip(interval_union(masks), own).groupBy(REC).agg(F.sum(F.col("stop") - F.col("start")).alias("m"))
    return own.join(masked, REC, "left").select(REC, (F.col("hi") - F.col("lo") - F.coalesce("m", F.lit(0))).alias("dur"))


def free_periods(events: DataFrame, bounds: DataFrame, masks: DataFrame, min_gap: int, margin: int) -> DataFrame:
    """Parts of recordings longer than min_gap without event or mask, shrunk by margin at both ends."""
    points = events.select(REC, F.col("t").alias("start"), F.col("t").alias("stop"))
    free = interval_complement(points.unionByName(masks.select(REC, "start", "stop")), bounds)
    return free.where(F.col("stop") - F.col("start") > min_gap).select(REC, (F.col("start") + margin).alias("start"), (F.col("stop") - margin).alias("stop")).where("stop > start")


def fuse_masks(stretches: DataFrame, points: DataFrame, stretch_margin: int, point_margin: int, min_distance: int) -> DataFrame:
    """Union of stretches and points with their margins, those at most min_distance apart joined."""
    both = expand(stretches, stretch_margin, stretch_margin).select(REC, "start", "stop").unionByName(expand(points, point_margin, point_margin).select(REC, "start", "stop"))
    return interval_union(both, gap=min_distance)


def coverage(states: DataFrame, bounds: DataFrame) -> DataFrame:
    """(rec_id, covered): whether states are contiguous, without overlap, from lo to hi."""
    broken = (F.col("start") != F.lag("stop").over(_order("start"))).cast("int")
    seen = states.withColumn("_broken", F.coalesce(broken, F.lit(0))).groupBy(REC).agg(F.sum("_broken").alias("b"), F.min("start").alias("a"), F.max("stop").alias("z"))
    return bounds.join(seen, REC, "left").select(REC, F.coalesce((F.col("b") == 0) & (F.col("a") == F.col("lo")) & (F.col("z") == F.col("hi")), F.lit(False)).alias("covered"))


def bounds_of(events: DataFrame, t: str | Column = "t") -> DataFrame:
    """(rec_id, lo, hi): first and last time of each recording."""
    return events.groupBy(REC).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
