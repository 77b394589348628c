"""Segmentation of whole recordings into states, in six levels that each take and return (rec_id, start, stop, state, ...).

Severe periods (IP) come from severe bursts; what lies between them is split at change points of the gaps between its bursts into
depr or postUp, IIP and preUp (dense where these cross); long masks become art; both ends of a recording become void as far as no
state protects them; periods that cannot be told from the rest go back to IIP; IIP full of medium bursts become Mdense.

States are few against events: windows over them are by recording. Times are whole microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import SECOND
from pulsegrid.operators.intervals import REC, clip, insert_predators, interval_union, merge_gaps, overlap_join
from pulsegrid.operators.signal import cusum_alarms

#: What becomes of states at the beginning and the end of a recording.
ENDS = {
    "start": {"protected": ("IP", "preUp"), "cut": ("IIP", "art"), "whole": ("postUp", "depr", "dense")},
    "stop": {"protected": ("IP", "postUp", "depr"), "cut": ("IIP", "art"), "whole": ("preUp", "dense")},
}
UNSAFE = ("void", "art")


@dataclass(frozen=True)
class StateParams:
    """Times in microseconds."""

    severe_gap: int = 180 * SECOND
    severe: tuple[int, ...] = (0, 1)
    quiet: int = 120 * SECOND
    threshold: float = 1.5
    drift: float = 0.1
    mask_duration: int = 10 * SECOND
    first_buffer: int = 180 * SECOND
    last_buffer: int = 300 * SECOND
    least_iip: int = 900 * SECOND
    medium: tuple[int, ...] = (2,)
    medium_share: float = 0.15
    bucket: int = 3600 * SECOND


def _by_time():
    return Window.partitionBy(REC).orderBy("start", "stop")


def _held(states: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of both tables in one, with _s, the last of the (disjoint) states begun at or before start. One sort, each table read once."""
    own = states.select(REC, "start", F.lit(0).alias("_side"), F.struct(*(c for c in states.columns if c != REC)).alias("_s"))
    other = points.select(REC, "start", F.lit(1).alias("_side"), F.lit(None).cast(own.schema["_s"].dataType).alias("_s"), *(c for c in points.columns if c not in (REC, "start")))
    last = F.last("_s", ignorenulls=True).over(Window.partitionBy(REC).orderBy("start", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return own.unionByName(other, allowMissingColumns=True).withColumn("_s", last).where("_s IS NOT NULL")


def severe_periods(bursts: DataFrame, bounds: DataFrame, p: StateParams) -> DataFrame:
    """Level 1: severe bursts less than severe_gap apart make an IP, the rest of the bounds is temp."""
    ip = clip(merge_gaps(bursts.where(F.col("rank").isin(*p.severe)), p.severe_gap), bounds)
    end = bounds.where("hi > lo").select(REC, F.col("hi").alias("start"), F.col("hi").alias("stop"), "lo")
    rows = ip.unionByName(end, allowMissingColumns=True)
    free_from = F.coalesce(F.lag("stop").over(_by_time()), F.max("lo").over(Window.partitionBy(REC)))
    two = F.array(F.struct(free_from.alias("start"), F.col("start").alias("stop"), F.lit("temp").alias("state")), F.struct("start", "stop", F.lit("IP").alias("state")))
    return rows.select(REC, two.alias("_two")).select(REC, F.inline("_two")).where("stop > start")


def falling_changes(x: np.ndarray, threshold: float, drift: float) -> list[int]:
    """Indices of the alarms for falls of x that each begin a fall: the highest point since the alarm before lies after that alarm.

    Where a fall goes on after its alarm, further alarms for it are left out. Ends of changes are not looked for, so a fall that
    begins before the one before it has ended counts too.
    """
    alarms = cusum_alarms(x, threshold, drift)
    return [a.at for before, a in zip([None, *alarms], alarms, strict=False) if a.falling and (before is None or not before.falling or a.onset > before.at)]


def split_period(start: int, stop: int, bursts: np.ndarray, p: StateParams) -> list[tuple[int, int, str]]:
    """States of one period with bursts (n, 2), in order of time."""
    from_, to = bursts[:, 0], bursts[:, 1]
    gaps = np.concatenate([from_, [stop]]).astype(float) - np.concatenate([[start], to])
    sd = gaps.std()
    z = (gaps - gaps.mean()) / sd if sd > 0 else np.zeros(len(gaps))
    before, after = falling_changes(z, p.threshold, p.drift), falling_changes(z[::-1], p.threshold, p.drift)
    head, label = start, "postUp"
    if from_[0] - start >= p.quiet:
        head, label = int(from_[0]), "depr"
    elif after:
        head = int(to[len(to) - after[-1]])
    tail = int(from_[before[-1] - 1]) if before else stop
    if head > tail:
        return [(start, stop, "dense")]
    return [s for s in ((start, head, label), (head, tail, "IIP"), (tail, stop, "preUp")) if s[1] > s[0]]


def break_periods(states: DataFrame, bursts: DataFrame, p: StateParams) -> DataFrame:
    """Level 2: temp periods become depr, postUp, IIP, preUp or dense. The bursts of one period meet in one task."""
    rows = _held(states, bursts.select(REC, "start", F.col("stop").alias("until"))).where("_side = 0 OR (_s.state = 'temp' AND until <= _s.stop)")
    kind = states.schema[REC].dataType.simpleString()
    inside = F.sort_array(F.collect_list(F.when(F.col("_side") == 1, F.array("start", "until"))))  # nulls, the states' own rows, are left out
    periods = rows.groupBy(REC, "_s").agg(inside.alias("inside")).select(REC, "_s.start", "_s.stop", "_s.state", "inside")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for rec, start, stop, state, held in zip(f[REC], f["start"], f["stop"], f["state"], f["inside"], strict=True):
                if state != "temp":
                    made.append((rec, start, stop, state))
                elif len(held):
                    made += [(rec, *s) for s in split_period(start, stop, np.stack(held), p)]
                else:
                    made.append((rec, start, stop, "depr" if stop - start >= p.quiet else "IIP"))
            yield pd.DataFrame(made, columns=[REC, "start", "stop", "state"])

    return periods.mapInPandas(run, f"{REC} {kind}, start long, stop long, state string")


def _void_end(states: DataFrame, side: str, buffer: int) -> DataFrame:
    """One end of nibble(): what overlaps the buffer and is not protected becomes void, as a whole or as far as the buffer reaches."""
    w, rule = Window.partitionBy(REC), ENDS[side]
    guard = F.col("state").isin(*rule["protected"])
    if side == "start":
        lo = F.min("start").over(w)
        hi = F.least(lo + buffer, F.min(F.when(guard, F.col("start"))).over(w))
    else:
        hi = F.max("stop").over(w)
        lo = F.greatest(hi - buffer, F.max(F.when(guard, F.col("stop"))).over(w))
    met = states.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_met", F.expr("start < _hi AND stop > _lo"))

    def piece(a: Column, b: Column, name: Column) -> Column:
        return F.struct(a.alias("start"), b.alias("stop"), name.alias("state"))

    s, e, void = F.col("start"), F.col("stop"), F.lit("void")
    cut = F.array(piece(s, F.least(e, F.col("_lo")), F.col("state")), piece(F.greatest(s, F.col("_lo")), F.least(e, F.col("_hi")), void), piece(F.greatest(s, F.col("_hi")), e, F.col("state")))
    whole = F.array(piece(s, e, F.when(F.col("_met") & F.col("state").isin(*rule["whole"]), void).otherwise(F.col("state"))))
    pieces = F.when(F.col("_met") & F.col("state").isin(*rule["cut"]), cut).otherwise(whole)
    return met.select(REC, F.explode(pieces).alias("_p")).select(REC, "_p.*").where("stop > start")


def nibble(states: DataFrame, p: StateParams) -> DataFrame:
    """Level 4: the buffers at both ends become void up to the first and last protected state; so do states beside art (IIP only if short)."""
    ends = _void_end(_void_end(states, "start", p.first_buffer), "stop", p.last_buffer)
    beside = F.coalesce(F.lag("state").over(_by_time()) == "art", F.lit(False)) | F.coalesce(F.lead("state").over(_by_time()) == "art", F.lit(False))
    short = F.expr("stop - start") < p.quiet
    lost = F.col("_beside") & (F.col("state").isin("postUp", "preUp", "depr", "dense") | ((F.col("state") == "IIP") & short))
    return ends.withColumn("_beside", beside).withColumn("state", F.when(lost, "void").otherwise(F.col("state"))).drop("_beside")


def with_integrity(states: DataFrame) -> DataFrame:
    """states with begins and ends: whether that end is a true one (null for void and art); a depr before void ends truly."""
    marked = states.withColumn("_b", F.lag("state").over(_by_time())).withColumn("_a", F.lead("state").over(_by_time()))
    own = ~F.col("state").isin(*UNSAFE)
    begins = F.coalesce(~F.col("_b").isin(*UNSAFE), F.lit(False))
    ends = F.coalesce(~F.col("_a").isin(*UNSAFE) | ((F.col("state") == "depr") & (F.col("_a") == "void")), F.lit(False))
    return marked.withColumn("begins", F.when(own, begins)).withColumn("ends", F.when(own, ends)).drop("_b", "_a")


def merge_states(states: DataFrame, only: str | None = None) -> DataFrame:
    """Neighbours of one state (or those of state `only`) as one, with begins of the first and ends of the last."""
    same = F.col("state") == F.lag("state").over(_by_time())
    if only is not None:
        same = same & (F.col("state") == only)
    marked = states.withColumn("_new", F.coalesce((~same).cast("int"), F.lit(1)))
    runs = marked.withColumn("_run", F.sum("_new").over(_by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(REC, "_run", "state").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("begins", "start").alias("begins"), F.max_by("ends", "start").alias("ends")).select(REC, "start", "stop", "state", "begins", "ends")


def validate_increases(states: DataFrame, events: DataFrame, p: StateParams) -> DataFrame:
    """Level 5: with too little IIP in a recording preUp, postUp and IIP become void; else those with no higher rate than IIP become IIP.

    An event on the border of two states counts for the later one.
    """
    held = _held(states, events.select(REC, F.col("t").alias("start"))).where("start <= _s.stop")
    counts = held.groupBy(REC, "_s").agg(F.sum("_side").alias("_n"))
    known = counts.select(REC, "_s.*", "_n").withColumn("_d", F.expr("stop - start"))
    w, iip = Window.partitionBy(REC), F.col("state") == "IIP"
    total = F.coalesce(F.sum(F.when(iip, F.col("_d"))).over(w), F.lit(0))
    events_in = F.coalesce(F.sum(F.when(iip, F.col("_n"))).over(w), F.lit(0))
    known = known.withColumn("_total", total).withColumn("_events", events_in)
    lost = (F.col("_total") < p.least_iip) & F.col("state").isin("preUp", "postUp", "IIP")
    weak = F.col("state").isin("preUp", "postUp") & (F.col("_n") * F.col("_total") <= F.col("_events") * F.col("_d"))
    state = F.when(lost, "void").when(weak, "IIP").otherwise(F.col("state"))
    flags = (F.when(~lost, F.col(c)).alias(c) for c in ("begins", "ends"))
    return known.select(REC, "start", "stop", state.alias("state"), *flags)


def join_dense(states: DataFrame, bursts: DataFrame, p: StateParams) -> DataFrame:
    """Level 6: an IIP of which medium bursts take more than medium_share becomes, with preUp and postUp beside it, Mdense."""
    medium = bursts.where(F.col("rank").isin(*p.medium)).select(REC, "start", "stop")
    held = overlap_join(states.where("state = 'IIP'").select(REC, "start", "stop"), medium, p.bucket)
    share = held.groupBy(REC, "start", "stop").agg(F.sum(F.expr("b_stop - b_start")).alias("_m"))
    full = states.join(share, [REC, "start", "stop"], "left").withColumn("_full", F.coalesce(F.col("_m") > p.medium_share * F.expr("stop - start"), F.lit(False)))
    beside = F.coalesce(F.lag("_full").over(_by_time()), F.lit(False)) | F.coalesce(F.lead("_full").over(_by_time()), F.lit(False))
    dense = F.col("_full") | (F.col("_beside") & F.col("state").isin("preUp", "postUp"))
    named = full.withColumn("_beside", beside).withColumn("state", F.when(dense, "Mdense").otherwise(F.col("state")))
    return merge_states(named.select(*states.columns), only="Mdense")


def segment(events: DataFrame, bursts: DataFrame, bounds: DataFrame, masks: DataFrame, params: StateParams | None = None) -> DataFrame:
    """(rec_id, state_id, state, start, stop, begins, ends) of recordings within bounds (rec_id, lo, hi), from bursts (start, stop, rank)."""
    p = params or StateParams()
    first = break_periods(severe_periods(bursts, bounds, p), bursts, p)
    long_masks = clip(interval_union(masks).where(F.expr("stop - start") > p.mask_duration), bounds)
    masked = insert_predators(first, long_masks, "art", 0)
    whole = merge_states(with_integrity(nibble(masked, p)))
    valid = merge_states(validate_increases(whole, events, p))
    made = join_dense(valid, bursts, p)
    number = F.row_number().over(_by_time())
    return made.select(REC, F.format_string("S%02d", number).alias("state_id"), "state", "start", "stop", "begins", "ends")
