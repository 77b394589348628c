"""Runs of marked samples in chunked signals, found chunk by chunk and joined across borders.

A chunk gives a short row for each run it holds; what has to be known to join two of them (does a run reach the chunk's first or
last sample, what was the state there) is in the row. Only these rows meet by recording, never samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import signal as G
from pulsegrid.operators.intervals import REC, overlap_join
from pulsegrid.sources.scratch import kept

RUN = "first long, last long"


def edges(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    step = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def moments(chunks: DataFrame) -> DataFrame:
    """(rec_id, n, mean, sd) of all samples of chunks (v array), null and NaN left out: moments of each chunk, merged about their common mean."""
    known = F.filter("v", lambda x: x.isNotNull() & ~F.isnan(x))
    own = chunks.select(REC, known.alias("_v")).select(REC, F.size("_v").alias("n"), "_v").where("n > 0")
    mean = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / F.col("n")
    parts = own.withColumn("m", mean).withColumn("q", F.aggregate("_v", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m")))).select(REC, "n", "m", "q")
    means = parts.groupBy(F.col(REC).alias("_rec")).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    met = parts.join(means, F.col(REC).eqNullSafe(F.col("_rec")))
    total = met.groupBy(REC).agg(F.sum("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("q") + F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("_q"))
    return total.select(REC, "n", "mean", F.sqrt(F.col("_q") / F.col("n")).alias("sd"))


def standardised(chunks: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """chunks with v standardised by recording (null where the deviation is 0)."""
    told = (moments(chunks) if stats is None else stats).select(F.col(REC).alias("_rec"), "mean", "sd")
    met = chunks.join(told, F.col(REC).eqNullSafe(F.col("_rec")), "left")
    return met.withColumn("v", F.when(F.col("sd") > 0, F.transform("v", lambda x: (x - F.col("mean")) / F.col("sd"))).otherwise(F.transform("v", lambda x: F.lit(None).cast("double")))).drop("_rec", "mean", "sd")


def running_rms(chunks: DataFrame, width: int) -> DataFrame:
    """chunks with rms: the root of the sum of squares in the frame of `width` samples around each, by width at the edges too."""
    before, after = width // 2, (width - 1) // 2
    ones, none = np.ones(width), np.zeros(0)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, v, b in zip(f["left"], f["v"], f["right"], strict=True):
                x = np.concatenate([np.zeros(before - len(a)), np.asarray(a, float), np.asarray(v, float), np.asarray(b, float), np.zeros(after - len(b))])
                x = np.nan_to_num(x) ** 2
                out.append(np.sqrt(np.maximum(np.convolve(x, ones, "valid"), 0) / width) if len(v) else none)
            yield f[[REC, "chunk_id", "i0", "sr", "v"]].assign(rms=out)

    kind = chunks.schema[REC].dataType.simpleString()
    haloed = G.with_halo(chunks, before, after).select(REC, "chunk_id", "i0", "sr", "v", "left", "right")
    return haloed.mapInPandas(each, f"{REC} {kind}, chunk_id long, i0 long, sr double, v array<double>, rms array<double>")


def of_chunks(chunks: DataFrame, columns: list[str], find: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(rec_id, first, last, ...) of find(*arrays) for the array columns of each chunk; `schema` names what find's arrays are besides first and last.

    Arrays of a batch of chunks become one frame: chunks can be short and many.
    """
    own = chunks.select(REC, "i0", *columns)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [find(*(np.asarray(x, float) for x in arrays)) for arrays in zip(*(f[c] for c in columns), strict=True)]
            if parts:
                own = np.repeat(np.arange(len(f)), [len(p["first"]) for p in parts])
                found = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
                i0 = f["i0"].to_numpy()[own]
                yield pd.DataFrame({REC: f[REC].iloc[own].reset_index(drop=True)} | found | {n: found[n] + i0 for n in ("first", "last")})

    return own.mapInPandas(each, f"{REC} {chunks.schema[REC].dataType.simpleString()}, {RUN}{', ' + schema if schema else ''}")


def joined(parts: DataFrame, *by: str, **totals: Column) -> DataFrame:
    """Runs of parts (rec_id, by, first, last, ...): those that follow one another without a gap are one; `totals` are summed over its parts.

    In `totals`, F.lag over `along(*by)` reaches the part before.
    """
    new = F.coalesce((F.col("first") > F.lag("last").over(along(*by)) + 1).cast("int"), F.lit(1))
    marked = parts.withColumn("_new", new)
    for name, value in totals.items():
        marked = marked.withColumn(name, value)
    run = F.sum("_new").over(along(*by).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", run).groupBy(REC, *by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), *(F.sum(n).alias(n) for n in totals)).drop("_run")


def along(*by: str):
    """Parts of a recording (and `by`) in order."""
    return Window.partitionBy(REC, *by).orderBy("first")


def at_or_above(chunks: DataFrame, limit: float) -> DataFrame:
    """(rec_id, first, last): runs of samples at or above limit, both ends included; a null or NaN ends a run."""

    def find(v: np.ndarray) -> dict[str, np.ndarray]:
        a, z = edges(v >= limit)
        return {"first": a, "last": z}

    return joined(of_chunks(chunks, ["v"], find, ""))


def loud_stretches(chunks: DataFrame, sr: float, window: float = 1.0, high: float = 4.0, low: float = 2.0, high_time: float = 0.5, low_time: float = 1.2, crossing: float = 0.12) -> DataFrame:
    """(rec_id, first, last) of chunks: suggested masks of high power and few zero crossings, as detection.loud_stretches finds them in samples.

    Runs of the standardised running power at or above low, of at least low_time, that hold a run at or above high of more than
    high_time and in which non-negative runs of samples are crossing or more apart on average (or do not occur).
    """
    powered = kept(running_rms(chunks, int(sr * window)), "power")  # read for the moments and for the runs
    stats = moments(powered.select(REC, F.col("rms").alias("v"))).select(F.col(REC).alias("_rec"), "mean", "sd")
    z = powered.join(stats, F.col(REC).eqNullSafe(F.col("_rec"))).where("sd > 0").withColumn("z", F.transform("rms", lambda x: (x - F.col("mean")) / F.col("sd")))

    def parts_of(v: np.ndarray, z: np.ndarray) -> dict[str, np.ndarray]:
        """Runs of low power (with how often the signal turns non-negative in each, and how it is at both ends), and of high power."""
        a, b = edges(z >= low)
        up = v >= 0
        begins = up & ~np.concatenate([[False], up[:-1]])
        counts = np.concatenate([[0], np.cumsum(begins)])
        inside = counts[b + 1] - counts[a] + (up[a] & ~begins[a]) if len(a) else np.zeros(0, int)
        c, d = edges(z >= high)
        none = np.zeros(len(c), bool)
        whole = {"first": (a, c), "last": (b, d), "ups": (inside, none.astype(int)), "head": (up[a], none), "tail": (up[b], none), "loud": (np.zeros(len(a), bool), ~none)}
        return {n: np.concatenate(x) for n, x in whole.items()}

    every = kept(of_chunks(z, ["v", "z"], parts_of, "ups long, head boolean, tail boolean, loud boolean"), "runs")
    touches = (F.lag("last").over(along()) + 1 == F.col("first")) & F.lag("tail").over(along()) & F.col("head")
    quiet = joined(every.where("NOT loud"), ups=F.col("ups") - F.coalesce(touches, F.lit(False)).cast("long"))
    loud = joined(every.where("loud")).where(F.col("last") - F.col("first") > high_time * sr)
    length = F.col("last") - F.col("first")
    long = quiet.where((length >= low_time * sr) & ((F.col("ups") == 0) | (length / F.col("ups") >= crossing * sr)))
    both = long.select(REC, "first", "last", F.lit(0).alias("_side")).unionByName(loud.select(REC, "first", F.lit(None).cast("long").alias("last"), F.lit(1).alias("_side")))
    stretch = F.last(F.when(F.col("_side") == 0, F.struct("first", "last")), ignorenulls=True).over(Window.partitionBy(REC).orderBy("first", "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_in", stretch).where((F.col("_side") == 1) & (F.col("first") <= F.col("_in.last")))
    return found.select(REC, "_in.first", "_in.last").distinct()


def beyond(chunks: DataFrame, limit: float) -> DataFrame:
    """(rec_id, side, first, last): runs of samples at limit or more deviations from the recording's mean, above (1) and below (-1)."""

    def find(z: np.ndarray) -> dict[str, np.ndarray]:
        parts = [(a, b, np.full(len(a), s)) for s, (a, b) in ((1, edges(z >= limit)), (-1, edges(z <= -limit)))]
        return {n: np.concatenate([p[k] for p in parts]) for k, n in enumerate(("first", "last", "side"))}

    return joined(of_chunks(standardised(chunks), ["v"], find, "side int"), "side")


def samples_of(chunks: DataFrame, runs: DataFrame, width: int = 65_536) -> DataFrame:
    """(rec_id, side, first, last, i, v) of every sample of the runs; chunks meet runs by buckets of `width` samples and are cut before samples become rows."""
    spans = chunks.where(F.size("v") > 0).select(REC, F.col("i0").alias("start"), (F.col("i0") + F.size("v") - 1).alias("stop"), "v")
    met = overlap_join(spans, runs.select(REC, "side", F.col("first").alias("start"), F.col("last").alias("stop")), width, closed=True)
    a, z = F.greatest("start", "b_start"), F.least("stop", "b_stop")
    cut = met.select(REC, F.col("b_side").alias("side"), F.col("b_start").alias("first"), F.col("b_stop").alias("last"), a.alias("_a"), F.slice("v", (a - F.col("start") + 1).cast("int"), F.greatest(z - a + 1, F.lit(0)).cast("int")).alias("_v"))
    return cut.select(REC, "side", "first", "last", "_a", F.posexplode("_v").alias("_p", "v")).select(REC, "side", "first", "last", (F.col("_a") + F.col("_p")).alias("i"), "v")


def _free(t: np.ndarray, v: np.ndarray, events: np.ndarray, before: float, after: float, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Which samples lie more than margin from the events on both sides (with no event at all, all that are known), and the event before each (NaN: none)."""
    whole = np.concatenate([[before], events, [after]])
    whole = whole[~np.isnan(whole)]
    known = ~np.isnan(v)
    if not len(whole):
        return known, np.full(len(t), np.nan)
    place = np.searchsorted(whole, t, side="right")
    last = np.where(place > 0, whole[np.maximum(place - 1, 0)], np.nan)
    following = np.where(place < len(whole), whole[np.minimum(place, len(whole) - 1)], np.nan)
    with np.errstate(invalid="ignore"):
        return known & (t - last > margin) & (following - t > margin), last


def amplitude_events(chunks: DataFrame, events: DataFrame, margin: int, dead_time: int, limit: float = 4.5, polarity: str = "neg") -> DataFrame:
    """(rec_id, t): crossings of +-limit deviations away from the events (rec_id, t) found so far, as detection.amplitude_events finds them in samples.

    Sample i lies at i seconds / sr, in whole microseconds. Free are samples more than margin from
    the events on both sides, between the first and the last event; without events, all. A crossing counts that is the first, or
    more than dead_time of free samples after the crossing before. Chunks know the events within, the one before and the one after;
    the clock of free time is summed within chunks first and carried on along them.
    """
    kind = chunks.schema[REC].dataType.simpleString()
    rate = chunks.groupBy(F.col(REC).alias("_rec")).agg(F.first("sr").alias("_sr"))
    pos = F.floor(F.col("t") * F.col("_sr") / 1e6)
    marks = events.join(rate, F.col(REC) == F.col("_rec")).where("t IS NOT NULL").select(REC, pos.alias("pos"), "t").unionByName(chunks.select(REC, F.col("i0").alias("pos"), F.lit(None).cast("long").alias("t")))
    begun = F.last(F.when(F.col("t").isNull(), F.col("pos")), ignorenulls=True).over(Window.partitionBy(REC).orderBy("pos", F.asc_nulls_first("t")).rowsBetween(Window.unboundedPreceding, 0))
    places = marks.withColumn("_chunk", F.coalesce(begun, F.lit(-1))).groupBy(REC, "_chunk").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    forth, back = Window.partitionBy(REC).orderBy("_chunk"), Window.partitionBy(REC).orderBy(F.desc("_chunk"))
    some = lambda k: F.when(F.size("ts") > 0, F.element_at("ts", k))
    before = F.last(some(-1), ignorenulls=True).over(forth.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(some(1), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    told = places.select(F.col(REC).alias("_rec"), "_chunk", "ts", before.cast("double").alias("before"), after.cast("double").alias("after"))
    met = chunks.withColumn("chunk", F.col("i0")).join(told, (F.col(REC) == F.col("_rec")) & (F.col("chunk") == F.col("_chunk"))).select(REC, "chunk", "i0", "sr", "v", "ts", "before", "after")
    met = kept(met, "placed")  # read for the moments and for the crossings

    def cut(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.asarray(row.v, float)
        t = ((row.i0 + np.arange(len(v))) * 1e6 / row.sr).astype(np.int64)
        free, last = _free(t, v, np.asarray(row.ts, float), np.nan if row.before is None else row.before, np.nan if row.after is None else row.after, margin)
        return t[free], v[free], last[free]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vs = [(row.rec_id, cut(row)[1]) for row in f.rename(columns={REC: "rec_id"}).itertuples(index=False)]
            yield pd.DataFrame([(r, len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum())) for r, v in vs if len(v)], columns=[REC, "n", "m", "q"])

    parts = met.mapInPandas(measure, f"{REC} {kind}, n long, m double, q double")
    means = parts.groupBy(F.col(REC).alias("_rec")).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    off = F.col("m") - F.col("mean")
    stats = parts.join(means, F.col(REC) == F.col("_rec")).groupBy("_rec").agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("q") + F.col("n") * off * off) / F.sum("n")).alias("sd"))

    def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.rename(columns={REC: "rec_id"}).itertuples(index=False):
                t, v, last = cut(row)
                if not len(t):
                    continue
                z = (v - row.mean) / row.sd
                same = (last[1:] == last[:-1]) | (np.isnan(last[1:]) & np.isnan(last[:-1]))
                clock = np.concatenate([[0], np.cumsum(np.where(same, np.diff(t), 0))])
                hit = {"pos": z > limit, "neg": z < -limit, "mix": np.abs(z) > limit}[polarity]
                gap = lambda x: None if np.isnan(x) else int(x)
                out.append((row.rec_id, row.chunk, None, int(clock[-1]), int(t[0]), int(t[-1]), gap(last[0]), gap(last[-1])))
                out += [(row.rec_id, row.chunk, int(a), int(c), None, None, None, None) for a, c in zip(t[hit], clock[hit], strict=True)]
            yield pd.DataFrame(out, columns=[REC, "chunk", "t", "clock", "t0", "t1", "gap0", "gap1"]).astype({c: "Int64" for c in ("t", "clock", "t0", "t1", "gap0", "gap1")})

    scaled = met.join(stats, F.col(REC) == F.col("_rec")).where("sd > 0").drop("_rec")
    rows = scaled.mapInPandas(hits, f"{REC} {kind}, chunk long, t long, clock long, t0 long, t1 long, gap0 long, gap1 long")
    w = Window.partitionBy(REC).orderBy("chunk", F.asc_nulls_first("t"))
    whole = F.col("t").isNull()
    left = F.last(F.when(whole, F.struct("t1", "gap1")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    linked = rows.withColumn("_left", left)
    link = F.when(whole & F.col("_left").isNotNull() & F.col("_left.gap1").eqNullSafe(F.col("gap0")), F.col("t0") - F.col("_left.t1")).otherwise(0)
    spent = linked.withColumn("_link", link).withColumn("_inner", F.when(whole, F.col("clock")).otherwise(0))
    upto = F.sum("_link").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.sum("_inner").over(w.rowsBetween(Window.unboundedPreceding, 0))
    based = spent.withColumn("_base", upto - F.last(F.when(whole, F.col("clock")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    clocked = based.where(~whole).select(REC, "t", (F.col("_base") + F.col("clock")).alias("_clock"))
    step = F.col("_clock") - F.lag("_clock").over(Window.partitionBy(REC).orderBy("t"))
    return clocked.withColumn("_gap", step).where(F.col("_gap").isNull() | (F.col("_gap") > dead_time)).select(REC, "t")
