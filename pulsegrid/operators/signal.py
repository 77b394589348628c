"""Operators on chunked signals: (rec_id, chunk_id, i0, sr, v array<double>), one row for a run of samples, i0 the index of its first.

A chunk is the unit of work, so one long recording is spread over many tasks. What a window needs beyond its chunk (the halo)
comes from the neighbouring chunks by lag and lead, as slices; chunks must be at least as long as the halo.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.intervals import REC
from pulsegrid.sources.scratch import kept


def to_chunks(samples: DataFrame, length: int, sr: float) -> DataFrame:
    """Chunks of `length` samples (the last may be shorter) from samples (rec_id, i, v)."""
    cells = samples.groupBy(REC, F.expr(f"i div {length}").alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_s"))
    return cells.select(REC, "chunk_id", F.get("_s", F.lit(0)).i.alias("i0"), F.lit(float(sr)).alias("sr"), F.transform("_s", lambda s: s.v.cast("double")).alias("v"))


def to_samples(chunks: DataFrame) -> DataFrame:
    """(rec_id, i, v) of chunks."""
    return chunks.select(REC, "i0", F.posexplode("v").alias("_p", "v")).select(REC, (F.col("i0") + F.col("_p")).alias("i"), "v")


def with_halo(chunks: DataFrame, before: int, after: int) -> DataFrame:
    """chunks with `left` and `right`: up to that many samples of the chunks before and after, none across a gap.

    A chunk inside a run that is shorter than the halo is an error.
    """
    w = Window.partitionBy(REC).orderBy("i0")
    none = F.array().cast("array<double>")
    end = F.col("i0") + F.size("v")

    def beside(near: Column, joins: Column, size: int, whole: Column) -> Column:
        """The neighbour's samples if it joins this chunk; it must have enough of them unless it is the recording's last (first) chunk."""
        short = joins & (F.size(near) < size) & ~whole
        return F.when(short, F.raise_error(F.lit("a chunk is shorter than the halo"))).when(joins, near).otherwise(none)

    out = chunks.withColumn("left", none).withColumn("right", none)
    if before:
        near = F.lag(F.slice("v", F.greatest(F.lit(1), F.size("v") - before + 1), F.lit(before))).over(w)
        first = F.coalesce(F.lag(end, 2).over(w) != F.lag("i0").over(w), F.lit(True))
        out = out.withColumn("_near", near).withColumn("_joins", F.coalesce(F.lag(end).over(w) == F.col("i0"), F.lit(False))).withColumn("_whole", first)
        out = out.withColumn("left", beside(F.col("_near"), F.col("_joins"), before, F.col("_whole")))
    if after:
        near = F.lead(F.slice("v", F.lit(1), F.lit(after))).over(w)
        last = F.coalesce(F.lead("i0", 2).over(w) != F.lead(end).over(w), F.lit(True))
        out = out.withColumn("_near", near).withColumn("_joins", F.coalesce(F.lead("i0").over(w) == end, F.lit(False))).withColumn("_whole", last)
        out = out.withColumn("right", beside(F.col("_near"), F.col("_joins"), after, F.col("_whole")))
    return out.drop("_near", "_joins", "_whole")


def map_chunks(chunks: DataFrame, run: Callable[[np.ndarray, int, int], np.ndarray], before: int, after: int) -> DataFrame:
    """chunks with v replaced by run(samples with halo, length of the left halo, length of the right halo)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [run(np.concatenate([np.asarray(x, float) for x in (a, v, b)]), len(a), len(b)).tolist() for a, v, b in zip(f["left"], f["v"], f["right"], strict=True)]
            yield f[[REC, "chunk_id", "i0", "sr"]].assign(v=out)

    kind = chunks.schema[REC].dataType.simpleString()
    return with_halo(chunks, before, after).select(REC, "chunk_id", "i0", "sr", "v", "left", "right").mapInPandas(each, f"{REC} {kind}, chunk_id long, i0 long, sr double, v array<double>")


def spectral_power(x: np.ndarray, width: int) -> np.ndarray:
    """(len(x) - width + 1, width / 2 + 1): squared magnitudes of the transform of each Hann window, by width."""
    if len(x) < width:
        return np.zeros((0, width // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, width) * np.hanning(width)
    return np.abs(np.fft.rfft(frames, axis=1)) ** 2 / width


def _powers(sr: float, v: np.ndarray, right: np.ndarray, width: int, low: float, high: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first window in the chunk, bins strictly between low and high, their power by window), of bounded size whatever the chunk's length."""
    hz = np.fft.rfftfreq(width, 1 / sr)
    bins = np.flatnonzero((hz > low) & (hz < high))
    x = np.concatenate([np.asarray(v, float), np.asarray(right, float)])
    for a in range(0, max(0, len(x) - width + 1), 8192):
        yield a, bins, spectral_power(x[a : a + 8192 + width - 1], width)[:, bins]


def _frame(parts: list[tuple], names: tuple[str, ...]) -> pd.DataFrame:
    """One frame of parts whose first value is a recording and whose others are arrays of one length, or numbers."""
    sizes = [max(np.size(x) for x in p[1:]) for p in parts]
    own = np.repeat(np.array([p[0] for p in parts], object), sizes)
    return pd.DataFrame({names[0]: own} | {n: np.concatenate([np.broadcast_to(p[k], size) for p, size in zip(parts, sizes, strict=True)]) for k, n in enumerate(names[1:], 1)})


def _frames(parts: Iterator[tuple], names: tuple[str, ...], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """Parts in frames of about `rows` rows."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += max(np.size(x) for x in p[1:])
        if n >= rows:
            yield _frame(held, names)
            held, n = [], 0
    if held:
        yield _frame(held, names)


def _with_windows(chunks: DataFrame, width: int) -> DataFrame:
    return with_halo(chunks, 0, width - 1).select(REC, "i0", "sr", "v", "right")


def spectrogram(chunks: DataFrame, width: int = 128, low: float = 4.0, high: float = 40.0) -> DataFrame:
    """(rec_id, i, bin, power): of every window that lies within the recording (i: its first sample), the bins strictly between low and high."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for rec, i0, sr, v, right in zip(f[REC], f["i0"], f["sr"], f["v"], f["right"], strict=True):
                for a, bins, p in _powers(sr, v, right, width, low, high):
                    yield rec, np.repeat(i0 + a + np.arange(len(p)), len(bins)), np.tile(bins, len(p)), p.ravel()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(parts(frames), (REC, "i", "bin", "power"))

    return _with_windows(chunks, width).mapInPandas(each, f"{REC} {chunks.schema[REC].dataType.simpleString()}, i long, bin long, power double")


def _cells(p: np.ndarray) -> np.ndarray:
    """64 cells for each doubling of power."""
    return np.floor(np.log2(np.maximum(p, 1e-300)) * 64).astype(np.int64)


def _coded(p: np.ndarray) -> np.ndarray:
    """The cell of each power (windows, bins), and in the last 16 bits the place of its bin, as bins follow one another."""
    return (_cells(p) << 16) + np.arange(p.shape[1])


def power_percentiles(windows: DataFrame, width: int, low: float, high: float, shares: tuple[float, float]) -> DataFrame:
    """(rec_id, bins array<struct<bin, lo, hi>>): exact percentiles (interpolated) of each bin's power over a recording.

    Powers are counted in cells before the shuffle; only those of the few cells that hold the wanted ranks are then looked at one by one.
    """
    kind = windows.schema[REC].dataType.simpleString()

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for rec, sr, v, right in zip(f[REC], f["sr"], f["v"], f["right"], strict=True):
                for _, bins, p in _powers(sr, v, right, width, low, high):
                    if p.size:
                        code, n = np.unique(_coded(p), return_counts=True)
                        yield rec, bins[code & 0xFFFF], code >> 16, n

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(counted(frames), (REC, "bin", "cell", "n"))

    counts = windows.mapInPandas(count, f"{REC} {kind}, bin long, cell long, n long").groupBy(REC, "bin", "cell").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(REC, "bin")
    upto = counts.withColumn("_upto", F.sum("n").over(own.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("n").over(own))
    at = [F.lit(s) * (F.col("_total") - 1) for s in shares]
    ranks = [r for x in at for r in (F.floor(x), F.least(F.floor(x) + 1, F.col("_total") - 1))]
    below = F.col("_upto") - F.col("n")
    wanted = upto.withColumn("_ranks", F.array(*ranks)).where(F.exists("_ranks", lambda r: (r >= below) & (r < F.col("_upto"))))
    wanted = wanted.select(REC, "bin", "cell", below.alias("below"), "_ranks", F.array(*at).alias("_at"))
    lists = wanted.groupBy(F.col(REC).alias("_rec")).agg(F.collect_list(F.struct("bin", "cell")).alias("wanted"))  # two to four cells a bin

    def picked(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for rec, sr, v, right, held in zip(f[REC], f["sr"], f["v"], f["right"], f["wanted"], strict=True):
                for _, bins, p in _powers(sr, v, right, width, low, high):
                    if p.size:
                        code = _coded(p)
                        hit = np.isin(code, [(w["cell"] << 16) + w["bin"] - int(bins[0]) for w in held])
                        if hit.any():
                            yield rec, bins[code[hit] & 0xFFFF], code[hit] >> 16, p[hit]

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(picked(frames), (REC, "bin", "cell", "power"))

    met = windows.join(lists, F.col(REC).eqNullSafe(F.col("_rec"))).select(REC, "sr", "v", "right", "wanted")
    powers = met.mapInPandas(pick, f"{REC} {kind}, bin long, cell long, power double")
    known = wanted.select(F.col(REC).alias("_rec"), F.col("bin").alias("_bin"), F.col("cell").alias("_cell"), "below", "_ranks", "_at")
    placed = powers.withColumn("_place", F.row_number().over(Window.partitionBy(REC, "bin", "cell").orderBy("power")) - 1)
    placed = placed.join(known, F.col(REC).eqNullSafe(F.col("_rec")) & (F.col("bin") == F.col("_bin")) & (F.col("cell") == F.col("_cell")))
    found = placed.withColumn("_rank", F.col("below") + F.col("_place")).where(F.array_contains("_ranks", F.col("_rank")))

    def between(k: int) -> Column:
        lower, upper = (F.max(F.when(F.col("_rank") == F.get("_ranks", F.lit(2 * k + j)), F.col("power"))) for j in (0, 1))
        part = F.max(F.get("_at", F.lit(k)) - F.get("_ranks", F.lit(2 * k)))
        return lower + (upper - lower) * part

    each = found.groupBy(REC, "bin").agg(between(0).alias("lo"), between(1).alias("hi"))
    return each.groupBy(REC).agg(F.sort_array(F.collect_list(F.struct("bin", "lo", "hi"))).alias("bins"))


def band_power(chunks: DataFrame, width: int = 128, low: float = 4.0, high: float = 40.0, lo: float = 0.05, hi: float = 0.95, scope: str = "recording") -> DataFrame:
    """(rec_id, i, v): mean over the bins of each window's power, scaled by the bin's percentiles and cut off there, then standardised.

    With scope "chunk" percentiles and deviations are those of each chunk's windows instead of the recording's. The spectra of a
    chunk are made again for each of the three passes; none is stored, but chunks with their halo and the means are written once.
    """
    if scope not in ("recording", "chunk"):
        raise ValueError(f"unknown scope: {scope}")
    kind = chunks.schema[REC].dataType.simpleString()
    windows = kept(_with_windows(chunks, width), "windows")
    if scope == "recording":
        limits = power_percentiles(windows, width, low, high, (lo, hi)).withColumnRenamed(REC, "_rec")
        windows = windows.join(limits, F.col(REC).eqNullSafe(F.col("_rec"))).drop("_rec")
    else:
        windows = windows.withColumn("bins", F.lit(None).cast("array<struct<bin:long,lo:double,hi:double>>"))

    def scaled(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for rec, i0, sr, v, right, bins in zip(f[REC], f["i0"], f["sr"], f["v"], f["right"], f["bins"], strict=True):
                blocks = _powers(sr, v, right, width, low, high)
                if bins is None:
                    blocks = list(blocks)
                    if not blocks:
                        continue
                    ends = np.percentile(np.concatenate([p for _, _, p in blocks]), [100 * lo, 100 * hi], axis=0)
                else:
                    ends = np.array([[x["lo"] for x in bins], [x["hi"] for x in bins]])
                span = np.where(ends[1] > ends[0], ends[1] - ends[0], np.inf)
                for a, _, p in blocks:
                    yield rec, i0 + a + np.arange(len(p)), i0, np.clip((p - ends[0]) / span, 0, 1).mean(axis=1)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(scaled(frames), (REC, "i", "_of", "_m"))

    mean = kept(windows.select(REC, "i0", "sr", "v", "right", "bins").mapInPandas(each, f"{REC} {kind}, i long, _of long, _m double"), "means")
    by = [REC] if scope == "recording" else [REC, "_of"]
    stats = mean.groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by))).agg(F.avg("_m").alias("_a"), F.stddev_pop("_m").alias("_s"))
    same = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)))
    return mean.join(stats, same).select(REC, "i", ((F.col("_m") - F.col("_a")) / F.nullif("_s", F.lit(0.0))).alias("v"))


def smoothing_kernel(width: int, order: int) -> np.ndarray:
    """Weights of a local polynomial fit of that order at the middle of `width` points (odd)."""
    half = width // 2
    return np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))[0]


def smooth(chunks: DataFrame, width: int = 21, order: int = 2) -> DataFrame:
    """Local polynomial smoothing; at both ends of a recording the signal is continued by point reflection."""
    kernel, half = smoothing_kernel(width, order), width // 2

    def run(x: np.ndarray, before: int, after: int) -> np.ndarray:
        size = len(x) - before - after
        if before < half:
            x = np.concatenate([2 * x[0] - x[1 : half - before + 1][::-1], x])
        if after < half:
            x = np.concatenate([x, 2 * x[-1] - x[-(half - after) - 1 : -1][::-1]])
        return np.convolve(x, kernel[::-1], "valid")[:size]

    return map_chunks(chunks, run, half, half)


def center(chunks: DataFrame, limit: float = 10.0, factor: float = 1000.0) -> DataFrame:
    """The recording's mean is subtracted; if the minimum's size then exceeds limit, all is divided by factor (to millivolts)."""
    stats = to_samples(chunks).groupBy(REC).agg(F.avg("v").alias("_m"), F.min("v").alias("_lo"))
    unit = F.when(F.abs(F.col("_lo") - F.col("_m")) > limit, factor).otherwise(1.0)
    return chunks.join(stats, REC).withColumn("v", F.transform("v", lambda x: (x - F.col("_m")) / unit)).drop("_m", "_lo")


class Alarm(NamedTuple):
    at: int
    onset: int
    falling: bool


def cusum_alarms(x: np.ndarray, threshold: float, drift: float) -> list[Alarm]:
    """Where x, less drift a step, has fallen or risen by more than threshold from its highest or lowest point since the alarm before.

    The onset is that point (the last of equal ones).
    """
    out: list[Alarm] = []
    tilted = np.asarray(x, float) + drift * np.arange(len(x)), np.asarray(x, float) - drift * np.arange(len(x))
    top = low = 0
    for i in range(len(x)):
        if tilted[0][i] >= tilted[0][top]:
            top = i
        if tilted[1][i] <= tilted[1][low]:
            low = i
        fallen, risen = tilted[0][top] - tilted[0][i] > threshold, tilted[1][i] - tilted[1][low] > threshold
        if fallen or risen:
            out.append(Alarm(i, top if fallen else low, bool(fallen)))
            top = low = i
    return out


#: Rounds in which blocks of a series are worked out apart; series that have not settled by then pass through one task.
ROUNDS = 6


def cusum(x: list[float], state: tuple[float | None, float, float, int, int], threshold: float, drift: float) -> tuple[list[int], list[int], tuple]:
    """(alarms, starts, state) of both sums of changes over x, from the state: value before, sums up and down, and how long each has been above 0.

    A sum that would be negative is 0 again; an alarm sets both to 0. The start of an alarm is the last place at which its sum was 0 (the
    upper one's if both are over the threshold), counted from the beginning of x, so that it may be negative.
    """
    before, up, down, up_at, down_at = state
    up_at, down_at = -up_at, -down_at
    alarms, starts = [], []
    for i, v in enumerate(x):
        if before is None:
            before, up_at, down_at = v, i, i
        s, before = v - before, v
        up, down = up + s - drift, down - s - drift
        if up <= 0:
            up, up_at = 0.0, i
        if down <= 0:
            down, down_at = 0.0, i
        if up > threshold or down > threshold:
            alarms.append(i)
            starts.append(up_at if up > threshold else down_at)
            up, down, up_at, down_at = 0.0, 0.0, i, i
    return alarms, starts, (before, up, down, len(x) - up_at, len(x) - down_at)


def change_points(values: DataFrame, by: list[str], order: str, value: str, threshold: float = 1.5, drift: float = 0.1, backwards: bool = False, starts: bool = False) -> DataFrame:
    """(by, order, with `starts` also start) of the alarms on the standardised values of each group, and where each change began; a group with a missing value has none.

    A series is dealt by ranges of (group, order) and cut into blocks. All blocks are worked out at once, from empty sums at first;
    then again those that the block before leaves another state to, until none does. Sums return to 0 again and again, so this takes
    few rounds; groups that have not settled after ROUNDS pass through one task, block by block. The arithmetic is that of one
    pass over the series. With `backwards` series are read from their end, so `start` is where a change ended.
    """
    kinds = [f"`{c}` {values.schema[c].dataType.simpleString()}" for c in by]
    of_order = values.schema[order].dataType.simpleString()
    x = F.col(value).cast("double")
    stats = values.groupBy(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by))).agg(F.avg(x).alias("_a"), F.stddev_pop(x).alias("_sd"), F.count_if(x.isNull()).alias("_none"))
    same = lambda names: functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)))
    joined = values.join(stats, same([f"_{i}" for i in range(len(by))]))
    scaled = joined.where("_none = 0 AND _sd > 0 AND NOT isnan(_sd)").select(*by, F.col(order).alias("_at"), ((x - F.col("_a")) / F.col("_sd")).alias("_x"))
    along = F.desc_nulls_first("_at") if backwards else F.asc_nulls_last("_at")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            edges = run_edges(batch, len(by))
            sizes = pa.array(edges, pa.int32())
            heads = [batch.column(k).take(pa.array(edges[:-1])) for k in range(len(by))]
            lists = [pa.ListArray.from_arrays(sizes, batch.column(k)) for k in (len(by), len(by) + 1)]
            place = [pa.array([part] * (len(edges) - 1), pa.int32()), pa.array(range(seq, seq + len(edges) - 1), pa.int32())]
            seq += len(edges) - 1
            yield pa.RecordBatch.from_arrays([*heads, *place, *lists], [*by, "part", "seq", "ats", "xs"])

    dealt = scaled.repartitionByRange(*by, along).sortWithinPartitions(*by, along)
    blocks = kept(dealt.mapInArrow(pack, ", ".join([*kinds, "part int, seq int", f"ats array<{of_order}>, xs array<double>"])), "series")
    state = "before double, up double, down double, up_at long, down_at long"
    empty = F.struct(F.lit(None).cast("double").alias("before"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(1).cast("long").alias("up_at"), F.lit(1).cast("long").alias("down_at"))
    made = f"part int, seq int, entry struct<{state}>, leave struct<{state}>, alarms array<int>, starts array<long>"
    fields = pa.struct([("before", pa.float64()), ("up", pa.float64()), ("down", pa.float64()), ("up_at", pa.int64()), ("down_at", pa.int64())])

    def worked(rows: list[tuple]) -> pa.RecordBatch:
        """Of (part, seq, entry, leave, alarms, starts)."""
        part, seq, entry, leave, alarms, starts = zip(*rows, strict=True)
        names = [f.name for f in fields]
        told = [pa.array([dict(zip(names, s, strict=True)) for s in states], fields) for states in (entry, leave)]
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seq, pa.int32()), *told, pa.array(alarms, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64()))], ["part", "seq", "entry", "leave", "alarms", "starts"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, seq, entry, xs in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "entry", "xs")), strict=True):
                entry = tuple(entry.values())
                alarms, starts, leave = cusum(xs, entry, threshold, drift)
                rows.append((part, seq, entry, leave, alarms, starts))
            if rows:
                yield worked(rows)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = None, None
        for batch in batches:
            rows = []
            for *key, part, seq, xs in zip(*(batch.column(c).to_pylist() for c in [*by, "part", "seq", "xs"]), strict=True):
                entry = now if key == own else (None, 0.0, 0.0, 0, 0)
                alarms, starts, now = cusum(xs, entry, threshold, drift)
                own = key
                rows.append((part, seq, entry, now, alarms, starts))
            if rows:
                yield worked(rows)

    w = Window.partitionBy(*by).orderBy("part", "seq")
    places = blocks.select(*by, "part", "seq", F.element_at("xs", -1).alias("_end"))
    first = places.withColumn("entry", F.struct(F.lag("_end").over(w).alias("before"), *(empty[f.name].alias(f.name) for f in list(fields)[1:])))

    def again(entries: DataFrame) -> DataFrame:
        told = entries.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), "entry")
        return blocks.join(told, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))).select("part", "seq", "entry", "xs").mapInArrow(each, made)

    done, found = kept(again(first), "cusum"), None
    for _ in range(ROUNDS):
        along_series = places.drop("_end").join(done, ["part", "seq"]).withColumn("_left", F.lag("leave").over(w))
        found = along_series.where(F.col("_left").isNotNull() & (F.col("_left") != F.col("entry"))).select(*by, "part", "seq", F.col("_left").alias("entry"))
        if not found.limit(1).count():
            break
        rest = done.join(found.select("part", "seq"), ["part", "seq"], "left_anti")
        done = kept(rest.unionByName(again(found)), "cusum")
    else:
        names = found.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by))).distinct()
        slow = blocks.join(names, same([f"_{i}" for i in range(len(by))]), "left_semi").repartition(*by).sortWithinPartitions(*by, "part", "seq")
        redone = kept(slow.select(*by, "part", "seq", "xs").mapInArrow(through, made), "cusum")
        done = done.join(redone.select("part", "seq"), ["part", "seq"], "left_anti").unionByName(redone)
    told = done.where(F.size("alarms") > 0).select("part", "seq", F.explode(F.arrays_zip("alarms", "starts")).alias("_a"))
    met = blocks.select(*by, "part", "seq", "ats").join(told, ["part", "seq"])
    lines = met.select(*by, F.get("ats", F.col("_a.alarms")).alias(order), "part", "seq", F.col("_a.starts").alias("_start"), F.when(F.col("_a.starts") >= 0, F.get("ats", F.col("_a.starts").cast("int"))).alias("start"))
    return _earlier_starts(lines, blocks, by) if starts else lines.select(*by, order)


def run_edges(batch: pa.RecordBatch, columns: int) -> list[int]:
    """Where runs of rows begin that agree in the first columns, and the number of rows."""
    if not batch.num_rows:
        return [0]
    new = np.zeros(batch.num_rows, bool)
    for k in range(columns):
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return [0, *np.flatnonzero(new).tolist(), batch.num_rows]


def _earlier_starts(lines: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """lines (by, order, part, seq, _start, start) with starts that lie in a block before, `_start` places back from the block's first, looked up there."""
    w = Window.partitionBy(*by).orderBy("part", "seq")
    base = blocks.select(*by, "part", "seq", "ats", F.size("ats").cast("long").alias("_n"))
    based = base.withColumn("_base", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    names = [c for c in lines.columns if c not in ("part", "seq", "_start")]
    at = based.select("part", "seq", "_base")
    far = lines.where("_start < 0").join(at, ["part", "seq"]).withColumn("_want", F.col("_base") + F.col("_start"))
    key = [F.col(c).alias(f"_{i}") for i, c in enumerate(by)]
    held = based.select(*key, "ats", F.col("_base").alias("_from"))
    same = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)))
    met = far.join(held, same & (F.col("_want") >= F.col("_from")) & (F.col("_want") < F.col("_from") + F.size("ats")))
    return lines.where("_start >= 0").select(*names).unionByName(met.withColumn("start", F.get("ats", (F.col("_want") - F.col("_from")).cast("int"))).select(*names))


def changes(values: DataFrame, by: list[str], order: str, value: str, threshold: float = 1.5, drift: float = 0.1) -> DataFrame:
    """(by, start, alarm, stop, amp) of the changes in each group's standardised values: where they began, were noticed and ended, and by how much value rose.

    Alarms of one start are one change, noticed at the first of them. A change ends at the first point from its alarm on at which a change of
    the series read backwards began, at the latest where the next change starts, or else at the group's last point. Alarms are few, and
    only they meet by group.
    """
    forth = change_points(values, by, order, value, threshold, drift, starts=True).groupBy(*by, "start").agg(F.min(order).alias("alarm"))
    back = change_points(values, by, order, value, threshold, drift, backwards=True, starts=True).select(*by, F.col("start").alias("end")).distinct()
    ended = F.col("end").isNotNull()
    rows = forth.withColumn("end", F.lit(None).cast(forth.schema["alarm"].dataType)).unionByName(back, allowMissingColumns=True).withColumn("_at", F.coalesce("end", "alarm")).withColumn("_side", ended.cast("int"))
    later = Window.partitionBy(*by).orderBy("_at", "_side")
    after = F.first("end", ignorenulls=True).over(later.rowsBetween(0, Window.unboundedFollowing))
    following = F.first(F.when(~ended, F.col("start")), ignorenulls=True).over(later.rowsBetween(1, Window.unboundedFollowing))
    met = rows.select("*", after.alias("_end"), following.alias("_next")).where("end IS NULL")
    name = lambda c: F.col(c).alias(f"_{by.index(c)}")
    same = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)))
    points = values.select(*map(name, by), F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"))
    last = points.groupBy(*(f"_{i}" for i in range(len(by)))).agg(F.max("_order").alias("_last"))
    whole = met.join(last, same).drop(*(f"_{i}" for i in range(len(by))))
    found = whole.select(*by, "start", "alarm", F.coalesce(F.least("_end", "_next"), "_last").alias("stop"))
    ends = found.join(points.select(*(f"_{i}" for i in range(len(by))), "_order", F.col("_value").alias("_to")), same & (F.col("_order") == F.col("stop"))).select(*by, "start", "alarm", "stop", "_to")
    begins = ends.join(points, same & (F.col("_order") == F.col("start")))
    return begins.select(*by, "start", "alarm", "stop", (F.col("_to") - F.col("_value")).alias("amp"))


def fourier_resample(x: np.ndarray, size: int) -> np.ndarray:
    """x on `size` points of the same span, by cutting off or filling up its spectrum."""
    n = len(x)
    if not n or not size:
        return np.zeros(size)
    spectrum = np.fft.rfft(x)
    keep = min(n, size)
    out = np.zeros(size // 2 + 1, complex)
    out[: keep // 2 + 1] = spectrum[: keep // 2 + 1]
    if keep % 2 == 0 and n != size:  # the highest common frequency stands for both of its signs in the shorter, for one in the longer
        out[keep // 2] *= 2 if size < n else 0.5
    return np.fft.irfft(out, size) * size / n


def resample(chunks: DataFrame, sr: float, halo: int) -> DataFrame:
    """Chunks at the rate sr. Each is resampled with `halo` samples of its neighbours, of which nothing is kept.

    Where chunks begin, and halos, should be whole numbers of new samples, else they are rounded.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, first = [], []
            for i0, old, v, a, b in zip(f["i0"], f["sr"], f["v"], f["left"], f["right"], strict=True):
                ratio = sr / old
                x = np.concatenate([np.asarray(part, float) for part in (a, v, b)])
                y = fourier_resample(x, int(len(x) * ratio))
                skip, start = round(len(a) * ratio), int(i0 * ratio)
                out.append(y[skip : skip + int((i0 + len(v)) * ratio) - start].tolist())
                first.append(start)
            yield f[[REC, "chunk_id"]].assign(i0=np.array(first, "int64"), sr=float(sr), v=out)

    kind = chunks.schema[REC].dataType.simpleString()
    haloed = with_halo(chunks, halo, halo).select(REC, "chunk_id", "i0", "sr", "v", "left", "right")
    return haloed.mapInPandas(each, f"{REC} {kind}, chunk_id long, i0 long, sr double, v array<double>")


def window_plan(lengths: DataFrame, width: int, overlap: float) -> DataFrame:
    """(rec_id, window_id, start, stop) over the n samples of each recording: overlapping windows of the next power of two, the last one at the end.

    overlap is a share of the width. A recording shorter than a window has one window of its own length.
    """
    size = 1 << max(0, int(width) - 1).bit_length()
    step = max(1, size - int(size * overlap))
    last = F.greatest(F.col("n") - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")), F.array(last)))
    dealt = lengths.where("n > 0").select(REC, "n", F.posexplode(starts).alias("window_id", "start"))
    return dealt.select(REC, "window_id", "start", F.least(F.col("start") + size, "n").alias("stop"))
