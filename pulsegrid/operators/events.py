"""Event algebra on tables (rec_id, t, ...), t in whole microseconds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.intervals import REC, _order, contain_join, merge_gaps, overlap_join

#: Length of the time buckets in which islands are first found, as multiples of the gap.
BUCKET = 10_000
#: Length of the spans in which neighbouring samples are found, in units of their order (600 s of whole microseconds).
SPAN = 600_000_000
#: Rows of a block in which running frames are worked out.
ROWS = 262_144


def gap_islands(events: DataFrame, max_gap: int, min_n: int = 2) -> DataFrame:
    """(rec_id, start, stop, n) of runs of events less than max_gap apart, of at least min_n events.

    Islands are first found within time buckets, which spreads even one huge recording, then islands of neighbouring buckets
    are joined where the gap between them is small; only islands, not events, meet by recording.
    """
    width = max_gap * BUCKET
    known = events.select(REC, "t", F.expr(f"t div {width}").alias("_bucket")).where(f"{REC} IS NOT NULL AND t IS NOT NULL")
    local = Window.partitionBy(REC, "_bucket").orderBy("t")
    new = F.coalesce((F.col("t") - F.lag("t").over(local) >= max_gap).cast("int"), F.lit(1))
    marked = known.withColumn("_new", new).withColumn("_island", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.groupBy(REC, "_bucket", "_island").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n"))
    joined = F.coalesce((F.col("start") - F.lag("stop").over(_order("start")) >= max_gap).cast("int"), F.lit(1))
    whole = parts.withColumn("_new", joined).withColumn("_island", F.sum("_new").over(_order("start").rowsBetween(Window.unboundedPreceding, 0)))
    return whole.groupBy(REC, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n")).where(F.col("n") >= min_n).drop("_island")


def bursts(events: DataFrame, max_gap: int, merge_limit: int) -> DataFrame:
    """(rec_id, start, stop, b_n): islands of two events or more, merged where less than merge_limit apart, and all events they hold."""
    merged = merge_gaps(gap_islands(events, max_gap), merge_limit)
    return contain_join(events.select(REC, "t"), merged).groupBy(REC, "start", "stop").agg(F.count("*").alias("b_n"))


def with_isi(events: DataFrame, *by: str) -> DataFrame:
    """events with isi, the time since the event before (in the same piece `by`, if given)."""
    return events.withColumn("isi", F.col("t") - F.lag("t").over(Window.partitionBy(REC, *by).orderBy("t")))


def with_sides(samples: DataFrame, order: str = "t", value: str = "v", span: int = SPAN) -> DataFrame:
    """samples with _p and _n, the value before and after in the recording (null: none), and _i, their number from 1; ties go by value.

    Neighbours are found within spans of `order`, which spreads even one huge recording. A span's first and last value and its count make
    a short row, and only these meet by recording: they tell what the first and last sample of each span have beside them.
    """
    place = F.floor(F.col(order) / span).cast("long")
    dealt = samples.withColumn("_span", place)
    both = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    ends = dealt.groupBy(F.col(REC).alias("_rec"), F.col("_span").alias("_own")).agg(F.min(both).alias("_lo"), F.max(both).alias("_hi"), F.count("*").alias("_rows"))
    by_span = Window.partitionBy("_rec").orderBy("_own")
    sides = ends.select("_rec", "_own", "_rows", F.lag("_hi.v").over(by_span).alias("_before"), F.lead("_lo.v").over(by_span).alias("_after"), F.coalesce(F.sum("_rows").over(by_span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    w = Window.partitionBy(REC, "_span").orderBy(order, value)
    numbered = dealt.withColumn("_k", F.row_number().over(w)).withColumn("_lag", F.lag(value).over(w)).withColumn("_lead", F.lead(value).over(w))
    met = numbered.join(sides, F.col(REC).eqNullSafe(F.col("_rec")) & F.col("_span").eqNullSafe(F.col("_own")))
    before, after = F.when(F.col("_k") == 1, F.col("_before")).otherwise(F.col("_lag")), F.when(F.col("_k") == F.col("_rows"), F.col("_after")).otherwise(F.col("_lead"))
    return met.select(*samples.columns, before.alias("_p"), after.alias("_n"), (F.col("_earlier") + F.col("_k")).alias("_i"))


def singlets(events: DataFrame, margin: int, span: int = SPAN) -> DataFrame:
    """Events at least `margin` from both neighbours that exist; recordings of one event have none. See with_sides for `span`."""
    marked = with_sides(events, "t", "t", span)
    before, after = F.col("t") - F.col("_p"), F.col("_n") - F.col("t")
    return marked.where((before.isNotNull() | after.isNotNull()) & F.coalesce(before >= margin, F.lit(True)) & F.coalesce(after >= margin, F.lit(True))).select(*events.columns)


def neighbour_counts(events: DataFrame, before: int, after: int, around: int) -> DataFrame:
    """events with n_before in [t - before, t), n_after in (t, t + after], n_around others in [t - around, t + around]."""
    w = _order("t")

    def count(a: int, b: int) -> Column:
        return F.count("*").over(w.rangeBetween(a, b))

    return events.select("*", count(-before, -1).alias("n_before"), count(1, after).alias("n_after"), (count(-around, around) - 1).alias("n_around"))


def sparse_events(events: DataFrame, before: int, after: int, around: int, limits: tuple[int, int, int] = (3, 4, 4), quiet: int | None = None) -> DataFrame:
    """Events with few neighbours, or with none in the `quiet` time before."""
    counted = neighbour_counts(events, before, after, around)
    few = (F.col("n_before") <= limits[0]) & (F.col("n_after") <= limits[1]) & (F.col("n_around") <= limits[2])
    if quiet is not None:
        counted = counted.withColumn("_quiet", F.count("*").over(_order("t").rangeBetween(-quiet, -1)))
        few = few | (F.col("_quiet") == 0)
    return counted.where(few).select(*events.columns)


def _edges(group: np.ndarray) -> list[int]:
    """Where runs of equal values begin, and the length."""
    return [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)] if len(group) else []


class Thinning:
    """What one time bucket does to the last time kept before it, found while its sorted events pass.

    Whatever that time is, the first event kept is one of those within a dead time of the bucket's start, or the next (`firsts`).
    From each of these a chain of kept events goes on; chains that meet are one from there on, so few are left after a while.
    """

    def __init__(self, start: int, step: int):
        self.step, self.limit, self.closed = step, start + step, False
        self.firsts: list[int] = []
        self.chain: list[int] = []  # of each of the firsts
        self.last: list[int] = []  # of each chain

    def add(self, part: np.ndarray) -> None:
        following = np.searchsorted(part, part + self.step).tolist()  # of each event the first that could be kept after it
        n, met, joined = len(part), [-1] * len(part), list(range(len(self.last)))

        def follow(i: int, chain: int) -> None:
            at = -1
            while i < n and met[i] < 0:
                met[i], at, i = chain, i, following[i]
            if i < n:
                joined[chain] = met[i]
            elif at >= 0:
                self.last[chain] = int(part[at])

        for chain in set(self.chain):
            follow(int(np.searchsorted(part, self.last[chain] + self.step)), chain)
        if not self.closed:
            until = int(np.searchsorted(part, self.limit))
            self.closed = until < n
            for i in range(min(n, until + 1)):
                joined.append(len(self.last))
                self.firsts.append(int(part[i]))
                self.chain.append(len(self.last))
                self.last.append(int(part[i]))
                follow(i, len(self.last) - 1)
        for k, chain in enumerate(self.chain):
            while joined[chain] != chain:
                chain = joined[chain]
            self.chain[k] = chain
        kept = [k for k in range(len(self.chain)) if k + 1 == len(self.chain) or self.chain[k] != self.chain[k + 1]]
        names = {c: i for i, c in enumerate(dict.fromkeys(self.chain[k] for k in kept))}
        self.firsts, self.last = [self.firsts[k] for k in kept], [self.last[c] for c in names]
        self.chain = [names[self.chain[k]] for k in kept]

    def exits(self) -> list[int]:
        return [self.last[c] for c in self.chain]


def leaving(last: int | None, firsts: list[int], exits: list[int], step: int) -> int | None:
    """The last time kept after a bucket, from that before it."""
    if last is None:
        return exits[0]
    k = bisect_left(firsts, last + step)
    return exits[k] if k < len(firsts) else last


def refractory(events: DataFrame, dead_time: int, strict: bool = False, width: int | None = None) -> DataFrame:
    """(rec_id, t): the first event is kept, then each that is at least dead_time (strict: more) after the last kept.

    Time is cut into buckets of `width` (10,000 dead times). Each bucket's effect on the last time kept is found apart (Thinning), these
    are composed along the recording, a short row for each bucket, and then every bucket is thinned from the time it is entered
    with. So a recording is spread over many tasks, which hold a batch of events each.
    """
    kind, step = events.schema[REC].dataType.simpleString(), dead_time + 1 if strict else max(1, dead_time)
    width = width or step * BUCKET

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, head, out = None, None, None, []

        def flush() -> pa.RecordBatch:
            heads, moves = [h for h, _ in out], [m for _, m in out]
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(0) for h in heads]), pa.concat_arrays([h.column(1) for h in heads]), pa.array([m.firsts for m in moves], longs), pa.array([m.exits() for m in moves], longs)], [REC, "_bucket", "firsts", "exits"])

        for batch in batches:
            t, group = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            edges = _edges(group)
            for a, b in zip(edges, edges[1:], strict=False):
                if group[a] != own:
                    if now is not None:
                        out.append((head, now))
                    own, head = group[a], batch.slice(a, 1)
                    now = Thinning(head.column(1)[0].as_py() * width, step)
                now.add(t[a:b])
            if len(out) >= 1000:
                yield flush()
                out = []
        if now is not None:
            out.append((head, now))
        if out:
            yield flush()

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = last = None
        for batch in batches:
            entered = []
            for group, firsts, exits in zip(*(batch.column(c).to_pylist() for c in ("_group", "firsts", "exits")), strict=True):
                if group != own:
                    own, last = group, None
                entered.append(last)
                last = leaving(last, firsts, exits, step)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entered, pa.int64())], [REC, "_bucket", "_last"])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = last = None
        for batch in batches:
            t, group, entry = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
            keep = np.zeros(len(t), bool)
            edges = _edges(group)
            for a, b in zip(edges, edges[1:], strict=False):
                if group[a] != own:
                    own, last = group[a], entry[a].as_py()
                part = t[a:b]
                following = np.searchsorted(part, part + step).tolist()
                i = int(np.searchsorted(part, last + step)) if last is not None else 0
                while i < len(part):
                    keep[a + i], last = True, int(part[i])
                    i = following[i]
            yield batch.select([0, 2]).filter(pa.array(keep))

    known = events.select(REC, F.col("t").cast("long").alias("t")).where("t IS NOT NULL").withColumn("_bucket", F.expr(f"(t - pmod(t, {width}L)) div {width}L"))
    named = known.select(REC, "_bucket", "t", F.xxhash64(F.lit(1), REC, "_bucket").alias("_group"))
    dealt = named.repartition(REC, "_bucket")  # one shuffle for both passes
    moves = dealt.sortWithinPartitions(REC, "_bucket", "t").mapInArrow(transitions, f"{REC} {kind}, _bucket long, firsts array<long>, exits array<long>")
    ordered = moves.withColumn("_group", F.xxhash64(F.lit(1), REC)).repartition(REC).sortWithinPartitions(REC, "_bucket")
    entries = ordered.mapInArrow(compose, f"{REC} {kind}, _bucket long, _last long").select(F.xxhash64(F.lit(1), REC, "_bucket").alias("_own"), F.col(REC).alias("_rec"), F.col("_bucket").alias("_in"), "_last")
    met = dealt.join(entries, (F.col("_group") == F.col("_own")) & F.col(REC).eqNullSafe(F.col("_rec")) & (F.col("_bucket") == F.col("_in")))
    return met.select(REC, "_bucket", "t", "_group", "_last").repartition("_group").sortWithinPartitions("_group", REC, "_bucket", "t").mapInArrow(thin, f"{REC} {kind}, t long")


def threshold_runs(samples: DataFrame, threshold: float | Column, value: str = "v", i: str = "i") -> DataFrame:
    """(rec_id, first, last): runs of neighbouring samples (by index i) at or above threshold, both ends included."""
    above = samples.where(F.col(value) >= threshold)
    run = F.col(i) - F.row_number().over(_order(i))
    return above.withColumn("_run", run).groupBy(REC, "_run").agg(F.min(i).alias("first"), F.max(i).alias("last")).drop("_run")


def local_extrema(samples: DataFrame, kind: str = "max", order: str = "t", value: str = "v", threshold: float | None = None, at: str = "next", span: int = SPAN) -> DataFrame:
    """Samples strictly above (below) both neighbours; with a threshold the next (or with at="peak" the same) sample must exceed it.

    See with_sides for `span`, which is in units of `order`.
    """
    sign = 1 if kind == "max" else -1
    x, before, after = (F.col(c) * sign for c in (value, "_p", "_n"))
    found = with_sides(samples, order, value, span).where((before < x) & (x > after))
    if threshold is not None:
        found = found.where((after if at == "next" else x) > sign * threshold)
    return found.select(*samples.columns)


def running_rms(samples: DataFrame, width: int, order: str = "t", value: str = "v", span: int = SPAN, rows: int = ROWS) -> DataFrame:
    """samples with rms: root of the sum of squares in the frame of `width` rows around each, divided by width at the edges too.

    Samples are numbered (with_sides) and dealt in blocks of `rows`; a block also gets the samples beside it that its frames reach.
    """
    back, ahead, size = width // 2, (width - 1) // 2, max(rows, width)
    numbered = with_sides(samples, order, value, span).drop("_p", "_n")
    own = F.expr(f"_i div {size}")
    reach = F.explode(F.sequence(F.expr(f"greatest(_i - {ahead}, 0) div {size}"), F.expr(f"(_i + {back}) div {size}")))
    frame = Window.partitionBy(REC, "_block").orderBy("_i").rowsBetween(-back, ahead)
    dealt = numbered.withColumn("_block", reach)
    return dealt.withColumn("rms", F.sqrt(F.sum(F.col(value) * F.col(value)).over(frame) / width)).where(F.col("_block") == own).select(*samples.columns, "rms")


def line_length(samples: DataFrame, order: str = "t", value: str = "v", span: int = SPAN) -> DataFrame:
    """(rec_id, ll): sum of the absolute differences of neighbouring samples, which are found by spans (with_sides)."""
    step = F.abs(F.col(value) - F.col("_p"))
    return with_sides(samples.select(REC, order, value), order, value, span).withColumn("_d", step).groupBy(REC).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("ll"))


def zscore(df: DataFrame, value: str, *by: str, name: str = "z") -> DataFrame:
    """Standardised with the population deviation of each group; null where that is 0. Moments are summed before the shuffle and joined."""
    stats = df.groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by))).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    met = df.join(stats, same, "left") if by else df.join(F.broadcast(stats))  # without groups a single row
    return met.withColumn(name, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd", *(f"_by{k}" for k in range(len(by))))


def nearest(a: DataFrame, b: DataFrame, t: str = "t") -> DataFrame:
    """a with b_t, the time of b nearest in the same recording (ties: the earlier; null: none), and dt = b_t - t. Both are sorted together, up and down."""
    left = a.select(REC, F.col(t).alias("_t"), F.struct(*a.columns).alias("_e"))
    right = b.select(REC, F.col(t).alias("_t"), F.lit(None).cast(left.schema["_e"].dataType).alias("_e"))
    own = F.when(F.col("_e").isNull(), F.col("_t"))
    before = F.last(own, ignorenulls=True).over(_order("_t").rangeBetween(Window.unboundedPreceding, 0))
    after = F.last(own, ignorenulls=True).over(_order(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0))  # running frames both, from either end
    both = left.unionByName(right).withColumn("_p", before).withColumn("_n", after).where("_e IS NOT NULL")
    best = F.when(F.col("_n").isNull() | (F.col("_t") - F.col("_p") <= F.col("_n") - F.col("_t")), F.col("_p")).otherwise(F.col("_n"))
    return both.select("_e.*", best.alias("b_t"), (best - F.col("_t")).alias("dt"))


def tolerance_match(found: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """(rec_id, tp, fp, fn): found events strictly within tolerance of a true one or not, and true ones without a found one."""
    hit = F.coalesce((F.abs("dt") < tolerance).cast("long"), F.lit(0))
    own = nearest(found.select(REC, "t"), truth.select(REC, "t")).groupBy(REC).agg(F.sum(hit).alias("tp"), F.sum(1 - hit).alias("fp"))
    other = nearest(truth.select(REC, "t"), found.select(REC, "t")).groupBy(REC).agg(F.sum(1 - hit).alias("fn"))
    zero = F.lit(0).cast("long")
    return own.join(other, REC, "full").select(REC, *(F.coalesce(c, zero).alias(c) for c in ("tp", "fp", "fn")))


def scored_match(clean: DataFrame, dirty: DataFrame, truth: DataFrame, windows: DataFrame, tolerance: int) -> DataFrame:
    """(rec_id, tp, fp, tn, fn) within the disjoint windows (rec_id, start, stop) that someone has looked through, of every recording that has one.

    Of the events kept (clean) and those rejected (dirty), each in a window counts: as tp or fn if a true event of the same window lies
    strictly within tolerance, else as fp or tn. Windows include both ends.
    """
    looked = truth.select(REC, "t")
    seen = contain_join(looked, windows).select(F.struct(REC, "start").alias(REC), "t")

    def judged(events: DataFrame, hit: str, miss: str) -> DataFrame:
        own = contain_join(events.select(REC, "t"), windows).select(F.struct(REC, "start").alias(REC), "t")
        near = F.coalesce((F.abs("dt") < tolerance).cast("long"), F.lit(0))
        return nearest(own, seen).groupBy(F.col(f"{REC}.{REC}").alias(REC)).agg(F.sum(near).alias(hit), F.sum(1 - near).alias(miss))

    every = windows.select(REC).distinct()
    both = every.join(judged(clean, "tp", "fp"), REC, "left").join(judged(dirty, "fn", "tn"), REC, "left")
    return both.select(REC, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "tn", "fn")))


def next_after(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with next_t, the first time of b strictly after t."""
    left = a.select(REC, F.col("t").alias("_t"), F.struct(*a.columns).alias("_e"))
    right = b.select(REC, F.col("t").alias("_t"), F.lit(None).cast(left.schema["_e"].dataType).alias("_e"))
    own = F.when(F.col("_e").isNull(), F.col("_t"))
    after = F.last(own, ignorenulls=True).over(_order(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -1))
    return left.unionByName(right).withColumn("_n", after).where("_e IS NOT NULL").select("_e.*", F.col("_n").alias("next_t"))


def merge_equal_runs(events: DataFrame, label: str, order: str = "t") -> DataFrame:
    """(rec_id, label, start, stop, n) of runs of neighbours with an equal label."""
    w = _order(order)
    new = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    marked = events.withColumn("_new", first).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(REC, "_run", label).agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("n")).drop("_run")


def doublets(events: DataFrame, max_distance: int) -> DataFrame:
    """(rec_id, t, is_doublet): in runs of events less than max_distance apart all but the one nearest the run's mean (ties: the earlier) are doublets."""
    new = F.coalesce((F.col("t") - F.lag("t").over(_order("t")) >= max_distance).cast("int"), F.lit(1))
    runs = events.select(REC, "t").withColumn("_new", new).withColumn("_run", F.sum("_new").over(_order("t").rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(REC, "_run")
    place = F.row_number().over(w.orderBy(F.abs(F.col("t") - F.col("_mean")), "t"))
    return runs.withColumn("_mean", F.avg("t").over(w)).withColumn("is_doublet", place > 1).select(REC, "t", "is_doublet")


def double_detections(events: DataFrame, samples: DataFrame, max_distance: int, before: int, after: int, width: int = 60_000_000) -> DataFrame:
    """(rec_id, first, second, true_t, false_t) of neighbouring events under max_distance apart, by samples (rec_id, t, v).

    Of the two the one nearer to the least sample from first - before to second + after (the later end left out; of equal samples the
    earliest) is the true one, the first of the two if both are as near.
    """
    pairs = events.select(REC, F.col("t").alias("first"), F.lead("t").over(_order("t")).alias("second")).where(F.col("second") - F.col("first") < max_distance)
    around = pairs.select(REC, "first", "second", (F.col("first") - before).alias("start"), (F.col("second") + after - 1).alias("stop"))
    points = samples.where("v IS NOT NULL").select(REC, F.col("t").alias("start"), F.col("t").alias("stop"), "v")
    met = overlap_join(around, points, width, closed=True).groupBy(REC, "first", "second").agg(F.min(F.struct("b_v", "b_start")).b_start.alias("_low"))
    nearer = F.abs(F.col("_low") - F.col("second")) < F.abs(F.col("_low") - F.col("first"))
    return met.select(REC, "first", "second", F.when(nearer, F.col("second")).otherwise(F.col("first")).alias("true_t"), F.when(nearer, F.col("first")).otherwise(F.col("second")).alias("false_t"))


def flank_events(events: DataFrame, samples: DataFrame, smoothed: DataFrame, limit: float = 4.5, ceiling: float = 7.0, before: int = 100_000, after: int = 200_000, step: int = 2_000, width: int = 60_000_000) -> DataFrame:
    """(rec_id, t) of events on the flank of a large deflection of samples (rec_id, t, v; standardised, every `step`) that belong to no minimum.

    A deflection is a run of samples at or below -limit, taken with `before` and `after` around it, unless a sample reaches `ceiling`
    within twice these. Each of its events is given to the nearest minimum of the smoothed signal there (ties: the earlier); of the
    events of one minimum the nearest is true (ties: the earlier). The others ride a flank, but for those within a tenth of before
    and after of the deflection's ends.
    """
    low = samples.where(F.col("v") <= -limit).select(REC, "t")
    run = low.withColumn("_run", F.col("t") / step - F.row_number().over(_order("t"))).groupBy(REC, "_run").agg(F.min("t").alias("a"), F.max("t").alias("z")).drop("_run")
    wide = run.select(REC, "a", "z", (F.col("a") - 2 * before).alias("start"), (F.col("z") + 2 * after - step).alias("stop"))
    points = samples.where(F.col("v") >= ceiling).select(REC, F.col("t").alias("start"), F.col("t").alias("stop"))
    loud = overlap_join(wide, points, width, closed=True).select(F.col(REC).alias("_r"), F.col("a").alias("_a")).distinct()
    snips = run.join(loud, F.col(REC).eqNullSafe(F.col("_r")) & (F.col("a") == F.col("_a")), "left_anti").select(REC, (F.col("a") - before).alias("start"), (F.col("z") + after).alias("stop"))

    def inside(df: DataFrame) -> DataFrame:
        return overlap_join(snips, df.select(REC, F.col("t").alias("start"), F.col("t").alias("stop")), width, closed=True).select(REC, "start", "stop", F.col("b_start").alias("t"))

    minima = local_extrema(smoothed, "min").select(REC, "t")
    own, lows = inside(events), inside(minima).where("t > start AND t < stop")
    keyed = lambda df: df.select(F.struct(REC, "start", "stop").alias(REC), "t")
    placed = nearest(keyed(own), keyed(lows)).where("b_t IS NOT NULL").select(f"{REC}.*", "t", "b_t")
    place = F.row_number().over(Window.partitionBy(REC, "start", "stop", "b_t").orderBy(F.abs(F.col("t") - F.col("b_t")), "t"))
    riders = placed.withColumn("_place", place).where((F.col("_place") > 1) & (F.col("stop") - F.col("t") > after / 10) & (F.col("t") - F.col("start") > before / 10))
    return riders.select(REC, "t").distinct()


def box_counts(times: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """times (rec_id, t) with n, how many events lie less than width away."""
    both = times.select(REC, "t", F.lit(0).alias("_e")).unionByName(events.select(REC, "t", F.lit(1).alias("_e")))
    return both.withColumn("n", F.sum("_e").over(_order("t").rangeBetween(1 - width, width - 1))).where("_e = 0").select(REC, "t", "n")


def threshold_counts(peaks: DataFrame, thresholds: list[float], height: str = "v") -> DataFrame:
    """(rec_id, threshold, n): how many peaks exceed each threshold, zero included. Peaks are counted by the steps between thresholds, not paired with them."""
    steps = F.array(*map(F.lit, sorted(thresholds)))
    under = peaks.select(REC, F.size(F.filter(steps, lambda s: s < F.col(height))).alias("k")).groupBy(REC, "k").count()
    cells = under.groupBy(REC).agg(F.map_from_entries(F.collect_list(F.struct("k", "count"))).alias("m"))
    each = cells.select(REC, "m", F.posexplode(steps).alias("i", "threshold"))
    more = F.aggregate(F.map_keys(F.map_filter("m", lambda k, v: k > F.col("i"))), F.lit(0).cast("long"), lambda s, k: s + F.element_at("m", k))
    return each.select(REC, "threshold", more.alias("n"))
