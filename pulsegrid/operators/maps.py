"""Codebooks, their quality, histograms, rates and diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import SECOND
from pulsegrid.operators.bursts import burstiness, project
from pulsegrid.operators.events import with_isi
from pulsegrid.operators.intervals import REC, overlap_join


def region_vectors(regions: DataFrame, names: list[str], norm: str = "zscore") -> DataFrame:
    """regions with v, their features `names` as a vector: standardised over all regions (zscore), of length 1 (L2), or as they are (none).

    A feature that does not vary is 0, a vector of length 0 stays; a missing feature is an error of the caller and gives a null in v.
    """
    raw = F.array(*(F.col(n).cast("double") for n in names))
    if norm == "none":
        return regions.withColumn("v", raw)
    if norm == "L2":
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        return regions.withColumn("v", raw).withColumn("v", F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")))
    if norm != "zscore":
        raise ValueError(f"unknown norm: {norm}")
    stats = regions.agg(*(f(n).alias(f"_{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))))  # a single row
    scaled = F.array(*(F.when(F.col(f"_s{i}") > 0, (F.col(n) - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(F.when(F.col(n).isNotNull(), 0.0)) for i, n in enumerate(names)))
    return regions.join(F.broadcast(stats)).select(*regions.columns, scaled.alias("v"))


def region_categories(regions: DataFrame, labelled: DataFrame, label: str, width: int) -> DataFrame:
    """regions (rec_id, start, stop, ...) with `label` of the labelled interval that covers most of each, and how much (overlap).

    Intervals that only touch a region count with an overlap of 0; of equal ones the earlier, then the smaller label is taken. Regions
    without any have a null label. Pairs meet by buckets of `width`.
    """
    own = regions.select(REC, "start", "stop").distinct()
    met = overlap_join(own, labelled.select(REC, "start", "stop", label), width, closed=True)
    shared = F.least("stop", "b_stop") - F.greatest("start", "b_start")
    best = met.groupBy(F.col(REC).alias("_rec"), F.col("start").alias("_a"), F.col("stop").alias("_z")).agg(F.min(F.struct((-shared).alias("o"), F.col("b_start"), F.col(f"b_{label}").alias("l"))).alias("_b"))
    same = F.col(REC).eqNullSafe(F.col("_rec")) & (F.col("start") == F.col("_a")) & (F.col("stop") == F.col("_z"))
    return regions.join(best, same, "left").select(*regions.columns, F.col("_b.l").alias(label), (-F.col("_b.o")).alias("overlap"))


def mean_vectors(vectors: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """(node_id, w): the mean vector of each label, summed position by position before the shuffle."""
    means = vectors.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s.x)
    return means.groupBy(F.col(label).alias("node_id")).agg(ordered.alias("w"))


def hex_nodes(columns: int, rows: int) -> list[tuple[int, float, float]]:
    """(node_id, x, y) of a hexagonal grid; odd rows are shifted by half a cell to the right."""
    return [(r * columns + c, c + 0.5 * (r % 2), r * 3**0.5 / 2) for r in range(rows) for c in range(columns)]


def hex_edges(spark: SparkSession, columns: int, rows: int) -> DataFrame:
    """(src, dst), both ways, of neighbouring nodes: those at a distance of one cell."""
    nodes = hex_nodes(columns, rows)
    near = [(a, b) for a, ax, ay in nodes for b, bx, by in nodes if a != b and (ax - bx) ** 2 + (ay - by) ** 2 < 1.01]
    return spark.createDataFrame(near, "src int, dst int")


def hits(projected: DataFrame, codebook: DataFrame) -> DataFrame:
    """(node_id, n) of every node, zero included."""
    return codebook.select("node_id").join(projected.groupBy(F.col("bmu").alias("node_id")).agg(F.count("*").alias("n")), "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))


def map_quality(projected: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, mean distance to the nearest node, and the share of vectors whose two nearest nodes are not neighbours."""
    known = F.broadcast(edges.select(F.col("src").alias("bmu"), F.col("dst").alias("bmu2"), F.lit(1).alias("_near")))
    return projected.join(known, ["bmu", "bmu2"], "left").agg(F.count("*").alias("n"), F.avg("dist").alias("quantisation_error"), F.avg(F.when(F.col("_near").isNull(), 1.0).otherwise(0.0)).alias("topological_error"))


def train_map(vectors: DataFrame, codebook: DataFrame, columns: int, rounds: int = 10, radius: float = 2.0) -> DataFrame:
    """Batch training of a map: in each round a node becomes the mean of all vectors, weighted by its distance on the grid to their nearest node.

    The codebook (node_id, w) is small and is taken to the driver between rounds; sums over the vectors are made by Spark.
    """
    spark, nodes = vectors.sparkSession, {r["node_id"]: list(r["w"]) for r in codebook.collect()}
    place = {i: (x, y) for i, x, y in hex_nodes(columns, -(-len(nodes) // columns))}
    for k in range(rounds):
        reach = max(0.4, radius * (1 - k / rounds))
        book = spark.createDataFrame(list(nodes.items()), "node_id int, w array<double>")
        found = project(vectors, book).select("bmu", F.posexplode("v").alias("pos", "x")).groupBy("bmu", "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n")).collect()
        fresh = {}
        for i, w in nodes.items():
            top, weight = [0.0] * len(w), [0.0] * len(w)
            for r in found:
                d = (place[i][0] - place[r["bmu"]][0]) ** 2 + (place[i][1] - place[r["bmu"]][1]) ** 2
                h = 2.718281828459045 ** (-d / (2 * reach**2))
                top[r["pos"]] += h * r["s"]
                weight[r["pos"]] += h * r["n"]
            fresh[i] = [a / b if b else c for a, b, c in zip(top, weight, w, strict=True)]
        nodes = fresh
    return spark.createDataFrame(list(nodes.items()), "node_id int, w array<double>")


def severity(codebook: DataFrame, reference: int) -> DataFrame:
    """(node_id, si): distance from the reference node, scaled such that the reference has 1 and the farthest node 0."""
    from pulsegrid.functions import sq_distance

    ref = codebook.where(F.col("node_id") == reference).select(F.col("w").alias("_ref"))
    d = codebook.join(F.broadcast(ref)).select("node_id", F.sqrt(sq_distance(F.col("w"), F.col("_ref"))).alias("d"))
    top = d.agg(F.max("d").alias("top"))
    return d.join(F.broadcast(top)).select("node_id", (1 - F.col("d") / F.nullif("top", F.lit(0.0))).alias("si"))


def cluster_nodes(codebook: DataFrame, clusters: int, reference: int, method: str = "ward") -> DataFrame:
    """(node_id, clust): nodes joined step by step into `clusters` groups, numbered from 0 by the distance of their means from the reference node.

    A map has at most some hundreds of nodes, so this runs on the driver. method is ward (least growth of the squared distances from
    the mean) or complete (least largest distance).
    """
    if method not in ("ward", "complete"):
        raise ValueError(f"unknown method: {method}")
    rows = sorted((r["node_id"], r["w"]) for r in codebook.select("node_id", "w").collect())
    w = np.array([v for _, v in rows], float)
    groups = [[k] for k in range(len(rows))]
    apart = ((w[:, None] - w[None]) ** 2).sum(-1) / (2 if method == "ward" else 1)  # cost of joining each two groups
    np.fill_diagonal(apart, np.inf)
    while len(groups) > clusters:
        at = int(np.argmin(np.where(np.tri(len(groups), k=-1, dtype=bool), apart, np.inf)))
        x, y = divmod(at, len(groups))  # y < x
        n, m = len(groups[x]), len(groups[y])
        if method == "ward":
            size = np.array(list(map(len, groups)))
            cost = ((n + size) * apart[x] + (m + size) * apart[y] - size * apart[x, y]) / (n + m + size)
        else:
            cost = np.maximum(apart[x], apart[y])
        apart[y] = apart[:, y] = cost
        apart[y, y] = np.inf
        apart = np.delete(np.delete(apart, x, 0), x, 1)
        groups[y] += groups.pop(x)
    ref = w[[i for i, _ in rows].index(reference)]
    groups.sort(key=lambda g: ((w[g].mean(0) - ref) ** 2).sum())
    made = [(rows[k][0], c) for c, g in enumerate(groups) for k in g]
    return codebook.sparkSession.createDataFrame(made, "node_id int, clust int")


def reference_node(codebook: DataFrame, largest: list[int], smallest: list[int] | None = None) -> int:
    """The node with the largest sum of the components `largest` less those of `smallest` (ties: the lower node)."""
    score = sum((F.get("w", F.lit(k)) for k in largest), F.lit(0.0)) - sum((F.get("w", F.lit(k)) for k in smallest or []), F.lit(0.0))
    return codebook.orderBy(score.desc(), "node_id").first()["node_id"]


def neighbour_distances(codebook: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, d): mean distance of each node to its neighbours on the grid."""
    from pulsegrid.functions import sq_distance

    a = codebook.select(F.col("node_id").alias("src"), F.col("w").alias("_a"))
    b = codebook.select(F.col("node_id").alias("dst"), F.col("w").alias("_b"))
    met = edges.join(F.broadcast(a), "src").join(F.broadcast(b), "dst")  # a map's nodes: fixed in number
    return met.groupBy(F.col("src").alias("node_id")).agg(F.avg(F.sqrt(sq_distance(F.col("_a"), F.col("_b")))).alias("d"))


def initial_map(vectors: DataFrame, columns: int, rows: int, vector: str = "v") -> DataFrame:
    """(node_id, w): a grid over the plane of the two largest principal components, two deviations to each side of the mean.

    Sums and products of components are made by Spark; only their table, of the vectors' width squared, comes to the driver.
    """
    flat = vectors.select(F.posexplode(vector).alias("i", "x"), F.col(vector).alias("_v"))
    cells = flat.select("i", "x", F.posexplode("_v").alias("j", "y")).groupBy("i", "j").agg(F.avg("x").alias("m"), F.covar_pop("x", "y").alias("c")).collect()
    size = 1 + max(r["i"] for r in cells)
    mean, cov = np.zeros(size), np.zeros((size, size))
    for r in cells:
        mean[r["i"]], cov[r["i"], r["j"]] = r["m"], r["c"]
    value, axis = np.linalg.eigh(cov)
    axis = axis * np.where(np.take_along_axis(axis, np.abs(axis).argmax(0)[None], 0) < 0, -1, 1)  # sign: largest entry positive
    span = 2 * np.sqrt(np.maximum(value[-2:], 0)) * axis[:, -2:]
    place = [(-1 + 2 * (k % columns) / max(1, columns - 1), -1 + 2 * (k // columns) / max(1, rows - 1)) for k in range(columns * rows)]
    made = [(k, (mean + x * span[:, 1] + y * span[:, 0]).tolist()) for k, (x, y) in enumerate(place)]
    return vectors.sparkSession.createDataFrame(made, "node_id int, w array<double>")


def percentiles(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """(by, p array<double>): exact percentiles of a number, interpolated, of each group; nulls are left out.

    Values are counted in cells, 64 for each doubling of their size, before the shuffle; infinities have cells of their own. Of the cells
    that hold a wanted rank equal values are counted, and only different ones are then sorted, so neither a group nor a value that is
    very frequent meets in one task. Between two infinities of one sign, or at one, nothing is interpolated.
    """
    x = F.col(value).cast("double")
    size = F.when(F.abs(x) == float("inf"), F.lit(1 << 30)).otherwise(F.floor(F.log2(F.abs(x)) * 64) + (1 << 20))
    cell = F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("long")
    known = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("_x"), cell.alias("_cell"))
    counts = known.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*by)
    upto = counts.withColumn("_upto", F.sum("_n").over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_n").over(own))
    at = [F.lit(float(s)) * (F.col("_total") - 1) for s in shares]
    ranks = F.array(*(r for a in at for r in (F.floor(a), F.least(F.floor(a) + 1, F.col("_total") - 1))))
    below = F.col("_upto") - F.col("_n")
    wanted = upto.withColumn("_ranks", ranks).where(F.exists("_ranks", lambda r: (r >= below) & (r < F.col("_upto"))))
    names = [f"_by{k}" for k in range(len(by))]
    wanted = wanted.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col("_cell").alias("_in"), below.alias("_below"), "_ranks", F.array(*at).alias("_at"))
    same = F.col("_cell") == F.col("_in")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    alike = known.join(wanted, same).groupBy(*by, "_cell", "_x").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in ("_below", "_ranks", "_at")))
    last = F.col("_below") + F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy("_x"))
    found = alike.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n"))

    def between(k: int) -> Column:
        holds = lambda j: (F.get("_ranks", F.lit(2 * k + j)) >= F.col("_first")) & (F.get("_ranks", F.lit(2 * k + j)) < F.col("_last"))
        lower, upper = (F.max(F.when(holds(j), F.col("_x"))) for j in (0, 1))
        part = F.max(F.get("_at", F.lit(k)) - F.get("_ranks", F.lit(2 * k)))
        return F.when((lower == upper) | (part == 0), lower).otherwise(lower + (upper - lower) * part)

    return found.groupBy(*by).agg(F.array(*(between(k) for k in range(len(shares)))).alias("p"))


def percentile_norm(df: DataFrame, value: str, by: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """df with `normed`: value scaled such that each group's lo and hi percentiles are 0 and 1, cut off there; null where they are equal.

    With lo 0 and hi 1 the least and the largest value are.
    """
    names = {c: f"_g{k}" for k, c in enumerate(by)}
    p = percentiles(df, value, by, [lo, hi]).withColumnsRenamed(names | {"p": "_p"})
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    low, high = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    scaled = (F.col(value) - low) / F.nullif(high - low, F.lit(0.0))
    return df.join(p, same, "left").withColumn("normed", F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))).drop("_p", *names.values())


def amplitude_histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, n, share) over int(sqrt(n) / 3) bins of equal width from the least to the largest value."""
    stats = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("c")).withColumn("k", F.greatest(F.lit(1), F.floor(F.sqrt("c") / 3)))
    width = F.nullif((F.col("hi") - F.col("lo")) / F.col("k"), F.lit(0.0))
    cell = F.coalesce(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.col("k") - 1), F.lit(0)).cast("long")
    return df.where(F.col(value).isNotNull()).join(F.broadcast(stats)).groupBy(cell.alias("bin"), "c").agg(F.count("*").alias("n")).select("bin", "n", (F.col("n") / F.col("c")).alias("share"))


def rates(events: DataFrame, durations: DataFrame, by: str) -> DataFrame:
    """(rec_id, by, n, rate per second of the duration)."""
    return events.groupBy(REC, by).agg(F.count("*").alias("n")).join(durations, REC).select(REC, by, "n", (F.col("n") / F.nullif(F.col("dur") / SECOND, F.lit(0.0))).alias("rate"))


def time_fractions(intervals: DataFrame, durations: DataFrame, by: str) -> DataFrame:
    """(rec_id, by, n, tfrac): intervals of each category and their share of the duration."""
    sums = intervals.groupBy(REC, by).agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("_d"))
    return sums.join(durations, REC).select(REC, by, "n", (F.col("_d") / F.nullif("dur", F.lit(0))).alias("tfrac"))


def diagnostics(events: DataFrame, bursts: DataFrame, durations: DataFrame) -> DataFrame:
    """One row a recording: counts, event rate, time in bursts and burstiness."""
    e = with_isi(events).withColumn("isi", F.col("isi") / SECOND).groupBy(REC).agg(F.count("*").alias("n_events"), burstiness().alias("burstiness"))
    b = bursts.groupBy(REC).agg(F.count("*").alias("n_bursts"), F.sum(F.col("stop") - F.col("start")).alias("_d"))
    seconds = F.nullif(F.col("dur") / SECOND, F.lit(0.0))
    both = e.join(durations, REC).join(b, REC, "left")
    return both.select(REC, "n_events", F.coalesce("n_bursts", F.lit(0)).alias("n_bursts"), (F.col("n_events") / seconds).alias("rate"), (F.coalesce("_d", F.lit(0)) / F.nullif("dur", F.lit(0))).alias("tfrac_bursts"), "burstiness")


def full_diagnostics(events: DataFrame, pieces: DataFrame, bursts: DataFrame, free: DataFrame, masks: DataFrame, durations: DataFrame) -> DataFrame:
    """One row a recording of durations (rec_id, dur): rates, shares of time, burstiness and durations.

    Events are per second, high-load bursts per minute; intervals between events count within pieces (rec_id, start, stop) that no
    mask interrupts; bursts have a cname. Durations are in minutes.
    """
    from pulsegrid.operators.intervals import contain_join

    isi = with_isi(contain_join(events.select(REC, "t"), pieces), "start").groupBy(REC).agg(burstiness().alias("burstiness"))
    e = events.groupBy(REC).agg(F.count("*").alias("_n"))
    length = F.col("stop") - F.col("start")
    high = F.col("cname") == "high-load"
    b = bursts.groupBy(REC).agg(F.sum(length).alias("_bursts"), F.count_if(high).alias("_high"), F.sum(F.when(high, length)).alias("_t_high"))
    f, m = (df.groupBy(REC).agg(F.sum(length).alias(c)) for df, c in ((free, "_free"), (masks, "_masks")))
    all_ = durations.join(e, REC, "left").join(isi, REC, "left").join(b, REC, "left").join(f, REC, "left").join(m, REC, "left")
    dur = F.nullif("dur", F.lit(0))
    part = lambda c: F.coalesce(c, F.lit(0)) / dur
    return all_.select(
        REC, (part("_n") * SECOND).alias("rate_events"), (part("_high") * 60 * SECOND).alias("rate_high_load"), part("_t_high").alias("tfrac_high_load"), part("_bursts").alias("tfrac_bursts"), part("_free").alias("tfrac_free"),
        "burstiness", (F.col("dur") / (60 * SECOND)).alias("minutes"), (F.coalesce("_masks", F.lit(0)) / (60 * SECOND)).alias("minutes_masked"),
    )


def category_rates(events: DataFrame, bursts: DataFrame, durations: DataFrame) -> DataFrame:
    """(rec_id, cname, n, rate per second) of the bursts of each category, and of all events as category `discharges`."""
    own = bursts.select(REC, "cname").unionByName(events.select(REC, F.lit("discharges").alias("cname")))
    return rates(own, durations, "cname")


def proximity(states: DataFrame, events: DataFrame, keep: str = "state") -> DataFrame:
    """preUp and postUp states with near / far counts of events in the half next to the severe period and in the other, and proxdist, their ratio.

    The severe period follows preUp and precedes postUp. An event in the very middle is in no half. Infinite without a far event;
    states without any event have no row.
    """
    from pulsegrid.operators.intervals import contain_join

    held = contain_join(events, states.where(F.col(keep).isin("preUp", "postUp")), [keep]).withColumn("_twice", 2 * F.col("t") - F.col("start") - F.col("stop"))
    side = F.when(F.col(keep) == "preUp", F.col("_twice")).otherwise(-F.col("_twice"))
    counts = held.groupBy(REC, "start", "stop", keep).agg(F.count_if(side > 0).alias("near"), F.count_if(side < 0).alias("far"))
    return counts.withColumn("proxdist", F.when(F.col("far") == 0, F.lit(float("inf"))).otherwise(F.col("near") / F.col("far")))


def top_clusters(counts: DataFrame, by: str, k: int, order: str) -> DataFrame:
    """The k rows of each recording with the largest `order` (ties: by `by`)."""
    return counts.withColumn("_place", F.row_number().over(Window.partitionBy(REC).orderBy(F.desc(order), by))).where(F.col("_place") <= k).drop("_place")
