"""Features, classification and aggregates of bursts."""

from __future__ import annotations

from math import log10

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import SECOND, log_guard, sq_distance
from pulsegrid.operators.events import with_isi
from pulsegrid.operators.intervals import REC, contain_join, overlap_join

#: Nodes of a codebook that are broadcast together.
MOST_NODES = 100_000

#: Feature name to aggregate over a burst's events, isi being in seconds and null at its first event.
FEATURES = {
    "b_n": lambda: F.count("*"),
    "dur": lambda: (F.max("t") - F.min("t")) / SECOND,
    "isi_mean": lambda: F.avg("isi"),
    "isi_std": lambda: F.stddev_pop("isi"),
    "isi_med": lambda: F.median("isi"),
    "isi_cv": lambda: F.stddev_pop("isi") / F.avg("isi"),
    "isi_fano": lambda: F.var_pop("isi") / F.avg("isi"),
}


def burst_features(events: DataFrame, bursts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(rec_id, start, stop, features) of each burst; unknown names are rejected."""
    names = list(FEATURES) if names is None else names
    if unknown := set(names) - set(FEATURES):
        raise ValueError(f"unknown features: {sorted(unknown)}")
    inside = contain_join(events.select(REC, "t"), bursts.select(REC, "start", "stop"))
    inside = with_isi(inside, "start").withColumn("isi", F.col("isi") / SECOND)
    return inside.groupBy(REC, "start", "stop").agg(*(FEATURES[n]().alias(n) for n in names))


def isi_peak(events: DataFrame, lo: float, hi: float, bins: int, *by: str) -> DataFrame:
    """Left edge (seconds) of the fullest of the log-spaced bins of isi (ties: the lowest), of each group `by`."""
    step = (log10(hi) - log10(lo)) / bins
    isi = with_isi(events, *(b for b in by if b != REC)).where("isi IS NOT NULL").withColumn("_s", F.col("isi") / SECOND)
    binned = isi.where((F.col("_s") >= lo) & (F.col("_s") < hi)).withColumn("_bin", F.floor((F.log10("_s") - log10(lo)) / step))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "_bin"))
    top = binned.groupBy(*by, "_bin").count().withColumn("_place", best).where("_place = 1")
    return top.select(*by, F.pow(F.lit(10.0), F.lit(log10(lo)) + F.col("_bin") * step).alias("isi_peak"), F.col("count").alias("n"))


def burst_isi_peak(events: DataFrame, bursts: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """(rec_id, start, stop, isi_peak): isi_peak() of the events of each burst; lo where no interval lies within the bins."""
    own = bursts.select(REC, "start", "stop")
    peaks = isi_peak(contain_join(events.select(REC, "t"), own), lo, hi, bins, REC, "start").select(F.col(REC).alias("_r"), F.col("start").alias("_s"), "isi_peak")
    return own.join(peaks, F.col(REC).eqNullSafe(F.col("_r")) & (F.col("start") == F.col("_s")), "left").select(REC, "start", "stop", F.coalesce("isi_peak", F.lit(float(lo))).alias("isi_peak"))


def waveform_features(samples: DataFrame, bursts: DataFrame, free: DataFrame) -> DataFrame:
    """(rec_id, start, stop, l_len, l_rate, lz_len, lz_rate) of bursts with samples (rec_id, t, v).

    l_len is the sum of the steps between neighbouring samples of a burst, l_rate that by its seconds; lz_ are the same of the signal
    in deviations of its samples in the free periods (null where these don't vary or don't exist).
    """
    inside = contain_join(samples.select(REC, "t", "v"), bursts.select(REC, "start", "stop"))
    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy(REC, "start").orderBy("t")))
    lengths = inside.withColumn("_d", step).groupBy(REC, "start", "stop").agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("l_len"))
    calm = contain_join(samples.select(REC, "t", "v"), free.select(REC, "start", "stop")).groupBy(F.col(REC).alias("_r")).agg(F.nullif(F.stddev_pop("v"), F.lit(0.0)).alias("_sd"))
    seconds = F.nullif((F.col("stop") - F.col("start")) / SECOND, F.lit(0.0))
    both = lengths.join(calm, F.col(REC).eqNullSafe(F.col("_r")), "left")
    return both.select(REC, "start", "stop", "l_len", (F.col("l_len") / seconds).alias("l_rate"), (F.col("l_len") / F.col("_sd")).alias("lz_len"), (F.col("l_len") / F.col("_sd") / seconds).alias("lz_rate"))


def severe_in(states: DataFrame, bursts: DataFrame, severe: tuple[str, ...], width: int) -> DataFrame:
    """(rec_id, start, stop, n_severe) of every state: the bursts of a severe category (cname) that overlap it."""
    hit = overlap_join(states.select(REC, "start", "stop"), bursts.where(F.col("cname").isin(*severe)).select(REC, "start", "stop"), width)
    counts = hit.groupBy(F.col(REC).alias("_r"), F.col("start").alias("_s"), F.col("stop").alias("_e")).agg(F.count("*").alias("_n"))
    same = F.col(REC).eqNullSafe(F.col("_r")) & (F.col("start") == F.col("_s")) & (F.col("stop") == F.col("_e"))
    return states.join(counts, same, "left").select(REC, "start", "stop", F.coalesce("_n", F.lit(0)).alias("n_severe"))


def severe_by_node(bursts: DataFrame, recordings: DataFrame, nodes: list[int], min_gap: int) -> DataFrame:
    """(rec_id, n, starts) of every recording: bursts whose bmu is one of nodes, less those that begin under min_gap after the one before; and when all of them start."""
    found = bursts.where(F.col("bmu").isin(*nodes)).withColumn("_near", F.coalesce((F.col("start") - F.lag("stop").over(Window.partitionBy(REC).orderBy("start")) < min_gap).cast("int"), F.lit(0)))
    counts = found.groupBy(F.col(REC).alias("_r")).agg((F.count("*") - F.sum("_near")).alias("n"), F.sort_array(F.collect_list("start")).alias("starts"))
    return recordings.select(REC).distinct().join(counts, F.col(REC).eqNullSafe(F.col("_r")), "left").select(REC, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("starts", F.array().cast("array<bigint>")).alias("starts"))


def standardise(features: DataFrame, variables: list[dict]) -> Column:
    """The vector of a burst in the order of the codebook: logarithm where flagged, (x - mean) / std of the codebook, times factor."""
    out = []
    for v in sorted(variables, key=lambda v: v["pos"]):
        x = F.col(v["name"]).cast("double")
        x = log_guard(x) if v["is_log"] else x
        out.append((x - v["mean"]) / v["std"] * v["factor"])
    return F.array(*out)


def project(vectors: DataFrame, codebook: DataFrame, vector: str = "v", second: bool = False) -> DataFrame:
    """vectors with bmu, the node of the codebook (node_id, w) nearest to them, and dist (ties: the lower node); with `second` also bmu2.

    The codebook is gathered into rows of an array of at most about MOST_NODES nodes that are joined by broadcast, one after the other, so no
    vector is shuffled or repeated; a map has hundreds of nodes and makes one row.
    """
    book = codebook.where("node_id IS NOT NULL AND w IS NOT NULL").select("node_id", "w")
    n, best = book.count(), F.array().cast("array<struct<d:double,node_id:bigint>>")
    parts = -(-2 * n // MOST_NODES) if n > MOST_NODES else 1
    out = vectors.withColumn("_best", best)
    for k in range(parts):
        some = book if parts == 1 else book.where(F.pmod(F.xxhash64("node_id"), F.lit(parts)) == k)
        nodes = some.agg(F.sort_array(F.collect_list(F.struct("node_id", "w"))).alias("_nodes"))
        far = F.transform("_nodes", lambda n: F.struct(sq_distance(F.col(vector), n.w).alias("d"), n.node_id.cast("long").alias("node_id")))
        both = out.join(F.broadcast(nodes)).withColumn("_r", far)
        if second:
            nearest = F.slice(F.sort_array(F.concat("_best", "_r")), 1, 2)
        else:
            nearest = F.array(F.array_min("_r")) if parts == 1 else F.array(F.array_min(F.concat("_best", "_r")))
        out = both.withColumn("_best", nearest).drop("_nodes", "_r")
    kind = codebook.schema["node_id"].dataType
    out = out.withColumn("bmu", F.get("_best", F.lit(0)).node_id.cast(kind)).withColumn("dist", F.sqrt(F.get("_best", F.lit(0)).d))
    if second:
        out = out.withColumn("bmu2", F.get("_best", F.lit(1)).node_id.cast(kind))
    return out.drop("_best")


def classify(features: DataFrame, codebook: DataFrame, variables: list[dict], least: int = 5) -> DataFrame:
    """features with bmu, rank and si of the codebook (node_id, w, clust, si); all null in bursts of fewer than `least` events."""
    placed = project(features.withColumn("_v", standardise(features, variables)), codebook.select("node_id", "w"), "_v").drop("_v", "dist")
    looked = placed.join(F.broadcast(codebook.select(F.col("node_id").alias("bmu"), F.col("clust").alias("rank"), "si")), "bmu", "left")
    enough = F.col("b_n") >= least
    return looked.select(*features.columns, *(F.when(enough, F.col(c)).alias(c) for c in ("bmu", "rank", "si")))


def burstiness(isi: str = "isi") -> Column:
    """(sd - mean) / (sd + mean), from -1 for regular to 1 for bursty trains."""
    sd, mean = F.stddev_pop(isi), F.avg(isi)
    return (sd - mean) / F.nullif(sd + mean, F.lit(0.0))


def severity_order(bursts: DataFrame, budget: int) -> DataFrame:
    """Bursts by severity (highest first) as long as their total duration is within budget (microseconds) in each recording."""
    w = Window.partitionBy(REC).orderBy(F.desc_nulls_last("si"), "start").rowsBetween(Window.unboundedPreceding, 0)
    return bursts.withColumn("_used", F.sum(F.col("stop") - F.col("start")).over(w)).where(F.col("_used") <= budget).drop("_used")


def spread(order: Column | list, *by: str) -> Column:
    """Place (from 0) of each row in an order that is spread over the whole range of `order` from early on: ranks by their bits read backwards.

    The first 2 ** k rows of a group are about evenly spaced, so any beginning of it represents the group.
    """
    columns = order if isinstance(order, list) else [order]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*columns)) - 1
    bits = F.length(F.bin(F.count(F.lit(1)).over(Window.partitionBy(*by)) - 1))
    return F.reverse(F.lpad(F.bin(rank), bits, "0"))


def representatives(bursts: DataFrame, budget: int, share: float = 12.0) -> DataFrame:
    """bursts (rec_id, start, stop, si) that show the range of severity of each recording within a budget of time (microseconds), with their place.

    Bursts with a severity are taken in spread order until those taken last longer than the budget together; a burst counts with a
    `share`-th of the budget at most, so that a long one does not stand alone.
    """
    ordered = bursts.where("si IS NOT NULL").withColumn("_key", spread([F.col("si"), F.col("start")], REC))
    w = Window.partitionBy(REC).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    long = F.least(F.col("stop") - F.col("start"), F.lit(int(budget / share)))
    return ordered.withColumn("_used", F.sum(long).over(w)).withColumn("place", F.row_number().over(Window.partitionBy(REC).orderBy("_key")) - 1).where(F.col("_used") <= budget).drop("_used", "_key")
