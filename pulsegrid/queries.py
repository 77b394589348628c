"""Queries over the driver's tables, and the same in SQL.

`events` is the event train (user_id: recording, ts: time, value: sample), `embeddings` the vectors to classify. Gaps between
events are hours here, so the usual seconds are scaled by 7,200.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import SECOND, category, micros, rank_name
from pulsegrid.operators import bursts as B
from pulsegrid.operators import events as E
from pulsegrid.operators import intervals as I
from pulsegrid.operators import maps as M
from pulsegrid.operators import mixtures as X
from pulsegrid.operators import pieces as P
from pulsegrid.operators import runs as R
from pulsegrid.operators import signal as G
from pulsegrid.plans import detection as D
from pulsegrid.plans import sorting as W
from pulsegrid.plans import states as S
from pulsegrid.plans.protocol import Protocol, Stage
from pulsegrid.sources import documents, scratch, stages
from pulsegrid.streaming import stateful as T

HOUR = 3600 * SECOND
GAP, MERGE, DEAD = 18_000 * SECOND, 25_200 * SECOND, 12_000 * SECOND
MARGIN, FREE, FREE_MARGIN = 6 * HOUR, 48 * HOUR, 2 * HOUR
OFFSET = 24 * HOUR
BEFORE, AFTER, AROUND, QUIET = 13_000 * SECOND, 18_000 * SECOND, 14_400 * SECOND, 7_200 * SECOND
WIDTH = 7 * 24 * HOUR
THRESHOLDS = [float(x) for x in range(0, 100, 10)]


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("rec_id"), micros(F.col("ts")).alias("t"), F.col("value").alias("v"), F.col("event_type").alias("kind"))


def masks(ev: DataFrame) -> DataFrame:
    return I.expand(ev.where("kind = 'error'").select("rec_id", "t"), MARGIN, MARGIN)


def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bursts(train(spark, sf_dir), GAP, MERGE)


def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gap_islands(train(spark, sf_dir), GAP)


def burst_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    made = B.burst_features(ev, E.bursts(ev, GAP, MERGE))
    fine = {"isi_mean": 1e3, "isi_std": 1e3, "isi_med": 1e3, "isi_cv": 1e6, "isi_fano": 1e3}  # cut, not rounded: half cells are common here
    return made.select("rec_id", "start", "stop", "b_n", "dur", *((F.floor(F.col(c) * n) / n).alias(c) for c, n in fine.items()))


def burst_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.bursts(train(spark, sf_dir), GAP, MERGE)
    rank = F.when(F.col("b_n") >= 8, 0).when(F.col("b_n") >= 7, 1).when(F.col("b_n") >= 6, 2).when(F.col("b_n") >= 5, 3)
    named = made.withColumn("rank", rank).withColumn("rank_name", rank_name(F.col("rank")))
    return named.select("rec_id", "start", "b_n", "rank", "rank_name", category(F.col("rank_name")).alias("cname"))


def singlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.singlets(train(spark, sf_dir), GAP).select("rec_id", "t")


def free_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return I.free_periods(ev, I.bounds_of(ev), masks(ev), FREE, FREE_MARGIN)


def sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.neighbour_counts(train(spark, sf_dir), BEFORE, AFTER, AROUND).select("rec_id", "t", "n_before", "n_after", "n_around")


def sparse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sparse_events(train(spark, sf_dir), BEFORE, AFTER, AROUND, (1, 1, 1), QUIET).select("rec_id", "t")


def refractory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.refractory(train(spark, sf_dir), DEAD)


def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.interval_union(masks(train(spark, sf_dir)))


def mask_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    points = ev.where("kind = 'error'").select("rec_id", "t")
    return I.fuse_masks(E.bursts(ev, GAP, MERGE), points, HOUR, 2 * HOUR, 12 * HOUR)


def mask_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return I.interval_complement(masks(ev), I.bounds_of(ev))


def analyzed_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return I.analyzed_duration(I.bounds_of(ev), masks(ev), OFFSET)


def events_in_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    held = I.contain_join(ev, E.bursts(ev, GAP, MERGE), ["b_n"])
    return held.groupBy("kind").agg(F.count("*").alias("n"), F.sum("b_n").alias("sum_n"))


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return I.overlap_join(E.bursts(ev, GAP, MERGE).drop("b_n"), I.interval_union(masks(ev)), WIDTH)


def touch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return I.overlap_join(E.bursts(ev, GAP, MERGE).drop("b_n"), I.interval_complement(E.bursts(ev, GAP, MERGE), I.bounds_of(ev)), WIDTH, closed=True)


def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return I.interval_subtract(E.bursts(ev, GAP, MERGE), masks(ev), WIDTH)


def insert_predators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return I.insert_predators(E.merge_equal_runs(ev, "kind").where("stop > start").withColumnRenamed("kind", "state"), masks(ev), "art", 10 * HOUR)


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return I.clean_events(ev, masks(ev)).select("rec_id", "t", "kind")


def runs_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    indexed = ev.withColumn("i", F.row_number().over(Window.partitionBy("rec_id").orderBy("t")) - 1)
    return E.threshold_runs(indexed, F.lit(20.0)).select("rec_id", F.col("first").cast("long"), F.col("last").cast("long"))


def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.local_extrema(train(spark, sf_dir), threshold=20.0).select("rec_id", "t", "v")


def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.local_extrema(train(spark, sf_dir), "min").select("rec_id", "t", "v")


def running_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.running_rms(train(spark, sf_dir), 8).select("rec_id", "t", F.round("rms", 6).alias("rms"))


def line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.line_length(train(spark, sf_dir)).select("rec_id", F.round("ll", 6).alias("ll"))


def zscore_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.zscore(train(spark, sf_dir), "v", "rec_id").select("rec_id", "t", F.round("z", 6).alias("z"))


def percentile_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.percentile_norm(train(spark, sf_dir), "v", ["kind"]).select("rec_id", "t", F.round("normed", 6).alias("normed"))


def amp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.amplitude_histogram(train(spark, sf_dir), "v").select("bin", "n", F.round("share", 9).alias("share"))


def isi_hist_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.isi_peak(train(spark, sf_dir), 600.0, 1_080_000.0, 200, "rec_id").select("rec_id", F.round("isi_peak", 4).alias("isi_peak"), "n")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    return v.select("vec_id", "v"), M.mean_vectors(v, "label", "v")


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir)[1].select("node_id", F.posexplode("w").alias("pos", "w")).select("node_id", F.col("pos").cast("long").alias("pos"), F.round("w", 6).alias("w"))


def bmu_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.project(*_vectors(spark, sf_dir)).select("vec_id", "bmu", F.round("dist", 6).alias("dist"))


def bmu_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, nodes = _vectors(spark, sf_dir)
    return M.hits(B.project(vectors, nodes), nodes)


def map_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, nodes = _vectors(spark, sf_dir)
    return M.map_quality(B.project(vectors, nodes, second=True), M.hex_edges(spark, 5, 2)).select("n", F.round("quantisation_error", 6).alias("quantisation_error"), F.round("topological_error", 6).alias("topological_error"))


def category_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    dur = I.analyzed_duration(I.bounds_of(ev), masks(ev))
    return M.rates(I.clean_events(ev, masks(ev)), dur, "kind").select("rec_id", "kind", "n", F.round("rate", 9).alias("rate"))


def category_tfracs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    named = E.bursts(ev, GAP, MERGE).withColumn("cname", F.when(F.col("b_n") >= 5, "high-load").otherwise("low-load"))
    return M.time_fractions(named, I.analyzed_duration(I.bounds_of(ev), masks(ev)), "cname").select("rec_id", "cname", "n", F.round("tfrac", 9).alias("tfrac"))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    made = M.diagnostics(ev, E.bursts(ev, GAP, MERGE), I.analyzed_duration(I.bounds_of(ev), masks(ev)))
    return made.select("rec_id", "n_events", "n_bursts", *(F.round(c, 9).alias(c) for c in ("rate", "tfrac_bursts", "burstiness")))


def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merge_equal_runs(train(spark, sf_dir), "kind")


def state_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    held = I.interval_union(masks(ev))
    bounds = I.bounds_of(ev)
    return I.coverage(I.clip(held, bounds).unionByName(I.interval_complement(held, bounds)), bounds)


def tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return E.tolerance_match(ev.where("kind = 'click'"), ev.where("kind = 'error'"), 8 * HOUR)


def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return E.nearest(ev.where("kind = 'click'").select("rec_id", "t"), ev.where("kind = 'error'").select("rec_id", "t"))


def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return E.next_after(ev.where("kind = 'click'").select("rec_id", "t"), ev.where("kind = 'error'").select("rec_id", "t"))


def doublets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.doublets(train(spark, sf_dir), DEAD).groupBy("rec_id").agg(F.sum(F.col("is_doublet").cast("long")).alias("n_doublets"))


def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threshold_counts(E.local_extrema(train(spark, sf_dir)), THRESHOLDS)


def burst_isi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inter-event times within mask-free pieces only."""
    ev = train(spark, sf_dir)
    pieces = I.contain_join(ev, I.interval_complement(masks(ev), I.bounds_of(ev)))
    isi = E.with_isi(pieces, "start").where("isi IS NOT NULL")
    return isi.groupBy("rec_id").agg(F.count("*").alias("n"), F.sum("isi").alias("sum_isi"))


SCALE = 7_200
STATES = S.StateParams(
    **{k: v * SCALE for k, v in vars(S.StateParams()).items() if k.endswith(("gap", "quiet", "duration", "buffer", "iip", "bucket"))}
)


def _ranked(ev: DataFrame) -> DataFrame:
    """Bursts, severe from five events and medium with four."""
    return E.bursts(ev, GAP, MERGE).withColumn("rank", F.when(F.col("b_n") >= 5, 1).when(F.col("b_n") == 4, 2))


def severe_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return S.severe_periods(_ranked(ev), I.bounds_of(ev), STATES).select("rec_id", "start", "stop", "state")


def state_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return S.segment(ev, _ranked(ev), I.bounds_of(ev), masks(ev), STATES)


def chosen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.choose_threshold(threshold_counts(spark, sf_dir))


def refractory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.refractory_counts(E.local_extrema(train(spark, sf_dir)), DEAD, THRESHOLDS)


def amplitude_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events among the samples that are far from errors."""
    ev = train(spark, sf_dir)
    return D.amplitude_events(ev, ev.where("kind = 'error'").select("rec_id", "t"), MARGIN, DEAD, 1.5, "pos")


def _indexed(ev: DataFrame) -> DataFrame:
    return ev.select("rec_id", (F.row_number().over(Window.partitionBy("rec_id").orderBy("t")) - 1).cast("long").alias("i"), "v")


def loud_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.loud_stretches(_indexed(train(spark, sf_dir)), 1.0, 4.0, 1.2, 0.3, 0.5, 2.0, 0.0)


def saturation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.saturation_points(_indexed(train(spark, sf_dir)), 1.0, 1.0, 3.0, 5.0, 5.0, 0.5)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.to_chunks(_indexed(train(spark, sf_dir)), 32, 1.0)


def spectrogram_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.spectrogram(_chunks(spark, sf_dir), 16, 0.1, 0.4).select("rec_id", "i", "bin", F.round("power", 6).alias("power"))


def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.band_power(_chunks(spark, sf_dir), 16, 0.1, 0.4).select("rec_id", "i", F.round("v", 6).alias("v"))


def fourier_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.to_samples(G.resample(_chunks(spark, sf_dir), 0.5, 16)).select("rec_id", "i", F.round("v", 6).alias("v"))


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.to_samples(G.smooth(_chunks(spark, sf_dir), 5, 2)).select("rec_id", "i", F.round("v", 6).alias("v"))


def centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.to_samples(G.center(_chunks(spark, sf_dir))).select("rec_id", "i", F.round("v", 9).alias("v"))


def cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.change_points(_indexed(train(spark, sf_dir)), ["rec_id"], "i", "v", 4.0, 0.5)


def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = train(spark, sf_dir).groupBy("rec_id").agg(F.count("*").alias("n"))
    return G.window_plan(lengths, 12, 0.25).select("rec_id", F.col("window_id").cast("long").alias("window_id"), "start", "stop")


def node_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _vectors(spark, sf_dir)[1]
    return M.neighbour_distances(nodes, M.hex_edges(spark, 5, 2)).select("node_id", F.round("d", 6).alias("d"))


def node_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.severity(_vectors(spark, sf_dir)[1], 0).select("node_id", F.round("si", 6).alias("si"))


def node_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_nodes(_vectors(spark, sf_dir)[1], 4, 0)


def trained_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)[0]
    made = M.train_map(vectors, M.initial_map(vectors, 4, 3), 4, rounds=2)
    return made.select("node_id", F.transform("w", lambda x: F.round(x, 6)).alias("w"))


def gmm_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors, taken as waveforms, fall to each cluster."""
    vectors = _vectors(spark, sf_dir)[0]
    model, order = W.fit_clusters(vectors, 3, 4)
    return W.label(vectors, model, order).groupBy("label").agg(F.count("*").alias("n"))


def _named(ev: DataFrame) -> DataFrame:
    return E.bursts(ev, GAP, MERGE).withColumn("cname", F.when(F.col("b_n") >= 5, "high-load").otherwise("low-load"))


def waveform_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    made = B.waveform_features(ev, E.bursts(ev, GAP, MERGE), I.free_periods(ev, I.bounds_of(ev), masks(ev), 12 * HOUR, 0))
    return made.select("rec_id", "start", "stop", *(F.round(c, 6).alias(c) for c in ("l_len", "l_rate", "lz_len", "lz_rate")))


def burst_isi_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return B.burst_isi_peak(ev, E.bursts(ev, GAP, MERGE), 600.0, 18_000.0, 20).select("rec_id", "start", "stop", F.round("isi_peak", 4).alias("isi_peak"))


def _runs(ev: DataFrame) -> DataFrame:
    return E.merge_equal_runs(ev, "kind").where("stop > start").withColumnRenamed("kind", "state")


def severe_in_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return B.severe_in(_runs(ev), _named(ev), ("high-load",), WIDTH)


def severe_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a burst stands for its node."""
    ev = train(spark, sf_dir)
    made = B.severe_by_node(E.bursts(ev, GAP, MERGE).withColumnRenamed("b_n", "bmu"), ev, [3, 4], 60 * HOUR)
    return made.select("rec_id", "n", F.size("starts").cast("long").alias("n_all"))


def masked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return I.mask_samples(ev.select("rec_id", "t", "v"), masks(ev))


def burst_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_neighbours(E.bursts(train(spark, sf_dir), GAP, MERGE).drop("b_n"))


def double_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return E.double_detections(ev.where("kind = 'click'").select("rec_id", "t"), ev, 20 * HOUR, 5 * HOUR, 20 * HOUR, WIDTH)


def box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return E.box_counts(ev.where("kind = 'click'"), ev.where("kind = 'error'"), 30 * HOUR)


def full_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    bounds, held = I.bounds_of(ev), I.interval_union(masks(ev))
    made = M.full_diagnostics(ev, I.interval_complement(held, bounds), _named(ev), I.free_periods(ev, bounds, masks(ev), FREE, FREE_MARGIN), held, I.analyzed_duration(bounds, masks(ev)))
    return made.select("rec_id", *(F.round(c, 9).alias(c) for c in made.columns if c != "rec_id"))


def category_rates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    made = M.category_rates(ev, _named(ev), I.analyzed_duration(I.bounds_of(ev), masks(ev)))
    return made.select("rec_id", "cname", "n", F.round("rate", 9).alias("rate"))


def state_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one kind, widened, stand for states."""
    ev = train(spark, sf_dir)
    wide = _runs(ev).withColumn("state", F.when(F.col("state") == "error", "postUp").when(F.col("state") == "click", "preUp").otherwise("IIP"))
    found = M.proximity(I.interval_union(wide.where("state = 'preUp'")).withColumn("state", F.lit("preUp")), ev.select("rec_id", "t"))
    return found.select("rec_id", "start", "stop", "near", "far", F.round("proxdist", 6).alias("proxdist"))


def flank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by place, so that they are evenly spaced; each counts as an event, and the signal itself stands for the smoothed one."""
    z = E.zscore(_indexed(train(spark, sf_dir)), "v", "rec_id").select("rec_id", F.col("i").alias("t"), (-F.col("z")).alias("v")).where("v IS NOT NULL")
    return E.flank_events(z.select("rec_id", "t"), z, z, 1.0, 2.5, 6, 8, 1, 1000)


def suggested_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = {"window": 4.0, "high": 1.2, "low": 0.3, "high_time": 0.5, "low_time": 2.0, "crossing": 0.0}
    saturated = {"stump_time": 1.0, "tooth_time": 3.0, "stump_width": 5.0, "tooth_bend": 5.0, "limit": 0.5}
    return D.suggested_masks(_indexed(train(spark, sf_dir)), 1.0, 2 * SECOND, SECOND, 3 * SECOND, loud, saturated)


def chunked_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.loud_stretches(_chunks(spark, sf_dir), 1.0, 4.0, 1.2, 0.3, 0.5, 2.0, 0.0)


def chunked_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chunked_saturation_points(_chunks(spark, sf_dir), 1.0, 1.0, 3.0, 5.0, 5.0, 0.5)


def chunked_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = {"window": 4.0, "high": 1.2, "low": 0.3, "high_time": 0.5, "low_time": 2.0, "crossing": 0.0}
    saturated = {"stump_time": 1.0, "tooth_time": 3.0, "stump_width": 5.0, "tooth_bend": 5.0, "limit": 0.5}
    return D.chunked_masks(_chunks(spark, sf_dir), 1.0, 2 * SECOND, SECOND, 3 * SECOND, loud, saturated)


def chunked_amplitude_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples stand for evenly spaced ones, a second apart; events are those of kind error."""
    ev = train(spark, sf_dir)
    placed = ev.withColumn("i", (F.row_number().over(Window.partitionBy("rec_id").orderBy("t")) - 1).cast("long")).where("kind = 'error'")
    return R.amplitude_events(_chunks(spark, sf_dir), placed.select("rec_id", (F.col("i") * SECOND).alias("t")), SECOND, 3 * SECOND, 1.0, "pos")


def signal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.at_or_above(_chunks(spark, sf_dir), 20.0)


def change_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.changes(_indexed(train(spark, sf_dir)), ["rec_id"], "i", "v", 2.0, 0.3)
    return found.select("rec_id", "start", "alarm", "stop", F.round("amp", 6).alias("amp"))


STATE_OF = {"view": "IIP", "click": "IIP", "purchase": "preUp", "signup": "postUp", "error": "art"}
KIND_STATES = S.StateParams(first_buffer=60 * HOUR, last_buffer=80 * HOUR, quiet=30 * HOUR, least_iip=20 * HOUR, medium=(2,), medium_share=0.3, bucket=WIDTH)


def _contiguous(ev: DataFrame) -> DataFrame:
    """Runs of events of one kind stand for states, each until the next begins, the last until the last event."""
    order = Window.partitionBy("rec_id").orderBy("start")
    runs = E.merge_equal_runs(ev, "kind").select("rec_id", "start", "stop", F.coalesce(*(F.when(F.col("kind") == k, s) for k, s in STATE_OF.items())).alias("state"))
    return runs.withColumn("stop", F.coalesce(F.lead("start").over(order), "stop")).where("stop > start").select("rec_id", "start", "stop", "state")


def state_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_states(S.with_integrity(_contiguous(train(spark, sf_dir))))


def state_voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nibble(_contiguous(train(spark, sf_dir)), KIND_STATES).select("rec_id", "start", "stop", "state")


def state_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return S.validate_increases(S.with_integrity(_contiguous(ev)), ev, KIND_STATES)


def state_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    made = E.bursts(ev, GAP, MERGE).withColumn("rank", F.when(F.col("b_n") >= 3, 2))
    return S.join_dense(S.merge_states(S.with_integrity(_contiguous(ev))), made, KIND_STATES)


def gmm_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label stand for a recording's waveforms: the best of a grid of mixtures for each, and how many vectors fall to its clusters."""
    snips = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("rec_id"), F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    fits = X.fit(snips, [(2, 2), (3, 3), (3, 5)])
    chosen = X.best(fits)
    told = X.by_height(X.clusters(snips, fits, chosen)).groupBy("rec_id", "label").agg(F.count("*").alias("n"))
    return told.join(chosen.select("rec_id", "components", F.col("clusters").alias("k")), "rec_id").select("rec_id", "components", "k", "label", "n")


def scored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks found and views rejected, against purchases, within bursts."""
    ev = train(spark, sf_dir)
    of = lambda k: ev.where(F.col("kind") == k).select("rec_id", "t")
    return E.scored_match(of("click"), of("view"), of("purchase"), E.bursts(ev, GAP, MERGE), 4 * HOUR)


def region_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts as regions: features of length 1, and the kind of the run of equal events that covers most."""
    ev = train(spark, sf_dir)
    regions = E.bursts(ev, GAP, MERGE).withColumn("hours", (F.col("stop") - F.col("start")) / HOUR)
    vectors = M.region_vectors(regions, ["b_n", "hours"], "L2").select("rec_id", "start", "stop", F.transform("v", lambda x: F.round(x, 9)).alias("v"))
    return M.region_categories(vectors, _runs(ev), "state", WIDTH).select("rec_id", "start", "stop", F.get("v", F.lit(0)).alias("v0"), F.get("v", F.lit(1)).alias("v1"), "state", "overlap")


def representative_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of all kinds of length, the number of events being their severity, for at most forty hours a recording."""
    made = E.bursts(train(spark, sf_dir), GAP, MERGE).withColumn("si", F.col("b_n").cast("double"))
    return B.representatives(made, 40 * HOUR).select("rec_id", "start", "stop", "place")


def _longest(batches):
    """Rows and the longest interval of a piece."""
    import pyarrow as pa

    n, last, longest = 0, None, 0
    for b in batches:
        for t in b.column("t").to_pylist():
            longest = max(longest, t - last) if last is not None else 0
            n, last = n + 1, t
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "longest": pa.array([longest], pa.int64())})


def piece_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = train(spark, sf_dir)
    return P.over_pieces(ev.select("rec_id", "t"), masks(ev), I.bounds_of(ev), _longest, "n long, longest long")


CUT = (1_704_600_000_000_000, 1_705_300_000_000_000)


def stage_cutout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages are written, and a time is cut from them: how many events, masks and bursts of each recording lie there."""
    ev, folder = train(spark, sf_dir), scratch.path(spark, "stages")
    for stage, table in (("events", ev.select("rec_id", "t")), ("masks", I.interval_union(masks(ev))), ("bursts", E.bursts(ev, GAP, MERGE))):
        stages.write_stage(table, folder, stage, span=24 * HOUR)
    parts = [t.select("rec_id", F.lit(stage).alias("stage")) for stage, t in stages.cutouts(spark, folder, *CUT).items()]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("rec_id", "stage").agg(F.count("*").alias("n"))


def _protocol(folder: str) -> Protocol:
    return Protocol(
        [
            Stage("thin", lambda t, p: E.refractory(t["events"].select(F.col("user_id").alias("rec_id"), micros(F.col("ts")).alias("t")), p["dead_time"]), ("events",), {"dead_time": DEAD}),
            Stage("bursts", lambda t, p: E.bursts(t["thin"], p["max_gap"], p["merge_limit"]), ("thin",), {"max_gap": GAP, "merge_limit": MERGE}),
        ],
        folder,
    )


def protocol_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages over all recordings, run as a protocol and read from its folder."""
    protocol = _protocol(scratch.path(spark, "protocol"))
    return protocol.run(spark, {"events": f"{sf_dir}/events.parquet"})["bursts"]


def diagnostics_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of diagnostics for each recording is written; what they hold, read back."""
    ev, folder = train(spark, sf_dir), scratch.path(spark, "documents")
    made = M.diagnostics(ev, E.bursts(ev, GAP, MERGE), I.analyzed_duration(I.bounds_of(ev), masks(ev)))
    own = made.select("rec_id", F.struct("n_events", F.round("rate", 9).alias("rate")).alias("events"), F.struct("n_bursts", F.round("tfrac_bursts", 9).alias("tfrac")).alias("bursts"))
    documents.register(spark)
    own.write.format("documents").option("key", "rec_id").mode("append").save(folder)
    back = spark.read.schema(own.schema).json(folder, multiLine=True)
    return back.select("rec_id", "events.n_events", "events.rate", "bursts.n_bursts", "bursts.tfrac")


def classified_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts against a codebook of four nodes over their number of events and duration."""
    made = B.burst_features(ev := train(spark, sf_dir), E.bursts(ev, GAP, MERGE), ["b_n", "dur"])
    book = spark.createDataFrame([(k, [k - 1.5, 1.0 - k], k // 2, 1 - k / 3) for k in range(4)], "node_id int, w array<double>, clust int, si double")
    variables = [{"name": n, "pos": i, "is_log": n == "dur", "mean": m, "std": s, "factor": 1.0} for i, (n, m, s) in enumerate((("b_n", 3.0, 2.0), ("dur", 4.5, 0.4)))]
    return B.classify(made, book, variables, 3).select("rec_id", "start", "b_n", "bmu", "rank", F.round("si", 6).alias("si"))


def severe_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.bursts(train(spark, sf_dir), GAP, MERGE).withColumn("si", F.col("b_n").cast("double"))
    return B.severity_order(made, 72 * HOUR).select("rec_id", "start", "stop")


def spectral_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values stand for power: thinned peaks whose next value exceeds half a deviation."""
    return D.spectral_events(train(spark, sf_dir).select("rec_id", "t", "v"), DEAD, threshold=0.5)[0]


def detected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of both kinds in the signal of evenly spaced samples, a second apart."""
    return D.detect(_chunks(spark, sf_dir), 16, 0.1, 0.4, 2 * SECOND, SECOND, 1.5, "pos", threshold=0.5)


def stream_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream that ends: those kept, as far as the watermark of two days has passed them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    files = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole = any(name.endswith("/events.parquet") for name in files.inputFiles())  # a stream reads a folder: the table's own, or that of its one file
    reader = spark.readStream.schema(files.schema)
    source = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if whole else reader.parquet(f"{sf_dir}/events.parquet")
    events = source.select(F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"))
    out, at = scratch.path(spark, "thinned"), scratch.path(spark, "stream")
    kept = T.thinned(events, DEAD, "2 days", keep=60 * 24 * HOUR, span=24 * HOUR)
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        event_bursts, gap_islands, burst_features, burst_ranks, singlets, free_periods, sparse_events, sparse_selection, refractory_events, mask_union, mask_fusion,
        mask_complement, analyzed_duration, events_in_bursts, overlap_join, touch_join, interval_subtract, insert_predators, clean_events, runs_above_threshold,
        local_maxima, local_minima, running_rms, line_length, zscore_value, percentile_norm, amp_histogram, isi_hist_peak, codebook, bmu_projection, bmu_hits,
        map_quality, category_rates, category_tfracs, diagnostics, state_runs, state_coverage, tolerance_match, nearest_event, next_event, doublets, threshold_counts, burst_isi,
        severe_periods, state_segments, chosen_threshold, refractory_counts, amplitude_events, loud_stretches, saturation_points,
        spectrogram_power, band_power, fourier_resample, smoothed, centered, cusum, window_plan, node_distances, node_severity, node_clusters, trained_map, gmm_sort,
        waveform_features, burst_isi_peak, severe_in_states, severe_by_node, masked_samples, burst_neighbours, double_detections, box_counts, full_diagnostics,
        category_rates_all, state_proximity, flank_events, suggested_masks, chunked_stretches, chunked_saturation, chunked_masks,
        chunked_amplitude_events, signal_runs, change_spans, gmm_each, scored_match, region_matrix, representative_bursts, piece_intervals,
        stage_cutout, protocol_bursts, diagnostics_documents, classified_bursts, severe_within_budget, spectral_peaks, detected_events, stream_thinned,
        state_integrity, state_voids, state_validation, state_density,
    )
}

_EV = "ev AS (SELECT user_id AS rec_id, epoch_us(ts) AS t, value AS v, event_type AS kind FROM events)"
_BOUNDS = "bounds AS (SELECT rec_id, min(t) AS lo, max(t) AS hi FROM ev GROUP BY rec_id)"


def _union(name: str, source: str, gap: int = 0, op: str = ">") -> str:
    """Common table expressions of the union of intervals."""
    return f"""{name}_a AS (SELECT rec_id, start, stop, max(stop) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {source}),
{name}_b AS (SELECT *, sum(CASE WHEN m IS NULL OR start - m {op} {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT rec_id, min(start) AS start, max(stop) AS stop FROM {name}_b GROUP BY rec_id, g)"""


_ISLANDS = f"""isl_a AS (SELECT rec_id, t, CASE WHEN t - lag(t) OVER w < {GAP} THEN 0 ELSE 1 END AS brk FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY t)),
isl_b AS (SELECT rec_id, t, sum(brk) OVER (PARTITION BY rec_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM isl_a),
islands AS (SELECT rec_id, min(t) AS start, max(t) AS stop, count(*) AS n FROM isl_b GROUP BY rec_id, g HAVING count(*) >= 2)"""
_BURSTS = f"""{_ISLANDS},
{_union("merged", "islands", MERGE, ">=")},
bursts AS (SELECT m.rec_id, m.start, m.stop, count(*) AS b_n FROM merged m JOIN ev ON ev.rec_id = m.rec_id AND ev.t BETWEEN m.start AND m.stop GROUP BY ALL)"""
_MASKS = f"masks AS (SELECT rec_id, t - {MARGIN} AS start, t + {MARGIN} AS stop FROM ev WHERE kind = 'error'), {_union('mu', 'masks')}"
_CLIPPED = "mc AS (SELECT mu.rec_id, greatest(start, lo) AS start, least(stop, hi) AS stop FROM mu JOIN bounds USING (rec_id) WHERE least(stop, hi) > greatest(start, lo))"


def _complement(name: str, union: str) -> str:
    return f"""{name}_c AS (SELECT u.rec_id, greatest(start, lo) AS start, least(stop, hi) AS stop FROM {union} u JOIN bounds USING (rec_id) WHERE least(stop, hi) > greatest(start, lo)),
{name}_d AS (SELECT rec_id, start, stop FROM {name}_c UNION ALL SELECT rec_id, lo, lo FROM bounds UNION ALL SELECT rec_id, hi, hi FROM bounds),
{name} AS (SELECT rec_id, stop AS start, nxt AS stop FROM (SELECT rec_id, stop, lead(start) OVER (PARTITION BY rec_id ORDER BY start, stop) AS nxt FROM {name}_d) WHERE nxt > stop)"""


def _duration(offset: int) -> str:
    return f"""own AS (SELECT rec_id, lo + {offset} AS lo, hi FROM bounds WHERE hi > lo + {offset}),
analysed AS (SELECT o.rec_id, o.hi - o.lo - coalesce(sum(greatest(least(mu.stop, o.hi) - greatest(mu.start, o.lo), 0)), 0)::BIGINT AS dur FROM own o LEFT JOIN mu ON mu.rec_id = o.rec_id GROUP BY o.rec_id, o.hi, o.lo)"""


_VEC = """vec AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
book AS (SELECT label AS node_id, pos, avg(x) AS w FROM vec GROUP BY label, pos),
dists AS (SELECT vec_id, node_id, sqrt(sum((x - w) * (x - w))) AS dist FROM vec JOIN book USING (pos) GROUP BY vec_id, node_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, node_id) AS k FROM dists)"""

_NAMED = "named AS (SELECT *, CASE WHEN b_n >= 5 THEN 'high-load' ELSE 'low-load' END AS cname FROM bursts)"
_RUNS = """run_a AS (SELECT rec_id, t, kind, CASE WHEN kind = lag(kind) OVER (PARTITION BY rec_id ORDER BY t) THEN 0 ELSE 1 END AS brk FROM ev), run_b AS (SELECT *, sum(brk) OVER (PARTITION BY rec_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM run_a),
runs AS (SELECT rec_id, kind AS state, min(t) AS start, max(t) AS stop FROM run_b GROUP BY rec_id, kind, g HAVING max(t) > min(t))"""
_INDEXED = "ix AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS i, v FROM ev)"
_PEAKS = "near_ AS (SELECT rec_id, t, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY t)), peaks AS (SELECT rec_id, t, v FROM near_ WHERE p < v AND v > q)"


def _free(name: str, least: int, margin: int) -> str:
    """Parts longer than least without event or mask, shrunk by margin."""
    return f"""{name}_m AS (SELECT rec_id, t - {MARGIN} AS start, t + {MARGIN} AS stop FROM ev WHERE kind = 'error' UNION ALL SELECT rec_id, t, t FROM ev), {_union(f"{name}_u", f"{name}_m")},
{name}_e AS (SELECT rec_id, greatest(start, lo) AS start, least(stop, hi) AS stop FROM {name}_u JOIN bounds USING (rec_id)),
{name}_g AS (SELECT rec_id, stop AS a, lead(start) OVER (PARTITION BY rec_id ORDER BY start, stop) AS b FROM {name}_e),
{name} AS (SELECT rec_id, a + {margin} AS start, b - {margin} AS stop FROM {name}_g WHERE b - a > {least} AND b - {margin} > a + {margin})"""


_SPECTRA = f"""{_INDEXED}, wave AS (SELECT j, k, 0.5 - 0.5 * cos(2 * pi() * j / 15) AS w, cos(2 * pi() * j * k / 16) AS c, sin(2 * pi() * j * k / 16) AS s FROM range(16) a(j), range(2, 7) b(k)),
spectra AS (SELECT a.rec_id, a.i, k AS bin, (pow(sum(b.v * w * c), 2) + pow(sum(b.v * w * s), 2)) / 16 AS power FROM ix a JOIN wave ON true JOIN ix b ON b.rec_id = a.rec_id AND b.i = a.i + j GROUP BY a.rec_id, a.i, k HAVING count(*) = 16)"""



def _alarms(name: str, index: str, threshold: float, drift: float) -> str:
    """Alarms of zc (rec_id, i, n, z) read in the order of `index`: (rec_id, seen, start), counted in that order."""
    return f"""{name}_s AS (SELECT rec_id, {index} AS i, z - lag(z) OVER (PARTITION BY rec_id ORDER BY {index}) AS s FROM zc),
{name}_k AS (SELECT rec_id, i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, i AS ua, i AS da, false AS alarm, i AS st FROM {name}_s WHERE i = 0
UNION ALL SELECT rec_id, i, CASE WHEN al THEN 0 ELSE u END, CASE WHEN al THEN 0 ELSE d END, CASE WHEN al THEN i ELSE ua END, CASE WHEN al THEN i ELSE da END, al, CASE WHEN u > {threshold} THEN ua ELSE da END
FROM (SELECT rec_id, i, greatest(u, 0) AS u, greatest(d, 0) AS d, CASE WHEN u <= 0 THEN i ELSE ua END AS ua, CASE WHEN d <= 0 THEN i ELSE da END AS da, u > {threshold} OR d > {threshold} AS al
FROM (SELECT s.rec_id, s.i, k.up + s - {drift} AS u, k.dn - s - {drift} AS d, k.ua, k.da FROM {name}_k k JOIN {name}_s s ON s.rec_id = k.rec_id AND s.i = k.i + 1))),
{name} AS (SELECT rec_id, i AS seen, st AS start FROM {name}_k WHERE alarm)"""


_STATES = f"""st_a AS (SELECT rec_id, t, kind, CASE WHEN kind = lag(kind) OVER (PARTITION BY rec_id ORDER BY t) THEN 0 ELSE 1 END AS brk FROM ev), st_b AS (SELECT *, sum(brk) OVER (PARTITION BY rec_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM st_a),
st_c AS (SELECT rec_id, CASE kind {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in STATE_OF.items())} END AS state, min(t) AS start, max(t) AS last FROM st_b GROUP BY rec_id, kind, g),
st AS (SELECT * FROM (SELECT rec_id, start, coalesce(lead(start) OVER (PARTITION BY rec_id ORDER BY start), last) AS stop, state FROM st_c) WHERE stop > start),
sound AS (SELECT rec_id, start, stop, state, CASE WHEN state NOT IN ('void', 'art') THEN coalesce(lag(state) OVER w NOT IN ('void', 'art'), false) END AS begins,
CASE WHEN state NOT IN ('void', 'art') THEN coalesce(lead(state) OVER w NOT IN ('void', 'art') OR (state = 'depr' AND lead(state) OVER w = 'void'), false) END AS ends FROM st WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop))"""


def _merged(name: str, source: str, only: str = "true") -> str:
    """Neighbours of one state in `source` as one."""
    return f"""{name}_a AS (SELECT *, CASE WHEN state = lag(state) OVER w AND {only} THEN 0 ELSE 1 END AS brk FROM {source} WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop)),
{name}_b AS (SELECT *, sum(brk) OVER (PARTITION BY rec_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT rec_id, min(start) AS start, max(stop) AS stop, state, arg_min_null(begins, start) AS begins, arg_max_null(ends, start) AS ends FROM {name}_b GROUP BY rec_id, state, g)"""


def _void_end(name: str, source: str, side: str, buffer: int) -> str:
    rule = {k: ", ".join(f"'{x}'" for x in v) for k, v in S.ENDS[side].items()}
    span = (
        f"min(start) OVER r AS lo, least(min(start) OVER r + {buffer}, min(CASE WHEN state IN ({rule['protected']}) THEN start END) OVER r) AS hi"
        if side == "start"
        else f"greatest(max(stop) OVER r - {buffer}, max(CASE WHEN state IN ({rule['protected']}) THEN stop END) OVER r) AS lo, max(stop) OVER r AS hi"
    )
    return f"""{name}_m AS (SELECT *, start < hi AND stop > lo AS met FROM (SELECT rec_id, start, stop, state, {span} FROM {source} WINDOW r AS (PARTITION BY rec_id))),
{name} AS (SELECT * FROM (SELECT rec_id, start, least(stop, lo) AS stop, state FROM {name}_m WHERE met AND state IN ({rule['cut']}) UNION ALL SELECT rec_id, greatest(start, lo), least(stop, hi), 'void' FROM {name}_m WHERE met AND state IN ({rule['cut']})
UNION ALL SELECT rec_id, greatest(start, hi), stop, state FROM {name}_m WHERE met AND state IN ({rule['cut']}) UNION ALL SELECT rec_id, start, stop, CASE WHEN met AND state IN ({rule['whole']}) THEN 'void' ELSE state END FROM {name}_m WHERE NOT (met AND state IN ({rule['cut']}))) WHERE stop > start)"""


_LOUD = """lo_a AS (SELECT rec_id, i, v, sqrt(sum(v * v) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4) AS rms FROM ix),
lo_b AS (SELECT *, (rms - avg(rms) OVER w) / nullif(stddev_pop(rms) OVER w, 0) AS z FROM lo_a WINDOW w AS (PARTITION BY rec_id)),
lo_c AS (SELECT rec_id, i, coalesce(z >= 1.2, false) AS high, i - row_number() OVER (PARTITION BY rec_id ORDER BY i) AS run FROM lo_b WHERE z >= 0.3),
lo_d AS (SELECT rec_id, run, i, i - row_number() OVER (PARTITION BY rec_id, run, high ORDER BY i) AS peak, high FROM lo_c),
lo_e AS (SELECT rec_id, run, peak, high, count(*) AS n FROM lo_d GROUP BY ALL), lo_f AS (SELECT rec_id, run, max(n) FILTER (high) AS h FROM lo_e GROUP BY rec_id, run),
loud AS (SELECT rec_id, min(i) AS first, max(i) AS last FROM lo_c JOIN lo_f USING (rec_id, run) GROUP BY rec_id, run, h HAVING h - 1 > 0.5 AND max(i) - min(i) >= 2)"""
_SATURATED = """sa_a AS (SELECT rec_id, i, v, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z FROM ix WINDOW w AS (PARTITION BY rec_id)),
sa_b AS (SELECT *, CASE WHEN z >= 0.5 THEN 1 ELSE -1 END AS side FROM sa_a WHERE abs(z) >= 0.5), sa_c AS (SELECT *, i - row_number() OVER (PARTITION BY rec_id, side ORDER BY i) AS run FROM sa_b),
sa_d AS (SELECT *, count(*) OVER r AS n, row_number() OVER (PARTITION BY rec_id, side, run ORDER BY i) AS place FROM sa_c WINDOW r AS (PARTITION BY rec_id, side, run)), sa_e AS (SELECT * FROM sa_d WHERE place < n),
sa_f AS (SELECT a.rec_id, a.side, a.run, a.i, count(*) AS near FROM sa_e a JOIN sa_e b ON a.rec_id = b.rec_id AND a.side = b.side AND a.run = b.run AND abs(abs(a.v) - abs(b.v)) < 5 GROUP BY ALL),
sa_g AS (SELECT rec_id, side, run, i, coalesce(abs(lead(v, 2) OVER w - 2 * lead(v) OVER w + v) <= 5, false) AS straight FROM sa_e WINDOW w AS (PARTITION BY rec_id, side, run ORDER BY i)),
sa_h AS (SELECT rec_id, side, run, i - row_number() OVER (PARTITION BY rec_id, side, run ORDER BY i) AS tooth FROM sa_g WHERE straight), sa_i AS (SELECT rec_id, side, run, max(c) AS longest FROM (SELECT rec_id, side, run, tooth, count(*) AS c FROM sa_h GROUP BY ALL) GROUP BY ALL),
sa_j AS (SELECT e.rec_id, e.side, e.run, e.n, max(near) AS near, max(longest) AS longest, arg_max(e.i, abs(v) - e.i * 1e-12) AS i FROM sa_e e JOIN sa_f f USING (rec_id, side, run, i) LEFT JOIN sa_i t USING (rec_id, side, run) GROUP BY e.rec_id, e.side, e.run, e.n),
saturated AS (SELECT rec_id, i, CASE WHEN n - 1 > 1 AND near >= 1 THEN 'stump' WHEN n - 1 > 3 AND longest >= 2 THEN 'tooth' END AS kind FROM sa_j WHERE (n - 1 > 1 AND near >= 1) OR (n - 1 > 3 AND longest >= 2))"""

ORACLES: dict[str, str] = {
    "waveform_features": f"""WITH {_EV}, {_BOUNDS}, {_BURSTS}, {_free("free", 12 * HOUR, 0)}, d AS (SELECT b.rec_id, b.start, b.stop, abs(v - lag(v) OVER (PARTITION BY b.rec_id, b.start ORDER BY t)) AS d FROM bursts b JOIN ev ON ev.rec_id = b.rec_id AND t BETWEEN start AND stop),
f AS (SELECT rec_id, nullif(stddev_pop(v), 0) AS sd FROM (SELECT DISTINCT ev.rec_id, t, v FROM ev JOIN free USING (rec_id) WHERE t BETWEEN start AND stop) GROUP BY rec_id),
l AS (SELECT rec_id, start, stop, coalesce(sum(d), 0) AS l, nullif((stop - start) / 1e6, 0) AS s FROM d GROUP BY rec_id, start, stop)
SELECT rec_id, start, stop, round(l, 6) AS l_len, round(l / s, 6) AS l_rate, round(l / sd, 6) AS lz_len, round(l / sd / s, 6) AS lz_rate FROM l LEFT JOIN f USING (rec_id)""",
    "burst_isi_peak": f"""WITH {_EV}, {_BURSTS}, st AS (SELECT log10(600.0::DOUBLE) AS l, (log10(18000.0::DOUBLE) - log10(600.0::DOUBLE)) / 20 AS step),
i AS (SELECT b.rec_id, b.start, (t - lag(t) OVER (PARTITION BY b.rec_id, b.start ORDER BY t)) / 1e6 AS s FROM bursts b JOIN ev ON ev.rec_id = b.rec_id AND t BETWEEN start AND stop),
c AS (SELECT rec_id, start, floor((log10(s) - l) / step) AS bin, count(*) AS n FROM i, st WHERE s >= 600 AND s < 18000 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, start ORDER BY n DESC, bin) AS k FROM c)
SELECT b.rec_id, b.start, b.stop, round(coalesce(pow(10.0::DOUBLE, l + bin * step), 600), 4) AS isi_peak FROM bursts b CROSS JOIN st LEFT JOIN r ON r.rec_id = b.rec_id AND r.start = b.start AND k = 1""",
    "severe_in_states": f"""WITH {_EV}, {_BURSTS}, {_NAMED}, {_RUNS} SELECT r.rec_id, r.start, r.stop, count(n.start) AS n_severe FROM runs r LEFT JOIN named n ON n.rec_id = r.rec_id AND cname = 'high-load' AND n.start < r.stop AND r.start < n.stop GROUP BY ALL""",
    "severe_by_node": f"""WITH {_EV}, {_BURSTS}, f AS (SELECT rec_id, start - lag(stop) OVER (PARTITION BY rec_id ORDER BY start) AS gap FROM bursts WHERE b_n IN (3, 4))
SELECT r.rec_id, count(f.rec_id) - count(*) FILTER (gap < {60 * HOUR}) AS n, count(f.rec_id) AS n_all FROM (SELECT DISTINCT rec_id FROM ev) r LEFT JOIN f USING (rec_id) GROUP BY r.rec_id""",
    "masked_samples": f"""WITH {_EV} SELECT rec_id, t, CASE WHEN NOT EXISTS (SELECT 1 FROM ev m WHERE m.rec_id = ev.rec_id AND m.kind = 'error' AND abs(m.t - ev.t) < {MARGIN}) THEN v END AS v FROM ev""",
    "burst_neighbours": f"""WITH {_EV}, {_BURSTS} SELECT rec_id, start, stop, lag(start) OVER w AS prev_start, lag(stop) OVER w AS prev_stop, lead(start) OVER w AS next_start, lead(stop) OVER w AS next_stop FROM bursts WINDOW w AS (PARTITION BY rec_id ORDER BY start)""",
    "double_detections": f"""WITH {_EV}, p AS (SELECT rec_id, t AS first, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS second FROM ev WHERE kind = 'click'), q AS (SELECT * FROM p WHERE second - first < {20 * HOUR}),
m AS (SELECT q.rec_id, first, second, t, row_number() OVER (PARTITION BY q.rec_id, first ORDER BY v, t) AS k FROM q JOIN ev ON ev.rec_id = q.rec_id AND t >= first - {5 * HOUR} AND t < second + {20 * HOUR})
SELECT rec_id, first, second, CASE WHEN abs(t - second) < abs(t - first) THEN second ELSE first END AS true_t, CASE WHEN abs(t - second) < abs(t - first) THEN first ELSE second END AS false_t FROM m WHERE k = 1""",
    "box_counts": f"""WITH {_EV} SELECT a.rec_id, a.t, count(b.t) AS n FROM ev a LEFT JOIN ev b ON b.rec_id = a.rec_id AND b.kind = 'error' AND abs(b.t - a.t) < {30 * HOUR} WHERE a.kind = 'click' GROUP BY a.rec_id, a.t""",
    "full_diagnostics": f"""WITH {_EV}, {_BOUNDS}, {_MASKS}, {_BURSTS}, {_NAMED}, {_duration(0)}, {_complement("piece", "mu")}, {_free("calm", FREE, FREE_MARGIN)},
i AS (SELECT p.rec_id, t - lag(t) OVER (PARTITION BY p.rec_id, p.start ORDER BY t) AS isi FROM piece p JOIN ev ON ev.rec_id = p.rec_id AND t BETWEEN p.start AND p.stop),
x AS (SELECT rec_id, (stddev_pop(isi) - avg(isi)) / nullif(stddev_pop(isi) + avg(isi), 0) AS burstiness FROM i GROUP BY rec_id), e AS (SELECT rec_id, count(*) AS n FROM ev GROUP BY rec_id),
b AS (SELECT rec_id, sum(stop - start) AS d, count(*) FILTER (cname = 'high-load') AS h, sum(stop - start) FILTER (cname = 'high-load') AS dh FROM named GROUP BY rec_id),
f AS (SELECT rec_id, sum(stop - start) AS d FROM calm GROUP BY rec_id), m AS (SELECT rec_id, sum(stop - start) AS d FROM mu GROUP BY rec_id)
SELECT a.rec_id, round(coalesce(e.n, 0) / nullif(dur, 0)::DOUBLE * 1e6, 9) AS rate_events, round(coalesce(h, 0) / nullif(dur, 0)::DOUBLE * 6e7, 9) AS rate_high_load, round(coalesce(dh, 0)::DOUBLE / nullif(dur, 0), 9) AS tfrac_high_load,
round(coalesce(b.d, 0)::DOUBLE / nullif(dur, 0), 9) AS tfrac_bursts, round(coalesce(f.d, 0)::DOUBLE / nullif(dur, 0), 9) AS tfrac_free, round(burstiness, 9) AS burstiness, round(dur / 6e7, 9) AS minutes, round(coalesce(m.d, 0)::DOUBLE / 6e7, 9) AS minutes_masked
FROM analysed a LEFT JOIN e USING (rec_id) LEFT JOIN x USING (rec_id) LEFT JOIN b USING (rec_id) LEFT JOIN f USING (rec_id) LEFT JOIN m USING (rec_id)""",
    "category_rates_all": f"""WITH {_EV}, {_BOUNDS}, {_MASKS}, {_BURSTS}, {_NAMED}, {_duration(0)}, a AS (SELECT rec_id, cname FROM named UNION ALL SELECT rec_id, 'discharges' FROM ev)
SELECT rec_id, cname, count(*) AS n, round(count(*) / (nullif(dur, 0) / 1e6), 9) AS rate FROM a JOIN analysed USING (rec_id) GROUP BY rec_id, cname, dur""",
    "state_proximity": f"""WITH {_EV}, {_RUNS}, s AS (SELECT rec_id, start, stop FROM runs WHERE state = 'click')
SELECT s.rec_id, start, stop, count(*) FILTER (2 * t > start + stop) AS near, count(*) FILTER (2 * t < start + stop) AS far,
round(CASE WHEN far = 0 THEN 'inf'::DOUBLE ELSE near / far END, 6) AS proxdist FROM s JOIN ev ON ev.rec_id = s.rec_id AND t BETWEEN start AND stop GROUP BY s.rec_id, start, stop""",
    "refractory_counts": f"""WITH RECURSIVE {_EV}, {_PEAKS}, o AS (SELECT rec_id, th, t, row_number() OVER (PARTITION BY rec_id, th ORDER BY t) AS i FROM (SELECT rec_id, (10 * x)::DOUBLE AS th, t FROM peaks, range(10) r(x) WHERE v > 10 * x)),
k AS (SELECT rec_id, th, t, i, t AS last FROM o WHERE i = 1 UNION ALL SELECT o.rec_id, o.th, o.t, o.i, CASE WHEN o.t - k.last >= {DEAD} THEN o.t ELSE k.last END FROM k JOIN o ON o.rec_id = k.rec_id AND o.th = k.th AND o.i = k.i + 1),
n AS (SELECT rec_id, th, count(*) AS n FROM k WHERE t = last GROUP BY rec_id, th) SELECT r.rec_id, (10 * x)::DOUBLE AS threshold, coalesce(n, 0) AS n FROM (SELECT DISTINCT rec_id FROM peaks) r CROSS JOIN range(10) y(x) LEFT JOIN n ON n.rec_id = r.rec_id AND th = 10 * x""",
    "cusum": f"""WITH RECURSIVE {_EV}, {_INDEXED}, z AS (SELECT rec_id, i, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z FROM ix WINDOW w AS (PARTITION BY rec_id)), s AS (SELECT rec_id, i, coalesce(z - lag(z) OVER (PARTITION BY rec_id ORDER BY i), 0) AS s FROM z WHERE z IS NOT NULL),
k AS (SELECT rec_id, i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, false AS alarm FROM s WHERE i = 0 UNION ALL
SELECT s.rec_id, s.i, greatest(0, CASE WHEN k.alarm THEN 0 ELSE k.up END + s - 0.5), greatest(0, CASE WHEN k.alarm THEN 0 ELSE k.down END - s - 0.5),
greatest(CASE WHEN k.alarm THEN 0 ELSE k.up END + s, CASE WHEN k.alarm THEN 0 ELSE k.down END - s) - 0.5 > 4 FROM k JOIN s ON s.rec_id = k.rec_id AND s.i = k.i + 1) SELECT rec_id, i FROM k WHERE alarm""",
    "loud_stretches": f"""WITH {_EV}, {_INDEXED}, {_LOUD} SELECT rec_id, first, last FROM loud""",
    "saturation_points": f"""WITH {_EV}, {_INDEXED}, {_SATURATED} SELECT rec_id, i, kind FROM saturated""",
    "suggested_masks": f"""WITH {_EV}, {_INDEXED}, {_LOUD}, {_SATURATED}, both_ AS (SELECT rec_id, first * 1000000 - 2000000 AS start, last * 1000000 + 2000000 AS stop FROM loud UNION ALL SELECT rec_id, i * 1000000 - 1000000, i * 1000000 + 1000000 FROM saturated),
{_union("fused", "both_", 3 * SECOND)} SELECT rec_id, start, stop FROM fused""",
    "chunked_amplitude_events": f"""WITH {_EV}, {_INDEXED}, xs AS (SELECT rec_id, i * {SECOND} AS t, v FROM ix),
er AS (SELECT rec_id, i * {SECOND} AS t FROM (SELECT rec_id, kind, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS i FROM ev) WHERE kind = 'error'),
p AS (SELECT x.rec_id, x.t, x.v, (SELECT max(er.t) FROM er WHERE er.rec_id = x.rec_id AND er.t <= x.t) AS b, (SELECT min(er.t) FROM er WHERE er.rec_id = x.rec_id AND er.t >= x.t) AS a FROM xs x),
f AS (SELECT * FROM p WHERE (a IS NULL AND b IS NULL) OR (t - b > {SECOND} AND a - t > {SECOND})),
z AS (SELECT *, (v - avg(v) OVER r) / nullif(stddev_pop(v) OVER r, 0) AS z, CASE WHEN b IS NOT DISTINCT FROM lag(b) OVER w THEN coalesce(t - lag(t) OVER w, 0) ELSE 0 END AS spent FROM f WINDOW r AS (PARTITION BY rec_id), w AS (PARTITION BY rec_id ORDER BY t)),
k AS (SELECT *, sum(spent) OVER (PARTITION BY rec_id ORDER BY t) AS clock FROM z), h AS (SELECT rec_id, t, clock - lag(clock) OVER (PARTITION BY rec_id ORDER BY t) AS gap FROM k WHERE z > 1.0)
SELECT rec_id, t FROM h WHERE gap IS NULL OR gap > {3 * SECOND}""",
    "scored_match": f"""WITH {_EV}, {_BURSTS}, w AS (SELECT e.rec_id, e.t, e.kind, b.start FROM bursts b JOIN ev e ON e.rec_id = b.rec_id AND e.t BETWEEN b.start AND b.stop),
j AS (SELECT a.rec_id, a.kind, EXISTS (SELECT 1 FROM w x WHERE x.rec_id = a.rec_id AND x.start = a.start AND x.kind = 'purchase' AND abs(x.t - a.t) < {4 * HOUR}) AS near FROM w a WHERE a.kind IN ('click', 'view'))
SELECT r.rec_id, count(*) FILTER (kind = 'click' AND near) AS tp, count(*) FILTER (kind = 'click' AND NOT near) AS fp, count(*) FILTER (kind = 'view' AND NOT near) AS tn, count(*) FILTER (kind = 'view' AND near) AS fn
FROM (SELECT DISTINCT rec_id FROM bursts) r LEFT JOIN j USING (rec_id) GROUP BY r.rec_id""",
    "region_matrix": f"""WITH {_EV}, {_BURSTS}, {_RUNS}, f AS (SELECT *, (stop - start) / {HOUR}::DOUBLE AS h FROM bursts),
m AS (SELECT f.rec_id, f.start, r.state, least(f.stop, r.stop) - greatest(f.start, r.start) AS overlap, row_number() OVER (PARTITION BY f.rec_id, f.start ORDER BY least(f.stop, r.stop) - greatest(f.start, r.start) DESC, r.start, r.state) AS k
FROM f JOIN runs r ON r.rec_id = f.rec_id AND r.start <= f.stop AND f.start <= r.stop)
SELECT f.rec_id, f.start, f.stop, round(b_n / sqrt(b_n * b_n + h * h), 9) AS v0, round(h / sqrt(b_n * b_n + h * h), 9) AS v1, state, overlap FROM f LEFT JOIN m ON m.rec_id = f.rec_id AND m.start = f.start AND k = 1""",
    "representative_bursts": f"""WITH {_EV}, {_BURSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY b_n, start) - 1 AS r, count(*) OVER (PARTITION BY rec_id) - 1 AS z FROM bursts),
k AS (SELECT *, reverse(lpad(bin(r), length(bin(z))::INT, '0')) AS key FROM r),
u AS (SELECT *, sum(least(stop - start, {40 * HOUR // 12})) OVER (PARTITION BY rec_id ORDER BY key) AS used, row_number() OVER (PARTITION BY rec_id ORDER BY key) - 1 AS place FROM k)
SELECT rec_id, start, stop, place FROM u WHERE used <= {40 * HOUR}""",
    "piece_intervals": f"""WITH {_EV}, {_BOUNDS}, {_MASKS}, edge AS (SELECT rec_id, start, stop FROM mu UNION ALL SELECT rec_id, hi, hi FROM bounds),
gap AS (SELECT e.rec_id, greatest(coalesce(lag(least(e.stop, hi)) OVER (PARTITION BY e.rec_id ORDER BY e.start, e.stop), lo), lo) AS start, least(e.start, hi) AS stop FROM edge e JOIN bounds USING (rec_id)),
free AS (SELECT * FROM gap WHERE stop > start),
held AS (SELECT f.*, t, t - lag(t) OVER (PARTITION BY f.rec_id, f.start ORDER BY t) AS isi FROM free f JOIN ev ON ev.rec_id = f.rec_id AND t BETWEEN f.start AND f.stop)
SELECT rec_id, start, stop, count(*) AS n, coalesce(max(isi), 0) AS longest FROM held GROUP BY rec_id, start, stop""",
    "stage_cutout": f"""WITH {_EV}, {_BURSTS}, {_MASKS}, every_ AS (SELECT rec_id, 'events' AS stage FROM ev WHERE t BETWEEN {CUT[0]} AND {CUT[1]}
UNION ALL SELECT rec_id, 'masks' FROM mu WHERE start <= {CUT[1]} AND stop >= {CUT[0]} UNION ALL SELECT rec_id, 'bursts' FROM bursts WHERE start < {CUT[1]} AND stop > {CUT[0]})
SELECT rec_id, stage, count(*) AS n FROM every_ GROUP BY ALL""",
    "protocol_bursts": f"""WITH RECURSIVE whole AS (SELECT user_id AS rec_id, epoch_us(ts) AS t FROM events), o AS (SELECT rec_id, t, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS i FROM whole),
k AS (SELECT rec_id, t, i, t AS last FROM o WHERE i = 1 UNION ALL SELECT o.rec_id, o.t, o.i, CASE WHEN o.t - k.last >= {DEAD} THEN o.t ELSE k.last END FROM k JOIN o ON o.rec_id = k.rec_id AND o.i = k.i + 1), ev AS (SELECT rec_id, t FROM k WHERE t = last), {_BURSTS} SELECT rec_id, start, stop, b_n FROM bursts""",
    "stream_thinned": f"""WITH RECURSIVE {_EV}, o AS (SELECT rec_id, t, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS i FROM ev),
k AS (SELECT rec_id, t, i, t AS last FROM o WHERE i = 1 UNION ALL SELECT o.rec_id, o.t, o.i, CASE WHEN o.t - k.last >= {DEAD} THEN o.t ELSE k.last END FROM k JOIN o ON o.rec_id = k.rec_id AND o.i = k.i + 1), w AS (SELECT max(t) // 1000 * 1000 - {48 * HOUR} AS w FROM ev) SELECT rec_id, t FROM k, w WHERE t = last AND t < w""",
    "classified_bursts": f"""WITH {_EV}, {_BURSTS}, x AS (SELECT rec_id, start, b_n, (b_n - 3.0) / 2.0 AS a, (CASE WHEN stop > start THEN log10((stop - start) / 1e6) ELSE 1e-5 END - 4.5) / 0.4 AS b FROM bursts),
d AS (SELECT *, k, row_number() OVER (PARTITION BY rec_id, start ORDER BY (a - (k - 1.5)) ** 2 + (b - (1.0 - k)) ** 2, k) AS place FROM x, range(4) n(k))
SELECT rec_id, start, b_n, CASE WHEN b_n >= 3 THEN k END AS bmu, CASE WHEN b_n >= 3 THEN k // 2 END AS rank, CASE WHEN b_n >= 3 THEN round(1 - k / 3.0::DOUBLE, 6) END AS si FROM d WHERE place = 1""",
    "severe_within_budget": f"""WITH {_EV}, {_BURSTS}, u AS (SELECT *, sum(stop - start) OVER (PARTITION BY rec_id ORDER BY b_n DESC, start) AS used FROM bursts) SELECT rec_id, start, stop FROM u WHERE used <= {72 * HOUR}""",
    "spectral_peaks": f"""WITH RECURSIVE {_EV}, z AS (SELECT rec_id, t, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z FROM ev WINDOW w AS (PARTITION BY rec_id)),
n AS (SELECT *, lag(z) OVER w AS p, lead(z) OVER w AS q, max(z) OVER (PARTITION BY rec_id) AS top, row_number() OVER w AS i FROM z WHERE z IS NOT NULL WINDOW w AS (PARTITION BY rec_id ORDER BY t)),
flat AS (SELECT rec_id, t, i - row_number() OVER (PARTITION BY rec_id ORDER BY i) AS g FROM n WHERE z = top),
centre AS (SELECT rec_id, list(t ORDER BY t)[(count(*) - 1) // 2 + 1] AS t FROM flat GROUP BY rec_id, g HAVING count(*) > 1),
peak AS (SELECT rec_id, t FROM n WHERE p < z AND z > q AND q > 0.5 UNION ALL SELECT rec_id, t FROM centre), o AS (SELECT rec_id, t, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS i FROM peak),
k AS (SELECT rec_id, t, i, t AS last FROM o WHERE i = 1 UNION ALL SELECT o.rec_id, o.t, o.i, CASE WHEN o.t - k.last >= {DEAD} THEN o.t ELSE k.last END FROM k JOIN o ON o.rec_id = k.rec_id AND o.i = k.i + 1) SELECT rec_id, t FROM k WHERE t = last""",
    "flank_events": f"""WITH {_EV}, {_INDEXED}, z AS (SELECT rec_id, i AS t, -(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS v FROM ix WINDOW w AS (PARTITION BY rec_id)), zz AS (SELECT * FROM z WHERE v IS NOT NULL),
low AS (SELECT rec_id, t, t - row_number() OVER (PARTITION BY rec_id ORDER BY t) AS g FROM zz WHERE v <= -1.0), run AS (SELECT rec_id, min(t) AS a, max(t) AS z FROM low GROUP BY rec_id, g),
snip AS (SELECT rec_id, a - 6 AS start, z + 8 AS stop FROM run r WHERE NOT EXISTS (SELECT 1 FROM zz p WHERE p.rec_id = r.rec_id AND p.v >= 2.5 AND p.t BETWEEN r.a - 12 AND r.z + 15)),
near_ AS (SELECT rec_id, t, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM zz WINDOW w AS (PARTITION BY rec_id ORDER BY t)), low_at AS (SELECT s.rec_id, s.start, s.stop, n.t AS b FROM snip s JOIN near_ n ON n.rec_id = s.rec_id AND n.p > n.v AND n.q > n.v AND n.t > s.start AND n.t < s.stop),
best AS (SELECT s.rec_id, s.start, s.stop, e.t, b, row_number() OVER (PARTITION BY s.rec_id, s.start, s.stop, e.t ORDER BY abs(e.t - b), b) AS k FROM snip s JOIN zz e ON e.rec_id = s.rec_id AND e.t BETWEEN s.start AND s.stop JOIN low_at l ON l.rec_id = s.rec_id AND l.start = s.start AND l.stop = s.stop),
placed AS (SELECT *, row_number() OVER (PARTITION BY rec_id, start, stop, b ORDER BY abs(t - b), t) AS place FROM best WHERE k = 1)
SELECT DISTINCT rec_id, t FROM placed WHERE place > 1 AND stop - t > 0.8 AND t - start > 0.6""",
    "state_integrity": f"""WITH {_EV}, {_STATES}, {_merged('made', 'sound')} SELECT * FROM made""",
    "state_voids": f"""WITH {_EV}, {_STATES}, {_void_end('va', 'st', 'start', KIND_STATES.first_buffer)}, {_void_end('vb', 'va', 'stop', KIND_STATES.last_buffer)},
n AS (SELECT *, coalesce(lag(state) OVER w = 'art', false) OR coalesce(lead(state) OVER w = 'art', false) AS beside FROM vb WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop))
SELECT rec_id, start, stop, CASE WHEN beside AND (state IN ('postUp', 'preUp', 'depr', 'dense') OR (state = 'IIP' AND stop - start < {KIND_STATES.quiet})) THEN 'void' ELSE state END AS state FROM n""",
    "state_validation": f"""WITH {_EV}, {_STATES}, c AS (SELECT s.*, (SELECT count(*) FROM ev WHERE ev.rec_id = s.rec_id AND t >= s.start AND (t < s.stop OR (t = s.stop AND NOT EXISTS (SELECT 1 FROM st n WHERE n.rec_id = s.rec_id AND n.start = s.stop)))) AS n FROM sound s),
d AS (SELECT *, coalesce(sum(CASE WHEN state = 'IIP' THEN stop - start END) OVER r, 0) AS total, coalesce(sum(CASE WHEN state = 'IIP' THEN n END) OVER r, 0) AS k FROM c WINDOW r AS (PARTITION BY rec_id)),
e AS (SELECT *, total < {KIND_STATES.least_iip} AND state IN ('preUp', 'postUp', 'IIP') AS lost FROM d)
SELECT rec_id, start, stop, CASE WHEN lost THEN 'void' WHEN state IN ('preUp', 'postUp') AND n * total <= k * (stop - start) THEN 'IIP' ELSE state END AS state, CASE WHEN NOT lost THEN begins END AS begins, CASE WHEN NOT lost THEN ends END AS ends FROM e""",
    "state_density": f"""WITH {_EV}, {_BURSTS}, {_STATES}, {_merged('made', 'sound')},
f AS (SELECT m.*, coalesce((SELECT sum(b.stop - b.start) FROM bursts b WHERE b.rec_id = m.rec_id AND b.b_n >= 3 AND m.state = 'IIP' AND b.start < m.stop AND b.stop > m.start) > {KIND_STATES.medium_share} * (m.stop - m.start), false) AS whole FROM made m),
g AS (SELECT * REPLACE (CASE WHEN whole OR ((coalesce(lag(whole) OVER w, false) OR coalesce(lead(whole) OVER w, false)) AND state IN ('preUp', 'postUp')) THEN 'Mdense' ELSE state END AS state) FROM f WINDOW w AS (PARTITION BY rec_id ORDER BY start, stop)),
{_merged('dense', 'g', "state = 'Mdense'")} SELECT * FROM dense""",
    "change_spans": f"""WITH RECURSIVE {_EV}, {_INDEXED}, zc AS (SELECT rec_id, i, v, count(*) OVER w AS n, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM ix WINDOW w AS (PARTITION BY rec_id) QUALIFY stddev_pop(v) OVER w > 0),
{_alarms("fo", "i", 2.0, 0.3)}, {_alarms("ba", "n - 1 - i", 2.0, 0.3)},
forth AS (SELECT rec_id, start, min(seen) AS alarm FROM fo GROUP BY rec_id, start),
ends AS (SELECT DISTINCT b.rec_id, n.n - 1 - b.start AS e FROM ba b JOIN (SELECT DISTINCT rec_id, n FROM zc) n USING (rec_id)),
spans AS (SELECT f.*, lead(start) OVER (PARTITION BY rec_id ORDER BY alarm) AS nxt, (SELECT min(e) FROM ends WHERE ends.rec_id = f.rec_id AND e >= f.alarm) AS e, (SELECT max(i) FROM zc WHERE zc.rec_id = f.rec_id) AS z FROM forth f),
closed AS (SELECT rec_id, start, alarm, coalesce(least(e, nxt), z) AS stop FROM spans)
SELECT c.rec_id, c.start, c.alarm, c.stop, round(b.v - a.v, 6) AS amp FROM closed c JOIN zc a ON a.rec_id = c.rec_id AND a.i = c.start JOIN zc b ON b.rec_id = c.rec_id AND b.i = c.stop""",
    "smoothed": f"""WITH {_EV}, {_INDEXED}, n AS (SELECT rec_id, max(i) AS z FROM ix GROUP BY rec_id), kernel AS (SELECT * FROM (VALUES (-2, -3.0 / 35), (-1, 12.0 / 35), (0, 17.0 / 35), (1, 12.0 / 35), (2, -3.0 / 35)) t(j, w)),
p AS (SELECT ix.rec_id, i, w, i + j AS at, CASE WHEN i + j < 0 THEN -(i + j) WHEN i + j > z THEN 2 * z - i - j ELSE i + j END AS src, CASE WHEN i + j < 0 THEN 0 WHEN i + j > z THEN z END AS edge FROM ix JOIN n USING (rec_id), kernel)
SELECT p.rec_id, p.i, round(sum(w::DOUBLE * CASE WHEN edge IS NULL THEN a.v ELSE 2 * b.v - a.v END), 6) AS v FROM p JOIN ix a ON a.rec_id = p.rec_id AND a.i = src LEFT JOIN ix b ON b.rec_id = p.rec_id AND b.i = edge GROUP BY p.rec_id, p.i""",
    "spectrogram_power": f"WITH {_EV}, {_SPECTRA} SELECT rec_id, i, bin, round(power, 6) AS power FROM spectra",
    "band_power": f"""WITH {_EV}, {_SPECTRA}, q AS (SELECT rec_id, bin, quantile_cont(power, 0.05) AS lo, quantile_cont(power, 0.95) AS hi FROM spectra GROUP BY rec_id, bin),
m AS (SELECT rec_id, i, avg(coalesce(least(greatest((power - lo) / nullif(hi - lo, 0), 0), 1), 0)) AS m FROM spectra JOIN q USING (rec_id, bin) GROUP BY rec_id, i)
SELECT rec_id, i, round((m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0), 6) AS v FROM m WINDOW w AS (PARTITION BY rec_id)""",
    "event_bursts": f"WITH {_EV}, {_BURSTS} SELECT * FROM bursts",
    "gap_islands": f"WITH {_EV}, {_ISLANDS} SELECT * FROM islands",
    "burst_features": f"""WITH {_EV}, {_BURSTS},
inside AS (SELECT b.rec_id, b.start, b.stop, t, (t - lag(t) OVER (PARTITION BY b.rec_id, b.start ORDER BY t)) / 1e6 AS isi FROM bursts b JOIN ev ON ev.rec_id = b.rec_id AND ev.t BETWEEN b.start AND b.stop)
SELECT rec_id, start, stop, count(*) AS b_n, (max(t) - min(t)) / 1e6 AS dur, floor(avg(isi) * 1e3) / 1e3 AS isi_mean, floor(stddev_pop(isi) * 1e3) / 1e3 AS isi_std, floor(quantile_cont(isi, 0.5) * 1e3) / 1e3 AS isi_med,
floor(stddev_pop(isi) / avg(isi) * 1e6) / 1e6 AS isi_cv, floor(var_pop(isi) / avg(isi) * 1e3) / 1e3 AS isi_fano FROM inside GROUP BY rec_id, start, stop""",
    "burst_ranks": f"""WITH {_EV}, {_BURSTS}, r AS (SELECT *, CASE WHEN b_n >= 8 THEN 0 WHEN b_n >= 7 THEN 1 WHEN b_n >= 6 THEN 2 WHEN b_n >= 5 THEN 3 END AS rank FROM bursts)
SELECT rec_id, start, b_n, rank, CASE rank WHEN 0 THEN 'XL' WHEN 1 THEN 'L' WHEN 2 THEN 'M' WHEN 3 THEN 'S' ELSE 'XS' END AS rank_name,
CASE WHEN rank <= 1 THEN 'high-load' WHEN rank = 2 THEN 'medium-load' ELSE 'low-load' END AS cname FROM r""",
    "singlets": f"""WITH {_EV}, n AS (SELECT rec_id, t, t - lag(t) OVER w AS b, lead(t) OVER w - t AS a FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY t))
SELECT rec_id, t FROM n WHERE (a IS NOT NULL OR b IS NOT NULL) AND coalesce(a >= {GAP}, true) AND coalesce(b >= {GAP}, true)""",
    "free_periods": f"""WITH {_EV}, {_BOUNDS}, masks AS (SELECT rec_id, t - {MARGIN} AS start, t + {MARGIN} AS stop FROM ev WHERE kind = 'error' UNION ALL SELECT rec_id, t, t FROM ev), {_union("mu", "masks")}, {_CLIPPED},
edges AS (SELECT rec_id, greatest(start, lo) AS start, least(stop, hi) AS stop FROM mu JOIN bounds USING (rec_id)),
gaps AS (SELECT rec_id, stop AS a, lead(start) OVER (PARTITION BY rec_id ORDER BY start, stop) AS b FROM edges)
SELECT rec_id, a + {FREE_MARGIN} AS start, b - {FREE_MARGIN} AS stop FROM gaps WHERE b - a > {FREE} AND b - {FREE_MARGIN} > a + {FREE_MARGIN}""",
    "sparse_events": f"""WITH {_EV} SELECT a.rec_id, a.t, count(*) FILTER (b.t >= a.t - {BEFORE} AND b.t < a.t) AS n_before, count(*) FILTER (b.t > a.t AND b.t <= a.t + {AFTER}) AS n_after,
count(*) FILTER (abs(b.t - a.t) <= {AROUND}) - 1 AS n_around FROM ev a JOIN ev b ON a.rec_id = b.rec_id AND b.t BETWEEN a.t - {AFTER} AND a.t + {AFTER} GROUP BY a.rec_id, a.t""",
    "sparse_selection": f"""WITH {_EV}, c AS (SELECT a.rec_id, a.t, count(*) FILTER (b.t >= a.t - {BEFORE} AND b.t < a.t) AS n1, count(*) FILTER (b.t > a.t AND b.t <= a.t + {AFTER}) AS n2,
count(*) FILTER (abs(b.t - a.t) <= {AROUND}) - 1 AS n3, count(*) FILTER (b.t >= a.t - {QUIET} AND b.t < a.t) AS n4 FROM ev a JOIN ev b ON a.rec_id = b.rec_id AND b.t BETWEEN a.t - {AFTER} AND a.t + {AFTER} GROUP BY a.rec_id, a.t)
SELECT rec_id, t FROM c WHERE (n1 <= 1 AND n2 <= 1 AND n3 <= 1) OR n4 = 0""",
    "refractory_events": f"""WITH RECURSIVE {_EV}, o AS (SELECT rec_id, t, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS i FROM ev),
k AS (SELECT rec_id, t, i, t AS last FROM o WHERE i = 1 UNION ALL SELECT o.rec_id, o.t, o.i, CASE WHEN o.t - k.last >= {DEAD} THEN o.t ELSE k.last END FROM k JOIN o ON o.rec_id = k.rec_id AND o.i = k.i + 1)
SELECT rec_id, t FROM k WHERE t = last""",
    "mask_union": f"WITH {_EV}, {_MASKS} SELECT rec_id, start, stop FROM mu",
    "mask_fusion": f"""WITH {_EV}, {_BURSTS}, both_ AS (SELECT rec_id, start - {HOUR} AS start, stop + {HOUR} AS stop FROM bursts UNION ALL SELECT rec_id, t - {2 * HOUR}, t + {2 * HOUR} FROM ev WHERE kind = 'error'),
{_union("fused", "both_", 12 * HOUR)} SELECT rec_id, start, stop FROM fused""",
    "mask_complement": f"WITH {_EV}, {_BOUNDS}, {_MASKS}, {_complement('free', 'mu')} SELECT rec_id, start, stop FROM free",
    "analyzed_duration": f"WITH {_EV}, {_BOUNDS}, {_MASKS}, {_duration(OFFSET)} SELECT rec_id, dur FROM analysed",
    "events_in_bursts": f"WITH {_EV}, {_BURSTS} SELECT kind, count(*) AS n, sum(b_n)::BIGINT AS sum_n FROM ev JOIN bursts b ON ev.rec_id = b.rec_id AND t BETWEEN start AND stop GROUP BY kind",
    "overlap_join": f"WITH {_EV}, {_BURSTS}, {_MASKS} SELECT b.rec_id, b.start, b.stop, m.start AS b_start, m.stop AS b_stop FROM bursts b JOIN mu m ON m.rec_id = b.rec_id AND b.start < m.stop AND m.start < b.stop",
    "touch_join": f"""WITH {_EV}, {_BOUNDS}, {_BURSTS}, {_complement("free", "bursts")}
SELECT b.rec_id, b.start, b.stop, f.start AS b_start, f.stop AS b_stop FROM bursts b JOIN free f ON f.rec_id = b.rec_id AND b.start <= f.stop AND f.start <= b.stop""",
    "interval_subtract": f"""WITH {_EV}, {_BURSTS}, {_MASKS}, cut AS (SELECT b.rec_id, b.start AS s0, b.stop AS e0, b.b_n, mu.start AS ms, mu.stop AS me FROM bursts b JOIN mu ON mu.rec_id = b.rec_id AND mu.start < b.stop AND mu.stop > b.start),
edges AS (SELECT rec_id, s0, e0, b_n, s0 AS a, s0 AS z FROM cut GROUP BY ALL UNION ALL SELECT rec_id, s0, e0, b_n, greatest(ms, s0), least(me, e0) FROM cut UNION ALL SELECT rec_id, s0, e0, b_n, e0, e0 FROM cut GROUP BY ALL),
gaps AS (SELECT rec_id, b_n, z AS start, lead(a) OVER (PARTITION BY rec_id, s0 ORDER BY a, z) AS stop FROM edges)
SELECT rec_id, start, stop, b_n FROM gaps WHERE stop > start
UNION ALL SELECT b.rec_id, b.start, b.stop, b.b_n FROM bursts b WHERE b.stop > b.start AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.rec_id = b.rec_id AND cut.s0 = b.start)""",
    "clean_events": f"WITH {_EV}, {_MASKS} SELECT rec_id, t, kind FROM ev WHERE NOT EXISTS (SELECT 1 FROM mu WHERE mu.rec_id = ev.rec_id AND ev.t BETWEEN mu.start AND mu.stop)",
    "runs_above_threshold": f"""WITH {_EV}, i AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS i FROM ev), a AS (SELECT rec_id, i, i - row_number() OVER (PARTITION BY rec_id ORDER BY i) AS g FROM i WHERE v >= 20)
SELECT rec_id, min(i) AS first, max(i) AS last FROM a GROUP BY rec_id, g""",
    "local_maxima": f"WITH {_EV}, n AS (SELECT rec_id, t, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY t)) SELECT rec_id, t, v FROM n WHERE p < v AND v > q AND q > 20",
    "local_minima": f"WITH {_EV}, n AS (SELECT rec_id, t, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY t)) SELECT rec_id, t, v FROM n WHERE p > v AND v < q",
    "running_rms": f"WITH {_EV} SELECT rec_id, t, round(sqrt(sum(v * v) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8), 6) AS rms FROM ev",
    "line_length": f"WITH {_EV}, d AS (SELECT rec_id, abs(v - lag(v) OVER (PARTITION BY rec_id ORDER BY t)) AS d FROM ev) SELECT rec_id, round(coalesce(sum(d), 0), 6) AS ll FROM d GROUP BY rec_id",
    "zscore_value": f"WITH {_EV}, s AS (SELECT rec_id, t, v - avg(v) OVER w AS d, stddev_pop(v) OVER w AS sd FROM ev WINDOW w AS (PARTITION BY rec_id)) SELECT rec_id, t, round(CASE WHEN sd > 0 THEN d / sd END, 6) AS z FROM s",
    "percentile_norm": f"""WITH {_EV}, q AS (SELECT kind, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM ev GROUP BY kind)
SELECT rec_id, t, round(least(greatest((v - lo) / (hi - lo), 0), 1), 6) AS normed FROM ev JOIN q USING (kind)""",
    "amp_histogram": f"""WITH {_EV}, s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS c, floor(sqrt(count(*)) / 3)::BIGINT AS k FROM ev), b AS (SELECT least(floor((v - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, c FROM ev, s)
SELECT bin, count(*) AS n, round(count(*)::DOUBLE / any_value(c), 9) AS share FROM b GROUP BY bin""",
    "isi_hist_peak": f"""WITH {_EV}, i AS (SELECT rec_id, (t - lag(t) OVER (PARTITION BY rec_id ORDER BY t)) / 1e6 AS s FROM ev), st AS (SELECT log10(600.0::DOUBLE) AS l, (log10(1080000.0::DOUBLE) - log10(600.0::DOUBLE)) / 200 AS step),
b AS (SELECT rec_id, floor((log10(s) - l) / step) AS bin, count(*) AS n FROM i, st WHERE s >= 600 AND s < 1080000 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, bin) AS k FROM b)
SELECT rec_id, round(pow(10.0::DOUBLE, l + bin * step), 4) AS isi_peak, n FROM r, st WHERE k = 1""",
    "codebook": f"WITH {_VEC} SELECT node_id, pos - 1 AS pos, round(w, 6) AS w FROM book",
    "bmu_projection": f"WITH {_VEC} SELECT vec_id, node_id AS bmu, round(dist, 6) AS dist FROM ranked WHERE k = 1",
    "bmu_hits": f"WITH {_VEC} SELECT node_id, count(vec_id) AS n FROM (SELECT DISTINCT node_id FROM book) LEFT JOIN (SELECT vec_id, node_id FROM ranked WHERE k = 1) USING (node_id) GROUP BY node_id",
    "map_quality": f"""WITH {_VEC}, nodes AS (SELECT i AS id, i % 5 AS c, i // 5 AS r FROM range(10) t(i)),
edges AS (SELECT a.id AS x, b.id AS y FROM nodes a, nodes b WHERE (a.r = b.r AND abs(a.c - b.c) = 1) OR (a.r = 0 AND b.r = 1 AND b.c IN (a.c, a.c - 1)) OR (a.r = 1 AND b.r = 0 AND b.c IN (a.c, a.c + 1))),
two AS (SELECT a.vec_id, a.node_id AS x, b.node_id AS y, a.dist FROM ranked a JOIN ranked b ON a.vec_id = b.vec_id AND a.k = 1 AND b.k = 2)
SELECT count(*) AS n, round(avg(dist), 6) AS quantisation_error, round(avg(CASE WHEN e.x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS topological_error FROM two LEFT JOIN edges e USING (x, y)""",
    "category_rates": f"""WITH {_EV}, {_BOUNDS}, {_MASKS}, {_duration(0)}, c AS (SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM mu WHERE mu.rec_id = ev.rec_id AND ev.t BETWEEN mu.start AND mu.stop))
SELECT rec_id, kind, count(*) AS n, round(count(*) / (nullif(dur, 0) / 1e6), 9) AS rate FROM c JOIN analysed USING (rec_id) GROUP BY rec_id, kind, dur""",
    "category_tfracs": f"""WITH {_EV}, {_BOUNDS}, {_MASKS}, {_BURSTS}, {_duration(0)}, b AS (SELECT *, CASE WHEN b_n >= 5 THEN 'high-load' ELSE 'low-load' END AS cname FROM bursts)
SELECT rec_id, cname, count(*) AS n, round(sum(stop - start)::DOUBLE / nullif(dur, 0), 9) AS tfrac FROM b JOIN analysed USING (rec_id) GROUP BY rec_id, cname, dur""",
    "diagnostics": f"""WITH {_EV}, {_BOUNDS}, {_MASKS}, {_BURSTS}, {_duration(0)},
i AS (SELECT rec_id, (t - lag(t) OVER (PARTITION BY rec_id ORDER BY t)) / 1e6 AS isi FROM ev), e AS (SELECT rec_id, count(*) AS n_events, (stddev_pop(isi) - avg(isi)) / nullif(stddev_pop(isi) + avg(isi), 0) AS burstiness FROM i GROUP BY rec_id),
b AS (SELECT rec_id, count(*) AS n_bursts, sum(stop - start) AS d FROM bursts GROUP BY rec_id)
SELECT rec_id, n_events, coalesce(n_bursts, 0) AS n_bursts, round(n_events / (nullif(dur, 0) / 1e6), 9) AS rate, round(coalesce(d, 0)::DOUBLE / nullif(dur, 0), 9) AS tfrac_bursts, round(burstiness, 9) AS burstiness
FROM e JOIN analysed USING (rec_id) LEFT JOIN b USING (rec_id)""",
    "state_runs": f"""WITH {_EV}, a AS (SELECT rec_id, t, kind, CASE WHEN kind = lag(kind) OVER (PARTITION BY rec_id ORDER BY t) THEN 0 ELSE 1 END AS brk FROM ev), b AS (SELECT *, sum(brk) OVER (PARTITION BY rec_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT rec_id, kind, min(t) AS start, max(t) AS stop, count(*) AS n FROM b GROUP BY rec_id, kind, g""",
    "state_coverage": f"WITH {_EV} SELECT rec_id, max(t) > min(t) AS covered FROM ev GROUP BY rec_id",
    "tolerance_match": f"""WITH {_EV}, f AS (SELECT rec_id, t FROM ev WHERE kind = 'click'), g AS (SELECT rec_id, t FROM ev WHERE kind = 'error'),
a AS (SELECT rec_id, EXISTS (SELECT 1 FROM g WHERE g.rec_id = f.rec_id AND abs(g.t - f.t) < {8 * HOUR}) AS hit FROM f), b AS (SELECT rec_id, EXISTS (SELECT 1 FROM f WHERE g.rec_id = f.rec_id AND abs(g.t - f.t) < {8 * HOUR}) AS hit FROM g),
x AS (SELECT rec_id, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM a GROUP BY rec_id), y AS (SELECT rec_id, count(*) FILTER (NOT hit) AS fn FROM b GROUP BY rec_id)
SELECT rec_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM x FULL JOIN y USING (rec_id)""",
    "nearest_event": f"""WITH {_EV}, f AS (SELECT rec_id, t FROM ev WHERE kind = 'click'), g AS (SELECT rec_id, t FROM ev WHERE kind = 'error'),
r AS (SELECT f.rec_id, f.t, g.t AS b_t, row_number() OVER (PARTITION BY f.rec_id, f.t ORDER BY abs(g.t - f.t), g.t) AS k FROM f LEFT JOIN g USING (rec_id)) SELECT rec_id, t, b_t, b_t - t AS dt FROM r WHERE k = 1""",
    "next_event": f"WITH {_EV} SELECT f.rec_id, f.t, min(g.t) AS next_t FROM ev f LEFT JOIN ev g ON g.rec_id = f.rec_id AND g.t > f.t AND g.kind = 'error' WHERE f.kind = 'click' GROUP BY f.rec_id, f.t",
    "doublets": f"""WITH {_EV}, a AS (SELECT rec_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) < {DEAD} THEN 0 ELSE 1 END AS brk FROM ev)
SELECT rec_id, count(*) - sum(brk)::BIGINT AS n_doublets FROM a GROUP BY rec_id""",
    "threshold_counts": f"""WITH {_EV}, n AS (SELECT rec_id, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY t)), m AS (SELECT rec_id, v FROM n WHERE p < v AND v > q)
SELECT rec_id, (10 * i)::DOUBLE AS threshold, count(*) FILTER (v > 10 * i) AS n FROM m, range(10) t(i) GROUP BY rec_id, i""",
    "burst_isi": f"""WITH {_EV}, {_BOUNDS}, {_MASKS}, {_complement("free", "mu")}, i AS (SELECT f.rec_id, t - lag(t) OVER (PARTITION BY f.rec_id, f.start ORDER BY t) AS isi FROM free f JOIN ev ON ev.rec_id = f.rec_id AND t BETWEEN f.start AND f.stop)
SELECT rec_id, count(*) AS n, sum(isi)::BIGINT AS sum_isi FROM i WHERE isi IS NOT NULL GROUP BY rec_id""",
    "insert_predators": f"""WITH {_EV}, {_MASKS}, a AS (SELECT rec_id, t, kind, CASE WHEN kind = lag(kind) OVER (PARTITION BY rec_id ORDER BY t) THEN 0 ELSE 1 END AS brk FROM ev), b AS (SELECT *, sum(brk) OVER (PARTITION BY rec_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM a),
runs AS (SELECT rec_id, kind AS state, min(t) AS start, max(t) AS stop FROM b GROUP BY rec_id, kind, g HAVING max(t) > min(t)), cut AS (SELECT r.rec_id, r.start AS s0, r.stop AS e0, r.state, mu.start AS ms, mu.stop AS me FROM runs r JOIN mu ON mu.rec_id = r.rec_id AND mu.start < r.stop AND mu.stop > r.start),
edges AS (SELECT rec_id, s0, e0, state, s0 AS a, s0 AS z FROM cut GROUP BY ALL UNION ALL SELECT rec_id, s0, e0, state, greatest(ms, s0), least(me, e0) FROM cut UNION ALL SELECT rec_id, s0, e0, state, e0, e0 FROM cut GROUP BY ALL),
gaps AS (SELECT rec_id, state, z AS start, lead(a) OVER (PARTITION BY rec_id, s0 ORDER BY a, z) AS stop FROM edges)
SELECT rec_id, start, stop, state FROM gaps WHERE stop > start
UNION ALL SELECT rec_id, start, stop, state FROM runs r WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.rec_id = r.rec_id AND cut.s0 = r.start)
UNION ALL SELECT rec_id, start, stop, 'art' FROM mu WHERE stop - start > {10 * HOUR}""",
    "severe_periods": f"""WITH {_EV}, {_BOUNDS}, {_BURSTS}, severe AS (SELECT rec_id, start, stop FROM bursts WHERE b_n >= 5), {_union("ip", "severe", STATES.severe_gap, ">=")}, {_complement("rest", "ip")}
SELECT rec_id, start, stop, 'IP' AS state FROM ip UNION ALL SELECT rec_id, start, stop, 'temp' FROM rest""",
    "chosen_threshold": f"""WITH {_EV}, n AS (SELECT rec_id, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY t)), m AS (SELECT rec_id, v FROM n WHERE p < v AND v > q),
c AS (SELECT rec_id, (10 * i)::DOUBLE AS threshold, count(*) FILTER (v > 10 * i) AS n FROM m, range(10) t(i) GROUP BY rec_id, i), e AS (SELECT *, min(n) OVER r AS lo, max(n) OVER r AS hi FROM c WINDOW r AS (PARTITION BY rec_id)),
d AS (SELECT rec_id, threshold, lead(n) OVER (PARTITION BY rec_id ORDER BY threshold) - n AS d FROM e WHERE n > lo AND n < hi),
s AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY d DESC) AS place, ceil(count(*) OVER (PARTITION BY rec_id) * 35.0 / 100) AS last FROM d WHERE d IS NOT NULL),
x AS (SELECT *, min(CASE WHEN place <= last THEN d END) OVER (PARTITION BY rec_id) AS cut FROM s) SELECT rec_id, min(threshold) AS threshold FROM x WHERE d >= cut GROUP BY rec_id""",
    "amplitude_events": f"""WITH {_EV}, er AS (SELECT rec_id, t FROM ev WHERE kind = 'error'),
p AS (SELECT ev.rec_id, ev.t, ev.v, (SELECT max(er.t) FROM er WHERE er.rec_id = ev.rec_id AND er.t <= ev.t) AS b, (SELECT min(er.t) FROM er WHERE er.rec_id = ev.rec_id AND er.t >= ev.t) AS a FROM ev),
f AS (SELECT * FROM p WHERE (a IS NULL AND b IS NULL) OR (t - b > {MARGIN} AND a - t > {MARGIN})),
z AS (SELECT *, (v - avg(v) OVER r) / nullif(stddev_pop(v) OVER r, 0) AS z, CASE WHEN b IS NOT DISTINCT FROM lag(b) OVER w THEN coalesce(t - lag(t) OVER w, 0) ELSE 0 END AS spent FROM f WINDOW r AS (PARTITION BY rec_id), w AS (PARTITION BY rec_id ORDER BY t)),
k AS (SELECT *, sum(spent) OVER (PARTITION BY rec_id ORDER BY t) AS clock FROM z), h AS (SELECT rec_id, t, clock - lag(clock) OVER (PARTITION BY rec_id ORDER BY t) AS gap FROM k WHERE z > 1.5)
SELECT rec_id, t FROM h WHERE gap IS NULL OR gap > {DEAD}""",
    "centered": f"""WITH {_EV}, i AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS i, v - avg(v) OVER (PARTITION BY rec_id) AS x FROM ev),
u AS (SELECT rec_id, CASE WHEN abs(min(x)) > 10 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS unit FROM i GROUP BY rec_id) SELECT rec_id, i, round(x / unit, 9) AS v FROM i JOIN u USING (rec_id)""",
    "window_plan": f"""WITH {_EV}, n AS (SELECT rec_id, count(*) AS n FROM ev GROUP BY rec_id), s AS (SELECT rec_id, n, unnest(range(0, greatest(n - 16, 0) + 1, 12)) AS start FROM n UNION SELECT rec_id, n, greatest(n - 16, 0) FROM n)
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start) - 1 AS window_id, start, least(start + 16, n) AS stop FROM s""",
    "node_distances": f"""WITH {_VEC}, nodes AS (SELECT i AS id, i % 5 AS c, i // 5 AS r FROM range(10) t(i)),
edges AS (SELECT a.id AS x, b.id AS y FROM nodes a, nodes b WHERE (a.r = b.r AND abs(a.c - b.c) = 1) OR (a.r = 0 AND b.r = 1 AND b.c IN (a.c, a.c - 1)) OR (a.r = 1 AND b.r = 0 AND b.c IN (a.c, a.c + 1))),
d AS (SELECT x, y, sqrt(sum((a.w - b.w) * (a.w - b.w))) AS d FROM edges JOIN book a ON a.node_id = x JOIN book b ON b.node_id = y AND b.pos = a.pos GROUP BY x, y) SELECT x::INTEGER AS node_id, round(avg(d), 6) AS d FROM d GROUP BY x""",
    "node_severity": f"""WITH {_VEC}, d AS (SELECT a.node_id, sqrt(sum((a.w - b.w) * (a.w - b.w))) AS d FROM book a JOIN book b ON b.pos = a.pos AND b.node_id = 0 GROUP BY a.node_id)
SELECT node_id, round(1 - d / (SELECT max(d) FROM d), 6) AS si FROM d""",
}
ORACLES["diagnostics_documents"] = f"SELECT rec_id, n_events, round(rate, 9) AS rate, n_bursts, round(tfrac_bursts, 9) AS tfrac FROM ({ORACLES['diagnostics']})"
ORACLES |= {new: ORACLES[old] for new, old in (("chunked_stretches", "loud_stretches"), ("chunked_saturation", "saturation_points"), ("chunked_masks", "suggested_masks"), ("signal_runs", "runs_above_threshold"))}
