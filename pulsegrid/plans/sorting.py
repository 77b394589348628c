"""Events told apart by waveform: aligned snippets, principal components, clusters by a mixture of Gaussians, noise and doublets.

Models are fitted on the sparse events of all recordings together, or, with `each`, for every recording by itself, all at once.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import events as E
from pulsegrid.operators import mixtures as X
from pulsegrid.operators import signal as G
from pulsegrid.operators.intervals import REC
from pulsegrid.operators.maps import mean_vectors
from pulsegrid.sources.scratch import kept


def snippets(chunks: DataFrame, events: DataFrame, length: int, search: int, before: int, after: int) -> DataFrame:
    """(rec_id, i, center, v): for each event at sample i the `before` samples ahead of the minimum within +-search, and `after` from it on.

    Chunks have `length` samples. The events of a chunk meet it once, as a list, and are cut from it and its halo. Near a
    recording's border, where the cut is not whole, center and v are null.
    """
    halo = search + max(before, after)
    lists = events.groupBy(REC, F.expr(f"i div {length}").alias("chunk_id")).agg(F.sort_array(F.collect_set("i")).alias("_is"))
    whole = G.with_halo(chunks, halo, halo).select(REC, "chunk_id", (F.col("i0") - F.size("left")).alias("_from"), F.concat("left", "v", "right").alias("_x"))

    def cut(i: Column) -> Column:
        place = i - F.col("_from") + 1
        low = F.greatest(place - search, F.lit(1))
        around = F.slice("_x", low.cast("int"), (place + search - low + 1).cast("int"))
        return F.struct(i.alias("i"), (low + F.array_position(around, F.array_min(around)) - 1).alias("c"))

    met = whole.join(lists, [REC, "chunk_id"]).select(REC, "_from", "_x", F.explode(F.transform("_is", cut)).alias("_e"))
    fits = (F.col("_e.c") - before >= 1) & (F.col("_e.c") + after - 1 <= F.size("_x"))
    v = F.when(fits, F.slice("_x", F.greatest(F.col("_e.c") - before, F.lit(1)).cast("int"), F.lit(before + after)))
    return met.select(REC, F.col("_e.i").alias("i"), F.when(fits, F.col("_e.c") + F.col("_from") - 1).alias("center"), v.alias("v"))


def fit_clusters(snips: DataFrame, components: int = 3, clusters: int = 5, seed: int = 1) -> tuple[PipelineModel, DataFrame]:
    """(model, order): model of snippets, and (cluster, label) with labels from 1 by falling height of the clusters' mean waveforms."""
    known = snips.where("v IS NOT NULL").withColumn("_x", array_to_vector("v"))
    stages = [
        StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="_z"),
        PCA(k=components, inputCol="_z", outputCol="_pc"),
        StandardScaler(withMean=False, withStd=True, inputCol="_pc", outputCol="_score"),
        GaussianMixture(k=clusters, seed=seed, featuresCol="_score", predictionCol="cluster", probabilityCol="_p"),
    ]
    model = Pipeline(stages=stages).fit(known)
    heights = mean_vectors(model.transform(known).select("cluster", "v"), "cluster").select(F.col("node_id").alias("cluster"), (F.array_max("w") - F.array_min("w")).alias("_h"))
    few = heights.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("_h")).alias("h"), "cluster"))).alias("_all"))  # one row a cluster
    return model, few.select(F.posexplode("_all").alias("_k", "_c")).select("_c.cluster", (F.col("_k") + 1).alias("label"))


def label(snips: DataFrame, model: PipelineModel, order: DataFrame) -> DataFrame:
    """snips with label; border snippets have none."""
    placed = model.transform(snips.where("v IS NOT NULL").withColumn("_x", array_to_vector("v"))).select(*snips.columns, "cluster")
    named = placed.join(F.broadcast(order), "cluster").select(*snips.columns, "label")
    return named.unionByName(snips.where("v IS NULL").withColumn("label", F.lit(None).cast("int")))


def sort_events(
    snips: DataFrame, limits: dict, noise: tuple[int, ...] = (5,), doublet: int = 45, components: int = 3, clusters: int = 5, seed: int = 1, rounds: int = 3, each: bool = False
) -> DataFrame:
    """(rec_id, i, center, label, is_noise, is_doublet, is_clean) of all events of snips.

    limits are the arguments of sparse_events, in samples. In each round the model learns from events that are sparse once the noise
    found so far is left out; rounds end when noise (the last cluster) no longer grows. Events that are not sparse are projected by
    the model but never judged as noise. Doublets are told by their centres; border events join none. With `each` a recording has a
    model of its own (operators.mixtures); one with fewer different events than clusters has fewer clusters.
    """
    points = snips.select(REC, F.col("i").alias("t"))
    removed, last = points.limit(0), 0
    for _ in range(rounds):
        rest = points.join(removed, [REC, "t"], "left_anti")
        sparse = E.sparse_events(rest, **limits).unionByName(removed).withColumnRenamed("t", "i")
        few = snips.join(sparse, [REC, "i"], "left_semi")
        if each:
            named = X.by_height(X.clusters(snips, X.fit(few, [(components, clusters)], seed=seed))).drop("cluster")
        else:
            named = label(snips, *fit_clusters(few, components, clusters, seed))
        told = named.join(sparse.withColumn("_sparse", F.lit(True)), [REC, "i"], "left").select(REC, "i", "center", "label", "_sparse")
        labelled = kept(told, "labelled")  # the next round asks for it several times
        removed = labelled.where((F.col("label") == clusters) & F.col("_sparse")).select(REC, F.col("i").alias("t"))
        if (n := removed.count()) <= last:
            break
        last = n
    judged = labelled.withColumn("is_noise", F.coalesce(F.col("label").isin(*noise) & F.col("_sparse"), F.lit(False)))
    twice = E.doublets(judged.where("center IS NOT NULL").select(REC, F.col("center").alias("t")).distinct(), doublet)
    same = F.row_number().over(Window.partitionBy(REC, "center").orderBy("i")) > 1
    out = judged.join(twice.withColumnRenamed("t", "center"), [REC, "center"], "left")
    out = out.withColumn("is_doublet", F.coalesce(F.col("is_doublet"), F.lit(False)) | (F.col("center").isNotNull() & same))
    return out.select(REC, "i", "center", "label", "is_noise", "is_doublet", (~F.col("is_noise") & ~F.col("is_doublet")).alias("is_clean"))
