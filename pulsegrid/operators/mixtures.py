"""Principal components and Gaussian mixtures of all recordings at once, over a grid of component and cluster numbers.

Nothing is fitted on the driver and no recording is gathered. Waveforms give each task one sum of moments a recording; sums are
merged in a stream by recording, where the axes are found. Scores are kept in blocks. In each round of the mixtures every block
gives its sufficient statistics under its recording's current models, these are merged in a stream by model, and models whose
likelihood has settled drop out. A recording of one block needs no rounds: the same steps are repeated on the block in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.intervals import REC
from pulsegrid.sources.scratch import kept

#: Rows of a block of scores, rows at most that starting points are chosen from, and sums of moments that a task holds.
BLOCK, SEEDS, OPEN = 4096, 512, 64
RIDGE = 1e-6
MODEL = "clusters int, components int, w array<double>, mu array<double>, cov array<double>, mean_ll double, round int, done boolean"


@dataclass
class Fits:
    """axes (rec_id, n, bias, axes) give scores; models (rec_id, components, clusters, ..., n, loglik, bic) the mixtures of the whole grid."""

    axes: DataFrame
    models: DataFrame


def merge_moments(a: tuple, b: tuple) -> tuple:
    """(n, mean, sum of outer products about the mean) of two sets of rows together; no large numbers are subtracted."""
    (na, ma, sa), (nb, mb, sb) = a, b
    step, n = mb - ma, na + nb
    return n, ma + step * (nb / n), sa + sb + np.outer(step, step) * (na * nb / n)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _moments(rows: DataFrame) -> DataFrame:
    """(rec_id, part, n, mean, products): moments of v by recording and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, open_, made = TaskContext.get().partitionId() << 32, {}, 0

        def out() -> pa.RecordBatch:
            nonlocal made
            names = list(open_)
            made += len(names)
            cols = [pa.array(names, kind), pa.array(range(part + made - len(names), part + made), pa.int64()), pa.array([open_[r][0] for r in names], pa.int64())]
            cols += [pa.array([open_[r][k].tobytes() for r in names], pa.binary()) for k in (1, 2)]
            return pa.RecordBatch.from_arrays(cols, [REC, "part", "n", "mean", "products"])

        for batch in batches:
            kind = batch.schema.field(0).type
            recs = batch.column(0).dictionary_encode()
            x, code = _vectors(batch.column(1)), recs.indices.to_numpy(zero_copy_only=False)
            for k, rec in enumerate(recs.dictionary.to_pylist()):
                own = x[code == k]
                mean = own.mean(axis=0)
                now = (len(own), mean, (own - mean).T @ (own - mean))
                open_[rec] = merge_moments(open_[rec], now) if rec in open_ else now
                if len(open_) >= OPEN:
                    yield out()
                    open_.clear()
        if open_:
            yield out()

    return rows.select(REC, "v").mapInArrow(run, f"{REC} {rows.schema[REC].dataType.simpleString()}, part long, n long, mean binary, products binary")


def principal_axes(snips: DataFrame, components: int) -> DataFrame:
    """(rec_id, n, bias, axes) of every recording of snips (rec_id, v): a score is the product of v with an axis, less its bias.

    Waveforms are standardised point by point, axes are those of the largest variance, and scores have mean 0 and deviation 1. An
    axis points to where its largest weight is positive; axes without variance give scores of 0. Null waveforms are left out.
    """
    rows = snips.where(F.col("v").isNotNull() & F.col(REC).isNotNull())
    kind = snips.schema[REC].dataType.simpleString()

    def finish(rec, n: int, mean: np.ndarray, products: np.ndarray) -> tuple:
        sd = np.sqrt(np.diag(products) / max(n - 1, 1))
        inverse = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
        values, vectors = np.linalg.eigh(products / max(n - 1, 1) * np.outer(inverse, inverse))
        best = vectors[:, ::-1][:, :components].T
        best = best * np.sign(best[np.arange(len(best)), np.abs(best).argmax(axis=1)])[:, None]
        width = np.sqrt(np.maximum(values[::-1][:components], 0))
        scaled = best * inverse * np.divide(1.0, width, out=np.zeros_like(width), where=width > 1e-9)[:, None]
        return rec, n, (scaled @ mean).tolist(), scaled.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, out, type_ = None, None, [], None

        def flush() -> pa.RecordBatch:
            rec, n, bias, axes = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(rec, type_), pa.array(n, pa.int64()), pa.array(bias, pa.list_(pa.float64())), pa.array(axes, pa.list_(pa.list_(pa.float64())))], [REC, "n", "bias", "axes"])

        for batch in batches:
            type_ = batch.schema.field(0).type
            for rec, n, mean, products in zip(*(batch.column(c).to_pylist() for c in (REC, "n", "mean", "products")), strict=True):
                mean = np.frombuffer(mean)
                now = (n, mean, np.frombuffer(products).reshape(len(mean), -1))
                if own is not None and own[0] == rec:
                    total = merge_moments(total, now)
                    continue
                if own is not None:
                    out.append(finish(own[0], *total))
                own, total = (rec,), now
            if len(out) >= 256:
                yield flush()
                out = []
        if own is not None:
            out.append(finish(own[0], *total))
        if out:
            yield flush()

    dealt = _moments(rows).repartition(REC).sortWithinPartitions(REC, "part")
    return dealt.mapInArrow(run, f"{REC} {kind}, n long, bias array<double>, axes array<array<double>>")


def scores(snips: DataFrame, axes: DataFrame) -> DataFrame:
    """snips with s, the scores of v on the axes of its recording; rows without a waveform or axes are left out."""
    met = snips.where("v IS NOT NULL").join(axes.select(F.col(REC).alias("_rec"), F.col("n").alias("_n"), "bias", "axes"), F.col(REC) == F.col("_rec"))
    dot = lambda a: F.aggregate(F.zip_with(a, "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return met.withColumn("s", F.zip_with(F.transform("axes", dot), "bias", lambda x, b: x - b)).drop("_rec", "bias", "axes")


def log_density(x: np.ndarray, w: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """(rows, clusters): logarithm of weight times density."""
    out = np.empty((len(x), len(w)))
    for k in range(len(w)):
        root = np.linalg.cholesky(cov[k])
        y = np.linalg.solve(root, (x - mu[k]).T)
        out[:, k] = np.log(max(w[k], 1e-300)) - 0.5 * (y * y).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def statistics(x: np.ndarray, model: tuple) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """What a set of rows adds: log-likelihood, and each cluster's share of rows, of their sum and of their outer products."""
    joint = log_density(x, *model)
    top = joint.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
    r = np.exp(joint - total[:, None])
    return float(total.sum()), r.sum(axis=0), r.T @ x, np.einsum("nk,ni,nj->kij", r, x, x)


def maximised(n: int, share: np.ndarray, sums: np.ndarray, products: np.ndarray, old: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of the greatest expected likelihood; a cluster without rows stays where it was."""
    full = share > 1e-8
    by = np.where(full, share, 1.0)
    mu = np.where(full[:, None], sums / by[:, None], old[1])
    cov = products / by[:, None, None] - np.einsum("ki,kj->kij", mu, mu)
    cov = np.where(full[:, None, None], cov, old[2]) + RIDGE * np.eye(sums.shape[1])
    return share / n, mu, cov


def starting(x: np.ndarray, clusters: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A model to start from: well-spread rows of x as centres, moved by a few steps of means, and the spread around them."""
    rng, points = np.random.default_rng([seed, clusters, x.shape[1]]), np.unique(x, axis=0)
    centres = [points[rng.integers(len(points))]]
    while len(centres) < min(clusters, len(points)):
        far = ((points[:, None] - np.array(centres)) ** 2).sum(axis=2).min(axis=1)
        centres.append(points[min(int(np.searchsorted(np.cumsum(far), rng.random() * far.sum())), len(points) - 1)])
    mu = np.array(centres)
    for _ in range(10):
        near = ((x[:, None] - mu) ** 2).sum(axis=2).argmin(axis=1)
        mu = np.array([x[near == k].mean(axis=0) if (near == k).any() else mu[k] for k in range(len(mu))])
    near = ((x[:, None] - mu) ** 2).sum(axis=2).argmin(axis=1)
    around = x - mu[near]
    cov = around.T @ around / len(x) + 1e-3 * np.eye(x.shape[1])
    return np.bincount(near, minlength=len(mu)) / len(x), mu, np.repeat(cov[None], len(mu), axis=0)


def _flat(model: tuple) -> list:
    return [np.asarray(p).ravel().tolist() for p in model]


def _model(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, c = np.array(row["w"]), row["components"]
    return w, np.array(row["mu"]).reshape(len(w), c), np.array(row["cov"]).reshape(len(w), c, c)


def _types(kind: pa.DataType) -> pa.Schema:
    d = pa.list_(pa.float64())
    return pa.schema([(REC, kind), ("clusters", pa.int32()), ("components", pa.int32()), ("w", d), ("mu", d), ("cov", d), ("mean_ll", pa.float64()), ("round", pa.int32()), ("done", pa.bool_())])


def fit(snips: DataFrame, grid: list[tuple[int, int]], *, rounds: int = 100, settled: float = 1e-5, seed: int = 1, block: int = BLOCK) -> Fits:
    """Axes and mixtures of each recording of snips (rec_id, i, v) for every (components, clusters) of the grid.

    A mixture is settled when its mean log-likelihood gains less than `settled`, or after `rounds`. Starting points come from at
    most SEEDS rows of a recording, those of the smallest hash of i (a documented bound); the mixture itself from all rows. With
    fewer different rows than clusters there are as many clusters as rows. Recordings are independent: each gets what it would get
    alone. Waveforms of one recording have one length. Rows of a null recording or waveform are left out.
    """
    kind, most = snips.schema[REC].dataType.simpleString(), max(c for c, _ in grid)
    axes = kept(principal_axes(snips, most), "axes")
    placed = scores(snips, axes).select(REC, "i", "s", F.xxhash64("i").alias("h"), F.ceil(F.col("_n") / block).cast("long").alias("blocks"))
    cells = placed.groupBy(REC, "blocks", F.pmod("h", F.col("blocks")).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("h", "i", "s"))).alias("rows"))
    blocks = kept(cells, "blocks")
    share = F.lit(2.0**64) * (1.5 * SEEDS + 64)
    each = blocks.select(REC, "blocks", F.explode("rows").alias("r")).where((F.col("blocks") == 1) | (F.col("r.h").cast("double") + 2.0**63 < share / (F.col("blocks") * block)))
    seeds = each.groupBy(REC).agg(F.slice(F.sort_array(F.collect_list("r")), 1, SEEDS).alias("seeds"))
    alone = blocks.where("blocks = 1").select(F.col(REC).alias("_rec"), "rows")
    first = seeds.join(alone, F.col(REC) == F.col("_rec"), "left").select(REC, F.transform("seeds", lambda r: r.s).alias("seeds"), F.transform("rows", lambda r: r.s).alias("rows"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec, some, whole in zip(*(batch.column(c).to_pylist() for c in (REC, "seeds", "rows")), strict=True):
                few, x = np.array(some, float), None if whole is None else np.array(whole, float)
                for c, k in grid:
                    model, last, at, done = starting(few[:, :c], k, seed), None, 0, False
                    while x is not None and not done and at < rounds:
                        ll, *sums = statistics(x[:, :c], model)
                        done = last is not None and ll / len(x) - last < settled
                        last, at = ll / len(x), at + 1
                        if not done:
                            model = maximised(len(x), *sums, model)
                    out.append(dict(zip(_types(batch.schema.field(0).type).names, [rec, k, c, *_flat(model), last, at, x is not None], strict=True)))
            yield pa.RecordBatch.from_pylist(out, _types(batch.schema.field(0).type))

    models = kept(first.mapInArrow(start, f"{REC} {kind}, {MODEL}"), "models")
    finished, at = models.where("done"), 0
    models = models.where("NOT done")
    while at < rounds and models.limit(1).count():
        models, at = kept(_round(blocks, models, kind, settled, at + 1 == rounds), "models"), at + 1
        finished, models = finished.unionByName(models.where("done")), models.where("NOT done")
    n = axes.select(F.col(REC).alias("_rec"), "n")
    k = F.size("w")
    parameters = k * (1 + F.col("components") + F.col("components") * (F.col("components") + 1) / 2) - 1
    whole = finished.join(n, F.col(REC) == F.col("_rec")).drop("_rec").withColumn("loglik", F.col("mean_ll") * F.col("n"))
    return Fits(axes, whole.withColumn("bic", parameters * F.log(F.col("n")) - 2 * F.col("loglik")))


def _round(blocks: DataFrame, models: DataFrame, kind: str, settled: float, last: bool) -> DataFrame:
    """The models after one more step, done where the likelihood has settled (or with `last` all)."""
    named = models.withColumnRenamed(REC, "_rec")
    met = blocks.join(named, F.col(REC) == F.col("_rec")).select(REC, "cell", *models.drop(REC).columns, F.transform("rows", lambda r: r.s).alias("x"))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*_types(batch.schema.field(0).type), ("cell", pa.int64()), ("n", pa.int64()), ("ll", pa.float64()), *((s, pa.list_(pa.float64())) for s in ("share", "sums", "products"))])
            out = []
            for row in batch.to_pylist():
                x = np.array(row.pop("x"), float)[:, : row["components"]]
                ll, *sums = statistics(x, _model(row))
                out.append(row | {"n": len(x), "ll": ll} | dict(zip(("share", "sums", "products"), _flat(sums), strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, type_, out = None, None, None, []

        def done() -> None:
            n, ll, sums = total
            row, c = own, own["components"]
            k = len(row["w"])
            stop = row["mean_ll"] is not None and ll / n - row["mean_ll"] < settled
            old = _model(row)
            new = old if stop else maximised(n, sums[0], sums[1].reshape(k, c), sums[2].reshape(k, c, c), old)
            out.append({f: row[f] for f in (REC, "clusters", "components")} | dict(zip(("w", "mu", "cov"), _flat(new), strict=True)) | {"mean_ll": ll / n, "round": row["round"] + 1, "done": stop or last})

        for batch in batches:
            type_ = batch.schema.field(0).type
            for row in batch.to_pylist():
                now = (row["n"], row["ll"], [np.array(row[s]) for s in ("share", "sums", "products")])
                if own is not None and all(own[f] == row[f] for f in (REC, "components", "clusters")):
                    total = total[0] + now[0], total[1] + now[1], [a + b for a, b in zip(total[2], now[2], strict=True)]
                    continue
                if own is not None:
                    done()
                own, total = row, now
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, _types(type_))
                out = []
        if own is not None:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, _types(type_))

    parts = met.mapInArrow(expect, f"{REC} {kind}, {MODEL}, cell long, n long, ll double, share array<double>, sums array<double>, products array<double>")
    return parts.repartition(REC, "components", "clusters").sortWithinPartitions(REC, "components", "clusters", "cell").mapInArrow(step, f"{REC} {kind}, {MODEL}")


def best(fits: Fits) -> DataFrame:
    """Of each recording's models the one of the least BIC (ties: fewer components, then clusters)."""
    order = Window.partitionBy(REC).orderBy("bic", "components", "clusters")
    return fits.models.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def clusters(snips: DataFrame, fits: Fits, chosen: DataFrame | None = None) -> DataFrame:
    """snips (rec_id, i, v) with cluster, the likeliest of the recording's model in `chosen` (one a recording; default: best()); null without waveform."""
    models = (best(fits) if chosen is None else chosen).select(F.col(REC).alias("_of"), "components", "w", "mu", "cov")
    met = scores(snips, fits.axes).join(models, F.col(REC) == F.col("_of")).select(REC, "i", "s", "components", "w", "mu", "cov")
    kind, place = snips.schema[REC].dataType.simpleString(), snips.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs = batch.column(0).dictionary_encode()
            code, found = recs.indices.to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int32)
            x = _vectors(batch.column(2)) if batch.num_rows else np.zeros((0, 0))
            for k in np.unique(code):
                own = np.flatnonzero(code == k)
                row = batch.slice(int(own[0]), 1).select(["components", "w", "mu", "cov"]).to_pylist()[0]
                found[own] = log_density(x[own][:, : row["components"]], *_model(row)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], [REC, "i", "cluster"])

    told = met.mapInArrow(run, f"{REC} {kind}, i {place}, cluster int").select(F.col(REC).alias("_rec"), F.col("i").alias("_i"), "cluster").distinct()
    return snips.join(told, (F.col(REC) == F.col("_rec")) & (F.col("i") == F.col("_i")) & F.col("v").isNotNull(), "left").drop("_rec", "_i")


def by_height(clustered: DataFrame, height: Column | None = None) -> DataFrame:
    """clustered (rec_id, v, cluster, ...) with label: clusters of a recording from 1 by falling height of their mean waveform (ties: the smaller number)."""
    known = clustered.where("cluster IS NOT NULL")
    points = known.select(REC, "cluster", F.posexplode("v").alias("p", "x")).groupBy(REC, "cluster", "p").agg(F.avg("x").alias("x"))
    heights = points.groupBy(REC, "cluster").agg((F.max("x") - F.min("x")).alias("h") if height is None else height.alias("h"))
    named = heights.select(F.col(REC).alias("_rec"), F.col("cluster").alias("_cluster"), F.row_number().over(Window.partitionBy(REC).orderBy(F.desc("h"), "cluster")).alias("label"))
    return clustered.join(named, (F.col(REC) == F.col("_rec")) & (F.col("cluster") == F.col("_cluster")), "left").drop("_rec", "_cluster")
