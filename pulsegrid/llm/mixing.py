"""Mixing sources to target weights by cube-method balanced sampling.

Each document is to be taken target / size of its source times, at most twice. The whole part of that is certain; the
fraction is an inclusion probability. The flight phase moves the probabilities of three documents at a time along the
null space of the two balancing constraints (tokens and documents) until one of them is 0 or 1, so both totals stay as
they are. It runs in blocks of a bounded number of documents; the at most two that each block leaves form the next
level's blocks, until one block per source is left, whose last two documents are the landing problem.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import settle, small

WEIGHTS, FACTOR, CAP, BLOCK = (5.0, 2.0, 1.0), 1.5, 2.0, 2048
#: Tables of sources with at most this many rows are broadcast; larger ones are joined as Spark sees fit.
FEW = 100_000
EPS = 1e-9


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ordered(sources: DataFrame) -> DataFrame:
    """sources with `place`, from 0: their order by code point, null last. Sorted by ranges; only the ranges' sizes reach the driver."""
    rows = sources.orderBy(F.asc_nulls_last("source")).withColumn("_id", F.monotonically_increasing_id())
    rows = settle(rows, "ordered")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    first, at = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):  # a row for each partition
        first.append((r["part"], at))
        at += r["count"]
    starts = sources.sparkSession.createDataFrame(first, "_part long, _first long")
    return rows.join(F.broadcast(starts), part == F.col("_part")).withColumn("place", F.col("_first") + within).drop("_id", "_part", "_first")


def targets(sources: DataFrame, weights: Iterable[float] = WEIGHTS, factor: float = FACTOR, cap: float = CAP) -> DataFrame:
    """sources (source, words) with `target`, the words that each is to give. Sources by code point, null last, have the weights in turn.

    What lies above a source's cap is shared anew by weight: the share of a unit of weight rises until no more sources are
    at their cap. Only sums over the sources reach the driver.
    """
    weights = [float(w) for w in weights]
    placed = settle(ordered(sources).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))), "weighted")
    total = placed.agg(F.sum("words")).first()[0] or 0
    each, capped = 0.0, -1
    while True:
        over = F.col("_w") * each > F.col("words") * cap if capped >= 0 else F.lit(False)
        held, n, *classes = placed.agg(F.sum(F.when(over, F.col("words"))), F.count_if(over), *(F.count_if(~over & (F.col("_w") == w)) for w in sorted(set(weights)))).first()
        weight = sum(w * k for w, k in zip(sorted(set(weights)), classes, strict=True))
        if n == capped or not weight:
            break
        capped, each = n, max(0.0, factor * total - cap * (held or 0)) / weight
    return placed.withColumn("target", F.least(F.col("_w") * each, F.col("words") * cap)).drop("_w", "place")


def _step(p: list[float], u: list[float], rng: np.random.Generator) -> list[float]:
    """p moved along u or against it, as far as all stay in 0..1; the expectation is p."""
    forth = min((1 - x) / d if d > 0 else x / -d for x, d in zip(p, u, strict=True) if d)
    back = min(x / d if d > 0 else (1 - x) / -d for x, d in zip(p, u, strict=True) if d)
    by = forth if rng.random() * (forth + back) < back else -back
    moved = [x + by * d for x, d in zip(p, u, strict=True)]
    return [0.0 if x < EPS else 1.0 if x > 1 - EPS else x for x in moved]


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all 0 or 1 but for two at most; sums of p and of size * p stay. Units are taken in the order given."""
    p = p.astype(float).copy()
    waiting = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))][::-1]
    active: list[int] = []
    while True:
        while waiting and len(active) < 3:
            active.append(waiting.pop())
        if len(active) < 3:
            return p
        a, b, c = (float(size[i]) for i in active)
        u = [b - c, c - a, a - b]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        scale = max(map(abs, u))
        moved = _step([p[i] for i in active], [x / scale for x in u], rng)
        p[active] = moved
        active = [i for i, x in zip(active, moved, strict=True) if 0 < x < 1]


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The at most two units that are left are set to 0 or 1 such that the token total moves least (ties: the document total, then fewer)."""
    left = np.flatnonzero((p > 0) & (p < 1))
    best, out = None, p.copy()
    for bits in range(2 ** len(left)):
        take = np.array([bits >> i & 1 for i in range(len(left))], float)
        cost = (abs(float(((take - p[left]) * size[left]).sum())), abs(float((take - p[left]).sum())), float(take.sum()), bits)
        if best is None or cost < best:
            best = cost
            out[left] = take
    return out


def _balance(left: DataFrame, level: int, counts: DataFrame, last: bool, block: int) -> DataFrame:
    """One level: `left` with p moved; on the last one every source is one block, and lands."""
    blocks = small(counts.select(F.col("source").alias("_source"), F.ceil(F.col("n") / block).cast("int").alias("_blocks")), FEW)
    dealt = left.join(blocks, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_block", F.pmod(F.xxhash64("unit", F.lit(level)), F.col("_blocks"))).drop("_source", "_blocks")

    def move(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["words", "unit"], ascending=[False, True], kind="stable")
        size, rng = group["words"].to_numpy(float), np.random.default_rng([level, len(group), int(group["unit"].iloc[0]) & (2**63 - 1)])
        p = flight(size, group["p"].to_numpy(), rng)
        return group.assign(p=landing(size, p) if last else p).drop(columns="_block")

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    return settle(dealt.groupBy("source", "_block").applyInPandas(move, kept), "balanced")


def _unit(key: str, text: str, source: str) -> Column:
    """A hash of a document; a null is told from a value, wherever it stands."""
    return F.xxhash64(key, source, text, F.col(key).isNull(), F.col(source).isNull(), F.col(text).isNull())


def _decided(docs: DataFrame, key: str, text: str, source: str, weights: Iterable[float], factor: float, cap: float, block: int) -> DataFrame:
    """(unit, rows, key, size, source, source_size, target, whole, extra): of a document's equal rows each is taken `whole` times, and `extra` of them once more.

    Equal rows share their fraction: the whole number of further copies that it makes together is certain, and the cube method decides
    on the one that is left.
    """
    own = docs.select(_unit(key, text, source).alias("unit"), F.col(key).alias("key"), F.col(source).alias("source"), size_in_words(F.col(text)).alias("size"))
    units = settle(own.groupBy("unit", "key", "source", "size").agg(F.count("*").alias("rows")).withColumn("words", F.col("size") * F.col("rows")), "units")
    goal = targets(units.groupBy("source").agg(F.sum("words").alias("words")), weights, factor, cap)
    rate = F.when(F.col("words") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("words"))).otherwise(0.0)
    whole = F.floor(rate + EPS).cast("int")
    made = settle(goal.select(F.col("source").alias("_source"), F.col("words").alias("source_size"), "target", whole.alias("whole"), F.greatest(F.lit(0.0), rate - whole).alias("part")), "targets")
    stats = small(made, FEW)
    shared = units.join(stats, F.col("source").eqNullSafe(F.col("_source"))).withColumn("extra", F.floor(F.col("rows") * F.col("part") + EPS))
    shared = shared.withColumn("p", F.col("rows") * F.col("part") - F.col("extra"))
    left = shared.where(F.col("p") > EPS).select("unit", "key", "source", "size", F.col("size").alias("words"), "p")
    level, more = 0, None
    while True:
        counts = settle(left.groupBy("source").agg(F.count("*").alias("n")), "counts")
        most = counts.agg(F.max("n")).first()[0]
        if most is None:
            break
        left = _balance(left, level, counts, most <= block, block)
        taken = left.where("p = 1").select("unit", F.col("key").alias("_key"), "size", F.col("source").alias("_from"), F.lit(1).alias("_more"))
        more = taken if more is None else more.unionByName(taken)
        left, level = left.where("p > 0 AND p < 1"), level + 1
    if more is None:
        joined = shared.withColumn("_more", F.lit(0))
    else:
        joined = shared.join(more, (shared["unit"] == more["unit"]) & (shared["size"] == more["size"]) & shared["key"].eqNullSafe(more["_key"]) & shared["source"].eqNullSafe(more["_from"]), "left").drop(more["unit"], more["size"])
    return joined.select("unit", "rows", "key", "size", "source", "source_size", "target", "whole", (F.col("extra") + F.coalesce("_more", F.lit(0))).alias("extra"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Iterable[float] = WEIGHTS, factor: float = FACTOR, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """(unit, rows, key, size, source, source_size, target, copies): of each distinct document of docs, how many of its rows are taken how often.

    `unit` identifies key, source and text. The rows of a document are one line, or two of which one has a copy more: the whole
    part of target / source size for each row, what the fractions of all its rows make together, and 0 or 1. So a row that repeats
    very often is taken as exactly as many different ones. A null text has size 0. Null sources are one source, and there may
    be any number of sources. Results do not depend on partitions or order. An empty table gives an empty result.
    """
    made = _decided(docs, key, text, source, weights, factor, cap, block)
    parts = F.array(F.struct((F.col("rows") - F.col("extra")).alias("rows"), F.col("whole").alias("copies")), F.struct(F.col("extra").alias("rows"), (F.col("whole") + 1).alias("copies")))
    each = made.withColumn("_p", F.explode(F.filter(parts, lambda p: p.rows > 0)))
    return each.select("unit", "_p.rows", F.col("key").alias(key), "size", "source", "source_size", "target", "_p.copies")


def take(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Iterable[float] = WEIGHTS, factor: float = FACTOR, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it.

    Of a document's equal rows the first ones get the further copies; such rows are counted within their task and after the tasks
    before, so that a row of a third of all rows is not gathered anywhere.
    """
    decided = _decided(docs, key, text, source, weights, factor, cap, block).where("whole + extra > 0").select(F.col("unit").alias("_unit"), "rows", "whole", "extra")
    met = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _unit(key, text, source).alias("_of")).join(decided.select("_unit", F.struct("rows", "whole", "extra").alias("_d")), F.col("_of") == F.col("_unit"))
    met = met.select("_row", "_unit", "_d")
    split = (F.col("_d.extra") > 0) & (F.col("_d.extra") < F.col("_d.rows"))
    alike = met.where(~split).select("_row", (F.col("_d.whole") + (F.col("_d.extra") > 0).cast("int")).alias("_n"))
    mixed = settle(met.where(split).withColumn("_part", F.spark_partition_id()), "repeats")
    before = mixed.groupBy("_unit", "_part").agg(F.count("*").alias("_k"))
    before = before.select(F.col("_unit").alias("_u"), F.col("_part").alias("_p"), (F.sum("_k").over(Window.partitionBy("_unit").orderBy("_part")) - F.col("_k")).alias("_before"))
    placed = mixed.withColumn("_at", F.row_number().over(Window.partitionBy("_unit", "_part").orderBy(F.lit(0)))).join(before, (F.col("_unit") == F.col("_u")) & (F.col("_part") == F.col("_p")))
    some = placed.select("_row", (F.col("_d.whole") + (F.col("_before") + F.col("_at") <= F.col("_d.extra")).cast("int")).alias("_n"))
    both = alike.unionByName(some).where("_n > 0")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
