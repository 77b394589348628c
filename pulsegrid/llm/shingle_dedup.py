"""Near copies by word shingles: every pair of documents whose sets of shingles have a Jaccard similarity of 4/5 or more.

Equal and nearly equal texts are found by SimHash first (multi-index hashing of fingerprints of the same shingles): each
fingerprint's document is compared, exactly, with that of the smallest fingerprint it is linked to. Two sets at 4/5 can be a
quarter of the bits apart, farther than any radius that can be looked up, so the pairs left are found another way, which
misses none. If the shingles of all documents stand in one order, two such sets share one of their first
n - ceil(4n/5) + 1 (n: the size of each), so only documents that share one of these are compared, and exactly. Any order
finds the same pairs: shingles seen often in a sample come last, so that common passages seldom bring documents together.
A shingle's documents first meet one of them only, and after that only those of other components: many near copies of one
text aren't paired with one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import distil, settle, slices, small, swept
from pulsegrid.llm.components import components, joined
from pulsegrid.llm.simhash_dedup import RADIUS, SEED, linked, majority

WORDS = 5
#: Documents of the sample and shingles held as common, at most; in how many turns all meet one document of each shingle, and how
#: many orders the shingles of one turn choose that document by. None of them changes the result.
SAMPLE, COMMON, TURNS, SPREAD = 8_192, 50_000, 2, 4
#: Shingles are counted in so many cells, by which most pairs are told apart without their sets. Chance fills few cells alike only
#: where they hold few, so large sets are also counted in more cells, of 4 to 8 shingles, FINE of them at most.
CELLS, FINE = 128, 8_192


def hashes(text: str, words: int = WORDS) -> np.ndarray:
    """The XXH64 of runs of `words` words, A-Z lower-cased, repeats included; fewer words are one run, none have no shingle."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)] if w else ()
    return np.array([xxh64_intdigest(s, SEED) for s in runs], np.uint64)


def _node(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), SEED)


def _fine(own: np.ndarray) -> bytes | None:
    """How many of a large set are in each of its finer cells, a byte each; None if there are no more than CELLS or one holds too many."""
    bits = min(len(own).bit_length() - 3, FINE.bit_length() - 1)
    if 1 << max(bits, 0) <= CELLS:
        return None
    held = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return held.astype(np.uint8).tobytes() if held.max() < 256 else None


def _alike(x: bytes | None, y: bytes | None) -> bool:
    """Whether sets of these counts in finer cells can be similar enough; so can those that were not counted. Two sizes of cells are told in the larger."""
    if x is None or y is None:
        return True
    k = min(len(x), len(y))
    p, q = (np.frombuffer(c, np.uint8).reshape(k, -1).sum(1, dtype=np.int64) for c in (x, y))
    return 9 * int(np.minimum(p, q).sum()) >= 4 * int(p.sum() + q.sum())


def _long(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _map(docs: DataFrame, each: Callable[[dict, list[np.ndarray]], dict], schema: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict(each(rows, [hashes(t, words) for t in texts]))

    return docs.mapInArrow(run, schema)


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted shingles that three or more documents of a sample have."""
    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-docs.count() // SAMPLE)))) == 0)
    each = _map(some, lambda _, own: {"h": _long(np.concatenate([*map(np.unique, own), np.empty(0, np.uint64)]))}, "h long", words)
    with swept(docs.sparkSession):
        often = each.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).select("h").toPandas()
    return np.sort(often["h"].to_numpy(np.int64).view(np.uint64))


def _firsts(docs: DataFrame, words: int) -> DataFrame:
    """(key, node, fp, n, cells, fine, first): a number for the set of shingles, fingerprint, size, how many shingles are in each cell and finer cell, and first shingles in the common order."""
    common = _common(docs, words)

    def each(rows: dict, own: list[np.ndarray]) -> dict:
        fp = majority(np.concatenate([*own, np.empty(0, np.uint64)]), np.array(list(map(len, own)), np.int64))
        sets, first = list(map(np.unique, own)), []
        for s in sets:
            late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
            first.append(np.concatenate([s[~late], s[late]])[: len(s) - -(-4 * len(s) // 5) + 1].view(np.int64))
        return {"key": rows["key"], "node": _long([_node(s) for s in sets]), "fp": pa.array(fp.view(np.int64)), "n": pa.array([len(s) for s in sets], pa.int64()), "cells": pa.array([np.bincount(s >> np.uint64(57), minlength=CELLS).astype(np.int32) for s in sets], pa.list_(pa.int32())), "fine": pa.array(map(_fine, sets), pa.binary()), "first": pa.array(first, pa.list_(pa.int64()))}

    return _map(docs, each, f"key {docs.schema['key'].dataType.simpleString()}, node long, fp long, n long, cells array<int>, fine binary, first array<long>", words)


def _possible(n: Column, at: Column, m: Column, other: Column) -> Column:
    """Whether sets of n and m shingles, whose first common one is at these places, can be similar enough."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - at, m - other) >= 4 * (n + m))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) of pairs that counts in cells do not tell apart.

    What two sets have in common is at most the sum over the cells of the smaller count. All are told by CELLS cells first; finer
    cells, a thirtieth of a set, then move with what is left of large sets, most of which chance has brought together.
    """
    of = {c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("cells").alias(f"cells_{c}")) for c in "ab"}
    most = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    left = settle(pairs.join(of["a"], "a").join(of["b"], "b").where(9 * most >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "likely")
    large = nodes.where(F.col("fine").isNotNull())
    met = left.join(large.select(F.col("node").alias("a"), F.col("fine").alias("x")), "a", "left").join(large.select(F.col("node").alias("b"), F.col("fine").alias("y")), "b", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array([_alike(p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True)], pa.bool_()))

    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The (a, b) of pairs whose sets are similar; sets are made again from the texts of the documents that are met.

    Sets move with their pairs, so pairs with too little in common are left out first.
    """
    pairs = settle(_likely(pairs, nodes), "likely")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = small(nodes.join(ends, "node").select(F.col("least").alias("key")).distinct(), 500_000)
    own = _map(docs.join(keys, "key", "left_semi"), lambda _, x: {"node": _long([_node(s) for s in map(np.unique, x)]), "own": pa.array([np.unique(s).view(np.int64) for s in x], pa.list_(pa.int64()))}, "node long, own array<long>", words)
    sets = settle(own.join(small(ends, 500_000), "node", "left_semi").dropDuplicates(["node"]), "sets")
    met = pairs.join(sets.withColumnsRenamed({"node": "a", "own": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "own": "y"}), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(5 * both >= 4 * (F.size("x") + F.size("y") - both)).select("a", "b")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b) to be compared: every node with the least of its fingerprint, and that with the least of the fingerprint it is linked to."""
    prints = settle(nodes.groupBy("fp").agg(F.min("node").alias("least_node")), "fingerprints")
    near = linked(prints.select("fp"), prints.count(), RADIUS).where("node <> root")
    one, other = prints.withColumnsRenamed({"fp": "node", "least_node": "x"}), prints.withColumnsRenamed({"fp": "root", "least_node": "y"})
    same = nodes.join(prints, "fp").select(F.col("node").alias("x"), F.col("least_node").alias("y"))
    both = near.join(one, "node").join(other, "root").select("x", "y").unionByName(same).where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, component_id) of every row whose key is not null: the smallest key that similar pairs reach. Other rows link nothing."""
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def tables() -> tuple[DataFrame, ...]:
        rows = settle(_firsts(own, words), "firsts")
        nodes = settle(rows.groupBy("node").agg(F.min("key").alias("least"), *(F.min(c).alias(c) for c in ("fp", "n", "cells", "fine")), F.count("*").alias("rows")), "nodes")
        copies = small(nodes.where("rows > 1").select("node", "least"), 500_000)
        one = rows.join(copies, "node", "left").where(F.col("least").isNull() | (F.col("key") == F.col("least")))
        by_h = Window.partitionBy("h").orderBy("n", "node")
        dealt = one.select("node", "n", F.posexplode("first").alias("at", "h"))
        beside = dealt
        for name, near in (("_b", F.lag), ("_a", F.lead)):  # another set of nearly the same size
            beside = beside.withColumn(name, (near("node").over(by_h) != F.col("node")) & (5 * F.least(near("n").over(by_h), "n") >= 4 * F.greatest(near("n").over(by_h), "n")))
        return nodes, beside.where("_b OR _a").drop("_b", "_a"), rows.select("key", "node")

    nodes, shared, rows = distil(tables, "nodes", "shared", "keys")
    roots = distil(lambda: components(settle(_verified(settle(_by_fingerprint(nodes), "pairs"), own, nodes, words), "links")), "roots")
    of_size = F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1.25)))  # similar sets are of one class or of neighbouring ones
    for turn in range(TURNS + 1):
        state = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("size", of_size)
        if turn < TURNS:
            order = F.xxhash64("node", F.pmod("h", F.lit(SPREAD)), F.lit(turn))
            first = F.min(F.struct("at", order.alias("_"), "node", "n", "root")).alias("one")  # of a passage's documents one of which it is the most
            other = state.groupBy("h", "size").agg(first).select("h", "size", "one.*").drop("_")
        else:
            several = state.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
            state = state.join(several.select("h"), "h", "left_semi")
            other = state
        other = other.select("h", F.col("size").alias("meets"), *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "at", "root")))
        dealt = state.withColumn("meets", F.explode(F.array("size", F.col("size") - 1)))
        met = dealt.join(other, ["h", "meets"]).where((F.col("root") != F.col("o_root")) & _possible(F.col("n"), F.col("at"), F.col("o_n"), F.col("o_at")))
        if turn == TURNS:
            met = met.where("meets < size OR node < o_node")
        pairs = settle(met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct(), "pairs")
        if pairs.limit(1).count() and (new := distil(lambda: _verified(pairs, own, nodes, words), "links")).limit(1).count():  # noqa: B023
            roots = distil(lambda: joined(roots, new), "roots")  # noqa: B023
    rooted = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("node", "component_id"), "node").select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """docs with one document of each group: that of the smallest key. Rows with a null key all stay, as do repeated rows of a key that stays."""
    groups = lambda: near_groups(docs, key=key, text=text, words=words)
    others = distil(lambda: groups().where(F.col(key) > F.col("component_id")).select(F.col(key).alias("_gone")).distinct(), "others")
    return docs.join(small(others, 500_000), F.col(key) == F.col("_gone"), "left_anti")
