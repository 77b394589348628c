"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. By the pigeonhole rule two fingerprints within the radius agree, up to a small
radius of its own, in at least one segment: each fingerprint looks up every value in that small Hamming ball in the
segment's table, and what it meets there is kept if the distance over all 64 bits is within the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import settle, slices, small
from pulsegrid.llm.components import components, joined

BITS, SEED = 64, 42
WORDS, RADIUS, HOT = 4, 4, 64


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of `sizes` hashes the 64 bits that are set in over half of them; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    size = sizes[full]
    starts = np.cumsum(size) - size
    pieces = -(-size // 255)  # eight counters of a byte each share a 64-bit word, so no more than 255 rows are added at once
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    counts = np.add.reduceat(np.add.reduceat(lanes, cuts).view(np.uint8).astype(np.int64), first)
    out[full] = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp long) of every row: A-Z lower-cased, XXH64 of shingles of `words` words, repeats included, bits by majority.

    A text of fewer words has its whole sequence as its one shingle; a null or empty text, or one of white space only,
    has fingerprint zero. Null and repeated keys stay as they are; other columns are left out. There is no shuffle.
    """
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text"):
            hashes, sizes = [], []
            for t in texts:
                w = t.encode().lower().split()  # of bytes: A-Z only, and exactly the six ASCII white spaces
                shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)] if w else ()
                found = [xxh64_intdigest(s, SEED) for s in shingles]
                sizes.append(len(found))
                hashes += found
            fp = majority(np.array(hashes, np.uint64), np.array(sizes, np.int64))
            yield pa.RecordBatch.from_pydict({key: rows["key"], "fp": pa.array(fp.view(np.int64))})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def segments(rows: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, own radius) of each segment; wide enough that a table of `rows` fingerprints has about one a value."""
    m = max(2, min(radius + 1, BITS // max(1, (rows + 1).bit_length())))
    least, extra = divmod(radius, m)
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    own = [least if i <= extra else least - 1 for i in range(m)]
    return [(sum(widths[:i]), widths[i], own[i]) for i in range(m) if own[i] >= 0]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _tables(fps: DataFrame, rows: int, radius: int, name: str, ball: bool, *more: str) -> DataFrame:
    """(name, slot) of each fingerprint: its own value in each segment's table, or with `ball` every value that it looks up there."""
    parts = segments(rows, radius)
    flips = lambda i, shift, width, most: [(_signed(sum(1 << (shift + x) for x in f)), shift, (1 << width) - 1, i) for k in range(most + 1) for f in combinations(range(width), k)]
    probes = [p for i, (shift, width, most) in enumerate(parts) for p in flips(i, shift, width, most if ball else 0)]
    dealt = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(s).alias("s"), F.lit(w).cast("long").alias("w"), F.lit(i).cast("long").alias("i")) for m, s, w, i in probes)))
    return fps.select(F.col("fp").alias(name), *more, dealt.alias("p")).select(name, *more, F.expr(f"(shiftrightunsigned({name} ^ p.m, p.s) & p.w) * 8 + p.i").alias("slot"))


def _near(radius: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius


def links(fps: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b, of all distinct fingerprints in column fp, of which there are about `rows`, at most `radius` bits apart."""
    met = _tables(fps, rows, radius, "a", True).join(_tables(fps, rows, radius, "b", False), "slot")
    return met.where((F.col("a") < F.col("b")) & _near(radius)).select("a", "b").distinct()


def _crowds(there: DataFrame, hot: int) -> DataFrame:
    """(slot, crowd, rep) of the components that more than `hot` fingerprints of a slot belong to, and one of these."""
    return settle(there.groupBy("slot", F.col("b_root").alias("crowd")).agg(F.count("*").alias("n"), F.min("b").alias("rep")).where(F.col("n") > hot).select("slot", "crowd", "rep"), "crowds")


def _met(asked: DataFrame, there: DataFrame, crowds: DataFrame) -> DataFrame:
    """(a, root, b, b_root): each of asked (a, root, slot) with what stands in its slot of there (b, b_root, slot) and is of another component.

    What belongs to a crowd of its slot never meets that crowd: it meets the others there, and other crowds by their names.
    """
    known = small(crowds.select(F.col("slot").alias("_slot"), "crowd"), 500_000)
    told = asked.join(known, (F.col("slot") == F.col("_slot")) & (F.col("root") == F.col("crowd")), "left").drop("_slot")
    names = ("a", "root", "b", "b_root")
    alone = told.where("crowd IS NULL").join(there, "slot").select(*names)
    within = told.where("crowd IS NOT NULL").drop("crowd")
    rest = there.join(known, (F.col("slot") == F.col("_slot")) & (F.col("b_root") == F.col("crowd")), "left_anti")
    pairs = crowds.select(F.col("slot").alias("_s"), F.col("crowd").alias("_c")).join(crowds.select("slot", F.col("crowd").alias("_other")), (F.col("_s") == F.col("slot")) & (F.col("_c") != F.col("_other"))).drop("slot")
    other = within.join(pairs, (F.col("slot") == F.col("_s")) & (F.col("root") == F.col("_c"))).select("a", "root", F.col("_s").alias("slot"), F.col("_other").alias("b_root"))
    return alone.unionByName(within.join(rest, "slot").select(*names)).unionByName(other.join(there, ["slot", "b_root"]).select(*names)).where(F.col("root") != F.col("b_root"))


def linked(fps: DataFrame, rows: int, radius: int = RADIUS, hot: int = HOT, tables: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(node, root) of the components that all links() make; root is the smallest fingerprint. Fingerprints without a link are left out.

    Links within a component needn't all be found. First each fingerprint meets one of each slot it stands in, which joins most of
    a dense cluster; then it looks up one of each crowd (over `hot` fingerprints of one component in a slot) until this joins no
    more; at last fingerprints of different components look one another up, crowds never within themselves.
    `tables` (fps, name, ball, *more columns) may deal other slots than multi-index hashing does, such that of two fingerprints
    within the radius one stands in a slot that the other looks up.
    """
    deal = tables or (lambda fps, name, ball, *more: _tables(fps, rows, radius, name, ball, *more))
    own = deal(fps, "b", False)
    met = settle(own.join(own.groupBy("slot").agg(F.min("b").alias("a")), "slot").where((F.col("a") < F.col("b")) & _near(radius)).select("a", "b").distinct(), "met")
    first = components(met)
    while True:
        state = settle(fps.join(first, fps["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
        there = deal(state, "b", False, "root").withColumnRenamed("root", "b_root")
        asked = deal(state, "a", True, "root")
        crowds = _crowds(there, hot)
        if not crowds.limit(1).count():
            break
        ones = small(crowds.select("slot", F.col("crowd").alias("b_root"), F.col("rep").alias("b")), 500_000)
        more = settle(asked.join(ones, "slot").where((F.col("root") != F.col("b_root")) & _near(radius)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
        if not more.limit(1).count():
            break
        first = joined(first, more)
    more = _met(asked, there, crowds).where((F.col("a") < F.col("b")) & _near(radius)).select("a", "b").distinct()
    return joined(first, settle(more, "links"))


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: key, fp, component_id (the smallest key that links of `radius` bits or fewer reach).

    Equal fingerprints are collapsed before any search, so copies are never paired with one another. A component whose
    keys are all null has a null id. An empty table gives an empty result; other columns are left out.
    """
    fps = settle(fingerprints(docs, key=key, text=text, words=words), "fingerprints")
    distinct = settle(fps.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = linked(distinct.select("fp"), distinct.count(), radius).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group: that of the smallest key. Rows with a null key all stay, as do repeated rows of a key that stays."""
    groups = near_groups(docs, key=key, text=text, words=words, radius=radius)
    others = groups.where(F.col(key) > F.col("component_id")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(others, F.col(key) == F.col("_gone"), "left_anti")
