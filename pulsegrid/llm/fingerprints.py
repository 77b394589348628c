"""SimHash fingerprints of documents, and pairs or groups of all within a Hamming radius by permuted block tables.

Terms are pairs of neighbouring words (one word if there is no other), weighted by 1 + ln of their count. The 64-bit
hash of each term votes with its weight on each bit: for it where the bit is set, against it where not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Memo, by_ranges, settle
from pulsegrid.llm.simhash_dedup import linked

BITS, RADIUS = 64, 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@cache
def _memo() -> Memo:
    from xxhash import xxh64_intdigest

    return Memo(xxh64_intdigest, 150_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a whole text, as a signed integer; 0 if it has no word."""
    words = text.split()
    if not words:
        return 0
    h = np.fromiter(map(_memo().__getitem__, words), np.uint64, len(words))
    terms, n = np.unique(_mixed(h[:-1] * _A + h[1:]) if len(h) > 1 else _mixed(h), return_counts=True)
    weights = 1 + np.log(n.astype(np.float32))
    bits = np.unpackbits(terms.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = 2 * (weights @ bits.astype(np.float32)) - weights.sum()
    return int(np.packbits(votes > 0, bitorder="little").view(np.int64)[0])


def likeness(a: int, b: int) -> float:
    return 1 - ((a ^ b) & (2**BITS - 1)).bit_count() / BITS


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint long) of every row. Null, empty and white texts have fingerprint 0; rows stay as they are, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "fingerprint": pa.array([fingerprint(t.as_py() or "") for t in batch.column(1)], pa.int64())})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint long")


def edited(text: str, following: str) -> str:
    """text, its last third replaced by as much of the beginning of `following`."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def edit_likeness(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    The next document is that of the next smaller key (a number), after the smallest the largest; rows of equal key are
    ordered by their texts' hashes, largest first. A row with a null key has the empty text as its next one. Documents are dealt
    by ranges of the key (of the hash, within a key of very many rows) and sorted; each range also gets the first row of the
    range that follows it, so texts are shuffled once and streamed, one text and the one before it at a time.
    """
    rows, _ = by_ranges(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")), "key", "hash", "pid")
    rows = rows.withColumn("pid", F.when(F.col("key").isNotNull(), F.col("pid")))
    first = {r["pid"]: r["top"] for r in rows.where("pid IS NOT NULL").groupBy("pid").agg(F.max(F.struct("key", "hash")).alias("top")).collect()}  # a row for each range
    order = sorted(first, reverse=True)
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    to = spark.createDataFrame([(*first[p], order[i - 1]) for i, p in enumerate(order)], f"top {kind}, _hash long, to int")
    met = rows.join(F.broadcast(to), (F.col("key") == F.col("top")) & (F.col("hash") == F.col("_hash")))
    borders = met.groupBy("key", "hash", F.col("to").alias("pid")).agg(F.max("text").alias("text")).withColumn("border", F.lit(1))  # one, however often the row is repeated
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    loose = rows.withColumn("pid", F.coalesce("pid", -1 - F.pmod("hash", F.lit(n)).cast("int"))).withColumn("border", F.lit(0))
    dealt = loose.unionByName(borders).repartitionById(n, F.pmod(F.col("pid"), F.lit(n)))
    dealt = dealt.sortWithinPartitions("pid", "border", F.desc("key"), F.desc("hash"), F.desc("text")).select("key", "text", "pid", "border")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                key_, text_, pid, border = (batch.column(c)[i].as_py() for c in range(4))
                yield key_, text_ or "", pid, border

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, before, previous = [], None, (0, 0)

        def close(now: tuple, print_: int) -> None:
            own, own_print = before, previous
            changed = edited(own[1], now[1])
            changed_print = fingerprint(changed)
            out.append((own[0], len(own[1]), hashlib.sha256(changed.encode()).hexdigest(), f"{own_print & (2**BITS - 1):016x}", f"{changed_print & (2**BITS - 1):016x}", likeness(own_print, changed_print), likeness(own_print, print_)))

        for row in rows_of(batches):
            follows = before is not None and before[2] == row[2] and row[2] >= 0
            now_print = fingerprint(row[1])
            if before is not None and not before[3]:
                close(row if follows else (None, ""), now_print if follows else 0)
            before, previous = row, now_print
            if len(out) >= 1000:
                yield _batch(out, key, kind_)
                out.clear()
        if before is not None and not before[3]:
            close((None, ""), 0)
        if out:
            yield _batch(out, key, kind_)

    kind_ = kind
    return dealt.mapInArrow(run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list[tuple], key: str, kind: str) -> pa.RecordBatch:
    names = (key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    own = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}.get(kind)
    return pa.RecordBatch.from_pydict({n: pa.array(c, own if n == key else None) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


def blocks_for(rows: int, radius: int) -> int:
    """The least number of blocks whose prefixes have about 16 fingerprints each, of `rows` in all, if these are spread evenly."""
    blocks = radius + 1
    while blocks < BITS // 2 and rows > 16 << (BITS // blocks * (blocks - radius)):
        blocks += 1
    return blocks


def block_tables(fps: DataFrame, radius: int, blocks: int, name: str, *more: str, fp: str = "fp") -> DataFrame:
    """(name, more, slot): each fingerprint in every permuted block table, a slot for each table and prefix.

    The bits are cut into blocks. Of two fingerprints within the radius at least blocks - radius blocks are equal: for each
    choice of so many blocks there is a table with these in front, in which both have the same prefix. Slots are hashes, so
    two prefixes may share one, which adds comparisons and loses none.
    """
    if blocks <= radius:
        raise ValueError("there must be more blocks than the radius")
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    masks = [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]
    tables = [sum(masks[i] for i in own) for own in combinations(range(blocks), blocks - radius)]
    mask = F.explode(F.array(*(F.lit(m - 2**64 if m >= 2**63 else m).cast("long") for m in tables)))
    return fps.select(F.col(fp).alias(name), *more, mask.alias("mask")).select(name, *more, F.xxhash64("mask", F.col(name).bitwiseAND(F.col("mask"))).alias("slot"))


def within(fps: DataFrame, radius: int = RADIUS, blocks: int = 5, fp: str = "fingerprint") -> DataFrame:
    """(a, b), a < b, of all distinct fingerprints at most `radius` bits apart, by permuted block tables, whole distances verified.

    Equal fingerprints are one, so copies are never paired. A null fingerprint takes no part. A cluster of n different
    fingerprints has up to n * n / 2 pairs; `near_ids` groups them without these.
    """
    own = fps.select(F.col(fp).alias("fp")).where("fp IS NOT NULL").distinct()
    met = block_tables(own, radius, blocks, "a").join(block_tables(own, radius, blocks, "b"), "slot")
    return met.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b").distinct()


def near_ids(prints: DataFrame, radius: int = RADIUS, *, key: str = "doc_id", fp: str = "fingerprint") -> DataFrame:
    """prints with near_id: the smallest key that fingerprints (16 hex digits) at most `radius` bits apart lead to, one after another.

    Equal fingerprints are collapsed first. They meet in the permuted block tables, through representatives where a slot is
    crowded (`simhash_dedup.linked`), and whole distances are verified; no link is lost. A row without a fingerprint keeps its
    own key; where all keys of a group are null the id is null. An empty table gives an empty result; rows are kept as they are.
    """
    prints = settle(prints, "prints")
    own = F.conv(F.col(fp), 16, -10).cast("long")
    distinct = settle(prints.where(F.col(fp).isNotNull()).groupBy(own.alias("fp")).agg(F.min(key).alias("least")), "distinct")
    rows = distinct.count()
    blocks = blocks_for(rows, radius)
    roots = linked(distinct.select("fp"), rows, radius, tables=lambda fps, name, _, *more: block_tables(fps, radius, blocks, name, *more))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("near_id"))
    changed = rooted.join(least, "root").select(F.lpad(F.lower(F.hex("fp")), 16, "0").alias("_fp"), F.struct("near_id").alias("_near"))
    return prints.join(changed, F.col(fp) == F.col("_fp"), "left").withColumn("near_id", F.when(F.col(fp).isNull(), F.col(key)).otherwise(F.col("_near.near_id"))).drop("_fp", "_near")
