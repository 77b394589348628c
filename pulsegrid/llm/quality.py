"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Words are read twice: as they are, and as a shape (runs of upper case, lower case, digits and signs). One- to three-grams
of the shapes, one- and two-grams of the words and the event that a word repeats the one before are hashed into one
table of weights. A document's vector has the square roots of its n-grams' shares, and its score is a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Memo, fold, slices

BUCKETS = 1 << 18
#: The model is fitted on at most this many labelled documents, those of the smallest hashes of their ids, in this many shards.
MOST_LABELS, SHARDS = 8192, 4
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.0, 4
KEEP, WORD = 0.3, 24
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _shape(word: str) -> str:
    return re.sub(r"a+", "a", re.sub(r"A+", "A", re.sub(r"(?<=[^\W_])'(?=[^\W_])", "a", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))))


@cache
def _memo() -> Memo:
    def make(word: str) -> int:
        return crc32(word.lower().encode()) << 32 | crc32(_shape(word).encode())

    return Memo(make, 150_000)


def split(text: str) -> list[str]:
    """The words of a text; one of more than WORD characters (such as a text without white space) counts as several."""
    words = text.split()
    if words and len(max(words, key=len)) > WORD:
        return [w[i : i + WORD] for w in words for i in range(0, len(w), WORD)]
    return words


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (ascending) and values of a whole text; none if it has no word."""
    words = split(text)
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    both = np.fromiter(map(_memo().__getitem__, words), np.uint64, len(words))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    a, b, c = _ODD
    same = np.count_nonzero(word[1:] == word[:-1])
    grams = [word * a, word[:-1] * b + word[1:] * c, shape * c + a, shape[:-1] * a + shape[1:] * b + c, shape[:-2] * b + shape[1:-1] * c + shape[2:] * a + b, np.full(same, a)]
    found = (np.concatenate(grams) >> np.uint64(46)).astype(np.int64)  # the 18 highest bits
    counts = np.bincount(found, minlength=0) if len(found) > 20_000 else None
    if counts is None:
        at, n = np.unique(found, return_counts=True)
    else:
        at = np.flatnonzero(counts)
        n = counts[at]
    return at, np.sqrt(n / len(words))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates, example by example."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in examples:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(BUCKETS + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELS) -> np.ndarray:
    """The model: BUCKETS weights and the bias, the mean of the shards' models.

    Only labels 0 and 1 of documents outside the held-out fold count; null ids and labels are left out, of repeated ids the
    smallest label and the text of the smallest hash count. Without any label all weights are 0. The sample is bounded by `most`, whatever the input's size.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key) != 0)).groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    met = docs.join(F.broadcast(sample), F.col(key) == F.col("_id"))  # `most` rows
    one = met.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text"))).alias("_t"))
    rows = one.select(F.col("_id").alias("id"), "_t.text", F.col("_y").alias("y"), F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(SHARDS)).alias("shard"))

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(at=lambda g: [crc32(str(i).encode()) for i in g["id"]]).sort_values(["at", "id"])
        weights, bias = train([(*features(t or ""), int(y)) for t, y in zip(group["text"], group["y"], strict=True)])
        return pd.DataFrame({"w": [np.append(weights, bias).astype("<f4").tobytes()], "n": [len(group)]})

    models = rows.groupBy("shard").applyInPandas(shard, "w binary, n long").collect()
    total = sum(m["n"] for m in models)
    return sum((np.frombuffer(m["w"], "<f4") * np.float32(m["n"] / total) for m in sorted(models, key=lambda m: m["w"])), np.zeros(BUCKETS + 1, np.float32))


def score(docs: DataFrame, model: np.ndarray, *, key: str = "doc_id", text: str = "text", rest: bool = False) -> DataFrame:
    """(key, score) of every row, or with `rest` all columns of docs and `score`; a null or empty text has the bias only."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.asarray(model, np.float32))  # of fixed size: 1 MB
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text")) if not rest else docs.select(F.struct("*").alias("row"))
    own = kept.select("row").schema[0].dataType.simpleString() if rest else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        named = (pa.RecordBatch.from_pydict({"row": b.column(0), "text": b.column(0).field(text)}) for b in batches) if rest else batches
        for rows, texts in slices(named, "text"):
            dots = [float(w[at] @ x) if len(at) else 0.0 for at, x in map(features, texts)]
            values = pa.array(1 / (1 + np.exp(-np.clip(np.array(dots) + float(w[-1]), -35, 35))))
            yield pa.RecordBatch.from_pydict({"row": rows["row"], "score": values} if rest else {key: rows["key"], "score": values})

    if rest:
        return kept.mapInArrow(run, f"row {own}, score double").select("row.*", "score")
    return kept.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
