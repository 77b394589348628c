"""Language identification by nearest centroids of TF-IDF character n-grams.

Letters are lower-cased and everything else is a blank; two- and three-grams of characters are hashed into a fixed table.
A text's vector has (1 + ln count) * idf, normalised to length 1. Each language has several centroids, clustered by
cosine (spherical k-means); a text goes to the language of the nearest one. A text whose cosine is below that language's
radius, learned from the distances of its own examples, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import fold, settle, slices, small

BUCKETS = 1 << 13
#: Centroids are fitted on at most this many examples of each language, those of the smallest hashes of their ids.
MOST_EXAMPLES, CENTROIDS, ROUNDS = 400, 3, 8
#: So many languages (0.1 MB each) are sent to tasks together.
TOGETHER = 256
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: (number of the text, bucket, count), by text and bucket."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) + 2 for p in points])
    blank = np.zeros(1, np.uint32)
    x = np.concatenate([y for p in points for y in (blank, p, blank)]) if points else blank
    letter = _letters()[x]
    c = np.where(letter, x, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    two = ((c[:-1] * np.uint64(3) + (c[1:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(51)).astype(np.int64)
    three = (((c[:-2] >> np.uint64(11)) * np.uint64(0x165667B19E3779F9) + c[1:-1] * np.uint64(5) + (c[2:] >> np.uint64(5)) * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(51)).astype(np.int64)
    keep2, keep3 = letter[1:] & (owner[1:] == owner[:-1]), letter[1:-1] & (owner[2:] == owner[:-2])
    cells = np.bincount(np.concatenate([owner[1:][keep2] * BUCKETS + two[keep2], owner[1:-1][keep3] * BUCKETS + three[keep3]]), minlength=1)
    at = np.flatnonzero(cells)
    return at // BUCKETS, at % BUCKETS, cells[at]


def _groups(texts: list[str], most: int = 64) -> Iterator[list[str]]:
    for i in range(0, len(texts), most):
        yield texts[i : i + most]


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of length 1: (number of the text, bucket, value)."""
    owner, bucket, n = counts(texts)
    value = (1 + np.log(n)) * idf[bucket]
    length = np.sqrt(np.bincount(owner, value * value, len(texts)))
    return owner, bucket, value / np.maximum(length, 1e-12)[owner]


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts of column `text` each bucket occurs, and how many texts there are; all are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for _, texts in slices(batches, "text"):
            n += len(texts)
            for group in _groups(texts):
                df += np.bincount(counts(group)[1], minlength=BUCKETS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(df[at], n), pa.int64())})

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out[:-1], int(out[-1])


def cluster(owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int, k: int = CENTROIDS) -> tuple[np.ndarray, float]:
    """At most k centroids of n sparse vectors by spherical k-means, begun with vectors far from one another; and the least cosine that is not rejected."""
    x = np.zeros((n, BUCKETS), np.float32)
    x[owner, bucket] = value
    x = x[np.any(x, axis=1)]
    if not len(x):
        return np.zeros((0, BUCKETS), np.float32), 0.0
    mean = x.mean(0)
    chosen = [x[int(np.argmax(x @ mean))]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[int(np.argmin(np.max(x @ np.array(chosen).T, axis=1)))])
    c = np.array(chosen)
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == i].mean(0) if (near == i).sum() > 1 else mean for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    best = np.max(x @ c.T, axis=1)
    return c.astype(np.float32), float(max(0.0, best.mean() - 4 * best.std()))


@dataclass
class Model:
    table: DataFrame  # a row a language: lang, radius, c (its centroids as 32-bit floats); names are unique
    languages: int
    idf: np.ndarray


@dataclass
class Part:
    """Some languages of a model, for a task."""

    languages: list[str]
    centroids: np.ndarray  # (number of centroids, BUCKETS)
    owner: np.ndarray  # each centroid's language
    radius: np.ndarray  # each language's least cosine
    idf: np.ndarray


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_EXAMPLES) -> Model:
    """The model of all languages of docs, from rows outside the held-out fold whose text and language are known.

    Document frequencies cover all those rows; the centroids a bounded sample of each language: ids whose hash is below a
    threshold set by how many different ids the language has (the least hash always is), of which the `most` of the smallest
    hashes are used. Of a repeated id the text of the smallest hash counts. So no language is lost, however often a row repeats.
    """
    known = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where((fold(F.col("id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    place = F.shiftrightunsigned(F.xxhash64("id"), 1)
    ids = known.groupBy("lang", "id").agg(F.first(place).alias("place")).groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("count"), F.min("place").alias("least"))
    few = known.join(small(ids, 100_000), F.col("lang") == F.col("_lang")).where((place == F.col("least")) | (place < F.lit(2.0**63) * (1.5 * most + 50) / F.col("count")))
    one = few.groupBy("lang", "id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("_t"))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "id"])[:most]  # about 1.5 * most rows
        texts = group["text"].tolist()
        parts = [(o + 64 * i, b, v) for i, g in enumerate(_groups(texts)) for o, b, v in [vectors(g, idf)]]
        c, radius = cluster(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(texts))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "radius": [radius], "c": [c.astype("<f4").tobytes()]})

    rows = one.select("lang", "id", place.alias("place"), "_t.text")
    table = settle(rows.groupBy("lang").applyInPandas(fitted, "lang string, radius double, c binary").where(F.length("c") > 0), "languages")
    return Model(table, table.count(), idf)


def _part(rows: list, idf: np.ndarray) -> Part:
    found = sorted(rows, key=lambda r: r["lang"])
    parts = [np.frombuffer(r["c"], "<f4").reshape(-1, BUCKETS) for r in found]
    return Part([r["lang"] for r in found], np.concatenate(parts) if parts else np.zeros((0, BUCKETS), np.float32), np.repeat(np.arange(len(found)), [len(p) for p in parts]), np.array([r["radius"] for r in found]), idf)


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", reject: bool = True, together: int = TOGETHER) -> DataFrame:
    """(key, lang_pred, score, rejected) of every row; score is the cosine with the nearest centroid.

    A text that is null or has no letter is `und` with score 0. With `reject` so are the rejected ones, which otherwise keep
    their nearest language. Ties go to the language first in order. Without a learned language all are `und`. A model of more
    languages than `together` is applied in parts, of which each row keeps the nearest.
    """
    if model.languages <= together:
        return _nearest(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), _part(model.table.collect(), model.idf), key, reject)
    rows = settle(docs.select(F.struct(F.monotonically_increasing_id().alias("at"), F.col(key).alias("own")).alias("key"), F.col(text).alias("text")), "numbered")
    found, dealt = None, model.table.withColumn("_p", F.pmod(F.xxhash64("lang"), F.lit(-(-2 * model.languages // together))))
    for i in range(-(-2 * model.languages // together)):  # about half as many languages as fit
        some = _nearest(rows, _part(dealt.where(F.col("_p") == i).collect(), model.idf), "key", False)
        found = some if found is None else found.unionByName(some)
    best = found.groupBy("key").agg(F.min_by(F.struct("lang_pred", "score", "rejected"), F.struct((-F.col("score")).alias("s"), (F.col("lang_pred") == UNKNOWN).alias("u"), "lang_pred")).alias("b"))
    name = F.when(F.col("b.rejected") & F.lit(reject), UNKNOWN).otherwise(F.col("b.lang_pred"))
    return best.select(F.col("key.own").alias(key), name.alias("lang_pred"), "b.score", "b.rejected")


def _nearest(docs: DataFrame, part: Part, key: str, reject: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(part)  # of `together` languages at most
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        c, names = np.ascontiguousarray(m.centroids.T), [*m.languages, UNKNOWN]
        for rows, texts in slices(batches, "text"):
            found, scores, far = [], [], []
            for group in _groups(texts):
                owner, bucket, value = vectors(group, m.idf)
                near = np.zeros((len(group), max(1, c.shape[1])))
                if len(owner) and c.shape[1]:
                    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                    near[owner[starts]] = np.add.reduceat(c[bucket] * value[:, None], starts)
                best = np.argmax(near, axis=1)
                top = near[np.arange(len(group)), best]
                lang = m.owner[best] if len(m.owner) else np.full(len(group), len(names) - 1)
                known = np.isin(np.arange(len(group)), owner) & bool(len(m.owner))
                out = known & (top < m.radius[lang] if len(m.owner) else False)
                lang = np.where(known & ~(out & reject), lang, len(names) - 1)
                found += [names[i] for i in lang]
                scores += np.where(known, np.clip(top, 0, 1), 0.0).tolist()
                far += out.tolist()
            yield pa.RecordBatch.from_pydict({key: rows["key"], "lang_pred": pa.array(found, pa.string()), "score": pa.array(scores, pa.float64()), "rejected": pa.array(far, pa.bool_())})

    return docs.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, rejected boolean")
