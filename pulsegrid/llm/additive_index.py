"""Approximate nearest neighbours by additive quantisation.

A vector's direction is approximated by the sum of one word of each of several full-dimensional codebooks; encoding keeps a
beam of the best partial sums. Kept are the codes and the vector's norm by that of the sum. A query scores all codes by adding
entries of its table of inner products, and the best of each block are scored exactly in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import scratch, settle

BOOKS, WORDS, BEAM = 16, 256, 3
#: Codebooks are fitted on at most this many vectors, those of the smallest hashes of their ids; every vector is encoded.
MOST_FITTED, ROUNDS = 8192, 6
RERANK, ROWS, QUERIES = 400, 32_768, 1024
MOST_LENGTHS = 64
#: So many queries of a block are scored together, and rows of a block at a time.
TOGETHER, AT_ONCE = 64, 2048


def _residual_words(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
        c[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return c


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS) -> np.ndarray:
    """(books, words, dimensions): each codebook is fitted to what the ones before leave of x."""
    rng, out, rest = np.random.default_rng(1), [], x.astype(np.float32).copy()
    for _ in range(books):
        c = _residual_words(rest, words, rng)
        rest -= c[np.argmax(rest @ c.T - 0.5 * (c * c).sum(1), axis=1)]
        out.append(c)
    return np.array(out)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, and the norms in double precision, of vectors of any finite size."""
    top = np.abs(x).max(axis=1, keepdims=True)
    top[top == 0] = 1
    length = np.linalg.norm(x / top, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        norm = np.minimum(top * length, 1e300)[:, 0]
    return (x / top / np.maximum(length, 1e-300)).astype(np.float32), norm


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and the scale of each: the norm of the vector by that of its sum."""
    m, k, d = books.shape
    x, length = directions(x)
    half = 0.5 * np.einsum("mkd,mkd->mk", books, books)
    codes, rest = np.zeros((len(x), 1, 0), np.int64), x[:, None, :]
    for level in range(m):
        size = 0.5 * np.einsum("nbd,nbd->nb", rest, rest)
        step = half[level] - (rest.reshape(-1, d) @ books[level].T).reshape(len(x), -1, k) + size[:, :, None]  # half the squared distance
        flat = step.reshape(len(x), -1)
        picked, n = [], np.arange(len(x))
        for _ in range(min(beam, flat.shape[1])):
            picked.append(np.argmin(flat, axis=1))
            flat[n, picked[-1]] = np.inf
        best = np.stack(picked, axis=1)  # nearest first
        codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
        rest = np.take_along_axis(rest, (best // k)[:, :, None], axis=1) - books[level][best % k]
    own = codes[:, 0]
    norm = np.linalg.norm(books[np.arange(m), own].sum(axis=1), axis=1)
    return own.astype(np.uint8), length / np.maximum(norm, 1e-9)


def search_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, scale: np.ndarray, books: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's best of a block whose ids ascend: the table's `rerank` best, scored exactly. Ties go to smaller ids."""
    m, words, d = books.shape
    wide = codes.astype(np.intp).T.copy()
    for first in range(0, len(query_ids), TOGETHER):
        group, _ = directions(queries[first : first + TOGETHER])
        tables = (books.reshape(-1, d) @ group.T).reshape(m, words, len(group))
        scores = np.empty((len(group), len(ids)))
        for a in range(0, len(ids), AT_ONCE):
            near = tables[0].take(wide[0, a : a + AT_ONCE], axis=0)
            for j in range(1, m):
                near += tables[j].take(wide[j, a : a + AT_ONCE], axis=0)
            scores[:, a : a + AT_ONCE] = (near * scale[a : a + AT_ONCE, None]).T
        for q_id, q, near in zip(query_ids[first : first + TOGETHER].tolist(), queries[first : first + TOGETHER], scores, strict=True):
            near[ids == q_id] = -np.inf
            if len(near) > rerank:
                least = np.partition(near, -rerank)[-rerank]
                above = np.flatnonzero(near > least)
                chosen = np.concatenate([above, np.flatnonzero(near == least)[: rerank - len(above)]])  # of equal ones those of smaller ids
            else:
                chosen = np.arange(len(near))
            chosen = chosen[ids[chosen] != q_id]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = x[chosen].astype(np.float64) @ q
            best = np.lexsort((ids[chosen], -np.nan_to_num(exact, nan=-np.inf)))[:top]
            yield q_id, ids[chosen][best], exact[best]


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part: no null id, vector or component, all finite, not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda c: c != 0)).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def neighbours(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", top: int = 20, rerank: int = RERANK, rows: int = ROWS, per_query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, key, score) of each query's `top` nearest among all other vectors, by inner product.

    Null, zero and non-finite vectors take no part. Vectors of different lengths are searched apart, each length with codebooks of
    its own; beyond MOST_LENGTHS of them the results of one are written before the next is searched, so that plans stay short. Rows of equal id are candidates each; of several query rows of one id the
    smallest vector asks, once. Codebooks are fitted on a bounded sample and sent to all tasks (of fixed size:
    books * words * dimensions); all vectors are encoded. Queries and candidates meet as blocks of bounded size, of which each
    gives `top` exactly scored rows a query. With no vector there is no row.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double".replace("vec_id", f"`{key}`")
    every = valid(vectors, key, vector)
    asked = valid(queries, key, vector).groupBy(F.size("v").alias("d"), "id").agg(F.min("v").alias("v"))
    sizes = sorted(every.groupBy(F.size("v").alias("d")).count().collect())  # as many rows as there are lengths
    search = lambda d, n: _of_length(every.where(F.size("v") == d), asked.where(F.col("d") == d).select("id", "v"), d, n, key, top, rerank, rows, per_query_block)
    out = spark.createDataFrame([], schema)
    if len(sizes) <= MOST_LENGTHS:
        for d, n in sizes:
            out = out.unionByName(search(d, n))
        return out
    path = scratch(spark, "nearest")
    for d, n in sizes:
        search(d, n).write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _of_length(every: DataFrame, asked: DataFrame, d: int, n: int, key: str, top: int, rerank: int, rows: int, per_query_block: int) -> DataFrame:
    """neighbours() among the n vectors (id, v) of length d."""
    spark, schema = every.sparkSession, f"query_id long, rank int, `{key}` long, score double"
    sample = every.orderBy(F.xxhash64("id", "v"), "id").limit(MOST_FITTED).groupBy().applyInPandas(lambda g: pd.DataFrame({"b": [fit(directions(np.array(g.sort_values("id")["v"].tolist(), float))[0]).tobytes()]}), "b binary")
    sent = spark.sparkContext.broadcast(np.frombuffer(sample.first()["b"], np.float32).reshape(BOOKS, WORDS, d))

    def blocks(data: DataFrame, most: int, coded: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def done(part: list) -> pa.RecordBatch:
                ids, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                out = {"ids": [ids.astype("<i8").tobytes()], "x": [x.astype("<f8").tobytes()]}
                if coded:
                    parts = [encode(x[i : i + 512], sent.value) for i in range(0, len(x), 512)]
                    out |= {"codes": [np.concatenate([p[0] for p in parts]).tobytes()], "scale": [np.concatenate([p[1] for p in parts]).tobytes()]}
                return pa.RecordBatch.from_pydict(out)

            for batch in batches:
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)
                while len(ids):
                    room = most - sum(len(p[0]) for p in held)
                    held.append((ids[:room], x[:room]))
                    ids, x = ids[room:], x[room:]
                    if len(held[-1][0]) == room:
                        yield done(held)
                        held = []
            if held:
                yield done(held)

        dealt = data.repartition(-(-n // most) if coded else max(1, -(-n // (20 * most))), F.xxhash64("id"))
        made = dealt.mapInArrow(run, "ids binary, x binary" + ", codes binary, scale binary" * coded)
        return settle(made.withColumn("no", F.monotonically_increasing_id()), "blocks")

    rows_, asked_ = blocks(every, rows, True), blocks(asked, per_query_block, False)
    other = [[r["no"] for r in x.select("no").collect()] for x in (asked_, rows_)]  # a number for each block
    if not other[0]:
        return spark.createDataFrame([], schema)
    left = rows_.select("no", "ids", "x", "codes", "scale", F.explode(F.lit(other[0])).alias("of"))
    right = asked_.select(F.col("no").alias("of"), F.col("ids").alias("q_ids"), F.col("x").alias("q"), F.explode(F.lit(other[1])).alias("no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, codes, scale, q_ids, q = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate(("<i8", "<f8", np.uint8, "<f8", "<i8", "<f8")))
                found = list(search_block(ids, x.reshape(-1, d), codes.reshape(-1, BOOKS), scale, sent.value, q_ids, q.reshape(-1, d), top, rerank))
                sizes = [len(f[1]) for f in found]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat([f[0] for f in found], sizes).astype(np.int64), "id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    met = left.hint("merge").join(right, ["of", "no"]).select("ids", "x", "codes", "scale", "q_ids", "q").mapInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias(key), "score")
