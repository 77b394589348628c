"""What the operators of this subpackage share: scratch tables, bounded memos and slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one slice of documents holds at most, unless a single document is longer.
SLICE_CHARS = 1_000_000
#: With it Spark deletes the shuffle files of a job when the job has ended, not when the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    """Of a local session without a folder: driver and tasks are one process there."""
    return tempfile.mkdtemp(prefix="pulsegrid-")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Jobs within leave no shuffle files; afterwards the session is as it was."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    if (written := _written.get()) is not None:
        written.append(path)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distil(make: Callable[[], DataFrame | tuple[DataFrame, ...]], *names: str):
    """settle() of what make() returns, a frame for each name; tables that make() settled for itself are deleted then.

    Nothing but these frames may read the tables of make() later on.
    """
    own: list[str] = []
    token = _written.set(own)
    try:
        made = make()
    finally:
        _written.reset(token)
    out = [settle(df, name) for df, name in zip(made if len(names) > 1 else [made], names, strict=True)]
    spark = out[0].sparkSession
    for path in own:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out[0] if len(names) == 1 else tuple(out)


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows; otherwise the planner chooses a shuffled join."""
    with swept(df.sparkSession):
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5 (0: held out); a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5, F.lit(0))


class Memo(dict):
    """A dict that makes missing values and forgets those of two generations ago, so that its size stays bounded."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self.keep(key, value)
        return value


class Recent:
    """Values of strings, of those met again at most `most`, of those met once half as many; none of a string longer than `longest`.

    Strings met again are kept apart, so that many that occur once only don't drive them out.
    """

    def __init__(self, most: int, longest: int = 64):
        self.most, self.longest, self.kept, self.once = most, longest, {}, {}

    def find(self, name: str):
        value = self.kept.get(name)
        return self.once.get(name) if value is None else value

    def seek(self, names: list[str], learn: Callable[[list[str]], dict]) -> list:
        """The value of each of the names, which all differ; learn gives those of new ones. No value is None."""
        own = list(map(self.kept.get, names))
        if None not in own:
            return own
        lacking = [i for i, x in enumerate(own) if x is None]
        found = list(map(self.once.get, map(names.__getitem__, lacking)))
        made, again = learn([names[i] for i, x in zip(lacking, found, strict=True) if x is None]), {}
        for i, x in zip(lacking, found, strict=True):
            if x is None:
                own[i] = made[names[i]]
            else:
                own[i] = again[names[i]] = x
        if len(self.kept) + len(again) > self.most:
            self.kept.clear()
        self.kept.update(again)
        for name in again:
            del self.once[name]
        if len(self.once) + len(made) > self.most // 2:
            self.once.clear()
        self.once.update((k, v) for k, v in made.items() if len(k) <= self.longest)
        return own

    def forget(self) -> None:
        self.kept.clear(), self.once.clear()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_CHARS, together: int = 64) -> Iterator[tuple[dict, list[str]]]:
    """Of every batch, runs of at most `together` rows of about `most` characters: their columns as Arrow arrays, and the texts (null: empty)."""
    for batch in batches:
        texts = batch.column(text).to_pylist() if batch.num_rows <= together else None
        start = 0
        while start < batch.num_rows:
            if texts is None:
                end = min(batch.num_rows, start + together)
                run = batch.column(text).slice(start, end - start).to_pylist()
            else:
                end, run = batch.num_rows, texts
            at, size = 0, 0
            for i, t in enumerate(run):
                if size and size + len(t or "") > most:
                    yield _rows(batch, start + at, i - at), [x or "" for x in run[at:i]]
                    at, size = i, 0
                size += len(t or "")
            yield _rows(batch, start + at, len(run) - at), [x or "" for x in run[at:]]
            start = end


def _rows(batch: pa.RecordBatch, start: int, n: int) -> dict:
    return {name: batch.column(i).slice(start, n) for i, name in enumerate(batch.schema.names)}


def by_ranges(df: DataFrame, key: str, hash_: str, name: str = "_pid") -> tuple[DataFrame, int]:
    """df with the number of each row's range of (key, hash_), ascending, nulls first, and how many ranges there are.

    There is about a range for each shuffle partition. Bounds are quantiles of the key alone, so that texts are not read for
    them, and are literals in the plan, found by binary search: a task that is run again deals the same rows. A key that
    several quantiles fall on, and nulls, have as many ranges, cut by the hash (a long).
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema[key].dataType
    rows, nulls = df.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    found = df.where(F.col(key).isNotNull()).approxQuantile(key, [i / n for i in range(1, n)], 0.1 / n) if n > 1 and nulls < rows else []
    bounds, times = sorted(set(found)), Counter(found)
    parts = [max(1, -(-nulls * n // max(1, rows)))]  # of nulls, then from each bound on
    first = [0, parts[0]]  # the first range of nulls, and of keys below all bounds
    hot = {b: times[b] for b in bounds if times[b] > 1}
    steps: list[tuple[float, int, int]] = []  # from this key on: the first range, and into how many the hash cuts that very key
    at = first[1] + 1
    for b in bounds:
        cut = hot.get(b, 1)
        steps.append((b, at, cut))
        at += cut + (cut > 1)  # after a key of several ranges there is one for what follows it
    depth = max(1, len(steps).bit_length())
    size = (1 << depth) - 1
    filled = [*(b for b, _, _ in steps), *[None] * (size - len(steps))]
    array = F.array(*(F.lit(b).cast(kind) for b in filled))
    halves = F.array(*(F.lit(1 << i) for i in range(depth - 1, -1, -1)))
    place = F.aggregate(halves, F.lit(0), lambda lo, h: lo + F.when(F.get(array, lo + h - 1) <= F.col(key), h).otherwise(0))  # how many bounds are at or below the key
    starts = F.array(F.lit(first[1]), *(F.lit(s) for _, s, _ in steps))
    cuts = F.array(F.lit(1), *(F.lit(c) for _, _, c in steps))

    def of_hash(into: Column | int) -> Column:
        return F.floor(F.shiftrightunsigned(F.col(hash_).bitwiseXOR(F.lit(-(2**63))), 32) * into / 2**32).cast("int")

    there = df.withColumn("_at", F.when(F.col(key).isNotNull(), place))
    own = F.get(cuts, F.col("_at"))
    very = F.col(key) == F.get(array, F.col("_at") - 1)
    pid = F.get(starts, F.col("_at")) + F.when(own == 1, 0).when(very, of_hash(own)).otherwise(own)
    return there.withColumn(name, F.when(F.col(key).isNull(), of_hash(parts[0])).otherwise(pid)).drop("_at"), at
