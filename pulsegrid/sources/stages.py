"""What the stages of an analysis make, as Parquet tables in one folder, and its parameters and comments beside them.

A stage's rows lie in folder/stage/rows, by run of the stage and by span of time; folder/stage/index names the recordings of each run.
A recording's rows are those of the last run that names it. Rows are written before the index, so a run is seen whole or not at all,
and one that was killed leaves nothing but files that no one reads. Keys are columns of the files: no folder name is taken for a value.
"""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.functions import SECOND
from pulsegrid.operators.intervals import REC

#: Names that tables can have.
STAGES = ("signal", "power", "events", "masks", "bursts", "states", "diagnostics")
#: Length of a span of time, in microseconds.
SPAN = 3600 * SECOND
#: What can be noted about a recording under these names.
ALLOWED = {"polarity": ("neg", "pos", "mix"), "quality": ("free", "bad", "weak", "ok", "nice")}
#: How a stage's rows lie within a cutout: events and masks count at its borders, bursts and states have to reach into it.
CLOSED = {"events": True, "masks": True, "bursts": False, "states": False}


def _known(stage: str) -> None:
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")


def _begins(table: DataFrame) -> str | None:
    return next((c for c in ("start", "t") if c in table.columns), None)


def write_stage(table: DataFrame, folder: str, stage: str, parameters: dict | None = None, recordings: DataFrame | None = None, span: int = SPAN) -> None:
    """table as `stage` of folder. Recordings of the table are replaced, others stay; parameters are kept with it.

    Recordings (a table with rec_id) that are given are replaced too if they have no row. Rows with a time (start or t) are dealt
    by spans of `span` microseconds, so that a cutout reads only what it needs; a task sorts and writes rows of few spans, of one shuffled
    partition. Rows of a null recording are an error of the caller and are not kept.
    """
    _known(stage)
    spark, run, at = table.sparkSession, time.time_ns() // 1000, _begins(table)
    place = F.floor(F.col(at) / span).cast("long") if at else F.lit(0).cast("long")
    rows = table.where(F.col(REC).isNotNull()).withColumn("_span", F.coalesce(place, F.lit(0))).withColumn("_run", F.lit(run))
    rows.hint("rebalance", "_span").write.mode("append").partitionBy("_run", "_span").parquet(f"{folder}/{stage}/rows")
    written = spark.read.schema(rows.schema).parquet(f"{folder}/{stage}/rows").where(F.col("_run") == run)
    named = written.select(REC) if recordings is None else written.select(REC).unionByName(recordings.select(F.col(REC).cast(table.schema[REC].dataType)))
    reach = written.groupBy(REC).agg(F.max(F.col("stop") - F.col("start")).alias("longest")) if {"start", "stop"} <= set(table.columns) else None
    index = named.distinct()
    index = index.join(reach, REC, "left") if reach is not None else index.withColumn("longest", F.lit(0).cast("long"))
    index.select(REC, F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), F.lit(run).alias("run"), F.lit(span).cast("long").alias("span"), F.lit(table.schema.json()).alias("columns")).write.mode("append").parquet(f"{folder}/{stage}/index")
    if parameters is not None:
        note(spark, folder, stage, "parameters", json.dumps(parameters, sort_keys=True))


def _index(spark: SparkSession, folder: str, stage: str) -> tuple[DataFrame, StructType]:
    """(the last run of each recording, the columns of the last run)."""
    _known(stage)
    index = spark.read.parquet(f"{folder}/{stage}/index")
    columns = StructType.fromJson(json.loads(index.agg(F.max_by("columns", "run")).first()[0]))
    last = index.groupBy(REC).agg(F.max(F.struct("run", "longest", "span")).alias("_l"))
    return last.select(F.col(REC).alias("_rec"), "_l.run", "_l.longest", "_l.span"), columns


def _rows(spark: SparkSession, folder: str, stage: str, columns: StructType) -> DataFrame:
    return spark.read.schema(StructType([*columns.fields]).add("_run", "long").add("_span", "long")).parquet(f"{folder}/{stage}/rows")


def read_stage(spark: SparkSession, folder: str, stage: str, recordings: list | None = None) -> DataFrame:
    """The table of a stage, of all recordings or of some, with the types it was written with."""
    last, columns = _index(spark, folder, stage)
    rows = _rows(spark, folder, stage, columns)
    if recordings is not None:
        last, rows = last.where(F.col("_rec").isin(*recordings)), rows.where(F.col(REC).isin(*recordings))
    return rows.join(last, (F.col(REC) == F.col("_rec")) & (F.col("_run") == F.col("run"))).select(*columns.names)


def cutout(spark: SparkSession, folder: str, stage: str, lo: int, hi: int, recordings: list | None = None) -> DataFrame:
    """The rows of a stage that lie in lo to hi (microseconds): only spans that can hold such a row are read.

    Events and masks count from border to border; bursts and states have to reach into the inside. The spans before lo that are read are
    as many as the longest row needs. A stage without times comes whole.
    """
    last, columns = _index(spark, folder, stage)
    rows = _rows(spark, folder, stage, columns)
    if recordings is not None:
        last, rows = last.where(F.col("_rec").isin(*recordings)), rows.where(F.col(REC).isin(*recordings))
    at = _begins(rows)
    if at:
        runs = [tuple(r) for r in last.groupBy("run").agg(F.max("longest"), F.min("span")).collect()]  # a row for each run of the stage
        parts = [(F.col("_run") == run) & F.col("_span").between((lo - longest) // span, hi // span) for run, longest, span in runs]
        own = F.lit(False)
        for p in parts:
            own = own | p
        rows = rows.where(own)
        if "stop" in columns.names and at == "start":
            rows = rows.where((F.col("start") <= hi) & (F.col("stop") >= lo) if CLOSED.get(stage, True) else (F.col("start") < hi) & (F.col("stop") > lo))
        else:
            rows = rows.where(F.col(at).between(lo, hi))
    return rows.join(last, (F.col(REC) == F.col("_rec")) & (F.col("_run") == F.col("run"))).select(*columns.names)


def cutouts(spark: SparkSession, folder: str, lo: int, hi: int, recordings: list | None = None) -> dict[str, DataFrame]:
    """The cutout of every stage that the folder has."""
    out = {}
    for stage in STAGES:
        try:
            out[stage] = cutout(spark, folder, stage, lo, hi, recordings)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def note(spark: SparkSession, folder: str, subject: str, name: str, value: str) -> None:
    """A comment, quality mark or the like about a recording or stage. Notes are added, never changed; notes() has the last of each name."""
    if name in ALLOWED and value not in ALLOWED[name]:
        raise ValueError(f"{name} is one of {', '.join(ALLOWED[name])}, not {value}")
    row = spark.createDataFrame([(subject, name, value, time.time_ns())], "subject string, name string, value string, at long")
    row.coalesce(1).write.mode("append").parquet(f"{folder}/notes")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, name, value) as last noted; of two notes of one instant the larger value counts."""
    return spark.read.parquet(f"{folder}/notes").groupBy("subject", "name").agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def from_arrays(spark: SparkSession, signals: dict[str, np.ndarray], sr: float, length: int) -> DataFrame:
    """Chunks of signals in memory, as operators on signals take them."""
    rows = [(rec, k, k * length, float(sr), np.asarray(x[k * length : (k + 1) * length], float).tolist()) for rec, x in signals.items() for k in range(-(-len(x) // length))]
    return spark.createDataFrame(rows, f"{REC} string, chunk_id long, i0 long, sr double, v array<double>")
