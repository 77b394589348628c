"""Tables that an iterative operator writes to the folder that driver and executors share (spark.checkpoint.dir) and reads again."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; only a local session may leave spark.checkpoint.dir unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _of_local_session()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _of_local_session() -> str:
    return tempfile.mkdtemp(prefix="pulsegrid-core-")


def kept(table: DataFrame, name: str) -> DataFrame:
    """table, written and read again: its lineage ends there, so rounds stay short and a lost executor repeats only its own round."""
    at = path(table.sparkSession, name)
    table.write.parquet(at)
    return table.sparkSession.read.schema(table.schema).parquet(at)
