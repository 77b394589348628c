"""Masks as text: a line `(start, stop)` in seconds for a stretch, and a number alone for a point; other lines are headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import SECOND

NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, stop, kind) of all mask files under path, in microseconds; kind is stretch or point. Empty files give no row."""
    line = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    a = F.regexp_extract("line", rf"^\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)$", 1)
    b = F.regexp_extract("line", rf"^\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)$", 2)
    one = F.regexp_extract("line", rf"^({NUMBER})$", 1)
    start, stop = F.when(a != "", a).when(one != "", one), F.when(b != "", b).when(one != "", one)
    found = line.select("file", start.alias("s"), stop.alias("e"), F.when(a != "", "stretch").otherwise("point").alias("kind")).where("s IS NOT NULL")
    return found.select("file", *(F.round(F.col(c).cast("double") * SECOND).cast("long").alias(n) for c, n in (("s", "start"), ("e", "stop"))), "kind")


def write_masks(masks: DataFrame, path: str, digits: int = 2) -> None:
    """One text table in that form, of masks (start, stop, kind)."""
    number = lambda c: F.format_string(f"%.{digits}f", F.col(c) / SECOND)
    text = F.when(F.col("kind") == "point", number("start")).otherwise(F.concat(F.lit("("), number("start"), F.lit(", "), number("stop"), F.lit(")")))
    masks.select(text.alias("value")).write.mode("overwrite").text(path)
