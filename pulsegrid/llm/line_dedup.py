"""Exact line deduplication over documents, by DataFrame operations only.

Lines become 128-bit hashes. They are range-partitioned by hash and a salt of the document, sorted within by document
and position, and the first occurrence of each run is streamed over the rest (a running first value). Only the first
document of each salt goes on to a second pass without the salt, so a line that a third of all documents share is
spread over many tasks and meets in one as at most `salts` documents. What comes back is a compressed bitmap of
each document, as runs of kept lines; texts are not shuffled by line.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
LEAST, SALTS = 10, 256


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), ascii_uppercase, ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dropped_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, salts: int = SALTS) -> DataFrame:
    """(key, text_hash, drops): of each document that loses lines their sorted positions, from 0.

    A line goes if its key has `least` code points or more and some smaller document id has it too; within the smallest
    document all repeats stay. A null id counts as smaller than all others. Rows of equal id are one document.
    """
    lines = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    lines = lines.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("line")).where(F.char_length("line") >= least)
    lines = lines.select("doc", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"))
    streamed = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, 0)
    dealt = lines.repartitionByRange("h1", "h2", "salt").withColumn("first", F.first("doc").over(streamed))
    #: Lines that their own salt has decided keep their salt, so only the undecided ones (salt -1) meet.
    dealt = dealt.withColumn("salt", F.when(F.col("doc").eqNullSafe(F.col("first")), F.lit(-1)).otherwise(F.col("salt"))).drop("first")
    dealt = dealt.withColumn("first", F.first("doc").over(streamed)).where((F.col("salt") >= 0) | ~F.col("doc").eqNullSafe(F.col("first")))
    return dealt.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("drops")).withColumnRenamed("doc", key)


def keep_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, salts: int = SALTS) -> DataFrame:
    """Every row of docs, all its columns, and in struct `dedup`: n_lines, n_dropped, keep (runs: start, n) and lines.

    The runs are the document's bitmap of kept lines, run-length coded. A null or empty text is one empty line, which
    stays. Columns of docs may have any names but `dedup`. An empty table gives an empty result.
    """
    drops = dropped_lines(docs, key=key, text=text, least=least, salts=salts).select(F.struct(F.col(key).alias("key"), "text_hash", "drops").alias("_d"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), _lines(F.col(text)).alias("_lines"))
    both = rows.join(drops, F.col("_key").eqNullSafe(F.col("_d.key")) & (F.col("_hash") == F.col("_d.text_hash")), "left")
    dropped = F.coalesce("_d.drops", F.array().cast("array<int>"))
    ends, begins = F.concat(dropped, F.array(F.size("_lines"))), F.concat(F.array(F.lit(-1)), dropped)
    runs = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n"))), lambda r: r.n > 0)
    return both.select("_row.*", F.struct(F.size("_lines").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), runs.alias("keep"), F.col("_lines").alias("lines")).alias("dedup"))


def kept_text(dedup: str = "dedup") -> Column:
    """The text that a bitmap keeps; empty if it keeps no line."""
    return F.array_join(F.flatten(F.transform(f"{dedup}.keep", lambda r: F.slice(F.col(f"{dedup}.lines"), r.start + 1, r.n))), "\n")
