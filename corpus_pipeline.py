"""The corpus pipeline: documents are filtered, deduplicated, mixed and tokenised; each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import line_dedup, mixing, quality, sentencepiece_codec, shingle_dedup
from pulsegrid.llm.common import distil
from pulsegrid.llm.queries import tokenizer


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    It learns from labelled documents outside the held-out fold. A null or empty text has the model's bias as its score; rows of
    equal text have equal scores, so copies stay or go together; a null id is never learned from. All columns of docs are returned as they are,
    whatever their names; an empty table stays empty.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, rest=True).where(F.col("score") >= quality.KEEP).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id has already; n_chars follows the text.

    A null id counts as smaller than all others; rows of one id are one document and keep their repeats. A null or empty text is one empty
    line and stays as it is (null remains null); a document may lose all its lines and then has an empty text. docs has doc_id, text and
    n_chars, and any others but `dedup`.
    """
    kept = line_dedup.keep_bitmaps(docs).withColumn("text", F.when(F.col("dedup.n_dropped") > 0, line_dedup.kept_text()).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(F.col("dedup.n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more.

    That of the smallest id stays, and every row of it; documents without an id link nothing and stay. Texts of fewer than five words are one
    shingle; null, empty and blank texts are alike and are copies of one another. Chains of links are one group.
    """
    return shingle_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat whole, with all their columns.

    A null source is a source of its own. A null text has no words and is taken at its source's rate; a source without any words is not taken. Equal rows share their
    fraction: the first of them get the further copies. Reruns on the same rows take the same documents.
    """
    return mixing.take(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of token digests for each document of the mix, repeats included. A null text is encoded as an empty one."""
    return sentencepiece_codec.encode(docs, tokenizer("piece_bpe_32k.model"), ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL expresses neither the classifier nor the fingerprints; tests/llm holds run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written as Parquet and read again, and deleted once the next is written."""

    def upto(k: int) -> DataFrame:
        if not k:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        name, stage = STAGES[k - 1]
        return distil(lambda: stage(spark, upto(k - 1), sf_dir), name)

    return upto(len(STAGES))
