"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import additive_index, conversation_repair, fingerprints, language_id, line_dedup, merkle, mixing, oracles, packing, quality, secret_scan, sentencepiece_codec, simhash_dedup, token_files
from pulsegrid.llm.common import fold


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_read(spark, sf_dir), tokenizer("piece_bpe_32k.model"), ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(_read(spark, sf_dir)).withColumn("taken", F.col("size") * F.col("copies"))
    runs = taken.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / 4096))))
    each = runs.withColumn("_", F.explode(F.sequence(F.col("_run") * 4096 + 1, F.least((F.col("_run") + 1) * 4096, "rows"))))
    return each.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    scored = quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_read(spark, sf_dir))
    names = F.array(*map(F.lit, (*secret_scan.KINDS, "format")))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    base = joined(F.filter("spans", lambda s: s.kind < len(secret_scan.KINDS)))
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir)
    found = language_id.predict(docs, language_id.fit(docs), reject=False)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(_read(spark, sf_dir), token_files.folder(spark), tokenizer("byte_bpe_50k.json"))
    return token_files.read(manifest, ids=False)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return additive_index.neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_ids(fingerprints.edit_likeness(_read(spark, sf_dir)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.keep_bitmaps(_read(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "dedup.n_lines", "dedup.n_dropped", F.sha2(line_dedup.kept_text().cast("binary"), 256).alias("kept_sha256"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_groups(_read(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf(text: Column) -> Column:
        return merkle.digest(*(merkle.field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))

    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(lower))
    rows = merkle.manifest(_read(spark, sf_dir), leaf(F.col("text")), carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(turns), every=turns)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir), tokenizer("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_mixing, op3_quality, op4_secrets, op5_language_id, op6_token_files, op7_nearest, op8_fingerprints, op9_line_dedup, op10_simhash_dedup, op11_merkle, op12_conversations, op13_packing)}

ORACLES: dict[str, str] = {
    "op9_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT e.*, coalesce(f.first_doc <> e.doc_id, false) AS gone FROM keyed e LEFT JOIN firsts f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_merkle": oracles.MERKLE,
    "op12_conversations": oracles.CONVERSATIONS,
}
