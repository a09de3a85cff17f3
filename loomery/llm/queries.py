"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hamming, hpylm, langid, lines, media, neardup, packing, sharding, toxicity


def vocabulary_path() -> str:
    """Where the tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(spark, _table(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(spark, _table(spark, sf_dir, "documents"))


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDup(spark, words=3, percent=85).groups(_table(spark, sf_dir, "documents"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(spark, rows, rows.where(F.col("vec_id") % 20 == 0), k=10)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(spark, _table(spark, sf_dir, "documents"))


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.pages_without_boilerplate(spark, _table(spark, sf_dir, "pages"))


def op7_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"), vocabulary_path())


def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(spark, _table(spark, sf_dir, "documents"), vocabulary_path())


def op10_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_stratified_interleaving, op2_mpeg_audio, op3_circulant_minhash, op4_multi_index_hashing, op5_pitman_yor, op6_site_lines, op7_lexicon_automata, op8_vector_packing, op9_trie_bpe, op10_hyperdimensional_langid]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_stratified_interleaving": sharding.ORACLE_SQL,
        "op4_multi_index_hashing": hamming.ORACLE_SQL,
        "op6_site_lines": lines.ORACLE_SQL,
    }
