"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, backoff, decontaminate, gif, language, mixing, packing, quality, secrets, simhash, toxicity, trie, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.digest(table(spark, sf_dir, "documents"))


def op2_backoff_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.digest(table(spark, sf_dir, "documents"), order=3)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_backoff, op2_backoff_trigrams, op3_decontaminate, op4_mixing, op5_secrets, op6_gif, op7_toxicity, op8_warc, op9_language, op10_simhash, op11_prefix_trie, op12_filter_audit, op13_packing)
}

#: Models, images, fingerprints, schedules and spans are tested against brute force instead.
ORACLE_SQL = {"op2_backoff": backoff.ORACLE_SQL, "op2_backoff_trigrams": backoff.TRIGRAM_SQL, "op3_decontaminate": decontaminate.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL, "op11_prefix_trie": trie.ORACLE_SQL, "op12_filter_audit": audit.ORACLE_SQL}
