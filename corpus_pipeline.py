"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontaminate, mixing, quality, secrets, simhash
from tidewater.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the classifier learns from ``labels`` as far as these have a text in ``docs``.

    Null and empty texts are scored like any other, repeated rows are judged alike, and without labels all stay.
    """
    return quality.good_enough(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document, that with the smallest id; null ids come last, and blank texts are one group.

    Documents that share an id but are no near-duplicates all stay.
    """
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that ``benchmark`` covers to a twentieth or more go; shorter matches are cut out of the others.

    Null and empty texts have none and stay, repeated rows are judged alike, texts are read whole; an empty table stays empty, and without items nothing changes. Columns keep
    their names and order, whatever they are called.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind.

    Null texts stay null, repeated rows are scanned alike, texts are read whole; an empty table stays empty. Columns keep their names and order, whatever they are called.
    """
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each pass in which a document is used, with the text that is used there, how many words that are and the slots that they are laid into.

    A source that has to give more words than it has is used twice; the document at which a pass ends is cut. Documents without words are not part of it. A null source is one of its
    own, repeated rows are documents of their own, and an empty table gives no rows. Added columns get underscores before names that ``docs`` has.
    """
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: A fitted model and fingerprints are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
