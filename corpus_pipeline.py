"""The corpus pipeline: documents, through five of the operators, to training windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import jaccard, mixing, packing, pii, quality
from pagewright.llm.columns import quoted
from pagewright.session import delete, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry scores accept; the model learns from labelled ones of the documents given."""
    return quality.accept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their private data redacted."""
    return pii.anonymise(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that bring the sources to their target weights."""
    kept = mixing.mix(docs)
    return kept.select(*[kept[quoted(c)] for c in docs.columns])


def training_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into windows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("mixing sources", source_mixture),
    ("packing", training_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's result is a table in the shared folder, read again by the next."""
    folder = scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs


#: Scores and spans of learned models have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
