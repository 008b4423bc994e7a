"""The corpus pipeline: good documents, one of each near-duplicate group, sources mixed to their weights, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from opswell.llm import mixing, near_dups, packing, quality, queries
from opswell.session import scratch, tune
from opswell.sources.tables import Tables


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; it learns from the labels that are not held out.

    Null and empty texts are judged like others, repeated rows each; no documents give none.
    """
    return quality.good_documents(docs, queries.quality_labels(Tables(tune(spark), sf_dir)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % or more of its five-word shingles, directly or through others.

    Documents without words, null texts among them, are no group and stay.
    """
    tune(spark)
    return near_dups.one_of_each(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole copy of a document that the mix takes; documents without words are in no mix. Null sources are one."""
    tune(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; tokens as a checksum. Repeated rows are packed each."""
    tune(spark)
    rows = packing.pack(docs, queries.vocabulary())
    return rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("mix", mixed),
    ("pack", packed),
]

#: A learned network cannot be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written as Parquet and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return rows
        path = scratch(spark, f"pipeline-{name}")
        rows.write.parquet(path)
        docs = spark.read.parquet(path)
