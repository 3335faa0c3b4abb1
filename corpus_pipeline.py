"""From raw documents to token ids of a training mix: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import bpe, exact_dedup, jaccard_join, mixing, quality_rules
from barloom.llm.common import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, whose trusted target are the documents labelled good; null and empty texts go."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id; rows without a doc_id come last, repeated rows become one."""
    return exact_dedup.keep_largest(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the one with the smallest doc_id; rows without a doc_id stay."""
    return jaccard_join.keep_smallest(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that every stretch has the sources by their target weights; a null source is one of its own."""
    return mixing.mixed(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position, doc_id, n_tokens, ids_sha256, decoded_sha256, in the order of the mix.

    docs are the files that the stage before wrote, whose rows are in the mix's order: position counts them.
    """
    at = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = at.groupBy("file").agg(F.count("*").alias("n"))
    # a row for each file; numbers of part files have five digits or more, so longer names come later
    before = sizes.select("file", (F.sum("n").over(Window.orderBy(F.length("file"), "file")) - F.col("n")).alias("before"))
    placed = at.join(F.broadcast(before), "file").select((F.col("before") + F.col("row")).alias("position"), "doc_id", "text")
    told = bpe.digests(bpe.encode(placed.select(F.col("position").alias("doc_id"), "text"))).withColumnRenamed("doc_id", "position")
    return placed.select("position", "doc_id").join(told, "position").orderBy("position")


STAGES = [
    ("quality_rules", good_documents),
    ("exact_dedup", distinct_documents),
    ("jaccard_join", unlike_documents),
    ("mixing", mixed_documents),
    ("bpe", encoded_documents),
]

#: SQL can express neither near-duplicate components of any size nor BPE: test_pipeline in tests/llm is a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
