"""The corpus pipeline: documents in, packed training sequences out.

Each stage gets what the one before it kept, as Parquet, works on all of it, and returns the columns of documents; the last returns the
pieces of the documents with their places in the training sequences. Ids of documents are taken to be unique in documents; the mix repeats rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm import exact_dedup, mixing, packing, quality, simhash
from snapledger.llm.common import read, remove_folder, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1; it learns from the labelled ones that aren't held out."""
    return quality.classify(docs, read(spark, sf_dir, "labels")).where("__predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that are equal without white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near-duplicates, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return packing.pack_documents(docs).withColumnRenamed("__id", "doc_id")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, XXH64 and the tokenizer have no form in SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages, rows go through Parquet in the shared folder, which are deleted when the next stage has been written.

    The packing stage has written its pieces before it returns, so the last of them can go too.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove_folder(spark, folder)
    return packed
