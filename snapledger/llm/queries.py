"""The registered queries of the corpus operators, one for each, over their whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, collocations, exact_dedup, fingerprints, language, mixing, packing, quality, rules, secrets, sharding, simhash, token_counts
from .common import read, remainder, shared_folder


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents")).withColumnRenamed("__id", "doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder() == 2).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs), F.col("text"))
    return found.select("doc_id", (remainder() == 2).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__lang_score").alias("score"), F.col("__rejected").alias("rejected"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), "fingerprint", "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(read(spark, sf_dir, "documents")).withColumnRenamed("__id", "doc_id")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), measures=rules.COUNTS)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), *rules.COUNTS, base_failed.alias("base_failed"), F.col("failed").isNull().alias("kept"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard": op1_shard,
    "op2_pack": op2_pack,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_fingerprint": op9_fingerprint,
    "op10_mix": op10_mix,
    "op11_collocations": op11_collocations,
    "op12_quality_rules": op12_quality_rules,
    "op13_clusters": op13_clusters,
}

#: DuckDB has neither Spark's array shuffle, zstd dictionaries, tokenizers, XXH64 nor gamma draws; those queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""",
    "op10_mix": mixing.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_quality_rules": rules.ORACLE,
    "op13_clusters": clustering.ORACLE,
}
