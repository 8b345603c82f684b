"""A stored table of which a batch rewrites the partitions it touches, with proof that the others are what they were."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import table_hash
from .store import publish, published, remove, write_text, read_text

#: Situations of a partition after a batch; the last two refuse it.
SAME, CHANGED, NEW, COLLATERAL, LOST = "igual", "alterada pelo lote", "nova", "alterada fora do lote", "sumida"


def _leaf(by: list[str], row) -> str:
    return "/".join(f"{c}={row[c]}" for c in by)


def _parts(spark: SparkSession, root: str) -> dict[str, str]:
    """Partition and the version of it that counts, as the published list says. It has one line for each partition of the table, so the driver can hold it."""
    name = published(spark, root)
    return {} if name is None else dict(line.split("\t") for line in read_text(spark, f"{root}/_lists/{name}").splitlines())


def write_partitions(spark: SparkSession, root: str, rows: DataFrame, by: list[str]) -> set[str]:
    """Write rows as new versions of the partitions they are in, and publish the list that names them; every other partition keeps its files. Returns the partitions written.

    Readers see the list before or after, never a part. A partition's old versions stay until ``prune``.
    """
    version, before = uuid.uuid4().hex, _parts(spark, root)
    spread = rows.hint("rebalance", *by).withColumn("__v", F.lit(version))
    spread.write.mode("append").partitionBy(*by, "__v").parquet(f"{root}/rows")
    written = {_leaf(by, r) for r in spark.read.parquet(f"{root}/rows").where(F.col("__v") == version).select(*[F.col(c).cast("string") for c in by]).distinct().collect()}
    after = before | {p: version for p in written}
    name = uuid.uuid4().hex
    write_text(spark, f"{root}/_lists/{name}", "\n".join(f"{p}\t{v}" for p, v in sorted(after.items())))
    publish(spark, root, name)
    return written


def read_partitions(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The table, from the files of the partitions' versions that count; filters on partitions prune them."""
    paths = [f"{root}/rows/{p}/__v={v}" for p, v in _parts(spark, root).items()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(*paths)


def prune(spark: SparkSession, root: str, versions: set[str]) -> int:
    """Delete versions of partitions that no longer count, of those given; how many folders went."""
    gone = [f"{root}/rows/{p}/__v={v}" for p, now in _parts(spark, root).items() for v in versions if v != now]
    return sum(remove(spark, path) for path in gone)


def fingerprints(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, linhas, hash) of each partition, the same whatever the files, their order and their number."""
    return table_hash(rows, columns, by)


def proof(before: DataFrame, after: DataFrame, touched: DataFrame, by: list[str]) -> DataFrame:
    """Each partition with its situation: by stored fingerprints before the batch, fingerprints after it, and the partitions that the batch says it touches.

    A partition that differs though the batch doesn't touch it, or is there no more, is a side effect; the batch is refused unless ``holds``.
    """
    a = before.select(*by, F.col("linhas").alias("linhas_antes"), F.col("hash").alias("a"))
    b = after.select(*by, F.col("linhas").alias("linhas_depois"), F.col("hash").alias("b"))
    both = a.join(b, by, "full").join(touched.select(*by, F.lit(True).alias("tocada")).distinct(), by, "left")
    kind = F.when(F.col("b").isNull(), LOST).when(F.col("a").isNull() & F.col("tocada").isNull(), COLLATERAL).when(F.col("a").isNull(), NEW)
    kind = kind.when(F.col("a") == F.col("b"), SAME).when(F.col("tocada").isNull(), COLLATERAL).otherwise(CHANGED)
    return both.select(*by, "linhas_antes", "linhas_depois", kind.alias("situacao"))


def holds(found: DataFrame) -> bool:
    return found.where(F.col("situacao").isin(COLLATERAL, LOST)).limit(1).count() == 0
