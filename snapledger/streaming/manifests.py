"""Manifests as a stream: an extension beside the batch engine, with a collection's conclusion as event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COLLECTION = "uid string, entidade bigint, ex bigint, df string, status string, concluida_em timestamp, valor bigint"


def read_collections(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """New collection files of a folder; a uid that comes again within the watermark is dropped."""
    return spark.readStream.schema(COLLECTION).json(folder).withWatermark("concluida_em", late).dropDuplicatesWithinWatermark(["uid"])


def arrivals(stream: DataFrame, window: str = "1 day") -> DataFrame:
    """Collections per window of conclusion and status; windows close behind the watermark."""
    return stream.groupBy(F.window("concluida_em", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("coletas")).select(F.col("w.start").alias("inicio"), "status", "coletas")


def current(stream: DataFrame) -> DataFrame:
    """The running valid snapshot of each cut-off (update mode): the latest complete one, ties by uid."""
    best = F.max_by(F.struct("uid", "valor", "concluida_em"), F.struct("concluida_em", "uid"))
    return stream.where("status = 'completa'").groupBy("entidade", "ex", "df").agg(best.alias("b")).select("entidade", "ex", "df", "b.uid", "b.valor", "b.concluida_em")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new collections to a layer; available files only, so that a run ends."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
