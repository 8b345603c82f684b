"""Indicators of a cut-off, compositions that close, shares and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The 14 indicators: a count and 13 sums.
SUMS: dict[str, str] = {
    "inscricao_proc": "proc", "inscricao_aproc": "aproc", "inscricao": "proc + aproc", "pago_proc": "pago_proc", "pago_aproc": "pago_aproc", "pagos": "pago_proc + pago_aproc",
    "estornos": "pago_proc_estornado + pago_aproc_estornado", "liquidado": "liquidado", "cancelados": "cancelado_aproc + cancelado_proc", "retencao": "retencao", "s1": "s1", "s2": "s2", "s3": "s3",
}


def indicators(records: DataFrame, by: list[str]) -> DataFrame:
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("registros"), *[F.expr(f"sum({e})").cast("long").alias(n) for n, e in SUMS.items()])


def only_if_all_present(per_entity: DataFrame, entities: DataFrame, by: list[str], values: list[str], entity: str = "entidade") -> DataFrame:
    """Roll-up of entities: sums where every required entity has rows, else NULL with the situation ``municipio_indisponivel``.

    Missing entities of the catalog are counted, never guessed to be zero.
    """
    required = entities.select(F.col(entity)).distinct().agg(F.count(F.lit(1)).alias("__required"))
    inside = per_entity.join(entities.select(F.col(entity)).distinct(), entity, "left_semi")
    summed = inside.groupBy(*by).agg(F.count_distinct(entity).alias("__present"), *[F.sum(v).cast("long").alias(v) for v in values]).crossJoin(F.broadcast(required))  # one row
    full = F.col("__present") == F.col("__required")
    return summed.select(*by, F.when(full, "com_dados").otherwise("municipio_indisponivel").alias("situacao"), (F.col("__required") - F.col("__present")).cast("long").alias("ausentes"), *[F.when(full, F.col(v)).alias(v) for v in values])


def by_dimension(records: DataFrame, by: list[str], dimension: Column, name: str) -> DataFrame:
    """Count, inscription and S1 by a dimension; NULL is a group."""
    return records.groupBy(*by, dimension.alias(name)).agg(F.count(F.lit(1)).alias("registros"), F.sum(F.col("proc") + F.col("aproc")).cast("long").alias("inscricao"), F.sum("s1").cast("long").alias("s1"))


def bands(records: DataFrame, by: list[str]) -> DataFrame:
    """Inscription by band; a record gives its processed part to one band and its not-processed part to another."""
    each = F.explode(F.array(F.struct(F.col("faixa_p").alias("faixa"), F.col("proc").alias("v")), F.struct(F.col("faixa_n").alias("faixa"), F.col("aproc").alias("v"))))
    return records.select(*by, each.alias("x")).where("x.faixa is not null").groupBy(*by, F.col("x.faixa").alias("faixa")).agg(F.count(F.lit(1)).alias("registros"), F.sum("x.v").cast("long").alias("inscricao"))


def with_fixed_groups(found: DataFrame, spark: SparkSession, points: DataFrame, by: list[str], name: str, domain: tuple[str, ...], values: list[str]) -> DataFrame:
    """found with every group of a fixed domain at every point, zero where a group has no records; NULL and groups outside the domain stay, so that the parts close."""
    groups = spark.createDataFrame([(d,) for d in domain], f"{name} string")
    grid = points.select(*by).distinct().crossJoin(F.broadcast(groups))  # times the few names of a domain
    joined = grid.join(found, [*by, name], "full")
    return joined.select(*by, name, *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values])


def closing(parts: DataFrame, totals: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sum of parts, total, and whether they close to the cent."""
    summed = parts.groupBy(*by).agg(F.sum(value).cast("long").alias("partes"))
    return totals.select(*by, F.col(value).alias("total")).join(summed, by, "left").select(*by, "total", F.coalesce("partes", F.lit(0)).alias("partes"), (F.coalesce("partes", F.lit(0)) == F.col("total")).alias("fecha"))


def top_with_rest(groups: DataFrame, by: list[str], name: str, value: str, top: int) -> DataFrame:
    """The top groups by value and the rest as one group ``demais (n grupos)``; all groups where there are at most top + 1."""
    window = Window.partitionBy(*by)
    ranked = groups.withColumn("__r", F.row_number().over(window.orderBy(F.col(value).desc(), F.col(name).asc_nulls_last()))).withColumn("__n", F.count(F.lit(1)).over(window))
    rest = (F.col("__n") > top + 1) & (F.col("__r") > top)
    label = F.when(rest, F.concat(F.lit("demais ("), (F.col("__n") - top).cast("string"), F.lit(" grupos)"))).otherwise(F.col(name).cast("string"))
    return ranked.groupBy(*by, label.alias("grupo")).agg(F.sum(value).cast("long").alias(value), F.min("__r").cast("long").alias("posicao"))
