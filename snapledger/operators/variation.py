"""What changed between two cut-offs or snapshots: contributions, classes, ranked lists, differing fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def contributions(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer join by key: both values, the class, and later - earlier where an absent side gives nothing."""
    a = before.select(*key, F.col(value).alias("antes"))
    b = after.select(*key, F.col(value).alias("depois"))
    joined = a.join(b, key, "full")
    kind = F.when(F.col("antes").isNull(), "nova").when(F.col("depois").isNull(), "retirada").when(F.col("depois") > F.col("antes"), "aumentou").when(F.col("depois") < F.col("antes"), "reduziu").otherwise("igual")
    return joined.withColumn("classe", kind).withColumn("contribuicao", F.coalesce("depois", F.lit(0)) - F.coalesce("antes", F.lit(0)))


def groups(found: DataFrame, by: list[str], order: list[str], top: int) -> DataFrame:
    """Five exclusive groups: top increases, other increases, top reductions, other reductions, zero; counts and sums.

    The top of each sign is a ranking cut at ``top`` before the shuffle; the others are what the plain sums leave.
    """
    signed = found.withColumn("__s", F.signum(F.col("contribuicao")).cast("int"))
    measures = [F.count(F.lit(1)).alias("registros"), F.sum("contribuicao").cast("long").alias("soma")]
    every = signed.groupBy(*by, "__s").agg(*measures)
    rank = F.row_number().over(Window.partitionBy(*by, "__s").orderBy(F.abs("contribuicao").desc(), *order))
    best = signed.where("__s <> 0").withColumn("__k", rank).where(F.col("__k") <= top).groupBy(*by, "__s").agg(*measures)
    rest = every.unionByName(best.withColumns({"registros": -F.col("registros"), "soma": -F.col("soma")})).groupBy(*by, "__s").agg(F.sum("registros").alias("registros"), F.sum("soma").cast("long").alias("soma")).where("registros > 0")
    name = lambda up, down: F.when(F.col("__s") > 0, up).when(F.col("__s") < 0, down).otherwise("sem variação").alias("grupo")
    return best.select(*by, name("maiores aumentos", "maiores reduções"), "registros", "soma").unionByName(rest.select(*by, name("outros aumentos", "outras reduções"), "registros", "soma"))


def ranked(found: DataFrame, by: list[str], order: list[str], page: int) -> DataFrame:
    """The list of non-zero contributions, greatest first: rank, page, running total, total of the page, whether the page is the last.

    A prefix scan in two levels: rows are sorted into ranges over all lists at once, ranked and summed within their range, and each range starts where the counts
    and sums of the ranges before it end. So a list of any length is many tasks' work.
    """
    down = F.col("contribuicao").desc()
    sorted_rows = found.where("contribuicao <> 0").repartitionByRange(*by, down, *order)
    rows = cut(sorted_rows.withColumn("__p", F.spark_partition_id()))
    line = Window.partitionBy(*by, "__p").orderBy(down, *order)
    parts = rows.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"), F.sum("contribuicao").alias("__v"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__v0"), F.sum("__n").over(Window.partitionBy(*by)).alias("__all"))
    own = rows.withColumns({"__k": F.row_number().over(line), "__s": F.sum("contribuicao").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    placed = own.join(parts, [*by, "__p"]).withColumns({"posicao": (F.col("__n0") + F.col("__k")).cast("long"), "acumulado": (F.col("__v0") + F.col("__s")).cast("long")})
    placed = placed.withColumn("pagina", F.expr(f"(posicao - 1) div {page}"))
    whole = placed.withColumn("subtotal", F.sum("contribuicao").over(Window.partitionBy(*by, "pagina")).cast("long")).withColumn("ultima", (F.col("pagina") + 1) * page >= F.col("__all"))
    return whole.drop("__p", "__k", "__s", "__n0", "__v0", "__all")


def differing_fields(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row for each key and field that differs (NULL-safe); a key on one side only differs in all its fields from nothing."""
    side = lambda df, s: df.select(*key, F.lit(True).alias(f"__{s}"), F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f) for f in fields])).alias(f"m{s}"))
    joined = side(before, "a").join(side(after, "b"), key, "full")
    each = joined.select(*key, "__a", "__b", "ma", "mb", F.explode(F.array(*[F.lit(f) for f in fields])).alias("campo"))
    each = each.withColumn("antes", F.try_element_at("ma", F.col("campo"))).withColumn("depois", F.try_element_at("mb", F.col("campo")))
    kind = F.when(F.col("__a").isNull(), "novo").when(F.col("__b").isNull(), "removido").otherwise("alterado")
    return each.where(~F.col("antes").eqNullSafe(F.col("depois"))).select(*key, "campo", "antes", "depois", kind.alias("tipo"))


def impact(differences: DataFrame, by: list[str]) -> DataFrame:
    """Later - earlier by field, split by new, removed and changed records."""
    d = F.coalesce("depois", F.lit(0)) - F.coalesce("antes", F.lit(0))
    of = lambda t: F.coalesce(F.sum(F.when(F.col("tipo") == t, d)), F.lit(0)).cast("long")
    return differences.groupBy(*by, "campo").agg(F.count(F.lit(1)).alias("registros"), of("novo").alias("novos"), of("removido").alias("removidos"), of("alterado").alias("alterados"), F.sum(d).cast("long").alias("impacto"))
