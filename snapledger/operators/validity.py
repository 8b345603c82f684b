"""Which snapshot counts: current, as it was on an instant, newest though refused, changes between snapshots, repeated keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The row with the greatest order of each key, as one aggregation (no sort, map-side part); NULL in an order column loses."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("__b")
    return rows.groupBy(*by).agg(best).select(*by, *[F.col(f"__b.{v}").alias(v) for v in values])


def current(snapshots: DataFrame, by: list[str], order: list[str], values: list[str], complete: Column, refused: DataFrame | None = None, uid: str = "uid", em: Column | None = None, concluded: str = "concluida_em") -> DataFrame:
    """The valid snapshot of each cut-off: complete, not refused, concluded by ``em`` if given (without a conclusion: never), newest."""
    found = snapshots.where(complete)
    if em is not None:
        found = found.where(F.col(concluded).isNotNull() & (F.col(concluded) <= em))
    if refused is not None:
        found = found.join(refused.select(uid), uid, "left_anti")
    return latest(found, by, order, values)


def as_of(snapshots: DataFrame, instants: DataFrame, by: list[str], concluded: str, order: list[str], values: list[str]) -> DataFrame:
    """For each instant (column em, a short list), the latest snapshot of each key concluded by then.

    Every snapshot goes to the first instant at or after its conclusion only; the best of each (key, instant) is found there and then
    carried forward over the few instants, so that history isn't multiplied by the instants.
    """
    grid = F.broadcast(instants.agg(F.array_sort(F.collect_list("em")).alias("__at")))
    first = snapshots.crossJoin(grid).withColumn("em", F.try_element_at(F.filter("__at", lambda e: e >= F.col(concluded)), F.lit(1))).where("em is not null")
    best = first.groupBy(*by, "em").agg(F.max(F.struct(*order, F.struct(*values).alias("__v"))).alias("__b"))
    keys = best.select(*by).distinct().crossJoin(F.broadcast(instants.select("em")))
    carried = F.max("__b").over(Window.partitionBy(*by).orderBy("em").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return keys.join(best, [*by, "em"], "left").withColumn("__b", carried).where("__b is not null").select(*by, "em", *[F.col(f"__b.__v.{v}").alias(v) for v in values])


def newest_refused(snapshots: DataFrame, by: list[str], order: list[str], uid: str, refused: Column) -> DataFrame:
    """Cut-offs whose newest snapshot is refused, with the snapshot that counts instead (NULL if none)."""
    key = F.struct(*order)
    ends = snapshots.groupBy(*by).agg(F.max_by(uid, key).alias("mais_novo"), F.max_by(refused, key).alias("__r"), F.max_by(F.when(~refused, F.col(uid)), F.when(~refused, key)).alias("vigente"))
    return ends.where("__r").drop("__r")


def with_previous(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with the value before and the difference later - earlier; NULL at the first row or where either is NULL."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("anterior", before).withColumn("diferenca", F.col(value) - F.col("anterior"))


def repeated_keys(rows: DataFrame, key: list[str], content: Column) -> DataFrame:
    """Keys that occur more than once, exact (one content) or conflicting."""
    found = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("vezes"), F.count_distinct(content).alias("conteudos")).where("vezes > 1")
    return found.withColumn("tipo", F.when(F.col("conteudos") == 1, "exata").otherwise("conflitante"))


def occurrences(rows: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """rows with the number of each row among those of its key, by position."""
    return rows.withColumn("ocorrencia", F.row_number().over(Window.partitionBy(*key).orderBy(*position)).cast("long"))
