"""Choosing and matching rows: cases in a chain of exclusion, and two runs whose identifiers differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import row_hash


def chain(rows: DataFrame, by: list[str], key: list[str], cases: dict[str, Column]) -> DataFrame:
    """(by, caso, key): for each case in order, the first row by key that meets it and that no case before has taken; cases without one are left out.

    As a case can lose no more rows than there are cases before it, the first so many of each are enough: they are found in one pass (ranked within tasks before anything is
    shuffled), and folded in order over one small array for each group. A key that repeats is one.
    """
    n = len(cases)
    met = F.array_compact(F.array(*[F.when(cond, F.lit(i)) for i, cond in enumerate(cases.values())]))
    each = rows.select(*by, F.struct(*key).alias("__k"), F.explode(met).alias("__i"))
    first = each.withColumn("__n", F.dense_rank().over(Window.partitionBy(*by, "__i").orderBy("__k"))).where(F.col("__n") <= n)
    one = first.groupBy(*by).agg(F.collect_set(F.struct("__i", "__k")).alias("__c"))
    kind = first.schema["__k"].dataType.simpleString()
    start = F.array().cast(f"array<struct<__i:int,__k:{kind}>>")

    def step(taken: Column, i: Column) -> Column:
        free = F.filter(F.col("__c"), lambda c: (c["__i"] == i) & ~F.exists(taken, lambda t: t["__k"] == c["__k"]))
        return F.when(F.size(free) == 0, taken).otherwise(F.concat(taken, F.array(F.array_min(free))))

    chosen = one.select(*by, F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)).alias("__x"))
    names = F.array(*[F.lit(c) for c in cases])
    return chosen.select(*by, F.get(names, F.col("__x.__i")).alias("caso"), *[F.col(f"__x.__k.{c}").alias(c) for c in key])


def paired(a: DataFrame, b: DataFrame, identifier: str, content: list[str], order: list[str] | None = None) -> DataFrame:
    """(id_a, id_b): identifiers of two runs that stand for the same content, one to one. Of rows with equal content the first pairs with the first, and so on, by ``order`` (what
    tells them apart, say a hash of what belongs to them) and then by identifier; those that the other run hasn't stay alone, with NULL on the other side."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("__h").orderBy(*(order or []), identifier))
        return df.withColumn("__h", row_hash(*content)).select("__h", place.alias("__n"), F.col(identifier).alias(name))

    return numbered(a, "id_a").join(numbered(b, "id_b"), ["__h", "__n"], "full").select("id_a", "id_b")


def renamed(rows: DataFrame, identifier: str, pairs: DataFrame) -> DataFrame:
    """rows of the second run under the identifiers of the first; those of identifiers that the first hasn't get NULL."""
    to = pairs.where("id_b is not null").select(F.col("id_b").alias("__b"), F.col("id_a").alias("__a"))
    return rows.join(to, F.col(identifier) == F.col("__b"), "left").withColumn(identifier, F.col("__a")).select(*rows.columns)
