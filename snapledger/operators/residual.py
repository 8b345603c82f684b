"""Differences between two sources, taken apart into known causes and what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of a difference, in the order in which they are tried.
AGREES, PROVEN, SWAP, PARTIAL, UNKNOWN = "concorda", "causa_comprovada", "regra_de_classificacao", "causa_parcial", "sem_causa"
#: The part of a difference that its pair of columns cancels out.
SWAP_CAUSE = "troca de soma zero"
_PART = "array<struct<causa:string,valor:bigint>>"


def gathered(causes: DataFrame, key: list[str], order: str, name: str, amount: str) -> DataFrame:
    """One row for each key: causas, its causes (name, amount) in order; those of amount NULL or 0 are no causes. A key has as many as the catalog of causes has kinds."""
    own = causes.where(F.coalesce(F.col(amount), F.lit(0)) != 0).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("causa"), F.col(amount).cast("long").alias("valor")))).alias("c"))
    return own.select(*key, F.transform("c", lambda x: F.struct(x["causa"].alias("causa"), x["valor"].alias("valor"))).alias("causas"))


def fold(difference: Column, causes: Column) -> Column:
    """struct(resto, tomadas): causes in order, each taken off what the ones before it have left if that brings it nearer to zero."""
    start = F.struct(difference.cast("long").alias("resto"), F.array().cast(_PART).alias("tomadas"))

    def step(state: Column, cause: Column) -> Column:
        left = state["resto"] - cause["valor"]
        taken = F.struct(left.alias("resto"), F.concat(state["tomadas"], F.array(cause)).alias("tomadas"))
        return F.when(F.abs(left) < F.abs(state["resto"]), taken).otherwise(state)

    return F.aggregate(F.coalesce(causes, F.array().cast(_PART)), start, step)


def classify(differences: DataFrame, causes: DataFrame, key: list[str], value: str = "diferenca", swapped: str | None = None) -> DataFrame:
    """differences with classe, tomadas (the causes taken and their amounts) and resto; the amounts and the rest always sum to the difference.

    causes has one row for each key (``gathered``). A difference that its causes make up whole is proven; else one that a paired column cancels to the cent (column
    ``swapped``) is a matter of classification, taken whole; else causes may make up a part of it; else it has none. A NULL difference has no class and nothing left.
    """
    d = F.col(value)
    swap = F.coalesce(F.col(swapped), F.lit(False)) if swapped else F.lit(False)
    joined = differences.join(causes, key, "left").withColumn("__f", fold(d, F.col("causas")))
    rest, taken = F.col("__f.resto"), F.col("__f.tomadas")
    whole = F.array(F.struct(F.lit(SWAP_CAUSE).alias("causa"), d.cast("long").alias("valor")))
    kind = F.when(d == 0, AGREES).when(rest == 0, PROVEN).when(swap & d.isNotNull(), SWAP).when(F.size(taken) > 0, PARTIAL).when(d.isNotNull(), UNKNOWN)
    out = joined.withColumn("classe", kind)
    is_swap = F.col("classe") == SWAP
    return out.select(*differences.columns, "classe", F.when(is_swap, whole).when(F.col("classe") == AGREES, F.array().cast(_PART)).otherwise(taken).alias("tomadas"), F.when(is_swap, F.lit(0).cast("long")).otherwise(rest).alias("resto"))


def cancelled_by_pair(differences: DataFrame, by: list[str], column: str, value: str, pairs: list[tuple[str, str]], out: str = "trocada") -> DataFrame:
    """differences with whether the paired column of the same point differs by the opposite amount. One aggregate of the paired columns for each point, joined back."""
    at = lambda c: F.max(F.when(F.col(column) == c, F.col(value)))
    wide = differences.groupBy(*by).agg(*[at(c).alias(f"__{c}") for p in pairs for c in p])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce((F.col(f"__{x}") != 0) & (F.col(f"__{x}") == -F.col(f"__{y}")), F.lit(False)).alias("s")) for x, y in pairs for c in (x, y)]))
    flags = wide.select(*by, each.alias("f")).select(*by, F.col("f.c").alias(column), F.col("f.s").alias(out))
    return differences.join(flags, [*by, column], "left").withColumn(out, F.coalesce(out, F.lit(False)))
