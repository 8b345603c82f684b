"""Statements against computed values, explanations of differences, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(declared: DataFrame, computed: DataFrame, key: list[str], value: str = "valor") -> DataFrame:
    """declared against computed by key: both and computed - declared. A statement without a computed value keeps NULL, it isn't zero."""
    d = declared.select(*key, F.col(value).alias("declarado"))
    c = computed.select(*key, F.col(value).alias("calculado"))
    kind = F.when(F.col("calculado").isNull(), "sem valor calculado").when(F.col("calculado") == F.col("declarado"), "sem diferença").otherwise("diferença")
    return d.join(c, key, "left").withColumn("diferenca", F.col("calculado") - F.col("declarado")).withColumn("situacao", kind)


def explain(differences: DataFrame, catalog: DataFrame, wildcards: list[str], out: str = "explicacao") -> DataFrame:
    """Differences with the texts of all catalog rows that apply: the year is in the row's list, and every wildcard column is NULL or equal.

    The catalog's rows are spread over their years and met by year, so the join is an equi-join whatever its size. A zero
    difference is never looked up.
    """
    names = {c: f"__{c}" for c in catalog.columns}
    cat = catalog.withColumnsRenamed(names).withColumn("__ano", F.explode(F.array_distinct("__anos")))
    on = (F.col("__ano") == F.col("ex")) & (F.col("diferenca") != 0)
    for w in wildcards:
        on = on & (F.col(f"__{w}").isNull() | (F.col(f"__{w}") == F.col(w)))
    joined = differences.join(cat, on, "left")
    found = joined.groupBy(*differences.columns).agg(F.array_join(F.array_sort(F.collect_list("__texto")), "; ").alias(out), F.max("__certeza").alias("certeza"))
    return found.withColumn("situacao", F.when(F.col("diferenca") == 0, "sem diferença").when(F.col("certeza") == 2, "explicada").when(F.col("certeza") == 1, "hipótese").otherwise("não determinada"))


def summary(explained: DataFrame, by: list[str]) -> DataFrame:
    """All explained, some, only hypotheses, or none, over a set of differences."""
    differs = F.col("situacao") != "sem diferença"
    agg = explained.groupBy(*by).agg(
        F.count_if(differs).alias("diferencas"), F.count_if(F.col("situacao") == "explicada").alias("explicadas"), F.count_if(F.col("situacao") == "hipótese").alias("hipoteses")
    )
    kind = F.when(F.col("diferencas") == 0, "sem diferença").when(F.col("explicadas") == F.col("diferencas"), "explicada").when(F.col("explicadas") > 0, "parcialmente explicada").when(F.col("hipoteses") > 0, "hipótese").otherwise("não determinada")
    return agg.withColumn("situacao", kind)


def swaps(differences: DataFrame, by: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Points where two paired columns differ by opposite amounts: the sum moved from one to the other. One pass, no self join."""
    at = lambda c: F.max(F.when(F.col("coluna") == c, F.col("diferenca")))
    wide = differences.groupBy(*by).agg(*[at(c).alias(f"d_{c}") for p in pairs for c in p])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("de"), F.lit(y).alias("para"), F.col(f"d_{x}").alias("a"), F.col(f"d_{y}").alias("b")) for x, y in pairs]))
    return wide.select(*by, each.alias("s")).where("s.a <> 0 and s.a = -s.b").select(*by, "s.de", "s.para", F.col("s.a").alias("valor"))


def scope_decision(official: Column, portal: Column, own: Column, others: Column, until: int, year: Column) -> tuple[Column, Column]:
    """(treatment, situation) of an extra entity at a point, from two statements' inscriptions (NULL: no statement), the entity's own and that of all others.

    A statement proves that it includes the entity if what it has beyond the others is the entity's own, or that it excludes it if that is nothing. Two proofs that differ
    contradict each other (the official one counts); one proof is enough. Without any, the nearer treatment is probable if it misses by under five percent of the entity's
    own; else the earlier rule (included up to the year ``until``) stays, inconclusive.
    """
    proof = lambda s: F.when(s - others == own, "inclui").when(s - others == 0, "exclui")
    a, b = proof(official), proof(portal)
    rule = F.when(year <= until, "inclui").otherwise("exclui")
    out, inside = official - others, official - others - own
    near, left = F.when(F.abs(out) < F.abs(inside), "exclui").otherwise("inclui"), F.least(F.abs(out), F.abs(inside))
    probable = official.isNotNull() & (own != 0) & (20 * left < own)
    treatment = F.coalesce(a, b, F.when(probable, near), rule)
    situation = F.when(a != b, "contraditorio").when(a.isNotNull(), "comprovado").when(b.isNotNull(), "comprovado pelo portal").when(probable, "provavel").otherwise("inconclusivo")
    return treatment, situation


def coverage(expected: DataFrame, collected: DataFrame, read: DataFrame, key: list[str]) -> DataFrame:
    """Each expected document's situation: not collected, collected but unread, read in part, read. collected and read count parts."""
    j = expected.join(collected.select(*key, F.col("n").alias("c")), key, "left").join(read.select(*key, F.col("n").alias("r")), key, "left")
    kind = F.when(F.coalesce("c", F.lit(0)) == 0, "nao_coletado").when(F.coalesce("r", F.lit(0)) == 0, "coletado_sem_leitura").when(F.col("r") < F.col("c"), "lido_parcial").otherwise("lido")
    return j.select(*expected.columns, kind.alias("situacao"))
