"""Inquiries into statements: candidate sums, readings held against one another, absent cells, states before and after, notes and pendencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a statement line, and its identities as (result, what it must be).
CELLS = ("a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "L")
IDENTITIES = (("e", "a + b - c - d"), ("k", "f + g - i - j"), ("L", "e + k"))
#: What each column is held to be the sum of: whose tab (``p``: processed, ``n``: not processed), on which condition, which field.
CANDIDATES: dict[str, tuple[str, str, str]] = {
    "a": ("p", "anoempenho < ex - 1", "proc"), "b": ("p", "anoempenho = ex - 1", "proc"), "c": ("p", "true", "pago_proc"), "d": ("p", "aproc = 0", "cancelado_aproc"), "f": ("n", "anoempenho < ex - 1", "aproc"),
    "g": ("n", "anoempenho = ex - 1", "aproc"), "h": ("n", "true", "liquidado"), "i": ("n", "true", "pago_aproc"), "j": ("n", "true", "cancelado_aproc"),
}
TABS = {"p": "proc > 0", "n": "aproc > 0"}


def candidate(column: str) -> str:
    tab, condition, value = CANDIDATES[column]
    return f"CASE WHEN {TABS[tab]} AND {condition} THEN {value} ELSE 0 END"


def candidate_sums(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, coluna, candidato): every column's candidate sum and the two closings of them, from one aggregation."""
    wide = records.groupBy(*by).agg(*[F.expr(f"sum({candidate(c)})").cast("long").alias(c) for c in CANDIDATES])
    closed = wide.withColumns({"e": F.expr("a + b - c - d"), "k": F.expr("f + g - i - j")})
    return closed.unpivot(by, [*CANDIDATES, "e", "k"], "coluna", "candidato")


def zero_absent(wide: DataFrame) -> DataFrame:
    """Statement lines whose absent cells (NULL) are taken for zero if the line's own identities close so; else the line stays as it is and says which it lacks.

    Adds ``ausentes`` (names in order), ``falha`` (NULL for a good line): the absent cells if they don't close, or the first identity that doesn't hold.
    """
    absent = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in CELLS])), ",")
    known = wide.select("*", F.struct(*[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in CELLS]).alias("__z"), absent.alias("ausentes"))
    rule = lambda text: "".join(f"__z.{x}" if x in CELLS else x for x in text)
    broken = F.coalesce(*[F.when(F.col(f"__z.{r}") != F.expr(rule(t)), f"{r} = {t}") for r, t in IDENTITIES])
    fault = F.when((F.col("ausentes") != "") & broken.isNotNull(), F.concat(F.lit("ausentes sem fechar: "), "ausentes")).otherwise(broken)
    filled = known.withColumn("falha", fault)
    keep = F.col("falha").isNull() | (F.col("ausentes") == "")
    return filled.withColumns({c: F.when(keep, F.col(f"__z.{c}")).otherwise(F.col(c)) for c in CELLS}).drop("__z")


def cells_compared(read: DataFrame, declared: DataFrame, doc: list[str], cell: list[str]) -> DataFrame:
    """Documents' cells against a declaration's (column valor in both): how many were compared, how many differ, whether the document is equal. A zero that isn't declared is no difference; any other value that isn't is one."""
    j = read.join(declared.select(*doc, *cell, F.col("valor").alias("__d")), [*doc, *cell], "left")
    both, none = F.col("__d").isNotNull(), F.col("__d").isNull()
    differs = (both & (F.col("__d") != F.col("valor"))) | (none & (F.col("valor") != 0))
    agg = j.groupBy(*doc).agg(F.count_if(both).alias("comparadas"), F.count_if(differs).alias("diferentes"))
    return agg.withColumn("igual", (F.col("comparadas") > 0) & (F.col("diferentes") == 0))


def layouts_validated(rule: DataFrame, second: DataFrame, declared: DataFrame, doc: list[str], line: str, column: str) -> DataFrame:
    """Readings by a layout's rule against a second reading and a declaration, cell by cell: a document is valid if something was checked, nothing differs from the second reading and no line
    lacks one. Differences from the declaration are told, and don't decide. A line counts as read the second time if any of its cells was."""
    key = [*doc, line, column]
    lines = second.select(*doc, line, F.lit(True).alias("__l")).distinct()
    told = declared.select(*doc, line, F.lit(True).alias("__t")).distinct()
    j = rule.join(lines, [*doc, line], "left").join(told, [*doc, line], "left").join(second.select(*key, F.col("valor").alias("__s")), key, "left").join(declared.select(*key, F.col("valor").alias("__d")), key, "left")
    there = F.col("__l").isNotNull()
    agg = j.groupBy(*doc).agg(
        F.count(F.lit(1)).alias("celulas"), F.count_if(there).alias("conferidas"), F.count_if(there & ~F.col("__s").eqNullSafe(F.col("valor"))).alias("divergentes"),
        F.array_join(F.array_sort(F.collect_set(F.when(~there, F.col(line)))), ",").alias("sem_segunda_leitura"), F.count_if(F.col("__t").isNotNull() & ~F.col("__d").eqNullSafe(F.col("valor"))).alias("conteudo_diferente"),
    )
    ok = (F.col("divergentes") == 0) & (F.col("sem_segunda_leitura") == "") & (F.col("conferidas") > 0)
    return agg.withColumn("situacao", F.when(ok, "validado").otherwise("divergente"))


def states_compared(before: DataFrame, after: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Two states of a system (columns by, key, texto, numero: exactly one of the two isn't NULL): in each part how many entries are the same, differ as numbers, differ as texts, are new, are gone."""
    a = before.select(*by, *key, F.col("texto").alias("__t"), F.col("numero").alias("__n"), F.lit(True).alias("__a"))
    b = after.select(*by, *key, "texto", "numero", F.lit(True).alias("__b"))
    j = a.join(b, [*by, *key], "full")
    same = F.col("texto").eqNullSafe(F.col("__t")) & F.col("numero").eqNullSafe(F.col("__n"))
    words = F.col("texto").isNotNull() | F.col("__t").isNotNull()
    kind = F.when(F.col("__a").isNull(), "novos").when(F.col("__b").isNull(), "removidos").when(same, "iguais").when(words, "textos").otherwise("valores")
    kinds = ["iguais", "valores", "textos", "novos", "removidos"]
    found = j.groupBy(*by).agg(*[F.count_if(kind == k).alias(k) for k in kinds])
    return found.withColumn("identico", F.expr("valores + textos + novos + removidos") == 0)


def view_nature(view: Column, situations: list[Column]) -> Column:
    """``derivado`` for a published view all of whose rules are in operation, else ``analitico``; a rule without a decision isn't in operation."""
    ok = view == "publicado"
    for s in situations:
        ok = ok & F.coalesce(s == "operacional", F.lit(False))
    return F.when(ok, "derivado").otherwise("analitico")
