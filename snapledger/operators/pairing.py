"""Mirrored pairs of two entities: a copy's number is the original's plus a base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = ["ex", "df", "anoempenho"]


def is_copy(entity: int, base: int) -> Column:
    return (F.col("entidade") == entity) & (F.col("empenho") >= base)


def execution(prefix: str = "") -> Column:
    c = lambda n: F.abs(F.col(prefix + n))
    return c("pago_proc") + c("pago_aproc") + c("cancelado_aproc") + c("liquidado")


def pairs(records: DataFrame, copies: int, originals: int, base: int, match: list[str]) -> DataFrame:
    """Copies with their originals: same point, number less base, all match fields equal (NULL equals NULL).

    relacao: ``igual`` (same inscription), ``a_e_saldo_final_de_b`` (the copy's whole inscription is the original's S1), ``outra``.
    lado: which side was executed.
    """
    keep = ["empenho", "proc", "aproc", "s1", *match]
    a = records.where(is_copy(copies, base)).select(*POINT, (F.col("empenho") - base).alias("b_empenho"), *[F.col(c).alias(f"a_{c}") for c in keep], execution().alias("a_exec"))
    b = records.where(F.col("entidade") == originals).select(*POINT, *[F.col(c).alias(f"b_{c}") for c in keep], execution().alias("b_exec"))
    on = a.join(b, [*POINT, "b_empenho"])
    for m in match:
        on = on.where(F.col(f"a_{m}").eqNullSafe(F.col(f"b_{m}")))
    same = (F.col("a_proc") == F.col("b_proc")) & (F.col("a_aproc") == F.col("b_aproc"))
    final = F.col("a_proc") + F.col("a_aproc") == F.col("b_s1")
    x, y = F.col("a_exec") > 0, F.col("b_exec") > 0
    return on.select(
        *POINT, "a_empenho", "b_empenho", "a_proc", "a_aproc", "b_proc", "b_aproc",
        F.when(same, "igual").when(final, "a_e_saldo_final_de_b").otherwise("outra").alias("relacao"),
        F.when(x & y, "ambos").when(x, "A").when(y, "B").otherwise("nenhum").alias("lado"),
    )


def unpaired(records: DataFrame, copies: int, originals: int, base: int, match: list[str]) -> DataFrame:
    """Copies without an original (left anti, NULL-safe on the match fields)."""
    return _against(records.where(is_copy(copies, base)), records, originals, base, match, "left_anti")


def consolidated(records: DataFrame, copies: int, originals: int, base: int, match: list[str], first: int | None = None) -> DataFrame:
    """records without the originals that their copies replace: nothing paid, liquidated or cancelled, and a copy at the same point with the same inscription and match
    fields (NULL equals NULL). Copies before the fiscal year ``first``, which are outside the scope themselves, replace nothing. An entity's own view
    has no copy of another entity, so it never loses a record.
    """
    inside = is_copy(copies, base) if first is None else is_copy(copies, base) & (F.col("ex") >= first)
    names = [*POINT, "proc", "aproc", *match]
    a = records.where(inside).select((F.col("empenho") - base).alias("__empenho"), *[F.col(c).alias(f"__{c}") for c in names])
    idle = (F.col("entidade") == originals) & (execution() == 0)
    on = idle & (F.col("empenho") == F.col("__empenho"))
    for c in (*POINT, "proc", "aproc"):
        on = on & (F.col(c) == F.col(f"__{c}"))
    for m in match:
        on = on & F.col(m).eqNullSafe(F.col(f"__{m}"))
    return records.join(a, on, "left_anti")


def reservations(records: DataFrame, copies: int, originals: int, base: int, match: list[str], first: int | None = None) -> DataFrame:
    """For each cut-off: pairs whose original stays in the total (executed, or of another inscription) and its inscription, and consolidated ones matched on a NULL field.

    Copies before the fiscal year ``first`` are outside the scope, so they make no total uncertain.
    """
    inside = is_copy(copies, base) if first is None else is_copy(copies, base) & (F.col("ex") >= first)
    a = records.where(inside).select(*POINT, (F.col("empenho") - base).alias("empenho"), F.col("proc").alias("a_proc"), F.col("aproc").alias("a_aproc"), *[F.col(m).alias(f"a_{m}") for m in match])
    on = records.where(F.col("entidade") == originals).join(a, [*POINT, "empenho"])
    for m in match:
        on = on.where(F.col(m).eqNullSafe(F.col(f"a_{m}")))
    stays = (execution() > 0) | (F.col("proc") != F.col("a_proc")) | (F.col("aproc") != F.col("a_aproc"))
    blank = reduce(lambda x, y: x | y, [F.col(m).isNull() for m in match], F.lit(False))
    opened = F.col("proc") + F.col("aproc")
    return on.groupBy("ex", "df").agg(F.count_if(stays).alias("nao_consolidados"), F.coalesce(F.sum(F.when(stays, opened)), F.lit(0)).cast("long").alias("inscricao_original"), F.count_if(~stays & blank).alias("evidencia_incompleta"))


def _against(copy: DataFrame, records: DataFrame, originals: int, base: int, match: list[str], how: str) -> DataFrame:
    o = records.where(F.col("entidade") == originals).select(*[F.col(c).alias(f"__{c}") for c in (*POINT, "empenho", *match)])
    on = F.col("empenho") - base == F.col("__empenho")
    for c in POINT:
        on = on & (F.col(c) == F.col(f"__{c}"))
    for m in match:
        on = on & F.col(m).eqNullSafe(F.col(f"__{m}"))
    return copy.join(o, on, how)


def excluded_side(version: str) -> Column:
    """Whose inscription leaves the consolidated view: a, b or NULL. None if both sides were executed."""
    same = F.col("relacao") == "igual"
    kinds = {"v1": F.when(same, "b"), "v2": F.when(F.col("relacao").isin("igual", "a_e_saldo_final_de_b"), "a"), "v4": F.when(same & F.col("lado").isin("A", "nenhum"), "b")}
    return F.when(F.col("lado") != "ambos", kinds[version])


def adjustments(found: DataFrame, version: str) -> DataFrame:
    """What each pair takes from the columns at its point: inscription of the excluded side only, S1 to S3 along; long format, negative."""
    side = found.withColumn("fora", excluded_side(version)).where("fora is not null")
    v = lambda n: F.when(F.col("fora") == "a", F.col(f"a_{n}")).otherwise(F.col(f"b_{n}"))
    last = F.col("anoempenho") == F.col("ex") - 1
    rows = side.select(*POINT, v("proc").alias("p"), v("aproc").alias("n"), F.when(last, "b").otherwise("a").alias("cp"), F.when(last, "g").otherwise("f").alias("cn"))
    part = lambda col, amount: F.struct(col.alias("coluna"), (-amount).alias("ajuste"))
    p, n = F.greatest(F.col("p"), F.lit(0)), F.greatest(F.col("n"), F.lit(0))
    each = F.explode(F.array(part(F.col("cp"), p), part(F.col("cn"), n), part(F.lit("e"), p), part(F.lit("k"), n), part(F.lit("L"), p + n), part(F.lit("S1"), F.col("p") + F.col("n")), part(F.lit("S2"), F.col("n")), part(F.lit("S3"), F.col("p"))))
    return rows.select("ex", "df", each.alias("x")).groupBy("ex", "df", F.col("x.coluna").alias("coluna")).agg(F.sum("x.ajuste").cast("long").alias("ajuste"))
