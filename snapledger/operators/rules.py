"""Versioned accounting rules on ledger records; every version is computed, governance chooses the published one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("ambos", "processado", "nao_processado", "sem_saldo_abertura")
COLUMNS = ("a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "L", "S1", "S2", "S3")
VERSIONS = ("v1", "v2", "v3")
#: Effect and sign of a movement type; types that aren't here are ``desconhecido`` with sign 0.
MOVEMENTS = {"purchase": ("inscricao", 1), "click": ("liquidacao", 1), "view": ("pagamento", -1), "signup": ("cancelamento", -1)}

# Effect and sign of a movement by its type code; 33 since version 2.
MOVEMENT_CODES = {
    20: ("empenho", 1), 21: ("cancelamento", -1), 22: ("estorno_cancelamento", 1), 30: ("liquidacao", 1), 31: ("estorno_liquidacao", -1), 33: ("em_liquidacao", 0),
    40: ("pagamento", 1), 41: ("estorno_pagamento", -1), 50: ("retencao", 1), 51: ("estorno_retencao", -1),
}


def category() -> Column:
    p, a = F.col("proc") > 0, F.col("aproc") > 0
    return F.when(p & a, "ambos").when(p, "processado").when(a, "nao_processado").otherwise("sem_saldo_abertura")


def _cancel_v2_open() -> Column:
    """What of the cancellation leaves the not-processed balance: at most what isn't liquidated yet."""
    c, a, liq = F.col("cancelado_aproc"), F.col("aproc"), F.col("liquidado")
    room = F.greatest(a - F.greatest(liq, F.lit(0)), F.lit(0))
    return F.when(a > 0, F.when(c > 0, F.least(c, room)).otherwise(c)).otherwise(F.lit(0))


def derive(records: DataFrame) -> DataFrame:
    """records with category, bands, balances S1 to S3 and both splits of the cancellation, in one projection."""
    proc, aproc, canc = F.col("proc"), F.col("aproc"), F.col("cancelado_aproc")
    last = F.col("anoempenho") == F.col("ex") - 1
    zero = F.lit(0).cast("long")
    open_v2 = _cancel_v2_open().cast("long")
    return records.withColumns({
        "categoria": category(),
        "faixa_p": F.when(proc > 0, F.when(last, "b").otherwise("a")),
        "faixa_n": F.when(aproc > 0, F.when(last, "g").otherwise("f")),
        "s1": proc + aproc - F.col("pago_proc") - F.col("pago_aproc") - canc,
        "s2": aproc - F.col("liquidado") - canc,
        "s3": proc - F.col("pago_proc") + F.col("liquidado") - F.col("pago_aproc"),
        "canc_v1_p": F.when((proc > 0) & (aproc == 0), canc).otherwise(zero),
        "canc_v1_n": F.when(aproc > 0, canc).otherwise(zero),
        "canc_v2_p": F.when(aproc > 0, canc - open_v2).when(proc > 0, canc).otherwise(zero),
        "canc_v2_n": open_v2,
    })


DERIVED_SQL = """
rec AS (
  SELECT *, CASE WHEN proc > 0 AND aproc > 0 THEN 'ambos' WHEN proc > 0 THEN 'processado' WHEN aproc > 0 THEN 'nao_processado' ELSE 'sem_saldo_abertura' END AS categoria,
    CASE WHEN proc > 0 THEN CASE WHEN anoempenho = ex - 1 THEN 'b' ELSE 'a' END END AS faixa_p,
    CASE WHEN aproc > 0 THEN CASE WHEN anoempenho = ex - 1 THEN 'g' ELSE 'f' END END AS faixa_n,
    proc + aproc - pago_proc - pago_aproc - cancelado_aproc AS s1, aproc - liquidado - cancelado_aproc AS s2, proc - pago_proc + liquidado - pago_aproc AS s3,
    CASE WHEN proc > 0 AND aproc = 0 THEN cancelado_aproc ELSE 0 END AS canc_v1_p, CASE WHEN aproc > 0 THEN cancelado_aproc ELSE 0 END AS canc_v1_n,
    CASE WHEN aproc > 0 THEN cancelado_aproc - CASE WHEN cancelado_aproc > 0 THEN least(cancelado_aproc, greatest(aproc - greatest(liquidado, 0), 0)) ELSE cancelado_aproc END
         WHEN proc > 0 THEN cancelado_aproc ELSE 0 END AS canc_v2_p,
    CASE WHEN aproc > 0 THEN CASE WHEN cancelado_aproc > 0 THEN least(cancelado_aproc, greatest(aproc - greatest(liquidado, 0), 0)) ELSE cancelado_aproc END ELSE 0 END AS canc_v2_n
  FROM base)"""


def _column_terms(version: str) -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    proc, aproc = F.col("proc"), F.col("aproc")
    p, n = proc > 0, aproc > 0
    mixed = version != "v1"  # payments follow the category of a record with one balance only
    only_p, only_n = p & (aproc == 0), n & (proc == 0)
    extra = lambda cond, c: F.when(cond, F.col(c)).otherwise(zero) if mixed else zero
    return {
        "a": F.when(F.col("faixa_p") == "a", proc).otherwise(zero),
        "b": F.when(F.col("faixa_p") == "b", proc).otherwise(zero),
        "c": F.when(p, F.col("pago_proc")).otherwise(zero) + extra(only_p, "pago_aproc"),
        "d": F.col("canc_v2_p" if version == "v3" else "canc_v1_p"),
        "f": F.when(F.col("faixa_n") == "f", aproc).otherwise(zero),
        "g": F.when(F.col("faixa_n") == "g", aproc).otherwise(zero),
        "h": F.when(n, F.col("liquidado")).otherwise(zero),
        "i": F.when(n, F.col("pago_aproc")).otherwise(zero) + extra(only_n, "pago_proc"),
        "j": F.col("canc_v2_n") if version == "v3" else F.when(n, F.col("cancelado_aproc")).otherwise(zero),
        "S1": F.col("s1"),
        "S2": F.col("s2"),
        "S3": F.col("s3"),
    }


def close(df: DataFrame) -> DataFrame:
    """The identities: e = a + b - c - d, k = f + g - i - j, L = e + k."""
    c = F.col
    return df.withColumn("e", c("a") + c("b") - c("c") - c("d")).withColumn("k", c("f") + c("g") - c("i") - c("j")).withColumn("L", c("e") + c("k"))


def statement_columns(records: DataFrame, by: list[str], versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """Statement columns of each version side by side in one aggregation: by, versao, and the COLUMNS in cents."""
    sums = [F.sum(t).cast("long").alias(f"{v}_{k}") for v in versions for k, t in _column_terms(v).items()]
    wide = records.groupBy(*by).agg(*sums)
    names = list(_column_terms("v1"))
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("versao"), *[F.col(f"{v}_{k}").alias(k) for k in names]) for v in versions]))
    return close(wide.select(*by, each.alias("s")).select(*by, "s.*")).select(*by, "versao", *COLUMNS)


def long_columns(wide: DataFrame, by: list[str]) -> DataFrame:
    return wide.unpivot(by, list(COLUMNS), "coluna", "valor")


def anomalies(records: DataFrame, copies_of: int, base: int) -> DataFrame:
    """One row for each anomaly of a record: the record's key, tipo. Records of entity copies_of numbered from base on are copies."""
    found = F.array(
        F.when(F.col("liquidado") < 0, "LIQ-NEG"),
        F.when((F.col("pago_proc") != 0) & (F.col("proc") == 0), "PAGOPROC-SEM-PROC"),
        F.when(F.col("cancelado_proc") != 0, "CANCPROC-NZ"),
        F.when((F.col("entidade") == copies_of) & (F.col("empenho") >= base), "COPIA-24"),
        F.when(F.col("anoempenho") >= F.col("ex"), "ANOEMP-FUTURO"),
        F.when((F.col("proc") <= 0) & (F.col("aproc") <= 0), "SEM-SALDO-ABERTURA"),
    )
    return records.select("entidade", "ex", "df", "anoempenho", "empenho", F.explode(F.array_compact(found)).alias("tipo"))


def movement_effect(kind: Column, types: dict[str, tuple[str, int]] = MOVEMENTS) -> tuple[Column, Column]:
    """Effect and sign of a movement type."""
    effect = reduce(lambda c, t: c.when(kind == t[0], t[1][0]), types.items(), F.when(F.lit(False), ""))
    sign = reduce(lambda c, t: c.when(kind == t[0], t[1][1]), types.items(), F.when(F.lit(False), 0))
    return effect.otherwise("desconhecido"), sign.otherwise(0).cast("long")


def interpret(code: Column, liquidation: Column, payment: Column, version: str = "v2") -> tuple[Column, Column, Column]:
    """Effect, sign and reference of a movement by its type code: payments refer to the payment, liquidations and retentions to the liquidation, others to none."""
    known = {c: t for c, t in MOVEMENT_CODES.items() if version != "v1" or c != 33}
    effect, sign = movement_effect(code, known)
    to = lambda *names: code.isin(*[c for c, (e, _) in known.items() if e.removeprefix("estorno_") in names])
    return effect, sign, F.when(to("pagamento"), payment).when(to("liquidacao", "em_liquidacao", "retencao"), liquidation)
