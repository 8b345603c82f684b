"""Lists of commitments: a closed set of filters, orders, pages, and what each level may see."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CREDITOR_TYPES, RESTRICTED, creditor_type, full_document, public_name
from .rules import CATEGORIES

BANDS = {"a": "faixa_p", "b": "faixa_p", "f": "faixa_n", "g": "faixa_n"}
CODES = ("orgao", "funcao", "programa", "elemento")
#: Budget dimensions, any of which a record may lack.
BUDGET = ("orgao", "unidade", "funcao", "sub_funcao", "programa", "projeto", "elemento")
#: Columns that tell who the creditor is.
RESTRICTED_COLUMNS = ("credor", "cnpj", "cnpj_nome")
ORDERS = {"saldo": [("s1", False), ("entidade", True), ("anoempenho", True), ("empenho", True)], "chave": [("entidade", True), ("anoempenho", True), ("empenho", True)]}
MOST_ROWS = 500


def filters(**given) -> tuple[Column, dict]:
    """(condition, echo of the filters applied). Only known filters with valid values; anything else is a ValueError. A filter chooses records and changes no value."""
    wanted = {k: v for k, v in given.items() if v is not None}
    found: list[Column] = []
    echo: dict = {}

    def need(ok: object, text: str) -> None:
        if not ok:
            raise ValueError(text)

    for name, value in wanted.items():
        shown = name
        if name in ("anoempenho", "empenho", "fonte_recurso"):
            need(isinstance(value, int) and not isinstance(value, bool) and value >= 0, f"{name}: a non-negative integer")
            found.append(F.col(name) == value)
        elif name == "categoria":
            need(value in CATEGORIES, f"categoria: one of {CATEGORIES}")
            found.append(F.col(name) == value)
        elif name == "programatica":
            need(re.fullmatch(r"\d{1,28}", str(value)), "programatica: the first 1 to 28 digits of the code")
            found.append(F.col(name).startswith(str(value)))
            shown = "programatica_comeca_com"
        elif name == "tipo_credor":
            need(value in CREDITOR_TYPES, f"tipo_credor: one of {CREDITOR_TYPES}")
            found.append(creditor_type(F.col("cnpj")) == value)
        elif name == "cnpj":
            digits = re.sub(r"\D", "", str(value))
            need(len(digits) == 14, "cnpj: all 14 digits of a company's number")
            value = f"{digits[:2]}.{digits[2:5]}.{digits[5:8]}/{digits[8:12]}-{digits[12:]}"
            found.append(F.col(name) == value)
        elif name == "faixa":
            need(value in BANDS, f"faixa: one of {tuple(BANDS)}")
            found.append(F.col(BANDS[value]) == value)
        elif name in CODES:
            need(re.fullmatch(r"\d{1,20}", str(value)), f"{name}: 1 to 20 digits")
            found.append(F.col(name) == str(value))
        elif name == "sem_classificacao":
            need(value in BUDGET, f"sem_classificacao: one of {BUDGET}")
            found.append(F.col(value).isNull())
        else:
            raise ValueError(f"unknown filter {name}")
        echo[shown] = value
    return reduce(lambda a, b: a & b, found, F.lit(True)), echo


def clamp(limit: int) -> int:
    return max(1, min(MOST_ROWS, limit))


def page(rows: DataFrame, order: str = "saldo", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in one of the two orders, down to a total tie-break; at most MOST_ROWS rows, at least one."""
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in ORDERS[order]]
    return rows.orderBy(*by).offset(max(0, offset)).limit(clamp(limit))


def at_level(rows: DataFrame, level: str) -> DataFrame:
    """rows as a level may see them: ``interno`` all, ``publico`` without the creditor's document and with the public name and kind instead."""
    if level == "interno":
        return rows
    if level != "publico":
        raise ValueError(f"unknown level {level}")
    shown = rows.withColumns({"credor_publico": public_name(F.col("credor"), F.col("cnpj")), "tipo_credor": creditor_type(F.col("cnpj"))})
    return shown.drop(*RESTRICTED_COLUMNS)


def redacted(changes: DataFrame, field: str = "campo", values: tuple[str, ...] = ("antes", "depois")) -> DataFrame:
    """Field-by-field changes with the values of restricted fields hidden, NULL ones too."""
    secret = F.col(field).isin(*RESTRICTED_COLUMNS)
    return changes.withColumns({v: F.when(secret, RESTRICTED).otherwise(F.col(v).cast("string")) for v in values})


__all__ = ["BANDS", "BUDGET", "ORDERS", "at_level", "clamp", "filters", "full_document", "page", "redacted"]
