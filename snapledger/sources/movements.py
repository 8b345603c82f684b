"""Movement pages: JSON items to rows of entries, and the items that hold no exact value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rules import interpret
from . import contracts

#: Optional whole numbers of an item, and what they are called here.
NUMBERS = {"exercicioLiquidacao": "liquidacao_ex", "noLiquidacao": "liquidacao_no", "exercicioPagamento": "pagamento_ex", "noPagamento": "pagamento_no"}


def stripped(text: Column) -> Column:
    """text without white space at its ends; empty for NULL."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _prepared(pages: DataFrame, key: list[str], body: str) -> DataFrame:
    return contracts.items(pages, key, body).withColumn("valor_c", contracts.money(F.col("item"), "valor"))


def entries(pages: DataFrame, key: list[str], body: str = "body", version: str = "v2") -> DataFrame:
    """(key, indice, ...) of every item with an exact value, with its effect, its signed value, and the liquidation or payment that it refers to (``number/year``, NULL if either is missing).

    An optional amount that is absent, null or no exact number is NULL. Pages that are no JSON, and items without an exact value, give no rows here (see ``refused``).
    """
    v = lambda f, t: F.try_variant_get("item", f"$.{f}", t)
    found = _prepared(pages, key, body).where("valor_c is not null").select(
        *key, "indice", v("data", "string").try_cast("date").alias("data"), v("tipoLancamento", "bigint").alias("tipo"), stripped(v("descricaoTipoLancamento", "string")).alias("descricao"), "valor_c",
        contracts.money(F.col("item"), "valorALiquidar").alias("a_liquidar_c"), contracts.money(F.col("item"), "valorAPagar").alias("a_pagar_c"), *[v(f, "bigint").alias(n) for f, n in NUMBERS.items()], v("nroDocumento", "string").alias("documento"),
    )
    label = lambda n: F.concat(F.col(f"{n}_no").cast("string"), F.lit("/"), F.col(f"{n}_ex").cast("string"))
    effect, sign, reference = interpret(F.col("tipo"), label("liquidacao"), label("pagamento"), version)
    return found.withColumns({"efeito": effect, "com_sinal_c": F.col("valor_c") * sign, "referencia": reference})


def refused(pages: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """(key, indice, motivo) of items whose value is absent, null or not exact."""
    return contracts.items(pages, key, body).select(*key, "indice", contracts.refusal(F.col("item"), "valor").alias("motivo")).where("motivo is not null")
