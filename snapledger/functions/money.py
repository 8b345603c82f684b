"""Money is BIGINT cents: exact or refused, never rounded, never a float in a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Cents of a DOUBLE that is known to hold two decimals (rounding undoes binary noise only)."""
    return F.round(amount * 100).cast("long")


def exact_cents(amount: Column) -> Column:
    """Cents of a decimal or its plain text, NULL if it has more than two decimals or is no number. Decided on the text, so no digit is lost on the way;
    a text with an exponent is read as a number of up to 18 decimals."""
    text = F.trim(amount.cast("string"))
    wide = text.try_cast("decimal(38,18)")
    plain = F.when(text.rlike(r"^[+-]?\d+(\.\d{0,2}0*)?$"), F.regexp_replace(text, r"(\.\d{2})0+$", "$1").try_cast("decimal(38,2)"))
    power = F.when(text.rlike("[eE]") & (wide == wide.try_cast("decimal(22,2)")), wide.try_cast("decimal(38,2)"))
    return (F.coalesce(plain, power) * 100).try_cast("decimal(38,0)").try_cast("long")


def text_cents(text: Column) -> Column:
    """Cents of a number such as ``1.234,56`` (point for thousands, comma for decimals); NULL if it isn't one."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\.", ""), ",", ".")
    return F.when(F.trim(text).rlike(r"^-?\d{1,3}(\.\d{3})*,\d{2}$"), (plain.try_cast("decimal(30,2)") * 100).try_cast("long"))


def ceil_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a + b - 1, b).cast("long")


def half_up_tenths(part: str, total: str) -> Column:
    """part / total in tenths of a percent, halves up; NULL if the total isn't positive. part must not be negative."""
    return F.when(F.col(total) > 0, F.expr(f"(2 * {part} * 1000 + {total}) div (2 * {total})"))


def largest_remainder(df: DataFrame, group: list[str], value: str, order: str, out: str = "share") -> DataFrame:
    """Shares in tenths of a percent that sum to 1000 in each group; NULL where a group's total isn't positive or a part is negative."""
    whole = Window.partitionBy(*group)
    df = df.withColumn("__t", F.sum(value).over(whole)).withColumn("__ok", (F.min(value).over(whole) >= 0) & (F.col("__t") > 0))
    df = df.withColumn("__f", F.when(F.col("__ok"), F.expr(f"{value} * 1000 div __t"))).withColumn("__r", F.when(F.col("__ok"), F.expr(f"{value} * 1000 % __t")))
    rank = F.row_number().over(whole.orderBy(F.col("__r").desc(), F.col(order).asc_nulls_last()))
    missing = 1000 - F.sum("__f").over(whole)
    return df.withColumn("__k", rank).withColumn("__m", missing).withColumn(out, (F.col("__f") + (F.col("__k") <= F.col("__m")).cast("long")).cast("long")).drop("__t", "__ok", "__f", "__r", "__k", "__m")


def format_cents(value: Column) -> Column:
    """``1.234,56`` from cents, by integer arithmetic."""
    size = F.abs(value)
    units = F.translate(F.format_number(F.call_function("div", size, F.lit(100)), 0), ",", ".")
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), units, F.lit(","), F.lpad((size % 100).cast("string"), 2, "0")))
