"""Instants and periods. The ledger's clock is fixed at three hours behind UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
OFFSET = "-03:00"


def canonical_instant(text: Column) -> Column:
    """A date means its last second, a time without offset is at OFFSET, other offsets are converted. NULL if unreadable."""
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & ~day
    return F.when(day, F.try_to_timestamp(F.concat(text, F.lit(f"T23:59:59{OFFSET}")))).when(zoned, F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(F.concat(text, F.lit(OFFSET))))


def bimester(day: Column) -> Column:
    return F.call_function("div", F.month(day) + 1, F.lit(2)).cast("long")


def bimester_end(year: Column, number: Column) -> Column:
    return F.last_day(F.make_date(year.cast("int"), (number * 2).cast("int"), F.lit(1)))


def month_end(year: Column, month_name: Column) -> Column:
    """Last day of a month given by name, NULL for an unknown name."""
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.trim(month_name)))
    return F.when(place > 0, F.last_day(F.make_date(year.cast("int"), F.greatest(place, F.lit(1)).cast("int"), F.lit(1))))


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))
