"""Snapshots as intervals of validity: one stored table that answers "as it was on" for every instant."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import OFFSET

_ZONE = timezone(timedelta(hours=int(OFFSET[:3])))


def canonical_text(text: str) -> str:
    """The one text of an instant: ISO to the second at the ledger's clock. A date means its last second."""
    found = datetime.fromisoformat(text)
    if len(text) == 10:
        found = found.replace(hour=23, minute=59, second=59)
    return (found.replace(tzinfo=_ZONE) if found.tzinfo is None else found.astimezone(_ZONE)).isoformat(timespec="seconds")


def instant(text: str) -> Column:
    """A canonical instant as a timestamp; any other text of the same instant is refused, so that no two names of one derivation exist."""
    if canonical_text(text) != text:
        raise ValueError(f"instant {text!r} isn't in canonical form {canonical_text(text)!r}")
    return F.lit(text).cast("timestamp")


def intervals(snapshots: DataFrame, by: list[str], order: list[str], concluded: str, counts: Column, values: list[str]) -> DataFrame:
    """Each snapshot that counts, with the interval [de, ate) in which it is its cut-off's valid one; ate is NULL for the current one.

    A snapshot that doesn't count (incomplete, refused, without conclusion) never ends another's interval. Of snapshots concluded at the same instant only the last by order is
    ever valid, so every interval holds at least one instant, and the intervals of a cut-off neither overlap nor leave a gap. The order begins with the conclusion.
    """
    good = snapshots.where(counts & F.col(concluded).isNotNull())
    ends = F.lead(concluded).over(Window.partitionBy(*by).orderBy(*order))
    return good.withColumn("ate", ends).where("ate is null or ate > " + concluded).select(*by, F.col(concluded).alias("de"), "ate", *values)


def valid_at(stored: DataFrame, em: Column) -> DataFrame:
    """The snapshots valid at an instant: two comparisons, which reach the scan of a stored table."""
    return stored.where((F.col("de") <= em) & (F.col("ate").isNull() | (F.col("ate") > em))).drop("de", "ate")


def valid_at_each(stored: DataFrame, instants: list[str]) -> DataFrame:
    """The snapshots valid at each of a few instants (column vigencia), in one pass: a row goes out once for each instant that it holds."""
    at = F.array(*[F.struct(F.lit(t).alias("vigencia"), instant(t).alias("t")) for t in instants])
    held = F.filter(at, lambda x: (x["t"] >= F.col("de")) & (F.col("ate").isNull() | (x["t"] < F.col("ate"))))
    return stored.withColumn("__at", F.explode(held)).select(F.col("__at.vigencia").alias("vigencia"), *[c for c in stored.columns if c not in ("de", "ate")])


def divergence(stored: DataFrame, instants: list[str], by: list[str], uid: str, value: str) -> DataFrame:
    """Cut-offs whose valid snapshot at an earlier instant isn't the one at the last: both, and the value's change. Those not there at the earlier one aren't changes."""
    every = valid_at_each(stored, instants)
    last = every.where(F.col("vigencia") == instants[-1]).select(*by, F.col(uid).alias("depois"), F.col(value).alias("valor_depois"))
    before = every.where(F.col("vigencia") != instants[-1]).select("vigencia", *by, F.col(uid).alias("antes"), F.col(value).alias("valor_antes"))
    return before.join(last, by).where("antes <> depois").withColumn("diferenca", F.col("valor_depois") - F.col("valor_antes"))
