"""Series of cut-offs: gaps stay gaps, and no difference skips one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series(universe: DataFrame, found: DataFrame, by: list[str], at: list[str], value: str) -> DataFrame:
    """Every point of the universe with its value, or NULL and the reason, and the difference to the point before it (NULL beside a gap)."""
    joined = universe.join(found.select(*by, *at, value), [*by, *at], "left")
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*at))
    return joined.select(*by, *at, value, F.when(F.col(value).isNull(), "sem_coleta").otherwise("com_dados").alias("situacao"), (F.col(value) - before).alias("diferenca"))


def dense_years(points: DataFrame, by: list[str], first: int, last: int) -> DataFrame:
    """Every key with every year of a range."""
    return points.select(*by).distinct().withColumn("ex", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))


def representative(points: DataFrame, by: list[str], cut: str = "df", year_end: str = "-12-31") -> DataFrame:
    """The cut-off that stands for a year: its end if there, else the last there is."""
    return points.groupBy(*by).agg(F.max_by(cut, F.struct(F.col(cut).endswith(year_end), F.col(cut))).alias(cut))


def continuity(closing: DataFrame, opening: DataFrame, key: list[str]) -> DataFrame:
    """Each record at a year's end against the same record at the next opening: proc = S3 and aproc = S2 are due.

    A record with nothing left (S1 = 0) may be absent; one with a balance may not.
    """
    after = opening.select(*key, F.lit(True).alias("__there"), F.col("proc").alias("proc_abertura"), F.col("aproc").alias("aproc_abertura"))
    c = F.col
    kind = (
        F.when(c("__there").isNull() & (c("s1") != 0), "SALDO-SEM-CONTINUIDADE")
        .when(c("__there").isNull(), "encerrado")
        .when((c("proc_abertura") == c("s3")) & (c("aproc_abertura") == c("s2")), "continuo")
        .otherwise("DESCONTINUIDADE")
    )
    return closing.join(after, key, "left").withColumn("classe", kind).drop("__there")
