"""What is known of each entity at a cut-off, and whether a total may be formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bimester


def state(known: Column, records: Column, flags: dict[str, Column]) -> Column:
    """The state of a cut-off, by the first that holds: not in the catalog, no current snapshot (records NULL: in the order of the flags, else never collected), no records (a true zero), data."""
    found = F.when(~F.coalesce(known, F.lit(False)), "inexistente")
    for name in ("nao_processado", "ambiguo", "valor_recusado", "incompleto"):
        if name in flags:
            found = found.when(records.isNull() & F.coalesce(flags[name], F.lit(False)), name)
    return found.when(records.isNull(), "sem_coleta").when(records == 0, "sem_rp").otherwise("com_dados")


def resolve(universe: DataFrame, catalog: DataFrame, snapshots: DataFrame, attempts: DataFrame) -> DataFrame:
    """The state of every (entidade, ex, df) of the universe, for all cut-offs in one job, where what is known of them lies in tables of its own.

    catalog: (entidade, ex) officially open. snapshots: current ones with their number of records. attempts: flags of what else there
    was (nao_processado, ambiguo, valor_recusado, incompleto).
    """
    key = ["entidade", "ex", "df"]
    known = catalog.select("entidade", "ex", F.lit(True).alias("__known"))
    joined = universe.join(known, ["entidade", "ex"], "left").join(snapshots.select(*key, "registros"), key, "left").join(attempts, key, "left")
    flags = {n: F.col(n) for n in attempts.columns if n not in key}
    return joined.select(*key, state(F.col("__known"), F.col("registros"), flags).alias("situacao"), "registros")


def availability(states: DataFrame) -> DataFrame:
    """Each cut-off of the municipality: available if at least one entity is summed and none is missing; the missing ones are named."""
    missing = F.col("situacao").isin("nao_processado", "ambiguo", "valor_recusado", "incompleto", "sem_coleta")
    summed = F.col("situacao").isin("sem_rp", "com_dados")
    agg = states.groupBy("ex", "df").agg(F.count_if(summed).alias("somadas"), F.count_if(missing).alias("faltam"), F.count_if(F.col("situacao") == "com_dados").alias("com"), F.array_join(F.array_sort(F.collect_set(F.when(missing, F.col("entidade").cast("string")))), ",").alias("ausentes"))
    ok = (F.col("somadas") > 0) & (F.col("faltam") == 0)
    return agg.select("ex", "df", F.when(~ok, "municipio_indisponivel").when(F.col("com") == 0, "sem_rp").otherwise("com_dados").alias("situacao"), "somadas", "faltam", "ausentes")


def history(universe: DataFrame, states: DataFrame, rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """A key over the cut-offs of its entity in the fiscal years after the commitment's own: its value, ``ausente`` where the cut-off is there without it, or the cut-off's own state."""
    at = ["entidade", "ex", "df"]
    points = universe.join(states.select(*at, "situacao"), at, "left")
    mine = rows.select(*key).distinct().join(points, "entidade").where(F.col("ex") > F.col("anoempenho"))
    found = mine.join(rows.select(*key, "ex", "df", value), [*key, "ex", "df"], "left")
    there = F.col("situacao").isin("com_dados", "sem_rp")
    return found.select(*key, "ex", "df", F.when(there, F.col(value)).alias(value), F.when(there & F.col(value).isNull(), "ausente").otherwise(F.col("situacao")).alias("situacao"))


def gate(states: DataFrame) -> DataFrame:
    """Each cut-off with its entities by state, and why no total may be formed (NULL if one may): (ex, df, somadas, faltam, fora, fora_do_escopo, motivo)."""
    names = lambda *kinds: F.array_join(F.array_sort(F.collect_set(F.when(F.col("situacao").isin(*kinds), F.col("entidade")))).cast("array<string>"), ",")
    found = states.groupBy("ex", "df").agg(
        F.count_if(F.col("situacao").isin("sem_rp", "com_dados")).alias("somadas"), names("nao_processado", "ambiguo", "valor_recusado", "incompleto", "sem_coleta").alias("faltam"), names("inexistente").alias("fora"), names("fora_do_escopo").alias("fora_do_escopo")
    )
    why = F.when(F.col("faltam") != "", F.concat(F.lit("faltam entidades: "), "faltam")).when(F.col("somadas") == 0, "nenhuma entidade com snapshot")
    return found.withColumn("motivo", why)


def extra_entity(year: Column, day: Column, periods: list[tuple[str, str, str]], default: tuple[str, str], reservations: dict[str, str]) -> tuple[Column, Column, Column]:
    """Treatment of the extra entity in the bimester of a cut-off, what it rests on, and the reservation that it carries (NULL for a proven one)."""
    period = F.concat_ws("-", year.cast("string"), bimester(day).cast("string"))
    table = lambda i: F.create_map(*[F.lit(x) for p in periods for x in (p[0], p[i])])
    situation = F.coalesce(F.try_element_at(table(2), period), F.lit(default[1]))
    notes = F.create_map(*[F.lit(x) for kv in reservations.items() for x in kv])
    return F.coalesce(F.try_element_at(table(1), period), F.lit(default[0])), situation, F.try_element_at(notes, situation)


def in_catalog(official: DataFrame, year: int, years: str = "ofic") -> DataFrame:
    """official entities with the first and last of their fiscal years, and their situation in a year."""
    y = F.col(years)
    kind = F.when(y.isNull() | (F.size(y) == 0), "sem catálogo de exercícios").when(F.array_contains(y, F.lit(year).cast("long")), "no catálogo oficial").otherwise("fora do catálogo oficial")
    return official.withColumns({"primeiro": F.array_min(y), "ultimo": F.array_max(y), "situacao": kind})
