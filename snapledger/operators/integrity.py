"""Orphans, gates, equivalence of tables, governance decisions, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import row_hash, set_hash


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """One row: how many child rows have a key that no parent has."""
    left = child.where(F.col(key).isNotNull()).select(F.col(key).alias("__k")).join(parent.select(F.col(parent_key).alias("__k")), "__k", "left_anti")
    return left.agg(F.count(F.lit(1)).alias("orfaos")).select(F.lit(name).alias("relacao"), "orfaos")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def gate(name: str, rows: DataFrame, failed: Column, verified: bool = True) -> DataFrame:
    """One row: the gate's failures and whether it holds; NULL means not verified."""
    return rows.agg(F.count_if(failed).alias("falhas")).select(F.lit(name).alias("portao"), F.lit(verified).alias("__v"), "falhas").select("portao", F.when(F.col("__v"), F.col("falhas")).alias("falhas"), F.when(F.col("__v"), F.col("falhas") == 0).alias("ok"))


def verdict(gates: DataFrame) -> DataFrame:
    """rejected if a gate fails, incomplete if one isn't verified, else approved."""
    return gates.agg(F.when(F.count_if(~F.col("ok")) > 0, "reprovado").when(F.count_if(F.col("ok").isNull()) > 0, "incompleto").otherwise("aprovado").alias("resultado"))


def table_hash(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """A hash of the rows of each group that doesn't depend on order, partitioning or repetition of the run."""
    return rows.withColumn("__h", row_hash(*columns)).groupBy(*by).agg(F.count(F.lit(1)).alias("linhas"), set_hash("__h").alias("hash"))


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, as multisets, with the side that has them; empty if they are equivalent."""
    return a.exceptAll(b).withColumn("lado", F.lit("a")).unionByName(b.exceptAll(a).withColumn("lado", F.lit("b")))


def only_adds(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of before that after lacks; empty proves that after only adds."""
    return before.join(after.select(*key), key, "left_anti")


def decisions_as_of(decisions: DataFrame, rule: str, decided: str, tie: str, values: list[str], instant: Column | None = None) -> DataFrame:
    """The last decision on each rule (by the instant, if given) and how many there were."""
    rows = decisions if instant is None else decisions.where(F.col(decided) <= instant)
    best = F.max_by(F.struct(*values), F.struct(decided, tie)).alias("__b")
    return rows.groupBy(rule).agg(best, F.count(F.lit(1)).alias("decisoes")).select(rule, *[F.col(f"__b.{v}").alias(v) for v in values], "decisoes")


def published_rules(decisions: DataFrame, rules: list[str]) -> list[str]:
    """The rules among those given that aren't operational and composing; a guard before publishing. Reads one row a rule."""
    good = {r[0] for r in decisions.where((F.col("situacao") == "operacional") & F.col("compoe")).select("regra").distinct().collect()}
    return [r for r in rules if r not in good]


def provenance(records: DataFrame, responses: DataFrame, objects: DataFrame, expected: str = "sha256") -> DataFrame:
    """Each record with its response and stored object (by name sha256), and whether the chain is whole: object there, its size right, its hash the expected one."""
    j = records.join(responses, ["coleta", "ordem"], "left").join(objects, "sha256", "left")
    whole = F.col("body").isNotNull() & (F.sha2("body", 256) == F.col(expected)) & (F.octet_length("body") == F.col("tamanho"))
    return j.withColumn("integro", F.coalesce(whole, F.lit(False)))


def keep_latest(runs: DataFrame, by: list[str], order: str, keep: int = 1) -> DataFrame:
    """Runs that a retention rule would let go: all but the newest ``keep`` of each group (a plan; nothing is deleted)."""
    from pyspark.sql import Window

    return runs.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).where(F.col("__r") > keep).drop("__r")


def catalog_differences(code: DataFrame, stored: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Entries of a catalog whose fingerprints differ between two copies of it, or that one lacks: key, onde."""
    side = lambda df, n: df.select(*key, row_hash(*fields).alias(n))
    both = side(code, "a").join(side(stored, "b"), key, "full")
    where = F.when(F.col("b").isNull(), "só no código").when(F.col("a").isNull(), "só no banco").when(F.col("a") != F.col("b"), "difere")
    return both.select(*key, where.alias("onde")).where("onde is not null")


def decision_violation() -> Column:
    """The first rule that a decision (situacao, compoe, fonte, teste, evidencia, ressalva) breaks, NULL if none.

    Only an operational rule composes or carries a reservation; a promotion needs a documented source and a regression test, and, if the rule composes, independent evidence or a reservation.
    """
    c = F.col
    none = lambda n: F.coalesce(F.trim(c(n)), F.lit("")) == ""
    operational = c("situacao") == "operacional"
    return (
        F.when(c("compoe") & ~operational, "só regra operacional compõe")
        .when(c("ressalva").isNotNull() & ~operational, "ressalva só na promoção")
        .when(operational & none("fonte"), "sem fonte")
        .when(operational & ~F.coalesce(c("teste"), F.lit("")).rlike(r"^tests/.+[.]py::.+$"), "sem teste de regressão")
        .when(operational & c("compoe") & c("evidencia").isNull() & none("ressalva"), "sem evidência nem ressalva")
    )


def homologation(gates: DataFrame, pending: DataFrame, coverage: DataFrame, by: str) -> DataFrame:
    """The verdict for each value of by, over gates (portao, ok, obrigatorio), pending matters (tipo) and documents (conferido), and the three dimensions it rests on, apart.

    A failed gate rejects; a mandatory one that wasn't run makes it incomplete (one that isn't mandatory changes nothing); then anything pending, or a document not checked, makes it an
    approval with reservations.
    """
    g = gates.groupBy(by).agg(F.count_if(~F.col("ok")).alias("reprovados"), F.count_if(F.col("ok").isNull() & F.col("obrigatorio")).alias("nao_executados"))
    p = pending.groupBy(by).agg(F.count(F.lit(1)).alias("pendencias"), F.array_join(F.array_sort(F.collect_set("tipo")), ",").alias("tipos"))
    d = coverage.groupBy(by).agg(F.count(F.lit(1)).alias("documentos"), F.count_if(F.col("conferido")).alias("conferidos"))
    all_ = g.join(p, by, "left").join(d, by, "left").na.fill({"pendencias": 0, "tipos": "", "documentos": 0, "conferidos": 0})
    technical = (F.col("reprovados") == 0) & (F.col("nao_executados") == 0)
    complete = F.col("conferidos") == F.col("documentos")
    verdict = F.when(F.col("reprovados") > 0, "reprovada").when(F.col("nao_executados") > 0, "incompleta").when((F.col("pendencias") > 0) | ~complete, "aprovada_com_ressalvas").otherwise("aprovada_sem_ressalvas")
    return all_.select(by, verdict.alias("resultado"), technical.alias("tecnica"), "reprovados", "nao_executados", complete.alias("cobertura_completa"), "documentos", "conferidos", "pendencias", "tipos")


def broken_links(names: dict[str, DataFrame]) -> DataFrame:
    """(elo, quebras): how many rows each relation of broken links has; all zero means that every value can be traced."""
    return union_all([rows.agg(F.count(F.lit(1)).alias("quebras")).select(F.lit(name).alias("elo"), "quebras") for name, rows in names.items()])
