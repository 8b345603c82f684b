"""Whole answers about a cut-off: its context, its catalog, each entity's state in words, totals by any dimension, and partitions fit for a chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of an entity at a cut-off, in words.
STATE_TEXTS = {
    "com_dados": "dado existente",
    "sem_rp": "entidade existente, sem RP neste corte (zero registros na API)",
    "inexistente": "entidade inexistente no exercício (fora do catálogo oficial; não é RP zero)",
    "sem_coleta": "corte não coletado",
    "nao_processado": "corte coletado, mas ainda não processado",
    "incompleto": "dado indisponível: só há coleta incompleta ou com falha deste corte",
    "ambiguo": "dado indisponível: o retrato do corte tem a mesma chave de empenho mais de uma vez (CHAVE-DUP); nenhuma ocorrência é escolhida",
    "valor_recusado": "dado indisponível: o retrato do corte tem campo monetário ausente, nulo ou inválido (VALOR-RECUSADO); o registro nunca é somado como zero",
    "fora_do_escopo": "entidade fora do catálogo do portal e fora do escopo do Município neste período (regra ESCOPO-MUN): listada, não somada",
}
NOT_THERE = "entidade fora do catálogo oficial do exercício: não existia; não é RP zero"
NONE_SUMMED = "nenhuma entidade do catálogo oficial com snapshot neste corte"
SUMMED = ("com_dados", "sem_rp")
MISSING = ("nao_processado", "ambiguo", "valor_recusado", "incompleto", "sem_coleta")
NO_CLASS = "sem classificação"


def state_text(state: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATE_TEXTS.items() for x in kv]), state)


def context(derivations: DataFrame, runs: DataFrame, read: DataFrame) -> DataFrame:
    """(derivacao, normalizacao, limite) of the newest current derivation: one row, or none where there is none.

    derivations: id, normalizacao, vigencia_em (NULL: current). runs: id, ultima (the highest collection that it read; NULL in runs
    that didn't write it down). read: normalizacao, coleta; the limit of a run without ``ultima`` is the highest collection with a row of it, zero if none has.
    """
    newest = derivations.where("vigencia_em is null").groupBy().agg(F.max("id").alias("derivacao"), F.max_by("normalizacao", "id").alias("normalizacao")).where("derivacao is not null")
    run = F.broadcast(newest).join(runs.select(F.col("id").alias("normalizacao"), "ultima"), "normalizacao")  # one row on the left
    highest = read.join(F.broadcast(newest.select("normalizacao")), "normalizacao", "left_semi").agg(F.max("coleta").alias("__c"))
    return run.crossJoin(F.broadcast(highest)).select("derivacao", "normalizacao", F.coalesce("ultima", "__c", F.lit(0)).cast("long").alias("limite"))  # one row each


def seen_by(rows: DataFrame, instants: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    """For each key and instant (column em, a short list), the sorted set of values seen by then: each (key, value) once, by its first time, so that history isn't multiplied by the instants."""
    first = rows.groupBy(*by, value).agg(F.min(at).alias("__at"))
    there = first.join(F.broadcast(instants.select("em")), F.col("__at") <= F.col("em"))
    return there.groupBy(*by, "em").agg(F.array_sort(F.collect_set(value)).alias("vistos"))


def catalog(entities: DataFrame, years: DataFrame, seen: DataFrame, year: int) -> DataFrame:
    """Entities that any source knows at each instant em: name, whether the catalog has them, official and seen years, and what they are in a year.

    entities: entidade, em, nome. years: entidade, em, exercicios (array, may be empty). seen: entidade, em, vistos (array).
    """
    key = ["entidade", "em"]
    found = entities.withColumn("no_catalogo", F.lit(True)).join(years, key, "full").join(seen, key, "full")
    y = F.col("exercicios")
    kind = F.when(y.isNull() | (F.size(y) == 0), "sem catálogo de exercícios").when(F.array_contains(y, F.lit(year).cast("long")), "no catálogo oficial").otherwise("fora do catálogo oficial")
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(F.col(c)).cast("array<string>"), ","), F.lit(""))
    return found.select(*key, "nome", F.coalesce("no_catalogo", F.lit(False)).alias("no_catalogo"), F.array_min(y).alias("primeiro"), F.array_max(y).alias("ultimo"), listed("exercicios").alias("oficiais"), listed("vistos").alias("vistos"), kind.alias("situacao"))


def listed(entities: Column) -> Column:
    """``[1, 2]``."""
    return F.concat(F.lit("["), F.array_join(entities.cast("array<string>"), ", "), F.lit("]"))


def reasons(states: DataFrame) -> DataFrame:
    """(ex, df, motivo): why no total of the Municipality may be formed, state by state in the order of their first entities; NULL where one may."""
    grouped = states.groupBy("ex", "df", "situacao").agg(F.array_sort(F.collect_set("entidade")).alias("e"))
    said = F.struct(F.col("e")[0].alias("o"), F.concat(state_text(F.col("situacao")), F.lit(" para a(s) entidade(s) "), listed(F.col("e"))).alias("t"))
    agg = grouped.groupBy("ex", "df").agg(F.array_sort(F.collect_list(F.when(F.col("situacao").isin(*MISSING), said))).alias("m"), F.count_if(F.col("situacao").isin(*SUMMED)).alias("n"))
    why = F.when(F.size("m") > 0, F.array_join(F.transform("m", lambda x: x["t"]), "; ")).when(F.col("n") == 0, NONE_SUMMED)
    return agg.select("ex", "df", why.alias("motivo"))


def own_reason(state: Column, entity: Column) -> Column:
    """Why one entity by itself has no value at a cut-off; NULL if it has."""
    return F.when(state == "inexistente", NOT_THERE).when(state.isin(*MISSING), F.concat(state_text(state), F.lit(" para a(s) entidade(s) "), listed(F.array(entity))))


def warnings(state: Column, records: Column, entity: Column, year: Column, approximate: Column, refused: Column) -> Column:
    """What must be said of an entity at a cut-off, in order: a snapshot whose time of conclusion is approximate, a newer one that was refused, records that aren't summed."""
    of = F.concat(F.lit("entidade "), entity.cast("string"))
    there = F.coalesce(records, F.lit(0)) > 0
    said = F.array(
        F.when(records.isNotNull() & approximate, F.concat(of, F.lit(": horário de conclusão aproximado"))),
        F.when(refused, F.concat(of, F.lit(": retrato mais novo recusado"))),
        F.when(there & (state == "fora_do_escopo"), F.concat(of, F.lit(" fora do catálogo do portal com registros no snapshot: não compõe o Município"))),
        F.when(there & (state == "inexistente"), F.concat(of, F.lit(" fora do catálogo oficial de "), year.cast("string"), F.lit(" com registros no snapshot: não somados ao Município"))),
    )
    return F.array_compact(said)


def by_dimensions(rows: DataFrame, by: list[str], dimensions: list[str]) -> DataFrame:
    """(by, dimensao, chave, registros, inscricao, s1) for all dimensions in one pass; a NULL key is a group of its own. Keys are texts."""
    sets = [[F.col(c) for c in (*by, d)] for d in dimensions]
    found = rows.groupingSets(sets, *by, *dimensions).agg(
        *[F.grouping(d).alias(f"__g_{d}") for d in dimensions], F.count(F.lit(1)).alias("registros"), F.sum(F.col("proc") + F.col("aproc")).cast("long").alias("inscricao"), F.sum("s1").cast("long").alias("s1")
    )
    mine = lambda d: F.col(f"__g_{d}") == 0
    name = F.coalesce(*[F.when(mine(d), d) for d in dimensions])
    value = F.coalesce(*[F.when(mine(d), F.col(d).cast("string")) for d in dimensions])
    return found.select(*by, name.alias("dimensao"), value.alias("chave"), "registros", "inscricao", "s1")


def partition(parts: DataFrame, by: list[str], tops: dict[str, int]) -> DataFrame:
    """Blocks of a chart: parts (by, bloco, chave, ordem, valor, total) with their shares in tenths of a percent, whether they close, and why no pie may be drawn.

    In a block of ``tops`` the largest groups stay and the rest is one, ``demais (n grupos)``, unless that would stand for a single group. ``ordem`` is a fixed
    place or NULL (then by value, largest first, then by key). Shares are NULL where there is no pie; else they sum to 1000, and what rounding leaves goes to the largest remainders.
    """
    block = Window.partitionBy(*by, "bloco")
    key = F.coalesce(F.col("chave"), F.lit(NO_CLASS))
    top = F.try_element_at(F.create_map(*[x for n, t in tops.items() for x in (F.lit(n), F.lit(t))]), F.col("bloco"))
    rank = F.row_number().over(block.orderBy(F.col("ordem").asc_nulls_last(), F.desc("valor"), "chave"))
    ranked = parts.withColumn("chave", key).withColumns({"__k": rank, "__n": F.count(F.lit(1)).over(block), "__top": top})
    rest = F.coalesce((F.col("__n") > F.col("__top") + 1) & (F.col("__k") > F.col("__top")), F.lit(False))
    label = F.when(rest, F.concat(F.lit("demais ("), (F.col("__n") - F.col("__top")).cast("string"), F.lit(" grupos)"))).otherwise(F.col("chave"))
    whole = ranked.groupBy(*by, "bloco", "total", label.alias("chave")).agg(F.sum("valor").cast("long").alias("valor"), F.min("__k").cast("long").alias("posicao"))
    whole = whole.withColumns({"__s": F.sum("valor").over(block), "__low": F.min("valor").over(block)})
    apart = F.col("__s") - F.col("total")
    why = (
        F.when(apart != 0, F.concat(F.lit("as partes não somam o total (diferença de "), apart.cast("string"), F.lit(" centavos): o gráfico não é desenhado")))
        .when(F.col("total") == 0, "total zero: não há o que dividir")
        .when(F.col("__low") < 0, "há parte negativa, que um gráfico de pizza não representa: veja as colunas")
    )
    whole = whole.withColumn("motivo", why)
    pie = F.col("motivo").isNull()
    whole = whole.withColumns({"__f": F.when(pie, F.expr("valor * 1000 div total")), "__r": F.when(pie, F.expr("valor * 1000 % total"))})
    more = F.row_number().over(block.orderBy(F.desc("__r"), "posicao")) <= 1000 - F.sum("__f").over(block)
    return whole.withColumn("decimos", (F.col("__f") + more.cast("long")).cast("long")).select(*by, "bloco", "chave", "valor", "total", "posicao", "motivo", "decimos")
