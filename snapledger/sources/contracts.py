"""The arrival contract of JSON pages: what was sent, typed exactly or refused, never repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import exact_cents

#: Fields of a record that must be there, by JSON type.
INT_FIELDS = ["entidade", "anoempenho", "empenho", "fonteRecurso", "fornecedor"]
TEXT_FIELDS = ["empenhoExercicio", "cnpjNome", "programatica", "descricaoFonte", "nome", "cnpj", "desdobraDesp", "subDesdobramento", "dataEmissao"]
MONEY_FIELDS = ["proc", "aproc", "canceladoProc", "pagoProc", "pagoProcEstornado", "canceladoAProc", "pagoAProc", "pagoAProcEstornado", "liquidado", "retencao"]
#: Fields that come all together or not at all.
GROUP_FIELDS = ["orgao", "unidade", "funcao", "subFuncao", "programa", "projeto", "elemento"]
#: Spark's names of the types that JSON numbers become.
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
PAGE_FIELDS = {"content": "ARRAY", "number": "BIGINT", "numberOfElements": "BIGINT", "size": "BIGINT", "totalElements": "BIGINT", "totalPages": "BIGINT", "first": "BOOLEAN", "last": "BOOLEAN", "empty": "BOOLEAN", "sort": "ARRAY", "pageable": "OBJECT"}


def _kind(item: Column, path: str) -> Column:
    """JSON type at a path: ``absent``, NULL literal as ``VOID``, else the head of Spark's name of the type."""
    v = F.try_variant_get(item, path, "variant")
    return F.when(v.isNull(), "absent").otherwise(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def page_violations(pages: DataFrame, body: str = "body") -> DataFrame:
    """pages with the first rule of the page contract that each breaks (NULL if none): JSON, presence, type, coherence."""
    rows = pages.withColumn("__v", F.try_parse_json(body))
    n = lambda f: F.try_variant_get("__v", f"$.{f}", "bigint")
    b = lambda f: F.try_variant_get("__v", f"$.{f}", "boolean")
    rules = [F.when(F.col("__v").isNull(), "não é JSON")]
    for f, kind in PAGE_FIELDS.items():
        rules += [F.when(_kind(F.col("__v"), f"$.{f}") == "absent", f"{f}: ausente"), F.when(_kind(F.col("__v"), f"$.{f}") != kind, f"{f}: tipo")]
    items = F.size(F.try_variant_get("__v", "$.content", "array<variant>"))
    rules += [
        F.when(n("number") < 0, "number: domínio"),
        F.when(n("size") <= 0, "size: domínio"),
        F.when(n("numberOfElements") != items, "numberOfElements: incoerente"),
        F.when(b("empty") != (items == 0), "empty: incoerente"),
        F.when(b("first") != (n("number") == 0), "first: incoerente"),
        F.when(n("totalPages") != F.floor((n("totalElements") + n("size") - 1) / n("size")), "totalPages: incoerente"),
    ]
    return rows.withColumn("violacao", F.coalesce(*rules)).drop("__v")


def items(pages: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """(key, indice, item): the elements of ``content`` of every page that is one; other bodies give no rows."""
    content = F.try_variant_get(F.try_parse_json(body), "$.content", "array<variant>")
    return pages.select(*key, F.posexplode(content).alias("indice", "item"))


def _refused(value: Column) -> Column:
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(value.isNull(), "ausente").when(kind == "VOID", "nulo").when(~kind.isin(*NUMBERS), "invalido").when(_cents(value).isNull(), "invalido")


def _cents(value: Column) -> Column:
    return F.when(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).isin(*NUMBERS), exact_cents(F.try_variant_get(value, "$", "string")))


def refusal(item: Column, field: str) -> Column:
    """``ausente``, ``nulo``, ``invalido`` or NULL: what keeps a money field from being exact cents.

    Texts, booleans, and numbers with more than two decimals are invalid. A number never goes through a DOUBLE unless it was written with an exponent.
    """
    return _refused(F.try_variant_get(item, f"$.{field}", "variant"))


def money(item: Column, field: str) -> Column:
    """Cents, NULL where refused."""
    return _cents(F.try_variant_get(item, f"$.{field}", "variant"))


def records(found: DataFrame, key: list[str]) -> DataFrame:
    """Typed records of items whose money fields are all exact, with the keys that are missing and those not expected."""
    item = F.col("item")
    # all money fields are taken out of the item in one go; a field is refused just where it gives no cents
    fields = F.try_variant_get(item, "$", f"struct<{', '.join(f'{f}: variant' for f in MONEY_FIELDS)}>")
    priced = found.withColumn("__m", fields).withColumns({f"{f}_c": _cents(F.col(f"__m.{f}")) for f in MONEY_FIELDS})
    clean = priced.where(" and ".join(f"{f}_c is not null" for f in MONEY_FIELDS))
    expected = F.array(*[F.lit(f) for f in (*INT_FIELDS, *TEXT_FIELDS, *MONEY_FIELDS, *GROUP_FIELDS)])
    there = F.json_object_keys(F.to_json(item))
    text = lambda f: F.try_variant_get(item, f"$.{f}", "string")
    return clean.select(
        *key, "indice", *[F.try_variant_get(item, f"$.{f}", "bigint").alias(f) for f in INT_FIELDS], *[text(f).alias(f) for f in TEXT_FIELDS[:-1]], text("dataEmissao").try_cast("date").alias("data_emissao"),
        *[f"{f}_c" for f in MONEY_FIELDS], *[text(f).alias(f) for f in GROUP_FIELDS],
        F.array_except(expected, there).alias("chaves_ausentes"), F.array_except(there, expected).alias("chaves_extras"),
    )


def refused_values(found: DataFrame, key: list[str]) -> DataFrame:
    """One row for each refused money field: key, index, field, reason, and the raw JSON of an invalid value."""
    item = F.col("item")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("campo"), F.try_variant_get(item, f"$.{f}", "variant").alias("v")) for f in MONEY_FIELDS]))
    judged = found.select(*key, "indice", each.alias("x")).select(*key, "indice", "x.campo", "x.v").withColumn("motivo", _refused(F.col("v"))).where("motivo is not null")
    return judged.select(*key, "indice", "campo", "motivo", F.when(F.col("motivo") == "invalido", F.to_json("v")).alias("bruto"))


def record_violations(found: DataFrame, key: list[str]) -> DataFrame:
    """Items that break the record contract, with the first broken rule: not an object, unknown keys, missing keys, partial group, types (NULL is never of any type)."""
    text, number, whole = F.array(F.lit("STRING")), F.array(*[F.lit(n) for n in NUMBERS]), F.array(F.lit("BIGINT"))
    allowed = F.create_map(*[x for names, t in ((INT_FIELDS, whole), (TEXT_FIELDS, text), (MONEY_FIELDS, number), (GROUP_FIELDS, text)) for n in names for x in (F.lit(n), t)])
    kinds, there = F.col("__kinds"), F.map_keys("__kinds")
    must = F.array(*[F.lit(f) for f in (*INT_FIELDS, *TEXT_FIELDS, *MONEY_FIELDS)])
    group = F.array(*[F.lit(f) for f in GROUP_FIELDS])
    some = F.size(F.array_intersect(there, group))
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    wrong = F.transform(F.filter(F.map_entries(kinds), lambda e: ~F.array_contains(F.try_element_at(allowed, e["key"]), e["value"])), lambda e: e["key"])
    rule = F.coalesce(
        F.when(kinds.isNull(), "não é um objeto"),
        F.when(F.size(F.array_except(there, F.concat(must, group))) > 0, F.concat(F.lit("chave desconhecida: "), listed(F.array_except(there, F.concat(must, group))))),
        F.when(F.size(F.array_except(must, there)) > 0, F.concat(F.lit("chave ausente: "), listed(F.array_except(must, there)))),
        F.when((some > 0) & (some < len(GROUP_FIELDS)), "grupo incompleto"),
        F.when(F.size(wrong) > 0, F.concat(F.lit("tipo: "), listed(wrong))),
    )
    types = F.transform_values(F.try_variant_get("item", "$", "map<string,variant>"), lambda k, v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    # an explode of one rule or none instead of a filter, which the optimizer would push below and work out twice
    return found.withColumn("__kinds", types).select(*key, "indice", F.explode(F.array_compact(F.array(rule))).alias("violacao"))


#: What a catalog's items must have at least, by path and type.
CATALOGS = {
    "entidades": {"$.id": "BIGINT", "$.nome": "STRING"},
    "exercicios": {"$.id.entidade.id": "BIGINT", "$.id.exercicio": "BIGINT", "$.aberto": "BOOLEAN", "$.fechado": "BOOLEAN"},
}


def list_items(bodies: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """(key, indice, item) of bodies that are JSON lists; others give no rows."""
    items = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    return bodies.select(*key, F.posexplode(items).alias("indice", "item"))


def catalog_violations(found: DataFrame, kind: str) -> DataFrame:
    """found with the first path that is absent or of another type (NULL if none)."""
    rules = [F.when(_kind(F.col("item"), p) != t, F.concat(F.lit(f"{p}: "), _kind(F.col("item"), p))) for p, t in CATALOGS[kind].items()]
    return found.withColumn("violacao", F.coalesce(*rules))


def catalog_years(found: DataFrame) -> DataFrame:
    """(entidade, ex, aberto, fechado) of a catalog of fiscal years."""
    v = lambda p, t: F.try_variant_get("item", p, t)
    return found.select(v("$.id.entidade.id", "bigint").alias("entidade"), v("$.id.exercicio", "bigint").alias("ex"), v("$.aberto", "boolean").alias("aberto"), v("$.fechado", "boolean").alias("fechado"))


def collection_status(pages: DataFrame, by: str, good: Column) -> DataFrame:
    """Each collection of pages: complete if every page is good, failed if none is, else incomplete."""
    found = pages.groupBy(by).agg(F.count(F.lit(1)).alias("paginas"), F.count_if(good).alias("boas"))
    return found.withColumn("status", F.when(F.col("boas") == F.col("paginas"), "completa").when(F.col("boas") == 0, "falhou").otherwise("incompleta"))


def repeated_records(rows: DataFrame, by: str, key: list[str], page: str, content: Column) -> DataFrame:
    """Business keys that come more than once in a collection: how often, on how many pages, and whether the records are alike."""
    found = rows.groupBy(by, *key).agg(F.count(F.lit(1)).alias("vezes"), F.count_distinct(page).alias("paginas"), F.count_distinct(content).alias("conteudos")).where("vezes > 1")
    return found.withColumn("tipo", F.when(F.col("conteudos") == 1, "exata").otherwise("conflitante"))


def refused_collections(refusals: DataFrame, by: str, kind: str, order: tuple[str, ...] = ("CHAVE-DUP", "VALOR-RECUSADO")) -> DataFrame:
    """Each refused collection with the reason that comes first."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(kind))
    return refusals.groupBy(by).agg(F.min_by(kind, rank).alias("motivo"), F.count(F.lit(1)).alias("ocorrencias"))


def paging(pages: DataFrame, by: str = "coleta") -> DataFrame:
    """Each collection's pages (columns numero, elementos, total, ultima) against each other: constant total, its sum, no gap, last flag."""
    agg = pages.groupBy(by).agg(
        F.count_distinct("total").alias("totais"), F.max("total").alias("total"), F.sum("elementos").cast("long").alias("lidos"), F.count(F.lit(1)).alias("paginas"), F.max("numero").alias("maior"), F.count_distinct("numero").alias("numeros"), F.count_if("ultima").alias("ultimas"), F.max_by("ultima", "numero").alias("fim")
    )
    rule = (
        F.when(F.col("totais") > 1, "total mudou entre páginas")
        .when((F.col("maior") + 1 != F.col("paginas")) | (F.col("numeros") != F.col("paginas")), "página ausente ou repetida")
        .when(F.col("lidos") != F.col("total"), "soma difere do total")
        .when((F.col("ultimas") != 1) | ~F.col("fim"), "marca de última página")
    )
    return agg.select(by, "total", "lidos", "paginas", rule.alias("violacao"), F.when(rule.isNull(), "completa").otherwise("incompleta").alias("status"))


def out_of_order(found: DataFrame, by: str, page: str, index: str, order: list[str]) -> DataFrame:
    """Rows whose order key is below that of the row before them in the same collection."""
    w = Window.partitionBy(by).orderBy(page, index)
    return found.withColumn("__p", F.lag(F.struct(*order)).over(w)).where(F.struct(*order) < F.col("__p")).drop("__p")


def second_read(first: DataFrame, second: DataFrame, key: list[str], value: str = "sha256") -> DataFrame:
    """Pages on which two reads of a collection differ, one-sided ones too (NULL-safe)."""
    a, b = first.select(*key, F.col(value).alias("primeira")), second.select(*key, F.col(value).alias("segunda"))
    return a.join(b, key, "full").where(~F.col("primeira").eqNullSafe(F.col("segunda")))


def path_types(rows: DataFrame, body: str) -> DataFrame:
    """For each top-level path of JSON objects: the set of types, how many rows have it, and whether all do."""
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    parsed = rows.select(F.try_parse_json(body).alias("__v"), F.json_object_keys(body).alias("__k"))
    each = parsed.select("__v", F.explode("__k").alias("chave")).select("chave", F.schema_of_variant(F.element_at(F.try_variant_get("__v", "$", "map<string,variant>"), F.col("chave"))).alias("t"))
    found = each.groupBy(F.concat(F.lit("$."), F.col("chave")).alias("caminho")).agg(F.array_join(F.array_sort(F.collect_set(F.regexp_extract("t", "^[A-Z]+", 0))), ",").alias("tipos"), F.count(F.lit(1)).alias("registros"))
    return found.crossJoin(F.broadcast(total)).select("caminho", "tipos", "registros", (F.col("registros") == F.col("__n")).alias("obrigatorio"))  # total is one row


def shape_changes(reference: DataFrame, sample: DataFrame) -> DataFrame:
    """Paths that are new, gone, or of other types than in a reference (a type that is only ``VOID`` is no change)."""
    a = reference.select("caminho", F.col("tipos").alias("antes"), "obrigatorio")
    b = sample.select("caminho", F.col("tipos").alias("agora"))
    known = lambda c: F.array_remove(F.split(c, ","), F.lit("VOID"))
    kind = F.when(F.col("antes").isNull(), "novo").when(F.col("agora").isNull() & F.col("obrigatorio"), "removido").when(F.size(F.array_except(known("agora"), known("antes"))) > 0, "tipo mudou")
    return a.join(b, "caminho", "full").withColumn("mudanca", kind).where("mudanca is not null").select("caminho", "mudanca", "antes", "agora")
