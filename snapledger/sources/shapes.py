"""The nested shape of JSON: the paths of all bodies with the kinds of values there, compared between two collections; and the canonical text of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the root that are followed; what is deeper is told, not followed.
DEPTH = 12
TOO_DEEP = "profundo"
OK, CHANGED, UNAVAILABLE = "ok", "mudou", "indisponivel"


def canonical(json: Column) -> Column:
    """The text of a JSON value with sorted keys at every level and without blanks, so that neither their order nor the writer's spacing tells two records apart. NULL if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def record_hash(json: Column) -> Column:
    return F.sha2(canonical(json), 256)


def kind(value: Column) -> Column:
    """null, boolean, number, string, array or object."""
    names = F.create_map(*[F.lit(x) for kv in {"VOID": "null", "BOOLEAN": "boolean", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}.items() for x in kv])
    # the schema of a value is worked out once; branches of a WHEN would each work it out again
    return F.coalesce(F.try_element_at(names, F.substring_index(F.schema_of_variant(value), "<", 1)), F.lit("number"))


def paths(bodies: DataFrame, json: str, by: list[str], depth: int = DEPTH) -> DataFrame:
    """(by, caminho, tipo, vezes): every path of the bodies with a kind of value found there, and how often. Bodies that aren't JSON have none.

    Each step down adds the members of the objects and arrays that the step before has found and lets all others pass, so bodies are parsed once and nothing is joined. A value
    below ``depth`` levels is told by the kind ``profundo`` at its path and not opened.
    """
    rows = bodies.select(*by, F.lit("$").alias("caminho"), F.try_parse_json(json).alias("v")).where("v is not null").select(*by, "caminho", "v", kind(F.col("v")).alias("tipo"), F.lit(True).alias("novo"))
    for level in range(depth + 1):
        opened = F.col("novo") & F.col("tipo").isin("object", "array")
        if level == depth:
            rows = rows.withColumn("tipo", F.when(opened, TOO_DEEP).otherwise(F.col("tipo")))
            break
        own = F.array(F.struct(F.col("caminho"), F.lit(None).cast("variant").alias("v"), F.col("tipo"), F.lit(False).alias("novo")))
        members = F.transform(F.map_entries(F.expr("try_cast(v as map<string,variant>)")), lambda e: F.struct(F.concat("caminho", F.lit("."), e["key"]).alias("caminho"), e["value"].alias("v"), kind(e["value"]).alias("tipo"), F.lit(True).alias("novo")))
        items = F.transform(F.expr("try_cast(v as array<variant>)"), lambda x: F.struct(F.concat("caminho", F.lit("[]")).alias("caminho"), x.alias("v"), kind(x).alias("tipo"), F.lit(True).alias("novo")))
        below = F.when(opened & (F.col("tipo") == "object"), members).when(opened, items)
        every = F.when(opened, F.concat(own, below)).otherwise(F.array(F.struct("caminho", "v", "tipo", F.lit(False).alias("novo"))))
        rows = rows.select(*by, F.explode(every).alias("x")).select(*by, "x.caminho", "x.v", "x.tipo", "x.novo")
    return rows.groupBy(*by, "caminho", "tipo").agg(F.count(F.lit(1)).alias("vezes"))


def shape(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, caminho, tipos): kinds of each path, sorted and joined by a bar."""
    return found.groupBy(*by, "caminho").agg(F.array_join(F.array_sort(F.collect_set("tipo")), "|").alias("tipos"))


def shape_hash(shapes: DataFrame, by: list[str]) -> DataFrame:
    """(by, caminhos, forma_sha256): the hash of the sorted lines path:kinds. A contract has as many lines as it has paths, whatever the number of bodies."""
    line = F.concat_ws(":", "caminho", "tipos")
    return shapes.groupBy(*by).agg(F.count(F.lit(1)).alias("caminhos"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("forma_sha256"))


def changes(reference: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """Paths that are new, removed, or have a kind that the reference hasn't; a NULL alone is no change, as an optional field may come empty."""
    a, b = reference.select(*by, "caminho", F.col("tipos").alias("antes")), now.select(*by, "caminho", F.col("tipos").alias("agora"))
    both = a.join(b, [*by, "caminho"], "full")
    fresh = F.array_except(F.array_except(F.split("agora", r"\|"), F.array(F.lit("null"))), F.split("antes", r"\|"))
    what = F.when(F.col("antes").isNull(), "novo").when(F.col("agora").isNull(), "removido").when(F.size(fresh) > 0, "tipo diferente")
    return both.select(*by, "caminho", "antes", "agora", what.alias("mudanca")).where("mudanca is not null")


def verdict(samples: DataFrame, json: str, found: DataFrame, by: list[str]) -> DataFrame:
    """What a probe says of each collection: ``indisponivel`` if none of its bodies is JSON, ``mudou`` if its shape has changed, else ``ok``."""
    read = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("corpos"), F.count(F.try_parse_json(json)).alias("lidos"))
    changed = found.groupBy(*by).agg(F.count(F.lit(1)).alias("mudancas"))
    n = F.coalesce("mudancas", F.lit(0))
    return read.join(changed, by, "left").select(*by, "corpos", "lidos", n.alias("mudancas"), F.when(F.col("lidos") == 0, UNAVAILABLE).when(n > 0, CHANGED).otherwise(OK).alias("resultado"))
