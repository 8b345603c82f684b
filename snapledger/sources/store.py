"""The object store and its manifests: everything else is a pure function of these."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import canonical_instant

RESPONSE = "struct<ordem:int,url:string,http_status:int,recebida_em:string,sha256:string,tamanho:bigint>"
MANIFEST = f"formato int, snapshot_uid string, tipo string, endpoint string, parametros map<string,string>, coletada_em string, coleta_finalizada_em string, origem_carimbo string, status string, coletor string, observacao string, respostas array<{RESPONSE}>, segunda_leitura array<{RESPONSE}>, __corrupt string"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each manifest file; text that isn't one is kept in __corrupt."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("columnNameOfCorruptRecord", "__corrupt").json(path)


def collections(manifests: DataFrame) -> DataFrame:
    """Collections with start, conclusion and what the conclusion rests on: recorded, last response (second reading included), or nothing."""
    last = F.array_max(F.transform(F.concat(F.coalesce("respostas", F.array()), F.coalesce("segunda_leitura", F.array())), lambda r: canonical_instant(r["recebida_em"])))
    recorded = canonical_instant(F.col("coleta_finalizada_em"))
    basis = F.when(recorded.isNotNull(), "registrada").when(last.isNotNull(), "ultima_resposta").otherwise("sem_evidencia")
    return manifests.where("__corrupt is null").select("snapshot_uid", "tipo", "parametros", "status", canonical_instant(F.col("coletada_em")).alias("inicio_em"), F.coalesce(recorded, last).alias("concluida_em"), basis.alias("evidencia"))


def responses(manifests: DataFrame) -> DataFrame:
    return manifests.where("__corrupt is null").select(F.col("snapshot_uid").alias("coleta"), F.explode("respostas").alias("r")).select("coleta", "r.*")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, tamanho, body, integro): stored files, each named by its hash, checked against it."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1)
    return files.select(name.alias("sha256"), F.col("length").alias("tamanho"), F.col("content").alias("body"), (F.sha2("content", 256) == name).alias("integro"))


def new_objects(bodies: DataFrame, stored: DataFrame) -> DataFrame:
    """Bodies that aren't stored yet, once each, under their hash."""
    keyed = bodies.withColumn("sha256", F.sha2("body", 256)).dropDuplicates(["sha256"])
    return keyed.join(stored.select("sha256"), "sha256", "left_anti").select("sha256", F.octet_length("body").cast("long").alias("tamanho"), "body")


def import_groups(files: DataFrame, pattern: str = r"^(.*?)[_-]p(\d+)\.json$") -> DataFrame:
    """Historic page files (path, sha256) as collections: the name before the page number names one; a page with two contents is a conflict."""
    rows = files.select(F.regexp_extract("path", pattern, 1).alias("grupo"), F.regexp_extract("path", pattern, 2).try_cast("int").alias("pagina"), "sha256").where("pagina is not null")
    pages = rows.groupBy("grupo", "pagina").agg(F.count_distinct("sha256").alias("n"))
    found = pages.groupBy("grupo").agg(F.count(F.lit(1)).alias("paginas"), F.max("pagina").alias("maior"), (F.max("n") > 1).alias("conflito"))
    return found.withColumn("uid", F.substring(F.sha2("grupo", 256), 1, 32)).withColumn("completo", ~F.col("conflito") & ((F.col("maior") == F.col("paginas")) | (F.col("maior") + 1 == F.col("paginas"))))


def publications(groups: DataFrame, body: str = "body", name: str = "Anexo VII") -> DataFrame:
    """Files of a publications list (groups hold lists, these hold files) whose name contains the given text."""
    shape = "array<struct<list:array<struct<list:array<struct<idArquivo:bigint,valor:string,nomeArquivo:string,dataArquivo:string>>>>>>"
    outer = groups.select(F.explode(F.from_json(body, shape)).alias("g")).select(F.explode("g.list").alias("s")).select(F.explode("s.list").alias("f"))
    return outer.select("f.*").where(F.col("nomeArquivo").contains(name) | F.col("valor").contains(name))


def coverage_of(store: DataFrame, database: DataFrame, key: str = "sha256") -> DataFrame:
    """What one side has and the other lacks."""
    a = store.select(key).distinct().join(database.select(key), key, "left_anti").withColumn("falta_em", F.lit("banco"))
    return a.unionByName(database.select(key).distinct().join(store.select(key), key, "left_anti").withColumn("falta_em", F.lit("acervo")))


def append_only(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Write a layer once; an existing one is an error, never overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Where that is unset, a temporary one if all runs in one process, else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(context, "_snapledger_folder"):
        context._snapledger_folder = tempfile.mkdtemp(prefix="spark-")
    return context._snapledger_folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> bool:
    system, p = _path(spark, path)
    return system.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new small file; False if there is one by that name already, which stays as it is."""
    system, p = _path(spark, path)
    system.mkdirs(p.getParent())
    try:
        out = system.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()) or system.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    system, p = _path(spark, path)
    stream = system.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _versions(spark: SparkSession, root: str) -> list[str]:
    system, p = _path(spark, f"{root}/_published")
    return sorted(f.getPath().getName() for f in system.listStatus(p)) if system.exists(p) else []


def published(spark: SparkSession, root: str) -> str | None:
    """The name that was last published under root. A file that a writer has created and not filled yet doesn't count."""
    for version in reversed(_versions(spark, root)):
        if name := read_text(spark, f"{root}/_published/{version}").strip():
            return name
    return None


def publish(spark: SparkSession, root: str, name: str) -> str:
    """Make a name the one that counts under root, as the next in a row of small files, each created only if no other writer has; returns the file's name."""
    while True:
        last = _versions(spark, root)
        number = f"{int(last[-1]) + 1 if last else 0:012d}"
        if write_text(spark, f"{root}/_published/{number}", name):
            return number


#: Schemas of layers by name and version; a version has one.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def _state(spark: SparkSession, paths: list[str]) -> str:
    """What tells one state of the source tables from another: every file's path, length and time of change."""
    found = []
    for path in paths:
        system, p = _path(spark, path)
        files = system.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join([*paths, *sorted(found)]).encode()).hexdigest()[:20]


def size_of(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of the files under the paths."""
    return sum(system.getContentSummary(p).getLength() for system, p in (_path(spark, path) for path in paths))


def _whole(spark: SparkSession, base: str) -> list[str]:
    """Folders of a layer's state that are marked as whole."""
    system, p = _path(spark, f"{base}/_whole")
    return sorted(n for f in system.listStatus(p) if not (n := f.getPath().getName()).startswith(".")) if system.exists(p) else []


def layer(spark: SparkSession, name: str, version: str, sources: list[str], build: Callable[[], DataFrame], partitions: list[str], order: list[str], dealt: bool = False) -> DataFrame:
    """A derived table that is written once for each state of its sources and read by every query after that, pruned to the partitions it asks for.

    version names the rules that make it. Partitions of very different sizes are rebalanced into files of about the advisory size before they are written, unless build has
    ``dealt`` its rows itself. A writer
    writes a folder of its own and marks it when it is whole; readers take the first marked one by name. Of writers at the same time each makes the same rows, so any whole
    folder is right, and one that isn't the first is removed by its writer. What a writer that died has left is never read; ``old_states`` lists it and the folders of earlier states.
    """
    base = f"{shared_folder(spark)}/snapledger/{name}-{version}-{_state(spark, sources)}"
    if not _whole(spark, base):
        own = uuid.uuid4().hex
        rows = build() if dealt else build().hint("rebalance", *partitions)
        append_only(rows.sortWithinPartitions(*partitions, *order), f"{base}/{own}", partitions)
        write_text(spark, f"{base}/_whole/{own}", "")
        if _whole(spark, base)[0] != own:
            remove(spark, f"{base}/_whole/{own}")
            remove(spark, f"{base}/{own}")
    folder = _whole(spark, base)[0]
    if (name, version) not in _SCHEMAS:
        _SCHEMAS[name, version] = build().schema
    return spark.read.schema(_SCHEMAS[name, version]).parquet(f"{base}/{folder}")


def old_states(spark: SparkSession, name: str, version: str, sources: list[str]) -> list[str]:
    """Folders of a layer that the present state of its sources doesn't read: other states, other versions, and what writers that died have left. ``remove`` deletes them."""
    root, now = f"{shared_folder(spark)}/snapledger", f"{name}-{version}-{_state(spark, sources)}"
    system, p = _path(spark, root)
    if not system.exists(p):
        return []
    stale = [str(f.getPath()) for f in system.listStatus(p) if f.getPath().getName().startswith(f"{name}-") and f.getPath().getName() != now]
    whole, (_, mine) = _whole(spark, f"{root}/{now}"), _path(spark, f"{root}/{now}")
    if whole:
        stale += [str(f.getPath()) for f in system.listStatus(mine) if f.isDirectory() and f.getPath().getName() not in ("_whole", whole[0])]
    return sorted(stale)
