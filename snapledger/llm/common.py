"""What the corpus operators share: lineage cuts, row filters by digest, skew-safe group lookups."""

from __future__ import annotations

import hashlib
import math
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run without space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a text whose words are held as objects at a time.
WINDOW_BYTES = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Ways a group of equal keys is split before it is gathered, at least, and rows of a split at most where one group holds all of them.
SALTS, SALT_ROWS = 16, 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Where that is unset, a temporary one if all runs in one process, as in tests, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows, on whatever file system it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def salts_for(rows: int) -> int:
    return max(SALTS, math.ceil(rows / SALT_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind, which else stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package shipped to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the workers once a context, so that they can import it wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_snapledger_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        sources = {str(f.relative_to(root.parent)): f.read_bytes() for f in sorted(root.rglob("*.py"))}
        name = hashlib.sha256(repr(sorted(sources.items())).encode()).hexdigest()[:12]
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), f"snapledger-{name}.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file, data in sources.items():
                out.writestr(file, data)
        context.addPyFile(path)
    context._snapledger_shipped = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def word_windows(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some megabytes at a time, so that a very long text needs little more memory than its bytes."""
    begin = 0
    while len(data) - begin > WINDOW_BYTES:
        space = _SPACE.search(data, begin + WINDOW_BYTES)
        end = space.start() if space else len(data)
        yield data[begin:end].split()
        begin = end
    yield data[begin:].split()


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out from all learning."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def windowed(text: Column, id_col: Column, most: int, windows: int = 10) -> Column:
    """text, or of one longer than ``most`` code points so many in windows: one in each equal part of the text, its place chosen by hash, with spaces between."""
    n, width = F.length(text), most // windows
    part = F.floor(n / windows)
    at = lambda i: (F.lit(i) * part + F.pmod(F.xxhash64(F.lit("window"), id_col, F.lit(i)), part - width + 1) + 1).cast("int")
    return F.when(n <= most, text).otherwise(F.concat_ws(" ", *[F.substring(text, at(i), F.lit(width)) for i in range(windows)]))


def text_key(text_col: str) -> Column:
    """A digest of the original text that tells rows apart which share an id."""
    return F.xxhash64(F.col(text_col))


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns whose names begin with two underscores, as those that operators add do, under other names (but for the columns used), and how to name them back."""
    odd = [c for c in docs.columns if c.startswith("__") and c not in used]
    prefix = "kept_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    names = {c: f"{prefix}{i}" for i, c in enumerate(odd)}
    return docs.withColumnsRenamed(names) if names else docs, {v: k for k, v in names.items()}


def keep_rows(docs: DataFrame, keepers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs whose (id, text digest) is in keepers (columns __id, __key, unique); repeated rows once.

    docs are shuffled once: the join and the removal of repeats use one key that is never null.
    """
    one = lambda i, k: F.concat(F.when(i.isNull(), "n").otherwise(F.concat(F.lit("i"), i.cast("string"))), F.lit("/"), F.hex(k))
    docs, back = shielded(docs, id_col, text_col)
    tagged = docs.withColumn("__row", one(F.col(id_col), text_key(text_col)))
    k = keepers.select(one(F.col("__id"), F.col("__key")).alias("__row"))
    return tagged.join(k, "__row", "left_semi").dropDuplicates(["__row"]).select(*[F.col(f"`{c}`") for c in docs.columns]).withColumnsRenamed(back)


def by_row(id_col: str) -> Column:
    """What spreads rows evenly, rows without id and rows that repeat one too: the id with the row's own number. Only for rows that are cut from their lineage, where a row keeps its number."""
    return F.struct(F.col(id_col), F.monotonically_increasing_id().alias("n"))


def best_per_group(rows: DataFrame, group: str, order: Column, spread: Column) -> DataFrame:
    """rows (cut from their lineage) with __best (least order of the row's group) and __count, without gathering a group in one task.

    Each group is first reduced in parts, as many as the number of rows asks for, the parts (one row a group and part) are combined, and the
    rows find their group's result by (group, part), so a group with a third of all rows spreads over as many keys.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts_for(rows.count()))).cast("int"))
    parts = salted.groupBy(group, "__salt").agg(F.min(order).alias("__b"), F.count(F.lit(1)).alias("__c"))
    whole = parts.groupBy(group).agg(
        F.min("__b").alias("__best"), F.sum("__c").alias("__count"), F.collect_list("__salt").alias("__salts")
    )
    lookup = whole.select(F.col(group).alias("__g"), "__best", "__count", F.explode("__salts").alias("__s"))
    return salted.join(lookup, (F.col(group) == F.col("__g")) & (F.col("__salt") == F.col("__s"))).drop("__g", "__s", "__salt")


def spread_join(rows: DataFrame, key: str, table: DataFrame, spread: Column) -> DataFrame:
    """rows (cut from their lineage) joined with table (one row for each key); a key with very many rows spreads over as many keys as their number asks for."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts_for(rows.count()))).cast("int"))
    lookup = salted.select(key, "__salt").distinct().join(table, key)
    return salted.join(lookup, [key, "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected graph with edges (a, b); root is the least node reachable.

    Least labels spread along edges and each label is then replaced by its own label (pointer jumping), so
    the number of rounds follows the logarithm of the longest path. All state stays in DataFrames; every round
    is cut by a checkpoint. Hubs are safe: their neighbours are reduced by a partial minimum.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        seen = label.select(F.col("node").alias("b"), F.col("root").alias("r"))
        near = both.join(seen, "b").groupBy("a").agg(F.min("r").alias("r"))
        lower = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        above = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = checkpointed(lower.join(above, "root").select("node", "old", F.least("root", "up").alias("root")))
        changed = step.where("root <> old").limit(1).count()
        label = step.select("node", "root")
        if not changed:
            return label
