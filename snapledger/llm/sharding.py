"""Operator 1, sharding by a two-pass external shuffle. Built from DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shielded

SHARDS = 16
SEED = 20_231
#: A bucket is gathered in one task's memory: at most about so many rows, and so many bytes of payload.
BUCKET_ROWS = 20_000
BUCKET_BYTES = 64 << 20
#: Equal rows are many if they would take more than this part of a bucket; copies of such rows are dealt out so many at a time.
MANY, COPIES = 8, 1000


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row, about: those of strings and binaries, eight of other plain values, the JSON text of nested ones."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        own = F.octet_length(c) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.octet_length(F.to_json(F.struct(c))) if nested else F.lit(8)
        size = size + F.coalesce(own, F.lit(0))
    return size


def scattered(df: DataFrame, key_col: str, seed: int, size_col: str | None, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """df with __bucket and __order, and the number of buckets, which follows from rows and bytes.

    Both are hashes of the key, the whole row and, for rows with very many equal ones, the number of the copy. Such rows are counted with a map-side
    part and written out again as often, so neither a key nor a row can fill a bucket.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    digest = F.xxhash64(F.lit(seed), *columns)
    size = F.col(f"`{size_col}`") if size_col else row_bytes(df)
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, math.ceil(n / bucket_rows), math.ceil(total / bucket_bytes))
    rows = df.withColumns({"__digest": digest, "__copy": F.lit(0).cast("long")})
    if buckets > 1:
        many = df.select(digest.alias("__many"), size.alias("__n")).groupBy("__many").agg(F.count(F.lit(1)).alias("__c"), F.sum("__n").alias("__s"))
        # at most 2 * MANY rows a bucket
        many = many.where((F.col("__c") > 1) & ((F.col("__c") > bucket_rows // MANY) | (F.col("__s") > bucket_bytes // MANY))).select("__many")
        if not many.isEmpty():
            equal = F.col("__digest") == F.col("__many")
            counted = rows.join(F.broadcast(many), equal, "left_semi").groupBy(*columns, "__digest").agg(F.count(F.lit(1)).alias("__c"))
            spread = counted.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1, F.lit(COPIES).cast("long")))).repartition(buckets, "__digest", "__from")
            copies = spread.withColumn("__copy", F.explode(F.sequence("__from", F.least(F.col("__from") + COPIES, "__c") - 1)))
            rows = rows.join(F.broadcast(many), equal, "left_anti").unionByName(copies.select(*columns, "__digest", "__copy"))
    hashed = lambda s: F.xxhash64(F.lit(s), F.col(f"`{key_col}`"), F.col("__digest"), F.col("__copy"))
    return rows.withColumns({"__bucket": F.pmod(hashed(seed), F.lit(buckets)).cast("int"), "__order": hashed(seed + 1)}).drop("__digest", "__copy"), buckets


def external_shuffle(df: DataFrame, key_col: str = "doc_id", shards: int = SHARDS, seed: int = SEED, size_col: str | None = None, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df in a seeded random order over ``shards`` shards: its columns with shard (int) and slot (long).

    Pass 1 scatters the rows into buckets by a seeded hash of the row, one bucket a partition; the number of buckets follows from the rows and
    their bytes (size_col, or else row_bytes), so that a bucket fits in memory. Pass 2 orders each bucket
    by hash (so the outcome doesn't depend on arrival or on a retried task) and applies ``shuffle``, Spark's
    Fisher-Yates shuffle of an array, seeded with the seed and the bucket. A row's place in the whole order is its
    bucket's start plus its place in the bucket; place modulo shards is the shard, and the quotient its slot. So the shards' counts
    differ by one at most and slots have no gaps.

    Equal or null keys, and equal rows, are spread over the buckets like others. Columns must be of types that can be hashed and ordered (no maps);
    columns of df that are called shard or slot are replaced, others of any name stay. Texts of any length go with their rows; a bucket holds one row at least.
    An empty table gives an empty table.
    """
    df, back = shielded(df.drop("shard", "slot"), key_col, size_col or key_col)
    columns = df.columns
    found, buckets = scattered(df, key_col, seed, size_col, bucket_rows, bucket_bytes)
    rows = F.struct("__order", *[F.col(f"`{c}`") for c in columns])
    gathered = (
        found.repartitionById(buckets, F.col("__bucket"))
        .groupBy("__bucket")
        .agg(F.sort_array(F.collect_list(rows)).alias("__rows"))
        .withColumn("__rows", F.shuffle("__rows", seed))
    )
    placed = gathered.select("__bucket", F.posexplode("__rows").alias("__at", "__row"))
    counts = found.groupBy(F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__start"))
    place = F.col("__start") + F.col("__at")
    # one row a bucket, 16 bytes each: a million buckets are 16 MB
    return placed.join(F.broadcast(starts), F.col("__bucket") == F.col("__b")).select(
        *[F.col(f"__row.`{c}`").alias(c) for c in columns],
        (place % shards).cast("int").alias("shard"),
        F.expr(f"(__start + __at) div {shards}").cast("long").alias("slot"),
    ).withColumnsRenamed(back)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write df, shuffled, as Parquet: a folder for each shard, and in it a file for each bucket (pass 2 writes what it has shuffled, without another
    shuffle), rows in slot order. Files sorted by name are in slot order too. The path must be new."""
    out = external_shuffle(df, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """The contract's rows: whole documents are shuffled and written under path, and size and checksum are of what was written; null text counts as empty."""
    whole = docs.select(F.col(id_col).alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("__size"))
    write_shards(whole, path, key_col="doc_id", shards=shards, size_col="__size")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    out = docs.sparkSession.read.schema(T.StructType([*whole.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
