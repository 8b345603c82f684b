"""Operator 8, token counts of documents by a scan for separators in flat token files without an index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, sliced, text_key
from .tokens import encoder

SEPARATOR = 49_407
#: Tokens (two bytes each) of a block, blocks that one task sums up, documents written to a file.
BLOCK, SUMMED, FILE_ROWS = 65_536, 1024, 2_000
#: Bytes of a token file that one task reads (about).
PART_BYTES = 64 << 20


def file_of(id_col: str, text_col: str, files: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(files)).cast("int")


def _separators(data, separator: int, dtype: str) -> tuple[int, np.ndarray]:
    """How many tokens a block has, and the places of its separators."""
    tokens = np.frombuffer(data, dtype)
    return len(tokens), np.flatnonzero(tokens == separator).astype(np.int32)


def token_blocks(docs: DataFrame, files: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, separator: int = SEPARATOR, block: int = BLOCK, scanned: bool = False) -> DataFrame:
    """(file, block, data), or with scanned (file, block, n, ends) as scan_blocks gives it, in the same pass: the documents of each file, in the order of (id, text digest), as one flat stream of tokens.

    Every document's tokens end with the separator; text that spells it is read as ordinary text, so that it never occurs inside.
    Blocks have a fixed size and take no notice of documents. Tokens, half the size of the text, are what is shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path, plain=True), np.array([separator], "<u2").tobytes()
        for batch in sliced(batches):
            data = [np.frombuffer(ids, "<u4").astype("<u2").tobytes() + end for ids in own.many(t or "" for t in batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=["file", "__id", "__key", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, held = None, 0, bytearray()

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal at
            while len(held) >= least and held:
                part = bytes(held[: 2 * block])
                if scanned:
                    n, ends = _separators(part, separator, "<u2")
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([ends], pa.list_(pa.int32()))], names=["file", "block", "n", "ends"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([at], pa.int64()), pa.array([part], pa.binary())], names=["file", "block", "data"])
                del held[: 2 * block]
                at += 1

        for batch in sliced(batches):
            for file, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if file != now:
                    yield from flush(1)
                    now, at = file, 0
                held += data
                yield from flush(2 * block)
        yield from flush(1)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(file_of(id_col, text_col, files).alias("file"), F.col(id_col).alias("__id"), text_key(text_col).alias("__key"), F.col(text_col).alias("__text"))
    tokens = map_arrow(rows, encode, f"file int, __id {kind}, __key long, data binary")
    return map_arrow(tokens.repartition("file").sortWithinPartitions("file", "__id", "__key"), cut, "file int, block long, n long, ends array<int>" if scanned else "file int, block long, data binary")


def _opened(path: str):
    """A file by the path that Spark lists, open for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK, dtype: str = "<u2") -> DataFrame:
    """(file, block, data) of flat binary token files of any length.

    Only names and lengths are listed; ranges of about PART_BYTES, whole blocks, are dealt to the tasks, which read a block at a time.
    """
    width = np.dtype(dtype).itemsize * block
    listed = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    total = listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    part = max(1, PART_BYTES // width) * width
    ranges = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part).cast("long"))).alias("begin"))
    ranges = ranges.select("path", "begin", F.least("length", F.col("begin") + part).alias("end")).repartition(max(1, math.ceil(total / PART_BYTES)), "path", "begin")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(file) as data:
                    for k in range(begin, end, width):
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k // width], pa.int64()), pa.array([data.read_at(min(width, end - k), k)], pa.binary())], names=["file", "block", "data"])

    return map_arrow(ranges, cut, "file string, block long, data binary")


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """(file, block, n, ends): the tokens of each block and the places of its separators, found in one search of the block as an array."""
    kind = blocks.schema["file"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_separators(data.as_buffer(), separator, dtype) for data in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([e for _, e in found], pa.list_(pa.int32()))], names=["file", "block", "n", "ends"])

    return map_arrow(blocks.where("data is not null").select("file", "block", "data"), scan, f"file {kind}, block long, n long, ends array<int>")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): the documents of each file, in order, without their separators; see stitch."""
    return stitch(scan_blocks(blocks, separator, dtype))


def stitch(scanned: DataFrame) -> DataFrame:
    """Documents from scanned blocks: a block's own sums (tokens, separators, place of the last) are carried forward by a
    prefix scan in two levels, within SUMMED blocks and across those, so that a document may begin many blocks before it ends.

    Tokens after a file's last separator are one more document, closed = false. Empty documents count 0; blocks without tokens and
    empty tables give no rows. The same (file, block) must not occur twice.
    """
    found = checkpointed(scanned)
    summed = found.withColumn("part", F.floor(F.col("block") / SUMMED))
    inner = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("s") + F.try_element_at("ends", F.lit(-1))
    summed = summed.withColumn("s", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    summed = summed.withColumns({"d": F.coalesce(F.sum(F.size("ends")).over(inner), F.lit(0)), "e": last}).withColumn("p", F.max("e").over(inner))
    parts = summed.groupBy("file", "part").agg(F.sum("n").alias("pn"), F.sum(F.size("ends")).alias("pd"), F.max("e").alias("pe"))
    outer = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ps", F.coalesce(F.sum("pn").over(outer), F.lit(0))).withColumn("pdd", F.coalesce(F.sum("pd").over(outer), F.lit(0))).withColumn("pp", F.max(F.col("ps") + F.col("pe")).over(outer))
    base = summed.join(parts.select("file", "part", "ps", "pdd", "pp"), ["file", "part"])
    before = F.coalesce(F.col("ps") + F.col("p"), F.col("pp"), F.lit(-1))
    docs = base.select("file", (F.col("ps") + F.col("s")).alias("b"), (F.col("pdd") + F.col("d")).alias("o"), before.alias("prev"), "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") > 0, F.col("b") + F.try_element_at("ends", F.col("i"))).otherwise(F.col("prev")) + 1
    closed = docs.select("file", (F.col("o") + F.col("i")).cast("long").alias("ordinal"), start.cast("long").alias("start"), (F.col("b") + F.col("end") - start).cast("long").alias("n_tokens"), F.lit(True).alias("closed"))
    ends = parts.groupBy("file").agg(F.sum("pn").alias("n"), F.sum("pd").alias("o"), F.coalesce(F.max(F.col("ps") + F.col("pe")), F.lit(-1)).alias("e"))
    open_ = ends.where("n > e + 1").select("file", F.col("o").cast("long").alias("ordinal"), (F.col("e") + 1).cast("long").alias("start"), (F.col("n") - F.col("e") - 1).cast("long").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(open_)


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, file_rows: int = FILE_ROWS, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: __id, n_tokens, file, ordinal, start.

    docs are written as flat streams, the streams are scanned, and the k-th document of a stream is the k-th of its
    file in the order of writing. Null text counts as empty; ids may be null. Rows that repeat an id and a text count each, in any order, as they are
    alike. Very long texts are encoded in parts; other columns are not read. An empty table gives an empty table.
    """
    files = max(1, math.ceil(docs.count() / file_rows))
    counted = stitch(token_blocks(docs, files, id_col, text_col, path, block=block, scanned=True))
    rows = docs.select(file_of(id_col, text_col, files).alias("file"), F.col(id_col).alias("__id"), text_key(text_col).alias("__key"))
    order = F.row_number().over(Window.partitionBy("file").orderBy("__id", "__key")) - 1
    listed = rows.withColumn("ordinal", order.cast("long")).select("file", "ordinal", "__id")
    return counted.join(listed, ["file", "ordinal"]).select("__id", "n_tokens", "file", "ordinal", "start")
