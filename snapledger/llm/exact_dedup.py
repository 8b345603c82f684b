"""Operator 5, exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_per_group, by_row, checkpointed, keep_rows, map_arrow, sliced, text_key

#: Bytes of a chunk: least, most, and the bits of the rolling hash that must be zero at a cut (2 KB on average).
CHUNK_LEAST, CHUNK_MOST, CUT_BITS = 256, 8192, 11
ID_BYTES = 16
#: Bytes whose rolling hashes are held at a time.
WINDOW = 8 << 20
_SPACES = b" \t\n\x0b\x0c\r"
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of data. A cut depends on the 32 bytes before it alone, and on the cut before."""
    n = len(data)
    if n <= CHUNK_LEAST:
        return [n] if n else []
    ends, last = [], 0
    for cut in [*_cuts(data), n]:
        while cut - last > CHUNK_MOST:
            last += CHUNK_MOST
            ends.append(last)
        if cut - last >= CHUNK_LEAST or cut == n and cut > last:
            ends.append(cut)
            last = cut
    return ends


def _cuts(data: bytes) -> list[int]:
    """Places where the rolling hash of the 32 bytes before has CUT_BITS zeros; long data goes through in windows."""
    found = []
    for k in range(0, len(data), WINDOW):
        lead = min(k, 31)
        h = _GEAR[np.frombuffer(data[k - lead : k + WINDOW], np.uint8)]
        for width in (1, 2, 4, 8, 16):  # after it, h covers twice the bytes
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        cuts = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
        found += (cuts[cuts > lead] - lead + k).tolist()
    return found


def _chunks(data: bytes, id_bytes: int) -> list[tuple[bytes, bytes]]:
    out, last = [], 0
    for end in chunk_ends(data):
        piece = data[last:end]
        out.append((xxhash.xxh3_128_digest(piece)[:id_bytes], piece))
        last = end
    return out


def _normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACES)


def _recipes(docs: DataFrame, id_col: str, text_col: str, id_bytes: int) -> DataFrame:
    """(__id, __key, __n, __sha, __recipe): the recipe is the ordered chunk identifiers, end to end."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, sha, recipe = [], [], []
            for text in batch.column(2).to_pylist():
                data = _normalised(text)
                n.append(len(text or ""))
                sha.append(hashlib.sha256(data).hexdigest())
                recipe.append(b"".join(c for c, _ in _chunks(data, id_bytes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())], names=["__id", "__key", "__n", "__sha", "__recipe"])

    return map_arrow(docs.select(F.col(id_col).alias("__id"), text_key(text_col).alias("__key"), F.col(text_col).alias("__text")), run, f"__id {kind}, __key long, __n long, __sha string, __recipe binary")


def _distinct_chunks(docs: DataFrame, text_col: str, id_bytes: int) -> DataFrame:
    """(__chunk, __bytes): every different chunk once; repeats go before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen = {piece: c for text in batch.column(0).to_pylist() for c, piece in _chunks(_normalised(text), id_bytes)}
            yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.binary()), pa.array(seen.keys(), pa.binary())], names=["__chunk", "__bytes"])

    return map_arrow(docs.select(F.col(text_col)), run, "__chunk binary, __bytes binary").distinct()


def _verified(docs: DataFrame, recipes: DataFrame, id_col: str, text_col: str, id_bytes: int) -> DataFrame:
    """recipes, with other identifiers where different chunks share one.

    The bytes behind each identifier are compared. As a rule every identifier stands for one chunk, and the recipes hold. If some
    don't, the chunks of those get their own numbers, and the recipes that use them are written anew: the number of
    each ambiguous chunk, in order, is added to the recipe.
    """
    bad = checkpointed(_distinct_chunks(docs, text_col, id_bytes).groupBy("__chunk").agg(F.count(F.lit(1)).alias("__k")).where("__k > 1").select("__chunk"))
    if bad.isEmpty():
        return recipes
    kind = docs.schema[id_col].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own := _chunks(_normalised(text), id_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(own), batch.schema.field(0).type), pa.array([key] * len(own), pa.int64()), pa.array(range(len(own)), pa.int32()), pa.array([c for c, _ in own], pa.binary()), pa.array([p for _, p in own], pa.binary())], names=["__id", "__key", "__pos", "__chunk", "__bytes"])

    # (id, key) pairs that repeat are one text: count each once
    rows = docs.select(F.col(id_col).alias("__id"), text_key(text_col).alias("__key"), F.col(text_col).alias("__text")).dropDuplicates(["__id", "__key"])
    spelt = map_arrow(rows, parts, f"__id {kind}, __key long, __pos int, __chunk binary, __bytes binary").join(bad, "__chunk", "left_semi")
    told = spelt.groupBy("__id", "__key").agg(F.sort_array(F.collect_list(F.struct("__pos", F.sha2("__bytes", 256).alias("h")))).alias("__own"))
    extra = told.select(F.col("__id").alias("__i"), F.col("__key").alias("__k"), F.array_join(F.transform("__own", lambda x: x["h"]), "").cast("binary").alias("__extra"))
    return recipes.join(extra, F.col("__id").eqNullSafe(F.col("__i")) & F.col("__key").eqNullSafe(F.col("__k")), "left").select("__id", "__key", "__n", "__sha", F.concat("__recipe", F.coalesce("__extra", F.lit(b""))).alias("__recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = ID_BYTES) -> DataFrame:
    """One row for each row of docs: __id, __key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (space, tab to return); null counts as empty. Of equal texts
    the one with the most code points stays, then the one with the smallest id (null last), then, of rows that share an id, the one
    whose text has the smaller digest. The texts' chunks are compared once each, as distinct (identifier, bytes); documents are then compared
    by recipe, so long texts move once at most, and are cut in windows. Rows that repeat an id and a text are kept or dropped together and
    each counts in group_size. Other columns are not read. An empty table gives an empty table.
    """
    recipes = checkpointed(_verified(docs, _recipes(docs, id_col, text_col, id_bytes), id_col, text_col, id_bytes))
    order = F.struct((-F.col("__n")).alias("n"), F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"))
    found = best_per_group(recipes, "__recipe", order, by_row("__id"))
    kept = F.col("__best.id").eqNullSafe(F.col("__id")) & F.col("__best.key").eqNullSafe(F.col("__key"))
    return found.select("__id", "__key", F.col("__best.id").alias("keep_id"), F.col("__count").cast("long").alias("group_size"), kept.alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of equal texts, the one that exact_duplicates keeps; all columns pass through."""
    keep = exact_duplicates(docs, id_col, text_col).where("kept").select("__id", "__key").distinct()
    return keep_rows(docs, keep, id_col, text_col)
