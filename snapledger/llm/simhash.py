"""Operator 7, near-duplicates by SimHash and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_per_group, by_row, checkpointed, components, keep_rows, map_arrow, ship, sliced, spread_join, text_key, word_windows

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: (blocks, equal blocks asked for, up to so many different fingerprints). With d differing bits, at least blocks - d blocks are equal, so every scheme finds all pairs; more equal bits keep buckets small as the corpus grows.
SCHEMES = ((6, 2, 2_000_000), (7, 3, 130_000_000), (8, 4, 1 << 62))
#: Buckets with more fingerprints than SMALL are compared in tiles of TILE by TILE.
SMALL, TILE = 48, 1024
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """64 bits: bit i is 1 if it is set in over half of the hashes of the shingles; 0 without words."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for words in word_windows((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + words
        if len(words) >= SHINGLE:
            line, digest = b" ".join(words), xxhash.xxh64_intdigest
            ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
            starts = [0, *(e + 1 for e in ends[:-SHINGLE])]
            hashes = [digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=True)]
            ones += _ones(hashes)
            total += len(hashes)
        carried = words[-(SHINGLE - 1) :]
    if not total:
        if not carried:
            return 0
        ones, total = _ones([xxhash.xxh64_intdigest(b" ".join(carried), SEED)]), 1
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(np.array(hashes[i : i + _BLOCK], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return ones


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __key, __fp), a row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fp = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["__id", "__key", "__fp"])

    return map_arrow(docs.select(F.col(id_col).alias("__id"), text_key(text_col).alias("__key"), F.col(text_col).alias("__text")), run, f"__id {kind}, __key long, __fp long")


def _masks(blocks: int, equal: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(x) for x in combinations(one, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that join what links within a and b (all of b; a is None for b alone) join: one fewer than nodes at most."""
    x = b if a is None else np.concatenate([a, b])
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
    label = np.arange(len(x))
    while True:
        low = np.where(near, label[None, :], len(x)).min(1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    child = np.flatnonzero(label != np.arange(len(x)))
    return x[child].view(np.int64), x[label[child]].view(np.int64)


def _tile_edges(distance: int):
    """For mapInPandas over rows sorted by (bucket, tile pair, side): the links in each tile pair."""

    def pair(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        fp = group["fp"].to_numpy().view(np.uint64)
        side = group["side"].to_numpy()
        return _forest(fp[side == 0] if (side == 0).any() else None, fp[side == 1], distance)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            cuts = np.flatnonzero((frame[["j", "bucket", "lo", "hi"]].to_numpy()[1:] != frame[["j", "bucket", "lo", "hi"]].to_numpy()[:-1]).any(1)) + 1
            parts = np.split(np.arange(len(frame)), cuts)
            for part in parts:
                piece = frame.iloc[part]
                if held and tuple(held[-1][["j", "bucket", "lo", "hi"]].iloc[0]) != tuple(piece[["j", "bucket", "lo", "hi"]].iloc[0]):
                    a, b = pair(pd.concat(held))
                    yield pd.DataFrame({"a": a, "b": b})
                    held = []
                held.append(piece)
        if held:
            a, b = pair(pd.concat(held))
            yield pd.DataFrame({"a": a, "b": b})

    return run


def links(fps: DataFrame, distance: int = DISTANCE, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of different fingerprints within the distance.

    fps: column __fp, distinct, cut from its lineage. A pair within the distance shares some choice of blocks; rows
    meet by (choice, value of its bits), never one against all. Small buckets are joined. In a large bucket (many near copies of
    one text, up to about 100,000 different fingerprints: each goes to as many tiles as there are), fingerprints go to tiles; each pair of tiles is one unit of work of fixed size that compares all its
    pairs and returns a spanning forest of the links it finds instead of every pair, so no bucket is gathered in
    one task and no link is lost.
    """
    ship(fps.sparkSession)
    n = fps.count()
    blocks, equal = next((b, e) for b, e, most in SCHEMES if n <= most)
    if blocks - equal < distance:
        raise ValueError("the schemes cover up to 4 differing bits")
    keys = F.array(*[F.struct(F.lit(i).alias("j"), F.col("__fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(_masks(blocks, equal))])
    keyed = fps.select(F.col("__fp").alias("fp"), F.explode(keys).alias("k")).select("fp", "k.j", "k.bucket")
    sizes = keyed.groupBy("j", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = checkpointed(keyed.join(sizes, ["j", "bucket"]))
    few = met.where(F.col("n") <= small)
    near = few.alias("x").join(few.alias("y"), ["j", "bucket"]).where("x.fp < y.fp").where(F.expr(f"bit_count(x.fp ^ y.fp) <= {distance}")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = met.where(F.col("n") > small).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    # every fingerprint meets each tile of its bucket: as the first of the pair or as the second
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("lo"), F.greatest(t, F.col("own")).alias("hi"), F.when(F.col("own") >= t, 1).otherwise(0).alias("side")))
    tiled = many.withColumn("own", own).select("fp", "j", "bucket", F.explode(pairs).alias("p")).select("fp", "j", "bucket", "p.lo", "p.hi", "p.side")
    dense = tiled.repartition("j", "bucket", "lo", "hi").sortWithinPartitions("j", "bucket", "lo", "hi", "side").mapInPandas(_tile_edges(distance), "a long, b long")
    return near.union(dense).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: __id, __key, fingerprint (16 hex digits), component_id (smallest id reachable), __first (whether
    the row is the first of its component: smallest id, then smallest text digest).

    Documents whose fingerprints differ in at most 4 bits are linked. Null and wordless texts have fingerprint zero and
    link like any other; texts shorter than a shingle hash whole. Equal fingerprints are taken once in the search, so
    groups of copies cost one row. Null ids count as larger than any other; rows that repeat an id and a text are alike. Very long
    texts are hashed in windows; other columns are not read. An empty table gives an empty table.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col))
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"))
    fps = checkpointed(rows.groupBy("__fp").agg(F.min(order).alias("__least")))
    roots = components(links(fps.select("__fp"))).select(F.col("node").alias("__fp"), F.col("root").alias("__root"))
    placed = fps.join(roots, "__fp", "left").withColumn("__root", F.coalesce("__root", "__fp"))
    classes = best_per_group(placed.select("__fp", "__root", "__least"), "__root", F.col("__least"), F.col("__fp")).select("__fp", F.col("__best").alias("__class"))
    joined = spread_join(rows, "__fp", classes, by_row("__id"))
    first = F.col("__class.id").eqNullSafe(F.col("__id")) & F.col("__class.key").eqNullSafe(F.col("__key"))
    return joined.select("__id", "__key", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__class.id").alias("component_id"), first.alias("__first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id (then text digest); all columns pass through."""
    keep = near_duplicates(docs, id_col, text_col).where("__first").select("__id", "__key").distinct()
    return keep_rows(docs, keep, id_col, text_col)
