"""Operator 9, document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, sliced, text_key, word_windows

SAMPLES, SEED = 64, 42
_TERMS = 2048
_MASK = np.uint64(0xFFF)


def _gamma_table() -> np.ndarray:
    """Gamma(2, 1) at the middles of 4096 equal shares of its law, by bisection of 1 - exp(-x)(1 + x)."""
    p, low, high = (np.arange(4096) + 0.5) / 4096, np.zeros(4096), np.full(4096, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return mid


_GAMMA = _gamma_table()
_R, _LOG_C = _GAMMA.astype(np.float32), np.log(_GAMMA).astype(np.float32)
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def signature(weights: dict[str, float] | Counter) -> np.ndarray:
    """SAMPLES 16-bit values; two signatures agree in a place with the generalised Jaccard similarity of the weights.

    For a term of weight w and a sample, r and c are Gamma(2, 1) and b is uniform, drawn from the term and the
    sample alone; t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the sample is (term, t) of the least a. All zeros without terms.
    """
    if not weights:
        return np.zeros(SAMPLES, np.uint16)
    terms = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED) for t in weights), np.uint64, len(weights))
    logs = np.log(np.fromiter(weights.values(), np.float32, len(weights)))
    least, value = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    for k in range(0, len(terms), _TERMS):
        term, log = terms[k : k + _TERMS, None], logs[k : k + _TERMS]
        z = term * _ODD[None, :]
        z ^= z >> np.uint64(32)
        z *= _MIX
        r = _R[z >> np.uint64(52)]
        b = (z & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        a = _LOG_C[(z >> np.uint64(40)) & _MASK] + r * (b - 1)
        t = None
        if (heavy := np.flatnonzero(log != 0)).size:
            t = np.floor(log[heavy, None] / r[heavy] + b[heavy])
            a[heavy] -= r[heavy] * t
        at = a.argmin(0)
        low = a[at, np.arange(SAMPLES)]
        chosen = term[at, 0] * _MIX
        if t is not None:
            place = np.full(len(log), -1)
            place[heavy] = np.arange(len(heavy))
            own = place[at]
            chosen += np.where(own >= 0, t[own, np.arange(SAMPLES)], 0).astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        better = low < least
        least, value = np.where(better, low, least), np.where(better, chosen, value)
    value ^= value >> np.uint64(29)
    return ((value * _MIX) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def text_signature(text: str) -> np.ndarray:
    """Terms are the words (white-space runs apart); a term that occurs n times weighs 1 + ln n."""
    counts: Counter[bytes] = Counter()
    for words in word_windows(text.encode("utf-8", "surrogatepass").lower()):
        counts.update(words)
    return signature({t.decode("utf-8", "surrogatepass"): 1 + math.log(n) for t, n in counts.items()})


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(own: np.ndarray, text: str, following: str, sign: np.ndarray) -> tuple:
    """The values of a document with signature own, whose next document is following with signature sign."""
    other = edited(text, following)
    cut = own if other == text else text_signature(other)
    return len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).digest(), own.astype(">u2").tobytes(), cut.astype(">u2").tobytes(), likeness(own, cut), likeness(own, sign)


_NAMES = ["n_chars", "sha", "own", "cut", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_VALUES = "n_chars long, sha binary, own binary, cut binary, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id (null ids come last), and after the last the first. The rows are range-partitioned by
    id, of any type that is ordered, and sorted, so each task reads its documents in order and knows the next of all but its last. A task's first and last
    text go out as one row more, numbered with the range; those few rows, two texts a task, are joined with the next range's. So the texts are shuffled once, no
    task sees all, and the driver sees none. ``ranges`` is their number, as the session's shuffle partitions otherwise.

    Null text counts as empty; the likeness of two empty texts is 1, of an empty and another 0. Rows that share an id follow each
    other by text digest, descending; rows that repeat an id and a text are alike, and spread over ranges where there are many. Very long texts are
    counted in windows; other columns are not read. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), text_key(text_col).alias("__key"), F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("__nth"))
    order = [F.col("__id").desc_nulls_last(), F.col("__key").desc(), F.col("__nth")]
    ordered = (rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, held, id_type = TaskContext.get().partitionId(), None, None, None
        for batch in sliced(batches):
            ids, out, id_type = [], [], batch.schema.field(0).type
            for own_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                sign = text_signature(text)
                if held is None:
                    head = text
                else:
                    ids.append(held[0])
                    out.append(_compared(held[2], held[1], text, sign))
                held = own_id, text, sign
            if out:
                none = [pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.string()), pa.nulls(len(out), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)), *none], names=["doc_id", *_NAMES, "part", "head", "tail"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], id_type), *(pa.nulls(1, t) for t in _KINDS), pa.array([part], pa.int32()), pa.array([head]), pa.array([held[1]])], names=["doc_id", *_NAMES, "part", "head", "tail"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            out = [_compared(text_signature(tail), tail, head, text_signature(head)) for tail, head in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True))], names=["doc_id", *_NAMES])

    found = checkpointed(map_arrow(ordered.select("__id", "__text"), inside, f"doc_id {kind}, {_VALUES}, part int, head string, tail string"))
    edges = found.where("part is not null").select("doc_id", "part", "head", "tail")
    # one number a task in this window
    follows = edges.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after"))
    heads = edges.select(F.col("part").alias("after"), F.col("head").alias("following"))
    lasts = map_arrow(edges.join(follows, "part").join(heads, "after").select("doc_id", "tail", "following"), across, f"doc_id {kind}, {_VALUES}")
    every = found.where("part is null").select("doc_id", *_NAMES).union(lasts)
    text = lambda c: F.lower(F.hex(c))
    return every.select("doc_id", "n_chars", text("sha").alias("edited_sha256"), text("own").alias("fingerprint"), text("cut").alias("edited_fingerprint"), "near_edited", "near_next")
