"""Operator 2, packing documents into training sequences by linear grouping and best fit."""

from __future__ import annotations

import logging
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, sliced
from .tokens import encoder

log = logging.getLogger(__name__)
CAPACITY, END_ID = 4096, 1
#: Numbers of groups to try, and the share of the capacity above which a length counts as large.
GROUPS, LARGE = (8, 16, 24), 1 / 6
#: Rows of one length that one task numbers.
NUMBERED = 500_000
#: Simplex steps at most; a bound on effort, the packing is whole at any point.
ROUNDS = 2000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(__id, piece, start, length, ids_crc32[, ids]): a document's ids and the end id, cut only where longer than the capacity."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in sliced(batches):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(encode.many(t or "" for t in batch.column(1).to_pylist())):
                data += end
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    rows.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            own = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["__id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                own.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(own, names=names)

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"__id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _fillings(sizes: list[int], capacity: int) -> np.ndarray:
    """All ways to fill a sequence with these sizes that no further one fits into; few, as the sizes are few and large."""
    rows, room = np.zeros((1, len(sizes)), np.int8), np.array([capacity])
    for g, size in enumerate(sizes):
        most = room // size
        at = np.repeat(np.arange(len(rows)), most + 1)
        count = np.arange(len(at)) - np.repeat(np.cumsum(most + 1) - most - 1, most + 1)
        rows, room = rows[at], room[at] - count * size
        rows[:, g] = count
    return rows[room < min(sizes)].astype(float)


def configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how often) from the fractional optimum of the configuration problem, rounded down.

    Simplex steps: given the prices of the sizes in the present basis, the most valuable way to fill a sequence enters. If ROUNDS of them don't
    reach the optimum, the configurations found so far are used, and the log says so.
    """
    k = len(sizes)
    ways = _fillings(sizes, capacity)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(wanted, float)
    for _ in range(ROUNDS):
        value = ways @ np.linalg.solve(basis.T, np.ones(k))
        enter = int(value.argmax())
        if value[enter] <= 1 + 1e-9:
            break
        share, step = np.linalg.solve(basis, need), np.linalg.solve(basis, ways[enter])
        ratio = np.where(step > 1e-9, np.maximum(share, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = ways[enter]
    else:
        log.warning("configurations of %d sizes: stopped after %d steps, before the optimum", k, ROUNDS)
    often = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-6).astype(int)
    left = need - basis @ often
    for j in np.argsort(often):  # rounding up by the tolerance must not take more than there is
        while often[j] > 0 and (basis[left < -1e-6, j] > 0).any():
            often[j] -= 1
            left += basis[:, j]
    return [(basis[:, j].astype(int), int(often[j])) for j in range(k) if often[j]]


class Layout:
    """Where runs of documents of equal length go; sequences that are equally full are kept as ranges.

    Its size follows the number of different lengths, not of documents: every step places as many as fit alike.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, how many, first sequence, per sequence, offset
        self._placed: dict[int, int] = {}
        self._open: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first sequence, how many)
        self._rooms: list[int] = []

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        rank = self._placed.get(length, 0)
        self.runs.append((length, rank, count, first, each, offset))
        self._placed[length] = rank + count

    def leave(self, room: int, first: int, count: int) -> None:
        if count and room:
            if room not in self._open:
                self._open[room] = []
                insort(self._rooms, room)
            self._open[room].append((first, count))

    def best_fit(self, length: int, count: int) -> None:
        """Put count documents of one length, each into the fullest sequence that takes it."""
        while count:
            at = bisect_left(self._rooms, length)
            if at < len(self._rooms):
                room = self._rooms[at]
                first, many = self._open[room].pop()
                if not self._open[room]:
                    del self._open[room], self._rooms[at]
            else:
                room, many = self.capacity, math.ceil(count / (self.capacity // length))
                first = self.new(many)
            each = room // length
            full = min(many, count // each)
            if full:
                self.put(length, full * each, first, each, self.capacity - room)
                self.leave(room - each * length, first, full)
                count -= full * each
            if full < many:
                if count:
                    self.put(length, count, first + full, count, self.capacity - room)
                    self.leave(room - count * length, first + full, 1)
                    count, full = 0, full + 1
                self.leave(room, first + full, many - full)


def layout(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 16) -> Layout:
    """Lay out documents, given how many there are of each length.

    Linear grouping: large lengths, in descending order, form groups of equal cardinality; each group counts as its
    largest length, so there are few sizes, and their configurations are optimised. The actual documents then take the places of
    their group's size, and the rest, small ones too, go in by best fit, largest first. With fewer large documents than groups, each is a group.
    ``groups`` 0 is best fit alone, for comparison.
    """
    out = Layout(capacity)
    rest = dict(counts)
    large = sorted((n for n in counts if n > capacity * LARGE), reverse=True)
    total = sum(counts[n] for n in large)
    if groups := min(groups, total):
        members: list[list[list[int]]] = [[] for _ in range(groups)]  # of each group: [length, how many]
        seen = 0
        for n in large:
            left = counts[n]
            while left:
                g = min(groups - 1, seen * groups // total)
                take = min(left, max(1, math.ceil((g + 1) * total / groups) - seen) if g < groups - 1 else left)
                members[g].append([n, take])
                seen, left = seen + take, left - take
        merged: dict[int, list[list[int]]] = {}
        for m in members:
            if m:
                merged.setdefault(m[0][0], []).extend(m)
        sizes = list(merged)
        for config, often in configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], capacity):
            ranges = [(out.new(often), often, 0)]  # first sequence, how many, filled
            for size, slots in zip(sizes, config, strict=True):
                for _ in range(slots):
                    nxt = []
                    for first, many, filled in ranges:
                        while many:
                            n, there = merged[size][0]
                            take = min(many, there)
                            out.put(n, take, first, 1, filled)
                            nxt.append((first, take, filled + n))
                            first, many, rest[n] = first + take, many - take, rest[n] - take
                            merged[size][0][1] -= take
                            if not merged[size][0][1]:
                                merged[size].pop(0)
                    ranges = nxt
            for first, many, filled in ranges:
                out.leave(capacity - filled, first, many)
    for n in sorted(rest, reverse=True):
        out.best_fit(n, rest[n])
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (columns __id, piece, length, ids_crc32 and others, cut from its lineage) with sequence_id and offset.

    The driver sees how many pieces there are of each length (at most ``capacity`` rows) and lays these out; the layout
    has runs of equal pieces, some thousands of rows whatever the corpus holds, and is broadcast. Pieces find their place by length and number
    in the length. A length may hold most pieces, so each is numbered in parts, and the parts' counts are summed up first.
    """
    spark = parts.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = min((layout(counts, capacity, g) for g in GROUPS), key=lambda p: p.sequences)
    salts = max(16, math.ceil(max(counts.values(), default=1) / NUMBERED))
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("__id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sums = salted.groupBy(F.col("length").alias("__l"), F.col("__salt").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    starts = sums.withColumn("__start", F.sum("__n").over(Window.partitionBy("__l").orderBy("__s")) - F.col("__n"))
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("__own", own).join(starts, (F.col("length") == F.col("__l")) & (F.col("__salt") == F.col("__s"))).withColumn("__rank", F.col("__start") + F.col("__own"))
    runs = spark.createDataFrame([tuple(map(int, r)) for r in plan.runs], "__len long, __from long, __count long, __first long, __each long, __offset long")
    place = F.col("__rank") - F.col("__from")
    return numbered.join(
        F.broadcast(runs), (F.col("length") == F.col("__len")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__count"))
    ).select(
        *[F.col(f"`{c}`") for c in parts.columns],
        (F.col("__first") + F.floor(place / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + place % F.col("__each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with their places: __id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Null text counts as empty (the end id alone). Every row is packed, repeated rows too; ids may be null. Pieces of one length are taken in the
    order of (id, piece, checksum). Very long texts are encoded in parts; other columns are not read. An empty table gives an empty table.
    """
    return pack(checkpointed(pieces(docs, id_col, text_col, path, capacity, end_id, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the training sequences of pack_documents(..., with_ids=True), at most capacity ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("__p")).select("sequence_id", F.flatten(F.transform("__p", lambda x: x["ids"])).alias("ids"))
