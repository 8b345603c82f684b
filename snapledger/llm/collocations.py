"""Operator 11, phrase collocations by vertical positional lists.

Documents are cut into blocks of some million words. A block holds, for each of its phrases, the list of the positions where it occurs; a list's length is the
phrase's frequency in the block. Lists of words come first. The lists of phrases of k + 1 words are made by merge-joining, in order of position, the
occurrences of frequent phrases of k words with the postings one place on: those of the adjacent word, held as the frequent phrase that ends in it. Which phrases
are frequent is a sum of list lengths over all blocks.

Only the words' lists are stored, once; a pass over groups of neighbouring blocks rebuilds the lists of a level from them and from the levels' frequent phrases. A group counts each of
its phrases once, however often it occurs there, and deals these counts over parts by a hash, sorted and packed a thousand to a row, as most phrases are rare and a row of their own
would be mostly empty bytes. A part has all counts of its phrases; it gives a row for each frequent one, and one for each group with the numbers of its lists that are frequent. No hash stands for a phrase: its identifier is the first (group, list) it has.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WINDOW_BYTES, checkpointed, exists, map_arrow, remove_folder, shared_folder, without_shuffles

MIN_COUNT, LONGEST, TOP, WITHIN_PERCENT, SCALE = 30, 4, 2000, 80, 2_000_000
#: Tokens of a block, and of the blocks that are taken together, about. Bytes of a stored piece of a block.
BLOCK, GROUP, PIECE = 1 << 22, 1 << 22, 8192
#: Lists of a block, of a group of blocks, and blocks of a task, at most, as powers of two.
LIST_BITS, GROUP_BITS, TASK_BITS = 23, 27, 14
#: Parts that phrases are dealt over, at least, and tokens for each part beyond. Phrases of a row.
PARTS, PART, DEALT = 1024, 1 << 20, 1024
#: Rows of a group that one task ranks.
RANKED = 1_000_000
_BREAK = b"\xff"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)
_CUT = re.compile(rb"[\x20\x09\xff]")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text in order, some megabytes at a time. The byte of a break is in no UTF-8 text."""
    data, begin = text.translate(_PLAIN), 0
    while begin < len(data):
        cut = _CUT.search(data, begin + WINDOW_BYTES)
        end = cut.start() if cut else len(data)
        yield data[begin:end].replace(_BREAK, b" " + _BREAK + b" ").split()
        begin = end


class _Numbered(dict):
    """Words of one language, each numbered in its block when first met; 0 is the break."""

    def __init__(self, lang: str, names: list):
        super().__init__({_BREAK: 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = len(self.names)
        return len(self.names)


def pack(values: np.ndarray) -> bytes:
    """32-bit integers as compressed differences, low bytes apart from high ones."""
    steps = np.diff(values, prepend=np.int32(0)).astype(np.int32)
    return len(values).to_bytes(8, "little") + pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd"), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()
    return np.cumsum(steps, out=steps)


_STORED = "kind string, rep long, n long, lang string, word string, blk long, piece int, data binary"
_STORED_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
_STORED_NAMES = [c.split()[0] for c in _STORED.split(", ")]


def _stored(block: int, head: int, names: list, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's rows: one for each word with its number of occurrences, and the lists in pieces."""
    lengths = np.bincount(ids, minlength=len(names) + 1)
    bits = len(ids).bit_length()
    positions = (ids.astype(np.int64) << bits) + np.arange(len(ids))
    positions.sort()
    positions = (positions[lengths[0] :] & ((1 << bits) - 1)).astype(np.int32)
    counts = np.bincount(ids[head:], minlength=len(names) + 1)[1:]
    assert len(names) < 1 << LIST_BITS
    none = lambda n, k: pa.nulls(n, _STORED_TYPES[k])
    for at in range(0, len(names), 1 << 16):
        part = names[at : at + (1 << 16)]
        n = len(part)
        rep = (block << LIST_BITS) + np.arange(at, at + n, dtype=np.int64)
        words = pa.array([w for _, w in part], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.repeat("word", n), pa.array(rep), pa.array(counts[at : at + n]), pa.array([x for x, _ in part], pa.string()), words, *(none(n, k) for k in (5, 6, 7))], _STORED_NAMES)
    data = pack(np.concatenate([[head, len(names)], lengths[1:], positions]).astype(np.int32))
    pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
    for at in range(0, len(pieces), 256):
        part = pieces[at : at + 256]
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.repeat("piece", n), *(none(n, k) for k in range(1, 5)), pa.array(np.full(n, block)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(part, pa.binary())], _STORED_NAMES)


def _blocks(longest: int):
    """(text, lang) to stored blocks. A text that passes a block's end goes on in the next one, which begins with its last words again; a phrase counts where its last word is."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << TASK_BITS
        names, words, ids, count, head = [], {}, [], 0, 0
        for batch in batches:
            texts, langs = batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()
            for text, lang in zip(texts, langs, strict=True):
                if not (text := text.as_py()):
                    continue
                lang = "und" if lang is None else lang
                for window in (*tokens(text), [_BREAK]):
                    if count >= BLOCK:
                        whole = np.concatenate(ids)
                        yield from _stored(number, head, names, whole)
                        over = [names[k - 1] if k else (lang, _BREAK) for k in whole[1 - longest :]]
                        number, names, words, ids, head = number + 1, [], {}, [], len(over)
                        count = head
                        ids.append(np.array([words.setdefault(x, _Numbered(x, names))[w] for x, w in over], np.int32))
                    if lang not in words:
                        words[lang] = _Numbered(lang, names)
                    ids.append(np.fromiter(map(words[lang].__getitem__, window), np.int32, len(window)))
                    count += len(window)
        if count:
            yield from _stored(number, head, names, np.concatenate(ids))

    return cut


def extend(positions: np.ndarray, lists: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of the phrases that are one word longer: positions in order of list, list of each, and of each new list the lists of its first and its last words.

    positions and lists name the occurrences of frequent phrases; laid out in order of position, each is merged with the one that begins one place on. Lists and places are then
    sorted as one number where 64 bits hold both, in place.
    """
    line = np.full(int(positions.max(initial=0)) + 2, -1, np.int32)
    line[positions] = lists
    at = np.flatnonzero((line[:-1] >= 0) & (line[1:] >= 0)).astype(np.int32)
    key = line[at].astype(np.int64)
    key *= number
    key += line[at + 1]
    bits = len(line).bit_length()
    del line
    if number * number < 1 << (63 - bits):
        key <<= bits
        key += at
        key.sort()
        positions = (key & ((1 << bits) - 1)).astype(np.int32)
        key >>= bits
    else:
        order = np.argsort(key, kind="stable")
        key, positions = key[order], at[order]
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    pairs = key[fresh]
    return positions, np.cumsum(fresh, dtype=np.int32) - 1, pairs // max(number, 1), pairs % max(number, 1)


_PAIRS = "part int, grp long, data binary"
_COUNTED = "grp long, data binary, gid long, f long, a long, b long"
_COUNTED_NAMES = [c.split()[0] for c in _COUNTED.split(", ")]


def pack_rows(columns: list[np.ndarray], ascending: int) -> bytes:
    """Columns of 64-bit integers, compressed byte by byte; the first ones, in ascending order or near it, as differences."""
    rows = np.stack([np.diff(x, prepend=0) if k < ascending else x for k, x in enumerate(columns)]).astype(np.int64)
    return len(columns[0]).to_bytes(4, "little") + pa.compress(rows.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def unpack_rows(data: bytes, columns: int, ascending: int) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=8 * columns * n, codec="zstd"), np.uint8)
    rows = np.ascontiguousarray(planes.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(columns, n)
    np.cumsum(rows[:ascending], axis=1, out=rows[:ascending])
    return rows


def _dealt(group: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of a group's phrases; where a phrase goes follows from its a and b alone."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed >>= np.uint64(32)
    part = (mixed % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    found = [(int(part[order[low]]), pack_rows([a[x], x, b[x], n[x]], 2)) for low, high in _runs(part[order]) for k in range(low, high, DEALT) for x in [order[k : min(high, k + DEALT)]]]
    for k in range(0, len(found), 256):
        own, data = zip(*found[k : k + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), group)), pa.array(data, pa.binary())], ["part", "grp", "data"])


def _counted(least: int):
    """Rows (part, grp, data), those of a part together, to rows of two kinds: (gid, f, a, b) of a frequent phrase, and (grp, data) of a group's lists of frequent phrases."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[pa.RecordBatch]:
            a, rep, b, n = np.concatenate(held, axis=1)
            held.clear()
            order = np.lexsort((b, a))
            a, b, rep, n = a[order], b[order], rep[order], n[order]
            starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            f, gid = np.add.reduceat(n, starts), np.minimum.reduceat(rep, starts)
            kept = f >= least
            for k in range(0, int(kept.sum()), 1 << 16):
                found = [pa.array(x[kept][k : k + (1 << 16)]) for x in (gid, f, a[starts], b[starts])]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(found[0]), pa.int64()), pa.nulls(len(found[0]), pa.binary()), *found], _COUNTED_NAMES)
            lengths = np.diff(starts, append=len(a))
            rep, gid = rep[np.repeat(kept, lengths)], np.repeat(gid[kept], lengths[kept])
            order = np.argsort(rep)
            rep, gid = rep[order], gid[order]
            lists = [(int(rep[low]) >> GROUP_BITS, pack_rows([rep[low:high] & ((1 << GROUP_BITS) - 1), gid[low:high]], 1)) for low, high in _runs(rep >> GROUP_BITS)]
            if lists:
                groups, data = zip(*lists, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(data, pa.binary()), *[pa.nulls(len(lists), pa.int64())] * 4], _COUNTED_NAMES)

        part, held = None, []
        for batch in batches:
            parts, groups = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, high in _runs(parts):
                if held and parts[low] != part:
                    yield from whole()
                part = parts[low]
                for k in range(low, high):
                    rows = unpack_rows(batch.column(2)[k].as_py(), 4, 2)
                    rows[1] += int(groups[k]) << GROUP_BITS
                    held.append(rows)
        if held:
            yield from whole()

    return counted


_NONE = (np.empty(0, np.int32), np.empty(0, np.int64))


def _words(data: bytes, index: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a block, positions in lists of frequent words, the list of each as its number in the group (own, of the block's lists index), and the first position that counts."""
    stored = unpack(data)
    head, number = int(stored[0]), int(stored[1])
    lengths, positions = stored[2 : 2 + number], stored[2 + number :]
    lists = np.full(number, -1, np.int32)
    lists[index] = own
    return positions[np.repeat(lists >= 0, lengths)], np.repeat(lists, np.where(lists >= 0, lengths, 0)), head


def _pairs(group: int, blocks: dict[int, bytes], words: dict[int, tuple[np.ndarray, np.ndarray]], longer: list[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Of a group of blocks, the phrases one word longer than the last level; longer has (list, identifier) of the frequent phrases of the levels after the words.

    Each block's lists are extended apart, and their phrases then numbered together.
    """
    own = np.unique(np.concatenate([gid for _, gid in words.values()] or [_NONE[1]]))
    held = [_words(blocks[b], index, np.searchsorted(own, gid)) for b in sorted(blocks) for index, gid in [words.get(b, _NONE)]]
    for level in range(1, len(longer) + 2):
        if level > 1:
            gids = np.full(number, -1, np.int64)
            gids[longer[level - 2][0]] = longer[level - 2][1]
            own, kept = gids, gids >= 0
            held = [(p[kept[x]], x[kept[x]], head) for p, x, head in held]
        size, found = max(len(own), 1), []
        while held:
            p, x, head = held.pop(0)
            p, x, first, last = extend(p, x, size)
            found.append((p, x, first * size + last, head))
        keys = np.unique(np.concatenate([k for _, _, k, _ in found] or [_NONE[1]]))
        held = [(p, np.searchsorted(keys, k).astype(np.int32)[x], head) for p, x, k, head in found]
        first, last, number = own[keys // size], own[keys % size], len(keys)
    if not number:
        return
    assert number < 1 << GROUP_BITS
    n = sum(np.bincount(x[p + level >= head], minlength=number) for p, x, head in held)
    del found, held, keys
    yield from _dealt(group, first, last, n, parts)


def _passed(levels: int, parts: int):
    """Rows (grp, level, blk, idx, gid, data), those of a group of blocks together: level 0 has pieces of blocks, 1 frequent words of a block, the others frequent phrases of the group, packed."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[pa.RecordBatch]:
            pieces.sort()
            blocks = {b: b"".join(x for _, _, x in own) for b, own in itertools.groupby(pieces, key=lambda p: p[0])}
            words = {b: tuple(map(np.concatenate, zip(*own, strict=True))) for b, own in lists[1].items()}
            longer = [tuple(map(np.concatenate, zip(*lists[k][None], strict=True))) if lists[k] else _NONE for k in range(2, levels + 1)]
            yield from _pairs(group, blocks, words, longer, parts)

        group, pieces, lists = None, [], [defaultdict(list) for _ in range(levels + 1)]
        for batch in batches:
            grp, level, blk, idx, gid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            for low, high in _runs(grp):
                if group is not None and grp[low] != group:
                    yield from whole()
                    pieces, lists = [], [defaultdict(list) for _ in range(levels + 1)]
                group = int(grp[low])
                for a, b in _runs(level[low:high] + (blk[low:high] << 3)):
                    a, b, k, block = low + a, low + b, int(level[low + a]), int(blk[low + a])
                    if k == 0:
                        pieces.extend(zip([block] * (b - a), idx[a:b].tolist(), batch.column(5)[a:b].to_pylist(), strict=True))
                    elif k == 1:
                        lists[1][block].append((idx[a:b], gid[a:b]))
                    else:
                        lists[k][None].extend(tuple(unpack_rows(x, 2, 1)) for x in batch.column(5)[a:b].to_pylist())
        if group is not None:
            yield from whole()

    return passed


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return ((a, b) for a, b in itertools.pairwise(edges) if a < b)


def _frequent_words(words: DataFrame, least: int) -> DataFrame:
    """(rep, gid, f, lang, word) of rows of the words with at least so many occurrences; gid is one number for all blocks."""
    same = Window.partitionBy("lang", "word")
    return words.withColumns({"f": F.sum("n").over(same), "gid": F.min("rep").over(same)}).where(F.col("f") >= least).select("rep", "gid", "f", "lang", "word")


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """rows, written and read again."""
    with without_shuffles(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def frequent_phrases(docs: DataFrame, folder: str, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of each length, and (lang, n) of all words.

    Of length k: gid, f, lang, phrase, last, a, b (of the parts without the last and without the first word), fronts, backs (frequencies of the first 1 to k - 1 and the last 1 to k - 1 words).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    with without_shuffles(spark):
        map_arrow(rows, _blocks(longest), _STORED).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/blocks")
    part = lambda kind, schema: spark.read.schema(schema).parquet(f"{folder}/blocks/kind={kind}") if exists(spark, f"{folder}/blocks/kind={kind}") else spark.createDataFrame([], schema)
    words, pieces = part("word", "rep long, n long, lang string, word string"), part("piece", "blk long, piece int, data binary")
    sizes = checkpointed(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent, levels = _kept(_frequent_words(words, least), f"{folder}/1"), []
    remove_folder(spark, f"{folder}/blocks/kind=word")
    tokens = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    group, parts = _grouped(pieces, tokens), max(PARTS, tokens // PART)
    none, zero, blk = F.lit(None).cast("binary").alias("data"), F.lit(0).cast("long"), F.shiftright("rep", LIST_BITS)
    for k in range(1, longest):
        every = pieces.select(group(F.col("blk")), F.lit(0).alias("level"), "blk", F.col("piece").alias("idx"), zero.alias("gid"), "data")
        every = every.unionAll(frequent.select(group(blk), F.lit(1).alias("level"), blk.alias("blk"), F.expr(f"rep & {(1 << LIST_BITS) - 1}").cast("int").alias("idx"), "gid", none))
        for i, x in enumerate(levels, 2):
            every = every.unionAll(x.where("data is not null").select("grp", F.lit(i).alias("level"), zero.alias("blk"), F.lit(0).alias("idx"), zero.alias("gid"), "data"))
        longer = map_arrow(every.repartition("grp").sortWithinPartitions("grp"), _passed(k, parts), _PAIRS)
        counted = map_arrow(longer.repartition("part").sortWithinPartitions("part"), _counted(least), _COUNTED)
        levels.append(_kept(counted, f"{folder}/{k + 1}"))
    remove_folder(spark, f"{folder}/blocks")
    empty = F.array().cast("array<long>")
    tables = [frequent.where("rep = gid").select("gid", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), empty.alias("fronts"), empty.alias("backs"))]
    for level in levels:
        one = level.where("data is null").select("gid", "f", "a", "b")
        p = tables[-1].select(F.col("gid").alias("a"), "lang", F.col("phrase").alias("p"), F.col("f").alias("pf"), "fronts")
        s = tables[-1].select(F.col("gid").alias("b"), "last", F.col("f").alias("sf"), "backs")
        joined = one.join(p, "a").join(s, "b")
        tables.append(joined.select("gid", "f", "lang", F.concat_ws(" ", "p", "last").alias("phrase"), "last", "a", "b", F.concat("fronts", F.array("pf")).alias("fronts"), F.concat("backs", F.array("sf")).alias("backs")))
    return tables, sizes


def _grouped(pieces: DataFrame, tokens: int):
    """The group of a block: so many neighbouring tasks' blocks, or blocks of one task, as have GROUP tokens on average."""
    tasks, blocks = pieces.agg(F.count_distinct(F.shiftright("blk", TASK_BITS)), F.count_distinct("blk")).first()
    near, own = max(1, GROUP * tasks // max(tokens, 1)), max(1, GROUP * blocks // max(tokens, 1))
    return lambda blk: (F.floor(F.shiftright(blk, TASK_BITS) / near).cast("long") * (1 << TASK_BITS) + F.floor(blk.bitwiseAND(F.lit((1 << TASK_BITS) - 1)) / own).cast("long")).alias("grp")


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, within_percent: int = WITHIN_PERCENT) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words that occurs ``least`` times is scored at each cut by its frequency over those of both parts, and the lowest counts (of equal ones the
    first cut). One that lies in a longer phrase with ``within_percent`` of its occurrences is left out; as a longer phrase is at most as frequent as the parts of it that
    are one word longer than the phrase, only those are asked. Products are decimals of 38 digits.

    Null text counts as empty, null language as ``und``. Empty texts have no phrases, texts of any length are read whole, rows that repeat count again; phrases with equal scores come by
    frequency, then by bytes. Other columns, of any name, are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    tables, sizes = frequent_phrases(docs, folder, lang_col, text_col, least, longest)
    found = None
    for k, table in enumerate(tables[1:], 2):
        if k < len(tables):
            parts = tables[k].select(F.col("f"), F.explode(F.array("a", "b")).alias("gid")).groupBy("gid").agg(F.max("f").alias("most"))
            table = table.join(parts, "gid", "left").where(F.col("most").isNull() | (_wide(F.col("most")) * 100 < _wide(F.col("f")) * within_percent))
        at = lambda i, c, e: F.get(F.col(c), i - 1 if e else F.lit(k - 1) - i)  # noqa: E731, B023
        cut = lambda i: F.struct(F.expr("0").cast("long").alias("score"), i.alias("k"), at(i, "fronts", True).alias("l"), at(i, "backs", False).alias("r"))  # noqa: E731, B023
        scored = lambda c: c.withField("score", F.call_function("div", _wide(F.col("f")) * SCALE, _wide(c["l"]) + _wide(c["r"])))
        best = F.array_min(F.array(*[scored(cut(F.lit(i))) for i in range(1, k)]))
        rows = table.select("lang", "phrase", F.col("f").alias("a"), best.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
        found = rows if found is None else found.unionAll(rows)
    with without_shuffles(spark):
        found.write.parquet(f"{folder}/scored")
    rows = spark.read.schema(found.schema).parquet(f"{folder}/scored")
    best_first = [F.desc("score"), F.desc("a"), F.col("phrase")]
    groups = max(1, -(-rows.count() // RANKED)) * 16
    rows = rows.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    while True:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*best_first)).cast("long")).where(F.col("rank") <= top)
        if groups == 1:
            break
        groups = max(1, groups * top // RANKED)
        rows = rows.withColumn("group", F.col("group") % groups)
    out = rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = checkpointed(out)
    remove_folder(spark, folder)
    return out


#: The same in SQL, for tables that one machine holds.
ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
s AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS i FROM cand),
parts AS (SELECT c.*, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.i + 1:], ' ')),
low AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
kept AS (SELECT * FROM low c WHERE NOT EXISTS (SELECT 1 FROM cand x WHERE x.lang = c.lang AND x.k > c.k AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * x.a >= 80 * c.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM r JOIN n ON r.lang = n.lang WHERE rank <= 2000
"""
