"""Operator 4, language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, ship, windowed
from .quality import logistic

#: Documents learned from, for each language (about), chosen by hash; of those over MOST_CHARS code points, as many in windows spread over the whole text.
SAMPLE, MOST_CHARS = 800, 20_000
#: Characters of an n-gram, and the absolute discount.
ORDER, DISCOUNT = 4, 0.75
#: Least size of the alphabet that unseen characters' share of probability is spread over; with more letters in the sample it grows with them.
ALPHABET = 255
#: Bits of a symbol, so that an n-gram of 4 fits in 64; letters that the sample doesn't have share one symbol, with those after its 65,534 most frequent ones.
BITS = 16
UNDETERMINED = "und"
#: A model of more bytes isn't broadcast.
MODEL_BYTES = 512 << 20


@dataclass(frozen=True)
class Model:
    """languages; symbol of each code point; for each n from 1 to ORDER the sorted n-grams and their log2 probabilities
    by language (rows of the sorted array), and for each n the sorted contexts, one symbol shorter, and their log2 back-off weights."""

    languages: list[str]
    symbols: np.ndarray
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    scale: float = 1.0
    offset: float = 0.0
    #: Symbols in all, the border and the shared one included.
    alphabet: int = ALPHABET + 1


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _codes(points: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Symbols of the characters; every run of what isn't a letter is one word border (0)."""
    s = symbols[points]
    return s[(s != 0) | np.concatenate([[True], s[:-1] != 0])] if len(s) else s


def _ngrams(s: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-grams that end at each symbol from place ORDER - 1 on."""
    out = np.zeros(len(s) - ORDER + 1, np.uint64)
    for k in range(n):
        at = ORDER - n + k
        out = (out << np.uint64(BITS)) | s[at : at + len(out)]
    return out


def _padded(s: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(ORDER - 1, np.uint32), s, np.zeros(1, np.uint32)])


def is_letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


class Reader:
    """Cross-entropies of texts under a model; holds its arrays in a worker."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def logs(self, s: np.ndarray) -> np.ndarray:
        """log2 probability of each symbol of the padded s given the ORDER - 1 before it, by language."""
        m = self.model
        out = np.zeros((len(s) - ORDER + 1, len(m.languages)), np.float32)
        todo = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            grams = _ngrams(s, n)[todo]
            at, hit = _lookup(m.grams[n - 1], grams)
            out[todo[hit]] += m.logs[n - 1][at[hit]]
            todo, grams = todo[~hit], grams[~hit]
            at, hit = _lookup(m.contexts[n - 1], grams >> np.uint64(BITS))
            out[todo[hit]] += m.backoffs[n - 1][at[hit]]
        out[todo] -= np.float32(np.log2(m.alphabet))  # no order knows it: all symbols alike
        return out

    def entropies(self, texts: list[str | None], most: int = 1 << 20) -> np.ndarray:
        """Bits a symbol, by text and language; NaN where a text is null or has no letter. Texts are read together, long ones in parts."""
        out = np.full((len(texts), len(self.model.languages)), np.nan)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            logs = self.logs(np.concatenate([np.zeros(ORDER - 1, np.uint32), *(np.concatenate([s, np.zeros(ORDER - 1, np.uint32)]) for _, s in held)]))
            begin = np.cumsum([0, *(len(s) + ORDER - 1 for _, s in held)])[:-1]
            # each text's symbols and the border after it; the filling between texts is left out
            stops = begin + np.array([len(s) + 1 for _, s in held])
            pairs = np.empty(2 * len(begin), np.int64)
            pairs[::2], pairs[1::2] = begin, np.minimum(stops, len(logs) - 1)
            sums = np.add.reduceat(logs.astype(np.float64), pairs, axis=0)[::2]
            for (i, s), total in zip(held, sums, strict=True):
                out[i] = np.nan_to_num(out[i]) - total
                lengths[i] += len(s) + 1
            held, size = [], 0

        lengths = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not text:
                continue
            points = _points(text)
            for k in range(0, len(points), most):
                s = _codes(points[k : k + most], self.model.symbols)
                if s.any():
                    held.append((i, s))
                    size += len(s)
                    if size >= most:
                        flush()
        flush()
        return out / np.where(lengths, lengths, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score, and the margin in bits a symbol to the second language."""
        bits = self.entropies(texts)
        none = np.isnan(bits[:, 0]) if bits.shape[1] else np.ones(len(texts), bool)
        ranked = np.sort(np.where(none[:, None], 0, bits), axis=1)
        margin = ranked[:, 1] - ranked[:, 0] if bits.shape[1] > 1 else np.full(len(texts), 1.0)
        best = np.where(none[:, None], 0, bits).argmin(1) if bits.shape[1] else np.zeros(len(texts), int)
        score = 1 / (1 + np.exp(-np.clip(self.model.scale * margin + self.model.offset, -30, 30)))
        names = [UNDETERMINED if n else self.model.languages[b] for n, b in zip(none, best, strict=True)]
        return names, np.where(none, 0.0, score), np.where(none, 0.0, margin)


def _sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(__lang, __h, __text): of each language, the learnable documents whose hash, as a number from 0 to 1, is under sample / count.

    Learnable is any text with a letter, whatever its length, and the count (of different ids, about) is of those alone. So about ``sample``
    of them at any size of the corpus; the count is the only pass over all rows. Rows that repeat an id are taken once.
    """
    known = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text")).where("__lang is not null and __id is not null").where(remainder("__id") != 2)
    known = known.where(F.col("__text").rlike(r"\p{L}"))
    counts = known.groupBy("__lang").agg((sample / F.approx_count_distinct("__id")).alias("__share"))  # one row a language
    place = F.shiftrightunsigned("__h", 11) * F.lit(2.0**-53)
    rated = known.withColumn("__h", F.xxhash64(F.lit("language"), "__id"))
    chosen = rated.join(F.broadcast(counts), "__lang").where(place < F.col("__share"))
    # of rows that share an id, the one with the least text
    return chosen.groupBy("__lang", "__h").agg(F.min(windowed(F.col("__text"), F.col("__id"), MOST_CHARS)).alias("__text"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Count n-grams of a bounded sample in Spark, and make the models' arrays from the counts.

    Learned from: rows that aren't held out, with a language; at most about ``sample`` documents of each language by hash. A fifth
    of these isn't counted and calibrates the score (the probability that the language is right, given the margin).
    The counts are bounded by the sample, not by the corpus.
    """
    ship(docs.sparkSession)
    rows = _sampled(docs, id_col, text_col, lang_col, sample)
    letters = is_letter_table()
    counted = rows.where(F.pmod("__h", F.lit(5)) != 0)

    def characters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                found, n = np.unique(np.concatenate([_points(t) for t in frame["__text"]]), return_counts=True)
                yield pd.DataFrame({"c": found.astype(np.int64), "n": n})

    seen = counted.select("__text").mapInPandas(characters, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    seen = seen[letters[seen["c"].to_numpy(int)]].sort_values(["n", "c"], ascending=[False, True])["c"].to_numpy(int)
    seen = seen[: (1 << BITS) - 2]
    symbols = np.where(letters, np.uint32(max(ALPHABET, len(seen) + 1)), np.uint32(0)).astype(np.uint32)
    symbols[seen] = np.arange(1, len(seen) + 1)
    small = symbols.astype(np.uint16)

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = small.astype(np.uint32)
        for frame in frames:
            for lang, part in frame.groupby("__lang"):
                s = [_padded(_codes(_points(t), table)) for t in part["__text"]]
                found, n = np.unique(np.concatenate([_ngrams(x, ORDER) for x in s]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "g": found.astype(np.int64), "n": n})

    counts = counted.select("__lang", "__text").mapInPandas(grams, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toPandas()
    model = kneser_ney({lang: (p["g"].to_numpy(np.int64).astype(np.uint64), p["n"].to_numpy(float)) for lang, p in counts.groupby("lang")}, symbols)
    if len(model.languages) < 2:
        return model
    kept = rows.where(F.pmod("__h", F.lit(5)) == 0).select("__lang", "__text").limit(sample * max(1, len(model.languages))).toPandas()
    if not len(kept):
        return model
    names, _, margin = Reader(model).predict(list(kept["__text"]))
    right = np.array([a == b for a, b in zip(names, kept["__lang"], strict=True)], float)
    # one case of doubt for each outcome, so that a faultless sample doesn't give certainty
    scale, offset = logistic(np.concatenate([margin, [0.0, 0.0]])[:, None], np.concatenate([right, [0.0, 1.0]]), np.ones(len(right) + 2))
    return Model(**{**model.__dict__, "scale": max(float(scale), 0.0), "offset": float(offset)})


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], symbols: np.ndarray) -> Model:
    """Interpolated Kneser-Ney models over the n-grams of all languages, from each language's counts of ORDER-grams.

    The top order uses counts; lower orders use in how many contexts a gram occurs. Every gram of any language gets its
    interpolated probability under each language, so that a gram is looked up once for all of them.
    """
    languages = sorted(counts)
    tables: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(ORDER)]
    for lang in languages:
        grams, n = counts[lang]
        order = np.argsort(grams)
        tables[ORDER - 1][lang] = grams[order], n[order]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: different grams one longer with this ending
            ends, n = np.unique(tables[k][lang][0] & np.uint64((1 << (BITS * k)) - 1), return_counts=True)
            tables[k - 1][lang] = ends, n.astype(float)
    grams, logs, contexts, backoffs = [], [], [], []
    alphabet = int(symbols.max()) + 1
    floor = 1 / alphabet
    for k in range(ORDER):
        union = np.unique(np.concatenate([tables[k][lang][0] for lang in languages])) if languages else np.zeros(0, np.uint64)
        context = union >> np.uint64(BITS)
        unique = np.unique(context)
        p, back = np.zeros((len(union), len(languages))), np.zeros((len(unique), len(languages)))
        for j, lang in enumerate(languages):
            own, n = tables[k][lang]
            head = own >> np.uint64(BITS)
            heads, first = np.unique(head, return_index=True)
            total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(head)))
            weight = np.ones(len(unique))
            weight[np.searchsorted(unique, heads)] = DISCOUNT * kinds / total
            at, hit = _lookup(own, union)
            t = np.ones(len(unique))
            t[np.searchsorted(unique, heads)] = total
            where = np.searchsorted(unique, context)
            discounted = np.where(hit, np.maximum(n[at] - DISCOUNT, 0), 0) / t[where]
            if k == 0:
                lower = np.full(len(union), floor)
            else:
                ending = union & np.uint64((1 << (BITS * k)) - 1)
                below, found = _lookup(grams[k - 1], ending)
                lower = np.where(found, np.exp2(logs[k - 1][below, j].astype(float)), floor)
            p[:, j] = discounted + weight[where] * lower
            back[:, j] = weight
        grams.append(union)
        logs.append(np.log2(np.maximum(p, 1e-12)).astype(np.float32))
        contexts.append(unique)
        backoffs.append(np.log2(np.maximum(back, 1e-12)).astype(np.float32))
    return Model(languages, symbols, grams, logs, contexts, backoffs, alphabet=alphabet)


def model_bytes(model: Model) -> int:
    return sum(a.nbytes for group in (model.grams, model.logs, model.contexts, model.backoffs) for a in group)


def identify(docs: DataFrame, model: Model, text: Column) -> DataFrame:
    """docs with __lang (``und`` without a letter or without models), __lang_score, and __rejected (score under one half).

    Of languages with equal cross-entropy the first by name is taken. Null texts and those without a letter are ``und`` with score 0; texts of any length are
    read whole, in parts; equal texts are answered alike; other columns pass through. An empty table gives an empty table. The model is
    broadcast once; its size follows the sample and the number of languages, not the corpus, and one over MODEL_BYTES is an error.
    """
    ship(docs.sparkSession)
    if (size := model_bytes(model)) > MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes for {len(model.languages)} languages is too large to broadcast; learn from a smaller sample")
    shared = docs.sparkSession.sparkContext.broadcast(Model(**{**model.__dict__, "symbols": model.symbols.astype(np.uint16)}))

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        reader = Reader(Model(**{**own.__dict__, "symbols": own.symbols.astype(np.uint32)}))
        for texts in batches:
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if own.languages:
                parts = [reader.predict(texts.slice(k, 256).to_pylist()) for k in range(0, len(texts), 256)]
                names, scores = [x for p in parts for x in p[0]], np.concatenate([np.zeros(0), *(p[1] for p in parts)])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    found = docs.withColumn("__found", of(text))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__found.lang").alias("__lang"), F.col("__found.score").alias("__lang_score"), (F.col("__found.score") < 0.5).alias("__rejected"))
