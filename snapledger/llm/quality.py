"""Operator 3, a quality classifier by compression with labelled dictionaries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, ship, windowed

#: Documents learned from, for each label, chosen by hash; of those over MOST_CHARS code points, as many in windows spread over the whole text. So the driver
#: gets at most 2 * SAMPLE * MOST_CHARS code points (60 million).
SAMPLE, MOST_CHARS = 1500, 20_000
#: Bytes of a dictionary and of the pieces that it is trained on.
DICTIONARY, TRAINED, LEVEL = 112_640, 1024, 3
#: Bytes of the pieces of a text that are compressed apart. Short ones leave only the dictionary to refer to, so a text's own repeats don't hide its kind.
PIECE = 192
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


class Scorer:
    """Scores by one model; holds the compressors of a worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        self._good, self._bad = make(model.good), make(model.bad)

    def evidence(self, text: str | None) -> tuple[float, float] | None:
        """The compressed-size difference, bytes with the bad dictionary less bytes with the good, over all pieces:
        over the sum of both sizes, and over the bytes of the text. None without text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return None
        good = bad = 0
        for k in range(0, len(data), PIECE):
            piece = data[k : k + PIECE]
            good += len(self._good.compress(piece))
            bad += len(self._bad.compress(piece))
        return (bad - good) / (bad + good), (bad - good) / len(data)

    def score(self, text: str | None) -> float:
        found = self.evidence(text)
        if found is None:
            return self.model.prior
        x = self.model.weights[-1] + sum(w * e for w, e in zip(self.model.weights, found))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the columns of x, then the offset, of a logistic fit: Newton steps, a small ridge on scaled columns."""
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 5e-2), 1e-6)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / scale
    return np.append(slopes, w[-1] - slopes @ mean)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample: at most ``sample`` labelled documents of each label, not held out and with text of any length, chosen by hash.

    Seven tenths of the sample make the dictionaries, the rest calibrates, weighted to the labels' shares among all labelled
    rows. Ids that repeat are taken once a label and text; labels other than 0 and 1, null ids and empty texts aren't learned from. Without four
    texts of both labels the score is the share of label 1 (one half without labels).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(remainder("__id") != 2)
    shares = {int(r["__label"]): int(r["n"]) for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    prior = (shares.get(1, 0) + 1) / (total + 2)
    order = F.xxhash64(F.lit("quality"), "__id")
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") >= 1)
    readable = known.join(text.select("__id"), "__id", "left_semi")
    chosen = None
    for label in sorted(shares):
        part = readable.where(F.col("__label") == label).dropDuplicates(["__id"]).orderBy(order, "__id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return Model(b"", b"", (), prior)
    rows = text.join(F.broadcast(chosen), "__id").select("__label", windowed(F.col("__text"), F.col("__id"), MOST_CHARS).alias("__text"), order.alias("__h"), F.xxhash64("__text").alias("__digest")).orderBy("__h", "__digest", "__label").limit(2 * sample).collect()
    fit = {label: [r["__text"].encode("utf-8", "surrogatepass") for r in rows if r["__label"] == label] for label in (0, 1)}
    if min(map(len, fit.values())) < 4:
        return Model(b"", b"", (), prior)
    cut = {label: max(1, len(fit[label]) * 7 // 10) for label in fit}
    model = Model(_dictionary(fit[1][: cut[1]]), _dictionary(fit[0][: cut[0]]), (), prior)
    scorer = Scorer(model)
    x, y, w = [], [], []
    for label in (0, 1):
        rest = fit[label][cut[label] :]
        for data in rest:
            x.append(scorer.evidence(data.decode("utf-8", "surrogatepass")))
            y.append(label)
            w.append(shares[label] / total / len(rest) * len(rows))
    weights = logistic(np.array(x), np.array(y, float), np.array(w))
    return Model(model.good, model.bad, tuple(weights.tolist()), prior)


def _dictionary(texts: list[bytes]) -> bytes:
    """The most useful DICTIONARY bytes of the texts; their pieces themselves where there are too few to train on."""
    parts = [t[k : k + TRAINED] for t in texts for k in range(0, len(t), TRAINED)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def score(model: Model, text: Column) -> Column:
    """Score from 0 to 1 of every whole text; null and empty texts get the share of label 1."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model) if model.good else None
        for texts in batches:
            if scorer is None:
                yield pa.array(np.full(len(texts), model.prior))
            else:  # few texts are Python objects at a time
                yield pa.array([scorer.score(t) for k in range(0, len(texts), 256) for t in texts.slice(k, 256).to_pylist()], pa.float64())

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs with __score and __predicted (1 at THRESHOLD or more). Null and empty texts get the prior; texts of any length are read whole, in pieces; equal texts
    score alike; other columns pass through. An empty table gives an empty table, and without labels every row gets one half."""
    ship(docs.sparkSession)
    model = learn(docs, labels, id_col, text_col, label_col)
    return docs.withColumn("__score", score(model, F.col(text_col))).withColumn("__predicted", (F.col("__score") >= THRESHOLD).cast("int"))
