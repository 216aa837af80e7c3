"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters in lower case. Features are single words, word stems
(first letters), pairs of neighbours and pairs with one or two words left out
between them, each hashed to one of ``DIMS`` coordinates and present or not. The
learner adapts its rate to each coordinate; its L1 term keeps all but a few
weights at zero, so what is broadcast is a short list of (coordinate, weight),
and scoring drops nearly all features of a text at the first look.

The scores' level is set on slices that were left out of learning, so that a rare label isn't scored low for being rare.

Learning is sequential. It runs in one task over a bounded sample, about
``PER_CLASS`` documents of each label, chosen by a hash of the document's id.

Defined results
  * null or empty text, or one without a word: the score of the constant term alone;
  * nothing to learn from: every score is 0; an empty table to score gives an empty result;
  * several labels for one document: the largest counts; rows without label are not learned from;
  * repeated rows: each by itself; null doc_id passes through; extra columns are ignored;
  * ties: rows with one place in the order go by their features; the sum of a text's weights doesn't depend on order;
  * very long texts are treated whole, about 100 bytes a word while their features are hashed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.common import hash_words, mixed

DIMS = 1 << 20
PER_CLASS = 3000
EPOCHS = 8
#: Slices of the sample that are left out in turn to set the constant term.
SLICES = 2
#: Left-out words between the two of a pair; 0 is the plain word pair.
GAPS = (0, 1, 2)
STEMS = (4, 5)

_WORD = re.compile(rb"[a-z\x80-\xff]+")


def features(text: str) -> np.ndarray:
    """Coordinates of all features, with repetitions."""
    words = _WORD.findall(text.lower().encode("utf-8", "replace"))
    if not words:
        return np.zeros(0, np.int64)
    h = hash_words(words)
    parts = [h, *(hash_words([w[:n] for w in words if len(w) > n]) ^ np.uint64(n) for n in STEMS)]
    parts += [mixed(h[: len(h) - g - 1], h[g + 1 :], 17 + 7 * g) for g in GAPS if len(h) > g + 1]
    return (np.concatenate(parts) >> np.uint64(24)).astype(np.int64) % DIMS


@dataclass
class Model:
    where: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(DIMS, np.float32)
        out[self.where] = self.weight
        return out


def ftrl(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float | None = None, l2: float = 0.05) -> Model:
    """Fit on rows of distinct coordinates (whole numbers of any width), in the given order, ``epochs`` times. ``l1`` grows with the rarer label unless given."""
    l1 = 2.5 + min(sum(labels), len(labels) - sum(labels)) / 300 if l1 is None else l1
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(zi: np.ndarray, ni: np.ndarray, reach: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(zi) <= reach, 0.0, -(zi - np.sign(zi) * reach) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            at = np.append(row, DIMS)  # the constant term
            zi, ni = z[at], n[at]
            reach = np.full(len(at), l1)
            reach[-1] = 0
            w = weights(zi, ni, reach)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - y
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] += g - step * w
            n[at] += g * g
    where = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Model(where, weights(z[where], n[where], l1).astype(np.float32), float(weights(z[-1:], n[-1:], 0.0)[0]))


def margins(rows: list[np.ndarray], model: Model) -> np.ndarray:
    weights = model.dense()
    return np.array([model.bias + float(weights[r].sum(dtype=np.float64)) for r in rows])


def offset(margin: np.ndarray, labels: np.ndarray, prior: float = 0.01) -> float:
    """What to add to margins so that their likelihood is greatest with both labels counting alike; drawn a little towards 0."""
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    low, high = -20.0, 20.0
    for _ in range(60):
        b = (low + high) / 2
        slope = float((share * (labels - 1 / (1 + np.exp(-np.clip(margin + b, -35, 35))))).sum()) - prior * b
        low, high = (b, high) if slope > 0 else (low, b)
    return b


def fit(rows: list[np.ndarray], labels: list[int], slices: int = SLICES) -> Model:
    """The learner over all rows. Its constant term is set so that 0.5 means even odds between labels of equal number, told by slices that were left out in turn."""
    model, held = ftrl(rows, labels), [np.zeros(0), np.zeros(0)]
    for k in range(slices):
        rest = [i for i in range(len(rows)) if i % slices != k]
        if 0 < sum(labels[i] for i in rest) < len(rest):
            part = ftrl([rows[i] for i in rest], [labels[i] for i in rest])
            held = [np.append(held[0], margins(rows[k::slices], part)), np.append(held[1], labels[k::slices])]
    if 0 < held[1].sum() < len(held[1]):
        model.bias += offset(*held)
    return model


def fit_batches(batches: Iterator[pa.RecordBatch]) -> Model | None:
    """Fit on batches of (place in the order, label, coordinates as little-endian unsigned 32-bit numbers); the coordinates are not copied."""
    place, labels, rows = [], [], []
    for b in batches:
        place += b.column(0).to_pylist()
        labels += b.column(1).to_pylist()
        rows += [np.frombuffer(v.as_buffer(), "<u4") for v in b.column(2)]
    if not rows:
        return None
    shared = {p for p, n in Counter(place).items() if n > 1}
    order = sorted(range(len(rows)), key=lambda i: (place[i], rows[i].tobytes() if place[i] in shared else b""))
    return fit([rows[i] for i in order], [labels[i] for i in order])


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit on all rows of ``df``, which is the (bounded) sample, in one task; rows go in the order of a hash of their key."""

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [np.unique(features(v.as_py() or "")).astype("<u4").tobytes() for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["place", "y", "row"])

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_batches(it)
        if model is None:
            return
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.where, -1), pa.int64()), pa.array(np.append(model.weight, model.bias), pa.float64())], ["at", "w"])

    sample = df.select(F.xxhash64(F.lit("order"), key).alias("place"), F.col(label).cast("int").alias("y"), F.col(text).alias("t"))
    found = sample.mapInArrow(parts, "place long, y int, row binary").repartition(1).mapInArrow(learn, "at long, w double").toPandas()
    if not len(found):
        return None
    at, w = found["at"].to_numpy(np.int64), found["w"].to_numpy(float)
    return Model(at[:-1], w[:-1].astype(np.float32), float(w[-1]))


def score(text: str, weights: np.ndarray, bias: float) -> float:
    at = features(text)
    at = np.unique(at[weights[at] != 0])
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(weights[at].sum(dtype=np.float64))))))


SCORED = "doc_id long, score double"


def score_toxicity(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score of each row's whole text (see ``SCORED``). ``keep`` names columns to carry along unchanged."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = None if shared.value is None else shared.value.dense()
        for b in texts:
            yield pa.array([0.0 if weights is None else score(v.as_py() or "", weights, shared.value.bias) for v in b], pa.float64())

    carried = [F.col(c).alias(f"_{c}") for c in keep]
    of = F.arrow_udf(scores, "double")  # the text alone goes to Python, the score alone comes back
    return df.select(F.col(key).cast("long").alias("doc_id"), of(F.col(text)).alias("score"), *carried)
