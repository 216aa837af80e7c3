"""Quality scores by nearest neighbours among labelled latent-semantic vectors.

A text's terms are hashed: word shapes (letters, digits and signs, runs of one
kind as one), pairs of neighbouring shapes, words, and marks of repetition.
Weighted by log frequency and inverse document frequency they are projected to
``RANK`` latent dimensions, the leading singular vectors of the labelled
sample's term-document matrix. The labelled vectors are broadcast. For every
document the cosine with each of them is computed, exactly and in blocks, and
the ``NEAREST`` ones vote with their label, weighted by similarity.

The labelled sample is bounded, about ``PER_CLASS`` documents of each label,
chosen by a hash of the document's id; that bounds what is broadcast.

Defined results
  * null or empty text: no terms; the score is the labelled sample's own share of label 1;
  * nothing to learn from: every score is 0; an empty table to score gives an empty result;
  * several labels for one document: the largest counts; rows without label are not learned from;
  * ties of similarity go to the smaller place in the sample's fixed order;
  * repeated rows: each by itself; null doc_id passes through; extra columns are ignored;
  * very long texts are treated whole, about 120 bytes a character while their terms are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.common import run_prints

PER_CLASS = 2000
RANK = 48
NEAREST = 21
#: Hash ranges of shapes with their pairs, and of words; after them the marks of repetition.
SHAPES, WORDS, MARKS = 4096, 4096, 8
DIMS = SHAPES + WORDS + MARKS
#: Documents to a block of cosines, and characters that are turned into terms at once.
BLOCK = 256
FLUSH = 1_000_000

_KIND = np.zeros(129, np.int64)
for _c in range(128):
    _ch = chr(_c)
    _KIND[_c] = 0 if _ch.isspace() or _c < 32 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 10 + _c
_KIND[128] = 1

def _segments(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2] - edge[0::2]


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of every term occurrence."""
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    origin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    kind = _KIND[np.minimum(chars, 128)]
    start, length = _segments(kind > 0)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who = np.searchsorted(origin, start, "right") - 1
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    short = kind[new]
    s_start, s_length = _segments(short > 0)
    shape = run_prints(short, s_start, s_length)
    word = run_prints(chars, start, length)
    same = who[1:] == who[:-1]
    pair = (shape[:-1] * np.uint64(31) + shape[1:] * np.uint64(0x85EBCA6B))[same]
    part = lambda h, n: ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    owners, found = [who, who[1:][same], who], [part(shape, SHAPES), part(pair, SHAPES), SHAPES + part(word, WORDS)]
    again = same & (word[1:] == word[:-1])
    owners.append(who[1:][again])
    found.append(np.full(int(again.sum()), SHAPES + WORDS))
    both = who.astype(np.uint64) * np.uint64(0x100000001B3) ^ word
    _, first = np.unique(both, return_index=True)
    rest = np.ones(len(who), bool)
    rest[first] = False
    total, repeated = np.bincount(who, minlength=len(texts)), np.bincount(who[rest], minlength=len(texts))
    level = np.minimum((repeated * 7) // np.maximum(total, 1), 6) + 1
    live = np.flatnonzero(total)
    owners.append(np.repeat(live, 8))
    found.append(np.repeat(SHAPES + WORDS + level[live], 8))
    return np.concatenate(owners), np.concatenate(found)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, term) with log(1 + occurrences)."""
    who, term = terms(texts)
    cell, n = np.unique(who * DIMS + term, return_counts=True)
    return cell // DIMS, cell % DIMS, np.log1p(n).astype(np.float32)


def _dense(who: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((rows, DIMS), np.float32)
    out[who, term] = value
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Model:
    project: np.ndarray  # terms x rank, inverse document frequency included
    vectors: np.ndarray  # labelled sample x rank, of unit length
    labels: np.ndarray

    @property
    def share(self) -> float:
        return float(self.labels.mean())


def fit(texts: list[str], labels: list[int], rank: int = RANK) -> Model:
    """Latent dimensions of the sample by subspace iteration, and its vectors there."""
    who, term, value = counted(texts)
    seen = np.bincount(term, minlength=DIMS)
    idf = np.where(seen > 0, np.log((1 + len(texts)) / (1 + seen)) + 0.1, 0).astype(np.float32)
    x = _unit(_dense(who, term, value * idf[term], len(texts)))
    basis = np.random.default_rng(3).standard_normal((DIMS, rank + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x @ basis)
        basis = x.T @ q
    _, _, right = np.linalg.svd(basis.T, full_matrices=False)
    project = np.ascontiguousarray(right[:rank].T) * idf[:, None]
    return Model(project.astype(np.float32), _unit(x @ right[:rank].T).astype(np.float32), np.asarray(labels, np.float32))


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row; of equal ones the first columns."""
    least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above, equal = cosine > least, cosine == least
    take = above | (equal & (equal.cumsum(1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(cosine), k)


def score(texts: list[str], model: Model, nearest: int = NEAREST) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    out = np.full(len(texts), model.share)
    who, term, value = counted(texts)
    edges = np.searchsorted(who, np.arange(len(texts) + 1))
    k = min(nearest, len(model.labels))
    for a in range(0, len(texts), BLOCK):
        b = min(a + BLOCK, len(texts))
        own = slice(edges[a], edges[b])
        have = np.diff(edges[a : b + 1]) > 0
        if not have.any():
            continue
        rows = model.project[term[own]] * value[own, None]
        at = np.zeros((b - a, rows.shape[1]), np.float32)
        at[have] = np.add.reduceat(rows, edges[a:b][have] - edges[a], axis=0)
        cosine = _unit(at) @ model.vectors.T
        top = _nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, top, 1), 0).astype(np.float64) ** 4
        total = weight.sum(1)
        vote = (weight * model.labels[top]).sum(1) / np.maximum(total, 1e-12)
        out[a:b] = np.where(have & (total > 0), vote, out[a:b])
    return out


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Fit on all rows of ``df``, which is the (bounded) sample, in one task; rows go in the order of a hash of their key."""

    def one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in it for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not got:
            return
        got.sort(key=lambda x: (x[0], x[2]))
        m = fit([x[2] for x in got], [x[1] for x in got])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.project, m.vectors, m.labels)], ["project", "vectors", "labels"])

    sample = df.select(F.xxhash64(F.lit("order"), key).alias("place"), F.col(label).cast("int").alias("y"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = sample.repartition(1).mapInArrow(one, "project binary, vectors binary, labels binary").collect()
    if not rows:
        return None
    project, vectors, labels = (np.frombuffer(bytes(x), np.float32) for x in rows[0])
    return Model(project.reshape(DIMS, -1), vectors.reshape(len(labels), -1), labels)


SCORED = "doc_id long, score double"


def score_quality(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of each row's whole text (see ``SCORED``)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(docs: list, texts: list[str]) -> pa.RecordBatch:
            scores = np.zeros(len(texts)) if shared.value is None else score(texts, shared.value)
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

        for b in it:
            docs, texts, n = [], [], 0
            for doc, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs.append(doc)
                texts.append(value.as_py() or "")
                n += len(texts[-1])
                if n >= FLUSH:
                    yield settle(docs, texts)
                    docs, texts, n = [], [], 0
            if docs:
                yield settle(docs, texts)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, SCORED)
