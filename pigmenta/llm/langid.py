"""Language identification: multinomial naive Bayes over hashed character n-grams.

Runs of letters, in lower case and fenced by a space on each side, are cut into
n-grams of one to four characters, hashed to ``BUCKETS`` buckets. Counts by
language give smoothed log-probabilities, a buckets x languages matrix that is
broadcast. A text's score is the sum of its n-grams' rows; texts are scored
together, in flat arrays, so a batch costs a few numpy calls.

Learning takes a bounded sample, about ``PER_LANG`` documents of each language,
chosen by a hash of the document's id; counting is spread over the executors.

Defined results
  * null text or one without a letter: language ``und``, score 0;
  * nothing to learn from (an empty table): every text is ``und``, score 0;
  * ties go to the language that comes first in alphabetical order;
  * the score is the posterior probability of the answer after the evidence is
    divided by the root of the n-gram count (n-grams are not independent);
  * very long texts are treated whole, about 70 bytes a character while their n-grams are counted; an empty text is one without a letter;
  * repeated rows: each by itself; null doc_id passes through; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
PER_LANG = 2000
ORDERS = (1, 2, 3, 4)
NONE = "und"
#: Characters that are scored at once.
FLUSH = 1_000_000
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)], bool)


_LETTER: np.ndarray | None = None


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text number of each, and whether each text has a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    low = [t.lower() for t in texts]
    chars = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.array([len(t) + 2 for t in low])
    owner = np.repeat(np.arange(len(texts)), length)
    letter = _LETTER[chars]
    has = np.bincount(owner, letter, minlength=len(texts)) > 0
    near = letter.copy()  # letters, and one space for each other run between them
    near[1:] |= letter[:-1]
    chars, owner, letter = chars[near], owner[near], letter[near]
    x = np.where(letter, chars, 32).astype(np.uint64)
    out, whose = [], []
    for n in ORDERS:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + x[i : len(x) - n + 1 + i] * _MUL[i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        same = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            same = same & letter
        out.append((h[same] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        whose.append(owner[: len(h)][same])
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate(whose) if whose else np.zeros(0, np.int64), has


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # buckets x languages
    prior: np.ndarray


def train(df: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.05) -> Model | None:
    """Fit on all rows of ``df``, which is the (bounded) sample; counts are summed on the executors."""
    langs = sorted(r[0] for r in df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string")).distinct().collect())
    if not langs:
        return None

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, len(langs)), np.int64)
        docs = np.zeros(len(langs), np.int64)
        for b in it:
            for label, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = langs.index(label)
                found, _, _ = grams([value.as_py() or ""])
                total[:, at] += np.bincount(found, minlength=BUCKETS)
                docs[at] += 1
        where, which = np.nonzero(total)
        cells = np.concatenate((where * len(langs) + which, np.arange(len(langs)) - len(langs)))
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.concatenate((total[where, which], docs)), pa.int64())], ["cell", "n"])

    parts = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), text).repartition(12).mapInArrow(count, "cell long, n long")
    summed = parts.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = summed["cell"].to_numpy(), summed["n"].to_numpy().astype(float)
    total, docs = np.zeros(BUCKETS * len(langs)), np.zeros(len(langs))
    docs[cell[cell < 0] + len(langs)] = n[cell < 0]
    total[cell[cell >= 0]] = n[cell >= 0]
    total = total.reshape(BUCKETS, len(langs)) + smoothing
    return Model(langs, np.log(total / total.sum(0)).astype(np.float32), np.log((docs + 1) / (docs + 1).sum()))


def score(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    found, whose, has = grams(texts)
    n = np.bincount(whose, minlength=len(texts))
    sums = np.stack([np.bincount(whose, model.logs[found, k], len(texts)) for k in range(len(model.langs))], 1) + model.prior
    best = sums.argmax(1)
    soft = (sums - sums.max(1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
    share = 1 / np.exp(soft).sum(1)
    return [model.langs[b] if ok else NONE for b, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, share, 0.0)


PREDICTED = "doc_id long, lang_pred string, score double"


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of each row's whole text (see ``PREDICTED``)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(docs: list, texts: list[str]) -> pa.RecordBatch:
            langs, scores = ([NONE] * len(texts), np.zeros(len(texts))) if shared.value is None else score(texts, shared.value)
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

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

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, PREDICTED)
