"""Quality rules from repetition: how much of a text stands inside n-grams and lines that the text repeats.

A batch's words are hashed once (64 bits). Over them runs one prefix sum of a polynomial, modulo 2^64 with an odd base, so
that the rolling hash of every window of any length is a difference of two sums, turned back to its start by a power of
the base's inverse. Windows that leave their text are masked, and a hash is mixed with its text's number. Sorting finds the
hashes that occur twice; a longer window need only be looked at where a shorter one repeats. Words inside repeated windows
are covered, and each is measured once, in characters (code points).

A text fails if it has under ``LEAST_WORDS`` words, if more than half of its words stand in repeated windows of ``BASE`` words,
or if the characters in repeated n-grams or lines make up more than the published share for that length (``MOST``,
``MOST_LINES``; Rae et al. 2021, in percent). All comparisons are of whole numbers.

The published shares count a repeated n-gram's later occurrences; so ``dup_chars`` leaves the first occurrence out,
while ``n_repeat_words`` takes it in.

Defined results
  * null text and text without words: all counts are 0, ``base_failed`` is true, ``kept`` false;
  * a line without a word is neither counted nor measured; the last line may lack its end;
  * ties don't arise: all occurrences of a window count alike, and the first is the one that starts first;
  * repeated rows: each by itself; a null id passes through; other columns pass through, clashing names are replaced;
  * very long texts are treated whole, about 150 bytes a word while they are measured; texts share a batch up to ``FLUSH`` characters;
  * an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from pigmenta.llm.common import hash_words, mixed

LEAST_WORDS = 50
#: Words of a window of the base rule, and its limit in percent of the words.
BASE, MOST_BASE = 3, 50
# Published limits, in percent of a text's characters, by words of an n-gram, and of repeated lines.
MOST = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MOST_LINES = 20
SYMBOLS = "#*$%&|<>"
#: Characters that are measured at once; a longer text is measured alone.
FLUSH = 2_000_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "line_chars")
RESULT = StructType([*(StructField(c, LongType()) for c in _COUNTS), StructField("dup_chars", ArrayType(LongType())), StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])

_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial, and the factors that turn a window's sum back to its start."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_ODD, n), out=sums[1:])
    return sums, _powers(_BACK, n)


def repeated(sums: np.ndarray, back: np.ndarray, owner: np.ndarray, length: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at ``start`` those that their text holds twice or more there, and whether each is a later occurrence.

    Hashes are sorted without their places first; only those that occur twice are looked up again.
    """
    start = start[start + length <= len(owner)]
    start = start[owner[start + length - 1] == owner[start]]
    print_ = mixed((sums[start + length] - sums[start]) * back[start], owner[start].astype(np.uint64))
    ranked = np.sort(print_)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return start[:0], np.zeros(0, bool)
    at = twice[np.minimum(np.searchsorted(twice, print_), len(twice) - 1)] == print_
    start, print_ = start[at], print_[at]
    order = np.argsort(print_, kind="stable")  # equal windows stay in order of their start
    later = np.zeros(len(order), bool)
    later[order[1:]] = print_[order[1:]] == print_[order[:-1]]
    return start, later


def inside(start: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``length`` words at one of ``start``."""
    edge = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(start + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:-1]) > 0


def _lines(text: str) -> tuple[int, int, int]:
    """Lines with a word that equal an earlier one, their characters, and the characters of all lines with a word."""
    own = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    once = set(own)
    total = sum(map(len, own))
    return len(own) - len(once), total - sum(map(len, once)), total


def measure(texts: list[str]) -> dict[str, list]:
    """Columns of ``RESULT`` for each text."""
    n = len(texts)
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # splits at the six ASCII blanks only
    sizes = np.fromiter(map(len, words), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    flat = [w for ws in words for w in ws]
    raw = np.frombuffer(b"".join(flat), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = np.diff(points[np.concatenate(([0], ends))])
    per_text = lambda weight: np.bincount(owner, weight, n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
    word_chars = per_text(chars)
    sums, back = rolling(hash_words(flat))
    start, later = repeated(sums, back, owner, BASE, np.arange(len(owner)))
    repeat = per_text(inside(start, BASE, len(owner)))
    dup = np.zeros((n, len(MOST)), np.int64)
    for i, k in enumerate(MOST):  # lengths grow, and a repeated window starts with a shorter one that repeats
        start, later = repeated(sums, back, owner, k, start)
        dup[:, i] = per_text(inside(start[later], k, len(owner)) * chars)
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(n, 3)
    base_failed = (sizes < LEAST_WORDS) | (100 * repeat > MOST_BASE * sizes)
    heavy = (100 * dup > np.array(list(MOST.values())) * word_chars[:, None]).any(1) | (100 * lines[:, 1] > MOST_LINES * lines[:, 2])
    return {
        "n_words": sizes.tolist(), "word_chars": word_chars.tolist(), "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": lines[:, 0].tolist(), "n_repeat_words": repeat.tolist(),
        "dup_line_chars": lines[:, 1].tolist(), "line_chars": lines[:, 2].tolist(), "dup_chars": dup.tolist(), "base_failed": base_failed.tolist(), "kept": (~base_failed & ~heavy).tolist(),
    }


def repetition_rules(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, unless given) of ``df`` with those of ``RESULT``; see the module for both verdicts."""
    keep = tuple(c for c in (df.columns if keep is None else keep) if c not in RESULT.names)
    schema = StructType([StructField(c, df.schema[c].dataType) for c in keep] + RESULT.fields)
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, start = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()], 0, 0
            while start < len(texts):
                at, size = start, 0
                while at < len(texts) and (at == start or size + len(texts[at]) <= FLUSH):
                    size += len(texts[at])
                    at += 1
                got = measure(texts[start:at])
                own = [batch.column(i).slice(start, at - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, arrow, strict=False)), *(pa.array(got[f.name], f.type) for f in list(arrow)[len(keep) :])], schema=arrow)
                start = at

    return df.select(*keep, df[text].alias("_text")).mapInArrow(each, schema)
