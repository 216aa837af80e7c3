"""Packing documents into fixed-length token sequences, first fit decreasing.

Documents are tokenised once. Each is cut into full pieces, which fill a
sequence by themselves, and one remainder. Pieces are dealt by a hash into
groups of about one size; each group packs its pieces by itself, longest
first, each into the leftmost bin with room. A tournament tree over the bins'
free room finds that bin in logarithmic time.

Defined results
  * null or empty text: the document is its end token alone;
  * repeated rows: each row is packed as a document of its own, with the same doc_id;
  * null doc_id: packed like any other; an empty table gives an empty result;
  * ties: pieces of one length are taken in order of doc_id, start and checksum; equal ones can't be told apart;
  * very long texts are tokenised whole, one at a time, and only their pieces' lengths and checksums travel;
  * extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END = 1
#: Documents to a group: large enough that the last, half-empty bins hardly count, small enough for one task.
GROUP = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids for the vocabulary at ``path``.

    A ``.json`` whose ranks also lie beside it as ``.tiktoken`` is read from
    those: same ids, about four times as fast. A text that the fast reader
    refuses, or that holds the name of a special token (which has an id of its own), goes to the other one.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    try:
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, OSError):
        return plain

    def quick(text: str) -> list[int]:
        if any(name in text for name in special):
            return plain(text)
        try:
            return fast.encode_ordinary(text)
        except Exception:  # noqa: BLE001  the regular expression's limits on some very long texts
            return plain(text)

    return quick


def pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenise each document, add its end token, and cut it at multiples of ``capacity`` (see ``PIECES``)."""
    names = [x.split(" ")[0] for x in PIECES.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in it:
            rows: list[tuple] = []
            for doc, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(value.as_py() or ""), end], "<u4")
                n = len(ids)
                rows += [(doc, s, min(capacity, n - s), zlib.crc32(ids[s : s + capacity].tobytes()), n) for s in range(0, n, capacity)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, PIECES)


class Bins:
    """Bins of one capacity under a tournament tree whose nodes hold the most room below them."""

    def __init__(self, most: int, capacity: int) -> None:
        self.size = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.size)
        self.capacity = capacity

    def put(self, length: int) -> tuple[int, int]:
        """Place ``length`` in the leftmost bin with room; that bin and the place inside."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < length:
                at += 1
        place = self.capacity - room[at]
        room[at] -= length
        found = at - self.size
        at //= 2
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            room[at] = left if left >= right else right
            at //= 2
        return found, place


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item; equal lengths are taken in their given order."""
    n = len(lengths)
    where, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        bins = Bins(n, capacity)
        for i in np.argsort(-lengths, kind="stable").tolist():
            where[i], place[i] = bins.put(int(lengths[i]))
    return where, place


def pack(parts: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece its sequence and its offset there (see ``PACKED``).

    Equal pieces are counted and numbered, so that those of repeated rows are dealt over the groups like any others.
    """

    def group(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "doc_tokens", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        where, place = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(keys[0]) << 32) + where, offset=place)[[x.split(" ")[0] for x in PACKED.split(", ")]].convert_dtypes()

    names = [x.split(" ")[0] for x in PIECES.split(", ")]
    each = parts.groupBy(*names).agg(F.count("*").alias("_n")).select(*names, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    dealt = each.select(*names, F.pmod(F.xxhash64(F.lit("pack"), *names, "_copy"), F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInPandas(group, PACKED)


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, per_group: int = GROUP) -> DataFrame:
    """Whole documents to packed pieces."""
    groups = max(1, math.ceil(df.count() / per_group))
    return pack(pieces(df, tokenizer, key, text, capacity), groups, capacity)
