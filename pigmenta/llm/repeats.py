"""Substring dedup: remove word windows that already occurred earlier in the corpus.

A window is ``window`` consecutive words of one document. A word goes if some
window over it has the same words as a window that starts earlier (smaller
doc_id, or the same document further left).

Hashing every window would shuffle a row a word. A difference cover D modulo v
holds, for any two positions i and j, an offset d < v with i+d and j+d both in
D. So two equal windows share an anchor, a run of window-v+1 words that starts
at cover positions of both documents, and only |D|/v of all positions are
hashed: 4/13 here. Anchors that occur once can't be part of a repeat. Around
the others the match is extended: the windows over them are hashed in full
(128 bits), and of each group of equal windows all but the earliest are marked.

How it is dealt out: hashes travel in packed blocks, one for each bucket and
batch. Before anything is sent, each batch keeps one row of its equal hashes
and settles the rest by itself, so that a passage that is in a third of all
documents sends one row a batch and not one a document. Extended windows are
dealt by the smallest hash inside them, which neighbours share, so that
answers come back as runs. The text is shuffled once, by document, and that
exchange serves both joins.

Defined results
  * null or empty text: no words, nothing removed, kept text empty;
  * null doc_id: each text without id is a document, before all others, in order of its hash (so that they don't meet in one task);
  * rows with one doc_id: one document's repeated rows; windows at the same
    place are no repeat of each other, and each row is judged by its own text;
  * ties: equal windows that start together (repeated rows) are all kept;
  * very long texts are treated whole; extra columns are ignored;
  * an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.common import hash_words, window_hashes

WINDOW = 20
#: Perfect difference sets by their period.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
PERIOD = 13
#: Entries that a worker gathers before it settles and sends them.
FLUSH = 400_000
#: Least number of hash buckets; a worker holds one bucket at a time.
BUCKETS = 128
#: Bytes of text for which there is one bucket more (their entries take about as much).
BUCKET_BYTES = 64 << 20

BLOCK = "bucket int, block binary"


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes, each transposed into byte planes so that their common high bytes compress."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(n, c.itemsize).T).tobytes() for c in columns]
    return n.to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(block: bytes, *kinds: str) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(block[:4], "little"), zstandard.ZstdDecompressor().decompress(block[4:]), 0, []
    for kind in map(np.dtype, kinds):
        part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Mask of the first row of each group in sorted ``keys``."""
    first = np.ones(len(keys[0]), bool)
    if len(first) > 1:
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(_starts(bucket))  # the callers have at least one entry
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        yield int(bucket[a]), packed(*(c[order[a:b]] for c in columns))


def _block_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block"])


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return ((doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


# An anchor entry: hash, document, position, and what is known: 0 nothing, 1 its hash is shared inside its batch,
# 2 (passed through in the document's bucket) it is shared and its hash is looked after by another entry.
ANCHOR = ("<u8", "<i8", "<u4", "u1")


def _anchor_blocks(cover: tuple[int, ...], period: int, window: int, buckets: int):
    length = window - period + 1
    member = np.zeros(period, bool)
    member[list(cover)] = True

    def settle(h: list, d: list, p: list) -> pa.RecordBatch:
        hashes, docs, places = np.concatenate(h), np.concatenate(d), np.concatenate(p)
        order = np.argsort(hashes, kind="stable")
        hashes, docs, places = hashes[order], docs[order], places[order]
        first = _starts(hashes)
        size = np.diff(np.append(np.flatnonzero(first), len(first)))
        known = np.full(len(first), 2, np.uint8)
        known[first] = size > 1
        bucket = np.where(first, (hashes % np.uint64(buckets)).astype(np.int64), _doc_bucket(docs, buckets))
        hashes = np.where(first, hashes, 0)  # what is passed through needs none
        order = np.lexsort((places, docs))  # neighbours side by side: all but the hashes compresses away
        return _block_batch(list(_by_bucket(bucket[order], hashes[order], docs[order], places[order], known[order])))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, d, p, n = [], [], [], 0
        for b in it:
            for doc, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (value.as_py() or b"").split()
                if len(words) < window:
                    continue
                at = np.arange(len(words) - length + 1)
                at = at[member[at % period]]
                h.append(window_hashes(hash_words(words), length)[at])
                d.append(np.full(len(at), doc, np.int64))
                p.append(at.astype(np.uint32))
                n += len(at)
                if n >= FLUSH:
                    yield settle(h, d, p)
                    h, d, p, n = [], [], [], 0
        if n:
            yield settle(h, d, p)

    return batches


def _buckets_of(it: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[list[np.ndarray]]:
    """All entries of each bucket; the partition is sorted by bucket."""
    now, held = None, []
    for b in it:
        for bucket, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket != now and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            now = bucket
            held.append(unpacked(block.as_py(), *kinds))
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _runs(doc: np.ndarray, data: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    """(document, bytes) of each run of equal ``doc``; ``data`` has ``width`` bytes a row."""
    if not len(doc):
        return
    edges = np.flatnonzero(_starts(doc))
    raw = data.tobytes()
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(doc)], strict=True):
        yield int(doc[a]), raw[a * width : b * width]


def _doc_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["k", "found"])


def _shared_anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hashes, docs, places, known in _buckets_of(it, *ANCHOR):
        pick = known == 2
        d, p = docs[pick], places[pick]
        rest = np.flatnonzero(~pick)
        rest = rest[np.argsort(hashes[rest], kind="stable")]
        if len(rest):
            first = _starts(hashes[rest])
            group = np.cumsum(first) - 1
            size = np.bincount(group)
            shared = (size > 1) | (np.bincount(group, known[rest]) > 0)
            rest = rest[shared[group]]
            d, p = np.concatenate((d, docs[rest])), np.concatenate((p, places[rest]))
        order = np.argsort(d, kind="stable")
        rows = list(_runs(d[order], p[order], 4))
        for at in range(0, len(rows), 50_000):
            yield _doc_rows(rows[at : at + 50_000])


# A window entry: two hashes, document, print of its text, start, and 1 if it is known to be a repeat (then dealt by document).
WINDOWS = ("<u8", "<u8", "<i8", "<i8", "<u4", "u1")
#: A run of repeated windows: print of the text, first start, number of starts.
RUN = np.dtype([("fp", "<i8"), ("start", "<u4"), ("n", "<u4")])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    out, done, power, size, n = None, 0, h, 1, len(h) - width + 1
    while size <= width:
        if width & size:
            part = power[done : done + n]
            out = part if out is None else np.minimum(out, part)
            done += size
        if size * 2 <= width:
            power = np.minimum(power[: len(power) - size], power[size:])
        size *= 2
    return out


def _later(h: np.ndarray, g: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, document and start; in that order, whether an earlier window has the same words."""
    order = np.lexsort((start, doc, g, h))
    h, g, doc, start = h[order], g[order], doc[order], start[order]
    first = _starts(h, g)
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, (doc != doc[head]) | (start != start[head])


def _window_blocks(period: int, window: int, buckets: int):
    length = window - period + 1

    def settle(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        h, g, doc, fp, start, deal = (np.concatenate(c) for c in zip(*parts, strict=True))
        order, repeat = _later(h, g, doc, start)
        h, g, doc, fp, start, deal = (c[order] for c in (h, g, doc, fp, start, deal))
        bucket = np.where(repeat, _doc_bucket(doc, buckets), (deal % np.uint64(buckets)).astype(np.int64))
        h, g = np.where(repeat, 0, h), np.where(repeat, 0, g)
        order = np.lexsort((start, fp, doc))
        return _block_batch(list(_by_bucket(*(c[order] for c in (bucket, h, g, doc, fp, start, repeat.astype(np.uint8))))))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in it:
            for doc, fp, value, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if not found.is_valid:
                    continue
                words = (value.as_py() or b"").split()
                count = len(words) - window + 1
                if count <= 0:
                    continue
                at = np.frombuffer(b"".join(found.as_py()), "<u4").astype(np.int64)
                near = np.zeros(len(words) + 1, np.int64)
                np.add.at(near, np.maximum(at - period + 1, 0), 1)
                np.add.at(near, np.minimum(at + 1, len(words)), -1)
                starts = np.flatnonzero(np.cumsum(near)[:count] > 0)
                if not len(starts):
                    continue
                w = hash_words(words)
                short = window_hashes(w, length)
                full, other = window_hashes(w, window), window_hashes(w ^ np.uint64(0xA5A5A5A5A5A5A5A5), window, 23)
                parts.append([full[starts], other[starts], np.full(len(starts), doc, np.int64), np.full(len(starts), fp, np.int64), starts.astype(np.uint32), _least(short, period)[starts]])
                n += len(starts)
                if n >= FLUSH:
                    yield settle(parts)
                    parts, n = [], 0
        if n:
            yield settle(parts)

    return batches


def _repeated_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, g, doc, fp, start, known in _buckets_of(it, *WINDOWS):
        pick, rest = np.flatnonzero(known == 1), np.flatnonzero(known == 0)
        if len(rest):
            order, repeat = _later(h[rest], g[rest], doc[rest], start[rest])
            pick = np.concatenate((pick, rest[order[repeat]]))
        if not len(pick):
            continue
        pick = pick[np.lexsort((start[pick], fp[pick], doc[pick]))]
        d, f, s = doc[pick], fp[pick], start[pick].astype(np.int64)
        new = np.ones(len(pick), bool)
        new[1:] = (d[1:] != d[:-1]) | (f[1:] != f[:-1]) | (s[1:] > s[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(pick)) - 1
        runs = np.zeros(len(heads), RUN)
        runs["fp"], runs["start"], runs["n"] = f[heads], s[heads], s[tails] - s[heads] + 1
        rows = list(_runs(d[heads], runs, RUN.itemsize))
        for at in range(0, len(rows), 50_000):
            yield _doc_rows(rows[at : at + 50_000])


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(window: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            total, gone, kept = [], [], []
            for fp, value, found in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                words = (value.as_py() or b"").split()
                n = len(words)
                if found.is_valid:
                    runs = np.frombuffer(b"".join(found.as_py()), RUN)
                    runs = runs[runs["fp"] == fp]
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, runs["start"].astype(np.int64), 1)
                    np.add.at(cover, runs["start"].astype(np.int64) + runs["n"] + window - 1, -1)
                    stay = np.flatnonzero(np.cumsum(cover)[:n] == 0)
                    words = [words[i] for i in stay.tolist()]
                total.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words))
            out = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(4), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), out], ["doc_id", "n_words", "n_removed", "kept"])

    return batches


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Per row of ``df``: words, removed words, and what is left, joined by single spaces (see ``KEPT``)."""
    cover = COVERS[period]
    if not is_cover(cover, period) or window <= period:
        raise ValueError("the period needs a difference cover and must be under the window")
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    doc = F.col(key).cast("long")
    no_id = F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64(text), 2)
    docs = df.select(F.coalesce(doc, no_id).alias("k"), F.xxhash64(text).alias("fp"), F.col(text).cast("binary").alias("t"), doc.alias("doc_id"))

    def answers(blocks: DataFrame, answer) -> DataFrame:
        found = blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "k long, found binary")
        return found.groupBy("k").agg(F.collect_list("found").alias("found"))

    anchors = docs.select("k", "t").mapInArrow(_anchor_blocks(cover, period, window, buckets), BLOCK)
    near = docs.join(answers(anchors, _shared_anchors).hint("merge"), "k", "left").select("k", "fp", "t", "found", "doc_id")  # the same columns as below: one exchange of the text
    windows = near.mapInArrow(_window_blocks(period, window, buckets), BLOCK)
    marked = docs.join(answers(windows, _repeated_runs).hint("merge"), "k", "left").select("k", "fp", "t", "found", "doc_id")
    return marked.mapInArrow(_remove(window), KEPT)
