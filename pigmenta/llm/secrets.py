"""Secret scans with a linear-chain conditional random field.

Tokens are runs of letters, digits and ``_ + / . -``. Each gets a label: O
outside, B begin or I inside a secret. Features of a token are its shape
(length, kinds of characters, share of digits, changes between letters and
digits), whether it or a neighbour names a credential, the separator before it,
the shape of its neighbours and their hashed words, and features of the whole text. The best labelling
is found exactly, by Viterbi over chunks of the token stream whose scores from
each possible entering label are combined afterwards, so a text may be of any length.

The field is fitted here, by gradient ascent on the conditional likelihood, on
windows around the spans of three base patterns and on windows without any, from
a bounded sample (about ``SAMPLE_DOCS`` documents chosen by a hash of their id,
``SAMPLE_WINDOWS`` windows). Each window with a span is learned twice, once with all that names a credential masked,
so that the field learns what secrets look like and finds those that no base pattern names. The spans found in every text are the base
patterns' own, plus those of the field that overlap none of these.

Defined results
  * null or empty text: no spans;
  * positions are code points, end exclusive; texts are treated whole;
  * with no sample or no base span in it (an empty table, say), the field adds nothing;
  * ties between labellings go to the lower label, O before B before I; spans of one start are listed by kind;
  * very long texts: the base patterns run in little memory; the field takes about 300 bytes a token of the longest text, as it is tagged in one piece;
  * repeated rows: each row by itself; extra columns are ignored; null doc_id passes through.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.common import checkpointed, run_prints

KINDS = ("assign", "access", "hex", "crf")
SAMPLE_DOCS = 6000
SAMPLE_WINDOWS = 2000
#: Tokens on each side of a span in a training window.
REACH = 16
#: Code points that are featurised at once.
FLUSH = 1_500_000
CHUNK = 128
#: Invented secrets for each one of the sample, and code points that are kept on each side of one.
INVENTED = 4
AROUND = 1000

#: Base patterns: name, pattern, the group whose length counts, least length.
_ASSIGN = re.compile(r"""(?ia:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer fails the length test anyway
_KEY = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "pwd", "auth", "bearer", "credential", "credentials", "access_key")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[tuple[Span, int]]:
    """((start, end, kind), start of the secret part) of each base span, by start and kind."""
    out = [((m.start(), m.end(), 0), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [((m.start(), m.end(), 1), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [((m.start(), m.end(), 2), m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0][0], x[0][2]))


# Character kinds: 0 separator, 1 lower, 2 upper, 3 digit, 4 symbol, 5 other letter (outside ASCII).
_KIND = np.zeros(129, np.uint8)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), ("_+/.-", 4)):
    for _c in _chars:
        _KIND[ord(_c)] = _k
_KIND[128] = 5
_HEXCHAR = np.zeros(129, bool)
_HEXCHAR[[ord(c) for c in "0123456789abcdefABCDEF"]] = True


def _spelling(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Print of each whole token, ASCII letters in lower case."""
    low = chars.astype(np.uint32)
    low[(low >= 65) & (low <= 90)] += 32
    return run_prints(low, starts, lengths)


def _print_of(word: str) -> int:
    return int(_spelling(np.array([ord(c) for c in word]), np.array([0]), np.array([len(word)]))[0])


_KEY_PRINTS = np.array(sorted(map(_print_of, _KEY)), np.uint64)

# Feature groups and how many values each has; a token has one value of each group.
WORDS = 1024
GROUPS = {"lower": 2, "upper": 2, "digit": 2, "symbol": 2, "atleast8": 2, "atleast12": 2, "atleast16": 2, "atleast20": 2, "word_before": WORDS, "word_before2": WORDS, "word_after": WORDS, "length": 12, "kinds": 32, "digits": 8, "turns": 6, "hex": 24, "self": 2, "before": 2, "before2": 2, "gap": 2, "named": 4, "shape_before": 32, "shape_after": 32, "length_after": 12, "file_size": 16, "file_key": 2, "file_digits": 4}
_OFFSETS = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])[:-1].tolist(), strict=True))
WIDTH = sum(GROUPS.values())


def featurise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of some texts: feature ids (tokens x groups), text number, start, end (code points), and each text's first token."""
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    origin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    code = np.minimum(chars, 128)
    kind = _KIND[code]
    kind[(chars == 160) | ((chars >= 8192) & (chars <= 8303)) | (chars == 12288)] = 0
    inside = kind > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros((0, len(GROUPS)), np.int32), np.zeros(0, np.int64), start, end, np.zeros(len(texts), np.int64)
    length = end - start

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return total[end] - total[start]

    def apart(mask: np.ndarray) -> np.ndarray:
        """Whether the gap before each token has such a character."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return total[start] - total[np.concatenate(([0], end[:-1]))] > 0

    n = {k: count(kind == k) for k in range(1, 6)}
    letters = n[1] + n[2] + n[5]
    digit = kind == 3
    turn = np.zeros(len(kind), bool)
    turn[1:] = (digit[1:] != digit[:-1]) & inside[1:] & inside[:-1]
    turns = count(turn)
    kinds = sum((n[k] > 0).astype(np.int64) << (k - 1) for k in range(1, 6))
    long = np.searchsorted([2, 4, 6, 8, 12, 16, 20, 24, 32, 48, 64], length, "right")
    is_hex = (count(_HEXCHAR[code]) == length) & (n[3] > 0)
    spelled = _spelling(chars, start, length)
    key = np.isin(spelled, _KEY_PRINTS) & (length <= 16) & (letters > 0)
    # Hash 0 is for what isn't a plain word.
    word = np.where((n[3] == 0) & (n[4] == 0), 1 + ((spelled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(WORDS - 1), 0).astype(np.int64)
    text_no = np.searchsorted(origin, start, "right") - 1
    first = np.searchsorted(text_no, np.arange(len(texts)))
    new = np.ones(len(start), bool)
    new[1:] = text_no[1:] != text_no[:-1]
    last = np.append(new[1:], True)

    def before(x: np.ndarray, none: int = 0) -> np.ndarray:
        y = np.empty_like(x)
        y[0], y[1:] = none, x[:-1]
        y[new] = none
        return y

    def after(x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        y[:-1] = x[1:]
        y[last] = 0
        return y

    keyed = key.astype(np.int64)
    kb = before(keyed)
    gap = apart((chars == 61) | (chars == 58)).astype(np.int64)
    gap[new] = 0
    total = np.bincount(text_no, minlength=len(texts))
    some = np.maximum(total, 1)
    with_digit = np.bincount(text_no, n[3] > 0, minlength=len(texts)) / some
    has_key = (np.bincount(text_no, keyed, minlength=len(texts)) > 0).astype(np.int64)
    has_kind = {name: (n[k] > 0).astype(np.int64) for k, name in ((1, "lower"), (2, "upper"), (3, "digit"), (4, "symbol"))}
    values = has_kind | {f"atleast{m}": (length >= m).astype(np.int64) for m in (8, 12, 16, 20)} | {
        "word_before": before(word), "word_before2": before(before(word)), "word_after": after(word), "length": long, "kinds": kinds, "digits": np.minimum(n[3] * 8 // np.maximum(length, 1), 7), "turns": np.minimum(turns, 5), "hex": long + 12 * is_hex, "self": keyed,
        "before": kb, "before2": before(kb), "gap": gap, "named": kb * 2 + gap, "shape_before": before(kinds), "shape_after": after(kinds), "length_after": after(long),
        "file_size": np.minimum(np.log2(some).astype(np.int64), 15)[text_no], "file_key": has_key[text_no], "file_digits": np.minimum((with_digit * 16).astype(np.int64), 3)[text_no],
    }
    ids = np.stack([values[g] + _OFFSETS[g] for g in GROUPS], axis=1).astype(np.int32)
    return ids, text_no, start - origin[text_no], end - origin[text_no], first


def masked(ids: np.ndarray) -> np.ndarray:
    """The same tokens as if no word near them named a credential, and with the words around them unknown."""
    out = ids.copy()
    place = {g: k for k, g in enumerate(GROUPS)}
    for g in ("self", "before", "before2", "file_key", "word_before", "word_before2", "word_after"):
        out[..., place[g]] = _OFFSETS[g]
    at = place["named"]
    out[..., at] = _OFFSETS["named"] + (ids[..., at] - _OFFSETS["named"]) % 2  # the separator stays
    return out


def fit(ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 60, rate: float = 0.25, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features x 3) and transitions (from x to) that maximise the conditional likelihood.

    ``ids`` is sequences x steps x groups, ``labels`` sequences x steps; steps at ``lengths`` and beyond are padding.
    """
    n, steps, _ = ids.shape
    live = np.arange(steps)[None, :] < lengths[:, None]
    weights, moves = np.zeros((WIDTH, 3)), np.zeros((3, 3))
    memory = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, moves)]
    gold = np.eye(3)[labels] * live[:, :, None]
    both = live[:, 1:] & live[:, :-1]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1] * both[:, :, None], gold[:, 1:])
    columns = [np.ascontiguousarray(ids[:, :, g]) for g in range(ids.shape[2])]
    for step in range(1, rounds + 1):
        emit = sum(weights[c] for c in columns) * live[:, :, None]
        alpha, beta = np.zeros((steps, n, 3)), np.zeros((steps, n, 3))
        alpha[0] = emit[:, 0]
        for t in range(1, steps):
            x = alpha[t - 1][:, :, None] + moves[None]
            m = x.max(1)
            alpha[t] = np.where(live[:, t, None], m + np.log(np.exp(x - m[:, None]).sum(1)) + emit[:, t], alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            x = moves[None] + (beta[t + 1] + emit[:, t + 1])[:, None, :]
            m = x.max(2)
            beta[t] = np.where(live[:, t + 1, None], m + np.log(np.exp(x - m[:, :, None]).sum(2)), beta[t + 1])
        top = alpha[-1].max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(alpha[-1] - top).sum(1))
        share = np.exp((alpha + beta).transpose(1, 0, 2) - total[:, None, None]) * live[:, :, None]
        seen = np.zeros((3, 3))
        for t in range(1, steps):
            x = alpha[t - 1][:, :, None] + moves[None] + (emit[:, t] + beta[t])[:, None, :] - total[:, None, None]
            seen += (np.exp(np.minimum(x, 0)) * both[:, t - 1, None, None]).sum(0)
        gaps = np.moveaxis(gold - share, 2, 0).reshape(3, -1)
        slope = np.stack([sum(np.bincount(c.reshape(-1), gap, WIDTH) for c in columns) for gap in gaps], 1)
        for x, g, (a, b) in zip((weights, moves), (slope, gold_moves - seen), memory, strict=True):
            g = g / n - decay * x
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return weights, moves


def viterbi(emit: np.ndarray, moves: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Best labels of a stream of sequences; ``new`` marks where one begins (there the label before has no say)."""
    n = len(emit)
    if not n:
        return np.zeros(0, np.int64)
    chunks = -(-n // CHUNK)
    filled = np.zeros((chunks * CHUNK, 3))
    filled[:n] = emit
    begins = np.ones(chunks * CHUNK, bool)
    begins[:n] = new
    filled, begins = filled.reshape(chunks, CHUNK, 3), begins.reshape(chunks, CHUNK)
    score = np.full((chunks, 3, 3), -1e30)  # from the label before the chunk to the label now
    score[:, [0, 1, 2], [0, 1, 2]] = 0
    back = np.zeros((CHUNK, chunks, 3, 3), np.uint8)
    for t in range(CHUNK):
        step = np.where(begins[:, t, None, None], 0.0, moves[None])
        x = score[:, :, :, None] + step[:, None]
        back[t] = x.argmax(2)
        score = x.max(2) + filled[:, t, None, :]
    entry, at = np.zeros((chunks, 3)), np.zeros(3)
    for c in range(chunks):
        entry[c] = at
        at = (at[:, None] + score[c]).max(0)
        at -= at.max()
    came, left = np.zeros(chunks, np.int64), np.zeros(chunks, np.int64)
    state = int(at.argmax())
    for c in range(chunks - 1, -1, -1):
        left[c] = state
        state = came[c] = int((entry[c] + score[c][:, state]).argmax())
    out, state, row = np.zeros((chunks, CHUNK), np.int64), left, np.arange(chunks)
    for t in range(CHUNK - 1, -1, -1):
        out[:, t] = state
        state = back[t, row, came, state].astype(np.int64)
    return out.reshape(-1)[:n]


def _labels(texts: list[str], text_no: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 on the first and 2 on the other tokens of each base span's secret part."""
    out = np.zeros(len(start), np.int64)
    bounds = np.append(first, len(start))
    for i, t in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        for (_, stop, _), secret in base_spans(t):
            x, y = a + np.searchsorted(end[a:b], secret, "right"), a + np.searchsorted(start[a:b], stop)
            if x < y and not out[x:y].any():
                out[x], out[x + 1 : y] = 1, 2
    return out


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def _invented(text: str, secret: int, stop: int, seed: int) -> tuple[str, int, int]:
    """The surroundings of a secret with random characters in its place, and where these stand."""
    rng = random.Random(seed)
    own = "".join(rng.choices(rng.choice(_ALPHABETS), k=rng.randrange(16, 49)))
    before = text[max(0, secret - AROUND) : secret]
    return before + own + text[stop : stop + AROUND], len(before), len(before) + len(own)


def _windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows: feature ids and labels as bytes, whether one has a secret, and a hash to choose by.

    Each secret comes as it is and with invented ones in its place, as the sample's secrets are of few makes.
    """

    def window(ids: np.ndarray, labels: np.ndarray, at: int, has: bool, place: int) -> tuple:
        part = slice(max(0, at - REACH), max(0, at - REACH) + 2 * REACH)
        return ids[part].tobytes(), labels[part].astype(np.uint8).tobytes(), has, place % (1 << 40)

    for b in it:
        rows = []
        for value in b.column(0):
            text = value.as_py() or ""
            ids, text_no, start, end, first = featurise([text])
            if not len(ids):
                continue
            labels = _labels([text], text_no, start, end, first)
            middle = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).digest(), "little")
            rows += [window(ids, labels, int(x), True, middle + int(x) * 2654435761) for x in np.flatnonzero(labels == 1)]
            plain = middle % len(ids)
            if not labels[max(0, plain - REACH) : plain + REACH].any():
                rows.append(window(ids, labels, plain, False, middle))
            for (_, stop, _), secret, turn in ((*span, turn) for span in base_spans(text) for turn in range(INVENTED)):
                made, a, z = _invented(text, secret, stop, (middle + secret) * INVENTED + turn)
                ids2, no, start2, end2, first2 = featurise([made])
                labels2 = np.where(_labels([made], no, start2, end2, first2) > 0, 2, 0)
                inside = np.flatnonzero((end2 > a) & (start2 < z))
                labels2[inside] = 2
                labels2[inside[:1]] = 1
                if len(inside):
                    rows.append(window(ids2, labels2, int(inside[0]), True, middle + secret * 40503 + turn + 1))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.bool_(), pa.int64()), strict=True)], ["ids", "labels", "has", "place"])


Model = tuple[np.ndarray, np.ndarray] | None


def train(df: DataFrame, key: str = "doc_id", text: str = "text", docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> Model:
    """Fit the field on at most ``windows`` windows of at most ``docs`` documents; None if these hold no base span."""
    known = df.where(F.col(key).isNotNull())
    place = F.pmod(F.xxhash64(F.lit("secret"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    cut = checkpointed(known.where(place * known.count() < docs).select(text).mapInArrow(_windows, "ids binary, labels binary, has boolean, place long"))
    rows = [r for half in ("has", "not has") for r in cut.where(half).orderBy("place", "ids").limit(windows // 2).collect()]
    if not any(r["has"] for r in rows):
        return None
    steps, g = 2 * REACH, len(GROUPS)
    ids, labels, lengths = np.zeros((len(rows), steps, g), np.int32), np.zeros((len(rows), steps), np.int64), np.zeros(len(rows), np.int64)
    for i, r in enumerate(rows):
        y = np.frombuffer(r["labels"], np.uint8)
        lengths[i] = len(y)
        labels[i, : len(y)] = y
        ids[i, : len(y)] = np.frombuffer(r["ids"], np.int32).reshape(-1, g)
    has = np.array([r["has"] for r in rows])
    return fit(np.concatenate((ids, masked(ids[has]))), np.concatenate((labels, labels[has])), np.concatenate((lengths, lengths[has])))


def tag(texts: list[str], model: Model) -> list[list[Span]]:
    """Spans of the field in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    if model is None:
        return out
    ids, text_no, start, end, _ = featurise(texts)
    new = np.ones(len(start), bool)
    new[1:] = text_no[1:] != text_no[:-1]
    weights = model[0].astype(np.float32)
    emit = np.zeros((len(ids), 3), np.float32)
    for g in range(len(GROUPS)):
        emit += weights[ids[:, g]]
    labels = viterbi(emit, model[1], new)
    prior = np.concatenate(([0], labels[:-1]))
    prior[new] = 0
    begins = np.flatnonzero((labels == 1) | ((labels == 2) & (prior == 0)))
    stops = np.flatnonzero(np.append((labels[1:] != 2) | new[1:], True) & (labels > 0))
    for a, b in zip(begins.tolist(), stops.tolist(), strict=True):
        out[text_no[a]].append((int(start[a]), int(end[b]), 3))
    return out


FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All spans of each row's text, by start, then kind as in ``KINDS`` (see ``FOUND``)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(docs: list, texts: list[str]) -> pa.RecordBatch:
            spans = []
            for t, more in zip(texts, tag(texts, shared.value), strict=True):
                own = [s for s, _ in base_spans(t)]
                ends, reach = [a for a, _, _ in own], np.maximum.accumulate([b for _, b, _ in own] or [0]).tolist()
                more = [x for x in more if not (at := bisect.bisect_left(ends, x[1])) or reach[at - 1] <= x[0]]
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted([*own, *more], key=lambda s: (s[0], s[2], s[1]))])
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(spans, _FOUND_TYPE)], ["doc_id", "spans"])

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

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, FOUND)
