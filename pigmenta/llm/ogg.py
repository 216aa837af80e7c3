"""Ogg media columns: write, verify, demultiplex and time-stamp Ogg streams.

The container is handled at the byte level (RFC 3533): pages of up to 255
lacing values, packets reassembled across pages, one 32-bit checksum a page,
any number of logical streams interleaved in one physical stream, and a
granule position a page that turns into a time once the stream's rate is known.

``ogg_encode`` and ``ogg_decode`` are the general operators (a column of
payloads to a column of media and back); ``ogg_roundtrip`` does both inside one
Arrow pass so that the media never has to be shuffled or spilled.

Defined results
  * null payload: treated as empty, which is padded to one unit of 64 zero bytes;
  * damaged media: ``ok`` is false and ``error`` says which check failed first,
    the other columns are null; the job goes on;
  * null media in ``ogg_decode``: ``ok`` is false, error ``no media``;
  * repeated rows: each row is handled by itself; in ``ogg_encode`` and ``ogg_decode`` extra columns pass through
    untouched unless they carry the name of an output column, which then wins; ``ogg_roundtrip`` returns its own columns only;
  * an empty table gives an empty result; there are no ties;
  * very long payloads are treated whole, about five times their bytes at once; features are counted in blocks;
  * streams besides the two of this module are demultiplexed and counted, and don't change the payload; a lost page, pages out of order
    and a stream without end are damage.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

#: Choices of this module: two logical streams, samples and their digests.
SAMPLES, DIGESTS = 0x0A, 0x0B
SAMPLE_MAGIC, DIGEST_MAGIC = b"pcm8\x01", b"crc8\x01"
RATE = 8000
PACKET = 20_400  # a multiple of 255: exercises the terminating zero lacing value
PAD = 64

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A page or packet that breaks a rule of the container."""


def page_checksum(page: bytes) -> int:
    """The container's CRC-32 (polynomial 04C11DB7, most significant bit first, zero start).

    zlib computes the mirrored form; mirroring each byte on the way in and the
    word on the way out gives the container's form at zlib's speed.
    """
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


@dataclass
class _Writer:
    """Pages of one logical stream. Packets come with the granule position at their end."""

    serial: int
    number: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: bytearray = field(default_factory=bytearray)
    granule: int = -1
    open: bool = False  # the page being filled starts inside a packet

    def _flush(self, unfinished: bool, last: bool = False) -> bytes:
        flags = (CONTINUED if self.open else 0) | (FIRST if self.number == 0 else 0) | (LAST if last else 0)
        page = _page(flags, self.granule, self.serial, self.number, bytes(self.lacing), bytes(self.body))
        self.number += 1
        self.lacing, self.body, self.granule, self.open = bytearray(), bytearray(), -1, unfinished
        return page

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        values = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for i, v in enumerate(values):
            if len(self.lacing) == 255:
                yield self._flush(unfinished=i > 0)
            self.lacing.append(v)
            self.body += data[at : at + v]
            at += v
        self.granule = granule

    def flush(self, last: bool = False) -> Iterator[bytes]:
        if self.lacing or last:
            yield self._flush(unfinished=False, last=last)


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % PAD or (0 if payload else PAD))


def encode(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """Store ``payload`` as 8-bit samples beside a stream of digests, one for each packet of samples."""
    samples, digests, out = _Writer(SAMPLES), _Writer(DIGESTS), []
    out += samples.packet(SAMPLE_MAGIC + struct.pack("<IQ", rate, n_bytes), 0)
    out += samples.flush()
    out += digests.packet(DIGEST_MAGIC + struct.pack("<I", rate), 0)
    out += digests.flush()
    for at in range(0, len(payload), PACKET):
        part = payload[at : at + PACKET]
        out += samples.packet(part, at + len(part))
        out += digests.packet(struct.pack("<I", zlib.crc32(part)), at + len(part))
    out += samples.flush(last=True)
    out += digests.flush(last=True)
    return b"".join(out)


@dataclass
class Stream:
    """What was read of one logical stream."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: (granule position, packets that had ended by then), one for each page on which a packet ends.
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    closed: bool = False
    part: list[bytes] = field(default_factory=list)
    hanging: bool = False

    def seconds(self, rate: int) -> list[float]:
        """Time at the end of each page that ends a packet."""
        return [g / rate for g, _ in self.marks]


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Verify every page and take the logical streams apart."""
    streams: dict[int, Stream] = {}
    at, end = 0, len(media)
    while at < end:
        if end - at < HEADER.size:
            raise OggError("cut header")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if magic != CAPTURE or version != 0:
            raise OggError("no page where one should start")
        lacing = media[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        if len(lacing) < n or at + size > end:
            raise OggError("cut page")
        page = media[at : at + size]
        if page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise OggError("checksum")
        if flags & FIRST:
            if serial in streams:
                raise OggError("stream begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None:
            raise OggError("stream without beginning")
        if s.closed:
            raise OggError("page after the end of its stream")
        if number != s.pages:
            raise OggError("page missing")
        if bool(flags & CONTINUED) != s.hanging:
            raise OggError("continuation")
        body, ended = 27 + n, False
        for v in lacing:
            s.part.append(page[body : body + v])
            body += v
            s.hanging = v == 255
            if not s.hanging:
                s.packets.append(b"".join(s.part))
                s.part, ended = [], True
        if ended:
            if s.marks and granule < s.marks[-1][0]:
                raise OggError("granule position goes back")
            s.marks.append((granule, len(s.packets)))
        elif granule != -1:
            raise OggError("granule position without packet")
        s.pages += 1
        s.closed = bool(flags & LAST)
        at += size
    for s in streams.values():
        if s.hanging:
            raise OggError("cut packet")
        if not s.closed:
            raise OggError("stream without end")
    return streams


def histogram(wave: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """How often each of the 256 levels occurs, a block at a time as counting takes eight bytes a sample."""
    return sum((np.bincount(wave[i : i + block], minlength=256) for i in range(0, len(wave), block)), np.zeros(256, np.int64))


def decode(media: bytes) -> dict:
    """Payload, true length, and features of a stream that ``encode`` wrote."""
    streams = demultiplex(media)
    samples, digests = streams.get(SAMPLES), streams.get(DIGESTS)
    if samples is None or digests is None or not samples.packets[0].startswith(SAMPLE_MAGIC) or not digests.packets[0].startswith(DIGEST_MAGIC):
        raise OggError("unknown streams")
    rate, n_bytes = struct.unpack_from("<IQ", samples.packets[0], len(SAMPLE_MAGIC))
    parts = samples.packets[1:]
    if [struct.pack("<I", zlib.crc32(p)) for p in parts] != digests.packets[1:]:
        raise OggError("digest")
    payload = b"".join(parts)
    if samples.marks[-1][0] != len(payload) or n_bytes > len(payload):
        raise OggError("length")
    wave = np.frombuffer(payload, np.uint8)
    levels, height = histogram(wave), np.arange(256)
    times = samples.seconds(rate)
    feature = ";".join((
        f"streams={len(streams)}", f"pages={sum(s.pages for s in streams.values())}", f"packets={sum(len(s.packets) for s in streams.values())}",
        f"end={times[-1]:.6f}", f"sum={int(levels @ height)}", f"energy={int(levels @ height**2)}", f"turns={int(np.count_nonzero(wave[1:] != wave[:-1]))}", f"peak={int(wave.max(initial=0))}",
    ))
    return {"payload": payload, "n_bytes": n_bytes, "feature": feature, "times": times}


DECODED = T.StructType([
    T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("n_bytes", T.LongType()), T.StructField("feature", T.StringType()), T.StructField("page_seconds", T.ArrayType(T.DoubleType())),
])


def _fresh(df: DataFrame, names: list[str]) -> list[str]:
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def ogg_encode(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Add column ``media``: the Ogg form of ``payload`` (string or binary; null counts as empty)."""

    def make(v: bytes | None) -> bytes:
        raw = bytes(v or b"")
        return encode(pad(raw), len(raw))

    @F.arrow_udf(T.BinaryType())
    def column(values: pa.Array) -> pa.Array:
        return pa.array([make(v.as_py()) for v in values], pa.binary())

    return df.select(*_fresh(df, [media]), column(F.col(payload).cast("binary")).alias(media))


def ogg_decode(df: DataFrame, media: str = "media", out: str = "decoded") -> DataFrame:
    """Add struct ``out`` (see ``DECODED``) read back from column ``media``."""

    def read(v: bytes | None) -> dict:
        if v is None:
            return {"ok": False, "error": "no media"}
        try:
            x = decode(v)
        except (OggError, struct.error, IndexError) as e:
            return {"ok": False, "error": str(e)}
        return {"ok": True, "error": None, "payload": x["payload"], "n_bytes": x["n_bytes"], "feature": x["feature"], "page_seconds": x["times"]}

    arrow = pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("feature", pa.string()), ("page_seconds", pa.list_(pa.float64()))])

    @F.arrow_udf(DECODED)
    def column(values: pa.Array) -> pa.Array:
        return pa.array([read(v.as_py()) for v in values], arrow)

    return df.select(*_fresh(df, [out]), column(F.col(media)).alias(out))


ROUNDTRIP = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, ok boolean, error string"


def ogg_roundtrip(df: DataFrame, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """Store each payload as Ogg, read the stored bytes back, and return digests of both (see ``ROUNDTRIP``)."""

    def one(v: bytes | None) -> tuple:
        raw = bytes(v or b"")
        media = encode(pad(raw), len(raw))
        try:
            x = decode(media)
        except (OggError, struct.error, IndexError) as e:
            return len(raw), None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, False, str(e)
        back = x["payload"]
        return x["n_bytes"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), x["feature"], True, None

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    names = [x.split(" ")[0] for x in ROUNDTRIP.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [one(v.as_py()) for v in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(payload).cast("binary").alias("payload")).mapInArrow(batches, ROUNDTRIP)
