"""Photos as rows (photo_id, width, height, space, rgb, error) from PPM, or from what Spark's image source decodes (PNG, JPEG, GIF, BMP)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.sources.ppm import decode_ppm
from pigmenta.sources.tags import managed, read_tags, turned

LONG_EDGE = 1600
PHOTO = "photo_id string, width int, height int, space string, rgb binary, error string"
_KINDS = pa.schema([("photo_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("space", pa.string()), ("rgb", pa.binary()), ("error", pa.string())])


def _shares(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``n`` cells laid over ``m`` wider ones (m <= n): the first it lies on, and its length on that and on the next, in units of 1 / m of a cell."""
    at = np.arange(n, dtype=np.int64)
    first = at * m // n
    own = np.minimum((first + 1) * n, (at + 1) * m) - at * m
    return first, own, m - own


class Scaler:
    """Scales a photo by area to a long edge of at most ``most`` while its rows come in, in whole numbers; smaller photos stay as they are.

    It holds the rows handed in and the small photo, never the whole one.
    """

    def __init__(self, width: int, height: int, most: int):
        self.size = (width, height)
        k = max(width, height)
        self.width, self.height = (width, height) if k <= most else (max(1, round(width * most / k)), max(1, round(height * most / k)))
        self.rows, self.next = np.zeros((self.height + 1, self.width, 3), np.int64), 0
        self.across, self.down = _shares(width, self.width), _shares(height, self.height)

    def feed(self, rows: np.ndarray) -> None:
        """The next rows: count x width x 3 values of 8 bits."""
        first, own, rest = self.across
        start = np.searchsorted(first, np.arange(self.width))
        values = rows.astype(np.int64)
        narrow = np.add.reduceat(values * own[None, :, None], start, 1)
        narrow[:, 1:] += np.add.reduceat(values * rest[None, :, None], start, 1)[:, :-1]
        first, own, rest = self.down
        for row in narrow:
            at = first[self.next]
            self.rows[at] += own[self.next] * row
            self.rows[at + 1] += rest[self.next] * row
            self.next += 1

    def result(self) -> np.ndarray:
        area = self.size[0] * self.size[1]
        return ((2 * self.rows[:-1] + area) // (2 * area)).astype(np.uint8)


#: Rows of a photo that are read or scaled at once.
BAND = 64


def shrink(rgb: np.ndarray, most: int) -> np.ndarray:
    """Scaled by area to a long edge of at most ``most``; smaller photos stay as they are."""
    h, w = rgb.shape[:2]
    if max(h, w) <= most:
        return rgb
    scaler = Scaler(w, h, most)
    for y in range(0, h, BAND):
        scaler.feed(rgb[y : y + BAND])
    return scaler.result()


def _row(name: str, rgb: np.ndarray | None, space: str, most: int, error: str | None = None) -> pa.RecordBatch:
    small = None if rgb is None else shrink(rgb, most)
    size = (None, None) if small is None else (small.shape[1], small.shape[0])
    return pa.RecordBatch.from_pylist([{"photo_id": name, "width": size[0], "height": size[1], "space": space, "rgb": None if small is None else small.tobytes(), "error": error}], schema=_KINDS)


def read_ppm_photos(spark: SparkSession, path: str, space: str = "sRGB", most: int = LONG_EDGE) -> DataFrame:
    """A row for each PPM file; one that can't be read has only ``error``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rgb = decode_ppm(content.as_py())[2]
                except ValueError as e:
                    yield _row(name, None, space, most, str(e))
                else:
                    yield _row(name, rgb, space, most)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, PHOTO)


def _tags(spark: SparkSession, path: str) -> DataFrame:
    """(origin, turn, profile, jpeg) of each file; a few hundred bytes a photo."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                turn, profile = read_tags(data)
                yield pa.RecordBatch.from_pydict({"origin": pa.array([name]), "turn": pa.array([turn], pa.int32()), "profile": pa.array([profile], pa.binary()), "jpeg": pa.array([data[:2] == b"\xff\xd8"])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, "origin string, turn int, profile binary, jpeg boolean")


def _same_name(origin: str) -> Column:
    """Both readers name local files, one with fewer slashes."""
    return F.regexp_replace(origin, "^file:/+", "file:///")


def read_photos(spark: SparkSession, path: str, space: str = "sRGB", most: int = LONG_EDGE) -> DataFrame:
    """A row for each image file, turned as its orientation tag says; one that can't be decoded has only ``error``.

    A PNG file's colour profile gives its space (see ``tags.managed``), ``space`` holds for files without one. JPEG decoding has already brought
    values under a profile to sRGB, within its gamut.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                if r["mode"] < 0:
                    yield _row(r["origin"], None, space, most, "not decoded")
                    continue
                px = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rgb = np.repeat(px, 3, 2) if r["nChannels"] == 1 else px[..., 2::-1]
                rgb = turned(shrink(rgb, most), r["turn"] or 1)
                rgb, own = (rgb, "sRGB" if r["profile"] else space) if r["jpeg"] else managed(rgb, r["profile"], space)
                yield _row(r["origin"], rgb, own, most)

    images = spark.read.format("image").load(path).select("image.*").withColumn("name", _same_name("origin"))
    tags = _tags(spark, path).withColumn("name", _same_name("origin")).drop("origin")
    return images.join(tags, "name", "left").drop("name").mapInArrow(each, PHOTO)
