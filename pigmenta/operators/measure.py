"""A photo's white and the colour under a tap; one photo (or one tap of it) at a time, no shuffle of pixels.

A photo is a row (photo_id, width, height, space, rgb): rgb holds height x width x 3 channels, space is ``sRGB`` or
``displayP3``. Rows flow through ``mapInArrow`` in batches whose bytes Spark bounds. A photo of which only some lines
are known may name them in a column ``lines`` (null: all); rgb then holds these alone, and whites and taps are measured on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pigmenta.functions.color import D65, TO_XYZ, adaptation
from pigmenta.functions.kernels import LIGHT, neutral_chroma, rgb_xyz, xyz_lab

# Clipped channel, chroma of a neutral, Lab radius of one object, least brightness of a camera's white.
CLIPPED = 250
NEUTRAL = 30.0
SAME_OBJECT = 30.0
CAMERA_FLOOR = 0.75


class White(NamedTuple):
    xyz: np.ndarray
    clipped: bool
    found: bool


def pixels(row: dict[str, Any]) -> np.ndarray:
    """Channels of a photo row as height x width x 3; a row whose sizes disagree is an error."""
    w, h, data = row["width"], row["height"], row["rgb"]
    if w is None or h is None or data is None or len(data) != w * h * 3:
        raise ValueError("size and content of a photo disagree")
    return np.frombuffer(data, np.uint8).reshape(h, w, 3)


def known_pixels(row: dict[str, Any]) -> tuple[np.ndarray, np.ndarray | None]:
    """Channels of a photo row, and which of its lines are known (None: all); unknown ones are black."""
    lines = row.get("lines")
    if lines is None:
        return pixels(row), None
    if row["height"] is None or lines != sorted({y for y in lines if 0 <= y < row["height"]}):
        raise ValueError("lines and height of a photo disagree")
    some = pixels(row | {"height": len(lines)})
    rgb, known = np.zeros((row["height"], *some.shape[1:]), np.uint8), np.zeros(row["height"], bool)
    rgb[lines], known[lines] = some, True
    return rgb, known


def _sent(photos: DataFrame) -> list[str]:
    """The columns of photo rows from which whites and taps are measured."""
    return ["photo_id", "width", "height", "space", "rgb", *(c for c in ("lines",) if c in photos.columns)]


def _white_of(rgb: np.ndarray, space: str) -> White:
    return White(np.median(rgb_xyz(rgb, space), 0), bool(np.median(rgb, 0).max() >= CLIPPED), True)


def auto_white(rgb: np.ndarray, space: str, known: np.ndarray | None = None) -> White:
    """Brightest sizeable neutral surface, on every fourth pixel each way; else the camera's own white, not ``found``.

    The same holds if no candidate lies in the band below the top, which takes very few, widely spread ones. Only ``known`` lines count.
    """
    some = (rgb[::4, ::4] if known is None else rgb[::4, ::4][known[::4]]).reshape(-1, 3)
    if not len(some):
        raise ValueError("a photo has no pixel for its white")
    xyz = rgb_xyz(some, space)
    bright = np.percentile(xyz[:, 1], 98)
    fit = (neutral_chroma(xyz) < NEUTRAL) & (xyz[:, 1] >= 0.5 * bright)
    if fit.sum() >= 0.03 * len(fit):
        top = np.percentile(xyz[fit, 1], 98)
        band = fit & (xyz[:, 1] >= 0.8 * top) & (xyz[:, 1] <= top)
        if band.any():
            return _white_of(some[band], space)
    return White(D65 * min(max(bright, CAMERA_FLOOR), 1.0), False, False)


def borrowed_white(rgb: np.ndarray, space: str, white: np.ndarray) -> np.ndarray:
    """Another photo's white, raised if this one has something sizeable that is brighter."""
    bright = min(np.percentile(rgb_xyz(rgb[::4, ::4], space)[..., 1], 98), 1.0)
    return white * (max(white[1], bright) / white[1])


def _disc(rgb: np.ndarray, x: float, y: float, r: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    h, w = rgb.shape[:2]
    rows, cols = np.arange(max(0, int(y - r)), max(0, min(h, int(y + r) + 1))), np.arange(max(0, int(x - r)), max(0, min(w, int(x + r) + 1)))
    far = np.hypot(cols[None, :] - x, rows[:, None] - y)
    inside = far <= r if known is None else (far <= r) & known[rows, None]
    return rgb[rows[:, None], cols[None, :]][inside], far[inside]


def white_at(rgb: np.ndarray, space: str, x: float, y: float, r: float) -> White | None:
    """White under a tap; None outside the photo."""
    px, _ = _disc(rgb, x, y, r)
    return _white_of(px, space) if len(px) else None


def body_colour(lab: np.ndarray) -> np.ndarray:
    """Median without the lightest and darkest 15 %, of eight values or more."""
    if len(lab) >= 8:
        lo, hi = np.percentile(lab[:, 0], (15, 85))
        lab = lab[(lab[:, 0] >= lo) & (lab[:, 0] <= hi)]
    return np.median(lab, 0)


def sample_colour(rgb: np.ndarray, space: str, white: np.ndarray, x: float, y: float, r: float, known: np.ndarray | None = None) -> np.ndarray | None:
    """Lab of the object under a tap, measured against ``white``; None outside the photo or its ``known`` lines."""
    px, far = _disc(rgb, x, y, r, known)
    if not len(px):
        return None
    lab = xyz_lab(LIGHT[px] @ (adaptation(white) @ TO_XYZ[space]).T)
    core = lab[far <= max(1.5, 0.4 * r)]
    if len(core):
        same = lab[np.sqrt(((lab - np.median(core, 0)) ** 2).sum(1)) < SAME_OBJECT]
        if len(same) >= 8:
            lab = same
    return body_colour(lab)


def per_photo(photos: DataFrame, one: Callable[[dict[str, Any]], list[dict[str, Any]]], schema: str) -> DataFrame:
    """Rows that ``one`` makes of each photo row."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist(one(b.slice(i, 1).to_pylist()[0]), schema=arrow)

    return photos.mapInArrow(each, schema)


WHITES = "white array<double>, clipped boolean, found boolean, error string"


def measure_whites(photos: DataFrame) -> DataFrame:
    """(photo_id, white XYZ, clipped, found, error) of each photo; a broken photo has only ``error``."""

    def one(row: dict[str, Any]) -> list[dict[str, Any]]:
        try:
            rgb, known = known_pixels(row)
            w = auto_white(rgb, row["space"], known)
        except ValueError as e:
            return [{"photo_id": row["photo_id"], "error": str(e)}]
        return [{"photo_id": row["photo_id"], "white": w.xyz.tolist(), "clipped": w.clipped, "found": w.found}]

    return per_photo(photos.select(*_sent(photos)), one, f"photo_id {photos.schema['photo_id'].dataType.simpleString()}, {WHITES}")


def measure_taps(photos: DataFrame, taps: DataFrame) -> DataFrame:
    """(id, lab) for each (id, photo_id, x, y, r) of ``taps``, against the photo's ``white`` (its automatic one if null).

    A tap outside its photo, or in a missing or broken one, or one without a white, gives no row. Taps of a photo are few rows a hand made; they
    travel to the photo as one list, so that its pixels are sent once.
    """
    lists = taps.groupBy("photo_id").agg(F.collect_list(F.struct("id", "x", "y", "r")).alias("taps"))

    def one(row: dict[str, Any]) -> list[dict[str, Any]]:
        try:
            rgb, known = known_pixels(row)
            white = auto_white(rgb, row["space"], known).xyz if row["white"] is None else np.array(row["white"])
        except ValueError:
            return []
        seen = ((t["id"], sample_colour(rgb, row["space"], white, t["x"], t["y"], t["r"], known)) for t in row["taps"] if None not in (t["x"], t["y"], t["r"]))
        return [{"id": i, "lab": lab.tolist()} for i, lab in seen if lab is not None]

    joined = photos.select(*_sent(photos), "white").join(lists, "photo_id")
    return per_photo(joined, one, f"id {taps.schema['id'].dataType.simpleString()}, lab array<double>")


RECORD = "white array<double>, clipped boolean, basis string"
#: Hours for which a photo's white stays good for photos after it.
SITTING = 2


def automatic_whites(photos: DataFrame, known: DataFrame) -> DataFrame:
    """(photo_id, white, clipped, basis) of photo rows with ``project`` and ``created``, none of them tapped.

    The white is the one found in the photo; failing that, the white of the project's latest photo in ``known`` (project, photo_id, created, white,
    basis) that was tapped or found, at most at this photo's time and less than ``SITTING`` hours before it, raised if something here is brighter;
    failing that, the camera's. The photo itself doesn't count; of photos of one instant the one with the larger id does. A broken photo gives no row.
    """
    measured = known.where("basis IN ('tapped', 'found')").select("project", F.col("created").alias("seen"), F.col("photo_id").alias("of"), F.col("white").alias("lent"))
    near = photos.select("project", "photo_id", "created").join(measured, "project").where((F.col("of") != F.col("photo_id")) & (F.col("seen") <= F.col("created")) & (F.col("created") < F.col("seen") + F.expr(f"INTERVAL {SITTING} HOURS")))
    lender = near.groupBy("photo_id").agg(F.max_by("lent", F.struct("seen", "of")).alias("lent"))

    def one(row: dict[str, Any]) -> list[dict[str, Any]]:
        try:
            rgb = pixels(row)
        except ValueError:
            return []
        white = auto_white(rgb, row["space"])
        basis, xyz = ("found", white.xyz) if white.found else ("camera", white.xyz) if row["lent"] is None else ("borrowed", borrowed_white(rgb, row["space"], np.array(row["lent"])))
        return [{"photo_id": row["photo_id"], "white": xyz.tolist(), "clipped": white.clipped, "basis": basis}]

    joined = photos.join(lender, "photo_id", "left").select("photo_id", "width", "height", "space", "rgb", "lent")
    return per_photo(joined, one, f"photo_id {photos.schema['photo_id'].dataType.simpleString()}, {RECORD}")


def add_photos(records: DataFrame, photos: DataFrame) -> DataFrame:
    """Photo records (project, photo_id, created, width, height, white, clipped, basis) with those of new photo rows, each with its automatic white.

    New photos lend each other nothing: those of one call were added at once. A broken photo is not added.
    """
    whites = automatic_whites(photos, records)
    return records.unionByName(photos.select("project", "photo_id", "created", "width", "height").join(whites, "photo_id").select(*records.columns))


def white_under(photos: DataFrame, photo_id: Any, x: float, y: float, r: float) -> list[float] | None:
    """White under a tap on one photo; None outside it."""

    def one(row: dict[str, Any]) -> list[dict[str, Any]]:
        white = white_at(pixels(row), row["space"], x, y, r)
        return [] if white is None else [{"white": white.xyz.tolist()}]

    found = per_photo(photos.where(F.col("photo_id") == photo_id).select("photo_id", "width", "height", "space", "rgb"), one, "white array<double>").first()
    return None if found is None else found["white"]


def add_samples(samples: DataFrame, photos: DataFrame, taps: DataFrame) -> DataFrame:
    """Samples (id, kind, label, photo_id, x, y, r, lab, available) with one for each of ``taps`` (id, kind, label, photo_id, x, y, r) that lies on its photo.

    ``photos`` are photo rows with their white. A null label becomes the next free number of its kind, in order of the taps' ids.
    """
    lab = measure_taps(photos, taps)
    stem = F.when(F.col("kind") == "paper", "#").otherwise("Bean ")
    behind = F.when(F.startswith("label", stem), F.substr("label", F.length(stem) + 1).try_cast("int"))
    last = samples.groupBy("kind").agg(F.coalesce(F.max(behind), F.lit(0)).alias("last"))
    new = taps.join(lab, "id").join(last, "kind", "left")
    place = F.sum(F.col("label").isNull().cast("int")).over(Window.partitionBy("kind").orderBy("id"))
    label = F.coalesce("label", F.concat(stem, (F.coalesce("last", F.lit(0)) + place).cast("string")))
    return samples.unionByName(new.withColumn("label", label).withColumn("available", F.lit(True)).select(*samples.columns))


def add_flavor(samples: DataFrame, sample_id: Any, label: str, lab: list[float], photo_id: Any) -> DataFrame:
    """Samples with a group's colour saved as a flavour: a bean without a tap."""
    kinds = {f.name: f.dataType for f in samples.schema}
    values = {"id": F.lit(sample_id), "kind": F.lit("bean"), "label": F.lit(label), "photo_id": F.lit(photo_id), "lab": F.array(*(F.lit(float(v)) for v in lab)), "available": F.lit(True)}
    one = samples.sparkSession.range(1).select(*(values.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    return samples.unionByName(one)


def set_white(photos: DataFrame, samples: DataFrame, photo_id: Any, white: list[float] | None) -> tuple[DataFrame, DataFrame]:
    """New white of one photo (None: its automatic one again; ``white_under`` gives that of a tap, ``automatic_whites`` a borrowed one), and its samples (id, photo_id, x, y, r, lab, ...) measured anew.

    A sample whose tap gives no colour any more, and those of other photos, keep theirs.
    """
    value = F.lit(None).cast("array<double>") if white is None else F.array(*(F.lit(float(v)) for v in white))
    changed = photos.withColumn("white", F.when(F.col("photo_id") == photo_id, value).otherwise(F.col("white")))
    fresh = measure_taps(changed.where(F.col("photo_id") == photo_id), samples.where(F.col("photo_id") == photo_id)).withColumnRenamed("lab", "fresh")
    return changed, samples.join(fresh, "id", "left").withColumn("lab", F.coalesce("fresh", "lab")).select(*samples.columns)
