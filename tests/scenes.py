"""Synthetic photos for tests: rounded pebbles of known colour on paper or cloth, under one lamp.

A scene is layers of light: a ground with texture, soft shadows away from the lamp, domed pebbles with smooth edges and
a highlight towards it, the lamp's decay over the frame, and sensor noise. Pebbles lie on a staggered lattice.
Colours are families of three in CIELAB around a centre, so how far members lie apart is a parameter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pigmenta.functions.color import D65, KNEE, TO_XYZ

#: Centres of the colour families, and grounds, in CIELAB.
FAMILIES = {"reds": (40.0, 50.0, 27.0), "yellows": (76.0, 6.0, 58.0), "greens": (58.0, -36.0, 34.0), "darks": (22.0, 6.0, -4.0), "whites": (86.0, 1.0, 9.0)}
GROUNDS = {"slate": (19.0, 1.0, -3.0), "indigo": (24.0, 6.0, -22.0), "bark": (42.0, 14.0, 22.0)}
PAPER_LAB = (93.0, 0.0, 0.0)
#: Linear light of a lamp somewhat warmer than daylight.
LAMP = np.array([1.0, 0.91, 0.76])
#: Where the lamp stands, in widths and heights of the frame.
LAMP_AT = (0.68, 0.22)
MARGIN = 1.1


def reflectance(lab: tuple[float, float, float] | np.ndarray) -> np.ndarray:
    """Linear sRGB of a CIELAB colour under D65, kept within what a surface reflects."""
    l, a, b = np.moveaxis(np.asarray(lab, float), -1, 0)  # noqa: E741
    f = np.stack([(l + 16) / 116 + a / 500, (l + 16) / 116, (l + 16) / 116 - b / 200], -1)
    xyz = np.where(f > KNEE, f**3, 3 * KNEE**2 * (f - 4 / 29)) * D65
    return np.clip(xyz @ np.linalg.inv(TO_XYZ["sRGB"]).T, 0.004, 0.95)


def family(name: str, apart: float = 11.0) -> np.ndarray:
    """Reflectances of three look-alikes, evenly around the family's centre."""
    turn = 2 * np.pi * np.arange(3) / 3 + 0.4
    ring = np.column_stack([0.45 * np.cos(turn), 0.85 * np.sin(turn), 0.6 * np.cos(turn + 0.7)])
    return reflectance(np.array(FAMILIES[name]) + apart * ring)


PAPER = reflectance(PAPER_LAB)


def lattice(count: int, columns: int = 10, pitch: tuple[float, float] = (105, 90), seed: int = 0, jitter: float = 7.0) -> np.ndarray:
    """Centre and turn of each of ``count`` pebbles; every other row is moved by half a step."""
    rng, (row, col) = np.random.default_rng(seed), np.divmod(np.arange(count), columns)
    at = np.column_stack([(MARGIN + col + 0.5 * (row % 2)) * pitch[0], (MARGIN + row) * pitch[1]])
    return np.column_stack([at + rng.uniform(-jitter, jitter, (count, 2)), rng.uniform(0, 360, count)])


def _texture(rng: np.random.Generator, height: int, width: int, cell: tuple[int, int]) -> np.ndarray:
    """Smooth noise: random values on a coarse net, drawn out linearly between its knots."""
    net = rng.normal(size=(height // cell[0] + 2, width // cell[1] + 2))
    y, x = np.arange(height) / cell[0], np.arange(width) / cell[1]
    rows = net[y.astype(int)] * (1 - y % 1)[:, None] + net[y.astype(int) + 1] * (y % 1)[:, None]
    return rows[:, x.astype(int)] * (1 - x % 1) + rows[:, x.astype(int) + 1] * (x % 1)


def photograph(
    places: np.ndarray, colours: np.ndarray, width: int = 1200, height: int = 900, radii: tuple[float, float] = (26.0, 17.0), decay: float = 0.9,
    vary: float = 0.025, seed: int = 0, ground: str | None = None, rim: int = 50, fibre: float = 0.0, creases: int = 0,
) -> np.ndarray:
    """Channels of a photo of pebbles at ``places`` (x, y, turn) on white paper, or on a ``ground`` laid on it with a ``rim`` of paper left."""
    rng = np.random.default_rng([seed, 77])
    xs, ys = np.arange(width, dtype=float)[None, :], np.arange(height, dtype=float)[:, None]
    scene = np.broadcast_to(PAPER, (height, width, 3)).copy()
    if ground is not None:
        scene[rim : height - rim, rim : width - rim] = reflectance(GROUNDS[ground])
    if fibre:
        scene *= np.clip(1 + fibre * _texture(rng, height, width, (4, 60)), 0.5, 1.5)[..., None]
    for _ in range(creases):
        slope, middle, half, x0 = rng.uniform(-0.05, 0.05), rng.uniform(0.1, 0.9) * height, rng.uniform(0.05, 0.15) * width, rng.uniform(0.2, 0.8) * width
        line = np.exp(-(((ys - middle - slope * (xs - x0)) / 1.1) ** 2)) * (np.abs(xs - x0) < half)
        scene *= (1 + 1.5 * line)[..., None]
    lamp = np.array([LAMP_AT[0] * width, LAMP_AT[1] * height])

    def near(x: float, y: float, reach: float) -> tuple[slice, slice]:
        return slice(max(0, int(y - reach)), max(0, int(y + reach) + 1)), slice(max(0, int(x - reach)), max(0, int(x + reach) + 1))

    long, short = radii
    away = places[:, :2] - lamp
    away = away / np.maximum(np.hypot(away[:, 0], away[:, 1]), 1)[:, None]
    for (x, y, _), (ax, ay) in zip(places, away, strict=True):
        box = near(x, y, 2 * long)
        d2 = (xs[:, box[1]] - x - 0.3 * short * ax) ** 2 + (ys[box[0]] - y - 0.3 * short * ay) ** 2
        scene[box] *= (1 - 0.22 * np.exp(-d2 / (0.55 * long * (long + short))))[..., None]
    for (x, y, turn), (ax, ay), colour in zip(places, away, np.reshape(colours, (-1, 3)), strict=True):
        box = near(x, y, long + 2)
        dx, dy, t = xs[:, box[1]] - x, ys[box[0]] - y, np.deg2rad(turn)
        rho = np.hypot((dx * np.cos(t) + dy * np.sin(t)) / long, (dy * np.cos(t) - dx * np.sin(t)) / short)
        cover = np.clip((1 - rho) * short + 0.5, 0, 1)[..., None]
        dome = 0.75 + 0.25 * np.sqrt(np.clip(1 - rho**2, 0, 1))
        spot = np.exp(-((dx + 0.35 * short * ax) ** 2 + (dy + 0.35 * short * ay) ** 2) / (0.16 * short) ** 2)
        body = colour * (1 + vary * rng.normal()) * dome[..., None]
        scene[box] = scene[box] * (1 - cover) + cover * np.maximum(body, 0.9 * spot[..., None])
    far2 = ((xs - lamp[0]) ** 2 + (ys - lamp[1]) ** 2) / (width**2 + height**2)
    light = np.clip(scene / (1 + decay * far2)[..., None] * LAMP + 0.003 * rng.normal(size=scene.shape), 0, 1)
    curve = np.where(light <= 0.0031308, light * 12.92, 1.055 * light ** (1 / 2.4) - 0.055)
    return np.floor(curve * 255 + 0.5).astype(np.uint8)


PHOTO = "photo_id long, width int, height int, space string, rgb binary"
#: Lattice of ``scene_photos``.
COLUMNS, PITCH = 5, 70


def scene_photos(objects: DataFrame, width: int = 450, height: int = 380) -> DataFrame:
    """(photo_id, object_id, r, g, b), linear, to a photo row each; objects lie in rows of ``COLUMNS`` in the order of their ids.

    Rows are small and rendering is dear, so photos are dealt over all cores.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, photo = pdf.sort_values("object_id"), int(pdf["photo_id"].iloc[0])
        rgb = photograph(lattice(len(pdf), COLUMNS, (PITCH, PITCH), photo), pdf[["r", "g", "b"]].to_numpy(float), width, height, (20.0, 13.0), seed=photo)
        return pd.DataFrame({"photo_id": [photo], "width": [width], "height": [height], "space": ["sRGB"], "rgb": [rgb.tobytes()]})

    tasks = objects.sparkSession.sparkContext.defaultParallelism * 4
    return objects.repartition(tasks, "photo_id").groupBy("photo_id").applyInPandas(one, PHOTO)
