"""Objects on a plain sheet in one photo, and their groups: a kernel for each photo, no shuffle of pixels."""

from __future__ import annotations

from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from pigmenta.functions.color import BRADFORD, D65, TO_XYZ
from pigmenta.functions.kernels import CONE_TARGET, FROM_CONE, LIGHT, neutral_chroma, xyz_lab
from pigmenta.operators import grouping
from pigmenta.operators.measure import CAMERA_FLOOR, NEUTRAL, auto_white, body_colour, per_photo, pixels
from pigmenta.operators.raster import label, nearest_site
from pigmenta.operators.surface import TERMS, solve

# Colour distance from the sheet and weight of lightness there; least share of the sheet; what outshines
# it and what is sizeable; depth of a core; most stretched and least filled object; depth of a body.
STANDS_OUT, SHADOW_WEIGHT = 12.0, 0.35
SHEET_SHARE = 0.15
BRIGHTER, SIZEABLE = 1.25, 0.01
CORE, BODY = 0.8, 0.35
STRETCH, FILL = 3.2, 0.72
LEAST_SIDE = 32
#: A larger photo is refused with status ``too_large``; readers scale to a long edge of 1600.
MOST_PIXELS = 4_000_000


class NoObjects(Exception):
    """The photo shows no sheet with objects on it."""


class Light(NamedTuple):
    """A white in cone space, whether the sheet itself is white paper, and whether the white was seen in the shot or tapped."""

    white: np.ndarray
    is_white: bool
    calibrated: bool


class Parts(NamedTuple):
    """Labelled components with boxes; entry 0 is the background and neither touches nor hugs the frame."""

    labels: np.ndarray
    area: np.ndarray
    on_edge: np.ndarray
    hugging: np.ndarray


def parts_of(mask: np.ndarray) -> Parts:
    labels, (h, w) = label(mask, diagonal=True), mask.shape
    n = int(labels.max()) + 1
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs]
    low, high = np.full((2, n), max(h, w)), np.full((2, n), -1)
    for axis, v in enumerate((ys, xs)):
        np.minimum.at(low[axis], of, v)
        np.maximum.at(high[axis], of, v)
    on_edge = (low[0] == 0) | (low[1] == 0) | (high[0] == h - 1) | (high[1] == w - 1)
    long = (high[0] - low[0] + 1 > 0.25 * h) | (high[1] - low[1] + 1 > 0.25 * w)
    return Parts(labels, np.bincount(labels.ravel(), minlength=n), on_edge & (np.arange(n) > 0), on_edge & long & (np.arange(n) > 0))


def _cross(mask: np.ndarray, outside: bool) -> list[np.ndarray]:
    """A mask and its four neighbours; cells outside the frame hold ``outside``."""
    p = np.pad(mask, 1, constant_values=outside)
    return [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]


def opened(mask: np.ndarray, times: int = 2) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_and.reduce(_cross(mask, True))
    for _ in range(times):
        mask = np.logical_or.reduce(_cross(mask, False))
    return mask


def grown(mask: np.ndarray, size: int) -> np.ndarray:
    """Dilation by a square of odd ``size``, by running counts."""
    r = size // 2
    for axis in (0, 1):
        c = np.cumsum(np.insert(mask.astype(np.int32), 0, 0, axis), axis)
        at = np.arange(mask.shape[axis])
        mask = np.take(c, np.minimum(at + r + 1, len(at)), axis) > np.take(c, np.maximum(at - r, 0), axis)
    return mask


def main_colour(lab: np.ndarray) -> tuple[np.ndarray, float]:
    """Median of the pixels near the fullest bin of 8 units (the lowest of equals), and their share."""
    bins, n = np.unique(np.floor(lab / 8), axis=0, return_counts=True)
    off = (lab - (bins[n.argmax()] + 0.5) * 8) * [SHADOW_WEIGHT, 1, 1]
    near = lab[(off**2).sum(1) < STANDS_OUT**2]
    return (np.median(near, 0), len(near) / len(lab)) if len(near) else (np.zeros(3), 0.0)


def off_sheet(lab: np.ndarray, sheet: np.ndarray, flat: bool) -> np.ndarray:
    """Opened mask of what differs from the sheet, small holes filled; under flat light what is lighter counts in full."""
    d = lab - sheet
    d[..., 0] *= np.where(flat & (d[..., 0] > 0), 1.0, SHADOW_WEIGHT)
    mask = opened((d**2).sum(-1) > STANDS_OUT**2)
    holes = label(~mask)
    small = np.bincount(holes.ravel()) < 0.00025 * mask.size
    small[0] = False
    return mask | small[holes]


def _terms(h: int, w: int, step: int = 1) -> np.ndarray:
    u, v = np.meshgrid(np.arange(0, w, step) / w * 2 - 1, np.arange(0, h, step) / h * 2 - 1)
    return np.stack([np.ones_like(u), u, v, u * u, u * v, v * v], -1)


def fit_light(cone: np.ndarray, bare: np.ndarray) -> np.ndarray:
    """Quadratic brightness of the bare sheet in each cone channel, fitted again without what lies well below: 6 x 3."""
    at = bare[::6, ::6]
    terms, values = _terms(*bare.shape, 6)[at], cone[::6, ::6][at].astype(float)

    def fit(keep: np.ndarray) -> np.ndarray | None:
        t = terms[keep]
        return solve(t.T @ t, t.T @ values[keep]) if len(t) >= len(TERMS) else None

    first = fit(np.ones(len(terms), bool))
    if first is None:
        raise NoObjects
    rest = (values - terms @ first).mean(1)
    spread = 1.4826 * np.median(np.abs(rest - np.median(rest))) + 1e-6
    again = fit(rest > -1.5 * spread)
    return first if again is None else again


def choose_white(flat: np.ndarray, bare: np.ndarray, surround: np.ndarray, level: np.ndarray, tapped: np.ndarray | None, fallback: np.ndarray | None) -> Light:
    """White of a flattened shot: the sheet if it is white, the tap, paper around the sheet, a white from outside, or a guess."""
    frame = bare[::4, ::4].size
    at = ~bare[::4, ::4]
    cone, edge = flat[::4, ::4][at], surround[::4, ::4][at]
    xyz, sheet = cone @ FROM_CONE.T, FROM_CONE @ level
    shine = xyz[:, 1]
    outshines = shine > BRIGHTER * sheet[1]
    neutral = bool(neutral_chroma(sheet) < NEUTRAL)
    if neutral and outshines.sum() < SIZEABLE * frame:
        return Light(level, True, True)
    if tapped is not None:
        return Light(tapped, False, True)
    paper = outshines & edge & (neutral_chroma(xyz) < NEUTRAL)
    if paper.any() and paper.sum() >= SIZEABLE * frame / 2:
        top = np.percentile(shine[paper], 98)
        band = paper & (shine >= 0.8 * top) & (shine <= top)
        return Light(np.median(cone[band if band.any() else paper], 0), False, True)
    rank = int(0.02 * frame)
    brightest = min(max(np.sort(shine)[::-1][rank], sheet[1]) if rank < len(shine) else sheet[1], 1.0)
    if fallback is not None:
        own = (FROM_CONE @ fallback)[1]
        return Light(fallback * (max(own, brightest) / own), False, False)
    tint = level if neutral else BRADFORD @ D65
    return Light(tint * (max(brightest, CAMERA_FLOOR) / (FROM_CONE @ tint)[1]), False, False)


def drop_junk(mask: np.ndarray) -> tuple[np.ndarray, Parts, np.ndarray]:
    """Mask without dust, frame-huggers and huge things at the frame; the components, and which of them stay."""
    parts = parts_of(mask)
    keep = parts.area >= 40
    keep[0] = False
    inner = keep & ~parts.on_edge
    if inner.any():
        keep &= ~(parts.on_edge & (parts.area > 4 * np.median(parts.area[inner])))
    keep &= ~parts.hugging
    if not keep.any():
        raise NoObjects
    return keep[parts.labels], parts, keep


def split_touching(mask: np.ndarray, parts: Parts, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner (a seed's label) of each cell, and its distance from the sheet; seeds are the cores of the distance transform."""
    distance = np.sqrt(nearest_site(~mask, mask)[0].astype(np.float32))
    thick = np.zeros(len(keep), np.float32)
    np.maximum.at(thick, parts.labels[mask], distance[mask])
    limit = np.minimum(thick, np.float32(np.median(thick[keep]))) * np.float32(CORE)
    seeds = label(mask & (distance > limit[parts.labels]), diagonal=True)
    if not seeds.any():
        raise NoObjects
    _, row, col = nearest_site(seeds > 0, mask)
    row = np.clip(row, 0, mask.shape[0] - 1)
    return np.where(mask & (parts.labels[row, col] == parts.labels), seeds[row, col], 0), distance


class Shapes(NamedTuple):
    """Ellipses with the area and fill of each; ``lab`` is the body's colour."""

    area: np.ndarray
    fill: np.ndarray
    ellipse: np.ndarray
    lab: np.ndarray


def shapes_of(owner: np.ndarray, distance: np.ndarray, lab: np.ndarray) -> Shapes:
    ys, xs = np.nonzero(owner)
    of = owner[ys, xs]
    order = np.argsort(of, kind="stable")
    ys, xs, of = ys[order], xs[order], of[order]
    ids, start = np.unique(of, return_index=True)
    area = np.diff(np.append(start, len(of))).astype(float)
    mean = lambda v: np.add.reduceat(v.astype(float), start) / area
    cx, cy = mean(xs), mean(ys)
    mxx, myy, mxy = mean(xs * xs) - cx * cx, mean(ys * ys) - cy * cy, mean(xs * ys) - cx * cy
    root = np.sqrt(4 * mxy**2 + (mxx - myy) ** 2)
    rx, ry = np.sqrt(2 * (mxx + myy + root)), np.sqrt(np.maximum(2 * (mxx + myy - root), 1))
    far, colours = distance[ys, xs], lab[ys, xs]
    deepest = np.repeat(np.maximum.reduceat(far, start), area.astype(int))
    body = far >= BODY * deepest
    ends = np.append(start, len(of))
    bodies = np.array([body_colour(colours[a:b][body[a:b]].astype(float)) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    with np.errstate(divide="ignore"):
        fill = area / (np.pi * rx * ry)
    return Shapes(area, fill, np.column_stack([cx, cy, rx, ry, 0.5 * np.degrees(np.arctan2(2 * mxy, mxx - myy))]), bodies)


class Found(NamedTuple):
    beans: np.ndarray
    labs: np.ndarray
    clumps: np.ndarray
    sheet: np.ndarray
    light: Light


def segment(rgb: np.ndarray, space: str, tapped: np.ndarray | None = None, fallback: np.ndarray | None = None) -> Found:
    """Every object on the sheet, the clumps of several, the sheet's colour and the white used; raises ``NoObjects``."""
    h, w = rgb.shape[:2]
    if min(h, w) < LEAST_SIDE:
        raise NoObjects
    cone = (LIGHT[rgb] @ (BRADFORD @ TO_XYZ[space]).T).astype(np.float32)

    # A rough white tells sheet from not-sheet; the sheet is the colour that fills most of the frame.
    tap = None if tapped is None else BRADFORD @ tapped
    guess = BRADFORD @ auto_white(rgb, space).xyz if tap is None else tap
    to_lab = lambda c, white: xyz_lab((c * (CONE_TARGET / white)) @ FROM_CONE.T).astype(np.float32)
    lab = to_lab(cone, guess)
    colour, share = main_colour(lab[::4, ::4].reshape(-1, 3).astype(float))
    rough = off_sheet(lab.astype(float), colour, flat=False)
    bare = ~grown(rough, max(5, int(0.02 * max(w, h))) | 1)
    if share < SHEET_SHARE or bare.sum() < SHEET_SHARE * bare.size:
        raise NoObjects
    around = parts_of(rough)

    # Divide out the sheet's own brightness, then measure against the white.
    light = np.maximum(_terms(h, w) @ fit_light(cone, bare), 0.02)
    level = np.median(light[bare][::16], 0)
    flat = cone / light * level
    found = choose_white(flat, bare, around.hugging[around.labels], level, tap, None if fallback is None else BRADFORD @ fallback)
    lab = to_lab(flat, found.white)
    sheet = np.median(lab[bare][::16].astype(float), 0)
    mask, parts, keep = drop_junk(off_sheet(lab.astype(float), sheet, flat=True))
    shapes = shapes_of(*split_touching(mask, parts, keep), lab)

    ratio = shapes.ellipse[:, 2] / shapes.ellipse[:, 3]
    like = (ratio <= STRETCH) & (shapes.fill >= FILL)
    if not like.any():
        raise NoObjects
    size = shapes.area / np.median(shapes.area[like])
    beans = like & (size >= 0.3) & (size <= 1.9)
    if beans.sum() < 2:
        raise NoObjects
    clumps = (size > 1.9) & (size <= 8) & (shapes.fill >= 0.5) & (ratio <= 6)
    return Found(shapes.ellipse[beans], shapes.lab[beans], shapes.ellipse[clumps], sheet, found)


_ELLIPSE = ("cx", "cy", "rx", "ry", "angle")
_SHAPE = ", ".join(f"{c}: double" for c in _ELLIPSE)
ANALYSIS = (
    "status string, sheet array<double>, white_paper boolean, calibrated boolean, "
    f"beans array<struct<{_SHAPE}, lab: array<double>, enhanced: array<double>, principal: array<double>>>, clumps array<struct<{_SHAPE}>>, "
    "partitions array<struct<k: int, assignment: array<int>, centroids: array<array<double>>, counts: array<int>, separation: double>>, suggested int"
)


def analyse_photos(photos: DataFrame) -> DataFrame:
    """One row (photo_id and ``ANALYSIS``) for each photo row of ``measure``; optional array columns ``tapped`` and ``fallback`` are whites.

    ``status`` is ``ok``, ``no_objects``, ``too_large``, or what is wrong with the row; all else is null unless ``ok``.
    """
    extra = [c for c in ("tapped", "fallback") if c in photos.columns]

    def one(row: dict[str, Any]) -> list[dict[str, Any]]:
        out: dict[str, Any] = {"photo_id": row["photo_id"]}
        whites = [None if row.get(c) is None else np.array(row[c], float) for c in ("tapped", "fallback")]
        try:
            rgb = pixels(row)
            if rgb.shape[0] * rgb.shape[1] > MOST_PIXELS:
                return [out | {"status": "too_large"}]
            found = segment(rgb, row["space"], *whites)
        except NoObjects:
            return [out | {"status": "no_objects"}]
        except ValueError as e:
            return [out | {"status": str(e)}]
        grouped = grouping.group(found.labs)
        named = [dict(zip(_ELLIPSE, e, strict=True)) for e in found.beans.tolist()]
        tints = zip(found.labs.tolist(), grouped.enhanced.tolist(), grouped.principal.tolist(), strict=True)
        beans = [e | {"lab": a, "enhanced": b, "principal": c} for e, (a, b, c) in zip(named, tints, strict=True)]
        clumps = [dict(zip(_ELLIPSE, e, strict=True)) for e in found.clumps.tolist()]
        parts = [{"k": p.k, "assignment": p.assignment.tolist(), "centroids": p.centroids.tolist(), "counts": p.counts.tolist(), "separation": p.separation} for p in grouped.partitions]
        return [out | {"status": "ok", "sheet": found.sheet.tolist(), "white_paper": found.light.is_white, "calibrated": found.light.calibrated, "beans": beans, "clumps": clumps, "partitions": parts, "suggested": grouped.suggested}]

    return per_photo(photos.select("photo_id", "width", "height", "space", "rgb", *extra), one, f"photo_id {photos.schema['photo_id'].dataType.simpleString()}, {ANALYSIS}")
