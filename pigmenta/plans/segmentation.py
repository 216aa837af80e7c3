"""Objects on a sheet, step by step as relations: sheet colour, mask, parts, cores, owners, shapes, sizes.

Each step is a text over the steps before it. For DuckDB they become one chain of common tables, with components by a keyed recursion and
nearest cells by brute force. Spark runs the same texts one after the other, writes what several steps read, and has its own operators
for components (tiles) and nearest cells (envelopes), so no photo is bound to one task.

The derived photos are small (64 x 50), so the largest hole that is filled is a larger share of them (``HOLE``) than of a real photo.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.functions.color import BRADFORD, D65, TO_XYZ, WHITE_Y, lab_stages, linear, nest, num, pixel_lab_stages
from pigmenta.operators import raster
from pigmenta.operators.surface import TERMS, robust_text
from pigmenta.operators.tables import checkpointed

Run = Callable[..., DataFrame]

WIDTH, HEIGHT = 64, 50
HOLE = 0.003
# Distance from the sheet and weight of lightness; least share of the sheet; dust; edge parts against inner ones; a long part;
# depth of cores and bodies; most stretched and least filled object; sizes of objects and clumps against the median.
STANDS_OUT, SHADOW, SHARE = "144e0", "0.35e0", "0.15e0"
DUST, EDGE, LONG = 40, 4, "0.25e0"
CORE, BODY, STRETCH, FILL = "0.8e0", "0.35e0", "3.2e0", "0.72e0"
SMALL, LARGE, CLUMP, CLUMP_FILL, CLUMP_STRETCH = "0.3e0", "1.9e0", "8e0", "0.5e0", "6e0"


class Step(NamedTuple):
    """``text`` over earlier steps; with ``kind`` the step labels cells (components), finds cells nearest to others, or takes every 16th cell, in Spark's own way."""

    name: str
    text: str
    kind: str = ""
    once: bool = False


def _photo(rgb: str, white: tuple[float, float, float]) -> str:
    """Lab of each pixel of a photo that is smoothed over 7 x 7 pixels, so that it shows spots."""
    near = lambda source, part, order: f"SELECT photo_id, y, x, {', '.join(f'avg(v{i}) OVER (PARTITION BY photo_id, {part} ORDER BY {order} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v{i}' for i in range(3))} FROM ({source}) AS t"
    level = lambda v: f"CAST(least(greatest(floor(({v} * 3e0 + 0.5e0) * 255e0), 0e0), 255e0) AS DOUBLE)"
    levels = f"SELECT photo_id, y AS row_y, x AS row_x, {', '.join(f'{level(f"v{i}")} AS {c}' for i, c in enumerate('rgb'))} FROM ({near(near(rgb, 'y', 'x'), 'x', 'y')}) AS t"
    return f"SELECT photo_id, row_y AS y, row_x AS x, lab_l AS l, lab_a AS a, lab_b AS b, r AS red, g AS green, b AS blue FROM ({nest(levels, pixel_lab_stages(white))}) AS p"


def _cross(inner: str, how: str) -> str:
    by = {"row": "(PARTITION BY photo_id, y ORDER BY x)", "col": "(PARTITION BY photo_id, x ORDER BY y)"}
    around = ", ".join(f"coalesce({f}(m) OVER {w}, m)" for w in by.values() for f in ("lag", "lead"))
    return f"SELECT photo_id, y, x, {how}(m, {around}) AS m FROM ({inner}) AS c"


def _sum(row: np.ndarray, names: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"{num(v)} * {n}" for v, n in zip(row, names, strict=True)) + ")"


def steps(rgb: str, white: tuple[float, float, float]) -> list[Step]:
    far = lambda l, a, b: f"{SHADOW} * (l - {l}) * {SHADOW} * (l - {l}) + (a - {a}) * (a - {a}) + (b - {b}) * (b - {b})"  # noqa: E731, E741
    opened = "SELECT * FROM sg_rough"
    for how in ("least", "least", "greatest", "greatest"):
        opened = _cross(opened, how)
    middle = lambda c: f"{{pct}}({c}, 0.5)"
    light = lambda k: " + ".join(f"c{i}{k} * ({t})" for i, t in enumerate(TERMS))
    root = "sqrt((sxx - syy) * (sxx - syy) + 4e0 * sxy * sxy)"
    return [
        Step("sg_px", _photo(rgb, white), once=True),
        Step("sg_mode", "SELECT photo_id, bl, ba, bb FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY n DESC, bl, ba, bb) AS place FROM (SELECT photo_id, floor(l / 8e0) AS bl, floor(a / 8e0) AS ba, floor(b / 8e0) AS bb, count(*) AS n FROM sg_px WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY photo_id, floor(l / 8e0), floor(a / 8e0), floor(b / 8e0)) AS h) AS o WHERE place = 1"),
        Step("sg_sheet", f"SELECT photo_id, bl, ba, bb, avg(CASE WHEN near THEN 1e0 ELSE 0e0 END) AS share, {middle('CASE WHEN near THEN l END')} AS sl, {middle('CASE WHEN near THEN a END')} AS sa, {middle('CASE WHEN near THEN b END')} AS sb FROM (SELECT p.photo_id, bl, ba, bb, l, a, b, {far('(bl + 0.5e0) * 8e0', '(ba + 0.5e0) * 8e0', '(bb + 0.5e0) * 8e0')} < {STANDS_OUT} AS near FROM sg_px p JOIN sg_mode m ON m.photo_id = p.photo_id WHERE x % 4 = 0 AND y % 4 = 0) AS n GROUP BY photo_id, bl, ba, bb", once=True),
        Step("sg_rough", f"SELECT p.photo_id, y, x, CASE WHEN {far('sl', 'sa', 'sb')} > {STANDS_OUT} THEN 1 ELSE 0 END AS m FROM sg_px p JOIN sg_sheet s ON s.photo_id = p.photo_id"),
        Step("sg_open", opened, once=True),
        Step("sg_gap", "SELECT photo_id, y, x FROM sg_open WHERE m = 0"),
        Step("sg_hole", "sg_gap", "components4", True),
        Step("sg_small", f"SELECT photo_id, label FROM sg_hole GROUP BY photo_id, label HAVING count(*) < {HOLE}e0 * {WIDTH * HEIGHT}"),
        Step("sg_mask", "SELECT photo_id, y, x FROM sg_open WHERE m = 1 UNION ALL SELECT h.photo_id, y, x FROM sg_hole h JOIN sg_small s ON s.photo_id = h.photo_id AND s.label = h.label", once=True),
        Step("sg_part", "sg_mask", "components8", True),
        Step("sg_box", f"SELECT *, on_edge AND (max_x - min_x + 1 > {LONG} * {WIDTH} OR max_y - min_y + 1 > {LONG} * {HEIGHT}) AS hugging FROM (SELECT *, min_x = 0 OR min_y = 0 OR max_x = {WIDTH - 1} OR max_y = {HEIGHT - 1} AS on_edge FROM (SELECT photo_id, label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM sg_part GROUP BY photo_id, label) AS b) AS b"),
        Step("sg_inner", f"SELECT photo_id, {middle('CAST(area AS DOUBLE)')} AS inner_area FROM sg_box WHERE area >= {DUST} AND NOT on_edge GROUP BY photo_id"),
        Step("sg_keep", f"SELECT b.photo_id, b.label FROM sg_box b LEFT JOIN sg_inner i ON i.photo_id = b.photo_id WHERE area >= {DUST} AND NOT hugging AND NOT (on_edge AND inner_area IS NOT NULL AND area > {EDGE} * inner_area)"),
        Step("sg_fg", "SELECT p.photo_id, y, x, p.label AS part FROM sg_part p JOIN sg_keep k ON k.photo_id = p.photo_id AND k.label = p.label", once=True),
        Step("sg_bare", "SELECT c.photo_id, c.y, c.x FROM sg_open c LEFT JOIN sg_fg f ON f.photo_id = c.photo_id AND f.y = c.y AND f.x = c.x WHERE f.part IS NULL"),
        Step("sg_depth", "sg_fg sg_bare", "nearest", True),
        Step("sg_thick", "SELECT f.photo_id, part, sqrt(CAST(max(d2) AS DOUBLE)) AS thick FROM sg_fg f JOIN sg_depth d ON d.photo_id = f.photo_id AND d.y = f.y AND d.x = f.x GROUP BY f.photo_id, part"),
        Step("sg_typical", f"SELECT photo_id, {middle('thick')} AS typical FROM sg_thick GROUP BY photo_id"),
        Step("sg_core", f"SELECT f.photo_id, f.y, f.x FROM sg_fg f JOIN sg_depth d ON d.photo_id = f.photo_id AND d.y = f.y AND d.x = f.x JOIN sg_thick t ON t.photo_id = f.photo_id AND t.part = f.part JOIN sg_typical m ON m.photo_id = f.photo_id WHERE sqrt(CAST(d2 AS DOUBLE)) > {CORE} * least(thick, typical)", once=True),
        Step("sg_seed", "sg_core", "components8", True),
        Step("sg_near", "sg_fg sg_core", "nearest", True),
        Step("sg_owner", "SELECT f.photo_id, f.y, f.x, s.label AS seed FROM sg_fg f JOIN sg_near n ON n.photo_id = f.photo_id AND n.y = f.y AND n.x = f.x JOIN sg_seed s ON s.photo_id = n.photo_id AND s.y = n.site_y AND s.x = n.site_x JOIN sg_fg g ON g.photo_id = n.photo_id AND g.y = n.site_y AND g.x = n.site_x WHERE g.part = f.part", once=True),
        Step("sg_cell", "SELECT o.photo_id, o.seed, o.y, o.x, sqrt(CAST(d2 AS DOUBLE)) AS depth, l, a, b FROM sg_owner o JOIN sg_depth d ON d.photo_id = o.photo_id AND d.y = o.y AND d.x = o.x JOIN sg_px p ON p.photo_id = o.photo_id AND p.y = o.y AND p.x = o.x"),
        Step("sg_shape", f"SELECT *, CASE WHEN rx > 0e0 THEN area / (3.141592653589793e0 * rx * ry) END AS fill FROM (SELECT photo_id, seed, area, deepest, cx, cy, sqrt(greatest(2e0 * (sxx + syy + {root}), 0e0)) AS rx, sqrt(greatest(2e0 * (sxx + syy - {root}), 1e0)) AS ry, CASE WHEN abs(sxy) < 1e-9 THEN CASE WHEN sxx >= syy - 1e-9 THEN 0e0 ELSE 90e0 END ELSE 0.5e0 * degrees(atan2(2e0 * sxy, sxx - syy)) END AS angle FROM (SELECT photo_id, seed, count(*) AS area, max(depth) AS deepest, avg(x) AS cx, avg(y) AS cy, avg(CAST(x * x AS DOUBLE)) - avg(x) * avg(x) AS sxx, avg(CAST(y * y AS DOUBLE)) - avg(y) * avg(y) AS syy, avg(CAST(x * y AS DOUBLE)) - avg(x) * avg(y) AS sxy FROM sg_cell GROUP BY photo_id, seed) AS m) AS m", once=True),
        Step("sg_deep", f"SELECT c.photo_id, c.seed, l, a, b FROM sg_cell c JOIN sg_shape s ON s.photo_id = c.photo_id AND s.seed = c.seed WHERE depth >= {BODY} * deepest", once=True),
        Step("sg_band", "SELECT photo_id, seed, {pct}(l, 0.15) AS low, {pct}(l, 0.85) AS high, count(*) AS n FROM sg_deep GROUP BY photo_id, seed"),
        Step("sg_body", f"SELECT d.photo_id, d.seed, {middle('l')} AS body_l, {middle('a')} AS body_a, {middle('b')} AS body_b FROM sg_deep d JOIN sg_band n ON n.photo_id = d.photo_id AND n.seed = d.seed WHERE n < 8 OR l BETWEEN low AND high GROUP BY d.photo_id, d.seed"),
        Step("sg_like", f"SELECT *, rx <= {STRETCH} * ry AND (fill IS NULL OR fill >= {FILL}) AS fit FROM sg_shape"),
        Step("sg_size", f"SELECT photo_id, {middle('CAST(area AS DOUBLE)')} AS usual FROM sg_like WHERE fit GROUP BY photo_id"),
        Step("sg_object", f"SELECT l.photo_id, l.seed, area, cx, cy, rx, ry, angle, fill, body_l, body_a, body_b, CASE WHEN fit AND area BETWEEN {SMALL} * usual AND {LARGE} * usual THEN 'object' WHEN area > {LARGE} * usual AND area <= {CLUMP} * usual AND (fill IS NULL OR fill >= {CLUMP_FILL}) AND rx <= {CLUMP_STRETCH} * ry THEN 'clump' ELSE 'other' END AS kind FROM sg_like l JOIN sg_body b ON b.photo_id = l.photo_id AND b.seed = l.seed LEFT JOIN sg_size s ON s.photo_id = l.photo_id"),
        Step("sg_count", "SELECT photo_id, sum(CASE WHEN kind = 'object' THEN 1 ELSE 0 END) AS objects, sum(CASE WHEN kind = 'clump' THEN 1 ELSE 0 END) AS clumps, max(CASE WHEN fit THEN 1 ELSE 0 END) AS any_fit FROM (SELECT o.photo_id, kind, fit FROM sg_object o JOIN sg_like l ON l.photo_id = o.photo_id AND l.seed = o.seed) AS o GROUP BY photo_id"),
        # The light over the sheet is a quadratic surface of each cone; divided out, all of the sheet is as bright as its usual bare cell.
        Step("sg_cone", f"SELECT photo_id, row_y AS y, row_x AS x, {', '.join(f'CAST(CAST(k{i} AS FLOAT) AS DOUBLE) AS k{i}' for i in range(3))} FROM ({nest('SELECT photo_id, y AS row_y, x AS row_x, red, green, blue FROM sg_px', [{f'lin_{c[0]}': linear(c) for c in ('red', 'green', 'blue')}, {f'k{i}': _sum(v, ('lin_r', 'lin_g', 'lin_b')) for i, v in enumerate(BRADFORD @ TO_XYZ['sRGB'])}])}) AS c", once=True),
        Step("sg_points", f"SELECT c.photo_id, 2e0 * c.x / {WIDTH}e0 - 1e0 AS u, 2e0 * c.y / {HEIGHT}e0 - 1e0 AS w, k0 AS v0, k1 AS v1, k2 AS v2 FROM sg_cone c JOIN sg_open o ON o.photo_id = c.photo_id AND o.y = c.y AND o.x = c.x WHERE m = 0 AND c.x % 6 = 0 AND c.y % 6 = 0"),
        Step("sg_fit", f"SELECT * FROM ({robust_text('SELECT * FROM sg_points')}) AS f", once=True),
        Step("sg_light", f"SELECT c.photo_id, c.y, c.x, {', '.join(f'k{i}, greatest({light(i)}, 0.02e0) AS f{i}' for i in range(3))} FROM (SELECT *, 2e0 * x / {WIDTH}e0 - 1e0 AS u, 2e0 * y / {HEIGHT}e0 - 1e0 AS w FROM sg_cone) AS c JOIN sg_fit s ON s.photo_id = c.photo_id", once=True),
        Step("sg_lit", "SELECT l.photo_id, l.y, l.x, f0, f1, f2 FROM sg_light l JOIN sg_open o ON o.photo_id = l.photo_id AND o.y = l.y AND o.x = l.x WHERE m = 0"),
        Step("sg_some", "sg_lit", "every16"),
        Step("sg_level", f"SELECT photo_id, {', '.join(f'{middle(f"f{i}")} AS level{i}' for i in range(3))} FROM sg_some GROUP BY photo_id"),
        Step("sg_flat", f"SELECT photo_id, row_y AS y, row_x AS x, lab_l AS l, lab_a AS a, lab_b AS b FROM ({nest(f'SELECT l.photo_id, l.y AS row_y, l.x AS row_x, {", ".join(f"k{i} / f{i} * {num(t)} AS g{i}" for i, t in enumerate(BRADFORD @ (D65 * WHITE_Y)))} FROM sg_light l JOIN sg_level v ON v.photo_id = l.photo_id', [{c: _sum(v, ('g0', 'g1', 'g2')) for c, v in zip('xyz', np.linalg.inv(BRADFORD), strict=True)}, *lab_stages()])}) AS f"),
        Step("sg_bareness", "SELECT photo_id, 1e0 - avg(CAST(m AS DOUBLE)) AS bare FROM sg_open GROUP BY photo_id"),
    ]


_SHAPE = "photo_id, seed, area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(rx, 5) AS rx, round(ry, 5) AS ry, round(angle, 5) AS angle, round(fill, 6) AS fill, round(body_l, 6) AS body_l, round(body_a, 6) AS body_a, round(body_b, 6) AS body_b, kind"
#: What each query shows of the chain.
SHOWN = {
    "sheet_colour": "SELECT photo_id, CAST(bl AS INT) AS bl, CAST(ba AS INT) AS ba, CAST(bb AS INT) AS bb, round(share, 6) AS share, round(sl, 6) AS l, round(sa, 6) AS a, round(sb, 6) AS b FROM sg_sheet",
    "rough_mask": "SELECT photo_id, y, x FROM sg_mask",
    "kept_parts": "SELECT photo_id, y, x, part FROM sg_fg",
    "core_cells": "SELECT photo_id, y, x, label AS seed FROM sg_seed",
    "seed_owners": "SELECT photo_id, y, x, seed FROM sg_owner",
    "segmented_objects": f"SELECT {_SHAPE} FROM sg_object",
    "flat_field": "SELECT photo_id, y, x, round(l, 3) AS l, round(a, 3) + 0e0 AS a, round(b, 3) + 0e0 AS b FROM sg_flat",
    "segment_status": f"SELECT s.photo_id, CASE WHEN share < {SHARE} THEN 'no sheet' WHEN bare < {SHARE} THEN 'nothing bare' WHEN c.photo_id IS NULL THEN 'no part' WHEN any_fit = 0 THEN 'no object' WHEN objects < 2 THEN 'too few objects' ELSE 'ok' END AS status, CAST(coalesce(objects, 0) AS BIGINT) AS objects, CAST(coalesce(clumps, 0) AS BIGINT) AS clumps, round(bare, 6) AS bare FROM sg_sheet s JOIN sg_bareness b ON b.photo_id = s.photo_id LEFT JOIN sg_count c ON c.photo_id = s.photo_id",
}
_NAME = re.compile(r"\b(FROM|JOIN) (sg_\w+)")


def _needed(chain: list[Step], shown: str) -> list[Step]:
    wanted = set(re.findall(r"sg_\w+", shown))
    for s in reversed(chain):
        if s.name in wanted:
            wanted |= set(re.findall(r"sg_\w+", s.text))
    return [s for s in chain if s.name in wanted]


def oracle_sql(chain: list[Step]) -> dict[str, str]:
    def ctes(s: Step) -> list[str]:
        if s.kind.startswith("components"):
            corner = "" if s.kind.endswith("8") else " WHERE dy = 0 OR dx = 0"
            near = f"(SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy) AS p, (SELECT unnest([-1, 0, 1]) AS dx) AS q{corner})"
            return [
                f"{s.name}_r(photo_id, y, x, seed) USING KEY (photo_id, y, x) AS (SELECT photo_id, y, x, y * {WIDTH} + x FROM {s.text} UNION SELECT c.photo_id, c.y, c.x, min(r.seed) FROM {s.name}_r AS r JOIN {near} AS d ON TRUE JOIN {s.text} AS c ON c.photo_id = r.photo_id AND c.y = r.y + dy AND c.x = r.x + dx JOIN recurring.{s.name}_r AS old ON old.photo_id = c.photo_id AND old.y = c.y AND old.x = c.x WHERE r.seed < old.seed GROUP BY c.photo_id, c.y, c.x)",
                f"{s.name} AS MATERIALIZED (SELECT photo_id, y, x, CAST(dense_rank() OVER (PARTITION BY photo_id ORDER BY seed) AS INT) AS label FROM {s.name}_r)",
            ]
        if s.kind == "nearest":
            cells, sites = s.text.split()
            best = "min({'d': (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 'x': b.x, 'y': b.y})"
            return [f"{s.name} AS MATERIALIZED (SELECT photo_id, y, x, best.d AS d2, best.y AS site_y, best.x AS site_x FROM (SELECT a.photo_id, a.y, a.x, {best} AS best FROM {cells} AS a JOIN {sites} AS b ON a.photo_id = b.photo_id GROUP BY a.photo_id, a.y, a.x) AS n)"]
        if s.kind == "every16":
            return [f"{s.name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY y, x) - 1 AS place FROM {s.text}) AS p WHERE place % 16 = 0)"]
        return [f"{s.name} AS MATERIALIZED ({s.text})"]

    return {name: f"WITH RECURSIVE {', '.join(c for s in _needed(chain, text) for c in ctes(s))} {text}" for name, text in SHOWN.items()}


def queries(run: Run, chain: list[Step]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(spark: SparkSession, sf_dir: str, frames: dict[str, DataFrame], text: str) -> DataFrame:
        used = {n: frames[n] for _, n in _NAME.findall(text)}
        return run(spark, sf_dir, _NAME.sub(r"\1 {\2}", text), **used)

    def step(spark: SparkSession, sf_dir: str, frames: dict[str, DataFrame], s: Step) -> DataFrame:
        if s.kind.startswith("components"):
            return raster.components(frames[s.text], diagonal=s.kind.endswith("8"))
        if s.kind == "nearest":
            cells, sites = (frames[n].select("photo_id", "y", "x") for n in s.text.split())
            frame = frames["sg_open"].select("photo_id", "y", "x", F.lit(False).alias("site"))  # all cells take part
            flagged = frame.unionByName(sites.withColumn("site", F.lit(True))).groupBy("photo_id", "y", "x").agg(F.max("site").alias("site"))
            return raster.nearest_seeds(flagged).join(cells, ["photo_id", "y", "x"], "left_semi")
        if s.kind == "every16":
            return raster.every_nth(frames[s.text], 16)
        return over(spark, sf_dir, frames, s.text)

    def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames: dict[str, DataFrame] = {}
            for s in _needed(chain, text):
                made = step(spark, sf_dir, frames, s)
                frames[s.name] = checkpointed(made) if s.once else made
            return over(spark, sf_dir, frames, text)

        return build

    return {name: query(text) for name, text in SHOWN.items()}
