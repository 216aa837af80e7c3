"""Queries over the test tables, as SQL text that Spark and DuckDB both run.

The tables hold no photos, so each query derives its input: parts are measured samples of flavours, suppliers are
sheets, embeddings are photos (50 rows of 64 values each), events are photos in time. Where Spark has a plan of its
own (a kernel, a separable transform) it stands in ``OWN`` beside the text that states the same result by brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.functions.color import balance_stages, balanced_lab_stages, ciede2000_stages, hex_stages, lab_stages, nest, pixel_lab_stages, unlab_stages, xyz_stages
from pigmenta.operators import assignment, measure, raster, segment, surface
from pigmenta.operators.tables import checkpointed, numbered
from pigmenta.plans import display, grouping, matching, segmentation, whites

TABLES = ("customer", "embeddings", "events", "part", "supplier")
SPARK = {"key": r"lower(trim(regexp_replace(label, '(?U)\\s+', ' ')))", "hexed": "format_string('#%02x%02x%02x', h_r, h_g, h_b)", "div": "div", "pct": "percentile", "raster": "SELECT vec_id div 50 AS photo_id, CAST(vec_id % 50 AS INT) AS y, x, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS x, v", "rgb": "SELECT vec_id div 50 AS photo_id, CAST(vec_id % 50 AS INT) AS y, x, CAST(v AS DOUBLE) AS v0, CAST(embedding[(x + 21) % 64] AS DOUBLE) AS v1, CAST(embedding[(x + 42) % 64] AS DOUBLE) AS v2 FROM embeddings LATERAL VIEW posexplode(embedding) t AS x, v", "at": "element_at(embedding, {})"}
DUCK = {"key": r"lower(trim(regexp_replace(label, '[\s\p{Z}]+', ' ', 'g')))", "hexed": "printf('#%02x%02x%02x', h_r, h_g, h_b)", "div": "//", "pct": "quantile_cont", "raster": "SELECT vec_id // 50 AS photo_id, CAST(vec_id % 50 AS INT) AS y, CAST(unnest(range(0, len(embedding))) AS INT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings", "rgb": "SELECT photo_id, y, x, CAST(embedding[x + 1] AS DOUBLE) AS v0, CAST(embedding[(x + 21) % 64 + 1] AS DOUBLE) AS v1, CAST(embedding[(x + 42) % 64 + 1] AS DOUBLE) AS v2 FROM (SELECT vec_id // 50 AS photo_id, CAST(vec_id % 50 AS INT) AS y, CAST(unnest(range(0, 64)) AS INT) AS x, embedding FROM embeddings) AS e", "at": "embedding[{}]"}

Query = Callable[[SparkSession, str], DataFrame]

#: White against which the derived samples and sheets, which have no photo, are measured.
WHITE = (0.659726868, 0.691085816, 0.552663648)
#: Pairs of a flavour and a sheet that a task makes, where they are dealt out; rows up to which the smaller side is broadcast for that.
TASK_PAIRS, BROADCAST_ROWS = 100_000, 500_000


def _samples() -> str:
    return "SELECT p_partkey AS seq, p_name AS label, CAST((p_partkey * 37 + p_size * 5) % 256 AS DOUBLE) AS r, CAST((p_partkey * 91 + p_size * 3) % 256 AS DOUBLE) AS g, CAST((p_partkey * 53 + 17) % 256 AS DOUBLE) AS b FROM part"


def _papers(space: str = "sRGB") -> str:
    rgb = "SELECT s_suppkey AS paper, concat('#', CAST(s_suppkey AS VARCHAR(20))) AS paper_label, s_acctbal >= 0 AS available, CAST(s_suppkey * 67 % 256 AS DOUBLE) AS r, CAST(s_suppkey * 29 % 256 AS DOUBLE) AS g, CAST(s_suppkey * 113 % 256 AS DOUBLE) AS b FROM supplier"
    return f"SELECT paper, paper_label, available, lab_l AS pl, lab_a AS pa, lab_b AS pb FROM ({nest(rgb, pixel_lab_stages(WHITE, space))}) AS p"


def _flavors() -> str:
    measured = nest(_samples(), pixel_lab_stages(WHITE))
    return f"SELECT flavor, min_by(label, seq) AS label, avg(lab_l) AS fl, avg(lab_a) AS fa, avg(lab_b) AS fb, count(*) AS samples, min(seq) AS first_seq FROM (SELECT *, {{key}} AS flavor FROM ({measured}) AS m) AS m GROUP BY flavor"


def _costs(k_l: float = 2.0) -> str:
    pairs = f"SELECT f.*, p.* FROM ({_flavors()}) AS f CROSS JOIN ({_papers()}) AS p"
    return nest(pairs, ciede2000_stages(("fl", "fa", "fb"), ("pl", "pa", "pb"), k_l))


def _objects() -> str:
    """Objects of a photo with a colour; {e1}.. stand for the first components."""
    return "SELECT vec_id {div} 50 AS photo_id, vec_id AS object_id, 50 + 60 * CAST({e1} AS DOUBLE) AS lab_l, 60 * CAST({e2} AS DOUBLE) AS lab_a, 60 * CAST({e3} AS DOUBLE) AS lab_b, CAST(vec_id % 3 AS INT) AS grp FROM embeddings"


def _rgb() -> str:
    """A photo of 64 x 50 pixels; each value of a row serves each channel once."""
    level = lambda v: f"CAST(least(greatest(floor(({v} + 0.6e0) / 1.2e0 * 255e0), 0e0), 255e0) AS DOUBLE)"
    return f"SELECT photo_id, y, x, {level('v0')} AS r, {level('v1')} AS g, {level('v2')} AS b FROM ({{rgb}}) AS t"


def _cross(inner: str, column: str, how: str) -> str:
    """One step over the four neighbours; what is outside the frame has no say."""
    by = {"row": "(PARTITION BY photo_id, y ORDER BY x)", "col": "(PARTITION BY photo_id, x ORDER BY y)"}
    near = ", ".join(f"coalesce({f}({column}) OVER {w}, {column})" for w in by.values() for f in ("lag", "lead"))
    return f"SELECT photo_id, y, x, {how}({column}, {near}) AS {column} FROM ({inner}) AS c"


def _mask(over: float) -> str:
    return f"SELECT photo_id, y, x, CASE WHEN v > {over}e0 THEN 1 ELSE 0 END AS m FROM ({{raster}}) AS t"


def _sites() -> str:
    return "SELECT photo_id, y, x FROM ({raster}) AS t WHERE v > 0.15e0"


_PIXEL = nest(_samples(), [*pixel_lab_stages(WHITE), *unlab_stages(), *hex_stages()])
_XYZ = nest(f"SELECT photo_id, x AS px, y AS py, r, g, b FROM ({_rgb()}) AS t", xyz_stages())
_NEUTRAL = nest(f"SELECT * FROM ({nest(f'SELECT * FROM ({_XYZ}) AS t WHERE px % 4 = 0 AND py % 4 = 0', [{'even': 'greatest(y, 0.0001e0)'}, {'nx': 'x / even', 'ny': 'y / even', 'nz': 'z / even'}])}) AS t", lab_stages("nx", "ny", "nz", ("nl", "na", "nb")))
# Pixels around each tap; every seventh object of a photo is a tap's place.
_TAPS = "SELECT vec_id {div} 50 AS photo_id, vec_id AS tap, CAST(vec_id * 13 % 70 AS INT) AS tx, CAST(vec_id % 50 AS INT) AS ty, CAST(2 + vec_id % 7 AS INT) AS tr FROM embeddings WHERE vec_id % 7 = 0"
_AROUND = f"SELECT a.photo_id, a.tap, sqrt((p.x - a.tx) * (p.x - a.tx) + (p.y - a.ty) * (p.y - a.ty)) AS far, a.tr, r, g, b FROM ({_TAPS}) AS a JOIN (" + _rgb() + ") AS p ON a.photo_id = p.photo_id AND p.x BETWEEN a.tx - a.tr AND a.tx + a.tr AND p.y BETWEEN a.ty - a.tr AND a.ty + a.tr WHERE (p.x - a.tx) * (p.x - a.tx) + (p.y - a.ty) * (p.y - a.ty) <= a.tr * a.tr"
_TAPPED = f"SELECT tap, far, tr, lab_l AS l, lab_a AS a, lab_b AS b FROM ({nest(_AROUND, pixel_lab_stages(WHITE))}) AS t"
# The samples of a photo for its white, and the white from them.
_WHITE_SAMPLES = f"SELECT photo_id, r, g, b, x, y, z, sqrt(na * na + nb * nb) < 30e0 AS neutral FROM ({_NEUTRAL}) AS s"
_WHITES = "WITH s AS ({samples}), p AS (SELECT photo_id, {pct}(y, 0.98) AS top, count(*) AS n FROM s GROUP BY photo_id), c AS (SELECT s.*, n FROM s JOIN p ON s.photo_id = p.photo_id WHERE neutral AND y >= 0.5e0 * top), q AS (SELECT photo_id, {pct}(y, 0.98) AS top FROM c GROUP BY photo_id HAVING count(*) >= 0.03e0 * max(n)), b AS (SELECT c.* FROM c JOIN q ON c.photo_id = q.photo_id WHERE y BETWEEN 0.8e0 * top AND top), m AS (SELECT photo_id, {pct}(x, 0.5) AS wx, {pct}(y, 0.5) AS wy, {pct}(z, 0.5) AS wz, greatest({pct}(r, 0.5), {pct}(g, 0.5), {pct}(b, 0.5)) >= 250e0 AS clipped FROM b GROUP BY photo_id) SELECT p.photo_id, coalesce(wx, 0.95047e0 * camera) AS wx, coalesce(wy, camera) AS wy, coalesce(wz, 1.08883e0 * camera) AS wz, coalesce(clipped, FALSE) AS clipped, wx IS NOT NULL AS found FROM (SELECT photo_id, least(greatest(top, 0.75e0), 1e0) AS camera FROM p) AS p LEFT JOIN m ON p.photo_id = m.photo_id"
_AUTO_WHITE = "SELECT photo_id, round(wx, 6) AS wx, round(wy, 6) AS wy, round(wz, 6) AS wz, clipped, found FROM ({whites}) AS w"
# The colour of each tap from the pixels around it, in Lab.
_BODY = "WITH d AS ({tapped}), k AS (SELECT tap, {pct}(l, 0.5) AS ml, {pct}(a, 0.5) AS ma, {pct}(b, 0.5) AS mb FROM d WHERE far <= greatest(1.5e0, 0.4e0 * tr) GROUP BY tap), s AS (SELECT d.*, coalesce((l - ml) * (l - ml) + (a - ma) * (a - ma) + (b - mb) * (b - mb) < 900e0, FALSE) AS same FROM d LEFT JOIN k ON d.tap = k.tap), n AS (SELECT tap, sum(CASE WHEN same THEN 1 ELSE 0 END) >= 8 AS narrow FROM s GROUP BY tap), o AS (SELECT s.* FROM s JOIN n ON s.tap = n.tap WHERE same OR NOT narrow), p AS (SELECT tap, {pct}(l, 0.15) AS lo, {pct}(l, 0.85) AS hi, count(*) AS n FROM o GROUP BY tap) SELECT o.tap, round({pct}(l, 0.5), 6) AS l, round({pct}(a, 0.5), 6) AS a, round({pct}(b, 0.5), 6) AS b FROM o JOIN p ON o.tap = p.tap WHERE n < 8 OR l BETWEEN lo AND hi GROUP BY o.tap"
# Each photo's own white as a matrix of nine columns, computed once a photo and joined to the pixels.
_OWN_MATRIX = f"SELECT photo_id, {', '.join(f'm{i}{j}' for i in range(3) for j in range(3))} FROM ({nest('{whites}', balance_stages())}) AS w"
_OWN_TAPPED = f"SELECT tap, far, tr, lab_l AS l, lab_a AS a, lab_b AS b FROM ({nest(f'SELECT t.*, {", ".join(f"m{i}{j}" for i in range(3) for j in range(3))} FROM ({_AROUND}) AS t JOIN ({_OWN_MATRIX}) AS w ON t.photo_id = w.photo_id', balanced_lab_stages())}) AS t"
# Flattened shots with sheets of all kinds: photos take turns with a white sheet, a tap, paper on the left, a white from outside, and none of these over a grey or a red sheet.
_FLAT = f"SELECT *, (x * 7 + y * 3) % 5 = 0 AS bare, photo_id % 5 = 2 AND x < 24 AS surround FROM ({_rgb()}) AS t"
_SHEETS = "SELECT photo_id, CASE WHEN kind = 0 THEN 0.95047e0 WHEN photo_id % 10 = 9 THEN 0.09e0 ELSE 0.05e0 END AS sx, CASE WHEN kind = 0 THEN 1e0 WHEN photo_id % 10 = 9 THEN 0.04e0 ELSE 0.05e0 END AS sy, CASE WHEN kind = 0 THEN 1.08883e0 WHEN photo_id % 10 = 9 THEN 0.01e0 ELSE 0.05e0 END AS sz, CASE WHEN kind = 1 THEN 0.7e0 END AS tx, CASE WHEN kind = 1 THEN 0.72e0 END AS ty, CASE WHEN kind = 1 THEN 0.6e0 END AS tz, CASE WHEN kind = 3 THEN 0.3e0 END AS ox, CASE WHEN kind = 3 THEN 0.31e0 END AS oy, CASE WHEN kind = 3 THEN 0.25e0 END AS oz FROM (SELECT DISTINCT vec_id {div} 50 AS photo_id, vec_id {div} 50 % 5 AS kind FROM embeddings) AS p"
_REFERENCE_WHITE = (whites.pixels(_FLAT), whites.levels(_SHEETS))
_PLACES = "SELECT photo_id, v0, v1, v2, 2e0 * x / 64e0 - 1e0 AS u, 2e0 * y / 50e0 - 1e0 AS w FROM ({rgb}) AS t WHERE x % 6 = 0 AND y % 6 = 0"
_SUMS = ", ".join([*(f"round(sum(({surface.TERMS[i]}) * ({surface.TERMS[j]})), 6) AS a{i}{j}" for i in range(6) for j in range(i, 6)), *(f"round(sum(({t}) * v{k}), 6) AS b{i}{k}" for i, t in enumerate(surface.TERMS) for k in range(3))])
_COEFFICIENTS = ", ".join(f"round({c}, 5) AS {c}" for c in surface.COEFFICIENTS)
_KNOWN_SITES = "SELECT a.photo_id, a.y, a.x, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM ({raster}) AS a JOIN (" + _sites() + ") AS b ON a.photo_id = b.photo_id GROUP BY a.photo_id, a.y, a.x"
_LABELS_SQL = "WITH RECURSIVE s AS (" + _sites() + "), r AS (SELECT photo_id, y, x, y * 64 + x AS seed FROM s UNION SELECT s.photo_id, s.y, s.x, r.seed FROM r JOIN s ON s.photo_id = r.photo_id AND abs(s.y - r.y) + abs(s.x - r.x) = 1), l AS (SELECT photo_id, y, x, min(seed) AS seed FROM r GROUP BY photo_id, y, x) SELECT photo_id, y, x, CAST(dense_rank() OVER (PARTITION BY photo_id ORDER BY seed) AS INT) AS label FROM l"



def _moments(labels: str) -> str:
    """Ellipse of each object from its moments; ry is never under one pixel."""
    return f"SELECT photo_id, label, area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(greatest(2e0 * (sxx + syy + root), 0e0)), 5) AS rx, round(sqrt(greatest(2e0 * (sxx + syy - root), 1e0)), 5) AS ry, round(CASE WHEN abs(sxy) < 1e-9 THEN CASE WHEN sxx >= syy - 1e-9 THEN 0e0 ELSE 90e0 END ELSE 0.5e0 * degrees(atan2(2e0 * sxy, sxx - syy)) END, 5) AS angle FROM (SELECT *, sqrt((sxx - syy) * (sxx - syy) + 4e0 * sxy * sxy) AS root FROM (SELECT photo_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, avg(CAST(x * x AS DOUBLE)) - avg(x) * avg(x) AS sxx, avg(CAST(y * y AS DOUBLE)) - avg(y) * avg(y) AS syy, avg(CAST(x * y AS DOUBLE)) - avg(x) * avg(y) AS sxy FROM ({labels}) AS s GROUP BY photo_id, label) AS m) AS m"


# Rainbow order: neutrals last, light to dark.
_HUES = f"SELECT flavor, CASE WHEN round(c, 9) < 10e0 THEN 1 ELSE 0 END AS grey, CASE WHEN round(c, 9) < 10e0 THEN -round(fl, 9) ELSE round(CASE WHEN h < 0e0 THEN h + 360e0 ELSE h END, 9) END AS hue FROM (SELECT *, sqrt(fa * fa + fb * fb) AS c, degrees(atan2(fb, fa)) AS h FROM ({_flavors()}) AS f) AS f"
# A difference under 7 needs lightnesses within 7 times 1.75, the most that lightness is divided by.
_HINT, _BIN = "7e0", "12.25e0"
_NEAR_COSTS = nest(f"SELECT f.*, p.* FROM (SELECT *, explode(sequence(CAST(floor(fl / {_BIN}) AS INT) - 1, CAST(floor(fl / {_BIN}) AS INT) + 1)) AS f_bin FROM ({_flavors()}) AS f) AS f JOIN (SELECT *, CAST(floor(pl / {_BIN}) AS INT) AS p_bin FROM ({_papers()}) AS p) AS p ON f_bin = p_bin", ciede2000_stages(("fl", "fa", "fb"), ("pl", "pa", "pb"), 1.0))
_NEAREST = "SELECT paper, min_by(flavor, delta_e) AS flavor, round(min(delta_e), 6) AS delta_e FROM ({costs}) AS c GROUP BY paper HAVING min(delta_e) < " + _HINT

TEXTS: dict[str, str] = {
    "pixel_to_lab": f"SELECT seq, round(lab_l, 6) AS l, round(lab_a, 6) AS a, round(lab_b, 6) AS b FROM ({_PIXEL}) AS p",
    "lab_to_hex": f"SELECT seq, h_r, h_g, h_b, {{hexed}} AS hex FROM ({_PIXEL}) AS p",
    "lab_roundtrip": f"SELECT seq, round(abs(ux - x) + abs(uy - y) + abs(uz - z), 9) AS gap FROM ({_PIXEL}) AS p",
    "ciede2000_pairs": f"SELECT flavor, paper, round(delta_e, 6) AS delta_e FROM ({_costs(1.0)}) AS c",
    "flavor_rollup": f"SELECT flavor, label, round(fl, 6) AS l, round(fa, 6) AS a, round(fb, 6) AS b, samples, first_seq FROM ({_flavors()}) AS f",
    "hue_order": f"SELECT flavor, row_number() OVER (ORDER BY grey, hue, flavor) AS place FROM ({_HUES}) AS h",
    "match_alternates_top5": f"SELECT flavor, paper, place, round(delta_e, 6) AS delta_e FROM (SELECT *, row_number() OVER (PARTITION BY flavor ORDER BY delta_e, paper) AS place FROM ({_costs()}) AS c WHERE available) AS r WHERE place <= 5",
    "nearest_flavor_hint": _NEAREST.replace("{costs}", _costs(1.0)),
    # The words of the bands.
    "verdict_bands": f"SELECT flavor, paper, CASE WHEN delta_e <= 2e0 THEN 'near-identical' WHEN delta_e <= 5e0 THEN 'close' WHEN delta_e <= 10e0 THEN 'noticeably off' ELSE 'poor' END AS match_band, CASE WHEN delta_e < 2e0 THEN 'too close to trust' WHEN delta_e < 4e0 THEN 'subtle but measurable' WHEN delta_e < 8e0 THEN 'clear' ELSE 'obvious' END AS separation_band FROM ({_costs(1.0)}) AS c",
    "suggestions": "SELECT label, place FROM (SELECT label, row_number() OVER (ORDER BY CASE WHEN lower(label) LIKE 'r%' THEN 0 ELSE 1 END, first_seq) AS place FROM (SELECT p_name AS label, min(p_partkey) AS first_seq FROM part GROUP BY p_name) AS f WHERE lower(label) LIKE '%r%') AS s WHERE place <= 12",
    "auto_white": _AUTO_WHITE.replace("{whites}", _WHITES.replace("{samples}", _WHITE_SAMPLES)),
    # Casings of marks: light on a dark shot, whose median lightness is under 50.
    "casing_colour": f"SELECT photo_id, CASE WHEN {{pct}}(lab_l, 0.5) < 50e0 THEN 'light' ELSE 'dark' END AS casing FROM ({nest(f'SELECT photo_id, r, g, b FROM ({_rgb()}) AS t', pixel_lab_stages(WHITE))}) AS p GROUP BY photo_id",
    "reference_white": whites.reference_white(*_REFERENCE_WHITE, whites.SORTED),
    "dominant_colour": f"SELECT photo_id, br, bg, bb, n FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY n DESC, br, bg, bb) AS place FROM (SELECT photo_id, CAST(floor(r / 8e0) AS INT) AS br, CAST(floor(g / 8e0) AS INT) AS bg, CAST(floor(b / 8e0) AS INT) AS bb, count(*) AS n FROM ({_rgb()}) AS t GROUP BY photo_id, floor(r / 8e0), floor(g / 8e0), floor(b / 8e0)) AS h) AS o WHERE place = 1",
    "sample_at_tap": _BODY.replace("{tapped}", _TAPPED),
    "sample_with_own_white": _BODY.replace("{tapped}", _OWN_TAPPED.replace("{whites}", f"SELECT * FROM ({_WHITES.replace('{samples}', _WHITE_SAMPLES)}) AS w")),
    # The white under each tap, and each photo's white lent by the photo before it: raised if something here is brighter.
    "tap_whites": f"SELECT tap, round({{pct}}(x, 0.5), 6) AS wx, round({{pct}}(y, 0.5), 6) AS wy, round({{pct}}(z, 0.5), 6) AS wz, greatest({{pct}}(r, 0.5), {{pct}}(g, 0.5), {{pct}}(b, 0.5)) >= 250e0 AS clipped FROM ({nest(_AROUND, xyz_stages())}) AS t GROUP BY tap",
    "borrowed_whites": f"SELECT t.photo_id, w.photo_id AS lender, round(wx * raise, 6) AS wx, round(wy * raise, 6) AS wy, round(wz * raise, 6) AS wz FROM (SELECT p.photo_id, w.photo_id AS lender, greatest(wy, least(top, 1e0)) / wy AS raise FROM (SELECT photo_id, {{pct}}(y, 0.98) AS top FROM ({_WHITE_SAMPLES}) AS s GROUP BY photo_id) AS p JOIN ({{whites}}) AS w ON w.photo_id = p.photo_id - 1) AS t JOIN ({{whites}}) AS w ON w.photo_id = t.lender".replace("{whites}", f"SELECT * FROM ({_WHITES.replace('{samples}', _WHITE_SAMPLES)}) AS w"),
    "photo_whites": _AUTO_WHITE.replace("{whites}", _WHITES.replace("{samples}", _WHITE_SAMPLES)),
    "tap_colours": _BODY.replace("{tapped}", _OWN_TAPPED.replace("{whites}", f"SELECT * FROM ({_WHITES.replace('{samples}', _WHITE_SAMPLES)}) AS w")),
    "borrowed_white_asof": "SELECT a.event_id, max({'t': b.ts, 'e': b.event_id}).e AS lender FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id <> a.event_id AND b.ts <= a.ts AND a.ts < b.ts + INTERVAL '2' HOUR AND b.event_type IN ('view', 'click') GROUP BY a.event_id",
    "erode": _cross(_mask(-0.1), "m", "least"),
    "opening": _cross(_cross(_cross(_cross(_mask(-0.1), "m", "least"), "m", "least"), "m", "greatest"), "m", "greatest"),
    "dilate": f"SELECT photo_id, y, x, max(m) OVER (PARTITION BY photo_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM (SELECT photo_id, y, x, max(m) OVER (PARTITION BY photo_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM ({_mask(0.15)}) AS t) AS t",
    "distance_transform": _KNOWN_SITES,
    "nearest_seed": "SELECT photo_id, y, x, min(best).d AS d2, min(best).y AS site_y, min(best).x AS site_x FROM (SELECT a.photo_id, a.y, a.x, {'d': (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 'x': b.x, 'y': b.y} AS best FROM ({raster}) AS a JOIN (" + _sites() + ") AS b ON a.photo_id = b.photo_id) AS n GROUP BY photo_id, y, x",
    "every_16th_pixel": f"SELECT photo_id, y, x FROM (SELECT photo_id, y, x, row_number() OVER (PARTITION BY photo_id ORDER BY y, x) - 1 AS place FROM ({_mask(-0.1)}) AS m WHERE m = 1) AS p WHERE place % 16 = 0",
    "components": _LABELS_SQL,
    "components_tiled": _LABELS_SQL,
    "component_boxes": f"SELECT photo_id, label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, (min(x) = 0 OR min(y) = 0 OR max(x) = 63 OR max(y) = 49) AS on_edge, (min(x) = 0 OR min(y) = 0 OR max(x) = 63 OR max(y) = 49) AND (max(x) - min(x) + 1 > 16 OR max(y) - min(y) + 1 > 12.5e0) AS hugging FROM ({_LABELS_SQL}) AS l GROUP BY photo_id, label",
    "object_moments": _moments(_LABELS_SQL),
    "surface_fit_sums": f"SELECT photo_id, {_SUMS} FROM ({_PLACES}) AS t GROUP BY photo_id",
    "surface_fit": f"SELECT photo_id, {_COEFFICIENTS} FROM ({surface.fit_text(_PLACES)}) AS f",
    "surface_fit_robust": f"SELECT photo_id, {_COEFFICIENTS} FROM ({surface.robust_text(_PLACES)}) AS f",
    "silhouette": "WITH o AS (SELECT photo_id, object_id, grp, 0.7e0 * lab_l AS l, lab_a AS a, lab_b AS b FROM (" + _objects() + ") AS o), n AS (SELECT photo_id, grp, count(*) AS size FROM o GROUP BY photo_id, grp), d AS (SELECT p.photo_id, p.object_id, p.grp, q.grp AS other, sum(sqrt((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))) AS total FROM o p JOIN o q ON p.photo_id = q.photo_id GROUP BY p.photo_id, p.object_id, p.grp, q.grp), m AS (SELECT d.photo_id, d.object_id, max(CASE WHEN other = d.grp AND size > 1 THEN total / greatest(size - 1, 1) END) AS own, min(CASE WHEN other <> d.grp THEN total / size END) AS near FROM d JOIN n ON d.photo_id = n.photo_id AND d.other = n.grp GROUP BY d.photo_id, d.object_id) SELECT photo_id, round(avg(coalesce((near - own) / greatest(own, near, 1e-12), 0e0)), 6) AS score FROM m GROUP BY photo_id",
    "group_separation": "WITH o AS (" + _objects() + "), c AS (SELECT photo_id, grp, {pct}(lab_l, 0.5) AS l, {pct}(lab_a, 0.5) AS a, {pct}(lab_b, 0.5) AS b FROM o GROUP BY photo_id, grp) SELECT photo_id, round(min(delta_e), 6) AS separation FROM (" + nest("SELECT p.photo_id, p.l AS l1, p.a AS a1, p.b AS b1, q.l AS l2, q.a AS a2, q.b AS b2 FROM c p JOIN c q ON p.photo_id = q.photo_id AND p.grp < q.grp", ciede2000_stages(("l1", "a1", "b1"), ("l2", "a2", "b2"))) + ") AS s GROUP BY photo_id",
    "colour_covariance": "SELECT photo_id, round(covar_samp(lab_l, lab_l), 5) AS ll, round(covar_samp(lab_l, lab_a), 5) AS la, round(covar_samp(lab_l, lab_b), 5) AS lb, round(covar_samp(lab_a, lab_a), 5) AS aa, round(covar_samp(lab_a, lab_b), 5) AS ab, round(covar_samp(lab_b, lab_b), 5) AS bb FROM (" + _objects() + ") AS o GROUP BY photo_id",
}

TEXTS |= display.TEXTS


def _filled(text: str, dialect: dict[str, str]) -> str:
    for i in (1, 2, 3):
        text = text.replace(f"{{e{i}}}", dialect["at"].format(i))
    for key in ("raster", "rgb", "key", "hexed", "div", "pct"):
        text = text.replace(f"{{{key}}}", dialect[key])
    return text


def run(spark: SparkSession, sf_dir: str, text: str, **others: DataFrame) -> DataFrame:
    """``text`` over the tables it names and ``others`` in braces, without leaving views behind."""
    text = _filled(text, SPARK)
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in text or f"JOIN {t}" in text}
    for t in named:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **named, **others)


#: Derived photos as rows with their bytes, and as smoothed ones that show spots. A photo is as high as its last line; if others are missing, ``lines`` has those that are there.
_BYTES = "SELECT photo_id, 64 AS width, CAST(max(y) + 1 AS INT) AS height, 'sRGB' AS space, CASE WHEN size(collect_set(y)) <= max(y) THEN array_sort(collect_set(y)) END AS lines, unhex(array_join(transform(array_sort(collect_list(struct(y, x, h))), p -> p.h), '')) AS rgb FROM (SELECT photo_id, y, x, concat(lpad(hex(CAST(r AS INT)), 2, '0'), lpad(hex(CAST(g AS INT)), 2, '0'), lpad(hex(CAST(b AS INT)), 2, '0')) AS h FROM ({photo}) AS p) AS p GROUP BY photo_id"


def photos(spark: SparkSession, sf_dir: str, smooth: bool = False) -> DataFrame:
    """The derived photos (see ``operators.measure``)."""
    text = "SELECT photo_id, y, x, red AS r, green AS g, blue AS b FROM (" + _CHAIN[0].text + ") AS p" if smooth else _rgb()
    return run(spark, sf_dir, _BYTES.replace("{photo}", text))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.analyse_photos(photos(spark, sf_dir, True)).select("photo_id", "status", F.size("beans").alias("beans"), F.size("clumps").alias("clumps"), "white_paper", "calibrated", "suggested", F.expr("transform(sheet, v -> round(v, 3))").alias("sheet"))


def _beans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.analyse_photos(photos(spark, sf_dir, True)).select("photo_id", "suggested", "partitions", F.posexplode("beans").alias("bean", "of")).select("photo_id", "bean", "of.*", F.expr("element_at(filter(partitions, p -> p.k = suggested), 1).assignment[bean]").alias("grp"))


def _whites(spark: SparkSession, sf_dir: str) -> DataFrame:
    whites = measure.measure_whites(photos(spark, sf_dir)).where("white IS NOT NULL")  # a photo without any pixel for it has none
    return whites.select("photo_id", *(F.round(F.col("white")[i], 6).alias(f"w{c}") for i, c in enumerate("xyz")), "clipped", "found")


def _taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    taps = run(spark, sf_dir, f"SELECT tap AS id, photo_id, CAST(tx AS DOUBLE) AS x, CAST(ty AS DOUBLE) AS y, CAST(tr AS DOUBLE) AS r FROM ({_TAPS}) AS t")
    lab = measure.measure_taps(photos(spark, sf_dir).withColumn("white", F.lit(None).cast("array<double>")), taps)
    return lab.select(F.col("id").alias("tap"), *(F.round(F.col("lab")[i], 6).alias(c) for i, c in enumerate("lab")))


def _measured_flavors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``_flavors``, written once. The first label is looked up afterwards: a text among the aggregates makes Spark sort all samples of a task."""
    flavors = checkpointed(run(spark, sf_dir, _flavors()).select("flavor", "fl", "fa", "fb", "samples", "first_seq"))
    samples = f"SELECT seq, label, {{key}} AS flavor FROM ({_samples()}) AS s"
    first = run(spark, sf_dir, f"SELECT f.flavor, min(label) AS label FROM ({samples}) AS s JOIN {{flavors}} AS f ON s.seq = f.first_seq AND s.flavor <=> f.flavor GROUP BY f.flavor", flavors=flavors)
    return checkpointed(spark.sql("SELECT f.flavor, label, fl, fa, fb, samples, first_seq FROM {flavors} AS f LEFT JOIN {first} AS l ON f.flavor <=> l.flavor", flavors=flavors, first=first))


def _dealt_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``_costs``, made by tasks of about ``TASK_PAIRS`` pairs each: the larger side is dealt out by its key, so that equal pairs meet without another shuffle. The text's few flavours lie in one task, which would make all pairs."""
    flavors, papers = _measured_flavors(spark, sf_dir), checkpointed(run(spark, sf_dir, _papers()))
    f, p = flavors.count(), papers.count()
    dealt = max(spark.sparkContext.defaultParallelism, -(-f * p // TASK_PAIRS))
    few, many, key = ("f", "p", "paper") if f <= p else ("p", "f", "flavor")
    sides = {"f": flavors, "p": papers}
    sides = {few: F.broadcast(sides[few]) if min(f, p) <= BROADCAST_ROWS else sides[few], many: sides[many].repartition(dealt, key)}
    pairs = f"SELECT f.*, p.* FROM {{{many}}} AS {many} CROSS JOIN {{{few}}} AS {few}"
    return spark.sql(nest(pairs, ciede2000_stages(("fl", "fa", "fb"), ("pl", "pa", "pb"), 2.0)), **sides)


def _assignment_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = _dealt_costs(spark, sf_dir).where("available").select(F.lit(0).cast("long").alias("project"), "flavor", "paper", "delta_e")
    return assignment.assign_projects(costs).select("project", "flavor", "paper", "delta_e")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole table; without SQL, as the assignment has none."""
    available = run(spark, sf_dir, f"SELECT count(*) AS available FROM ({_papers()}) AS p WHERE available")
    return assignment.summarise(_assignment_full(spark, sf_dir), available)


def _locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match under the locks of FIXTURES.md: the first two flavours to the two lowest sheets."""
    project = F.lit(0).cast("long").alias("project")
    flavors = run(spark, sf_dir, _flavors()).select(project, F.col("first_seq").alias("ord"), "flavor", "label")
    costs = _dealt_costs(spark, sf_dir).select(project, "flavor", "paper", "available", "delta_e")
    first = "SELECT f.flavor, p.paper FROM (SELECT flavor, row_number() OVER (ORDER BY flavor) AS i FROM (SELECT DISTINCT {key} AS flavor FROM (SELECT p_name AS label FROM part) AS n ORDER BY flavor LIMIT 2) AS d) AS f JOIN (SELECT paper, row_number() OVER (ORDER BY paper) AS i FROM (SELECT s_suppkey AS paper FROM supplier ORDER BY s_suppkey LIMIT 2) AS t) AS p ON f.i = p.i"
    matched = assignment.match_projects(flavors, costs, run(spark, sf_dir, first).select(project, "flavor", "paper"))
    return matched.select("flavor", "paper", F.round("delta_e", 6).alias("delta_e"), "locked", F.expr("transform(alternates, a -> named_struct('paper', a.paper, 'delta_e', round(a.delta_e, 6), 'taken_by', a.taken_by))").alias("alternates"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.components(run(spark, sf_dir, _sites()))


def _tiled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with frames cut into tiles of 16 x 16."""
    return raster.components(run(spark, sf_dir, _sites()), tile=16)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.nearest_seeds(run(spark, sf_dir, "SELECT photo_id, y, x, v > 0.15e0 AS site FROM ({raster}) AS t"))


def _every_16th(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.every_nth(run(spark, sf_dir, f"SELECT photo_id, y, x FROM ({_mask(-0.1)}) AS m WHERE m = 1"), 16)


def _over(spark: SparkSession, sf_dir: str, text: str, name: str, inner: str, **others: DataFrame) -> DataFrame:
    """``text`` over the rows of ``inner``, which are computed once and written, as the text reads them several times."""
    once = checkpointed(run(spark, sf_dir, inner, **others))
    return run(spark, sf_dir, text.replace(f"{{{name}}}", f"SELECT * FROM {{{name}}}"), **{name: once})


def _whites_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, _WHITES, "samples", _WHITE_SAMPLES)


def _auto_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_AUTO_WHITE.replace("({whites})", "{whites}"), whites=_whites_of(spark, sf_dir))


def _hue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(run(spark, sf_dir, _HUES), ["grey", "hue", "flavor"], "place").select("flavor", "place")


def _hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _NEAREST.replace("{costs}", _NEAR_COSTS))


def _reference_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, whites.reference_white("{shots}", _REFERENCE_WHITE[1], whites.BY_BINS), "shots", _REFERENCE_WHITE[0])


def _robust_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, f"SELECT photo_id, {_COEFFICIENTS} FROM ({surface.robust_text('{points}')}) AS f", "points", _PLACES)


def _borrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and whites are computed once."""
    samples = checkpointed(run(spark, sf_dir, _WHITE_SAMPLES))
    whites = checkpointed(spark.sql(_filled(_WHITES.replace("{samples}", "SELECT * FROM {samples}"), SPARK), samples=samples))
    text = "SELECT p.photo_id, w.photo_id AS lender, round(wx * raise, 6) AS wx, round(wy * raise, 6) AS wy, round(wz * raise, 6) AS wz FROM (SELECT photo_id, percentile(y, 0.98) AS top FROM {samples} GROUP BY photo_id) AS p JOIN {whites} AS w ON w.photo_id = p.photo_id - 1 CROSS JOIN LATERAL (SELECT greatest(wy, least(top, 1e0)) / wy AS raise) AS r"
    return spark.sql(text, samples=samples, whites=whites)


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, _BODY, "tapped", _TAPPED)


def _sample_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, _BODY, "tapped", _OWN_TAPPED.replace("{whites}", "SELECT * FROM {whites}"), whites=_whites_of(spark, sf_dir))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = (F.min("x") == 0) | (F.min("y") == 0) | (F.max("x") == 63) | (F.max("y") == 49)
    long = (F.max("x") - F.min("x") + 1 > 0.25 * 64) | (F.max("y") - F.min("y") + 1 > 0.25 * 50)
    return _labels(spark, sf_dir).groupBy("photo_id", "label").agg(F.count("*").alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), edge.alias("on_edge"), (edge & long).alias("hugging"))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_moments("SELECT * FROM {labels}"), labels=_labels(spark, sf_dir))


def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.distances(run(spark, sf_dir, "SELECT photo_id, y, x, v > 0.15e0 AS site FROM ({raster}) AS t"))


def _lender(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of lookup with one window over each user's events: the newest measured one up to now, itself left out.

    Of events at one instant the one with the larger id counts as newer. Only the two newest up to an instant can be the answer.
    """
    seen = "CASE WHEN event_type IN ('view', 'click') THEN struct(ts, event_id) END"
    text = f"""
        WITH own AS (SELECT event_id, user_id, ts, max({seen}) OVER (PARTITION BY user_id ORDER BY ts) AS newest, max({seen}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
        SELECT event_id, lender.event_id AS lender FROM (SELECT event_id, ts, CASE WHEN newest.event_id = event_id THEN before ELSE newest END AS lender FROM own) AS e WHERE ts < lender.ts + INTERVAL '2' HOUR"""
    return run(spark, sf_dir, text)


#: Spark's own plan where it isn't the text; without a text beside it, SQL can't state the result.
OWN: dict[str, Query] = {"surface_fit_robust": _robust_surface, "borrowed_whites": _borrowed, "hue_order": _hue_order, "nearest_flavor_hint": _hints, "reference_white": _reference_white, "auto_white": _auto_white, "sample_at_tap": _sample, "sample_with_own_white": _sample_own, "nearest_seed": _seeds, "every_16th_pixel": _every_16th, "components_tiled": _tiled_labels, "components": _labels, "component_boxes": _boxes, "object_moments": _shapes, "distance_transform": _distance, "borrowed_white_asof": _lender, "match_assignment_full": _assignment_full, "match_summary": _summary, "match_locked": _locked, "photo_whites": _whites, "tap_colours": _taps, "analyse_photos": _analysed, "photo_objects": _beans}


TEXTS |= grouping.texts(_objects())
_CHAIN = segmentation.steps("SELECT photo_id, y, x, v0, v1, v2 FROM ({rgb}) AS t", WHITE)
OWN |= segmentation.queries(run, _CHAIN)
OWN |= matching.queries(run, _dealt_costs) | grouping.queries(run, _objects(), lambda text: _filled(text, SPARK))


def queries() -> dict[str, Query]:
    plain = {name: (lambda spark, sf_dir, text=text: run(spark, sf_dir, text)) for name, text in TEXTS.items()}
    return plain | OWN


def oracle_sql() -> dict[str, str]:
    return {name: _filled(text, DUCK) for name, text in (TEXTS | matching.oracle_sql(_costs()) | grouping.oracle_sql(_objects()) | segmentation.oracle_sql(_CHAIN)).items()}
