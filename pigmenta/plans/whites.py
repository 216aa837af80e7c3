"""The white against which a flattened shot is measured, by the first of five rules that holds, as text for both engines.

In order: the sheet itself, if it is neutral and nothing sizeable outshines it; the tapped white; paper around the sheet; a white from
outside, raised if something here is brighter; the sheet's tint if neutral, else the camera's, at the level of the brightest sizeable thing.

That level is a rank: the luminance at 2 % of the frame, counted from above. Spark counts bins of luminance first and sorts only
the bin that holds the rank; the text for DuckDB sorts the photo.
"""

from __future__ import annotations

import numpy as np

from pigmenta.functions.color import BRADFORD, D65, TO_XYZ, lab_stages, linear, nest, num

# What outshines the sheet, what is sizeable, the rank's share, chroma of a neutral, least level of the camera's white.
BRIGHTER, SIZEABLE, RANK, NEUTRAL, FLOOR = "1.25e0", "0.01e0", "0.02e0", "30e0", "0.75e0"
_CONE = BRADFORD @ TO_XYZ["sRGB"]
_GREY = BRADFORD @ D65


def _row(values: np.ndarray, names: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"{num(v)} * {n}" for v, n in zip(values, names, strict=True)) + ")"


def _neutral(source: str, x: str, y: str, z: str) -> str:
    """``source`` with ``chroma``, brightness divided out."""
    evened = nest(source, [{"even": f"greatest({y}, 0.0001e0)"}, {"ex": f"{x} / even", "ey": f"{y} / even", "ez": f"{z} / even"}])
    return nest(f"SELECT * FROM ({evened}) AS e", [*lab_stages("ex", "ey", "ez", ("nl", "na", "nb")), {"chroma": "sqrt(na * na + nb * nb)"}])


def pixels(rgb: str) -> str:
    """Every fourth pixel each way of ``rgb`` (photo_id, x, y, r, g, b, bare, surround): cones, luminance and chroma."""
    lights = nest(f"SELECT photo_id, bare, surround, r, g, b FROM ({rgb}) AS t WHERE x % 4 = 0 AND y % 4 = 0", [{f"lin_{c}": linear(c) for c in "rgb"}, {**{c: _row(v, ("lin_r", "lin_g", "lin_b")) for c, v in zip("xyz", TO_XYZ["sRGB"], strict=True)}, **{f"c{i}": _row(v, ("lin_r", "lin_g", "lin_b")) for i, v in enumerate(_CONE)}}])
    return f"SELECT photo_id, bare, surround, c0, c1, c2, y AS shine, chroma FROM ({_neutral(lights, 'x', 'y', 'z')}) AS n"


def levels(sheets: str) -> str:
    """``sheets`` (photo_id and XYZ of the sheet's level sx.., of a tapped white tx.. and of one from outside ox.., null if there is none) in cones."""
    cones = ", ".join(f"{_row(v, tuple(f'{p}{c}' for c in 'xyz'))} AS {p}{i}" for p in "sto" for i, v in enumerate(BRADFORD))
    return f"SELECT photo_id, sy, oy, chroma < {NEUTRAL} AS grey, {cones} FROM ({_neutral(f'SELECT * FROM ({sheets}) AS s', 'sx', 'sy', 'sz')}) AS n"


#: The luminance of rank k (from 0) of photos in ``f``: sorted, and by counts of bins with a sort of one bin.
SORTED = "ranked AS (SELECT photo_id, shine FROM (SELECT n.photo_id, shine, k, row_number() OVER (PARTITION BY n.photo_id ORDER BY shine DESC) - 1 AS seat FROM n JOIN f ON f.photo_id = n.photo_id) AS r WHERE seat = k)"
BY_BINS = (
    "h AS (SELECT photo_id, CAST(floor(shine * 256e0) AS INT) AS bin, count(*) AS many FROM n GROUP BY photo_id, CAST(floor(shine * 256e0) AS INT)), "
    "u AS (SELECT photo_id, bin, many, sum(many) OVER (PARTITION BY photo_id ORDER BY bin DESC) - many AS above FROM h), "
    "hit AS (SELECT u.photo_id, bin, k - above AS place FROM u JOIN f ON f.photo_id = u.photo_id WHERE above <= k AND k < above + many), "
    "ranked AS (SELECT photo_id, shine FROM (SELECT n.photo_id, shine, place, row_number() OVER (PARTITION BY n.photo_id ORDER BY shine DESC) - 1 AS seat FROM n JOIN hit ON hit.photo_id = n.photo_id AND hit.bin = CAST(floor(shine * 256e0) AS INT)) AS r WHERE seat = place)"
)


def reference_white(px: str, lv: str, ranked: str) -> str:
    """A row a photo: which rule holds (1 to 5), the white in cones, whether the sheet is white, whether the white was seen or tapped."""
    median = lambda name, source: f"{name} AS (SELECT n.photo_id, {', '.join(f'{{pct}}(c{i}, 0.5) AS {name}{i}' for i in range(3))} FROM {source} GROUP BY n.photo_id)"
    raised = [f"o{i} * (greatest(oy, brightest) / oy)" for i in range(3)]
    tint = [f"(CASE WHEN grey THEN s{i} ELSE {num(v)} END) * (greatest(brightest, {FLOOR}) / (CASE WHEN grey THEN sy ELSE {num(D65[1])} END))" for i, v in enumerate(_GREY)]
    white = lambda i: f"CASE rule WHEN 1 THEN s{i} WHEN 2 THEN t{i} WHEN 3 THEN coalesce(band{i}, around{i}) WHEN 4 THEN {raised[i]} ELSE {tint[i]} END"
    return f"""
WITH px AS ({px}), lv AS ({lv}),
n AS (SELECT px.*, shine > {BRIGHTER} * sy AS over, shine > {BRIGHTER} * sy AND surround AND chroma < {NEUTRAL} AS paper FROM px JOIN lv ON lv.photo_id = px.photo_id WHERE NOT bare),
f AS (SELECT photo_id, count(*) AS frame, CAST(floor({RANK} * count(*)) AS BIGINT) AS k FROM px GROUP BY photo_id),
a AS (SELECT photo_id, sum(CASE WHEN over THEN 1 ELSE 0 END) AS overs, sum(CASE WHEN paper THEN 1 ELSE 0 END) AS papers FROM n GROUP BY photo_id),
top AS (SELECT photo_id, {{pct}}(shine, 0.98) AS top FROM n WHERE paper GROUP BY photo_id),
{median('band', 'n JOIN top ON top.photo_id = n.photo_id WHERE paper AND shine BETWEEN 0.8e0 * top AND top')},
{median('around', 'n WHERE paper')},
{ranked},
b AS (SELECT lv.*, frame, coalesce(overs, 0) AS overs, coalesce(papers, 0) AS papers, least(greatest(coalesce(shine, sy), sy), 1e0) AS brightest FROM lv JOIN f ON f.photo_id = lv.photo_id LEFT JOIN a ON a.photo_id = lv.photo_id LEFT JOIN ranked ON ranked.photo_id = lv.photo_id),
r AS (SELECT *, CASE WHEN grey AND overs < {SIZEABLE} * frame THEN 1 WHEN t0 IS NOT NULL THEN 2 WHEN papers > 0 AND papers >= {SIZEABLE} * frame / 2e0 THEN 3 WHEN o0 IS NOT NULL THEN 4 ELSE 5 END AS rule FROM b)
SELECT r.photo_id, rule, {', '.join(f'round({white(i)}, 6) AS white{i}' for i in range(3))}, rule = 1 AS white_sheet, rule <= 3 AS calibrated FROM r LEFT JOIN band ON band.photo_id = r.photo_id LEFT JOIN around ON around.photo_id = r.photo_id"""
