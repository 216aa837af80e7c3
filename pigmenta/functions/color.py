"""Colour arithmetic as SQL expressions, so that one text serves ``F.expr``, ``spark.sql`` and other SQL engines.

Each function returns stages: dictionaries of new column name to expression, where a stage may use the columns of
those before it. ``nest`` turns them into nested selects, ``apply`` into projections of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = dict[str, str]

# Published matrices of linear RGB to XYZ, of cone adaptation, and the D65 white.
TO_XYZ = {
    "sRGB": np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]),
    "displayP3": np.array([[0.4865709, 0.2656677, 0.1982173], [0.2289746, 0.6917385, 0.0792869], [0.0, 0.0451134, 1.0439444]]),
}
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
D65 = np.array([0.95047, 1.0, 1.08883])
WHITE_Y = 0.90
KNEE = 6 / 29


def num(x: float) -> str:
    """A double literal in every dialect."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def _dot(row: Iterable[float], names: Iterable[str]) -> str:
    return "(" + " + ".join(f"{num(c)} * {n}" for c, n in zip(row, names, strict=True)) + ")"


def adaptation(white: Iterable[float]) -> np.ndarray:
    """Matrix that takes ``white`` (XYZ) to ``WHITE_Y`` times D65 in cone space."""
    gain = (BRADFORD @ (D65 * WHITE_Y)) / (BRADFORD @ np.asarray(list(white)))
    return np.linalg.inv(BRADFORD) @ np.diag(gain) @ BRADFORD


def linear(c: str) -> str:
    """8-bit value with the sRGB curve to linear light."""
    v = f"({c} / 255e0)"
    return f"(CASE WHEN {v} <= 0.04045e0 THEN {v} / 12.92e0 ELSE pow(({v} + 0.055e0) / 1.055e0, 2.4e0) END)"


def _f(t: str) -> str:
    return f"(CASE WHEN {t} > {num(KNEE**3)} THEN cbrt({t}) ELSE {t} / {num(3 * KNEE**2)} + {num(4 / 29)} END)"


def _f_inverse(t: str) -> str:
    return f"(CASE WHEN {t} > {num(KNEE)} THEN {t} * {t} * {t} ELSE {num(3 * KNEE**2)} * ({t} - {num(4 / 29)}) END)"


def xyz_stages(space: str = "sRGB", white: Iterable[float] | None = None, rgb: tuple[str, str, str] = ("r", "g", "b")) -> list[Stage]:
    """8-bit channels to x, y, z; balanced if ``white`` is given. Constant matrices are folded here, once."""
    m = TO_XYZ[space] if white is None else adaptation(white) @ TO_XYZ[space]
    names = ("lin_r", "lin_g", "lin_b")
    return [dict(zip(names, map(linear, rgb), strict=True)), {k: _dot(row, names) for k, row in zip("xyz", m, strict=True)}]


def lab_stages(x: str = "x", y: str = "y", z: str = "z", out: tuple[str, str, str] = ("lab_l", "lab_a", "lab_b")) -> list[Stage]:
    scaled = {f"f{k}": _f(f"({c} / {num(w)})") for k, c, w in zip("xyz", (x, y, z), D65, strict=True)}
    return [scaled, dict(zip(out, ("116e0 * fy - 16e0", "500e0 * (fx - fy)", "200e0 * (fy - fz)"), strict=True))]


def pixel_lab_stages(white: Iterable[float], space: str = "sRGB") -> list[Stage]:
    return [*xyz_stages(space, white), *lab_stages()]


def balance_stages(white: tuple[str, str, str] = ("wx", "wy", "wz"), space: str = "sRGB", prefix: str = "m") -> list[Stage]:
    """A white in columns to the nine entries m00 .. m22 of the matrix from linear RGB to balanced XYZ; null if one of the white's cones is 0.

    The matrix is linear in three gains, one a cone, so each entry is three products with constants.
    """
    gains = {f"gain{k}": f"{num(t)} / nullif({_dot(row, white)}, 0e0)" for k, (row, t) in enumerate(zip(BRADFORD, BRADFORD @ (D65 * WHITE_Y), strict=True))}
    back, onto = np.linalg.inv(BRADFORD), BRADFORD @ TO_XYZ[space]
    return [gains, {f"{prefix}{i}{j}": _dot([back[i, k] * onto[k, j] for k in range(3)], [f"gain{k}" for k in range(3)]) for i in range(3) for j in range(3)}]


def balanced_lab_stages(rgb: tuple[str, str, str] = ("r", "g", "b"), prefix: str = "m") -> list[Stage]:
    """8-bit channels beside the columns of ``balance_stages`` to Lab."""
    names = ("lin_r", "lin_g", "lin_b")
    rows = {c: " + ".join(f"{prefix}{i}{j} * {n}" for j, n in enumerate(names)) for i, c in enumerate("xyz")}
    return [dict(zip(names, map(linear, rgb), strict=True)), rows, *lab_stages()]


def unlab_stages(l: str = "lab_l", a: str = "lab_a", b: str = "lab_b") -> list[Stage]:  # noqa: E741
    """Lab to XYZ (ux, uy, uz)."""
    first = {"gy": f"({l} + 16e0) / 116e0"}
    second = {"gx": f"gy + {a} / 500e0", "gz": f"gy - {b} / 200e0"}
    return [first, second, {f"u{k}": f"{_f_inverse(f'g{k}')} * {num(w)}" for k, w in zip("xyz", D65, strict=True)}]


def hex_stages(space: str = "sRGB") -> list[Stage]:
    """XYZ (ux, uy, uz), relative to D65, to clipped 8-bit channels h_r, h_g, h_b."""
    back = np.linalg.inv(TO_XYZ[space])
    names = ("ux", "uy", "uz")
    lin = {f"d_{k}": f"least(greatest({_dot(row, names)}, 0e0), 1e0)" for k, row in zip("rgb", back, strict=True)}
    gamma = {f"h_{k}": f"CAST(floor(255e0 * (CASE WHEN d_{k} <= 0.0031308e0 THEN 12.92e0 * d_{k} ELSE 1.055e0 * pow(d_{k}, {num(1 / 2.4)}) - 0.055e0 END) + 0.5e0) AS INT)" for k in "rgb"}
    return [lin, gamma]


def ciede2000_stages(one: tuple[str, str, str], two: tuple[str, str, str], k_l: float = 1.0, out: str = "delta_e") -> list[Stage]:
    """CIEDE2000 difference with lightness weight ``k_l`` (Sharma, Wu and Dalal 2005)."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    seven = num(25.0**7)
    turn = lambda v: f"(CASE WHEN {v} < 0e0 THEN {v} + 360e0 ELSE {v} END)"
    cos = lambda k, d: f"cos(radians({num(k)} * hm + {num(d)}))"
    return [
        {"c7": f"pow((sqrt({a1} * {a1} + {b1} * {b1}) + sqrt({a2} * {a2} + {b2} * {b2})) / 2e0, 7e0)"},
        {"gg": f"1e0 + 0.5e0 * (1e0 - sqrt(c7 / (c7 + {seven})))"},
        {"ap1": f"gg * {a1}", "ap2": f"gg * {a2}"},
        {"cp1": f"sqrt(ap1 * ap1 + {b1} * {b1})", "cp2": f"sqrt(ap2 * ap2 + {b2} * {b2})", "t1": f"degrees(atan2({b1}, ap1))", "t2": f"degrees(atan2({b2}, ap2))"},
        {"h1": f"CASE WHEN cp1 = 0e0 THEN 0e0 ELSE {turn('t1')} END", "h2": f"CASE WHEN cp2 = 0e0 THEN 0e0 ELSE {turn('t2')} END"},
        {
            "dh": "CASE WHEN cp1 * cp2 = 0e0 THEN 0e0 WHEN abs(h2 - h1) <= 180e0 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360e0 ELSE h2 - h1 + 360e0 END",
            "hm": "CASE WHEN cp1 * cp2 = 0e0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180e0 THEN (h1 + h2) / 2e0 WHEN h1 + h2 < 360e0 THEN (h1 + h2 + 360e0) / 2e0 ELSE (h1 + h2 - 360e0) / 2e0 END",
            "cm": "(cp1 + cp2) / 2e0", "lm": f"({l1} + {l2}) / 2e0 - 50e0",
        },
        {"tt": f"1e0 - 0.17e0 * {cos(1, -30)} + 0.24e0 * {cos(2, 0)} + 0.32e0 * {cos(3, 6)} - 0.2e0 * {cos(4, -63)}", "cm7": "pow(cm, 7e0)"},
        {
            "tl": f"({l2} - {l1}) / ({num(k_l)} * (1e0 + 0.015e0 * lm * lm / sqrt(20e0 + lm * lm)))", "tc": "(cp2 - cp1) / (1e0 + 0.045e0 * cm)",
            "th": "2e0 * sqrt(cp1 * cp2) * sin(radians(dh / 2e0)) / (1e0 + 0.015e0 * cm * tt)",
            "rt": f"-2e0 * sqrt(cm7 / (cm7 + {seven})) * sin(radians(60e0 * exp(-(hm - 275e0) * (hm - 275e0) / 625e0)))",
        },
        {out: "sqrt(greatest(tl * tl + tc * tc + th * th + rt * tc * th, 0e0))"},
    ]


def nest(source: str, stages: list[Stage]) -> str:
    for s in stages:
        source = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in s.items())} FROM ({source}) AS s"
    return source


def apply(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for s in stages:
        df = df.withColumns({n: F.expr(e) for n, e in s.items()})
    return df
