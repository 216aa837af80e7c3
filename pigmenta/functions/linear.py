"""Small symmetric systems as SQL expressions, in stages like those of ``color``: a solve by LDL', and 3 x 3 eigenvalues and axes."""

from __future__ import annotations

from pigmenta.functions.color import Stage, num

#: Pivots up to which a system counts as singular.
LEAST_PIVOT = 1e-12


def ldl_stages(n: int, right: int, out: str = "c") -> list[Stage]:
    """Columns a00 .. (upper triangle of a positive matrix) and b00 .. (``right`` right sides) to the solutions c00 ..; null if a pivot is too small."""
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    minus = lambda first, terms: " - ".join([first, *terms])
    stages: list[Stage] = []
    for j in range(n):
        stages.append({f"d{j}": minus(a(j, j), [f"l{j}{m} * l{j}{m} * d{m}" for m in range(j)])})
        below = {f"l{i}{j}": f"CASE WHEN d{j} > {num(LEAST_PIVOT)} THEN ({minus(a(i, j), [f'l{i}{m} * l{j}{m} * d{m}' for m in range(j)])}) / d{j} END" for i in range(j + 1, n)}
        stages += [below] if below else []
    for i in range(n):
        stages.append({f"y{i}{k}": minus(f"b{i}{k}", [f"l{i}{m} * y{m}{k}" for m in range(i)]) for k in range(right)})
    for i in reversed(range(n)):
        own = lambda k: f"CASE WHEN d{i} > {num(LEAST_PIVOT)} THEN y{i}{k} / d{i} END"  # noqa: E731, B023
        stages.append({f"{out}{i}{k}": minus(own(k), [f"l{m}{i} * {out}{m}{k}" for m in range(i + 1, n)]) for k in range(right)})
    return stages


def _dot3(p: str, q: str) -> str:
    return "(" + " + ".join(f"{p}{c} * {q}{c}" for c in "xyz") + ")"


def _cross3(p: str, q: str) -> dict[str, str]:
    return {"x": f"{p}y * {q}z - {p}z * {q}y", "y": f"{p}z * {q}x - {p}x * {q}z", "z": f"{p}x * {q}y - {p}y * {q}x"}


def eigen_stages(xx: str, xy: str, xz: str, yy: str, yz: str, zz: str) -> list[Stage]:
    """A symmetric 3 x 3 matrix to eigenvalues e1 >= e2 >= e3 and unit axes (v1x, v1y, v1z) .. whose largest entry, the first of equal ones, is positive.

    The values are the closed form by the cosine of a third of an angle. The axis of the value that stands furthest from the others is the
    longest cross product of two rows; the middle one is found in the plane across it, the last is their cross product. So
    equal values get axes at right angles too, and a multiple of the unit matrix the axes of space.
    """
    rows = {"r1": (xx, xy, xz), "r2": (xy, yy, yz), "r3": (xz, yz, zz)}
    shifted = {f"{r}{c}": f"{v} - e0" if i == j else v for i, (r, vs) in enumerate(rows.items()) for j, (c, v) in enumerate(zip("xyz", vs, strict=True))}
    crossed = {f"k{n}{c}": v for n, (p, q) in {1: ("r1", "r2"), 2: ("r1", "r3"), 3: ("r2", "r3")}.items() for c, v in _cross3(p, q).items()}
    pick = lambda c: f"CASE WHEN n0 <= tiny THEN {'1e0' if c == 'x' else '0e0'} WHEN n1 >= n2 AND n1 >= n3 THEN k1{c} / sqrt(n1) WHEN n2 >= n3 THEN k2{c} / sqrt(n2) ELSE k3{c} / sqrt(n3) END"
    across = {"ux": "CASE WHEN abs(wx) > abs(wy) THEN -wz ELSE 0e0 END", "uy": "CASE WHEN abs(wx) > abs(wy) THEN 0e0 ELSE wz END", "uz": "CASE WHEN abs(wx) > abs(wy) THEN wx ELSE -wy END"}
    times = lambda v: {"x": f"({xx} * {v}x + {xy} * {v}y + {xz} * {v}z)", "y": f"({xy} * {v}x + {yy} * {v}y + {yz} * {v}z)", "z": f"({xz} * {v}x + {yz} * {v}y + {zz} * {v}z)"}
    form = lambda p, q: " + ".join(f"{p}{c} * {t}" for c, t in times(q).items())
    axes = {1: ("w", "t"), 2: ("m", "m"), 3: ("t", "w")}  # of each value, where the first value stands apart, and where the last does
    signed = lambda n: f"CASE WHEN abs(a{n}x) >= abs(a{n}y) AND abs(a{n}x) >= abs(a{n}z) THEN a{n}x WHEN abs(a{n}y) >= abs(a{n}z) THEN a{n}y ELSE a{n}z END"
    return [
        {"mean": f"({xx} + {yy} + {zz}) / 3e0", "off": f"{xy} * {xy} + {xz} * {xz} + {yz} * {yz}"},
        {"spread": f"sqrt((({xx} - mean) * ({xx} - mean) + ({yy} - mean) * ({yy} - mean) + ({zz} - mean) * ({zz} - mean) + 2e0 * off) / 6e0)"},
        {"det": f"({xx} - mean) * (({yy} - mean) * ({zz} - mean) - {yz} * {yz}) - {xy} * ({xy} * ({zz} - mean) - {yz} * {xz}) + {xz} * ({xy} * {yz} - ({yy} - mean) * {xz})"},
        {"turn": "CASE WHEN spread > 0e0 THEN acos(least(greatest(det / (2e0 * spread * spread * spread), -1e0), 1e0)) / 3e0 ELSE 0e0 END"},
        {"e1": "mean + 2e0 * spread * cos(turn)", "e3": f"mean + 2e0 * spread * cos(turn + {num(2.0943951023931953)})"},
        {"e2": "3e0 * mean - e1 - e3"},
        {"ahead": "e1 - e2 >= e2 - e3", "e0": "CASE WHEN e1 - e2 >= e2 - e3 THEN e1 ELSE e3 END"},
        shifted,
        crossed,
        {f"n{n}": _dot3(f"k{n}", f"k{n}") for n in (1, 2, 3)},
        {"n0": "greatest(n1, n2, n3)", "tiny": "1e-28 * mean * mean * mean * mean"},
        {f"w{c}": pick(c) for c in "xyz"},
        across,
        {"un": f"sqrt({_dot3('u', 'u')})"},
        {f"p{c}": f"u{c} / un" for c in "xyz"},
        {f"q{c}": v for c, v in _cross3("w", "p").items()},
        {"pp": f"{form('p', 'p')} - e2", "pq": form("p", "q"), "qq": f"{form('q', 'q')} - e2"},
        {"gx": "CASE WHEN abs(pp) >= abs(qq) THEN pq ELSE qq END", "gy": "CASE WHEN abs(pp) >= abs(qq) THEN -pp ELSE -pq END"},
        {"gn": "sqrt(gx * gx + gy * gy)"},
        {"hx": "CASE WHEN gn > 0e0 THEN gx / gn ELSE 1e0 END", "hy": "CASE WHEN gn > 0e0 THEN gy / gn ELSE 0e0 END"},
        {f"m{c}": f"hx * p{c} + hy * q{c}" for c in "xyz"},
        {f"t{c}": v for c, v in _cross3("w", "m").items()},
        {f"a{n}{c}": f"CASE WHEN ahead THEN {p}{c} ELSE {q}{c} END" for n, (p, q) in axes.items() for c in "xyz"},
        {f"s{n}": f"CASE WHEN {signed(n)} < 0e0 THEN -1e0 ELSE 1e0 END" for n in (1, 2, 3)},
        {f"v{n}{c}": f"s{n} * a{n}{c}" for n in (1, 2, 3) for c in "xyz"},
    ]
