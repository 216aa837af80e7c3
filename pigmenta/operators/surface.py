"""The quadratic surface of a photo's brightness, and small dense solves on arrays for the photo kernel."""

from __future__ import annotations

import numpy as np

from pigmenta.functions.color import nest
from pigmenta.functions.linear import LEAST_PIVOT, ldl_stages

#: Terms of the surface in u and w, each -1 to 1 over the photo.
TERMS = ("1e0", "u", "w", "u * u", "u * w", "w * w")
CHANNELS = 3


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Gaussian elimination with partial pivoting; None if a pivot is too small."""
    m, n = np.column_stack([np.array(a, float), np.array(b, float)]), len(a)
    for i in range(n):
        p = i + int(np.abs(m[i:, i]).argmax())
        if abs(m[p, i]) <= LEAST_PIVOT:
            return None
        m[[i, p]] = m[[p, i]]
        m[i] /= m[i, i]
        others = np.arange(n) != i
        m[others] -= np.outer(m[others, i], m[i])
    return m[:, n:].reshape(np.shape(b))


COEFFICIENTS = [f"c{i}{k}" for i in range(6) for k in range(CHANNELS)]


def fit_text(points: str) -> str:
    """(photo_id, u, w, v0, v1, v2) to a row (photo_id, c00 .. c52) a photo: coefficient of each term and channel, null if they can't be told apart or there are under six points.

    One aggregation makes the sums of the normal equations, which are then solved in columns.
    """
    sums = [f"sum(({TERMS[i]}) * ({TERMS[j]})) AS a{i}{j}" for i in range(6) for j in range(i, 6)] + [f"sum(({t}) * v{k}) AS b{i}{k}" for i, t in enumerate(TERMS) for k in range(CHANNELS)]
    solved = nest(f"SELECT photo_id, count(*) AS points, {', '.join(sums)} FROM ({points}) AS p GROUP BY photo_id", ldl_stages(6, CHANNELS))
    return f"SELECT photo_id, {', '.join(f'CASE WHEN points >= 6 THEN {c} END AS {c}' for c in COEFFICIENTS)} FROM ({solved}) AS s"


def robust_text(points: str) -> str:
    """As ``fit_text``, fitted again without the points that lie more than 1.5 robust deviations below (mean of the channels); the first fit stays where the second fails."""
    predicted = lambda k: " + ".join(f"c{i}{k} * ({t})" for i, t in enumerate(TERMS))
    off = " + ".join(f"(v{k} - ({predicted(k)}))" for k in range(CHANNELS))
    again = fit_text("SELECT d.* FROM d JOIN s ON d.photo_id = s.photo_id WHERE far > -1.5e0 * spread")
    return (
        f"WITH p AS ({points}), f AS ({fit_text('SELECT * FROM p')}), "
        f"d AS (SELECT p.*, ({off}) / {CHANNELS}e0 AS far FROM p JOIN f ON p.photo_id = f.photo_id), "
        "m AS (SELECT photo_id, {pct}(far, 0.5) AS middle FROM d GROUP BY photo_id), "
        "s AS (SELECT d.photo_id, 1.4826e0 * {pct}(abs(far - middle), 0.5) + 1e-6 AS spread FROM d JOIN m ON d.photo_id = m.photo_id GROUP BY d.photo_id), "
        f"g AS ({again}) "
        f"SELECT f.photo_id, {', '.join(f'coalesce(g.{c}, f.{c}) AS {c}' for c in COEFFICIENTS)} FROM f LEFT JOIN g ON f.photo_id = g.photo_id"
    )
