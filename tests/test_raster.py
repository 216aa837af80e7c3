"""Components over tiles, nearest seeds and every n-th cell against brute force."""

import numpy as np
import pytest

from pigmenta.operators.raster import components, envelope, every_nth, label, nearest_seeds


def cells(spark, frames, schema="photo_id long, y int, x int"):
    rows = [(p, int(y), int(x)) for p, m in enumerate(frames) for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, schema).repartition(3)


def spiral(n):
    """A path that winds inwards, so that every tile holds several parts of one component."""
    m, y, x, d = np.zeros((n, n), bool), 0, 0, 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    m[0, 0] = True
    for length in [n - 1, n - 1, n - 1, *(v for k in range(n - 3, 1, -2) for v in (k, k))]:
        for _ in range(length):
            y, x = y + steps[d][0], x + steps[d][1]
            m[y, x] = True
        d = (d + 1) % 4
    return m


@pytest.mark.parametrize("diagonal", [False, True])
def test_tiles_give_the_components_of_the_whole(spark, diagonal):
    rng = np.random.default_rng(7)
    frames = [rng.random((37, 53)) < 0.55, spiral(33), np.ones((20, 9), bool), np.eye(30, dtype=bool)[::-1], rng.random((8, 70)) < 0.3]
    want = sorted((p, y, x, int(v)) for p, m in enumerate(frames) for (y, x), v in np.ndenumerate(label(m, diagonal)) if v)
    for tile in (8, 1024):
        assert sorted(map(tuple, components(cells(spark, frames), diagonal, tile).collect())) == want
    assert components(cells(spark, [np.zeros((3, 3), bool)]), diagonal).count() == 0


def test_envelope_against_all_columns():
    rng = np.random.default_rng(1)
    for _ in range(300):
        columns = np.sort(rng.choice(60, int(rng.integers(1, 20)), replace=False))
        heights = rng.integers(0, 40, len(columns)) ** 2
        wanted = np.arange(-5, 65)
        cost = (wanted[:, None] - columns[None]) ** 2 + heights[None]
        assert (envelope(columns, heights, wanted) == cost.argmin(1)).all()  # argmin takes the first of equal ones


def test_nearest_seeds_against_all_sites(spark):
    rng = np.random.default_rng(9)
    frames = [rng.random((23, 37)) < p for p in (0.01, 0.2, 0.7)] + [np.zeros((4, 5), bool), np.array([[True]])]
    rows = [(p, int(y), int(x), bool(v)) for p, m in enumerate(frames) for (y, x), v in np.ndenumerate(m)]
    got = {(r.photo_id, r.y, r.x): (r.d2, r.site_x, r.site_y) for r in nearest_seeds(spark.createDataFrame(rows, "photo_id long, y int, x int, site boolean").repartition(3)).collect()}
    want = {(p, y, x): min(((x - sx) ** 2 + (y - sy) ** 2, int(sx), int(sy)) for sy, sx in np.argwhere(frames[p])) for p, y, x, _ in rows if frames[p].any()}
    assert got == want


def test_every_nth(spark):
    frames = [np.random.default_rng(2).random((17, 29)) < 0.4, np.ones((1, 1), bool), np.zeros((2, 2), bool)]
    for step in (1, 3, 16):
        want = sorted((p, int(y), int(x)) for p, m in enumerate(frames) for y, x in np.argwhere(m)[::step])
        assert sorted(map(tuple, every_nth(cells(spark, frames), step).collect())) == want
