"""Ward by chains against always joining the cheapest pair; small systems as expressions against numpy."""

import resource

import duckdb
import numpy as np
import pytest

from pigmenta.functions.color import nest
from pigmenta.functions.linear import eigen_stages, ldl_stages
from pigmenta.operators.grouping import cuts, eigen, ward_groups, ward_merges
from pigmenta.plans import grouping as texts
from pigmenta.plans import queries as plans


def greedy(points):
    """Joins the first cheapest pair, with costs updated by Lance and Williams."""
    n = len(points)
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    size, alive, out = np.ones(n), list(range(n)), []
    while len(alive) > 1:
        _, a, b = min((d[a, b], a, b) for i, a in enumerate(alive) for b in alive[i + 1 :])
        out.append((a, b))
        alive.remove(b)
        for c in alive:
            if c != a:
                total = size[a] + size[b] + size[c]
                d[a, c] = d[c, a] = ((size[a] + size[c]) * d[a, c] + (size[b] + size[c]) * d[b, c] - size[c] * d[a, b]) / total
        size[a] += size[b]
    return out


@pytest.mark.parametrize("seed", range(10))
def test_chain_is_greedy(seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        points = rng.normal(size=(int(rng.integers(1, 30)), 3)) * rng.uniform(0.1, 20)
        assert ward_merges(points) == greedy(points)


def test_equal_points_and_cuts():
    points = np.repeat(np.random.default_rng(4).normal(size=(5, 3)), 4, 0)[np.random.default_rng(5).permutation(20)]
    got = cuts(ward_merges(points), 20, 5)
    same = (points[:, None] == points[None]).all(2)
    assert ((got[5][:, None] == got[5][None]) == same).all() and sorted(got) == [1, 2, 3, 4, 5]
    for k, g in got.items():
        first = [g.tolist().index(i) for i in range(k)]
        assert first == sorted(first) and len(set(g)) == k  # numbered by first appearance
    assert ward_merges(np.zeros((0, 3))) == [] and cuts([], 1, 6)[1].tolist() == [0] and cuts([], 0, 6) == {}


def test_many_objects_need_little_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    points = np.random.default_rng(2).normal(size=(6000, 3))
    got = cuts(ward_merges(points), 6000, 6)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000 and len(set(got[6])) == 6  # a table of distances takes 288 MB


def test_labels_against_recursion(spark):
    rng = np.random.default_rng(8)
    rows = [(p, 100 * p + i, *map(float, rng.normal(size=3) * 9)) for p in range(6) for i in range(2 * p + 1)]
    schema = "photo_id long, object_id long, lab_l double, lab_a double, lab_b double"
    want = duckdb.connect()
    want.execute(f"CREATE TABLE objects (photo_id BIGINT, object_id BIGINT, lab_l DOUBLE, lab_a DOUBLE, lab_b DOUBLE); INSERT INTO objects VALUES {', '.join(map(str, rows))}")
    labels = ward_groups(spark.createDataFrame(rows, schema).repartition(3)).drop("score")
    assert sorted(map(tuple, labels.collect())) == sorted(want.sql(f"{texts._ward('SELECT * FROM objects')} SELECT photo_id, k, object_id, grp FROM l").fetchall())
    got = texts.suggest(spark, spark.createDataFrame(rows, schema), ward_groups(spark.createDataFrame(rows, schema)), lambda t: plans._filled(t, plans.SPARK))
    expected = want.sql(plans._filled(f"{texts._ward('SELECT * FROM objects')},{texts._SCORES}, {texts._GROUPS}", plans.DUCK)).fetchall()
    tidy = lambda rows: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
    assert str(tidy(got.collect())) == str(tidy(expected)) and len(expected) == 1 + 6 + 15 + 21 * 3


def decomposed(spark, matrices):
    rows = ", ".join(f"({i}, {', '.join(f'{v!r}e0' if 'e' not in repr(v) else repr(v) for v in map(float, (m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2])))})" for i, m in enumerate(matrices))
    got = spark.sql(nest(f"SELECT * FROM VALUES {rows} AS t(i, xx, xy, xz, yy, yz, zz)", eigen_stages("xx", "xy", "xz", "yy", "yz", "zz"))).orderBy("i").collect()
    return [(np.array([r.e1, r.e2, r.e3]), np.array([[r[f"v{n}{c}"] for n in (1, 2, 3)] for c in "xyz"])) for r in got]


def test_axes_as_expressions(spark):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    plain = [m @ m.T for m in rng.normal(size=(40, 3, 3))] + [np.diag([1.0, 4.0, 2.0])]
    repeated = [turn @ np.diag(d) @ turn.T for d in ([5.0, 2.0, 2.0], [5.0, 5.0, 2.0], [3.0, 0.0, 0.0])] + [np.eye(3) * 7, np.zeros((3, 3)), np.diag([2.0, 2.0, 9.0])]
    for m, (values, axes) in zip(plain + repeated, decomposed(spark, plain + repeated), strict=True):
        want, vectors = eigen(m)
        assert np.allclose(values, want, atol=1e-6 * max(1, want[0])) and np.allclose(axes.T @ axes, np.eye(3), atol=1e-7)
        assert np.allclose(axes @ np.diag(values) @ axes.T, m, atol=1e-6 * max(1, want[0]))
        assert all(a[np.abs(a).argmax()] > 0 for a in axes.T)
        if min(want[0] - want[1], want[1] - want[2]) > 0.05:
            assert np.allclose(axes, vectors, atol=1e-5)


def test_solve_as_expressions(spark):
    rng = np.random.default_rng(6)
    systems = [(m @ m.T, rng.normal(size=(4, 2))) for m in rng.normal(size=(10, 4, 4))] + [(np.ones((4, 4)), np.ones((4, 2)))]
    names = [f"a{i}{j}" for i in range(4) for j in range(i, 4)] + [f"b{i}{k}" for i in range(4) for k in range(2)]
    rows = [(n, *map(float, [a[i, j] for i in range(4) for j in range(i, 4)]), *map(float, b.ravel())) for n, (a, b) in enumerate(systems)]
    frame = spark.createDataFrame(rows, "n int, " + ", ".join(f"{x} double" for x in names))
    got = spark.sql(nest("SELECT * FROM {frame}", ldl_stages(4, 2)), frame=frame).orderBy("n").collect()
    for (a, b), r in zip(systems[:-1], got, strict=False):
        assert np.allclose([[r[f"c{i}{k}"] for k in range(2)] for i in range(4)], np.linalg.solve(a, b), rtol=1e-6)
    assert [got[-1][f"c{i}{k}"] for i in range(4) for k in range(2)] == [None] * 8
