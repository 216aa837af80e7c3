"""Published values, algebraic properties and brute force for the colour operators; SQL for the queries."""

import itertools
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pigmenta.functions.color import apply, ciede2000_stages, hex_stages, lab_stages, pixel_lab_stages, unlab_stages
from pigmenta.operators import records
from pigmenta.operators.assignment import UNITS, assign_projects, auction, certify, match_projects
from pigmenta.operators.grouping import cuts, eigen, ward_merges
from pigmenta.operators.raster import label
from pigmenta.operators.surface import fit_text, robust_text, solve
from pigmenta.plans import queries as plans
from pigmenta.sources.ppm import decode_ppm, read_ppm, read_projects, split_projects, write_projects

# Published CIEDE2000 pairs (Sharma, Wu and Dalal 2005).
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_published_differences_both_ways(spark):
    df = spark.createDataFrame(PAIRS, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, e double")
    one, two = ("l1", "a1", "b1"), ("l2", "a2", "b2")
    for x, y in ((one, two), (two, one)):
        assert all(abs(r.delta_e - r.e) < 1e-4 for r in apply(df, ciede2000_stages(x, y)).collect())


def test_measured_pixels_and_round_trip(spark):
    white = (0.659726868, 0.691085816, 0.552663648)
    # Measured pixels that must come out the same.
    for rgb, space, lab, code in (((200, 60, 50), "sRGB", (51.7517, 57.5539, 31.7471), "#da4749"), ((200, 60, 50), "displayP3", (52.829, 69.2447, 41.0705), "#ee333c"), ((12, 10, 14), "sRGB", (3.892, 1.9414, -5.027), "#0d0d16")):
        df = spark.createDataFrame([tuple(map(float, rgb))], "r double, g double, b double")
        r = apply(df, [*pixel_lab_stages(white, space), *unlab_stages(), *hex_stages(), *lab_stages("ux", "uy", "uz", ("l", "a", "b"))]).first()
        assert np.allclose((r.lab_l, r.lab_a, r.lab_b), lab, atol=1e-3)
        assert np.allclose((r.l, r.a, r.b), (r.lab_l, r.lab_a, r.lab_b), atol=1e-9)
        assert f"#{r.h_r:02x}{r.h_g:02x}{r.h_b:02x}" == code


def nearest_pairs(cost):
    """Each row's cheapest columns, as many as there are rows, times the rows and one; and the names of these columns."""
    n = len(cost)
    order = np.argsort(cost, 1, kind="stable")[:, :n]
    names = np.unique(order)
    return np.take_along_axis(cost, order, 1) * (n + 1), np.searchsorted(names, order), names


def test_auction_against_all_injections():
    rng = np.random.default_rng(42)
    for n, m in ((1, 1), (1, 4), (2, 3), (3, 3), (3, 5), (4, 6), (5, 7)):
        for high in (2, 50, 10**10):  # ties, few ties, none
            for _ in range(20):
                cost = rng.integers(0, high, (n, m))
                pairs, at, names = nearest_pairs(cost)
                held, price = auction(pairs, at, len(names))
                best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
                assert len(set(held)) == n and sum(cost[i, names[j]] for i, j in enumerate(held)) == best
                assert (price >= 0).all() and not price[[j for j in range(len(names)) if j not in held]].any()


def test_auction_of_many_is_proved_by_its_prices():
    x, y = (np.random.default_rng(s).random((700, 3)) * 100 for s in (1, 2))
    cost = (((x[:, None] - y[None]) ** 2).sum(2) * UNITS).astype(np.int64)[:500]
    pairs, at, names = nearest_pairs(cost)
    held, price = auction(pairs, at, len(names))
    whole = np.zeros(700, np.int64)
    whole[names] = price
    total, bound = int(cost[np.arange(500), names[held]].sum()), ((cost * 501 + whole).min(1).sum() - whole.sum()) / 501
    assert len(set(held)) == 500 and 0 <= total - bound < 1


@pytest.mark.parametrize("sides", [(4, 6), (6, 4)])
def test_rounds_find_what_tasks_find(spark, sides):
    rng = np.random.default_rng(sum(sides))
    rows = [(p, f"f{i}", j, float(rng.integers(0, 9)) / 1000) for p in (1, 2) for i in range(sides[0]) for j in range(sides[1])]
    costs = spark.createDataFrame(rows, "project long, flavor string, paper long, delta_e double")
    proofs = []
    for most in (1_000_000, 0):
        out = assign_projects(costs, most)
        found = out.collect()
        assert len(found) == 2 * sides[0] and sum(r.paper is not None for r in found) == 8
        proof = certify(costs, out).collect()
        proofs.append(sorted((r.project, r.flavors, r.papers, r.matched, r.sheets, round(r.total, 9)) for r in proof))
        assert all(abs(r.total - r.bound) < 0.9 / UNITS for r in proof)
    assert proofs[0] == proofs[1] and proofs[0][0][3:5] == (4, 4)


def test_clusters_axes_and_labels():
    rng = np.random.default_rng(17)
    points = np.concatenate([rng.uniform(-1, 1, (n, 3)) + c for n, c in ((9, (20, 0, 5)), (14, (0, 30, 5)), (6, (-20, 0, 40)))])
    assert cuts(ward_merges(points), 29, 3)[3].tolist() == [0] * 9 + [1] * 14 + [2] * 6
    values, vectors = eigen(np.diag([1.0, 4.0, 2.0]))
    assert np.allclose(values, (4, 2, 1)) and np.allclose(vectors[:, 0], (0, 1, 0))
    mask = np.array([[1, 0, 1], [0, 1, 0], [1, 1, 0]], bool)
    assert label(mask).tolist() == [[1, 0, 2], [0, 3, 0], [3, 3, 0]]
    assert label(mask, diagonal=True).max() == 1


def test_solve_and_surface(spark):
    assert np.allclose(solve([[0, 3, 1], [4, 1, 0], [1, 0, 5]], [7, 6, 6]), (1, 2, 1)) and solve([[3, 6], [1, 2]], [9, 3]) is None
    surfaces = [(1, 1, -1, 0, 0.5, 0), (2, 0, 0, 1, 0, -1), (0.5, 0, 3, 0, 0, 0.25)]
    terms = lambda u, w: (1, u, w, u * u, u * w, w * w)
    seen = lambda u, w: [float(np.dot(c, terms(u, w))) for c in surfaces]
    rows = [(1, u / 5, w / 5, *seen(u / 5, w / 5)) for u in range(-5, 6) for w in range(-5, 6)] + [(2, 0.0, 0.0, 1.0, 1.0, 1.0)] + [(3, float(i % 2), float(i % 3), 1.0, 2.0, 3.0) for i in range(4)]
    dark = [(4, *r[1:3], *(v - (5 if i % 9 == 0 else 0) + 0.001 * (i % 3) for v in r[3:])) for i, r in enumerate(rows[:121])]
    points = spark.createDataFrame(rows + dark, "photo_id long, u double, w double, v0 double, v1 double, v2 double")
    run = lambda text: {r.photo_id: np.array(r[1:], object).reshape(6, 3).T for r in spark.sql(plans._filled(text, plans.SPARK), points=points).collect()}
    plain, robust = run(fit_text("SELECT * FROM {points}")), run(robust_text("SELECT * FROM {points}"))
    assert np.allclose(plain[1].astype(float), surfaces, atol=1e-9) and np.allclose(robust[1].astype(float), surfaces, atol=1e-9)
    assert all(v is None for i in (2, 3) for v in [*plain[i].ravel(), *robust[i].ravel()])
    assert np.abs(robust[4].astype(float) - surfaces).max() < 0.01 < 0.2 < np.abs(plain[4].astype(float) - surfaces).max()  # shadows are left out


def test_sources(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(b"P6 # note\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "b.ppm").write_bytes(b"P6 2 2 255\n123")
    assert decode_ppm((tmp_path / "a.ppm").read_bytes())[:2] == (2, 1)
    rows = read_ppm(spark, str(tmp_path / "*.ppm")).collect()
    assert sorted((r.x, r.r, r.g, r.b) for r in rows if r.error is None) == [(0, 1, 2, 3), (1, 4, 5, 6)]
    assert [r.error for r in rows if r.error] == ["truncated"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.json").write_text('{"version": 1, "locks": {"a": "b"}}')
    (tmp_path / "p" / "y.json").write_text("{broken")
    assert sorted(str(r.version) for r in read_projects(spark, str(tmp_path / "p")).select("version", "_broken").collect()) == ["1", "None"]


def test_projects_saved_and_read_again(spark, tmp_path):
    (tmp_path / "p").mkdir()
    tap = {"x": 3.0, "y": 4.5, "r": 9.0}
    sample = {"id": "s", "kind": "bean", "label": "Größe\n2", "photoID": None, "tap": tap, "lab": [50.0, 1.0, -2.0], "available": True, "created": 7.0}
    whole = {"version": 1, "photos": [], "samples": [sample], "locks": {"lime": "s"}}
    (tmp_path / "p" / "a.json").write_text(json.dumps(whole, indent=1))
    (tmp_path / "p" / "b.json").write_text("{ no project")
    (tmp_path / "p" / "d.json").write_text('{"version": 1, "photos": [], "locks": {}}')
    (tmp_path / "p" / "c.json").write_text(json.dumps(whole | {"version": 2, "samples": [], "locks": {}}))
    sound, aside = split_projects(read_projects(spark, str(tmp_path / "p")))
    assert sorted((r.path.rsplit("/", 1)[1], r.text) for r in aside.collect()) == [("b.json", "{ no project"), ("d.json", None)]
    write_projects(sound, str(tmp_path / "saved"))
    again, broken = split_projects(read_projects(spark, str(tmp_path / "saved"), lines=True))
    plain = lambda df: sorted((r.asDict(True) for r in df.drop("path").collect()), key=lambda r: r["version"])
    assert broken.count() == 0 and plain(again) == plain(sound)
    assert plain(again)[0]["samples"][0]["label"] == "Größe\n2" and plain(again)[0]["locks"] == {"lime": "s"}


def test_records(spark):
    samples = spark.createDataFrame([("1", "object", "Lime  x", "p", 1.0, 1.0, True), ("2", "object", "lime X", "q", 1.0, 1.0, True), ("3", "paper", "#7", None, None, None, True)], "id string, kind string, label string, photo_id string, tap_x double, tap_y double, available boolean")
    locks = spark.createDataFrame([("lime x", "3"), ("berry", "9")], "flavor_key string, paper_id string")
    assert [r.k for r in samples.select(records.flavor_key("label").alias("k")).collect()][:2] == ["lime x", "lime x"]
    assert records.next_number(samples, "#").first().n == 8
    _, kept = records.rename(samples, locks, "1", "Cherry")
    assert {r.flavor_key for r in kept.collect()} == {"lime x", "berry"}
    s2, _ = records.rename(samples, locks, "1", "Cherry")
    assert {r.flavor_key for r in records.rename(s2, locks, "2", "Cherry")[1].collect()} == {"cherry", "berry"}
    assert {tuple(r) for r in records.set_lock(locks, "cherry", "3").collect()} == {("berry", "9"), ("cherry", "3")}
    assert records.delete_sample(samples, locks, "3")[1].count() == 1
    photos = spark.createDataFrame([("p",), ("q",)], "id string")
    left, cleared = records.delete_photo(photos, samples, "p")
    assert left.count() == 1 and cleared.where(F.col("photo_id") == "q").count() == 1 and cleared.where("tap_x is null").count() == 2


def test_rename_and_locks(spark):
    samples = spark.createDataFrame([("1", "bean", "Lime"), ("2", "bean", "Cherry"), ("3", "paper", "Lime"), ("4", "bean", "Plum")], "id string, kind string, label string")
    locks = spark.createDataFrame([("lime", "3"), ("cherry", "9")], "flavor_key string, paper_id string")
    after = lambda i, name: sorted(map(tuple, records.rename(samples, locks, i, name)[1].collect()))
    assert after("1", "Cherry") == [("cherry", "9")]  # the lock that is there stays
    assert after("1", "Pear") == [("cherry", "9"), ("pear", "3")]
    assert after("3", "Pear") == after("1", " Lime ") == after("1", "") == after("4", "Lime") == [("cherry", "9"), ("lime", "3")]
    long = spark.createDataFrame([("1", "p" * 3000 + "41")], "id string, label string")
    assert records.next_number(long, "p" * 3000).first().n == 42


def test_lender_of_equal_times(spark, tmp_path):
    rows = [(1, 0, 1, "view"), (2, 0, 1, "view"), (3, 60, 1, "error"), (4, 7260, 1, "click"), (5, 7260, 2, "view"), (6, 0, 1, "error")]
    events = spark.createDataFrame([(i, t, u, k) for i, t, u, k in rows], "event_id long, s long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.lender for r in plans.queries()["borrowed_white_asof"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(con.sql(plans.oracle_sql()["borrowed_white_asof"]).fetchall()) == {1: 2, 2: 1, 3: 2, 6: 2}


def test_match_with_locks(spark):
    def match(costs, locks, names=("Cherry", "Berry")):
        flavors = spark.createDataFrame([(1, i, n.lower(), n) for i, n in enumerate(names)], "project long, ord long, flavor string, label string")
        rows = [(1, f, p, a, e) for f, p, a, e in costs]
        pairs = spark.createDataFrame(rows, "project long, flavor string, paper long, available boolean, delta_e double")
        held = spark.createDataFrame([(1, *x) for x in locks], "project long, flavor string, paper long")
        return {r.label: r for r in match_projects(flavors, pairs, held).collect()}

    costs = [("cherry", 1, True, 0.0), ("cherry", 2, True, 9.0), ("cherry", 3, True, 30.0), ("berry", 1, True, 8.0), ("berry", 2, True, 1.0), ("berry", 3, True, 25.0)]
    free = match(costs, [])
    assert [(r.paper, r.locked) for r in (free["Cherry"], free["Berry"])] == [(1, False), (2, False)]
    assert [(a.paper, a.taken_by) for a in free["Cherry"].alternates] == [(1, None), (2, "Berry"), (3, None)]
    got = match(costs, [("berry", 1), ("cherry", 99), ("nobody", 2)])  # unknown sheets and flavours are ignored
    assert [(r.paper, r.delta_e, r.locked) for r in (got["Berry"], got["Cherry"])] == [(1, 8.0, True), (2, 9.0, False)]
    used = [("cherry", 1, False, 0.0), ("cherry", 2, True, 9.0), ("berry", 1, False, 8.0), ("berry", 2, True, 1.0)]
    assert (match(used, [])["Cherry"].paper, match(used, [])["Berry"].paper) == (None, 2)
    got = match(used, [("cherry", 1)])
    assert (got["Cherry"].paper, got["Cherry"].locked, got["Berry"].paper) == (1, True, 2)
    assert [(a.paper, a.taken_by) for a in got["Berry"].alternates] == [(2, None), (1, "Cherry")]
    got = match(costs, [("berry", 1), ("cherry", 1)])  # both keep the sheet; the last in input order, not by key, is its holder
    assert [(r.paper, r.locked) for r in got.values()] == [(1, True)] * 2
    assert got["Cherry"].alternates[0].taken_by == "Berry" and got["Berry"].alternates[1].taken_by is None
    none = match([], [])
    assert [(r.paper, r.locked, r.alternates) for r in none.values()] == [(None, False, [])] * 2
    rows = plans.queries()["match_locked"](spark, "/root/testdata/sf0.001").collect()
    held = sorted((r.flavor, r.paper) for r in rows if r.locked)
    assert [p for _, p in held] == [0, 1] and [f for f, _ in held] == sorted(r.flavor for r in rows)[:2]
    held = [r.paper for r in rows if r.paper is not None]
    assert len(set(held)) == len(held)


def test_summary_of_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    sizes = [plans.run(spark, d, t).first()[0] for t in (f"SELECT count(*) FROM ({plans._flavors()}) AS f", f"SELECT count(*) FROM ({plans._papers()}) AS p WHERE available")]
    pairs = {(r.flavor, r.paper): r.delta_e for r in plans.run(spark, d, plans._costs()).collect()}
    at = [(r.flavor, r.paper) for r in plans.queries()["match_assignment_full"](spark, d).collect() if r.paper is not None]
    got = plans.queries()["match_summary"](spark, d).first()
    off = [pairs[x] for x in at]
    assert (got.flavors, got.matched, got.spare) == (sizes[0], min(sizes), max(sizes[1] - sizes[0], 0)) and got.flavors > 4
    assert (got.mean_delta_e, got.worst_delta_e) == (pytest.approx(sum(off) / len(off), abs=1e-6), pytest.approx(max(off), abs=1e-6))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in plans.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(plans.oracle_sql()[name]).df()
    got = plans.queries()[name](spark, d).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_assignment_with_repeated_pairs(spark):
    rows = [(0, "lime", 1, 9.0), (0, "lime", 1, 2.0), (0, "lime", 2, 3.0), (0, "plum", 1, 1.0), (0, "plum", 2, 4.0), (0, "plum", 2, 4.0)]
    out = assign_projects(spark.createDataFrame(rows, "project long, flavor string, paper long, delta_e double")).collect()
    assert sorted((r.flavor, r.paper, r.delta_e) for r in out) == [("lime", 2, 3.0), ("plum", 1, 1.0)]


@pytest.mark.parametrize("query", ["match_assignment_full", "match_summary"])
def test_pairs_for_the_assignment_are_dealt_over_tasks(spark, monkeypatch, query):
    """The few flavours lie in one task, which made all pairs and held them while it looked for repeated ones."""
    seen, solve = [], plans.assignment.assign_projects
    monkeypatch.setattr(plans, "TASK_PAIRS", 60)
    monkeypatch.setattr(plans.assignment, "assign_projects", lambda costs: seen.append(costs) or solve(costs))
    d = "/root/testdata/sf0.001"
    assert plans.queries()[query](spark, d).count() == (plans.run(spark, d, plans._flavors()).count() if query == "match_assignment_full" else 1)
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    want = plans.run(spark, d, plans._costs()).where("available").select("flavor", "paper", F.round("delta_e", 9))
    got = seen[0].select("flavor", "paper", F.round("delta_e", 9))
    assert len(sizes) > 4 and max(sizes) <= 128 and got.count() == want.count() == sum(sizes) and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("query", ["match_assignment_full", "match_summary"])
def test_a_bidders_pairs_do_not_meet_in_one_task(spark, monkeypatch, query):
    """All pairs were shuffled twice, and all sheets of a flavour met in one task, which then kept a few of them."""
    seen, solve = [], plans.assignment.assign_projects
    monkeypatch.setattr(plans.assignment, "assign_projects", lambda costs: seen.append(costs) or solve(costs))
    plans.queries()[query](spark, "/root/testdata/sf0.01")
    kept = plans.assignment._kept(seen[0])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if " Exchange " in line and "hashpartitioning(" in line and "REPARTITION" not in line]
    assert plan.count("WindowGroupLimit") == 2 and len(exchanges) == 1
    pairs, n = seen[0].collect(), kept.agg(F.max("n")).first()[0]
    sides = [{r[side] for r in pairs} for side in ("flavor", "paper")]
    assert n == min(map(len, sides)) and kept.count() == n * n and kept.select("bidder").distinct().count() == n


def test_kept_pairs_of_several_projects(spark):
    """Projects of other sizes and sides, with repeated pairs and pairs without a difference, against all pairs in Python."""
    rows = [(p, f"f{f}", s, None if (f + s) % 11 == 10 else float((f * 7 + s * 5 + p) % 13) + more) for p, nf, ns in ((1, 2, 9), (2, 6, 3), (3, 4, 4), (4, 1, 1)) for f in range(nf) for s in range(ns) for more in (3.0, 0.0, 0.0)]
    got = plans.assignment._kept(spark.createDataFrame(rows, "project long, flavor string, paper long, delta_e double").repartition(5)).collect()
    least, want = {}, set()
    for p, f, s, e in rows:
        if e is not None:
            least[p, f, s] = min(e, least.get((p, f, s), e))
    for p in (1, 2, 3, 4):
        own = {(f, s): e for (q, f, s), e in least.items() if q == p}
        sides = [sorted({k[i] for k in own}) for i in (0, 1)]
        who = int(len(sides[0]) > len(sides[1]))
        for b in sides[who]:
            near = sorted((e, k[1 - who], k) for k, e in own.items() if k[who] == b)[: min(map(len, sides))]
            want |= {(p, *k, e) for e, _, k in near}
    assert sorted((r.project, r.bidder.flavor or r.item.flavor, r.item.paper if r.bidder.paper is None else r.bidder.paper, r.delta_e) for r in got) == sorted(want)
    none = spark.createDataFrame([(1, "f", 1, None)], "project long, flavor string, paper long, delta_e double")
    assert plans.assignment._kept(none).count() == 0 and [r.paper for r in plans.assignment.assign_projects(none).collect()] == [None]


def test_measured_flavors_have_the_first_label(spark, tmp_path):
    names = [(4, "Old  Lamp"), (2, " old lamp"), (9, "OLD LAMP"), (3, "Red Rod"), (3, "Hot Plate"), (5, "hot plate"), (7, None), (8, None), (None, "no key")]
    spark.createDataFrame([(k, n, 1 + i) for i, (k, n) in enumerate(names)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    for d in (str(tmp_path), "/root/testdata/sf0.001"):
        want, got = plans.run(spark, d, plans._flavors()), plans._measured_flavors(spark, d)
        shown = lambda df: sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in df.select(*want.columns).collect())
        assert shown(got) == shown(want) and got.columns == want.columns


def test_locks_do_not_shuffle_the_pairs(spark, monkeypatch):
    """The pairs of all projects were shuffled for the locked flavours and again for their sheets."""
    seen, solve = [], plans.assignment.assign_projects
    monkeypatch.setattr(plans.assignment, "assign_projects", lambda costs: seen.append(costs) or solve(costs))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans.queries()["match_project_summaries"](spark, "/root/testdata/sf0.001")
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
