"""Whole photos: scenes with known objects, brute-force distances, readers, taps, the command line."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pigmenta.__main__ import Failure, report, triple
from pigmenta.functions.color import TO_XYZ, WHITE_Y, apply, ciede2000_stages
from pigmenta.functions.kernels import ciede2000, lab_hex
from pigmenta.operators.grouping import cuts, group, silhouettes, ward_groups, ward_merges
from pigmenta.operators.measure import auto_white, borrowed_white, measure_taps, measure_whites, sample_colour, set_white, white_at
from pigmenta.operators.segment import NoObjects, analyse_photos, grown, nearest_site, opened, segment
from pigmenta.operators.surface import robust_text
from pigmenta.plans import queries as plans
from pigmenta.plans.grouping import suggest
from pigmenta.sources.photos import read_photos, read_ppm_photos, shrink
from tests.scenes import COLUMNS, LAMP, MARGIN, PAPER, PITCH, family, lattice, photograph, scene_photos
from tests.test_colour import PAIRS

PAPER_L = 116 * np.cbrt(WHITE_Y) - 16


def scene(trio, per, **how):
    """Photo, places and kind of each object."""
    kind = np.random.default_rng(1).permutation(np.arange(3 * per) % 3)
    places = lattice(3 * per)
    return photograph(places, family(trio)[kind], **how), places, kind


def separated(rgb, places, kind, **whites):
    """Every object found where it lies, and the suggested groups are the kinds; returns what was found and its groups."""
    found = segment(rgb, "sRGB", **whites)
    got = group(found.labs)
    far = np.hypot(found.beans[:, None, 0] - places[None, :, 0], found.beans[:, None, 1] - places[None, :, 1])
    truth = kind[far.argmin(1)]
    part = got.partitions[got.suggested - 1]
    assert len(found.beans) == len(places) and not len(found.clumps) and far.min(1).max() < 12
    assert got.suggested == len(set(kind.tolist()))
    assert all(len(set(truth[part.assignment == g].tolist())) == 1 for g in range(part.k))
    return found, part


def test_reds_on_paper_under_uneven_light():
    found, part = separated(*scene("reds", 20))
    assert found.light.is_white and found.light.calibrated and abs(found.sheet[0] - PAPER_L) < 0.5
    assert part.counts.tolist() == [20, 20, 20] and part.separation > 2 and (np.diff(part.centroids[:, 0]) < 0).all()


@pytest.mark.parametrize("trio", ["yellows", "greens", "darks"])
def test_other_families(trio):
    assert separated(*scene(trio, 14))[0].light.is_white


@pytest.mark.parametrize("sheet", ["slate", "indigo"])
def test_pale_objects_on_a_dark_sheet(sheet):
    found, _ = separated(*scene("whites", 14, ground=sheet))
    assert found.light.calibrated and not found.light.is_white and found.sheet[0] < 40


def test_a_white_from_anywhere_gives_the_same_colours():
    _, on_paper = separated(*scene("reds", 14, decay=0.0))
    white = TO_XYZ["sRGB"] @ (LAMP * PAPER)
    black = scene("reds", 14, decay=0.0, ground="slate", rim=0)
    tapped, part = separated(*black, tapped=white)
    assert tapped.light.calibrated and not tapped.light.is_white and (ciede2000(part.centroids, on_paper.centroids) < 1).all()
    _, part = separated(*scene("reds", 14, decay=0.0, ground="slate"))
    assert (ciede2000(part.centroids, on_paper.centroids) < 1).all()
    lent, part = separated(*scene("reds", 14, decay=0.0, ground="indigo", rim=0), fallback=white)
    assert not lent.light.calibrated and (ciede2000(part.centroids, on_paper.centroids) < 1).all()
    alone, part = separated(*scene("reds", 14, ground="indigo", rim=0))
    assert not alone.light.calibrated and (part.centroids[:, 0] > 15).all() and (part.centroids[:, 1] > 25).all()
    pale, _ = separated(*scene("whites", 14, ground="slate", rim=0))
    assert not pale.light.calibrated


def test_folds_grain_and_surroundings():
    rgb, places, _ = scene("reds", 14, ground="indigo", rim=0, creases=6)
    found = segment(rgb, "sRGB")
    assert len(found.beans) == len(places) and not len(found.clumps)
    separated(*scene("greens", 14, ground="bark", rim=0, fibre=0.1))
    rgb, places, _ = scene("reds", 10)
    rgb = rgb.copy()
    rgb[:, :40] = (40, 35, 70)
    assert len(segment(rgb, "sRGB").beans) == len(places)


def test_touching_single_kind_and_even_light():
    red = family("reds")[0]
    close = [(300, 300, 0), (300, 333, 0), (600, 300, 0), (650, 300, 0), *((200 + 90 * i, 600, 30 * i) for i in range(8))]
    found = segment(photograph(np.array(close, float), [red] * 12), "sRGB")
    assert len(found.beans) == 12 and not len(found.clumps)
    found = segment(photograph(lattice(40), [red] * 40), "sRGB")
    assert len(found.beans) == 40 and group(found.labs).suggested == 1
    assert (segment(photograph(lattice(60), [red] * 60, vary=0.0), "sRGB").labs.std(0) < 1).all()


def test_photos_without_objects():
    for rgb in (np.zeros((20, 40, 3), np.uint8), np.full((80, 120, 3), (120, 40, 40), np.uint8), photograph(np.zeros((0, 3)), [], 200, 150), np.random.default_rng(0).integers(0, 256, (90, 90, 3), np.uint8)):
        with pytest.raises(NoObjects):
            segment(rgb, "sRGB")


def test_masks_against_brute_force():
    rng = np.random.default_rng(5)
    for share in (0.02, 0.3, 0.9):
        sites = rng.random((17, 23)) < share
        sites[3, 4] = True
        d2, row, col = nearest_site(sites, np.ones_like(sites))
        for y in range(17):
            for x in range(23):
                best = min(((q - x) ** 2 + (p - y) ** 2, q, p) for p, q in zip(*np.nonzero(sites), strict=True))
                assert (d2[y, x], col[y, x]) == best[:2] and sites[row[y, x], col[y, x]]
        grow = np.array([[sites[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any() for x in range(23)] for y in range(17)])
        assert (grown(sites, 5) == grow).all()
    block = np.zeros((12, 12), bool)
    block[:5, :6], block[9, 9] = True, True
    assert (opened(block)[:3, :4]).all() and not opened(block)[9, 9]


def test_differences_and_silhouette(spark):
    p = np.array(PAIRS)
    assert np.allclose(ciede2000(p[:, :3], p[:, 3:6]), p[:, 6], atol=1e-4)
    rng = np.random.default_rng(9)
    some = rng.uniform([0, -60, -60, 0, -60, -60], [100, 60, 60, 100, 60, 60], (200, 6))
    sql = apply(spark.createDataFrame(some.tolist(), "a double, b double, c double, d double, e double, f double"), ciede2000_stages(("a", "b", "c"), ("d", "e", "f"), 2.0))
    assert np.allclose([r.delta_e for r in sql.collect()], ciede2000(some[:, :3], some[:, 3:], 2.0), atol=1e-9)
    points, groups = rng.normal(size=(20, 3)), np.array([0] * 9 + [1] * 10 + [2])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    want = []
    for i, g in enumerate(groups):
        own = [d[i, j] for j in range(20) if groups[j] == g and j != i]
        near = min(np.mean([d[i, j] for j in range(20) if groups[j] == o]) for o in set(groups.tolist()) - {g})
        want.append((near - np.mean(own)) / max(near, np.mean(own)) if own else 0)
    assert abs(silhouettes(points, [groups], block=7)[0] - np.mean(want)) < 1e-12
    assert lab_hex(np.array([51.7517, 57.5539, 31.7471])) == "#da4749"


def test_group_counts(spark):
    rng = np.random.default_rng(3)
    labs = np.concatenate([rng.normal(c, 0.4, (12, 3)) for c in ((30, 0, 0), (60, 20, 0), (80, 0, 30))])
    got = group(labs)
    assert got.suggested == 3 and got.partitions[2].counts.tolist() == [12] * 3 and (np.diff(got.partitions[2].centroids[:, 0]) < 0).all()
    assert not np.allclose(got.enhanced, labs) and got.principal[:, 0].std() >= got.principal[:, 1].std() > 0
    raw = cuts(ward_merges(labs * [0.7, 1, 1]), len(labs), 4)[4]
    assert sorted(np.bincount(raw)) == sorted(got.partitions[3].counts)
    for n in (0, 1, 2):
        small = group(labs[:n])
        assert small.suggested == 1 and len(small.partitions) == max(n, 1) and (small.enhanced == labs[:n]).all()
    assert group(np.repeat(labs[:1], 5, 0)).suggested == 1
    df = spark.createDataFrame([(7, i, *map(float, v)) for i, v in enumerate(labs)], "photo_id long, object_id long, lab_l double, lab_a double, lab_b double")
    rows = suggest(spark, df, ward_groups(df), lambda text: plans._filled(text, plans.SPARK)).collect()
    assert len(rows) == 21 and {r.k for r in rows if r.suggested} == {3}
    for r in rows:
        own = got.partitions[r.k - 1]
        assert np.allclose((r.lab_l, r.lab_a, r.lab_b), own.centroids[r.grp], atol=1e-6) and r["size"] == own.counts[r.grp] and r.suggested == (r.k == got.suggested)
        assert r.k == 1 or (abs(r.separation - own.separation) < 1e-6 and abs(r.score - own.score) < 1e-6)


def test_whites_and_taps(spark):
    rgb = np.full((60, 90, 3), (90, 80, 70), np.uint8)
    rgb[:, :45] = (230, 225, 200)
    white = auto_white(rgb, "sRGB")
    assert white.found and not white.clipped and np.allclose(white.xyz, white_at(rgb, "sRGB", 10, 10, 4).xyz)
    assert white_at(rgb, "sRGB", -50, 10, 4) is None and white_at(np.full_like(rgb, 255), "sRGB", 5, 5, 3).clipped
    assert not auto_white(np.full((40, 40, 3), (200, 20, 20), np.uint8), "sRGB").found
    assert np.allclose(borrowed_white(rgb, "sRGB", white.xyz / 2)[1], white.xyz[1]) and np.allclose(borrowed_white(rgb // 2, "sRGB", white.xyz), white.xyz)
    assert np.allclose(sample_colour(rgb, "sRGB", white.xyz, 10, 10, 5), (PAPER_L, 0, 0), atol=1e-6)
    edge = sample_colour(rgb, "sRGB", white.xyz, 42, 30, 6)
    assert abs(edge[0] - PAPER_L) < 1e-6
    photos = spark.createDataFrame([("a", 90, 60, "sRGB", rgb.tobytes(), None), ("b", 5, 5, "sRGB", b"12", None)], "photo_id string, width int, height int, space string, rgb binary, white array<double>")
    got = {r.photo_id: r for r in measure_whites(photos).collect()}
    assert np.allclose(got["a"].white, white.xyz) and got["b"].white is None and got["b"].error
    taps = spark.createDataFrame([(1, "a", 10.0, 10.0, 5.0, None), (2, "a", -99.0, 0.0, 3.0, [1.0, 2.0, 3.0]), (3, None, None, None, None, [4.0, 5.0, 6.0]), (4, "b", 1.0, 1.0, 1.0, None), (5, "a", None, 1.0, 1.0, None)], "id long, photo_id string, x double, y double, r double, lab array<double>")
    assert [r.id for r in measure_taps(photos, taps.drop("lab")).collect()] == [1]
    changed, again = set_white(photos, taps, "a", [0.5, 0.5, 0.4])
    labs = {r.id: r.lab for r in again.collect()}
    assert changed.where("photo_id = 'a'").first().white == [0.5, 0.5, 0.4] and again.columns == taps.columns and len(labs) == 5
    assert np.allclose(labs[1], sample_colour(rgb, "sRGB", np.array([0.5, 0.5, 0.4]), 10, 10, 5)) and labs[2] == [1.0, 2.0, 3.0] and labs[3] == [4.0, 5.0, 6.0] and labs[4] is None
    assert set_white(changed, taps, "a", None)[0].where("photo_id = 'a'").first().white is None


def test_analysis_rows(spark):
    rgb, places, _ = scene("reds", 5, width=1200, height=320)
    rows = [(1, 1200, 320, "sRGB", rgb.tobytes()), (2, 64, 64, "sRGB", bytes(64 * 64 * 3)), (3, 9, 9, "sRGB", b""), (4, 4000, 2000, "sRGB", bytes(24_000_000)), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "photo_id long, width int, height int, space string, rgb binary").withColumn("status", F.lit("mine"))
    got = {r.photo_id: r for r in analyse_photos(df).collect()}
    assert [got[i].status == "ok" for i in range(1, 6)] == [True] + [False] * 4 and got[2].status == "no_objects" and got[4].status == "too_large"
    assert len(got[1].beans) == 15 and got[1].suggested == 3 and len(got[1].partitions) == 6 and got[2].beans is None
    assert analyse_photos(df.limit(0)).count() == 0


def test_robust_surface(spark):
    rows = [(1, u / 9, w / 9, 1 + u / 20 - (0.5 if u < -6 and w < -6 else 0) + 0.001 * ((u * 7 + w * 3) % 5 - 2)) for u in range(-9, 10) for w in range(-9, 10)] + [(2, 0.0, 0.0, 1.0)]
    points = spark.createDataFrame([(*r, r[3], 2 * r[3]) for r in rows], "photo_id long, u double, w double, v0 double, v1 double, v2 double")
    got = {r.photo_id: r for r in spark.sql(plans._filled(robust_text("SELECT * FROM {points}"), plans.SPARK), points=points).collect()}
    for k, times in enumerate((1, 1, 2)):
        assert np.allclose([got[1][f"c{i}{k}"] for i in range(6)], np.array((1, 9 / 20, 0, 0, 0, 0)) * times, atol=4e-3) and got[2][f"c0{k}"] is None


def png(rgb):
    """An 8-bit RGB PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_photo_files_and_reports(spark, tmp_path):
    rgb, _, _ = scene("reds", 5, width=1200, height=320)
    (tmp_path / "a.png").write_bytes(png(rgb))
    (tmp_path / "c.ppm").write_bytes(b"P6 1200 320 255\n" + rgb.tobytes())
    (tmp_path / "d.ppm").write_bytes(b"P6 9 9 255\n")
    got = read_photos(spark, str(tmp_path / "a.png")).first()
    assert (got.width, got.height) == (1200, 320) and got.rgb == rgb.tobytes()
    small = {r.photo_id[-5:]: r for r in read_ppm_photos(spark, str(tmp_path / "*.ppm"), most=300).collect()}
    assert (small["c.ppm"].width, small["c.ppm"].height) == (300, 80) and small["c.ppm"].rgb == shrink(rgb, 300).tobytes() and small["d.ppm"].error == "truncated"
    assert np.allclose(shrink(rgb, 600), rgb.reshape(160, 2, 600, 2, 3).mean((1, 3)), atol=0.51) and np.allclose(shrink(rgb, 7).mean(), rgb.mean(), atol=2)
    photo = read_ppm_photos(spark, str(tmp_path / "c.ppm"))
    assert next(report(spark, photo, "sort", [])).startswith("15 beans, 0 clumps, suggested groups: 3")
    (line,) = report(spark, photo, "white", [])
    assert line.startswith("white 0.") and line.endswith("found=true clipped=false")
    lines = list(report(spark, photo, "sample", ["600,300,6", "-90,0,3"], white=[0.65, 0.7, 0.55]))
    assert lines[0] == "white 0.6500,0.7000,0.5500  (given)" and lines[1].startswith("600,300,6        L ") and lines[2] == "-90,0,3: outside the photo"
    with pytest.raises(Failure, match="truncated"):
        list(report(spark, read_ppm_photos(spark, str(tmp_path / "d.ppm")), "white", []))
    assert triple("1,x,2,3") == [1, 2, 3]


def test_scenes_of_a_table(spark):
    """A rendered photo of every twenty suppliers, each an object in one of three look-alike reds; a tap on every object's place before jitter."""
    d = "/root/testdata/sf0.001"
    colour = "CASE s_suppkey * 7 % 3 " + " ".join(f"WHEN {i} THEN array({', '.join(f'{v}e0' for v in c)})" for i, c in enumerate(family("reds").tolist())) + " END"
    photos = scene_photos(plans.run(spark, d, f"SELECT photo_id, object_id, c[0] AS r, c[1] AS g, c[2] AS b FROM (SELECT s_suppkey div 20 AS photo_id, s_suppkey AS object_id, {colour} AS c FROM supplier) AS s"))
    at = plans.run(spark, d, "SELECT s_suppkey AS id, s_suppkey div 20 AS photo_id, row_number() OVER (PARTITION BY s_suppkey div 20 ORDER BY s_suppkey) - 1 AS i FROM supplier")
    taps = at.select("id", "photo_id", F.expr(f"({MARGIN}e0 + i % {COLUMNS} + 0.5e0 * (i div {COLUMNS} % 2)) * {PITCH}").alias("x"), F.expr(f"({MARGIN}e0 + i div {COLUMNS}) * {PITCH}").alias("y"), F.lit(5.0).alias("r"))
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").count()
    found = analyse_photos(photos).collect()
    assert sum(len(r.beans) for r in found) == suppliers and all(r.status == "ok" and r.white_paper for r in found)
    assert measure_taps(photos.withColumn("white", F.lit(None).cast("array<double>")), taps).count() == suppliers and all(r.found for r in measure_whites(photos).collect())


def test_photo_queries(spark):
    d = "/root/testdata/sf0.001"
    q = plans.queries()
    found = {r.photo_id: r for r in q["analyse_photos"](spark, d).collect()}
    beans = q["photo_objects"](spark, d).collect()
    assert set(found) == set(range(10)) and {r.status for r in found.values()} <= {"ok", "no_objects"} and any(r.status == "ok" for r in found.values())
    assert all(sum(b.photo_id == p for b in beans) == (r.beans if r.status == "ok" else 0) for p, r in found.items())
    rows = plans.photos(spark, d).collect()
    pixel = {(r.photo_id, r.y, r.x): (r.r, r.g, r.b) for r in plans.run(spark, d, plans._rgb()).collect()}
    assert all(tuple(r.rgb[3 * (64 * y + x) :][:3]) == pixel[r.photo_id, y, x] for r in rows for y, x in ((0, 0), (3, 7), (49, 63)))
    assert {r.k for r in q["group_suggestion"](spark, d).collect()} == set(range(1, 7)) and q["surface_fit_robust"](spark, d).where("c00 IS NULL").count() == 0


@pytest.mark.parametrize("query", ["photo_whites", "tap_colours"])
def test_whites_and_taps_of_photos_with_missing_lines(spark, tmp_path, query):
    """As in SQL: the last photo ends early, others lack lines at the top, in between, or all that whites are measured on."""
    duckdb = pytest.importorskip("duckdb")
    gone = "vec_id >= 356 OR vec_id BETWEEN 50 AND 57 OR vec_id IN (110, 112, 113, 119) OR vec_id BETWEEN 150 AND 199 AND vec_id % 50 % 4 = 0"
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where(f"NOT ({gone})").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in plans.queries()[query](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(plans.oracle_sql()[query]).fetchall()) and len(got) == {"photo_whites": 7, "tap_colours": 41}[query]
    status = {r.photo_id: r.status for r in plans.queries()["analyse_photos"](spark, str(tmp_path)).collect()}
    assert set(status) == set(range(8)) and status[7] == "no_objects" and "disagree" in status[2]
