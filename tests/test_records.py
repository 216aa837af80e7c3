"""Changes of records that measure: new photos, taps, whites that are borrowed, groups saved as flavours; lookups."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pigmenta.operators import measure, records
from pigmenta.operators.measure import auto_white, borrowed_white, sample_colour, white_at

START = dt.datetime(2026, 1, 5, 9, 0)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def shot(colour, size=(40, 60), paper=False):
    rgb = np.full((*size, 3), colour, np.uint8)
    if paper:
        rgb[:, : size[1] // 2] = (230, 225, 200)
    return rgb


SHOTS = {"p1": shot((90, 80, 70), paper=True), "p2": shot((200, 20, 20)), "p3": shot((20, 20, 200)), "p4": shot((200, 30, 20)), "p5": shot((10, 150, 10))}


@pytest.fixture(scope="module")
def photos(spark):
    when = {"p1": 0, "p2": 30, "p3": 119, "p4": 120, "p5": 500}
    rows = [("a", p, at(when[p]), 60, 40, "sRGB", bytearray(rgb.tobytes())) for p, rgb in SHOTS.items()] + [("b", "q1", at(10), 60, 40, "sRGB", bytearray(SHOTS["p2"].tobytes())), ("a", "broken", at(40), 60, 40, "sRGB", bytearray(b"xyz"))]
    return spark.createDataFrame(rows, "project string, photo_id string, created timestamp, width int, height int, space string, rgb binary")


RECORDS = "project string, photo_id string, created timestamp, width int, height int, white array<double>, clipped boolean, basis string"


def test_new_photos_find_borrow_or_guess_their_white(spark, photos):
    none = spark.createDataFrame([], RECORDS)
    first = measure.add_photos(none, photos.where("photo_id = 'p1'"))
    assert [(r.photo_id, r.basis, r.clipped) for r in first.collect()] == [("p1", "found", False)]
    lent = auto_white(SHOTS["p1"], "sRGB").xyz
    got = {r.photo_id: r for r in measure.add_photos(first, photos.where("photo_id <> 'p1'")).collect()}
    assert {p: r.basis for p, r in got.items()} == {"p1": "found", "p2": "borrowed", "p3": "borrowed", "p4": "camera", "p5": "camera", "q1": "camera"}  # two hours are too long; another project lends nothing
    for p in ("p2", "p3"):
        assert np.allclose(got[p].white, borrowed_white(SHOTS[p], "sRGB", lent))
    assert np.allclose(got["p4"].white, auto_white(SHOTS["p4"], "sRGB").xyz)
    more = spark.createDataFrame([("a", x, at(m), 1, 1, [v] * 3, False, b) for x, m, v, b in (("t1", 20, 0.5, "tapped"), ("t2", 20, 0.6, "tapped"), ("t3", 25, 0.7, "borrowed"), ("t4", 31, 0.8, "found"))], RECORDS)
    (again,) = measure.automatic_whites(photos.where("photo_id = 'p2'"), first.unionByName(more)).collect()
    assert again.basis == "borrowed" and np.allclose(again.white, borrowed_white(SHOTS["p2"], "sRGB", np.array([0.6] * 3)))  # the latest measured one; of equal times the larger id


def test_white_of_a_tap_and_of_a_reset(spark, photos):
    white = measure.white_under(photos, "p1", 10, 10, 4)
    assert np.allclose(white, white_at(SHOTS["p1"], "sRGB", 10, 10, 4).xyz) and measure.white_under(photos, "p1", -90, 0, 3) is None
    rows = [("s1", "p1", 45.0, 20.0, 5.0, [1.0, 2.0, 3.0]), ("s2", "p1", -50.0, 20.0, 5.0, [4.0, 5.0, 6.0]), ("s3", "p2", 5.0, 5.0, 3.0, [7.0, 8.0, 9.0])]
    samples = spark.createDataFrame(rows, "id string, photo_id string, x double, y double, r double, lab array<double>")
    of = photos.withColumn("white", F.lit(None).cast("array<double>"))
    changed, after = measure.set_white(of, samples, "p1", white)
    got = {r.id: r.lab for r in after.collect()}
    assert np.allclose(got["s1"], sample_colour(SHOTS["p1"], "sRGB", np.array(white), 45, 20, 5)) and got["s2"] == [4, 5, 6] and got["s3"] == [7, 8, 9]
    assert changed.where("photo_id = 'p1'").first().white == white


SAMPLES = "id string, kind string, label string, photo_id string, x double, y double, r double, lab array<double>, available boolean"


def test_samples_are_added_where_the_tap_lies_on_the_photo(spark, photos):
    old = spark.createDataFrame([("s0", "paper", "#7", "p1", 1.0, 1.0, 2.0, [1.0, 1.0, 1.0], True), ("s1", "bean", "Bean x", "p1", 1.0, 1.0, 2.0, [1.0, 1.0, 1.0], True)], SAMPLES)
    taps = spark.createDataFrame([("t1", "paper", None, "p1", 10.0, 10.0, 4.0), ("t2", "paper", None, "p1", 45.0, 10.0, 4.0), ("t3", "bean", None, "p1", 45.0, 20.0, 4.0), ("t4", "bean", "Lime", "p1", 45.0, 30.0, 4.0), ("t5", "bean", "Off", "p1", -45.0, 30.0, 4.0), ("t6", "bean", "Lost", "nowhere", 1.0, 1.0, 1.0)], "id string, kind string, label string, photo_id string, x double, y double, r double")
    white = [0.7, 0.7, 0.6]
    got = {r.id: r for r in measure.add_samples(old, photos.withColumn("white", F.array(*map(F.lit, white))), taps).collect()}
    assert {i: r.label for i, r in got.items()} == {"s0": "#7", "s1": "Bean x", "t1": "#8", "t2": "#9", "t3": "Bean 1", "t4": "Lime"} and all(r.available for r in got.values())
    assert np.allclose(got["t3"].lab, sample_colour(SHOTS["p1"], "sRGB", np.array(white), 45, 20, 4))
    saved = measure.add_flavor(old, "g", "Plum", [50, 1, 2], "p1").where("id = 'g'").first()
    assert (saved.kind, saved.label, saved.photo_id, saved.x, saved.lab, saved.available) == ("bean", "Plum", "p1", None, [50.0, 1.0, 2.0], True)


def test_lookups(spark):
    some = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert [r.v for r in records.by_id(some, "b").collect()] == [2] and records.by_id(some, "z").count() == records.by_id(some, None).count() == 0
    parts = spark.createDataFrame([(p, k, g) for p, most in ((1, 4), (2, 2)) for k in range(1, most + 1) for g in range(k)], "photo_id long, k int, grp int")
    shown = lambda *a: sorted(tuple(r) for r in records.partition_for(parts, *a).select("photo_id", "k", "grp").collect())
    assert shown(3) == [(1, 3, 0), (1, 3, 1), (1, 3, 2), (2, 1, 0)] and shown(3, 1) == [(1, 3, 1)] and shown(2, 1) == [(1, 2, 1), (2, 2, 1)]
