"""The data source ``ppm``: scaled while read, one partition a file, only the columns asked for."""

import io

import numpy as np
import pytest

from pigmenta.sources.photos import Scaler, read_ppm_photos, shrink
from pigmenta.sources.ppm_source import PpmSource, read_scaled


class Counting(io.BytesIO):
    most = 0

    def read(self, n=-1):
        data = super().read(n)
        self.most = max(self.most, len(data))
        return data


def by_area(rgb, w, h):
    """Mean over each cell of the small photo, with parts of pixels, in whole numbers."""
    big = np.repeat(np.repeat(rgb.astype(object), h, 0), w, 1)
    sums = big.reshape(h, rgb.shape[0], w, rgb.shape[1], 3).sum((1, 3))
    area = rgb.shape[0] * rgb.shape[1]
    return ((2 * sums + area) // (2 * area)).astype(np.uint8)


@pytest.mark.parametrize("size", [(7, 5, 3), (13, 29, 10), (40, 40, 39), (200, 3, 17), (5, 5, 1)])
def test_scaling_by_area_is_exact(size):
    h, w, most = size
    rgb = np.random.default_rng(h).integers(0, 256, (h, w, 3), np.uint8)
    got = shrink(rgb, most)
    assert max(got.shape[:2]) == most and (got == by_area(rgb, got.shape[1], got.shape[0])).all()
    assert shrink(rgb, 999) is rgb and Scaler(w, h, 999).size == (w, h)


def test_a_large_photo_is_never_held_whole():
    rgb = np.random.default_rng(1).integers(0, 256, (1500, 900, 3), np.uint8)
    file = Counting(b"P6\n# a note\n900 1500\n255\n" + rgb.tobytes())
    w, h, small = read_scaled(file, 300)
    assert (w, h) == (180, 300) and (small == shrink(rgb, 300)).all() and file.most <= 64 * 900 * 3
    same = read_scaled(io.BytesIO(b"P6 2 1 255\n" + bytes(range(6))), 1600)[2]
    assert same.tolist() == [[[0, 1, 2], [3, 4, 5]]]
    for data in (b"P6 2 2 255\n123", b"P5 2 2 255\n" + bytes(12), b"", b"P6 2 2 65535\n" + bytes(24)):
        with pytest.raises(ValueError):
            read_scaled(io.BytesIO(data), 1600)


def test_source(spark, tmp_path):
    rng = np.random.default_rng(2)
    shots = {f"{i}.ppm": rng.integers(0, 256, (50 + i, 90, 3), np.uint8) for i in range(3)}
    for name, rgb in shots.items():
        (tmp_path / name).write_bytes(b"P6 90 %d 255\n" % len(rgb) + rgb.tobytes())
    (tmp_path / "bad.ppm").write_bytes(b"P6 9 9 255\n")
    (tmp_path / "note.txt").write_text("no photo")
    spark.dataSource.register(PpmSource)
    read = lambda **o: spark.read.format("ppm").options(**o)
    df = read(maxSide="45", space="displayP3").load(f"{tmp_path}/*.ppm")
    got = {r.photo_id.rsplit("/", 1)[1]: r for r in df.collect()}
    want = {r.photo_id.rsplit("/", 1)[1]: r for r in read_ppm_photos(spark, f"{tmp_path}/*.ppm", "displayP3", 45).collect()}
    assert df.rdd.getNumPartitions() == 4 and {n: (r.width, r.height, r.space, r.rgb) for n, r in got.items() if not r.error} == {n: (r.width, r.height, r.space, r.rgb) for n, r in want.items() if not r.error}
    assert got["bad.ppm"].error == "truncated" and got["bad.ppm"].rgb is None and len(got) == 4
    sizes = read().schema("photo_id string, width int, height int, error string").load(f"{tmp_path}/*.ppm")
    assert sorted((r.width, r.height, r.error) for r in sizes.collect()) == [(9, 9, None), (90, 50, None), (90, 51, None), (90, 52, None)]  # the cut file's head is sound
    assert read().load(f"{tmp_path}/0.ppm").count() == 1 and read().load(f"file://{tmp_path}/0.ppm").first().width == 90
