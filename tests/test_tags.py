"""Orientation and colour profiles: a turned and a wide-gamut fixture read as their plain twins."""

import struct
import zlib

import numpy as np
import pytest

from pigmenta.functions.color import TO_XYZ
from pigmenta.sources.photos import read_photos
from pigmenta.sources.tags import _adapted, managed, read_tags, turned


def exif(value, order="<"):
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIHHHIHHI", 42, 8, 1, 0x0112, 3, 1, value, 0, 0)


def icc(matrix, curve):
    """A profile of three colorants and one curve."""
    xyz = [b"XYZ \0\0\0\0" + struct.pack(">3i", *(round(v * 65536) for v in c)) for c in np.asarray(matrix).T]
    names = [b"rXYZ", b"gXYZ", b"bXYZ", b"rTRC", b"gTRC", b"bTRC"]
    bodies, table, at = [*xyz, curve, curve, curve], b"", 132 + 12 * 6
    for name, body in zip(names, bodies, strict=True):
        table += struct.pack(">4sII", name, at, len(body))
        at += len(body)
    return bytes(128) + struct.pack(">I", 6) + table + b"".join(bodies)


PARA = b"para\0\0\0\0" + struct.pack(">HH5i", 3, 0, *(round(v * 65536) for v in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)))
GAMMA = b"curv\0\0\0\0" + struct.pack(">IH", 1, round(2.2 * 256))


def png(rgb, turn=None, profile=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in rgb)
    extra = (chunk(b"iCCP", b"x\0\0" + zlib.compress(profile)) if profile else b"") + (chunk(b"eXIf", exif(turn)) if turn else b"")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg_head(turn, profile):
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    half = len(profile) // 2
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xE2, b"ICC_PROFILE\0\x02\x02" + profile[half:]) + segment(0xE1, b"Exif\0\0" + exif(turn, ">")) + segment(0xE2, b"ICC_PROFILE\0\x01\x02" + profile[:half]) + b"\xff\xda"


# Where the top left and the top right pixel of the photo as it is seen stand in the file, by orientation.
SEEN = {1: ("a", "b"), 2: ("b", "a"), 3: ("d", "c"), 4: ("c", "d"), 5: ("a", "c"), 6: ("c", "a"), 7: ("d", "b"), 8: ("b", "d")}


@pytest.mark.parametrize("turn", range(1, 9))
def test_turns(turn):
    file = np.array([["a", "x", "b"], ["c", "y", "d"]])
    seen = turned(file, turn)
    assert (seen[0, 0], seen[0, -1]) == SEEN[turn] and seen.shape == ((2, 3) if turn < 5 else (3, 2))


def test_tags_of_files():
    profile = icc(_adapted("displayP3"), PARA)
    assert read_tags(jpeg_head(6, profile)) == (6, profile)
    rgb = np.zeros((2, 2, 3), np.uint8)
    assert read_tags(png(rgb, 8, profile)) == (8, profile) and read_tags(png(rgb)) == (1, None) == read_tags(b"GIF89a")
    assert read_tags(jpeg_head(77, profile))[0] == 1 and read_tags(jpeg_head(6, profile)[:20])[0] == 1


def test_profiles():
    rgb = np.random.default_rng(1).integers(0, 256, (9, 9, 3), np.uint8)
    for space in TO_XYZ:
        same, own = managed(rgb, icc(_adapted(space), PARA), "other")
        assert own == space and (same == rgb).all()
    linear, own = managed(rgb, icc(_adapted("displayP3"), b"curv\0\0\0\0" + struct.pack(">I", 0)))
    v = rgb / 255
    assert own == "displayP3" and (linear == np.floor(np.where(v <= 0.0031308, 12.92 * v, 1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5)).mean() > 0.99
    wide, own = managed(rgb, icc(_adapted("sRGB"), GAMMA))  # another curve, so its values become those of the wider space
    grey = managed(np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)[None], icc(_adapted("sRGB"), GAMMA))[0]
    assert own == "displayP3" and np.ptp(wide.astype(int), -1).mean() < np.ptp(rgb.astype(int), -1).mean() and (np.ptp(grey.astype(int), -1) <= 1).all()
    for broken in (b"", bytes(128), bytes(131) + b"\x05" + b"rXYZ"):
        assert managed(rgb, broken, "kept")[1] == "kept"


def test_turned_and_wide_files_read_as_their_twins(spark, tmp_path):
    rgb = np.random.default_rng(3).integers(0, 256, (30, 50, 3), np.uint8)
    back = {2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}
    (tmp_path / "plain.png").write_bytes(png(rgb))
    (tmp_path / "p3.png").write_bytes(png(rgb, profile=icc(_adapted("displayP3"), PARA)))
    for turn, undo in back.items():
        (tmp_path / f"t{turn}.png").write_bytes(png(turned(rgb, undo), turn))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = {r.photo_id.rsplit("/", 1)[1]: r for r in read_photos(spark, f"{tmp_path}/*.png").collect()}
    assert all((got[f"t{t}.png"].width, got[f"t{t}.png"].height, got[f"t{t}.png"].rgb) == (50, 30, rgb.tobytes()) for t in back)
    assert got["p3.png"].space == "displayP3" and got["plain.png"].space == "sRGB" and got["p3.png"].rgb == got["plain.png"].rgb == rgb.tobytes()
