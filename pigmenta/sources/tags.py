"""What image files say about themselves: how the photo is to be turned, and the colour space of its values."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from pigmenta.functions.color import BRADFORD, D65, TO_XYZ

# Fixed values of the formats: the orientation tag, and the white of profiles.
ORIENTATION = 0x0112
D50 = np.array([0.9642, 1.0, 0.8249])
#: Largest difference of a colorant from the known spaces' (profiles round to 1 / 65536, and their authors further).
NEAR = 0.003


def _jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack_from(">H", data, at + 2)[0]
        yield data[at + 1], data[at + 4 : at + 2 + size]
        at += 2 + size


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def _tiff_orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    at = struct.unpack_from(f"{order}I", tiff, 4)[0]
    if at + 2 > len(tiff):
        return 1
    for i in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
        entry = at + 2 + 12 * i
        if entry + 12 > len(tiff):
            return 1
        tag, kind = struct.unpack_from(f"{order}HH", tiff, entry)
        if tag == ORIENTATION and kind == 3:
            value = struct.unpack_from(f"{order}H", tiff, entry + 8)[0]
            return value if 1 <= value <= 8 else 1
    return 1


def read_tags(data: bytes) -> tuple[int, bytes | None]:
    """Orientation (1 to 8; 1 if there is none or it can't be read) and colour profile of a JPEG or PNG file."""
    turn, profile = 1, None
    if data[:2] == b"\xff\xd8":
        parts = []
        for marker, body in _jpeg_segments(data):
            if marker == 0xE1 and body[:6] == b"Exif\0\0":
                turn = _tiff_orientation(body[6:])
            elif marker == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(body) > 14:
                parts.append((body[12], body[14:]))
        profile = b"".join(b for _, b in sorted(parts)) or None
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        for name, body in _png_chunks(data):
            if name == b"eXIf":
                turn = _tiff_orientation(body)
            elif name == b"iCCP":
                try:
                    profile = zlib.decompress(body[body.index(b"\0") + 2 :])
                except (ValueError, zlib.error):
                    profile = None
    return turn, profile


def turned(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as the photo is to be seen: values 2, 4, 5 and 7 mirror it as well."""
    if orientation in (5, 6, 7, 8):
        rgb = rgb.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        rgb = rgb[::-1]
    if orientation in (2, 3, 6, 7):
        rgb = rgb[:, ::-1]
    return np.ascontiguousarray(rgb)


def _profile_tags(profile: bytes) -> dict[bytes, bytes]:
    n = struct.unpack_from(">I", profile, 128)[0]
    out = {}
    for i in range(min(n, 200)):
        name, at, size = struct.unpack_from(">4sII", profile, 132 + 12 * i)
        out[name] = profile[at : at + size]
    return out


def _fixed(data: bytes, at: int, n: int) -> np.ndarray:
    return np.array(struct.unpack_from(f">{n}i", data, at)) / 65536


def _curve(tag: bytes) -> np.ndarray:
    """Linear light of the 256 values."""
    v = np.arange(256) / 255
    if tag[:4] == b"curv":
        n = struct.unpack_from(">I", tag, 8)[0]
        if n == 0:
            return v
        points = np.array(struct.unpack_from(f">{n}H", tag, 12))
        return v ** (points[0] / 256) if n == 1 else np.interp(v, np.linspace(0, 1, n), points / 65535)
    if tag[:4] == b"para":
        kind = struct.unpack_from(">H", tag, 8)[0]
        g, a, b, c, d, e, f = np.concatenate([_fixed(tag, 12, (1, 3, 4, 5, 7)[kind]), np.zeros(7)])[:7]
        if kind == 0:
            return v**g
        if kind in (1, 2):
            return np.where(v >= -b / a, np.maximum(a * v + b, 0) ** g, 0) + (c if kind == 2 else 0)
        return np.where(v >= d, np.maximum(a * v + b, 0) ** g + e, c * v + f)
    raise ValueError("curve")


def _adapted(space: str) -> np.ndarray:
    """The space's matrix to XYZ under the white of profiles."""
    gain = (BRADFORD @ D50) / (BRADFORD @ D65)
    return np.linalg.inv(BRADFORD) @ np.diag(gain) @ BRADFORD @ TO_XYZ[space]


def managed(rgb: np.ndarray, profile: bytes | None, space: str = "sRGB") -> tuple[np.ndarray, str]:
    """Pixels and their space: values of the two known spaces stay as they are, those of another profile of a matrix and curves become displayP3.

    ``space`` holds where there is no profile, or one of another kind (tables, grey), or one that can't be read.
    """
    if profile is None:
        return rgb, space
    try:
        tags = _profile_tags(profile)
        matrix = np.stack([_fixed(tags[t], 8, 3) for t in (b"rXYZ", b"gXYZ", b"bXYZ")], 1)
        curves = [_curve(tags[t]) for t in (b"rTRC", b"gTRC", b"bTRC")]
    except (KeyError, ValueError, IndexError, struct.error):
        return rgb, space
    v = np.arange(256) / 255
    known = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    alike = max(np.abs(c - known).max() for c in curves) < 0.002
    for name in TO_XYZ:
        if alike and np.abs(matrix - _adapted(name)).max() < NEAR:
            return rgb, name
    light = np.stack([c[rgb[..., i]] for i, c in enumerate(curves)], -1) @ (np.linalg.inv(_adapted("displayP3")) @ matrix).T
    light = np.clip(light, 0, 1)
    shown = np.where(light <= 0.0031308, 12.92 * light, 1.055 * light ** (1 / 2.4) - 0.055)
    return np.floor(shown * 255 + 0.5).astype(np.uint8), "displayP3"
