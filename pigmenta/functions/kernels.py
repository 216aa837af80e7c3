"""Colour arithmetic on numpy arrays, for the kernels that see one whole photo."""

from __future__ import annotations

import numpy as np

from pigmenta.functions.color import BRADFORD, D65, KNEE, TO_XYZ, WHITE_Y

_V = np.arange(256) / 255
LIGHT = np.where(_V <= 0.04045, _V / 12.92, ((_V + 0.055) / 1.055) ** 2.4)
FROM_CONE = np.linalg.inv(BRADFORD)
CONE_TARGET = BRADFORD @ (D65 * WHITE_Y)


def rgb_xyz(rgb: np.ndarray, space: str) -> np.ndarray:
    return LIGHT[rgb] @ TO_XYZ[space].T


def xyz_lab(xyz: np.ndarray) -> np.ndarray:
    t = xyz / D65
    f = np.where(t > KNEE**3, np.cbrt(t), t / (3 * KNEE**2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def neutral_chroma(xyz: np.ndarray) -> np.ndarray:
    """Chroma with brightness divided out."""
    lab = xyz_lab(xyz / np.maximum(xyz[..., 1:2], 1e-4))
    return np.hypot(lab[..., 1], lab[..., 2])


def lab_hex(lab: np.ndarray, space: str = "sRGB") -> str:
    """Displayable colour of one Lab value, clipped to the gamut."""
    gy = (lab[0] + 16) / 116
    g = np.array([gy + lab[1] / 500, gy, gy - lab[2] / 200])
    xyz = np.where(g > KNEE, g**3, 3 * KNEE**2 * (g - 4 / 29)) * D65
    lin = np.clip(np.linalg.inv(TO_XYZ[space]) @ xyz, 0, 1)
    shown = np.where(lin <= 0.0031308, 12.92 * lin, 1.055 * lin ** (1 / 2.4) - 0.055)
    return "#" + "".join(f"{int(v):02x}" for v in np.floor(shown * 255 + 0.5))


def ciede2000(one: np.ndarray, two: np.ndarray, k_l: float = 1.0) -> np.ndarray:
    """CIEDE2000 difference over the last axis (Sharma, Wu and Dalal 2005)."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(np.asarray(one, float), -1, 0), np.moveaxis(np.asarray(two, float), -1, 0)
    c7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    g = 1.5 - 0.5 * np.sqrt(c7 / (c7 + 25.0**7))
    c1, c2 = np.hypot(g * a1, b1), np.hypot(g * a2, b2)
    h1, h2 = (np.where(c == 0, 0, np.degrees(np.arctan2(b, g * a)) % 360) for c, a, b in ((c1, a1, b1), (c2, a2, b2)))
    grey, dh = c1 * c2 == 0, h2 - h1
    far = np.abs(dh) > 180
    turn = np.where(grey, 0, np.where(far, dh - np.sign(dh) * 360, dh))
    mid = np.where(grey, h1 + h2, np.where(far, np.where(h1 + h2 < 360, h1 + h2 + 360, h1 + h2 - 360), h1 + h2) / 2)
    cm, lm = (c1 + c2) / 2, (l1 + l2) / 2 - 50
    wave = lambda k, d: np.cos(np.radians(k * mid + d))
    t = 1 - 0.17 * wave(1, -30) + 0.24 * wave(2, 0) + 0.32 * wave(3, 6) - 0.2 * wave(4, -63)
    d_l = (l2 - l1) / (k_l * (1 + 0.015 * lm**2 / np.sqrt(20 + lm**2)))
    d_c = (c2 - c1) / (1 + 0.045 * cm)
    d_h = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * cm * t)
    twist = -2 * np.sqrt(cm**7 / (cm**7 + 25.0**7)) * np.sin(np.radians(60 * np.exp(-(((mid - 275) / 25) ** 2))))
    return np.sqrt(np.maximum(d_l**2 + d_c**2 + d_h**2 + twist * d_c * d_h, 0))
