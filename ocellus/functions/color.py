"""Palettes, text contrast, the pose skeleton and depth colormaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _palette(colors: list[str]) -> np.ndarray:
    return np.array([list(bytes.fromhex(c[1:])) for c in colors], np.uint8)


#: Class colors, in the order in which common viewers of such models use them, so that pictures look alike.
COLORS = _palette(
    [
        "#042aff", "#0bdbeb", "#f3f3f3", "#00dfb7", "#111f68", "#ff6fdd", "#ff444f", "#cced00", "#00f344", "#bd00ff",
        "#00b4ff", "#dd00ba", "#00ffff", "#26c000", "#01ffb3", "#7d24ff", "#7b0068", "#ff1b6c", "#fc6d2f", "#a2ff0b",
    ]
)
#: Colors that limbs and keypoints refer to.
POSE_COLORS = _palette(
    [
        "#ff8000", "#ff9933", "#ffb266", "#e6e600", "#ff99ff", "#99ccff", "#ff66ff", "#ff33ff", "#66b2ff", "#3399ff",
        "#ff9999", "#ff6666", "#ff3333", "#99ff99", "#66ff66", "#33ff33", "#00ff00", "#0000ff", "#ff0000", "#ffffff",
    ]
)
#: The eleven-class diverging scheme "Spectral" of ColorBrewer, from blue to red.
SPECTRAL = _palette(
    [
        "#5e4fa2", "#3387bc", "#66c2a5", "#aadca4", "#e6f598", "#fffebe", "#fee08b", "#fdad60", "#f46d43", "#d43d4f",
        "#9e0142",
    ]
)
#: The limbs of the 17-point skeleton of COCO, by the places of their ends.
LIMBS = [
    (15, 13),
    (13, 11),
    (16, 14),
    (14, 12),
    (11, 12),
    (5, 11),
    (6, 12),
    (5, 6),
    (5, 7),
    (6, 8),
    (7, 9),
    (8, 10),
    (1, 2),
    (0, 1),
    (0, 2),
    (1, 3),
    (2, 4),
    (3, 5),
    (4, 6),
]
#: Entries of POSE_COLORS for legs, trunk, arms and head; for head, arms and legs.
LIMB_COLORS = [0] * 4 + [7] * 3 + [9] * 5 + [16] * 7
KEYPOINT_COLORS = [16] * 5 + [9] * 6 + [0] * 6
DEPTH_ALPHA = 0.6
COLORMAPS = ("inferno", "jet", "spectral", "gray")
#: Polynomials that fit the "inferno" colormap of matplotlib, a row a channel, constant term first.
INFERNO = [
    [0.0002189404, 0.1065134, 11.60249, -41.704, 77.16294, -71.31943, 25.13113],
    [0.001651005, 0.5639564, -3.972854, 17.4364, -33.40236, 32.62606, -12.24267],
    [-0.0194809, 3.932712, -15.94239, 44.35415, -81.80731, 73.20952, -23.07032],
]


def hex_color(index: Column, palette: np.ndarray = COLORS) -> Column:
    """#RRGGBB of a class, colors repeating."""
    codes = F.array(*(F.lit("#" + bytes(c).hex().upper()) for c in palette))
    return F.get(codes, F.pmod(index, F.lit(len(palette))).cast("int"))


def text_color(r: Column, g: Column, b: Column) -> Column:
    """black on colors of luminance over 150, else white."""
    return F.when(F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b > 150, "black").otherwise("white")


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def sample(t: Column, colormap: str) -> Column:
    """struct(r, g, b) of a value in [0, 1], computed in double precision and rounded half up."""
    t = _unit(t.cast("double"))
    if colormap == "gray":
        channels = [t * 255] * 3
    elif colormap == "jet":
        channels = [_unit(1.5 - F.abs(t * 4 - c)) * 255 for c in (3, 2, 1)]
    elif colormap == "inferno":
        channels = []
        for row in INFERNO:
            v = F.lit(row[-1])
            for c in reversed(row[:-1]):
                v = v * t + c
            channels.append(_unit(v) * 255)
    elif colormap == "spectral":
        x = t * 10
        i = F.least(F.floor(x), F.lit(9)).cast("int")
        channels = []
        for c in range(3):
            anchors = F.array(*(F.lit(float(v)) for v in SPECTRAL[:, c]))
            low, high = F.get(anchors, i), F.get(anchors, i + 1)
            channels.append((x - i) * (high - low) + low)
    else:
        raise ValueError(f"unknown colormap: {colormap}")
    return F.struct(*(F.floor(v + 0.5).cast("int").alias(k) for k, v in zip("rgb", channels)))


def sample_numpy(t: np.ndarray, colormap: str) -> np.ndarray:
    """sample() for an array: one more axis of three bytes."""
    t = np.clip(t.astype(np.float64), 0, 1)
    if colormap == "gray":
        out = np.stack([t * 255] * 3, axis=-1)
    elif colormap == "jet":
        out = np.stack([np.clip(1.5 - np.abs(t * 4 - c), 0, 1) * 255 for c in (3, 2, 1)], axis=-1)
    elif colormap == "inferno":
        out = np.stack([np.clip(np.polyval(row[::-1], t), 0, 1) * 255 for row in INFERNO], axis=-1)
    elif colormap == "spectral":
        x = t * 10
        i = np.minimum(x.astype(int), 9)
        low, high = SPECTRAL[i].astype(float), SPECTRAL[i + 1].astype(float)
        out = (x - i)[..., None] * (high - low) + low
    else:
        raise ValueError(f"unknown colormap: {colormap}")
    return np.floor(out + 0.5).astype(np.uint8)
