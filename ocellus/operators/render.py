"""Drawing on images: boxes, masks, rotated boxes, skeletons, class lists as bars, semantic and depth overlays.

There are no fonts here, so labels are drawn as filled plates in the class color and their text is returned as data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

from ocellus.functions.color import COLORS, KEYPOINT_COLORS, LIMB_COLORS, LIMBS, POSE_COLORS
from ocellus.functions.geometry import VISIBLE
from ocellus.operators.planes import IGNORE, blend_depth

MASK_ALPHA = 0.3
SEGMENT_OVERLAY, SEMANTIC_OVERLAY = 140, 128


def scale_of(height: int, width: int) -> float:
    """How much thicker lines are on large images."""
    return max(1.0, max(height, width) / 640)


def ink(rgb: Sequence[int]) -> str:
    """black on colors of luminance over 150, else white."""
    return "black" if 0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2] > 150 else "white"


def fill(image: np.ndarray, x1: float, y1: float, x2: float, y2: float, color: Sequence[int], alpha: float = 1.0) -> None:
    h, w = image.shape[:2]
    a, b, c, d = max(0, int(y1)), min(h, int(y2)), max(0, int(x1)), min(w, int(x2))
    if a < b and c < d:
        image[a:b, c:d] = (image[a:b, c:d] * (1 - alpha) + np.asarray(color) * alpha).astype(np.uint8)


def rectangle(image: np.ndarray, box: Sequence[float], color: Sequence[int], thick: int = 1) -> None:
    x1, y1, x2, y2 = box
    fill(image, x1, y1, x2, y1 + thick, color)
    fill(image, x1, y2 - thick, x2, y2, color)
    fill(image, x1, y1, x1 + thick, y2, color)
    fill(image, x2 - thick, y1, x2, y2, color)


def line(image: np.ndarray, p: Sequence[float], q: Sequence[float], color: Sequence[int], thick: int = 1) -> None:
    n = int(max(abs(q[0] - p[0]), abs(q[1] - p[1]))) + 1
    xs, ys = np.rint(np.linspace(p[0], q[0], n)).astype(int), np.rint(np.linspace(p[1], q[1], n)).astype(int)
    h, w = image.shape[:2]
    for dy in range(-(thick // 2), thick - thick // 2):
        for dx in range(-(thick // 2), thick - thick // 2):
            x, y = xs + dx, ys + dy
            ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            image[y[ok], x[ok]] = color


def disc(image: np.ndarray, center: Sequence[float], radius: int, color: Sequence[int]) -> None:
    h, w = image.shape[:2]
    ys, xs = np.ogrid[:h, :w]
    image[(xs - center[0]) ** 2 + (ys - center[1]) ** 2 <= radius**2] = color


def place_label(box: Sequence[float], width: int, height: int, image_h: int, image_w: int, taken: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int]:
    """Where a label's plate goes: above the box, inside the image, moved down at most ten times off plates that stand there."""
    x, y = max(0, min(int(box[0]), image_w - width)), int(box[1]) - height
    y = y if y >= 0 else int(box[1])
    for _ in range(10):
        if not any(x < c and a < x + width and y < d and b < y + height for a, b, c, d in taken):
            break
        y += height
    y = max(0, min(y, image_h - height))
    plate = (x, y, x + width, y + height)
    taken.append(plate)
    return plate


def label(cls: int, conf: float, names: Mapping[int, str]) -> str:
    return f" {names.get(cls, 'class')} {conf:.2f} "


def draw_detections(image: np.ndarray, boxes: np.ndarray, names: Mapping[int, str], masks: np.ndarray | None = None) -> tuple[np.ndarray, list[str]]:
    """(image, label texts) with boxes (n, 6: x1 y1 x2 y2 conf cls) and, under them, their masks."""
    out = image.copy()
    s = scale_of(*image.shape[:2])
    if masks is not None:
        for m, b in zip(masks, boxes):
            over = m > 0.5
            out[over] = (out[over] * (1 - MASK_ALPHA) + COLORS[int(b[5]) % len(COLORS)] * MASK_ALPHA).astype(np.uint8)
    taken: list[tuple[int, int, int, int]] = []
    texts = []
    for b in boxes:
        color = COLORS[int(b[5]) % len(COLORS)]
        rectangle(out, b[:4], color, max(1, round(2 * s)))
        texts.append(label(int(b[5]), float(b[4]), names))
        fill(out, *place_label(b, int(6 * s * len(texts[-1])), int(12 * s), *image.shape[:2], taken), color)
    return out, texts


def draw_obb(image: np.ndarray, corners: np.ndarray, classes: Sequence[int]) -> np.ndarray:
    """Outlines of rotated boxes given by their corners (n, 4, 2)."""
    out = image.copy()
    thick = max(1, round(2 * scale_of(*image.shape[:2])))
    for quad, cls in zip(corners, classes):
        for k in range(4):
            line(out, quad[k], quad[(k + 1) % 4], COLORS[int(cls) % len(COLORS)], thick)
    return out


def draw_pose(image: np.ndarray, keypoints: np.ndarray) -> np.ndarray:
    """Skeletons of (n, k, 2 or 3) keypoints; points without a confidence count as sure. Limbs are drawn for 17 points."""
    out = image.copy()
    h, w = image.shape[:2]
    s = scale_of(h, w)
    for person in keypoints:
        conf = person[:, 2] if person.shape[1] > 2 else np.ones(len(person))
        seen = (conf >= VISIBLE) & (person[:, 0] > 0) & (person[:, 0] < w) & (person[:, 1] > 0) & (person[:, 1] < h)
        full = len(person) == len(KEYPOINT_COLORS)
        for (a, b), c in zip(LIMBS if full else [], LIMB_COLORS):
            if seen[a] and seen[b]:
                line(out, person[a], person[b], POSE_COLORS[c], max(1, round(2 * s)))
        for k in np.flatnonzero(seen):
            disc(out, person[k], round(3 * s), POSE_COLORS[KEYPOINT_COLORS[k] if full else k % len(POSE_COLORS)])
    return out


def draw_semantic(image: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Half image, half class color; ignored pixels stay."""
    over = classes != IGNORE
    mixed = image // 2 + COLORS[classes % len(COLORS)] // 2
    return np.where(over[..., None], mixed, image).astype(np.uint8)


def draw_classes(image: np.ndarray, probs: np.ndarray, names: Mapping[int, str], top: int = 5) -> tuple[np.ndarray, list[str]]:
    """(image, texts) of the best classes, as bars at the top left."""
    order = sorted(range(len(probs)), key=lambda k: (np.isnan(probs[k]), -probs[k] if not np.isnan(probs[k]) else 0, k))[:top]
    out = image.copy()
    s = scale_of(*image.shape[:2])
    for row, k in enumerate(order):
        fill(out, 4, 4 + row * 14 * s, 4 + 100 * s * float(np.nan_to_num(probs[k])), 4 + (row * 14 + 10) * s, COLORS[k % len(COLORS)], 0.6)
    return out, [f"{names.get(k, 'class')} {probs[k]:.2f}" for k in order]


def overlay(boxes: np.ndarray, masks: np.ndarray | None, classes: np.ndarray | None, height: int, width: int) -> np.ndarray:
    """An RGBA layer: instance masks over 0.5, or the class map; the rest is transparent."""
    out = np.zeros((height, width, 4), np.uint8)
    if classes is not None:
        over = classes != IGNORE
        out[over, :3], out[over, 3] = COLORS[classes[over] % len(COLORS)], SEMANTIC_OVERLAY
    elif masks is not None:
        for m, b in zip(masks, boxes):
            out[m > 0.5, :3], out[m > 0.5, 3] = COLORS[int(b[5]) % len(COLORS)], SEGMENT_OVERLAY
    return out


def annotate(image: np.ndarray, names: Mapping[int, str], semantic: np.ndarray | None = None, boxes: np.ndarray | None = None, masks: np.ndarray | None = None, keypoints: np.ndarray | None = None, obb: tuple[np.ndarray, Sequence[int]] | None = None, probs: np.ndarray | None = None, depth: np.ndarray | None = None, colormap: str = "jet", viz: str = "disparity") -> np.ndarray:
    """All that a result holds, drawn in this order: class map, boxes, skeletons, rotated boxes, class list, depth."""
    out = image.copy() if semantic is None else draw_semantic(image, semantic)
    if boxes is not None:
        out = draw_detections(out, boxes, names, masks)[0]
    if keypoints is not None:
        out = draw_pose(out, keypoints)
    if obb is not None:
        out = draw_obb(out, *obb)
    if probs is not None:
        out = draw_classes(out, probs, names)[0]
    return out if depth is None else blend_depth(out, depth, colormap, viz)
