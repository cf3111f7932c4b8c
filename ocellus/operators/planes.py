"""numpy kernels over pixels and planes, and the Arrow stages that run them: resizing, masks, class and depth maps.

Planes are little-endian binaries with their extents beside them; one image is one row, so no stage shuffles.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions.color import DEPTH_ALPHA, sample_numpy

IGNORE = 65535
FILL = 114
_BITS = 11
F32 = np.float32


def _half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def letterbox_geometry(height: int, width: int, in_h: int, in_w: int) -> tuple[float, int, int, int, int]:
    """(scale, new_h, new_w, pad_top, pad_left) as in functions.geometry.letterbox."""
    if not height or not width:
        scale = float(min([F32(in_h) / F32(height)] * bool(height) + [F32(in_w) / F32(width)] * bool(width), default=F32(1)))
    else:
        scale = float(min(F32(in_h) / F32(height), F32(in_w) / F32(width)))
    extent = lambda x: max(1, _half_up(float(F32(x) * F32(scale)))) if x else 0
    new_h, new_w = extent(height), extent(width)
    return scale, new_h, new_w, max(0, in_h - new_h) // 2, max(0, in_w - new_w) // 2


def rect_extents(height: int, width: int, in_h: int, in_w: int, stride: int) -> tuple[int, int]:
    """(h, w) as in functions.geometry.rect_size."""
    scale = min(F32(in_h) / F32(height), F32(in_w) / F32(width))
    up = lambda x: max(-(-_half_up(float(F32(x) * scale)) // stride) * stride, stride)
    return up(height), up(width)


@lru_cache(maxsize=64)
def _taps(src: int, dst: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-pixel bilinear taps of one axis: both indexes, and the second's weight in 11-bit fixed point."""
    at = (np.arange(dst, dtype=F32) + F32(0.5)) * (F32(src) / F32(dst)) - F32(0.5)
    at = np.clip(at, 0, src - 1)
    low = np.floor(at).astype(np.int64)
    weight = np.floor((at - low) * (1 << _BITS) + F32(0.5)).astype(np.int32)
    return low, np.minimum(low + 1, src - 1), weight


def letterbox_tensor(rgb: np.ndarray, in_h: int, in_w: int) -> np.ndarray:
    """(3, in_h, in_w) floats in [0, 1] of an (h, w, 3) image: fixed-point bilinear resize, gray padding."""
    out = np.full((3, in_h, in_w), F32(FILL) / F32(255), F32)
    h, w = rgb.shape[:2]
    if not h or not w:
        return out
    _, new_h, new_w, top, left = letterbox_geometry(h, w, in_h, in_w)
    y0, y1, fy = _taps(h, new_h)
    x0, x1, fx = _taps(w, new_w)
    one = np.int32(1 << _BITS)
    px = rgb.astype(np.int32)
    fx, fy = fx[None, :, None], fy[:, None, None]
    upper = px[y0][:, x0] * (one - fx) + px[y0][:, x1] * fx
    lower = px[y1][:, x0] * (one - fx) + px[y1][:, x1] * fx
    value = (upper * (one - fy) + lower * fy + (1 << (2 * _BITS - 1))) >> (2 * _BITS)
    out[:, top : top + new_h, left : left + new_w] = (value.astype(F32) * (F32(1) / F32(255))).transpose(2, 0, 1)
    return out


@lru_cache(maxsize=64)
def _filter(src: int, dst: int, begin: float, extent: float) -> np.ndarray:
    """(dst, src) weights of a triangle filter that widens when it shrinks, over [begin, begin + extent) of the source."""
    scale = extent / dst
    reach = max(scale, 1.0)
    center = begin + (np.arange(dst) + 0.5) * scale
    d = np.abs((np.arange(src)[None, :] + 0.5 - center[:, None]) / reach)
    weight = np.maximum(0.0, 1.0 - d)
    inside = (np.arange(src) + 1 > begin) & (np.arange(src) < begin + extent)
    weight *= inside[None, :]
    total = weight.sum(axis=1, keepdims=True)
    return weight / np.where(total > 0, total, 1)


def convolve_resize(plane: np.ndarray, dst_h: int, dst_w: int, crop: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """Bilinear resize by convolution of an (h, w) or (h, w, c) array; crop: (x, y, w, h) of the source that is used."""
    h, w = plane.shape[:2]
    x, y, cw, ch = crop or (0.0, 0.0, float(w), float(h))
    rows, cols = _filter(h, dst_h, y, ch), _filter(w, dst_w, x, cw)
    return np.einsum("yh,hw...,xw->yx...", rows, plane.astype(np.float64), cols, optimize=True)


def center_crop_tensor(rgb: np.ndarray, size: int) -> np.ndarray:
    """(3, size, size) floats: scaled to cover, cropped in the middle (offsets half to even), divided by 255."""
    h, w = rgb.shape[:2]
    if not h or not w:
        return np.full((3, size, size), F32(FILL) / F32(255), F32)
    sx, sy = F32(size) / F32(w), F32(size) / F32(h)
    new_w, new_h = (size, max(1, int(F32(h) * sx))) if sx >= sy else (max(1, int(F32(w) * sy)), size)
    big = np.clip(np.floor(convolve_resize(rgb, new_h, new_w) + 0.5), 0, 255)
    x, y = round(max(0, new_w - size) / 2), round(max(0, new_h - size) / 2)
    return (big[y : y + size, x : x + size].astype(F32) / F32(255)).transpose(2, 0, 1)


def crop_bounds(plane_h: int, plane_w: int, height: int, width: int) -> tuple[int, int, int, int] | None:
    """(top, left, h, w) of the image inside a letterboxed plane; None if nothing is left."""
    gain = min(F32(plane_h) / F32(height), F32(plane_w) / F32(width))

    def axis(plane: int, x: int) -> tuple[int, int]:
        half = (F32(plane) - F32(_half_up(float(F32(x) * gain)))) / F32(2)
        away = lambda v: int(np.sign(v) * np.floor(abs(float(v)) + 0.5))
        low = max(0, away(half - F32(0.1)))
        return low, max(0, plane - max(0, away(half + F32(0.1))) - low)

    top, h = axis(plane_h, height)
    left, w = axis(plane_w, width)
    return (top, left, h, w) if h and w else None


def _axis(dst: int, size: int, offset: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.maximum((np.arange(dst, dtype=F32) + F32(0.5)) * (F32(size) / F32(dst)) - F32(0.5), F32(0)) + F32(offset)
    low = np.minimum(np.floor(at).astype(np.int64), last)
    return low, np.minimum(low + 1, last), (at - low.astype(F32)).astype(F32)


def bilinear(planes: np.ndarray, height: int, width: int) -> np.ndarray | None:
    """(c, height, width): letterboxed planes (c, h, w) without their padding, at the image's size."""
    c, h, w = planes.shape
    box = crop_bounds(h, w, height, width) if h and w and height and width else None
    if box is None:
        return None
    top, left, ch, cw = box
    y0, y1, fy = _axis(height, ch, top, h - 1)
    x0, x1, fx = _axis(width, cw, left, w - 1)
    p = planes.astype(F32)
    upper = p[:, y0][:, :, x0] * (F32(1) - fx) + p[:, y0][:, :, x1] * fx
    lower = p[:, y1][:, :, x0] * (F32(1) - fx) + p[:, y1][:, :, x1] * fx
    return upper * (F32(1) - fy)[:, None] + lower * fy[:, None]


def class_map(logits: np.ndarray, height: int, width: int) -> np.ndarray | None:
    """(height, width) classes of logits (c, h, w): resized unless of that size, then the first best; one plane means > 0."""
    p = logits.astype(F32) if logits.shape[1:] == (height, width) else bilinear(logits, height, width)
    if p is None:
        return None
    if len(p) == 1:
        return (p[0] > 0).astype(np.uint16)
    best, out = p[0].copy(), np.zeros(p.shape[1:], np.uint16)
    for k in range(1, len(p)):
        over = p[k] > best
        best[over], out[over] = p[k][over], k
    return out


def baked_map(classes: np.ndarray, height: int, width: int) -> np.ndarray | None:
    """(height, width) classes of a class map (h, w) that the model made: nearest pixel, without the padding."""
    h, w = classes.shape
    if (h, w) == (height, width):
        return classes.astype(np.uint16)
    box = crop_bounds(h, w, height, width) if h and w and height and width else None
    if box is None:
        return None
    top, left, ch, cw = box
    at = lambda dst, size, offset: np.minimum(((np.arange(dst, dtype=F32) + F32(0.5)) * (F32(size) / F32(dst))).astype(np.int64), size - 1) + offset
    return classes[at(height, ch, top)][:, at(width, cw, left)].astype(np.uint16)


def instance_masks(coefficients: np.ndarray, protos: np.ndarray, boxes: np.ndarray, height: int, width: int, in_h: int, in_w: int, pad_top: float, pad_left: float) -> np.ndarray:
    """(n, height, width) soft masks: sigmoid of coefficients x prototypes, padding off, resized, zero outside the box."""
    n, (c, mh, mw) = len(coefficients), protos.shape
    low = 1 / (1 + np.exp(-(coefficients.astype(np.float64) @ protos.reshape(c, -1)))).reshape(n, mh, mw)
    x, y = pad_left * mw / in_w, pad_top * mh / in_h
    crop = (max(0.0, x), max(0.0, y), min(max(mw - 2 * x, 1.0), mw), min(max(mh - 2 * y, 1.0), mh))
    out = np.zeros((n, height, width), F32)
    ys, xs = np.arange(height)[:, None], np.arange(width)[None, :]
    for k in range(n):
        x1, y1, x2, y2 = np.clip(boxes[k], 0, [width, height, width, height])
        out[k] = np.where((xs >= x1) & (xs <= x2) & (ys >= y1) & (ys <= y2), convolve_resize(low[k], height, width, crop), 0)
    return out


def colorize(depth: np.ndarray, colormap: str = "jet", viz: str = "disparity") -> np.ndarray:
    """(h, w, 3) colors of a depth map; pixels without a depth are black.

    metric spreads depth over its own range, disparity 1 / depth over its 2nd to 98th percentile.
    """
    ok = depth > 0
    out = np.zeros((*depth.shape, 3), np.uint8)
    if not ok.any():
        return out
    d = depth[ok].astype(F32)
    if viz == "metric":
        low, high = d.min(), d.max()
        value, span = d, high - low if high > low else F32(1e-6)
    else:
        value = F32(1) / d
        ordered = np.sort(value)
        low, high = (ordered[min(len(ordered) - 1, _half_up(p * (len(ordered) - 1)))] for p in (0.02, 0.98))
        span = max(high - low, F32(1e-6))
    out[ok] = sample_numpy((value - low) * (F32(1) / span), colormap)
    return out


def blend_depth(rgb: np.ndarray, depth: np.ndarray, colormap: str = "jet", viz: str = "disparity", alpha: float = DEPTH_ALPHA) -> np.ndarray:
    """The image under its colorized depth; pixels without a depth stay."""
    mixed = rgb * (1 - alpha) + colorize(depth, colormap, viz) * alpha
    return np.where((depth > 0)[..., None], mixed, rgb).astype(np.uint8)


def pack(array: np.ndarray, dtype: str) -> bytes:
    return array.astype(dtype).tobytes()


def resized_depth(data: Column, h: Column, w: Column, height: Column, width: Column) -> Column:
    """binary: a depth plane (little-endian floats) at the image's size; null where it has none."""

    @F.arrow_udf("binary")
    def run(p: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        out = []
        for raw, ph, pw, oh, ow in zip(p.to_pylist(), a.to_pylist(), b.to_pylist(), c.to_pylist(), d.to_pylist()):
            got = None if raw is None or len(raw) < 4 * ph * pw else bilinear(np.frombuffer(raw, "<f4")[: ph * pw].reshape(1, ph, pw), oh, ow)
            out.append(None if got is None else pack(got[0], "<f4"))
        return pa.array(out, pa.binary())

    return run(data, h, w, height, width)


def semantic_map(data: Column, classes: Column, h: Column, w: Column, height: Column, width: Column) -> Column:
    """binary: the class map (little-endian 16-bit) of logits (classes, h, w) at the image's size; null where it has none."""

    @F.arrow_udf("binary")
    def run(p: pa.Array, n: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        out = []
        for raw, k, ph, pw, oh, ow in zip(p.to_pylist(), n.to_pylist(), a.to_pylist(), b.to_pylist(), c.to_pylist(), d.to_pylist()):
            bad = raw is None or not k or len(raw) < 4 * k * ph * pw
            got = None if bad else class_map(np.frombuffer(raw, "<f4")[: k * ph * pw].reshape(k, ph, pw), oh, ow)
            out.append(None if got is None else pack(got, "<u2"))
        return pa.array(out, pa.binary())

    return run(data, classes, h, w, height, width)


def semantic_output(data: Column, shape: Column, height: Column, width: Column) -> Column:
    """binary: the class map (little-endian 16-bit) of an output of any kind at the image's size; null where it has none.

    Of one byte a value it is a class map that the model made, (1, h, w) or (h, w); else it holds logits (1, c, h, w).
    """

    @F.arrow_udf("binary")
    def run(p: pa.Array, s: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        out = []
        for raw, dims, oh, ow in zip(p.to_pylist(), s.to_pylist(), c.to_pylist(), d.to_pylist()):
            count = int(np.prod(dims)) if dims else 0
            got = None
            if raw is not None and count and len(dims) >= 2 and len(raw) == count and count == dims[-1] * dims[-2]:
                got = baked_map(np.frombuffer(raw, np.uint8).reshape(dims[-2:]), oh, ow)
            elif raw is not None and count and len(dims) >= 3 and len(raw) == 4 * count:
                got = class_map(np.frombuffer(raw, "<f4")[: dims[-1] * dims[-2] * dims[-3]].reshape(dims[-3:]), oh, ow)
            out.append(None if got is None else pack(got, "<u2"))
        return pa.array(out, pa.binary())

    return run(data, shape, height, width)


def depth_layer(depth: np.ndarray, colormap: str = "jet", viz: str = "disparity") -> np.ndarray:
    """(h, w, 4): a colorized depth map without transparency."""
    return np.concatenate([colorize(depth, colormap, viz), np.full((*depth.shape, 1), 255, np.uint8)], axis=2)


def plane_values(data: Column, dtype: str = "<f4") -> Column:
    """A plane's binary as an array of doubles."""

    @F.arrow_udf("array<double>")
    def run(p: pa.Array) -> pa.Array:
        return pa.array([None if raw is None else np.frombuffer(raw, dtype).astype(np.float64) for raw in p.to_pylist()], pa.list_(pa.float64()))

    return run(data)


def mask_areas(dets: DataFrame, protos: DataFrame, in_h: int, in_w: int, threshold: float = 0.5) -> DataFrame:
    """(image_id, det_rank, area): pixels of each instance mask over the threshold.

    dets: rows of segment() with pad_top, pad_left, orig_h, orig_w; protos: (image_id, data, channels, h, w), a row an image.
    """
    joined = dets.join(protos.select("image_id", "data", "channels", F.col("h").alias("mh"), F.col("w").alias("mw")), "image_id")

    @F.arrow_udf("bigint")
    def run(co: pa.Array, data: pa.Array, shape: pa.Array, box: pa.Array, place: pa.Array) -> pa.Array:
        out = []
        for c, raw, s, b, g in zip(co.to_pylist(), data.to_pylist(), shape.to_pylist(), box.to_pylist(), place.to_pylist()):
            p = np.frombuffer(raw, "<f4").reshape(s["channels"], s["mh"], s["mw"])
            m = instance_masks(np.array([c], F32), p, np.array([[b[k] for k in ("x1", "y1", "x2", "y2")]]), g["orig_h"], g["orig_w"], in_h, in_w, g["pad_top"], g["pad_left"])
            out.append(int((m > threshold).sum()))
        return pa.array(out, pa.int64())

    area = run(F.col("coefficients"), F.col("data"), F.struct("channels", "mh", "mw"), F.struct("x1", "y1", "x2", "y2"), F.struct("orig_h", "orig_w", "pad_top", "pad_left"))
    return joined.select("image_id", "det_rank", area.alias("area"))
