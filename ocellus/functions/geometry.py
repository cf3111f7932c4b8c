"""Box, letterbox and rotated-box geometry as Catalyst expressions.

Model values are 32-bit floats. Spark keeps +, -, * of floats as float but widens division and transcendental
functions to double, so every division is cast back: thresholds then fall on the same side as in 32-bit code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def f32(x: Value) -> Column:
    """x as a 32-bit float."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def ratio(a: Value, b: Value) -> Column:
    """a / b in 32 bits; null for b = 0, which least() passes over."""
    return F.try_divide(f32(a), f32(b)).cast("float")


def clamp(x: Column, low: Value, high: Value) -> Column:
    """x within [low, high]; NaN stays NaN, which least() and greatest() alone would not do."""
    inside = F.least(F.greatest(x, f32(low)), f32(high))
    return F.when(F.isnan(x), x).otherwise(inside)


def xywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """struct(x1, y1, x2, y2) of a box given by center and extent."""
    half_w, half_h = f32(w) * f32(0.5), f32(h) * f32(0.5)
    return F.struct((f32(cx) - half_w).alias("x1"), (f32(cy) - half_h).alias("y1"), (f32(cx) + half_w).alias("x2"), (f32(cy) + half_h).alias("y2"))


def xyxy_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(x, y, w, h): midpoint and extent."""
    return F.struct(((x1 + x2) * f32(0.5)).alias("x"), ((y1 + y2) * f32(0.5)).alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def scale_coords(box: Column, scale: Value, pad_top: Value, pad_left: Value) -> Column:
    """A box of the network's input in the original image's pixels: padding off, then divided by the gain."""
    return F.struct(
        ratio(box["x1"] - f32(pad_left), scale).alias("x1"),
        ratio(box["y1"] - f32(pad_top), scale).alias("y1"),
        ratio(box["x2"] - f32(pad_left), scale).alias("x2"),
        ratio(box["y2"] - f32(pad_top), scale).alias("y2"),
    )


def clip_coords(box: Column, height: Value, width: Value) -> Column:
    """A box clamped to the image."""
    return F.struct(clamp(box["x1"], 0, width).alias("x1"), clamp(box["y1"], 0, height).alias("y1"), clamp(box["x2"], 0, width).alias("x2"), clamp(box["y2"], 0, height).alias("y2"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, 0 where the union is not positive."""
    zero = f32(0)
    inter = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), zero) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), zero)
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - inter
    return F.when(union > 0, ratio(inter, union)).otherwise(zero)


def _covariance(w: Column, h: Column, angle: Column) -> tuple[Column, Column, Column]:
    a, b = w * w / 12, h * h / 12
    c, s = F.cos(angle), F.sin(angle)
    return a * c * c + b * s * s, a * s * s + b * c * c, (a - b) * c * s


def probiou(p: Column, q: Column) -> Column:
    """Overlap of two rotated boxes (cx, cy, w, h, angle): 1 - Hellinger distance of their Gaussians, in double precision."""
    eps = 1e-7
    d = lambda r, k: r[k].cast("double")
    a1, b1, c1 = _covariance(d(p, "w"), d(p, "h"), d(p, "angle"))
    a2, b2, c2 = _covariance(d(q, "w"), d(q, "h"), d(q, "angle"))
    a, b, c = a1 + a2, b1 + b2, c1 + c2
    dx, dy = d(p, "cx") - d(q, "cx"), d(p, "cy") - d(q, "cy")
    det = a * b - c * c
    near = (a * dy * dy + b * dx * dx) / (det + eps) * 0.25
    tilt = (c * -dx * dy) / (det + eps) * 0.5
    own = F.sqrt(F.greatest(a1 * b1 - c1 * c1, F.lit(0.0)) * F.greatest(a2 * b2 - c2 * c2, F.lit(0.0)))
    spread = F.log(det / (4 * own + eps) + eps) * 0.5
    bd = F.least(F.greatest(near + tilt + spread, F.lit(eps)), F.lit(100.0))
    return 1 - F.sqrt(1 - F.exp(-bd) + eps)


def letterbox(height: Column, width: Column, in_h: Value, in_w: Value) -> Column:
    """struct(scale, new_w, new_h, pad_left, pad_top) of an image fitted into the input; empty extents stay empty."""
    in_h, in_w = (x if isinstance(x, Column) else F.lit(x) for x in (in_h, in_w))
    scale = F.least(ratio(in_h, height), ratio(in_w, width))
    extent = lambda x: F.when(x == 0, F.lit(0)).otherwise(F.greatest(F.round(f32(x) * scale).cast("int"), F.lit(1)))
    new_w, new_h = extent(width), extent(height)
    pad = lambda room, new: F.floor(F.greatest(room - new, F.lit(0)) / 2).cast("int")
    return F.struct(scale.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"), pad(in_w, new_w).alias("pad_left"), pad(in_h, new_h).alias("pad_top"))


def rect_size(height: Column, width: Column, in_h: int, in_w: int, stride: int) -> Column:
    """struct(h, w): the smallest multiples of the stride that hold the fitted image, one stride at least."""
    scale = F.least(ratio(in_h, height), ratio(in_w, width))
    up = lambda x: F.greatest(F.ceil(F.round(f32(x) * scale) / stride).cast("int") * stride, F.lit(stride))
    return F.struct(up(height).alias("h"), up(width).alias("w"))


def center_crop(height: Column, width: Column, size: int) -> Column:
    """struct(scale, new_w, new_h, crop_x, crop_y): the image scaled to cover size x size, offsets rounded half to even."""
    sx, sy = ratio(size, width), ratio(size, height)
    new_w = F.when(sx >= sy, F.lit(size)).otherwise(F.floor(f32(width) * sy).cast("int"))
    new_h = F.when(sx >= sy, F.floor(f32(height) * sx).cast("int")).otherwise(F.lit(size))
    offset = lambda new: F.rint(F.greatest(new - size, F.lit(0)) / 2).cast("int")
    return F.struct(F.greatest(sx, sy).alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"), offset(new_w).alias("crop_x"), offset(new_h).alias("crop_y"))


def crop_bounds(plane_h: Column, plane_w: Column, height: Column, width: Column) -> Column:
    """struct(top, left, h, w) of the image inside a letterboxed plane; null if nothing is left."""
    gain = F.least(ratio(plane_h, height), ratio(plane_w, width))
    half = lambda plane, x: (f32(plane) - F.round(f32(x) * gain).cast("float")) * f32(0.5)
    ph, pw = half(plane_h, height), half(plane_w, width)
    low = lambda p: F.greatest(F.round(p - f32(0.1)).cast("int"), F.lit(0))
    high = lambda plane, p: F.greatest(plane - F.greatest(F.round(p + f32(0.1)).cast("int"), F.lit(0)), F.lit(0))
    top, left = low(ph), low(pw)
    h, w = F.greatest(high(plane_h, ph) - top, F.lit(0)), F.greatest(high(plane_w, pw) - left, F.lit(0))
    return F.when((h > 0) & (w > 0), F.struct(top.alias("top"), left.alias("left"), h.alias("h"), w.alias("w")))


#: Confidence from which a keypoint counts as seen.
VISIBLE = 0.25


def visible(x: Column, y: Column, conf: Column, height: Value, width: Value) -> Column:
    """Whether a keypoint is sure enough and strictly inside the image; one without a confidence is sure."""
    return (F.coalesce(conf, F.lit(1.0).cast("float")) >= f32(VISIBLE)) & (x > 0) & (x < width) & (y > 0) & (y < height)


def corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """array of struct(x, y): the corners of a rotated box, from the one that is top left before the turn, clockwise."""
    c, s = F.cos(angle.cast("double")), F.sin(angle.cast("double"))
    out = []
    for ix, iy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        dx, dy = w.cast("double") * ix, h.cast("double") * iy
        out.append(F.struct((cx.cast("double") + dx * c - dy * s).alias("x"), (cy.cast("double") + dx * s + dy * c).alias("y")))
    return F.array(*out)


def bounds(corner_list: Column, height: Value, width: Value) -> Column:
    """struct(x1, y1, x2, y2): the upright box around corners, clamped to the image."""
    xs, ys = F.transform(corner_list, lambda p: p["x"]), F.transform(corner_list, lambda p: p["y"])
    h, w = (x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in (height, width))
    fit = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    return F.struct(fit(F.array_min(xs), w).alias("x1"), fit(F.array_min(ys), h).alias("y1"), fit(F.array_max(xs), w).alias("x2"), fit(F.array_max(ys), h).alias("y2"))
