"""Decoding of prediction heads into typed rows.

A head is a DataFrame (image_id, pred_id, cx, cy, w, h, scores [, extra]) in the network's pixels; the geometry of each
image (scale, pad_top, pad_left, orig_h, orig_w) stands beside it. Outputs are rows in the original image's pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ocellus.functions import geometry as G
from ocellus.functions import vectors as V
from ocellus.functions.config import InferenceConfig
from ocellus.operators.nms import nms

#: Rows that a head of (x1, y1, x2, y2, conf, cls) rows may have to count as decoded already.
END2END_ROWS = 4096


def class_filter(cls: Column, config: InferenceConfig) -> Column:
    """Whether a class is asked for; it looks at the best class only, so a second best never rescues a box."""
    if config.classes is None:
        return F.lit(True)
    return cls.isin(list(config.classes)) if config.classes else F.lit(False)


def is_end2end(task: str, shape: list[int], keypoints: int = 0, masks: int = 0) -> bool:
    """Whether an output of this shape holds final rows (box, conf, cls, ...) rather than a head to suppress."""
    width = {"detect": 6, "segment": 6 + masks, "pose": 6 + keypoints, "obb": 7}.get(task)
    return width is not None and len(shape) == 3 and shape[1] <= END2END_ROWS and shape[2] == width


def keypoint_shape(width: int) -> tuple[int, int] | None:
    """(points, values a point) of so many keypoint values; None where 2 and 3 values a point both fit, or neither."""
    two, three = width % 2 == 0, width % 3 == 0
    if width <= 0 or two == three:
        return None
    return (width // 3, 3) if three else (width // 2, 2)


def head_shape(shape: list[int], names: int) -> tuple[int, int, bool] | None:
    """(classes, predictions, features first) of a detection output of 2 or 3 dimensions; None if it is no head.

    The axis that equals 4 + names is the features; without such an axis the shorter one is, and classes follow from it.
    """
    dims = shape[1:] if len(shape) == 3 else shape
    if len(dims) != 2:
        return None
    a, b = dims
    if names and 4 + names in (a, b):
        return (names, b, True) if a == 4 + names else (names, a, False)
    features = min(a, b)
    return (features - 4, max(a, b), a <= b) if features > 4 else None


def _best(head: DataFrame, best: Column) -> DataFrame:
    return head.withColumn("__best", best).filter(F.col("__best").isNotNull()).withColumn("cls", F.col("__best.cls")).withColumn("conf", F.col("__best.score")).drop("__best", "scores")


def _box(df: DataFrame, clip: bool) -> DataFrame:
    box = G.scale_coords(G.xywh_to_xyxy(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), F.col("scale"), F.col("pad_top"), F.col("pad_left"))
    if clip:
        box = G.clip_coords(box, F.col("orig_h"), F.col("orig_w"))
    return df.withColumn("__box", box).select("*", "__box.*").drop("__box", "cx", "cy", "w", "h")


def _clip(df: DataFrame) -> DataFrame:
    box = G.clip_coords(F.struct("x1", "y1", "x2", "y2"), F.col("orig_h"), F.col("orig_w"))
    keep = [c for c in df.columns if c not in ("x1", "y1", "x2", "y2")]
    return df.withColumn("__box", box).select(*keep, "__box.*")


def detect_candidates(head: DataFrame, config: InferenceConfig) -> DataFrame:
    """Boxes over the confidence (strictly) whose first best class is asked for."""
    found = _best(head, V.first_best(F.col("scores"))).filter((F.col("conf") > G.f32(config.conf)) & class_filter(F.col("cls"), config))
    return _box(found, clip=False)


def detect(head: DataFrame, config: InferenceConfig, strategy: str = "numpy") -> DataFrame:
    """(image_id, det_rank, pred_id, cls, conf, x1, y1, x2, y2): suppression sees unclipped boxes, the result is clipped.

    Only the 10 * max_det best boxes of an image take part.
    """
    kept = nms(detect_candidates(head, config), config.iou, strategy=strategy, before=10 * config.max_det, limit=config.max_det, rank="det_rank")
    return _clip(kept).select("image_id", "det_rank", "pred_id", "cls", "conf", "x1", "y1", "x2", "y2")


def boxes_inclusive(head: DataFrame, config: InferenceConfig) -> DataFrame:
    """Candidates of segment and pose heads: last best class, confidence reached or passed, clipped before suppression."""
    found = _best(head, V.last_best(F.col("scores"))).filter((F.col("conf") >= G.f32(config.conf)) & class_filter(F.col("cls"), config))
    return _box(found, clip=True)


def segment(head: DataFrame, config: InferenceConfig) -> DataFrame:
    """detect() by the rules of segment heads; `extra` goes through as the mask's coefficients."""
    kept = nms(boxes_inclusive(head, config), config.iou, limit=config.max_det, rank="det_rank")
    return kept.select("image_id", "det_rank", "pred_id", "cls", "conf", "x1", "y1", "x2", "y2", F.col("extra").alias("coefficients"))


def scale_keypoints(extra: Column, dim: int) -> Column:
    """array of struct(x, y, conf) from a flat array: scaled, clamped to the image; conf is null for two values a point."""

    def point(k: Column) -> Column:
        x = G.clamp(G.ratio(F.get(extra, k * dim) - F.col("pad_left"), F.col("scale")), 0, F.col("orig_w"))
        y = G.clamp(G.ratio(F.get(extra, k * dim + 1) - F.col("pad_top"), F.col("scale")), 0, F.col("orig_h"))
        conf = F.get(extra, k * dim + 2) if dim == 3 else F.lit(None).cast("float")
        return F.struct(x.alias("x"), y.alias("y"), conf.alias("conf"))

    return F.transform(F.sequence(F.lit(0), F.floor(F.size(extra) / dim).cast("int") - 1), point)


def pose(head: DataFrame, config: InferenceConfig, dim: int = 3) -> DataFrame:
    """detect() by the rules of pose heads, with keypoints: array of struct(x, y, conf)."""
    boxes = boxes_inclusive(head, config).withColumn("keypoints", scale_keypoints(F.col("extra"), dim)).drop("extra")
    return nms(boxes, config.iou, limit=config.max_det, rank="det_rank").select("image_id", "det_rank", "pred_id", "cls", "conf", "x1", "y1", "x2", "y2", "keypoints")


def obb(head: DataFrame, config: InferenceConfig) -> DataFrame:
    """(image_id, det_rank, pred_id, cls, conf, cx, cy, w, h, angle): rotated boxes; the angle is the head's last value.

    Centers are scaled and clamped, extents only scaled; suppression uses probabilistic IoU.
    """
    found = _best(head, V.last_best(F.col("scores"))).filter((F.col("conf") >= G.f32(config.conf)) & class_filter(F.col("cls"), config))
    out = found.select(
        "image_id",
        "pred_id",
        "cls",
        "conf",
        *_turned(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.get(F.col("extra"), F.lit(0))),
    )
    kept = nms(out, config.iou, columns=("cx", "cy", "w", "h", "angle"), limit=config.max_det, rank="det_rank")
    return kept.select("image_id", "det_rank", "pred_id", "cls", "conf", "cx", "cy", "w", "h", "angle")


def classify(logits: DataFrame, scores: str = "scores") -> DataFrame:
    """logits with `probs`: softmaxed, unless it is a distribution already."""
    return logits.withColumn("probs", V.softmax(F.col(scores)))


def _read(rows: DataFrame, config: InferenceConfig) -> DataFrame:
    """Final rows in order, up to the first confidence under the threshold (a NaN is not under it); then the class filter and the max_det cap."""
    order = Window.partitionBy("image_id").orderBy("pred_id")
    low = (F.col("conf") < G.f32(config.conf)) & ~F.isnan("conf")
    read = rows.withColumn("__stop", F.max(low).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("__stop")).drop("__stop")
    return read.filter(class_filter(F.col("cls"), config)).withColumn("det_rank", F.row_number().over(order).cast("long") - 1).filter(F.col("det_rank") < config.max_det)


def end2end(rows: DataFrame, config: InferenceConfig) -> DataFrame:
    """Final rows (image_id, pred_id, x1, y1, x2, y2, conf, cls, extra) read in order, without suppression.

    Boxes are scaled and clipped; `extra` goes through.
    """
    kept = _read(rows, config)
    box = G.clip_coords(G.scale_coords(F.struct("x1", "y1", "x2", "y2"), F.col("scale"), F.col("pad_top"), F.col("pad_left")), F.col("orig_h"), F.col("orig_w"))
    keep = [c for c in kept.columns if c not in ("x1", "y1", "x2", "y2")]
    return kept.withColumn("__box", box).select(*keep, "__box.*")


def _turned(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> list[Column]:
    """A rotated box in the image's pixels: the center is scaled and clamped, extents are only scaled."""
    return [
        G.clamp(G.ratio(cx - F.col("pad_left"), F.col("scale")), 0, F.col("orig_w")).alias("cx"),
        G.clamp(G.ratio(cy - F.col("pad_top"), F.col("scale")), 0, F.col("orig_h")).alias("cy"),
        G.ratio(w, F.col("scale")).alias("w"),
        G.ratio(h, F.col("scale")).alias("h"),
        angle.alias("angle"),
    ]


def end2end_obb(rows: DataFrame, config: InferenceConfig) -> DataFrame:
    """end2end() of rotated boxes: the four box values are center and extents, the first of `extra` is the angle."""
    box = _turned(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.get("extra", F.lit(0)))
    return _read(rows, config).select("image_id", "det_rank", "pred_id", "cls", "conf", *box)


def denormalize(head: DataFrame, in_h: int, in_w: int, dim: int = 0) -> DataFrame:
    """Heads in units of the input (no box value of an image over 2) in pixels; others are left as they are.

    dim: values a point, if `extra` holds keypoints; their x and y are scaled too.
    """
    w = Window.partitionBy("image_id")
    most = F.max(F.greatest(*(F.abs(c) for c in ("cx", "cy", "w", "h")))).over(w)
    out = head.withColumn("__unit", most <= 2.0)
    for c, size in (("cx", in_w), ("cy", in_h), ("w", in_w), ("h", in_h)):
        out = out.withColumn(c, F.when(F.col("__unit"), F.col(c) * G.f32(size)).otherwise(F.col(c)))
    if dim:
        size = lambda k: F.when(F.pmod(k, F.lit(dim)) == 0, G.f32(in_w)).when(F.pmod(k, F.lit(dim)) == 1, G.f32(in_h)).otherwise(G.f32(1))
        out = out.withColumn("extra", F.when(F.col("__unit"), F.transform("extra", lambda v, k: v * size(k))).otherwise(F.col("extra")))
    return out.drop("__unit")
