"""Greedy non-maximum suppression per (image, class).

Suppression depends on the boxes kept so far, so each (image, class) is one ordered unit. It is done over sorted
partitions in Arrow batches with numpy in 32 bits; `strategy="fold"` is the same as a pure Catalyst expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ocellus.functions.geometry import iou as iou_column

_SMALL = 512


def iou_rows(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """IoU of boxes (.., 4) in 32 bits; 0 where the union is not positive."""
    w = np.minimum(box[..., 2], others[..., 2]) - np.maximum(box[..., 0], others[..., 0])
    h = np.minimum(box[..., 3], others[..., 3]) - np.maximum(box[..., 1], others[..., 1])
    zero = np.float32(0)
    inter = np.maximum(w, zero) * np.maximum(h, zero)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    union = area(box) + area(others) - inter
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union > 0, inter / union, zero).astype(np.float32)


def _spread(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, d, c, s = b[..., 2] ** 2 / 12, b[..., 3] ** 2 / 12, np.cos(b[..., 4]), np.sin(b[..., 4])
    return a * c * c + d * s * s, a * s * s + d * c * c, (a - d) * c * s


def probiou_rows(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Probabilistic IoU of rotated boxes (.., cx cy w h angle), in double precision."""
    eps = 1e-7
    p, q = box.astype(np.float64), others.astype(np.float64)
    (a1, b1, c1), (a2, b2, c2) = _spread(p), _spread(q)
    a, b, c = a1 + a2, b1 + b2, c1 + c2
    dx, dy = p[..., 0] - q[..., 0], p[..., 1] - q[..., 1]
    det = a * b - c * c
    near = (a * dy * dy + b * dx * dx) / (det + eps) * 0.25
    tilt = (c * -dx * dy) / (det + eps) * 0.5
    own = np.sqrt(np.maximum(a1 * b1 - c1 * c1, 0) * np.maximum(a2 * b2 - c2 * c2, 0))
    bd = np.clip(near + tilt + np.log(det / (4 * own + eps) + eps) * 0.5, eps, 100)
    return 1 - np.sqrt(1 - np.exp(-bd) + eps)


def greedy(boxes: np.ndarray, threshold: float, overlap: Callable[[np.ndarray, np.ndarray], np.ndarray] = iou_rows) -> np.ndarray:
    """Which boxes stay, of boxes in order of preference: a box goes if one that stays overlaps it by more than threshold."""
    n = len(boxes)
    alive = np.ones(n, bool)
    limit = np.float32(threshold) if overlap is iou_rows else threshold
    if n <= _SMALL:
        over = overlap(boxes[:, None, :], boxes[None, :, :]) > limit
        for i in range(n):
            if alive[i]:
                alive[i + 1 :] &= ~over[i, i + 1 :]
    else:
        for i in range(n):
            if alive[i]:
                rest = i + 1 + np.flatnonzero(alive[i + 1 :])
                alive[rest[overlap(boxes[i], boxes[rest]) > limit]] = False
    return alive


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of the (sorted) keys ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = tuple(batch.column(k)[-1].as_py() for k in keys)
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == v
        border = batch.num_rows - int(same[::-1].cumprod().sum())
        if border:
            yield pa.Table.from_batches([*held, batch.slice(0, border)])
            held = []
        held.append(batch.slice(border))
    if held:
        yield pa.Table.from_batches(held)


def nms(
    boxes: DataFrame,
    threshold: float,
    columns: tuple[str, ...] = ("x1", "y1", "x2", "y2"),
    image: str = "image_id",
    cls: str = "cls",
    score: str = "conf",
    tie: str = "pred_id",
    strategy: str = "numpy",
    before: int | None = None,
    limit: int | None = None,
    rank: str | None = None,
) -> DataFrame:
    """The rows of boxes that per-class greedy suppression keeps, all columns.

    Preference: higher score, NaN last, then smaller `tie`. Suppression is strict (> threshold) and only inside one
    image and class. Five columns are rotated boxes (cx, cy, w, h, angle) and use probabilistic IoU. before: only so many
    of an image's best rows take part. rank: a column that is added, with the rank in the image from 0; limit: the ranks
    that stay. All of it is done behind one shuffle by image.
    """
    if strategy == "fold":
        first = ranked(boxes, before, "__pre", image, score, tie).drop("__pre") if before else boxes
        kept = _fold(first, threshold, columns, image, cls, score, tie)
        return ranked(kept, limit or 1 << 31, rank, image, score, tie) if rank else kept
    nan, key = "__nan", "__key"
    s = F.col(score)
    ready = boxes.withColumn(nan, F.isnan(s)).withColumn(key, F.when(F.isnan(s), F.lit(0.0).cast("float")).otherwise(-s))
    ready = ready.repartition(image).sortWithinPartitions(image, cls, nan, key, tie)
    overlap = iou_rows if len(columns) == 4 else probiou_rows
    own = boxes.columns

    def borders(*keys: np.ndarray) -> np.ndarray:
        change = np.zeros(len(keys[0]), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        return np.concatenate([[0], np.flatnonzero(change), [len(change)]]) if len(change) else np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, [image]):
            best = [table.column(c).to_numpy() for c in (tie, key, nan, image)]  # np.lexsort reads them from the last

            def ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """The rows by image and preference, and their ranks."""
                rows = rows[np.lexsort([k[rows] for k in best])]
                first = borders(best[-1][rows])
                return rows, np.arange(len(rows)) - np.repeat(first[:-1], np.diff(first))

            rows = np.arange(table.num_rows)
            if before:
                rows, at = ranks(rows)
                rows = np.sort(rows[at < before])
            a, b = best[-1][rows], table.column(cls).to_numpy()[rows]
            xy = np.stack([table.column(c).to_numpy()[rows] for c in columns], axis=1).astype(np.float32)
            first = borders(a, b)
            kept = rows[np.concatenate([greedy(xy[i:j], threshold, overlap) for i, j in zip(first[:-1], first[1:])])]
            if rank is None:
                yield from table.select(own).take(pa.array(kept)).to_batches()
                continue
            kept, at = ranks(kept)
            if limit is not None:
                kept, at = kept[at < limit], at[at < limit]
            yield from table.select(own).take(pa.array(kept)).append_column(rank, pa.array(at.astype(np.int64))).to_batches()

    return ready.mapInArrow(run, T.StructType([*boxes.schema.fields, *([T.StructField(rank, T.LongType())] if rank else [])]))


def _fold(boxes: DataFrame, threshold: float, columns: tuple[str, ...], image: str, cls: str, score: str, tie: str) -> DataFrame:
    """nms() as collect_list, array_sort and aggregate(): upright boxes only."""
    if len(columns) != 4:
        raise ValueError("the fold is for upright boxes")
    s = F.col(score)
    key = F.struct(F.isnan(s).alias("nan"), (-s).alias("key"), F.col(tie).alias("tie"), F.struct(*(F.col(c).alias(k) for c, k in zip(columns, ("x1", "y1", "x2", "y2")))).alias("b"), F.struct(*boxes.columns).alias("row"))
    grouped = boxes.groupBy(image, cls).agg(F.array_sort(F.collect_list(key)).alias("s"))
    limit = F.lit(threshold).cast("float")
    kept = F.aggregate("s", F.slice("s", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: iou_column(k["b"], b["b"]) > limit), acc).otherwise(F.array_append(acc, b)))
    return grouped.select(F.explode(kept).alias("k")).select("k.row.*")


def ranked(boxes: DataFrame, limit: int, rank: str, image: str = "image_id", score: str = "conf", tie: str = "pred_id") -> DataFrame:
    """The `limit` best rows of each image, with their rank from 0: NaN last, ties by `tie`."""
    w = Window.partitionBy(image).orderBy(F.isnan(score), F.desc(score), F.col(tie))
    return boxes.withColumn(rank, F.row_number().over(w).cast("long") - 1).filter(F.col(rank) < limit)
