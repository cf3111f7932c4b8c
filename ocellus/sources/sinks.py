"""Where results go: tables, JSON payloads, images on a file system, run folders."""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Only a session in one process, as in tests, may name none and get a temporary one."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    named = named or tempfile.mkdtemp(prefix="ocellus-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def next_run(base: str, name: str = "predict") -> str:
    """The first of base/name, base/name2, base/name3, ... that does not exist; it is made."""
    k = 1
    while True:
        path = os.path.join(base, name if k == 1 else f"{name}{k}")
        try:
            os.makedirs(path)
            return path
        except FileExistsError:
            k += 1


def is_writable(path: str) -> bool:
    return os.path.isdir(path) and os.access(path, os.W_OK)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels: np.ndarray) -> bytes:
    """A PNG of (h, w) 8- or 16-bit gray, (h, w, 3) RGB or (h, w, 4) RGBA pixels."""
    h, w = pixels.shape[:2]
    color = {2: 0, 3: 2 if pixels.ndim == 3 and pixels.shape[2] == 3 else 6}[pixels.ndim]
    deep = pixels.dtype == np.uint16
    rows = (pixels.astype(">u2") if deep else pixels.astype(np.uint8)).reshape(h, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16 if deep else 8, color, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def class_map_png(classes: np.ndarray) -> bytes:
    """A class map as gray PNG: 8 bits, or 16 if a class is over 255."""
    return png(classes.astype(np.uint16 if classes.size and classes.max() > 255 else np.uint8))


def bmp(rgb: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP, which every reader understands."""
    h, w = rgb.shape[:2]
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(r.tobytes() + pad for r in rgb[::-1, :, ::-1].astype(np.uint8))
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def write_files(df: DataFrame, folder: str, name: str = "name", data: str = "data") -> None:
    """Writes each row's bytes as folder/name, from the executors; folder has to be one that they share.

    A file is written beside its place and then moved, so that a task that runs twice leaves whole files.
    """

    def write(rows: Iterable[Row]) -> None:
        for row in rows:
            path = os.path.join(folder, row[name])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            beside = f"{path}.{os.getpid()}.part"
            with open(beside, "wb") as f:
                f.write(row[data])
            os.replace(beside, path)

    df.select(name, data).foreachPartition(write)


def payload(**parts: Column) -> Column:
    """One JSON object of the parts that are not null."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())))


def ranked_payload(dets: DataFrame, out: str, **parts: Column) -> DataFrame:
    """(image_id, out): what parts says of each detection of an image, as a JSON array in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("det_rank", F.struct(*(c.alias(k) for k, c in parts.items())).alias("o"))))
    return dets.groupBy("image_id").agg(F.to_json(F.transform(rows, lambda r: r["o"])).alias(out))


def box_payload(dets: DataFrame, name: str = "name", color: str = "color") -> DataFrame:
    """(image_id, boxes): the boxes of an image as a JSON array in rank order, with their names and colors."""
    own = {c: F.col(c) for c in ("x1", "y1", "x2", "y2", "conf", "cls")}
    return ranked_payload(dets, "boxes", **own, name=F.col(name), color=F.col(color))


def keypoint_payload(poses: DataFrame) -> DataFrame:
    """(image_id, keypoints): a JSON array of people, each an array of [x, y, confidence]; a missing confidence is null."""
    points = F.transform("keypoints", lambda k: F.array(k["x"], k["y"], k["conf"]))
    rows = F.array_sort(F.collect_list(F.struct("det_rank", points.alias("points"))))
    return poses.groupBy("image_id").agg(F.to_json(F.transform(rows, lambda r: r["points"])).alias("keypoints"))


def plane_payload(data: Column) -> Column:
    """A plane's bytes in base 64."""
    return F.base64(data)
