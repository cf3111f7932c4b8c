"""Image sources: files, lists, folders, patterns, arrays, frame folders. Decoding is the JVM's image reader."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ocellus.functions.config import ImageError
from ocellus.functions.text import IMAGE_SUFFIXES, VIDEO_SUFFIXES, suffix
from ocellus.sources.sinks import shared_folder

COLUMNS = ("path", "frame_idx", "total_frames", "fps", "image", "error")
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def kind_of(source: str) -> str:
    """webcam, image_url, stream, glob, directory, video or image."""
    low = source.lower()
    if source.lstrip("+").isdigit() and source.isascii() and int(source) < 1 << 32:
        return "webcam"
    if source.startswith(("http://", "https://")):
        return "image_url" if low.partition("?")[0].rpartition("/")[2].rpartition(".")[2] in IMAGE_SUFFIXES else "stream"
    if source.startswith(("rtsp://", "rtmp://")):
        return "stream"
    if "*" in source:
        return "glob"
    if os.path.isdir(source):
        return "directory"
    return "video" if low.rpartition(".")[2] in VIDEO_SUFFIXES else "image"


#: Paths up to which their numbers are broadcast to the images; beyond that both are shuffled by path.
MAX_BROADCAST = 1_000_000


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _numbered(spark: SparkSession, folder: str, ending: str = "") -> DataFrame:
    """Source columns for the image files of a folder whose names have the ending, numbered in the order of their paths.

    Paths alone are listed, ranged and numbered, each range from where the one before ends; pixels are not moved for it.
    """
    wanted = lambda p: suffix(p).isin(*IMAGE_SUFFIXES) & F.lower(p).endswith(ending.lower())
    listed = spark.read.format("binaryFile").load(folder).select(_plain(F.col("path")).alias("plain")).filter(wanted(F.col("plain")))
    shared_folder(spark)
    ranged = listed.repartitionByRange("plain").withColumn("range", F.spark_partition_id()).checkpoint(eager=True)
    total, starts = 0, []
    for r in ranged.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        starts.append((r["range"], total))
        total += r["n"]
    starts_ = F.broadcast(spark.createDataFrame(starts, "range int, start long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("plain")) - 1
    numbers = ranged.withColumn("place", place).join(starts_, "range").select("plain", (F.col("start") + F.col("place")).alias("frame_idx"))
    found = _load(spark, folder).filter(wanted(F.col("path"))).withColumn("plain", _plain(F.col("path")))
    joined = found.join(F.broadcast(numbers) if total <= MAX_BROADCAST else numbers, "plain")
    return joined.select("path", "frame_idx", F.lit(total).cast("long").alias("total_frames"), F.lit(None).cast("float").alias("fps"), "image", F.when(F.col("image.height") <= 0, "cannot decode").alias("error"))


def _load(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(path, image) of files with an image suffix; a file that cannot be decoded keeps its row."""
    raw = spark.read.format("image").option("dropInvalid", False).load(paths)
    return raw.select(F.col("image.origin").alias("path"), "image").filter(suffix(F.col("path")).isin(*IMAGE_SUFFIXES))


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """The images of a folder, not of folders below it, by path."""
    if not os.path.isdir(folder):
        raise ImageError(f"not a directory: {folder}")
    return _numbered(spark, folder)


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """dir/* or dir/*.ext, whatever the case of the extension, by path."""
    folder, _, name = pattern.rpartition("/")
    folder = folder or "."
    if "*" in folder or not name.startswith("*") or "*" in name[1:] or not os.path.isdir(folder):
        raise ImageError(f"pattern must be dir/* or dir/*.ext: {pattern}")
    return _numbered(spark, folder, "" if name in ("*", "*.*") else name[1:])


def read_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The images of a list, in its order."""
    order = spark.createDataFrame([(os.path.abspath(p) if "://" not in p else p, k) for k, p in enumerate(paths)], "listed string, frame_idx long")
    found = _load(spark, list(paths)).withColumn("plain", _plain(F.col("path")))
    joined = order.join(found, F.col("plain") == F.col("listed"), "left")
    return joined.select(
        F.coalesce("path", "listed").alias("path"), "frame_idx", F.lit(len(paths)).cast("long").alias("total_frames"), F.lit(None).cast("float").alias("fps"), "image",
        F.when(F.col("image").isNull() | (F.col("image.height") <= 0), "cannot decode").alias("error"),
    )


def from_arrays(spark: SparkSession, arrays: Sequence[np.ndarray], names: Sequence[str] | None = None) -> DataFrame:
    """RGB arrays (h, w, 3) as images."""
    rows = []
    for k, a in enumerate(arrays):
        if a.ndim != 3 or a.shape[2] != 3:
            raise ImageError(f"array {k} is not (height, width, 3)")
        bgr = np.ascontiguousarray(a[:, :, ::-1].astype(np.uint8))
        rows.append((names[k] if names else f"image{k}", k, len(arrays), None, ("", a.shape[0], a.shape[1], 3, 16, bytearray(bgr.tobytes())), None))
    return spark.createDataFrame(rows, f"path string, frame_idx long, total_frames long, fps float, image {IMAGE}, error string")


def from_rgba(spark: SparkSession, data: bytes, width: int, height: int) -> DataFrame:
    """One image from RGBA bytes, whose number is checked."""
    if len(data) != width * height * 4:
        raise ImageError(f"expected {width * height * 4} bytes, got {len(data)}")
    return from_arrays(spark, [np.frombuffer(data, np.uint8).reshape(height, width, 4)[:, :, :3]])


def read_frames(spark: SparkSession, folder: str, fps: float = 30.0) -> DataFrame:
    """A folder of frames as a video; there is no video decoder here."""
    return read_directory(spark, folder).withColumn("fps", F.lit(fps).cast("float"))


def read(spark: SparkSession, source: str | Sequence[str] | Sequence[np.ndarray]) -> DataFrame:
    """Reads any batch source. Webcams, streams, URLs and video files need decoders or a network and are errors here."""
    if not isinstance(source, str):
        items = list(source)
        return from_arrays(spark, items) if items and isinstance(items[0], np.ndarray) else read_list(spark, items)
    kind = kind_of(source)
    if kind == "directory":
        return read_directory(spark, source)
    if kind == "glob":
        return read_glob(spark, source)
    if kind == "image":
        return read_list(spark, [source])
    raise ImageError(f"no reader for a {kind} here: {source}")
