"""The prediction engine: read, run the model, decode by task, summarize. Stages are DataFrames and can be used apart."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.functions.config import ConfigError, InferenceConfig, PostprocessError
from ocellus.functions.text import output_stem
from ocellus.operators import decode, planes, render, results
from ocellus.sources import images, sinks
from ocellus.sources.models import Metadata, forward, metadata_from_map, output_shapes, rgb_of, session

_GEOMETRY = ("orig_h", "orig_w", "in_h", "in_w", "scale", "pad_top", "pad_left")
_GEOMETRY_DDL = "orig_h int, orig_w int, in_h int, in_w int, scale float, pad_top float, pad_left float"


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, made one at a time: a row holds a whole image's outputs."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def head_tensors(head: DataFrame, *geometry: str) -> DataFrame:
    """(image_id, geometry, data, shape): an image's predictions in the order of pred_id as one binary tensor of (1, predictions, 4 + classes).

    A Python worker holds one image's rows at a time, as Arrow columns; missing values become NaN.
    """

    def tensor(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows["pred_id"].to_numpy(), kind="stable")).combine_chunks()
        floats = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), "<f4")
        scores = floats(rows["scores"].chunk(0).flatten()).reshape(rows.num_rows, -1)
        a = np.concatenate([np.stack([floats(rows[c].chunk(0)) for c in ("cx", "cy", "w", "h")], axis=1), scores], axis=1)
        values = [*key, a.tobytes(), [1, *a.shape]]
        return pa.table([pa.array([v], t) for v, t in zip(values, (*(k.type for k in key), pa.binary(), pa.list_(pa.int32())))], names=names)

    names = ["image_id", *geometry, "data", "shape"]
    rows = head.select("image_id", *geometry, "pred_id", "cx", "cy", "w", "h", "scores")
    keys = T.StructType([rows.schema[c] for c in ("image_id", *geometry)])
    return rows.groupBy("image_id", *geometry).applyInArrow(tensor, T.StructType([*keys, T.StructField("data", T.BinaryType()), T.StructField("shape", T.ArrayType(T.IntegerType()))]))


def explode_head(raw: DataFrame, classes: int, extra: int, conf: float) -> DataFrame:
    """One row a prediction of the first output: (image_id, pred_id, cx, cy, w, h, scores, extra) and the geometry.

    Both layouts are read: features first or predictions first, of 4 + classes + extra features. Predictions whose best
    score is under conf never leave the Python worker; an output of another width gives no rows.
    """
    width = 4 + classes + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            if row["error"] or not row["outputs"]:
                continue
            out = row["outputs"][0]
            a = np.frombuffer(out["data"], "<f4")
            dims = out["shape"][1:] if len(out["shape"]) == 3 else out["shape"]
            if len(dims) != 2 or a.size != dims[0] * dims[1] or width not in dims:
                continue
            a = a.reshape(dims)
            a = a.T if dims[0] == width else a
            best = np.where(np.isnan(a[:, 4 : 4 + classes]), -np.inf, a[:, 4 : 4 + classes]).max(axis=1, initial=-np.inf)
            at = np.flatnonzero(best >= np.float32(conf))
            a = a[at]
            n = len(at)
            lists = lambda x: pa.array(list(x), pa.list_(pa.float32()))
            cols = [pa.array([row["image_id"]] * n, pa.int64()), pa.array(at, pa.int64()), *(pa.array(np.ascontiguousarray(a[:, k])) for k in range(4)), lists(a[:, 4 : 4 + classes]), lists(a[:, 4 + classes :])]
            cols += [pa.array([row[g]] * n, pa.int32() if k < 4 else pa.float32()) for k, g in enumerate(_GEOMETRY)]
            yield pa.RecordBatch.from_arrays(cols, ["image_id", "pred_id", "cx", "cy", "w", "h", "scores", "extra", *_GEOMETRY])

    schema = f"image_id long, pred_id long, cx float, cy float, w float, h float, scores array<float>, extra array<float>, {_GEOMETRY_DDL}"
    return raw.select("image_id", "outputs", "error", *_GEOMETRY).mapInArrow(run, schema)


def explode_rows(raw: DataFrame) -> DataFrame:
    """One row a final prediction (box, conf, cls, extra) of an end-to-end output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            if row["error"] or not row["outputs"]:
                continue
            out = row["outputs"][0]
            a = np.frombuffer(out["data"], "<f4").reshape(out["shape"])[0]
            n = len(a)
            cols = [pa.array([row["image_id"]] * n, pa.int64()), pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(a[:, k])) for k in range(5)), pa.array(np.nan_to_num(a[:, 5]).astype(np.int32)), pa.array(list(a[:, 6:]), pa.list_(pa.float32()))]
            cols += [pa.array([row[g]] * n, pa.int32() if k < 4 else pa.float32()) for k, g in enumerate(_GEOMETRY)]
            yield pa.RecordBatch.from_arrays(cols, ["image_id", "pred_id", "x1", "y1", "x2", "y2", "conf", "cls", "extra", *_GEOMETRY])

    schema = f"image_id long, pred_id long, x1 float, y1 float, x2 float, y2 float, conf float, cls int, extra array<float>, {_GEOMETRY_DDL}"
    return raw.select("image_id", "outputs", "error", *_GEOMETRY).mapInArrow(run, schema)


def instance_masks(raw: DataFrame, dets: DataFrame) -> DataFrame:
    """(image_id, det_rank, height, width, mask): the soft mask (little-endian floats) of each row of segment predictions.

    dets: rows with coefficients. Detections are gathered by image and meet the image's prototypes, the second output, once.
    An image without prototypes gives no masks.
    """
    own = F.struct("det_rank", "x1", "y1", "x2", "y2", "coefficients")
    gathered = dets.groupBy("image_id").agg(F.array_sort(F.collect_list(own)).alias("dets"))
    protos = raw.filter("error IS NULL AND size(outputs) > 1").select("image_id", F.get("outputs", F.lit(1)).alias("protos"), *_GEOMETRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                shape = row["protos"]["shape"][-3:]
                p = np.frombuffer(row["protos"]["data"], "<f4")
                if len(shape) != 3 or p.size != int(np.prod(shape)):
                    continue
                found = [d for d in row["dets"] if len(d["coefficients"]) == shape[0]]
                for d in found:  # one at a time: masks are as large as images
                    box = np.array([[d[c] for c in ("x1", "y1", "x2", "y2")]], np.float32)
                    mask = planes.instance_masks(np.array([d["coefficients"]], np.float32), p.reshape(shape), box, *(row[g] for g in ("orig_h", "orig_w", "in_h", "in_w", "pad_top", "pad_left")))
                    yield pa.RecordBatch.from_pylist([{"image_id": row["image_id"], "det_rank": d["det_rank"], "height": row["orig_h"], "width": row["orig_w"], "mask": planes.pack(mask[0], "<f4")}], schema=_MASKS)

    return gathered.join(protos, "image_id").mapInArrow(run, "image_id long, det_rank long, height int, width int, mask binary")


_MASKS = pa.schema([("image_id", pa.int64()), ("det_rank", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("mask", pa.binary())])


def mask_bounds(masks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, det_rank, area, x1, y1, x2, y2): pixels of each mask over the threshold and the box around them; null without any."""

    @F.arrow_udf("struct<area:bigint,x1:int,y1:int,x2:int,y2:int>")
    def run(mask: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        out = []
        for raw, a, b in zip(mask.to_pylist(), h.to_pylist(), w.to_pylist()):
            ys, xs = np.nonzero(np.frombuffer(raw, "<f4").reshape(a, b) > threshold)
            out.append({"area": len(xs)} | ({"x1": int(xs.min()), "y1": int(ys.min()), "x2": int(xs.max()), "y2": int(ys.max())} if len(xs) else {}))
        kind = pa.struct([("area", pa.int64()), *((c, pa.int32()) for c in ("x1", "y1", "x2", "y2"))])
        return pa.array(out, kind)

    return masks.withColumn("__b", run("mask", "height", "width")).select("image_id", "det_rank", "__b.*")


def annotated(source: DataFrame, predictions: DataFrame, task: str, names: dict[int, str], masks: DataFrame | None = None, colormap: str = "jet", viz: str = "disparity") -> DataFrame:
    """(image_id, path, total_frames, png, labels): every readable image of source with what was predicted for it drawn on.

    Predictions, and masks if given, are gathered by image and joined to it; an image without any is drawn as it is.
    """
    rows = predictions if masks is None else predictions.join(masks.select("image_id", "det_rank", "mask"), ["image_id", "det_rank"], "left")
    keep = [c for c in ("det_rank", "x1", "y1", "x2", "y2", "conf", "cls", "mask", "keypoints", "cx", "cy", "w", "h", "angle", "probs", "depth", "classes") if c in rows.columns]
    # planes and masks of floats cannot be sorted by, so only the rank is
    gathered = rows.groupBy("image_id").agg(F.collect_list(F.struct(*keep)).alias("found"))
    images_ = source.filter("error IS NULL").select(F.col("frame_idx").alias("image_id"), "path", "total_frames", "image")

    def drawn(row: dict) -> tuple[np.ndarray, list[str]]:
        rgb = rgb_of(row["image"])
        h, w = rgb.shape[:2]
        found = sorted(row["found"] or [], key=lambda r: r.get("det_rank") or 0)
        if not found:
            return rgb, []
        if task == "semantic":
            got = found[0]["classes"]
            return (rgb if got is None else render.draw_semantic(rgb, np.frombuffer(got, "<u2").reshape(h, w))), []
        if task == "depth":
            got = found[0]["depth"]
            return (rgb if got is None else planes.blend_depth(rgb, np.frombuffer(got, "<f4").reshape(h, w), colormap, viz)), []
        if task == "classify":
            return render.draw_classes(rgb, np.array(found[0]["probs"], np.float32), names)
        if task == "obb":
            quads = np.array([_corners(*(r[c] for c in ("cx", "cy", "w", "h", "angle"))) for r in found])
            return render.draw_obb(rgb, quads, [r["cls"] for r in found]), [render.label(r["cls"], r["conf"], names) for r in found]
        boxes = np.array([[r[c] for c in ("x1", "y1", "x2", "y2", "conf", "cls")] for r in found], np.float32)
        shapes = np.stack([np.frombuffer(r["mask"], "<f4").reshape(h, w) for r in found]) if all(r.get("mask") for r in found) else None
        out, texts = render.draw_detections(rgb, boxes, names, shapes)
        if task == "pose":
            for r in found:
                points = np.array([[p["x"], p["y"], 1.0 if p["conf"] is None else p["conf"]] for p in r["keypoints"]], np.float32)
                out = render.draw_pose(out, points[None])
        return out, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                pixels, texts = drawn(row)
                yield pa.RecordBatch.from_pylist([{"image_id": row["image_id"], "path": row["path"], "total_frames": row["total_frames"], "png": sinks.png(pixels), "labels": texts}], schema=_DRAWN)

    return images_.join(gathered, "image_id", "left").mapInArrow(run, "image_id long, path string, total_frames long, png binary, labels array<string>")


_DRAWN = pa.schema([("image_id", pa.int64()), ("path", pa.string()), ("total_frames", pa.int64()), ("png", pa.binary()), ("labels", pa.list_(pa.string()))])


def _corners(cx: float, cy: float, w: float, h: float, angle: float) -> list[tuple[float, float]]:
    c, s = np.cos(angle), np.sin(angle)
    return [(cx + dx * w * c - dy * h * s, cy + dx * w * s + dy * h * c) for dx, dy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]


@dataclass
class Engine:
    """A model and its options. predict() gives typed rows; raw() and postprocess() are its two halves."""

    spark: SparkSession
    model: str
    config: InferenceConfig = InferenceConfig()
    task: str | None = None

    def __post_init__(self) -> None:
        own = session(self.model).get_modelmeta().custom_metadata_map
        self.metadata: Metadata = metadata_from_map(own)
        if self.task and "task" in own and self.task != self.metadata.task:
            raise PostprocessError(f"the model is for {self.metadata.task}, not {self.task}")
        self.task = self.task or self.metadata.task
        if self.config.device != "cpu":
            raise ConfigError(f"only the CPU is here: {self.config.device}")
        self.shapes = output_shapes(self.model, self.config)

    @property
    def names(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.metadata.names.items()), "class_id int, name string")

    def layout(self) -> tuple[bool, int, int, tuple[int, int]]:
        """(final rows or a head, classes, mask coefficients, keypoint shape), from metadata and, where that is silent, from the shapes."""
        m, first = self.metadata, self.shapes[0] if self.shapes else []
        masks = self.shapes[1][1] if len(self.shapes) > 1 and len(self.shapes[1]) == 4 else 32
        points = m.kpt_shape
        if points is None and self.task == "pose" and len(first) == 3:
            points = decode.keypoint_shape(first[2] - 6)
        points = points or (17, 3)
        final = m.end2end or decode.is_end2end(self.task, first, points[0] * points[1], masks)
        classes = m.num_classes
        if not classes and (head := decode.head_shape(first, 0)):
            classes = head[0] - {"segment": masks, "pose": points[0] * points[1], "obb": 1}.get(self.task, 0)
        return final, classes, masks, points

    def read(self, source) -> DataFrame:
        return images.read(self.spark, source)

    def raw(self, source: DataFrame) -> DataFrame:
        """Raw outputs with image_id, the frame's number."""
        return forward(source, self.model, self.config, self.task, self.config.batch or 8).withColumn("image_id", F.col("frame_idx"))

    def postprocess(self, raw: DataFrame) -> DataFrame:
        """Typed rows from raw outputs, by task."""
        c = self.config
        final, classes, masks, points = self.layout()
        if final and self.task in ("detect", "segment", "pose", "obb"):
            rows = explode_rows(raw)
            if self.task == "obb":
                return decode.end2end_obb(rows, c)
            rows = decode.end2end(rows, c)
            if self.task == "pose":
                rows = rows.withColumn("keypoints", decode.scale_keypoints(F.col("extra"), points[1]))
            return rows.drop("extra", *_GEOMETRY) if self.task != "segment" else rows.withColumnRenamed("extra", "coefficients").drop(*_GEOMETRY)
        if self.task == "detect":
            return decode.detect(explode_head(raw, classes, 0, c.conf), c)
        if self.task == "segment":
            return decode.segment(explode_head(raw, classes, masks, c.conf), c)
        if self.task == "pose":
            return decode.pose(explode_head(raw, classes, points[0] * points[1], c.conf), c, points[1])
        if self.task == "obb":
            return decode.obb(explode_head(raw, classes, 1, c.conf), c)
        first = F.get("outputs", F.lit(0))
        good = raw.filter(F.col("error").isNull())
        if self.task == "classify":
            return decode.classify(good.select("image_id", planes.plane_values(first["data"]).alias("scores"))).drop("scores")
        shape = first["shape"]
        side = lambda k: F.element_at(shape, k)
        if self.task == "depth":
            return good.select("image_id", "orig_h", "orig_w", planes.resized_depth(first["data"], side(-2), side(-1), F.col("orig_h"), F.col("orig_w")).alias("depth"))
        kept = planes.semantic_output(first["data"], shape, F.col("orig_h"), F.col("orig_w"))
        return good.select("image_id", "orig_h", "orig_w", kept.alias("classes"))

    def masks(self, raw: DataFrame, predictions: DataFrame) -> DataFrame:
        """The instance masks of segment predictions; see instance_masks()."""
        return instance_masks(raw, predictions)

    def predict(self, source) -> DataFrame:
        return self.postprocess(self.raw(source if isinstance(source, DataFrame) else self.read(source)))

    def summarize(self, source, predictions: DataFrame) -> DataFrame:
        """(image_id, summary) of every image."""
        every = source.select(F.col("frame_idx").alias("image_id"))
        if self.task not in ("classify", "semantic", "depth"):
            return results.describe(every, predictions, self.names)
        named = self.metadata.names
        names = F.create_map(*(F.lit(x) for pair in sorted(named.items()) for x in pair)) if named else F.create_map().cast("map<int,string>")
        text = dict.fromkeys(("semantic", "depth", "probs"), F.lit(None).cast("string"))
        if self.task == "classify":
            text["probs"] = results.describe_probs(F.col("probs"), names)
        elif self.task == "depth":
            text["depth"] = results.describe_depth(planes.plane_values(F.col("depth")).cast("array<float>"))
        else:
            text["semantic"] = results.describe_mask(planes.plane_values(F.col("classes"), "<u2").cast("array<int>"), names)
        nothing = F.lit(None).cast("string")
        told = predictions.select("image_id", results.describe_any(text["semantic"], text["depth"], nothing, nothing, text["probs"]).alias("summary"))
        return every.join(told, "image_id", "left").withColumn("summary", F.coalesce("summary", F.lit(results.NOTHING)))

    def summary(self, predictions: DataFrame) -> DataFrame:
        """Summary rows: a box each, or the best class of an image."""
        return (results.probs_rows if self.task == "classify" else results.summary_rows)(predictions, self.names)

    def lines(self, source: DataFrame, raw: DataFrame, predictions: DataFrame) -> DataFrame:
        """(image_id, line): what is said of each image that was run: number, path, input size, summary and milliseconds."""
        told = raw.filter("error IS NULL").select("image_id", "path", "in_h", "in_w", results.speed_total(F.col("preprocess"), F.col("forward"), F.lit(None).cast("double")).alias("ms"))
        told = told.join(self.summarize(source, predictions), "image_id").join(source.select(F.col("frame_idx").alias("image_id"), "total_frames"), "image_id")
        return told.select("image_id", results.verbose_line(F.col("image_id") + 1, F.col("total_frames"), F.col("path"), F.col("in_h"), F.col("in_w"), F.col("summary"), F.col("ms")).alias("line"))

    def speed(self, raw: DataFrame) -> DataFrame:
        """Mean milliseconds of each stage. What follows the forward pass is part of Spark's own stages and is not timed apart."""
        return results.speed_report(raw.filter("error IS NULL").select("preprocess", "forward", F.lit(None).cast("double").alias("postprocess")))

    def unreadable(self, source: DataFrame) -> int:
        """How many inputs could not be read and are passed over."""
        return source.filter("error IS NOT NULL").count()

    def annotate(self, source: DataFrame, predictions: DataFrame, masks: DataFrame | None = None) -> DataFrame:
        return annotated(source, predictions, self.task, self.metadata.names, masks)

    def save(self, source: DataFrame, predictions: DataFrame, base: str = "runs", masks: DataFrame | None = None) -> str | None:
        """Writes annotated images, and class maps of semantic models, into a new run folder under base, and returns it.

        config.save=False writes nothing. Files have the image's name with .png; with save_frames, frames of one source get
        a folder name_frames and their number from 1. base has to be a folder that the executors share.
        """
        if not self.config.save:
            return None
        run = sinks.next_run(base)
        drawn = self.annotate(source, predictions, masks)
        stem = output_stem(F.col("path"), F.lit(0), F.lit(1))
        name = F.concat(stem, F.lit(".png"))
        if self.config.save_frames:
            name = F.concat(stem, F.lit("_frames/"), stem, F.lit("_"), (F.col("image_id") + 1).cast("string"), F.lit(".png"))
        sinks.write_files(drawn.select(name.alias("name"), F.col("png").alias("data")), run)
        if self.task == "semantic":
            placed = predictions.filter("classes IS NOT NULL").join(source.select(F.col("frame_idx").alias("image_id"), "path", "total_frames"), "image_id")
            maps = placed.select(F.concat(F.lit("maps/"), output_stem(F.col("path"), F.col("image_id"), F.col("total_frames")), F.lit(".png")).alias("name"), _class_png(F.col("classes"), F.col("orig_h"), F.col("orig_w")).alias("data"))
            sinks.write_files(maps, run)
        return run


def _class_png(classes: Column, h: Column, w: Column) -> Column:
    @F.arrow_udf("binary")
    def run(data: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([sinks.class_map_png(np.frombuffer(raw, "<u2").reshape(x, y)) for raw, x, y in zip(data.to_pylist(), a.to_pylist(), b.to_pylist())], pa.binary())

    return run(classes, h, w)
