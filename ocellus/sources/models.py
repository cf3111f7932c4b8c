"""Model files: the catalog of downloadable names, metadata inside ONNX files, and the forward pass as an Arrow stage."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import lru_cache
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.functions.config import TASK_SUFFIX, InferenceConfig, ModelLoadError, parse_precision, parse_task
from ocellus.operators import planes

SIZES = ("n", "s", "m", "l", "x")
NEWEST_ONLY = ("-sem", "-depth")
MAX_INPUT = 8192
MAX_METADATA = 4 << 20


def catalog(families: DataFrame, newest: DataFrame) -> DataFrame:
    """(model, size, variant): every family in every size and variant; some variants exist in the newest family alone."""
    spark = families.sparkSession
    sizes = spark.createDataFrame([(s,) for s in SIZES], "size string")
    variants = spark.createDataFrame([(v, v[1:] or "detect") for v in TASK_SUFFIX.values()], "suffix string, variant string")
    every = families.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(variants)).crossJoin(F.broadcast(newest))
    kept = every.filter(~F.col("suffix").isin(*NEWEST_ONLY) | (F.col("family") == F.col("newest")))
    return kept.select(F.concat("family", "size", "suffix", F.lit(".onnx")).alias("model"), "size", "variant")


@dataclass(frozen=True)
class Metadata:
    """What a model file says about itself."""

    task: str = "detect"
    stride: int = 32
    batch: int = 1
    channels: int = 3
    imgsz: tuple[int, int] | None = None
    kpt_shape: tuple[int, int] | None = None
    names: Mapping[int, str] = field(default_factory=dict)
    precision: str | None = None
    end2end: bool = False
    description: str = ""
    author: str = ""
    date: str = ""
    version: str = ""
    license: str = ""
    docs: str = ""

    @property
    def half(self) -> bool:
        return self.precision == "16"

    @property
    def num_classes(self) -> int:
        return len(self.names)

    def class_name(self, cls: int) -> str | None:
        return self.names.get(cls)

    def model_name(self, prefix: str, default: str = "") -> str:
        """The first word of the description that begins with a prefix, whatever its case."""
        return next((w for w in self.description.split() if w.lower().startswith(prefix.lower())), default)


def _bare(value: str) -> str:
    return value.strip().strip("'").strip('"')


def _truth(value: str) -> bool:
    return _bare(value).lower() not in ("none", "false", "0", "")


def _precision(value: str) -> str | None:
    value = _bare(value)
    return None if value.lower() in ("none", "null", "") else parse_precision(value)


def _from_args(args: str, key: str) -> str | None:
    m = re.search(rf"""(?:'{key}'|"{key}")\s*:?([^,}}]*)""", args)
    return m[1] if m else None


def int_pair(lines: list[str], key: str) -> tuple[int, int] | None:
    """The two integers of `key: [a, b]`, `(a, b)`, `a, b`, or of the two list items in the lines below it."""
    for k, line in enumerate(lines):
        if not line.strip().startswith(f"{key}:"):
            continue
        found = [int(p) for p in (q.strip() for q in line.split(":", 1)[1].strip().strip("[]()").split(",")) if p.isdigit()]
        for below in lines[k + 1 :] if len(found) < 2 else []:
            item = below.strip()
            if not item or item.startswith("#"):
                continue
            if not item.startswith("-") or len(found) == 2:
                break
            if item[1:].strip().isdigit():
                found.append(int(item[1:].strip()))
        if len(found) >= 2:
            return found[0], found[1]
    return None


def class_names(text: str) -> dict[int, str]:
    """Class names from a dictionary in braces behind `names:`, or from numbered lines anywhere."""
    m = re.search(r"names:\s*\{([^}]*)\}", text)
    entries = m[1].split(",") if m else text.splitlines()
    out = {}
    for e in entries:
        key, colon, value = e.partition(":")
        if colon and key.strip().isdigit():
            out[int(key.strip())] = _bare(value)
    return out


def parse_metadata(text: str) -> Metadata:
    """Metadata from lines of `key: value`; unknown keys are passed over, bad numbers and tasks are errors."""
    lines = text.splitlines()
    found: dict[str, str] = {}
    for line in lines:
        key, colon, value = line.strip().partition(":")
        if colon and not key.startswith("#"):
            found[key.strip()] = _bare(value)
    out = Metadata(**{k: found[k] for k in ("description", "author", "date", "version", "license", "docs") if k in found})
    try:
        if "task" in found:
            out = replace(out, task=parse_task(found["task"]))
        for k in ("stride", "batch", "channels"):
            if k in found:
                out = replace(out, **{k: int(found[k])})
        args = found.get("args", "")
        asked = found.get("quantize", _from_args(args, "quantize"))
        half = found.get("half", _from_args(args, "half"))
        precision = _precision(asked) if asked is not None else "16" if half is not None and _truth(half) else None
    except Exception as bad:
        raise ModelLoadError(f"bad metadata: {bad}") from bad
    return replace(out, precision=precision, end2end=found.get("end2end") in ("true", "True"), imgsz=int_pair(lines, "imgsz"), kpt_shape=int_pair(lines, "kpt_shape"), names=class_names(text))


def metadata_from_map(custom: Mapping[str, str]) -> Metadata:
    """Metadata from a model's key-value map: one combined text if there is one, else the keys themselves."""
    for key in ("metadata", "model_metadata"):
        if key in custom:
            return parse_metadata(custom[key])
    if "task" not in custom:
        for value in custom.values():
            if "task:" in value:
                return parse_metadata(value)
    return parse_metadata("\n".join(f"{k}: {v}" for k, v in custom.items()))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; nested messages are bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            width = {1: 8, 5: 4}[kind]
            value, at = data[at : at + width], at + width
        yield tag >> 3, value


def onnx_metadata(model: bytes) -> Metadata:
    """Metadata of an ONNX file without a runtime."""
    custom = {}
    for number, value in fields(model):
        if number == 14 and isinstance(value, bytes):
            pair = dict(fields(value))
            custom[bytes(pair.get(1, b"")).decode()] = bytes(pair.get(2, b"")).decode()
    return metadata_from_map(custom)


@lru_cache(maxsize=4)
def session(path: str):
    """The runtime session of a model, once a worker; one thread, as Spark runs a task a core."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    try:
        return ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    except Exception as bad:
        raise ModelLoadError(f"cannot load {path}: {bad}") from bad


def input_size(path: str, config: InferenceConfig) -> tuple[int, int]:
    """(height, width) of the network's input: what the file fixes, else the option, else its metadata, else 640."""
    s = session(path)
    h, w = s.get_inputs()[0].shape[2:4]
    if isinstance(h, int) and isinstance(w, int):
        return h, w
    size = config.imgsz or metadata_from_map(s.get_modelmeta().custom_metadata_map).imgsz or (640, 640)
    if not all(0 < x <= MAX_INPUT for x in size):
        raise ModelLoadError(f"input size out of range: {size}")
    return size


def rgb_of(image: Mapping) -> np.ndarray:
    a = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    if image["nChannels"] == 1:
        return np.repeat(a, 3, axis=2)
    return a[:, :, 2::-1]


def output_shapes(path: str, config: InferenceConfig) -> list[list[int]]:
    """The shapes of the outputs for one image: as the file states them, or else as a dry run over zeros shows them.

    The dry run warms the session up as well. Without one that succeeds there are no shapes.
    """
    s = session(path)
    stated = [list(o.shape) for o in s.get_outputs()]
    if all(isinstance(d, int) for shape in stated for d in shape[1:]):
        return [[1, *shape[1:]] for shape in stated]
    feed = s.get_inputs()[0]
    h, w = input_size(path, config)
    one = feed.shape[0] if isinstance(feed.shape[0], int) else 1
    try:
        got = s.run(None, {feed.name: np.zeros((one, 3, h, w), np.float16 if feed.type == "tensor(float16)" else np.float32)})
    except Exception:  # a model that takes no such image says so when it is run
        return []
    return [[1, *g.shape[1:]] for g in got]


OUTPUT = "path string, frame_idx long, orig_h int, orig_w int, in_h int, in_w int, scale float, pad_top float, pad_left float, outputs array<struct<data:binary,shape:array<int>>>, error string"


#: Milliseconds of an image: its own preparation, and its share of the batch that it ran in.
TIMINGS = "preprocess double, forward double"


def forward(images: DataFrame, model_path: str, config: InferenceConfig | None = None, task: str | None = None, batch: int = 8) -> DataFrame:
    """Runs a model over images (path, frame_idx, image): one row an image with its raw outputs, its geometry and its timings.

    A model that takes any size gets rectangles (config.rect): as few multiples of the stride as hold the fitted image.
    Images of one input size inside an Arrow batch are stacked up to `batch`. An image that cannot be prepared or run gets a
    reason in error and no outputs; the others go on.
    """
    config = config or InferenceConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = session(model_path)
        own = metadata_from_map(s.get_modelmeta().custom_metadata_map)
        kind = task or own.task
        full_h, full_w = input_size(model_path, config)
        feed = s.get_inputs()[0]
        rect = config.rect and kind != "classify" and not any(isinstance(x, int) for x in feed.shape[2:4])
        half = feed.type == "tensor(float16)"
        most = feed.shape[0] if isinstance(feed.shape[0], int) else batch
        for rows in batches:
            out: list[dict] = [{} for _ in range(rows.num_rows)]
            ready: list[tuple[int, np.ndarray]] = []
            for k, row in enumerate(rows.to_pylist()):
                image, began = row["image"], perf_counter()
                in_h, in_w = full_h, full_w
                if rect and image and image["height"] > 0 and image["width"] > 0:
                    in_h, in_w = planes.rect_extents(image["height"], image["width"], full_h, full_w, own.stride)
                out[k] = {"path": row["path"], "frame_idx": row["frame_idx"], "orig_h": image and image["height"], "orig_w": image and image["width"], "in_h": in_h, "in_w": in_w}
                try:
                    rgb = rgb_of(image)
                    scale, _, _, top, left = planes.letterbox_geometry(*rgb.shape[:2], in_h, in_w)
                    out[k] |= {"scale": scale, "pad_top": float(top), "pad_left": float(left)}
                    tensor = planes.center_crop_tensor(rgb, in_h) if kind == "classify" else planes.letterbox_tensor(rgb, in_h, in_w)
                    ready.append((k, tensor.astype(np.float16) if half else tensor))
                    out[k]["preprocess"] = 1000 * (perf_counter() - began)
                except Exception as bad:
                    out[k]["error"] = f"{type(bad).__name__}: {bad}"

            def go(group: list[tuple[int, np.ndarray]]) -> None:
                try:
                    full = np.stack([t for _, t in group])
                    if isinstance(feed.shape[0], int) and len(full) < most:
                        full = np.concatenate([full, np.zeros((most - len(full), *full.shape[1:]), full.dtype)])
                    began = perf_counter()
                    got = s.run(None, {feed.name: full})
                    took = 1000 * (perf_counter() - began) / len(group)
                    for n, (k, _) in enumerate(group):
                        mine = [g[n : n + 1] for g in got]
                        out[k]["outputs"] = [{"data": (g if g.dtype == np.uint8 else g.astype("<f4")).tobytes(), "shape": list(g.shape)} for g in mine]
                        out[k]["forward"] = took
                except Exception as bad:
                    if len(group) > 1:  # one bad image shall not take the others along
                        for one in group:
                            go([one])
                    else:
                        out[group[0][0]]["error"] = f"{type(bad).__name__}: {bad}"

            sizes: dict[tuple[int, ...], list[tuple[int, np.ndarray]]] = {}
            for one in ready:
                sizes.setdefault(one[1].shape, []).append(one)
            for same in sizes.values():
                for a in range(0, len(same), most):
                    go(same[a : a + most])
            yield pa.RecordBatch.from_pylist(out, schema=_OUTPUT_ARROW)

    return images.select("path", "frame_idx", "image").mapInArrow(run, f"{OUTPUT}, {TIMINGS}")


_OUTPUT_ARROW = pa.schema(
    [("path", pa.string()), ("frame_idx", pa.int64()), *((c, pa.int32()) for c in ("orig_h", "orig_w", "in_h", "in_w")), *((c, pa.float32()) for c in ("scale", "pad_top", "pad_left"))]
    + [("outputs", pa.list_(pa.struct([("data", pa.binary()), ("shape", pa.list_(pa.int32()))]))), ("error", pa.string()), ("preprocess", pa.float64()), ("forward", pa.float64())]
)


def tflite_metadata(model: bytes) -> Metadata | None:
    """Metadata of a TFLite file: metadata.json in the zip archive at its end; None without one."""
    try:
        with zipfile.ZipFile(io.BytesIO(model)) as z:
            info = z.getinfo("metadata.json")
            if info.file_size > MAX_METADATA:
                return None
            found = json.loads(z.read(info))
    except (zipfile.BadZipFile, KeyError, ValueError, NotImplementedError, zlib.error):
        return None
    if not isinstance(found, dict):
        return None
    lines = []
    for key, value in found.items():
        if key == "names" and isinstance(value, dict):
            lines += ["names:", *(f"  {k}: {v if isinstance(v, str) else ''}" for k, v in value.items())]
        elif key in ("imgsz", "kpt_shape") and isinstance(value, list):
            lines.append(f"{key}: [{', '.join(str(v) for v in value if isinstance(v, int))}]")
        elif key != "args" and isinstance(value, (str, int, float)):
            lines.append(f"{key}: {str(value).lower() if isinstance(value, bool) else value}")
    return parse_metadata("\n".join(lines))


def decode_shapes(flat: list[int], count: int) -> list[list[int]]:
    """Shapes from one list of rank, extents, rank, extents, ...; anything else is an error."""
    shapes, at = [], 0
    while at < len(flat):
        shape = flat[at + 1 : at + 1 + flat[at]]
        if len(shape) < flat[at]:
            raise ModelLoadError("malformed output shapes")
        shapes.append(list(shape))
        at += 1 + flat[at]
    if len(shapes) != count:
        raise ModelLoadError(f"{len(shapes)} output shapes instead of {count}")
    return shapes
