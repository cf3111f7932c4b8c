"""Scalar functions, geometry, vectors, configuration and metadata."""

import io
import json
import math
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ocellus.functions import color, config, geometry as G, text, vectors as V
from ocellus.operators import nms, planes
from ocellus.sources.models import class_names, decode_shapes, metadata_from_map, onnx_metadata, parse_metadata, tflite_metadata


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def box(*v):
    return F.struct(*(F.lit(float(x)).cast("float").alias(k) for k, x in zip(("x1", "y1", "x2", "y2"), v)))


def rot(*v):
    return F.struct(*(F.lit(float(x)).cast("float").alias(k) for k, x in zip(("cx", "cy", "w", "h", "angle"), v)))


def floats(*v):
    return F.array(*(F.lit(float(x)).cast("float") for x in v))


def test_iou(spark):
    r = one(spark, a=G.iou(box(0, 0, 10, 10), box(5, 5, 15, 15)), b=G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)), c=G.iou(box(0, 0, 1, 1), box(5, 5, 6, 6)), d=G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)))
    assert abs(r.a - 25 / 175) < 1e-6 and r.b == 1 and r.c == 0 and r.d == 0


def test_iou_is_decided_in_32_bits(spark):
    r = one(spark, over=G.iou(box(0, 0, 29, 1), box(11, 0, 40, 1)) > F.lit(0.45).cast("float"))
    assert r.over is False


def test_probiou(spark):
    r = one(spark, same=G.probiou(rot(50, 50, 20, 10, 0.3), rot(50, 50, 20, 10, 0.3)), far=G.probiou(rot(0, 0, 10, 10, 0), rot(500, 500, 10, 10, 0)))
    assert r.same > 0.999 and r.far < 0.01
    a, b = np.array([10, 12, 30, 8, 0.4]), np.array([14, 10, 22, 9, -0.2])
    assert abs(nms.probiou_rows(a, b) - one(spark, p=G.probiou(rot(*a), rot(*b))).p) < 1e-5


def test_letterbox_and_rect(spark):
    lit = F.lit
    r = one(spark, a=G.letterbox(lit(480), lit(640), 640, 640), b=G.letterbox(lit(1), lit(10000), 640, 640), c=G.rect_size(lit(333), lit(640), 1024, 1024, 32), d=G.letterbox(lit(0), lit(64), 640, 640))
    assert (r.a.new_w, r.a.new_h, r.a.pad_top, r.a.pad_left) == (640, 480, 80, 0)
    assert r.b.new_h == 1 and r.b.new_w == 640
    assert (r.c.h, r.c.w) == (544, 1024)
    assert r.d.new_h == 0


def test_crop_bounds(spark):
    r = one(spark, a=G.crop_bounds(F.lit(64), F.lit(64), F.lit(64), F.lit(64)), b=G.crop_bounds(F.lit(0), F.lit(64), F.lit(64), F.lit(64)))
    assert tuple(r.a) == (0, 0, 64, 64) and r.b is None
    assert planes.crop_bounds(64, 64, 64, 64) == (0, 0, 64, 64)


def test_clamp_keeps_nan(spark):
    r = one(spark, a=G.clamp(F.lit(float("nan")).cast("float"), 0, 1), b=G.clamp(F.lit(-3.0).cast("float"), 0, 1))
    assert math.isnan(r.a) and r.b == 0


def test_obb_corners_and_bounds(spark):
    r = one(spark, b=G.bounds(G.corners(*(F.lit(float(x)) for x in (50, 50, 20, 10, 0))), 100, 100))
    assert tuple(r.b) == (40, 45, 60, 55)


def test_argmax_rules(spark):
    nan = float("nan")
    r = one(spark, f=V.first_best(floats(0.5, nan, 0.9, 0.9)), l=V.last_best(floats(0.5, nan, 0.9, 0.9)), n=V.first_best(floats(nan)), m=V.last_best(floats(nan, nan)))
    assert r.f.cls == 2 and r.l.cls == 3 and r.n is None and r.m.score == float("-inf")


def test_probs_with_nan_and_ties(spark):
    p = floats(0.1, float("nan"), 0.7, 0.05)
    r = one(spark, t=V.top1(p), k=V.top_k(p, 4), a=V.top1(floats(0.4, 0.4, 0.2)), b=V.top_k(floats(0.4, 0.4, 0.2), 1))
    assert r.t.idx == 2 and [x.idx for x in r.k] == [2, 0, 3, 1]
    assert r.a.idx == 1 and r.b[0].idx == 0


@pytest.mark.parametrize("scores,top", [((1, 2, 3), 2), ((-5, -3, -8), 1), ((-0.5, 0.5, 1), 2)])
def test_softmax(spark, scores, top):
    r = one(spark, p=V.softmax(floats(*scores)))
    want = np.exp(scores) / np.exp(scores).sum()
    assert np.allclose(r.p, want) and int(np.argmax(r.p)) == top


def test_distribution_passes_through(spark):
    assert np.allclose(one(spark, p=V.softmax(floats(0.1, 0.2, 0.7))).p, (0.1, 0.2, 0.7))


def test_planes_columns(spark):
    m = V.argmax_planes(F.array(floats(0, 5, 1, 1), floats(1, 0, 3, 0), floats(2, 0, 1, 0)))
    r = one(spark, m=m, ids=V.class_ids(V.filter_classes(m, [0, 2], 3)), one=V.argmax_planes(F.array(floats(1, -1, 0.001, -0.001, 0))), none=V.filter_classes(m, [0], 1))
    assert r.m == [2, 0, 1, 0] and r.ids == [0, 2] and r.one == [1, 0, 1, 0, 0] and r.none == r.m


def test_depth_columns(spark):
    r = one(spark, a=V.depth_range(floats(0, 1.5, 4, -1)), b=V.depth_range(floats(0)), c=V.depth_range(floats(2)), p=V.percentiles(floats(*range(1, 101))))
    assert tuple(r.a) == (1.5, 4.0) and tuple(r.b) == (0, 1) and r.c.hi > r.c.lo and tuple(r.p) == (3, 98)


def test_plurals(spark):
    words = {"person": "persons", "bus": "buses", "match": "matches", "box": "boxes", "car": "cars", "baby": "babies", "toy": "toys", "sheep": "sheep", "knife": "knives", "dish": "dishes", "key": "keys"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.pluralize(F.col("w")).alias("p"))
    assert {r.w: r.p for r in df.collect()} == words == {w: text.plural(w) for w in words}


def test_source_strings(spark):
    kinds = {"0": "webcam", "4294967296": "image", "http://a/b.jpg?x=1": "image_url", "http://a/b": "stream", "rtsp://c": "stream", "d/*.png": "glob", "a.MKV": "video", "a.png": "image", "x.jpg.txt": "image", "12a": "image"}
    df = spark.createDataFrame([(k,) for k in kinds], "u string").select("u", text.source_kind(F.col("u")).alias("k"))
    assert {r.u: r.k for r in df.collect()} == kinds


def test_formats(spark):
    r = one(spark, b=text.format_bytes(F.lit(1536)), t=text.format_time(F.lit(3725.5)), p=text.progress_line(F.lit(512.0), F.lit(1024.0), F.lit(2.0), 4), u=text.progress_line(F.lit(10.0), F.lit(0.0), F.lit(0.0)))
    assert r.b == "1.5KB" and r.t == "1:02:05.5" and r.p == "   50% ━━── 512B/1.0KB 256B/s 2.0s" and r.u == "  10B 0B/s 0.0s"


def test_paths(spark):
    paths = {"m/a": "m/a.onnx", "a.ONNX": "a.onnx", "a.pt": "a.pt"}
    df = spark.createDataFrame([(k,) for k in paths], "p string").select("p", text.model_file(F.col("p")).alias("m"), text.output_stem(F.col("p"), F.lit(7), F.lit(1)).alias("s"), text.output_stem(F.col("p"), F.lit(7), F.lit(None).cast("int")).alias("n"))
    rows = df.collect()
    assert {r.p: r.m for r in rows} == paths
    assert [r.s for r in rows] == ["a", "a", "a"] and [r.n for r in rows] == ["a_000007"] * 3


@pytest.mark.parametrize("name", color.COLORMAPS)
def test_colormaps_agree(spark, name):
    t = np.linspace(-0.1, 1.1, 61)
    df = spark.createDataFrame([(float(x),) for x in t], "t double").select("t", color.sample(F.col("t"), name).alias("c")).orderBy("t")
    assert np.array_equal(np.array([tuple(r.c) for r in df.collect()]), color.sample_numpy(t, name))


def test_colors(spark):
    r = one(spark, a=color.hex_color(F.lit(0)), b=color.hex_color(F.lit(21)), c=color.text_color(F.lit(255), F.lit(255), F.lit(255)))
    assert r.a == "#042AFF" and r.b == "#0BDBEB" and r.c == "black"
    assert len(color.COLORS) == len(color.POSE_COLORS) == 20 and len(color.LIMBS) == len(color.LIMB_COLORS) == 19 and len(color.KEYPOINT_COLORS) == 17


def test_spellings():
    assert config.parse_task("Segmentation") == "segment" and config.parse_precision("FP16") == "16"
    assert config.parse_device("cuda") == "cuda:0" and config.parse_device("TensorRT:2") == "tensorrt:2" and config.parse_device("intel:gpu") == "intel:gpu"
    for bad in ("cuda:x", "cudax", "cuda:-1", "tpu"):
        with pytest.raises(config.ConfigError):
            config.parse_device(bad)
    assert config.parse_classes("[1, 2]") == [1, 2] and config.parse_classes(" ") == [] and config.parse_classes("'3'") == [3]
    with pytest.raises(config.ConfigError):
        config.parse_classes("a,b")
    assert not config.InferenceConfig(classes=()).keeps(0) and config.InferenceConfig().keeps(5)
    assert config.provider_label("CUDAExecutionProvider") == "CUDA" and config.parse_colormap("grey") == "gray" and config.parse_depth_viz("DepthAnything") == "disparity"


def test_metadata():
    m = parse_metadata("description: Some Fast-n model\nstride: 32\ntask: pose\nimgsz:\n- 640\n- 480\nkpt_shape: [17, 3]\nnames:\n  0: person\n  1: 'bus'\nargs: {'half': True, 'x': 1}\nend2end: True\n")
    assert (m.task, m.stride, m.imgsz, m.kpt_shape, dict(m.names), m.half, m.end2end) == ("pose", 32, (640, 480), (17, 3), {0: "person", 1: "bus"}, True, True)
    assert m.model_name("fast") == "Fast-n" and m.class_name(9) is None and m.num_classes == 2
    assert class_names("names: {0: 'a b', 1: \"c\"}") == {0: "a b", 1: "c"}
    assert parse_metadata("quantize: none\nhalf: true").precision is None
    assert metadata_from_map({"task": "detect", "names": "{0: 'x'}"}).names == {0: "x"}
    for bad in ("task: fly", "stride: many"):
        with pytest.raises(config.ModelLoadError):
            parse_metadata(bad)
    with pytest.raises(Exception):
        onnx_metadata(b"\xff\xff\xff")


def test_metadata_in_an_archive():
    out = io.BytesIO(b"model bytes")
    out.seek(0, 2)
    with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("metadata.json", json.dumps({"task": "pose", "imgsz": [64, 32], "names": {"0": "a: b"}, "end2end": True, "args": {"half": True}, "stride": 16}))
    m = tflite_metadata(out.getvalue())
    assert (m.task, m.imgsz, dict(m.names), m.end2end, m.stride, m.half) == ("pose", (64, 32), {0: "a: b"}, True, 16, False)
    assert tflite_metadata(b"nothing") is None


def test_flat_shapes():
    assert decode_shapes([3, 1, 2, 3, 1, 7], 2) == [[1, 2, 3], [7]]
    for bad, n in (([3, 1], 1), ([1, 7], 2)):
        with pytest.raises(config.ModelLoadError):
            decode_shapes(bad, n)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 3000))
def test_letterbox_fits(h, w):
    scale, new_h, new_w, top, left = planes.letterbox_geometry(h, w, 640, 640)
    assert 1 <= new_h <= 640 and 1 <= new_w <= 640 and max(new_h, new_w) == 640
    assert 0 <= top and top + new_h <= 640 and 0 <= left and left + new_w <= 640
