"""Suppression, decoding, planes, rendering, sources, the engine and streams."""

import json
import os
import tempfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ocellus.functions.config import ImageError, InferenceConfig, ModelLoadError
from ocellus.operators import decode, nms, planes, render, results
from ocellus.plans.engine import Engine, mask_bounds
from ocellus.plans.queries import ORACLES, QUERIES
from ocellus.sources import adapters, images, models, sinks
from ocellus.streaming import frames

SF = "/root/testdata/sf0.001"
HEAD = "image_id long, pred_id long, cx float, cy float, w float, h float, scores array<float>, extra array<float>, orig_h int, orig_w int, scale float, pad_top float, pad_left float"


def head(spark, preds, extra=None):
    return spark.createDataFrame([(0, i, *map(float, p[:4]), [float(s) for s in p[4]], [float(x) for x in (extra or [])], 640, 640, 1.0, 0.0, 0.0) for i, p in enumerate(preds)], HEAD)


def by_hand(boxes, threshold):
    kept = []
    for i, b in enumerate(boxes):
        if not any(nms.iou_rows(boxes[k], b) > np.float32(threshold) for k in kept):
            kept.append(i)
    return kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 40)] * 4), max_size=40), st.sampled_from([0.0, 0.3, 0.45, 0.9]), st.booleans())
def test_greedy_against_a_loop(raw, t, small):
    boxes = np.array([(x, y, x + w, y + h) for x, y, w, h in raw], np.float32).reshape(-1, 4)
    old, nms._SMALL = nms._SMALL, 512 if small else 0
    try:
        assert np.flatnonzero(nms.greedy(boxes, t)).tolist() == by_hand(boxes, t)
    finally:
        nms._SMALL = old


def test_nms_strategies_agree_and_nan_is_last(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 7), int(i % 3), int(i), float(s), *map(float, (x, y, x + w, y + h))) for i, (s, x, y, w, h) in enumerate(zip(rng.random(600).round(2), *rng.integers(0, 60, (4, 600))))]
    rows.append((0, 0, 999, float("nan"), 0.0, 0.0, 50.0, 50.0))
    df = spark.createDataFrame(rows, "image_id long, cls int, pred_id long, conf float, x1 float, y1 float, x2 float, y2 float")
    ids = [sorted(r.pred_id for r in nms.nms(df, 0.3, strategy=s).collect()) for s in ("numpy", "fold")]
    assert ids[0] == ids[1] and len(ids[0]) < 600
    two = spark.createDataFrame([(0, 0, 0, float("nan"), 0.0, 0.0, 10.0, 10.0), (0, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0)], df.schema)
    assert [r.pred_id for r in nms.nms(two, 0.5).collect()] == [1]


def test_detect(spark):
    h = head(spark, [(50, 50, 40, 40, (0.9, 0.1)), (52, 52, 40, 40, (0.85, 0.2)), (200, 200, 40, 40, (0.1, 0.95))])
    assert [(r.pred_id, r.cls) for r in decode.detect(h, InferenceConfig(iou=0.45)).orderBy("det_rank").collect()] == [(2, 1), (0, 0)]
    assert decode.detect(h, InferenceConfig(iou=0.45, classes=(1,))).count() == 1
    assert decode.detect(h, InferenceConfig(classes=())).count() == 0
    assert decode.detect(h, InferenceConfig(conf=0.95)).count() == 0  # strict
    assert decode.segment(h, InferenceConfig(conf=0.95)).count() == 1  # inclusive


def test_detect_ignores_nan_and_suppresses_before_clipping(spark):
    h = head(spark, [(10, 10, 10, 10, (float("nan"), 0.9)), (-300, 300, 700, 40, (0.8, 0)), (-295, 300, 700, 40, (0.7, 0))])
    got = decode.detect(h, InferenceConfig(iou=0.9)).orderBy("det_rank").collect()
    assert [r.cls for r in got] == [1, 0] and got[1].x1 == 0


def test_class_ties(spark):
    h = head(spark, [(50, 50, 10, 10, (0.6, 0.6))])
    assert decode.detect(h, InferenceConfig()).first().cls == 0 and decode.segment(h, InferenceConfig()).first().cls == 1


def test_pose_and_obb(spark):
    h = head(spark, [(50, 50, 40, 40, (0.9,))], extra=(10, 20, 0.5, 700, -5, 0.1))
    r = decode.pose(h, InferenceConfig()).first()
    assert [(k.x, k.y) for k in r.keypoints] == [(10, 20), (640, 0)] and abs(r.keypoints[0].conf - 0.5) < 1e-6
    two = decode.pose(head(spark, [(50, 50, 40, 40, (0.9,))], extra=(10, 20)), InferenceConfig(), dim=2).first()
    assert two.keypoints[0].conf is None
    o = decode.obb(head(spark, [(100, 100, 50, 20, (0.95,)), (101, 100, 50, 20, (0.9,))], extra=(0.78,)), InferenceConfig(iou=0.5)).collect()
    assert len(o) == 1 and abs(o[0].angle - 0.78) < 1e-6


def test_end2end(spark):
    schema = "image_id long, pred_id long, x1 float, y1 float, x2 float, y2 float, conf float, cls int, orig_h int, orig_w int, scale float, pad_top float, pad_left float"
    rows = [(0, i, 0.0, 0.0, 10.0, 10.0, c, k, 640, 640, 1.0, 0.0, 0.0) for i, (c, k) in enumerate([(0.9, 0), (float("nan"), 1), (0.25, 2), (0.1, 0), (0.9, 0)])]
    got = decode.end2end(spark.createDataFrame(rows, schema), InferenceConfig()).orderBy("det_rank").collect()
    assert [r.pred_id for r in got] == [0, 1, 2]
    assert [r.pred_id for r in decode.end2end(spark.createDataFrame(rows, schema), InferenceConfig(classes=(1, 2), max_det=1)).collect()] == [1]


def test_shapes():
    assert decode.keypoint_shape(51) == (17, 3) and decode.keypoint_shape(34) == (17, 2) and decode.keypoint_shape(36) is None
    assert decode.is_end2end("detect", [1, 300, 6]) and not decode.is_end2end("detect", [1, 84, 8400]) and decode.is_end2end("obb", [1, 300, 7])
    assert decode.head_shape([1, 84, 8400], 80) == (80, 8400, True) and decode.head_shape([8400, 84], 80) == (80, 8400, False)
    assert decode.head_shape([1, 6, 100], 0) == (2, 100, True) and decode.head_shape([1], 0) is None


def test_summaries(spark):
    names = spark.createDataFrame([(0, "person"), (5, "bus")], "class_id int, name string")
    dets = spark.createDataFrame([(1, 0, 0, 0.9), (1, 1, 0, 0.8), (1, 2, 5, 0.7), (2, 0, 7, 0.5)], "image_id long, det_rank long, cls int, conf float")
    both = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    assert {r.image_id: r.summary for r in results.describe(both, dets, names).collect()} == {1: "2 persons, 1 bus", 2: "1 object", 3: "(no detections)"}
    row = spark.range(1).select(results.describe_depth(F.array(F.lit(1.5), F.lit(4.0), F.lit(0.0))).alias("d"), results.describe_probs(F.array(F.lit(0.2), F.lit(0.8)), F.create_map(F.lit(1), F.lit("cat"))).alias("p"), results.verbose_line(F.lit(1), F.lit(2), F.lit("a.png"), F.lit(4), F.lit(6), F.lit("1 bus"), F.lit(2.0)).alias("v")).first()
    assert row.d == "depth 1.50-4.00m" and row.p == "cat 0.80, unknown 0.20" and row.v == "image 1/2 a.png: 4x6 1 bus, 2.0ms"


def test_planes_numpy():
    logits = np.zeros((3, 2, 2), np.float32)
    logits[2, 0, 0] = logits[1, 1, 0] = 1
    assert planes.class_map(logits, 2, 2).tolist() == [[2, 0], [1, 0]]
    assert np.allclose(planes.bilinear(np.full((1, 8, 8), 2.5, np.float32), 2, 4), 2.5)
    depth = np.arange(1, 7, dtype=np.float32).reshape(2, 3)
    assert np.array_equal(planes.bilinear(depth[None], 2, 3)[0], depth)
    assert planes.baked_map(np.array([[0, 5], [3, 7]], np.uint8), 2, 2).tolist() == [[0, 5], [3, 7]]
    boxed = np.full((8, 8), 99, np.uint8)
    boxed[2:6] = 4
    assert (planes.baked_map(boxed, 2, 4) == 4).all()
    assert planes.bilinear(np.zeros((1, 0, 4), np.float32), 2, 2) is None


def test_letterbox_pixels():
    flat = np.full((30, 60, 3), 200, np.uint8)
    t = planes.letterbox_tensor(flat, 64, 64)
    assert np.allclose(t[:, 16:48], 200 / 255) and np.allclose(t[:, 0], 114 / 255)
    assert np.allclose(planes.letterbox_tensor(np.zeros((0, 5, 3), np.uint8), 8, 8), 114 / 255)
    ramp = np.tile(np.arange(64, dtype=np.uint8)[None, :, None], (64, 1, 3))
    assert np.allclose(planes.letterbox_tensor(ramp, 64, 64)[0] * 255, ramp[..., 0], atol=1e-3)
    crop = planes.center_crop_tensor(np.tile(np.arange(100, dtype=np.uint8)[None, :, None], (50, 1, 3)), 50)
    assert crop.shape == (3, 50, 50) and np.allclose(crop[0, 0] * 255, np.arange(25, 75), atol=1)


def test_masks_stay_in_their_boxes():
    protos = np.ones((2, 8, 8), np.float32)
    m = planes.instance_masks(np.array([[4.0, 4.0], [-4.0, -4.0]]), protos, np.array([[4, 4, 11, 11], [0, 0, 31, 31]]), 32, 32, 32, 32, 0, 0)
    assert (m[0] > 0.5).sum() == 64 and (m[1] > 0.5).sum() == 0


def test_render():
    image = np.full((80, 80, 3), 100, np.uint8)
    boxes = np.array([[10, 20, 40, 50, 0.9, 0], [12, 22, 42, 52, 0.8, 1]])
    masks = np.zeros((2, 80, 80), np.float32)
    masks[0, 30:40, 20:30] = 0.9
    out, texts = render.draw_detections(image, boxes, {0: "cat"}, masks)
    assert texts == [" cat 0.90 ", " class 0.80 "] and (out != image).any() and (image == 100).all()
    people = np.random.default_rng(1).random((1, 17, 3)) * [70, 70, 1] + 1
    assert (render.draw_pose(image, people) != image).any() and (render.draw_pose(image, people[:, :, :2]) != image).any()
    quad = np.array([[[10, 10], [30, 10], [30, 30], [10, 30]]])
    assert (render.draw_obb(image, quad, [3]) != image).any()
    classes = np.full((80, 80), 65535)
    classes[:10] = 2
    mixed = render.annotate(image, {}, semantic=classes)
    assert (mixed[20:] == 100).all() and (mixed[:10] != 100).all()
    layer = render.overlay(boxes, masks, None, 80, 80)
    assert (layer[..., 3] > 0).sum() == 100 and set(np.unique(layer[..., 3])) == {0, render.SEGMENT_OVERLAY}
    depth = np.zeros((80, 80), np.float32)
    depth[:, :40] = np.linspace(1, 5, 40)
    assert (render.annotate(image, {}, depth=depth)[:, 40:] == 100).all()
    assert (render.draw_classes(image, np.array([0.1, np.nan, 0.9]), {2: "dog"})[1]) == ["dog 0.90", "class 0.10", "class nan"]
    assert planes.colorize(np.zeros((2, 2))).sum() == 0 and render.ink((255, 255, 0)) == "black"
    taken = []
    a, b = (render.place_label((5, 30), 20, 10, 80, 80, taken) for _ in range(2))
    assert a != b and a[1] == 20 and b[1] == 30


def save(folder, name, array):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(sinks.bmp(array) if name.lower().endswith("bmp") else sinks.png(array))
    return path


@pytest.fixture(scope="module")
def folder():
    with tempfile.TemporaryDirectory() as d:
        rng = np.random.default_rng(2)
        for name, shape in (("b.png", (20, 30, 3)), ("a.bmp", (16, 16, 3)), ("c.PNG", (8, 8, 3))):
            save(d, name, rng.integers(0, 255, shape, dtype=np.uint8))
        with open(os.path.join(d, "notes.txt"), "w") as f:
            f.write("x")
        with open(os.path.join(d, "z.png"), "wb") as f:
            f.write(b"broken")
        yield d


def test_image_sources(spark, folder):
    got = images.read(spark, folder).orderBy("frame_idx").collect()
    assert [os.path.basename(r.path) for r in got] == ["a.bmp", "b.png", "c.PNG", "z.png"]
    assert [r.error is None for r in got] == [True, True, True, False] and got[0].total_frames == 4
    assert images.read(spark, f"{folder}/*.png").count() == 3
    listed = images.read(spark, [f"{folder}/b.png", f"{folder}/a.bmp"]).orderBy("frame_idx").collect()
    assert [os.path.basename(r.path) for r in listed] == ["b.png", "a.bmp"] and (listed[0].image.height, listed[0].image.width) == (20, 30)
    rgb = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    row = images.from_arrays(spark, [rgb]).first()
    assert np.array_equal(np.frombuffer(row.image.data, np.uint8).reshape(4, 4, 3)[:, :, ::-1], rgb)
    for bad in ("0", "rtsp://x", f"{folder}/*/a.png"):
        with pytest.raises(ImageError):
            images.read(spark, bad)
    with pytest.raises(ImageError):
        images.from_rgba(spark, b"123", 2, 2)
    assert images.kind_of(folder) == "directory"


def test_decoded_pixels_round_trip(spark, folder):
    rgb = np.random.default_rng(9).integers(0, 255, (5, 7, 3), dtype=np.uint8)
    for name in ("p.png", "q.bmp"):
        with tempfile.TemporaryDirectory() as d:
            row = images.read(spark, [save(d, name, rgb)]).first()
            assert np.array_equal(np.frombuffer(row.image.data, np.uint8).reshape(5, 7, 3)[:, :, ::-1], rgb)


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor_info(name, dims):
    shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))


def identity_model(path, meta):
    """An ONNX file whose output is its input."""
    node = field(1, "images") + field(2, "output0") + field(4, "Identity")
    dims = ["n", 3, "h", "w"]
    graph = field(1, node) + field(2, "g") + field(11, tensor_info("images", dims)) + field(12, tensor_info("output0", dims))
    props = b"".join(field(14, field(1, k) + field(2, v)) for k, v in meta.items())
    with open(path, "wb") as f:
        f.write(field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13)) + props)
    return path


def test_forward_pass(spark, folder, tmp_path):
    path = identity_model(str(tmp_path / "m.onnx"), {"task": "depth", "imgsz": "[32, 32]", "names": "{0: 'a'}"})
    with open(path, "rb") as f:
        assert models.onnx_metadata(f.read()).imgsz == (32, 32)
    source = images.read(spark, folder)
    rows = models.forward(source, path, InferenceConfig(rect=False)).orderBy("frame_idx").collect()
    assert [r.error is None for r in rows] == [True, True, True, False]
    assert all(list(r.outputs[0].shape) == [1, 3, 32, 32] for r in rows[:3])
    first = np.frombuffer(rows[0].outputs[0].data, "<f4").reshape(3, 32, 32)
    image = source.filter("frame_idx = 0").first().image
    rgb = np.frombuffer(image.data, np.uint8).reshape(16, 16, 3)[:, :, ::-1]
    assert np.allclose(first, planes.letterbox_tensor(rgb, 32, 32))
    engine = Engine(spark, path, InferenceConfig(batch=2))
    out = engine.predict(folder).collect()
    assert len(out) == 3 and all(len(r.depth) == 4 * r.orig_h * r.orig_w for r in out)
    assert engine.names.first().name == "a"
    with pytest.raises(ModelLoadError):
        models.session(str(tmp_path / "none.onnx"))


def test_engine_decodes_by_task(spark, tmp_path):
    """The halves after the forward pass, on made-up outputs."""
    path = identity_model(str(tmp_path / "d.onnx"), {"task": "detect", "names": "{0: 'a', 1: 'b'}"})
    head_ = np.array([[50, 52, 200], [50, 52, 200], [40, 40, 40], [40, 40, 40], [0.9, 0.85, 0.1], [0.1, 0.2, 0.95]], np.float32)
    schema = f"image_id long, {models.OUTPUT}"

    def raw(a):
        return spark.createDataFrame([(0, "p", 0, 640, 640, 640, 640, 1.0, 0.0, 0.0, [(bytearray(a.astype("<f4").tobytes()), list(a.shape))], None), (1, "q", 1, 1, 1, 640, 640, 1.0, 0.0, 0.0, None, "bad")], schema)

    engine = Engine(spark, path, InferenceConfig(iou=0.45))
    for layout in (head_[None], head_.T[None], head_):
        assert [r.pred_id for r in engine.postprocess(raw(layout)).orderBy("det_rank").collect()] == [2, 0]
    assert engine.postprocess(raw(head_[:5][None])).count() == 0
    both = images.from_arrays(spark, [np.zeros((4, 4, 3), np.uint8)] * 2)
    assert {r.image_id: r.summary for r in engine.summarize(both, engine.postprocess(raw(head_[None]))).collect()} == {0: "1 a, 1 b", 1: "(no detections)"}
    classify = Engine(spark, identity_model(str(tmp_path / "c.onnx"), {"task": "classify"}))
    assert np.allclose(classify.postprocess(raw(np.array([[0.2, 0.8]]))).first().probs, (0.2, 0.8))
    final = Engine(spark, identity_model(str(tmp_path / "e.onnx"), {"task": "detect", "end2end": "True"}))
    assert final.postprocess(raw(np.array([[[1, 1, 9, 9, 0.9, 3], [1, 1, 9, 9, 0.1, 3]]]))).count() == 1
    turned = Engine(spark, identity_model(str(tmp_path / "o.onnx"), {"task": "obb", "end2end": "True"}))
    row = turned.postprocess(raw(np.array([[[10, 20, 8, 4, 0.9, 2, 0.5], [10, 20, 8, 4, 0.1, 2, 0.5]]]))).first()
    assert (row.cx, row.cy, row.w, row.h, row.angle, row.cls) == (10, 20, 8, 4, 0.5, 2)
    sem = Engine(spark, identity_model(str(tmp_path / "s.onnx"), {"task": "semantic"}))
    baked = sem.postprocess(spark.createDataFrame([(0, "p", 0, 2, 2, 2, 2, 1.0, 0.0, 0.0, [(bytearray([0, 5, 3, 7]), [1, 2, 2])], None)], schema)).first()
    assert np.frombuffer(baked.classes, "<u2").tolist() == [0, 5, 3, 7]
    assert set(np.frombuffer(sem.postprocess(raw(np.stack([np.zeros((8, 8)), np.ones((8, 8))])[None])).first().classes, "<u2")) == {1}


def test_layout_from_shapes(spark, tmp_path):
    engine = Engine(spark, identity_model(str(tmp_path / "m.onnx"), {"task": "detect"}))
    assert engine.shapes == [[1, 3, 640, 640]]
    for task, shapes, want in (("detect", [[1, 300, 6]], True), ("detect", [[1, 84, 8400]], False), ("obb", [[1, 300, 7]], True), ("pose", [[1, 300, 57]], True), ("segment", [[1, 300, 38], [1, 32, 160, 160]], True), ("segment", [[1, 116, 8400], [1, 32, 160, 160]], False)):
        engine.task, engine.shapes = task, shapes
        assert engine.layout()[0] == want
    assert engine.layout()[1:3] == (80, 32)


def test_rectangles(spark, tmp_path):
    path = identity_model(str(tmp_path / "r.onnx"), {"task": "detect", "imgsz": "[64, 64]"})
    source = images.from_arrays(spark, [np.zeros((20, 40, 3), np.uint8), np.zeros((40, 40, 3), np.uint8), np.zeros((20, 40, 3), np.uint8)])
    rows = models.forward(source, path).orderBy("frame_idx").collect()
    assert [list(r.outputs[0].shape) for r in rows] == [[1, 3, 32, 64], [1, 3, 64, 64], [1, 3, 32, 64]]
    assert all(r.in_h == s.outputs[0].shape[2] and r.preprocess >= 0 and r.forward >= 0 for r, s in zip(rows, rows))


def test_masks_from_the_engine(spark, tmp_path):
    engine = Engine(spark, identity_model(str(tmp_path / "g.onnx"), {"task": "segment", "names": "{0: 'a'}"}), InferenceConfig(conf=0.5))
    engine.shapes = [[1, 7, 3], [1, 2, 8, 8]]
    head_ = np.array([[16, 16, 16, 16, 0.9, 4, 0], [48, 48, 16, 16, 0.8, 0, 4], [48, 48, 16, 16, 0.1, 0, 4]], np.float32)
    protos = np.stack([np.full((8, 8), 2.0), np.full((8, 8), -2.0)]).astype(np.float32)
    out = [(bytearray(a.astype("<f4").tobytes()), list(a.shape)) for a in (head_[None], protos[None])]
    raw = spark.createDataFrame([(0, "p", 0, 64, 64, 64, 64, 1.0, 0.0, 0.0, out, None)], f"image_id long, {models.OUTPUT}")
    dets = engine.postprocess(raw)
    masks = engine.masks(raw, dets).orderBy("det_rank").collect()
    want = planes.instance_masks(head_[:2, 5:], protos, np.array([[8, 8, 24, 24], [40, 40, 56, 56]], np.float32), 64, 64, 64, 64, 0.0, 0.0)
    assert [r.det_rank for r in masks] == [0, 1] and all(np.allclose(np.frombuffer(r.mask, "<f4").reshape(64, 64), w) for r, w in zip(masks, want))
    bounds = {r.det_rank: (r.area, r.x1, r.y2) for r in mask_bounds(engine.masks(raw, dets)).collect()}
    assert bounds == {0: (17 * 17, 8, 24), 1: (0, None, None)}
    source = images.from_arrays(spark, [np.zeros((64, 64, 3), np.uint8)], ["one.jpg"])
    drawn = engine.annotate(source, dets, engine.masks(raw, dets)).first()
    assert drawn.png[:4] == b"\x89PNG" and drawn.labels == [" a 0.90 ", " a 0.80 "]
    run = engine.save(source, dets, str(tmp_path / "runs"))
    assert os.listdir(run) == ["one.png"] and run.endswith("predict")
    assert Engine(spark, engine.model, InferenceConfig(save=False)).save(source, dets, str(tmp_path / "runs")) is None


def test_end_to_end_and_what_is_said(spark, folder, tmp_path):
    engine = Engine(spark, identity_model(str(tmp_path / "e.onnx"), {"task": "semantic", "imgsz": "[32, 32]"}))
    source = engine.read(folder)
    raw = engine.raw(source)
    found = engine.postprocess(raw)
    run = engine.save(source, found, str(tmp_path / "runs"))
    maps = sorted(os.listdir(os.path.join(run, "maps")))
    assert len(maps) == 3 and all(m.endswith(".png") for m in maps) and engine.unreadable(source) == 1
    assert engine.speed(raw).first().forward > 0
    said = {r.image_id: r.summary for r in engine.summarize(source, found).collect()}
    assert len(said) == 4 and said[3] == "(no detections)" and set(said[0].split(", ")) <= {"unknown"}
    boxes = Engine(spark, identity_model(str(tmp_path / "f.onnx"), {"task": "detect", "imgsz": "[32, 32]", "names": "{0: 'a'}"}))
    none = spark.createDataFrame([], "image_id long, det_rank long, cls int")
    lines = [r.line for r in boxes.lines(source, boxes.raw(source), none).orderBy("image_id").collect()]
    assert len(lines) == 3 and lines[0].startswith("image 1/4 ") and "(no detections)" in lines[0]


def test_folders_are_numbered_without_one_task(spark, folder):
    df = images.read_directory(spark, folder)
    rows = df.select("path", "frame_idx").orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == list(range(len(rows))) and [r.path for r in rows] == sorted(r.path for r in rows)
    assert "SinglePartition" not in df._jdf.queryExecution().toString()


def test_sinks(spark, tmp_path):
    assert sinks.next_run(str(tmp_path)).endswith("predict") and sinks.next_run(str(tmp_path)).endswith("predict2")
    assert sinks.is_writable(str(tmp_path)) and not sinks.is_writable(str(tmp_path / "no"))
    assert sinks.class_map_png(np.array([[1, 300]]))[24] == 16 and sinks.class_map_png(np.array([[1, 2]]))[24] == 8
    df = spark.createDataFrame([("a/x.bin", bytearray(b"1")), ("y.bin", bytearray(b"22"))], "name string, data binary")
    sinks.write_files(df, str(tmp_path))
    assert (tmp_path / "a/x.bin").read_bytes() == b"1" and (tmp_path / "y.bin").read_bytes() == b"22"
    assert spark.range(1).select(sinks.payload(a=F.lit(1), b=F.lit(None).cast("int")).alias("p")).first().p == '{"a":1}'


def test_payloads(spark):
    dets = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, 0.5, 3, "b", "#1"), (1, 0, 0.0, 0.0, 2.0, 1.0, 0.9, 2, "a", "#0")], "image_id long, det_rank long, x1 float, y1 float, x2 float, y2 float, conf float, cls int, name string, color string")
    assert [b["name"] for b in json.loads(sinks.box_payload(dets).first().boxes)] == ["a", "b"]
    poses = spark.createDataFrame([(1, 0, [(1.0, 2.0, None)])], "image_id long, det_rank long, keypoints array<struct<x:float,y:float,conf:float>>")
    assert json.loads(sinks.keypoint_payload(poses).first().keypoints) == [[[1.0, 2.0, None]]]


def test_outputs_are_made_one_image_at_a_time(spark):
    import tracemalloc

    import pyarrow as pa

    from ocellus.plans import engine

    class Raw:
        """Gives the function that would run in the Python worker."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    geometry = {"orig_h": 640, "orig_w": 640, "in_h": 640, "in_w": 640, "scale": 1.0, "pad_top": 0.0, "pad_left": 0.0}
    for run, width in ((engine.explode_head(Raw(), 4, 0, 0.5), 8), (engine.explode_rows(Raw()), 6)):
        one = np.full((1, 500_000 // width, width), 0.1, "<f4")
        one[0, 0, 4] = 0.9
        batch = pa.RecordBatch.from_pylist([{"image_id": k, "outputs": [{"data": one.tobytes(), "shape": list(one.shape)}], "error": None} | geometry for k in range(30)])
        found, peak = [], 0
        tracemalloc.start()
        for out in run(iter([batch])):
            found.append((out["image_id"][0].as_py(), out.num_rows))
            peak = max(peak, tracemalloc.get_traced_memory()[0])
            tracemalloc.reset_peak()
        tracemalloc.stop()
        assert found == [(k, 1 if width == 8 else one.shape[1]) for k in range(30)]
        assert peak < 10 * one.nbytes  # of 30


def test_tensor_of_an_image(spark):
    from ocellus.plans.engine import head_tensors

    rows = [(7, 2, 1.0, 2.0, 3.0, 4.0, [0.5, None], 480), (7, 1, None, 6.0, 7.0, 8.0, [0.25, 0.75], 480), (8, 1, 1.0, 1.0, 1.0, 1.0, [1.0, 0.0], 720)]
    head = spark.createDataFrame(rows, "image_id long, pred_id long, cx float, cy float, w float, h float, scores array<float>, orig_h int")
    got = {r.image_id: r for r in head_tensors(head, "orig_h").collect()}
    assert [(got[k].shape, got[k].orig_h) for k in (7, 8)] == [([1, 2, 6], 480), ([1, 1, 6], 720)]
    want = [[np.nan, 6, 7, 8, 0.25, 0.75], [1, 2, 3, 4, 0.5, np.nan]]
    assert np.array_equal(np.frombuffer(got[7].data, "<f4").reshape(2, 6), np.array(want, "<f4"), equal_nan=True)


def test_engine_halves_makes_no_tensors_of_many_images_at_once(spark):
    assert "ArrowEvalPython" not in QUERIES["engine_halves"](spark, SF)._jdf.queryExecution().toString()


def test_stream_equals_batch(spark):
    small = adapters.head(spark, SF).filter("image_id < 4")
    config = InferenceConfig(conf=0.9, iou=0.45)
    want = {(r.image_id, r.det_rank, r.pred_id) for r in decode.detect(small, config).collect()}
    assert {(r.image_id, r.det_rank, r.pred_id) for r in frames.replay(small, config).collect()} == want


def test_stream_files_grow_in_number_not_in_size(spark, monkeypatch):
    seen = []
    own = frames.head_stream

    def spied(spark, folder, schema, files_per_batch=1):
        by_file = spark.read.parquet(folder).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), F.collect_set("image_id").alias("images"))
        seen.append(([r.rows for r in by_file.collect()], [i for r in by_file.collect() for i in r.images], files_per_batch))
        return own(spark, folder, schema, files_per_batch)

    monkeypatch.setattr(frames, "head_stream", spied)
    monkeypatch.setattr(frames, "ROWS_A_FILE", 100, raising=False)
    rows = [(image, k, 20.0 * k, 50.0, 10.0, 10.0, [0.99, 0.1], [], 640, 640, 1.0, 0.0, 0.0) for image in range(400) for k in range(5)]
    config = InferenceConfig(conf=0.9, iou=0.45)
    table = spark.createDataFrame(rows, HEAD)
    assert {(r.image_id, r.det_rank, r.pred_id) for r in frames.replay(table, config).collect()} == {(r[0], r[1], r[1]) for r in rows}
    ((sizes, image_ids, files_per_batch),) = seen
    assert sum(sizes) == len(rows) and max(sizes) < 250  # a fourth of the table is 500
    assert sorted(image_ids) == list(range(400))  # no image is in two files
    assert len(sizes) <= 20 and files_per_batch == 5


def test_frame_folder_as_a_stream(spark, folder, tmp_path):
    seen = []
    q = frames.frame_stream(spark, folder, 2).writeStream.foreachBatch(lambda df, k: seen.append(df.count())).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == images.read(spark, folder).filter("error IS NULL").count() or sum(seen) >= 3


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "nation", "embeddings", "events", "pages", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=str) == rows
