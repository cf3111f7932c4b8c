"""Registered queries over the driver's tables, each with the SQL that it must agree with.

Values that went through 32-bit arithmetic are rounded to 3 or 4 places in double precision on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.functions import color, text
from ocellus.functions import geometry as G
from ocellus.functions import vectors as V
from ocellus.functions.config import InferenceConfig
from ocellus.operators import decode, planes, results
from ocellus.sources import adapters as A
from ocellus.sources import sinks

CONF = InferenceConfig(conf=0.25, iou=0.45, max_det=300)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(c: Column | str, places: int = 3) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places) + 0.0


def rs(x: str, places: int = 3) -> str:
    return f"round(({x})::DOUBLE, {places}) + 0.0"


def _boxes(df: DataFrame, *more: str) -> DataFrame:
    return df.select("image_id", "det_rank", "pred_id", "cls", r("conf", 4).alias("conf"), *(r(c).alias(c) for c in ("x1", "y1", "x2", "y2")), *more)


# SQL pieces ----

FIRST_BEST = "list_position(scores, list_max(scores)) - 1"
LAST_BEST = "len(scores) - list_position(list_reverse(scores), list_max(scores))"
CLIP = {"x1": "orig_w", "y1": "orig_h", "x2": "orig_w", "y2": "orig_h"}
XYXY = """(cx - w * 0.5::FLOAT - pad_left) / scale AS x1, (cy - h * 0.5::FLOAT - pad_top) / scale AS y1,
    (cx + w * 0.5::FLOAT - pad_left) / scale AS x2, (cy + h * 0.5::FLOAT - pad_top) / scale AS y2"""
IOU_OVER = """(least(a.x2, b.x2) - greatest(a.x1, b.x1)) > 0 AND (least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0 AND
    ((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) /
    ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) > {t}::FLOAT"""


def clip_sql(c: str) -> str:
    return f"least(greatest({c}, 0::FLOAT), {CLIP[c]}::FLOAT) AS {c}"


def nms_sql(candidates: str, over: str, max_det: int) -> str:
    """CTEs that end in `dets`: the rows of the CTE `candidates` that per-class greedy suppression keeps, with det_rank."""
    return f"""
box AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, pred_id) AS k FROM {candidates}),
hits AS MATERIALIZED (
  SELECT b.image_id, b.cls, b.k, list(a.k) AS blockers FROM box a JOIN box b ON a.image_id = b.image_id AND a.cls = b.cls AND a.k < b.k
  WHERE {over} GROUP BY ALL
),
step AS MATERIALIZED (
  SELECT box.image_id, box.cls, box.k, blockers FROM box LEFT JOIN hits USING (image_id, cls, k)
),
walk AS (
  SELECT DISTINCT image_id, cls, 0::BIGINT AS k, []::BIGINT[] AS kept FROM box
  UNION ALL
  SELECT w.image_id, w.cls, s.k, CASE WHEN blockers IS NOT NULL AND list_has_any(kept, blockers) THEN kept ELSE list_append(kept, s.k) END
  FROM walk w JOIN step s ON s.image_id = w.image_id AND s.cls = w.cls AND s.k = w.k + 1
),
kept AS (SELECT image_id, cls, unnest(arg_max(kept, k)) AS k FROM walk GROUP BY image_id, cls),
dets AS (
  SELECT * FROM (
    SELECT box.*, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, pred_id) - 1 AS det_rank FROM box JOIN kept USING (image_id, cls, k)
  ) WHERE det_rank < {max_det}
)"""


def detect_sql(conf: float, iou: float, max_det: int, classes: str = "") -> str:
    return f"""{A.HEAD_SQL},
best AS (SELECT *, ({FIRST_BEST})::INT AS cls, list_max(scores) AS conf FROM head),
scaled AS (SELECT image_id, pred_id, cls, conf, orig_h, orig_w, {XYXY} FROM best WHERE conf > {conf}::FLOAT {classes}),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, pred_id) AS pre FROM scaled) WHERE pre <= {10 * max_det}),
{nms_sql("cand", IOU_OVER.format(t=iou), max_det)},
clipped AS (SELECT image_id, det_rank, pred_id, cls, conf, orig_h, orig_w, {", ".join(clip_sql(c) for c in CLIP)} FROM dets)"""


INCLUSIVE_SQL = """
best AS (SELECT *, ({best})::INT AS cls, list_max(scores) AS conf FROM head),
unclipped AS (SELECT *, {xyxy} FROM best WHERE conf >= {conf}::FLOAT),
cand AS (SELECT * REPLACE ({clip}) FROM unclipped)"""


def inclusive_sql(head: str, conf: float, iou: float, max_det: int) -> str:
    inner = INCLUSIVE_SQL.format(best=LAST_BEST, xyxy=XYXY, conf=conf, clip=", ".join(clip_sql(c) for c in CLIP))
    return f"{head},{inner},{nms_sql('cand', IOU_OVER.format(t=iou), max_det)}"


BOX_OUT = f"image_id, det_rank, pred_id, cls, {rs('conf', 4)} AS conf, {', '.join(f'{rs(c)} AS {c}' for c in CLIP)}"
PAIRS = InferenceConfig(conf=0.9, iou=0.45, max_det=300)
DETECT = detect_sql(0.25, 0.45, 300)
DETECT_HIGH = detect_sql(0.9, 0.45, 300)


def _dets(spark: SparkSession, d: str, config: InferenceConfig = CONF) -> DataFrame:
    return decode.detect(A.head(spark, d), config)


def _geometry(spark: SparkSession, d: str) -> DataFrame:
    return A.head(spark, d).select("image_id", "orig_h", "orig_w").distinct()


# detection ----


@query(f"WITH RECURSIVE {DETECT} SELECT {BOX_OUT} FROM clipped")
def detect_nms(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(_dets(spark, d))


@query(f"WITH RECURSIVE {detect_sql(0.5, 0.7, 20, 'AND cls IN (1, 3)')} SELECT {BOX_OUT} FROM clipped")
def detect_topk_cap(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(decode.detect(A.head(spark, d), InferenceConfig(conf=0.5, iou=0.7, max_det=20, classes=(1, 3))))


@query(f"WITH RECURSIVE {detect_sql(0.97, 0.45, 300)} SELECT {BOX_OUT} FROM clipped")
def detect_nms_fold(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(decode.detect(A.head(spark, d), InferenceConfig(conf=0.97, iou=0.45), strategy="fold"))


@query(
    f"""WITH {A.HEAD_SQL}, s AS (SELECT image_id, list_max(scores) AS m FROM head)
SELECT image_id, count(*) FILTER (m > 0.5::FLOAT) AS n_strict, count(*) FILTER (m >= 0.5::FLOAT) AS n_inclusive FROM s GROUP BY image_id"""
)
def conf_strict_vs_inclusive(spark: SparkSession, d: str) -> DataFrame:
    s = A.head(spark, d).select("image_id", V.first_best(F.col("scores"))["score"].alias("m"))
    return s.groupBy("image_id").agg(F.count_if(F.col("m") > G.f32(0.5)).alias("n_strict"), F.count_if(F.col("m") >= G.f32(0.5)).alias("n_inclusive"))


@query(f"WITH {A.HEAD_SQL} SELECT image_id, ({FIRST_BEST})::INT AS cls, count(*) AS n FROM head WHERE ({FIRST_BEST}) IN (0, 2) GROUP BY ALL")
def class_filter(spark: SparkSession, d: str) -> DataFrame:
    best = A.head(spark, d).select("image_id", V.first_best(F.col("scores"))["cls"].alias("cls"))
    return best.filter(decode.class_filter(F.col("cls"), InferenceConfig(classes=(0, 2)))).groupBy("image_id", "cls").agg(F.count("*").alias("n"))


@query(f"WITH {A.POSE_SQL} SELECT pred_id, ({FIRST_BEST})::INT AS first_cls, ({LAST_BEST})::INT AS last_cls, {rs('list_max(scores)', 4)} AS score FROM head")
def argmax_ties(spark: SparkSession, d: str) -> DataFrame:
    h = A.pose_head(spark, d)
    return h.select("pred_id", V.first_best(F.col("scores"))["cls"].alias("first_cls"), V.last_best(F.col("scores"))["cls"].alias("last_cls"), r(V.last_best(F.col("scores"))["score"], 4).alias("score"))


_PAIRS_SQL = f"""WITH {A.HEAD_SQL}, few AS (SELECT *, {XYXY} FROM head WHERE pred_id <= 20)"""


@query(
    _PAIRS_SQL
    + """, p AS (SELECT a.image_id, a.pred_id AS a_id, b.pred_id AS b_id,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0::FLOAT) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0::FLOAT) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
  FROM few a JOIN few b ON a.image_id = b.image_id AND a.pred_id < b.pred_id)
SELECT image_id, a_id, b_id, """
    + rs("CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END", 4)
    + " AS iou FROM p"
)
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = A.head(spark, d).filter("pred_id <= 20")
    b = h.select("image_id", "pred_id", G.scale_coords(G.xywh_to_xyxy(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), F.col("scale"), F.col("pad_top"), F.col("pad_left")).alias("box"))
    other = b.select("image_id", F.col("pred_id").alias("b_id"), F.col("box").alias("other"))
    pairs = b.join(other, "image_id").filter("pred_id < b_id")
    return pairs.select("image_id", F.col("pred_id").alias("a_id"), "b_id", r(G.iou(F.col("box"), F.col("other")), 4).alias("iou"))


def _probiou_sql(p: str, q: str) -> str:
    """SQL of the probabilistic IoU of two rows with cx, cy, w, h, angle."""

    def spread(t: str) -> tuple[str, str, str]:
        a, b, c, s = f"({t}.w::DOUBLE * {t}.w / 12)", f"({t}.h::DOUBLE * {t}.h / 12)", f"cos({t}.angle::DOUBLE)", f"sin({t}.angle::DOUBLE)"
        return f"({a} * {c} * {c} + {b} * {s} * {s})", f"({a} * {s} * {s} + {b} * {c} * {c})", f"(({a} - {b}) * {c} * {s})"

    (a1, b1, c1), (a2, b2, c2) = spread(p), spread(q)
    a, b, c = f"({a1} + {a2})", f"({b1} + {b2})", f"({c1} + {c2})"
    dx, dy = f"({p}.cx::DOUBLE - {q}.cx::DOUBLE)", f"({p}.cy::DOUBLE - {q}.cy::DOUBLE)"
    det = f"({a} * {b} - {c} * {c})"
    near = f"(({a} * {dy} * {dy} + {b} * {dx} * {dx}) / ({det} + 1e-7) * 0.25)"
    tilt = f"(({c} * -{dx} * {dy}) / ({det} + 1e-7) * 0.5)"
    own = f"sqrt(greatest({a1} * {b1} - {c1} * {c1}, 0) * greatest({a2} * {b2} - {c2} * {c2}, 0))"
    bd = f"least(greatest({near} + {tilt} + ln({det} / (4 * {own} + 1e-7) + 1e-7) * 0.5, 1e-7), 100)"
    return f"(1 - sqrt(1 - exp(-{bd}) + 1e-7))"


_OBB_ROWS = f"""obbs AS (
  SELECT image_id, pred_id, ({LAST_BEST})::INT AS cls, list_max(scores) AS conf,
    least(greatest((cx - pad_left) / scale, 0::FLOAT), orig_w::FLOAT) AS cx, least(greatest((cy - pad_top) / scale, 0::FLOAT), orig_h::FLOAT) AS cy,
    w / scale AS w, h / scale AS h, angle, orig_h, orig_w
  FROM head WHERE list_max(scores) >= 0.9::FLOAT
)"""


def _obb_head(spark: SparkSession, d: str) -> DataFrame:
    return A.head(spark, d).withColumn("extra", F.array("angle"))


@query(f"WITH {A.HEAD_SQL}, few AS (SELECT * FROM head WHERE pred_id <= 12) SELECT a.image_id, a.pred_id AS a_id, b.pred_id AS b_id, {rs(_probiou_sql('a', 'b'), 4)} AS iou FROM few a JOIN few b ON a.image_id = b.image_id AND a.pred_id < b.pred_id")
def probiou_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = A.head(spark, d).filter("pred_id <= 12").select("image_id", "pred_id", F.struct("cx", "cy", "w", "h", "angle").alias("box"))
    other = b.select("image_id", F.col("pred_id").alias("b_id"), F.col("box").alias("other"))
    return b.join(other, "image_id").filter("pred_id < b_id").select("image_id", F.col("pred_id").alias("a_id"), "b_id", r(G.probiou(F.col("box"), F.col("other")), 4).alias("iou"))


@query(
    f"WITH RECURSIVE {A.HEAD_SQL}, {_OBB_ROWS}, {nms_sql('obbs', _probiou_sql('a', 'b') + ' > 0.45', 300)} "
    f"SELECT image_id, det_rank, pred_id, cls, {rs('conf', 4)} AS conf, {', '.join(f'{rs(c)} AS {c}' for c in ('cx', 'cy', 'w', 'h', 'angle'))} FROM dets"
)
def obb_nms(spark: SparkSession, d: str) -> DataFrame:
    out = decode.obb(_obb_head(spark, d), PAIRS)
    return out.select("image_id", "det_rank", "pred_id", "cls", r("conf", 4).alias("conf"), *(r(c).alias(c) for c in ("cx", "cy", "w", "h", "angle")))


_CORNERS_SQL = ", ".join(f"cx::DOUBLE + ({ix} * w::DOUBLE) * cos(angle::DOUBLE) - ({iy} * h::DOUBLE) * sin(angle::DOUBLE) AS px{k}, cy::DOUBLE + ({ix} * w::DOUBLE) * sin(angle::DOUBLE) + ({iy} * h::DOUBLE) * cos(angle::DOUBLE) AS py{k}" for k, (ix, iy) in enumerate(((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))))
_CORNERS = f"WITH {A.HEAD_SQL}, {_OBB_ROWS}, c AS (SELECT *, {_CORNERS_SQL} FROM obbs)"


def _obb_rows(spark: SparkSession, d: str) -> DataFrame:
    h = _obb_head(spark, d)
    sized = h.select("image_id", "orig_h", "orig_w").distinct()
    kept = decode.obb(h, InferenceConfig(conf=0.9, iou=2.0, max_det=10**6))
    return kept.join(sized, "image_id").withColumn("corners", G.corners(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle"))))


@query(_CORNERS + " SELECT image_id, pred_id, " + ", ".join(f"{rs(f'p{a}{k}')} AS p{a}{k}" for k in range(4) for a in "xy") + " FROM c")
def obb_corners(spark: SparkSession, d: str) -> DataFrame:
    return _obb_rows(spark, d).select("image_id", "pred_id", *(r(F.get("corners", F.lit(k))[a]).alias(f"p{a}{k}") for k in range(4) for a in "xy"))


@query(_CORNERS + " SELECT image_id, pred_id, " + ", ".join(f"{rs(f'least(greatest({f}(px0, px1, px2, px3), 0), orig_w)' if a == 'x' else f'least(greatest({f}(py0, py1, py2, py3), 0), orig_h)')} AS {a}{k}" for a, k, f in (("x", 1, "least"), ("y", 1, "least"), ("x", 2, "greatest"), ("y", 2, "greatest"))) + " FROM c")
def obb_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = _obb_rows(spark, d).withColumn("b", G.bounds(F.col("corners"), F.col("orig_h"), F.col("orig_w")))
    return b.select("image_id", "pred_id", *(r(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(f"WITH RECURSIVE {inclusive_sql(A.HEAD_SQL, 0.9, 0.45, 300)} SELECT {BOX_OUT}, {', '.join(f'{rs(f'coefficients[{k + 1}]')} AS k{k}' for k in range(4))} FROM dets")
def segment_decode(spark: SparkSession, d: str) -> DataFrame:
    out = decode.segment(A.head(spark, d).withColumnRenamed("coefficients", "extra"), PAIRS)
    return _boxes(out, *(r(F.get("coefficients", F.lit(k))).alias(f"k{k}") for k in range(4)))


@query()
def segment_masks(spark: SparkSession, d: str) -> DataFrame:
    h = A.head(spark, d).withColumnRenamed("coefficients", "extra")
    dets = decode.segment(h, InferenceConfig(conf=0.99, iou=0.45, max_det=5))
    sized = h.select("image_id", "pad_top", "pad_left", F.floor(F.col("orig_h") / 8).cast("int").alias("orig_h"), F.floor(F.col("orig_w") / 8).cast("int").alias("orig_w")).distinct()
    small = dets.select("image_id", "det_rank", "coefficients", *((F.col(c) / 8).cast("float").alias(c) for c in CLIP)).join(sized, "image_id")
    n = A.read(spark, d, "embeddings").count()
    e = A.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    four = sized.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumn("vec_id", F.pmod(F.col("image_id") * 4 + F.col("k"), F.lit(n)))
    protos = four.join(e, "vec_id").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p")).select("image_id", F.flatten(F.transform("p", lambda x: x["v"])).alias("v"))

    @F.arrow_udf("binary")
    def floats(v):
        import numpy as np
        import pyarrow as pa

        return pa.array([np.asarray(x, "<f4").tobytes() for x in v.to_pylist()], pa.binary())

    packed = protos.select("image_id", floats("v").alias("data"), F.lit(4).alias("channels"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return planes.mask_areas(small, packed, A.INPUT, A.INPUT)


_POSE = inclusive_sql(A.POSE_SQL, 0.25, 0.45, 300)
_KPT = "SELECT image_id, det_rank, pred_id, unnest(range(0, 4)) AS kpt, extra, scale, pad_top, pad_left, orig_h, orig_w FROM dets"
_KX, _KY = "least(greatest((extra[kpt * 3 + 1] - pad_left) / scale, 0::FLOAT), orig_w::FLOAT)", "least(greatest((extra[kpt * 3 + 2] - pad_top) / scale, 0::FLOAT), orig_h::FLOAT)"


def _pose(spark: SparkSession, d: str) -> DataFrame:
    return decode.pose(A.pose_head(spark, d), CONF)


def _keypoints(spark: SparkSession, d: str) -> DataFrame:
    return _pose(spark, d).select("image_id", "det_rank", "pred_id", F.posexplode("keypoints").alias("kpt", "k")).select("image_id", "det_rank", "pred_id", "kpt", "k.*")


@query(f"WITH RECURSIVE {_POSE} SELECT {BOX_OUT} FROM dets")
def pose_decode(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(_pose(spark, d))


@query(f"WITH RECURSIVE {_POSE} SELECT image_id, det_rank, pred_id, kpt::INT AS kpt, {rs(_KX)} AS x, {rs(_KY)} AS y, {rs('extra[kpt * 3 + 3]')} AS conf FROM ({_KPT})")
def pose_keypoints(spark: SparkSession, d: str) -> DataFrame:
    return _keypoints(spark, d).select("image_id", "det_rank", "pred_id", "kpt", r("x").alias("x"), r("y").alias("y"), r("conf").alias("conf"))


@query(f"WITH RECURSIVE {_POSE} SELECT image_id, det_rank, kpt::INT AS kpt, {rs(f'{_KX} / 640::FLOAT', 4)} AS xn, {rs(f'{_KY} / 480::FLOAT', 4)} AS yn FROM ({_KPT})")
def kpts_normalized(spark: SparkSession, d: str) -> DataFrame:
    k = _keypoints(spark, d)
    return k.select("image_id", "det_rank", "kpt", r(G.ratio(F.col("x"), 640), 4).alias("xn"), r(G.ratio(F.col("y"), 480), 4).alias("yn"))


@query(f"WITH RECURSIVE {_POSE} SELECT image_id, count(*) AS visible FROM ({_KPT}) WHERE extra[kpt * 3 + 3] >= 0.25::FLOAT AND {_KX} > 0 AND {_KX} < 640 AND {_KY} > 0 AND {_KY} < 480 GROUP BY image_id")
def kpts_visible(spark: SparkSession, d: str) -> DataFrame:
    k = _keypoints(spark, d).filter(G.visible(F.col("x"), F.col("y"), F.col("conf"), 480, 640))
    return k.groupBy("image_id").agg(F.count("*").alias("visible"))


_E2E_SQL = f"""{A.HEAD_SQL}, rows_ AS (
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY scores[1] DESC, pred_id) AS pred_id, {XYXY.replace("(cx", "(cx").replace(" / scale", "").replace(" - pad_left", "").replace(" - pad_top", "")},
    scores[1] AS conf, (pred_id % 4)::INT AS cls, scale, pad_top, pad_left, orig_h, orig_w FROM head
), read_ AS (SELECT *, bool_or(conf < 0.6::FLOAT) OVER (PARTITION BY image_id ORDER BY pred_id ROWS UNBOUNDED PRECEDING) AS stop FROM rows_),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pred_id) - 1 AS det_rank FROM read_ WHERE NOT stop AND cls IN (0, 1, 2))"""


@query(
    f"WITH {_E2E_SQL} SELECT image_id, det_rank, pred_id, cls, {rs('conf', 4)} AS conf, "
    + ", ".join(f"{rs(f'least(greatest(({c} - {p}) / scale, 0::FLOAT), {CLIP[c]}::FLOAT)')} AS {c}" for c, p in (("x1", "pad_left"), ("y1", "pad_top"), ("x2", "pad_left"), ("y2", "pad_top")))
    + " FROM ranked WHERE det_rank < 100"
)
def end2end_cutoff(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    h = A.head(spark, d).withColumn("b", G.xywh_to_xyxy(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")))
    order = Window.partitionBy("image_id").orderBy(F.desc(F.get("scores", F.lit(0))), "pred_id")
    rows = h.select("image_id", F.row_number().over(order).cast("long").alias("pred_id"), "b.*", F.get("scores", F.lit(0)).alias("conf"), F.pmod("pred_id", F.lit(4)).cast("int").alias("cls"), "scale", "pad_top", "pad_left", "orig_h", "orig_w")
    return _boxes(decode.end2end(rows, InferenceConfig(conf=0.6, max_det=100, classes=(0, 1, 2))))


_TURNED_SQL = {"cx": "least(greatest((x1 - pad_left) / scale, 0::FLOAT), orig_w::FLOAT)", "cy": "least(greatest((y1 - pad_top) / scale, 0::FLOAT), orig_h::FLOAT)", "w": "x2 / scale", "h": "y2 / scale", "angle": "conf * 2::FLOAT"}


@query(f"WITH {_E2E_SQL} SELECT image_id, det_rank, pred_id, cls, {rs('conf', 4)} AS conf, {', '.join(f'{rs(x)} AS {c}' for c, x in _TURNED_SQL.items())} FROM ranked WHERE det_rank < 100")
def end2end_obb(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    h = A.head(spark, d).withColumn("b", G.xywh_to_xyxy(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))).withColumn("conf", F.get("scores", F.lit(0)))
    order = Window.partitionBy("image_id").orderBy(F.desc("conf"), "pred_id")
    rows = h.select("image_id", F.row_number().over(order).cast("long").alias("pred_id"), "b.*", "conf", F.pmod("pred_id", F.lit(4)).cast("int").alias("cls"), F.array(F.col("conf") * G.f32(2)).alias("extra"), "scale", "pad_top", "pad_left", "orig_h", "orig_w")
    got = decode.end2end_obb(rows, InferenceConfig(conf=0.6, max_det=100, classes=(0, 1, 2)))
    return got.select("image_id", "det_rank", "pred_id", "cls", r("conf", 4).alias("conf"), *(r(c).alias(c) for c in _TURNED_SQL))


@query(f"WITH RECURSIVE {DETECT_HIGH} SELECT {BOX_OUT} FROM clipped")
def engine_halves(spark: SparkSession, d: str) -> DataFrame:
    """The engine's second half over outputs as a model gives them: one binary tensor an image."""
    from ocellus.plans.engine import explode_head, head_tensors

    geometry = ("orig_h", "orig_w", "scale", "pad_top", "pad_left")
    head = A.head(spark, d)
    raw = head_tensors(head, *geometry).select(
        "image_id", F.array(F.struct("data", "shape")).alias("outputs"), F.lit(None).cast("string").alias("error"), "orig_h", "orig_w", F.lit(640).alias("in_h"), F.lit(640).alias("in_w"), *(F.col(c).cast("float").alias(c) for c in geometry[2:])
    )
    ids = head.groupBy("image_id").agg(F.array_sort(F.collect_list("pred_id")).alias("ids"))
    classes = A.head(spark, d).select(F.size("scores")).first()[0]
    found = decode.detect(explode_head(raw, classes, 0, PAIRS.conf), PAIRS)
    numbered = found.withColumnRenamed("pred_id", "place").join(ids, "image_id").withColumn("pred_id", F.get("ids", F.col("place").cast("int")))
    return _boxes(numbered)


@query(
    f"""WITH {A.HEAD_SQL}, unit AS (SELECT image_id, pred_id, (cx / 640::FLOAT) AS cx, (w / 640::FLOAT) AS w FROM head WHERE image_id % 2 = 0
UNION ALL SELECT image_id, pred_id, cx, w FROM head WHERE image_id % 2 = 1)
SELECT image_id, pred_id, {rs("CASE WHEN image_id % 2 = 0 THEN cx * 640::FLOAT ELSE cx END")} AS cx, {rs("CASE WHEN image_id % 2 = 0 THEN w * 640::FLOAT ELSE w END")} AS w FROM unit"""
)
def denormalized_head(spark: SparkSession, d: str) -> DataFrame:
    h = A.head(spark, d)
    unit = h
    for c in ("cx", "cy", "w", "h"):
        unit = unit.withColumn(c, F.when(F.pmod("image_id", F.lit(2)) == 0, G.ratio(F.col(c), 640)).otherwise(F.col(c)))
    return decode.denormalize(unit, A.INPUT, A.INPUT).select("image_id", "pred_id", r("cx").alias("cx"), r("w").alias("w"))


# result accessors ----


@query(f"WITH RECURSIVE {DETECT_HIGH} SELECT image_id, det_rank, {rs('(x1 + x2) * 0.5::FLOAT')} AS x, {rs('(y1 + y2) * 0.5::FLOAT')} AS y, {rs('x2 - x1')} AS w, {rs('y2 - y1')} AS h FROM clipped")
def boxes_xywh(spark: SparkSession, d: str) -> DataFrame:
    b = _dets(spark, d, PAIRS).withColumn("b", G.xyxy_to_xywh(*(F.col(c) for c in CLIP)))
    return b.select("image_id", "det_rank", *(r(f"b.{c}").alias(c) for c in "xywh"))


@query(f"WITH RECURSIVE {DETECT_HIGH} SELECT image_id, det_rank, {rs('x1 / orig_w::FLOAT', 4)} AS x1n, {rs('y1 / orig_h::FLOAT', 4)} AS y1n, {rs('x2 / orig_w::FLOAT', 4)} AS x2n, {rs('y2 / orig_h::FLOAT', 4)} AS y2n FROM clipped")
def boxes_normalized(spark: SparkSession, d: str) -> DataFrame:
    b = _dets(spark, d, PAIRS).join(_geometry(spark, d), "image_id")
    return b.select("image_id", "det_rank", *(r(G.ratio(F.col(c), F.col(s)), 4).alias(f"{c}n") for c, s in CLIP.items()))


_XYWHN = {"xn": "(x1 + x2) * 0.5::FLOAT / orig_w::FLOAT", "yn": "(y1 + y2) * 0.5::FLOAT / orig_h::FLOAT", "wn": "(x2 - x1) / orig_w::FLOAT", "hn": "(y2 - y1) / orig_h::FLOAT"}


@query(f"WITH RECURSIVE {DETECT_HIGH} SELECT image_id, det_rank, {', '.join(f'{rs(x, 4)} AS {c}' for c, x in _XYWHN.items())} FROM clipped")
def boxes_xywhn(spark: SparkSession, d: str) -> DataFrame:
    b = _dets(spark, d, PAIRS).join(_geometry(spark, d), "image_id").withColumn("b", G.xyxy_to_xywh(*(F.col(c) for c in CLIP)))
    return b.select("image_id", "det_rank", *(r(G.ratio(F.col(f"b.{c}"), F.col(s)), 4).alias(f"{c}n") for c, s in (("x", "orig_w"), ("y", "orig_h"), ("w", "orig_w"), ("h", "orig_h"))))


@query(
    f"WITH RECURSIVE {DETECT_HIGH}, {A.NAMES_SQL} SELECT image_id, det_rank, coalesce(name, cls::VARCHAR) AS name, cls AS class, {rs('conf', 4)} AS confidence, "
    f"{rs('x1 / orig_w::FLOAT', 4)} AS x1, {rs('y1 / orig_h::FLOAT', 4)} AS y1, {rs('x2 / orig_w::FLOAT', 4)} AS x2, {rs('y2 / orig_h::FLOAT', 4)} AS y2 FROM clipped LEFT JOIN names ON class_id = cls"
)
def summary_rows(spark: SparkSession, d: str) -> DataFrame:
    dets = _dets(spark, d, PAIRS).join(_geometry(spark, d), "image_id")
    s = results.summary_rows(dets, A.names(spark, d), normalize=True)
    return s.select("image_id", "det_rank", "name", "class", r("confidence", 4).alias("confidence"), *(r(f"box.{c}", 4).alias(c) for c in CLIP))


def plural_sql(w: str) -> str:
    special = " ".join(f"WHEN {w} = '{a}' THEN '{b}'" for a, b in text.IRREGULAR.items())
    return f"CASE {special} WHEN regexp_matches({w}, '(s|x|ch|sh)$') THEN {w} || 'es' WHEN regexp_matches({w}, 'y$') AND NOT regexp_matches({w}, '[eao]y$') THEN {w}[:-2] || 'ies' ELSE {w} || 's' END"


_COUNTS_SQL = f"counts AS (SELECT image_id, cls, count(*) AS n FROM clipped GROUP BY ALL), lines AS (SELECT image_id, string_agg(n || ' ' || CASE WHEN n > 1 THEN {plural_sql("coalesce(name, 'object')")} ELSE coalesce(name, 'object') END, ', ' ORDER BY cls) AS summary FROM counts LEFT JOIN names ON class_id = cls GROUP BY image_id)"


@query(f"WITH RECURSIVE {DETECT_HIGH}, {A.NAMES_SQL}, {_COUNTS_SQL} SELECT image_id, summary FROM lines")
def class_counts_text(spark: SparkSession, d: str) -> DataFrame:
    return results.class_counts(_dets(spark, d, PAIRS), A.names(spark, d))


_NARROW = detect_sql(0.999, 0.45, 300)


@query(f"WITH RECURSIVE {_NARROW}, {A.NAMES_SQL}, {_COUNTS_SQL} SELECT i.image_id, coalesce(summary, '(no detections)') AS summary FROM (SELECT DISTINCT image_id FROM head) i LEFT JOIN lines USING (image_id)")
def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    return results.describe(_geometry(spark, d), _dets(spark, d, InferenceConfig(conf=0.999, iou=0.45)), A.names(spark, d))


@query("SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 4 = 1 THEN 1 WHEN o_orderkey % 4 = 2 THEN 3 ELSE 0 END::INT AS n FROM orders")
def results_len(spark: SparkSession, d: str) -> DataFrame:
    o = A.read(spark, d, "orders")
    kind = F.pmod("o_orderkey", F.lit(4))
    arr = lambda n: F.sequence(F.lit(1), F.lit(n))
    none = F.lit(None).cast("array<int>")
    n = results.length(F.when(kind == 0, arr(2)), F.when(kind == 0, arr(7)), none, F.when(kind == 1, F.array(F.lit(0.5))), F.when(kind == 2, arr(3)))
    return o.select(F.col("o_orderkey").alias("image_id"), n.alias("n"))


@query("SELECT c_custkey, c_mktsegment AS word, " + plural_sql("lower(c_mktsegment)") + " AS plural FROM customer UNION ALL SELECT p_partkey, p_type, " + plural_sql("lower(split_part(p_type, ' ', 1))") + " FROM part UNION ALL SELECT n_nationkey, n_name, " + plural_sql("lower(n_name)") + " FROM nation")
def pluralize(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("word"), text.pluralize(F.lower("c_mktsegment")).alias("plural"))
    p = A.read(spark, d, "part").select("p_partkey", "p_type", text.pluralize(F.lower(F.split("p_type", " ")[0])))
    return c.union(p).union(A.read(spark, d, "nation").select("n_nationkey", "n_name", text.pluralize(F.lower("n_name"))))


# classification ----

_SOFT_SQL = """soft AS (
  SELECT vec_id AS image_id, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings
), probs AS (SELECT image_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM soft)"""


def _probs(spark: SparkSession, d: str) -> DataFrame:
    return decode.classify(A.logits(spark, d))


@query(f"WITH {_SOFT_SQL} SELECT image_id, {rs('list_max(p)', 6)} AS top, {rs('list_sum(p)', 6)} AS total, {rs('p[1]', 6)} AS first FROM probs")
def classify_softmax(spark: SparkSession, d: str) -> DataFrame:
    p = _probs(spark, d)
    return p.select("image_id", r(F.array_max("probs"), 6).alias("top"), r(F.aggregate("probs", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), r(F.get("probs", F.lit(0)), 6).alias("first"))


@query(f"WITH {_SOFT_SQL} SELECT image_id, (64 - list_position(list_reverse(p), list_max(p)))::INT AS top1, {rs('list_max(p)', 6)} AS top1conf FROM probs")
def probs_top1(spark: SparkSession, d: str) -> DataFrame:
    t = _probs(spark, d).withColumn("t", V.top1(F.col("probs")))
    return t.select("image_id", F.col("t.idx").cast("int").alias("top1"), r("t.p", 6).alias("top1conf"))


@query(
    f"""WITH {_SOFT_SQL}, each AS (SELECT image_id, unnest(p) AS v, unnest(range(0, 64)) AS i FROM probs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, i) AS k FROM each)
SELECT image_id, k::INT AS k, i::INT AS cls, {rs('v', 6)} AS conf FROM ranked WHERE k <= 5"""
)
def probs_top5(spark: SparkSession, d: str) -> DataFrame:
    t = _probs(spark, d).select("image_id", F.posexplode(V.top_k(F.col("probs"), 5)).alias("k", "t"))
    return t.select("image_id", (F.col("k") + 1).alias("k"), F.col("t.idx").cast("int").alias("cls"), r("t.p", 6).alias("conf"))


@query(
    f"""WITH {_SOFT_SQL}, {A.NAMES_SQL}, each AS (SELECT image_id, unnest(p) AS v, unnest(range(0, 64)) AS i FROM probs),
best AS (SELECT image_id, v, i::INT AS i, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, i) AS k FROM each)
SELECT image_id, coalesce(name, i::VARCHAR) AS name, i AS class, {rs('v', 6)} AS confidence FROM best LEFT JOIN names ON class_id = i WHERE k = 1"""
)
def probs_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = results.probs_rows(_probs(spark, d).select("image_id", "probs"), A.names(spark, d))
    return rows.select("image_id", "name", "class", r("confidence", 6).alias("confidence"))


# geometry ----

_SIZES = "sizes AS (SELECT p_partkey AS image_id, (1 + (p_partkey * 131) % 2000)::INT AS h, (1 + (p_partkey * 977) % 3000)::INT AS w FROM part)"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return A.read(spark, d, "part").select(k.alias("image_id"), (1 + F.pmod(k * 131, F.lit(2000))).cast("int").alias("h"), (1 + F.pmod(k * 977, F.lit(3000))).cast("int").alias("w"))


_FIT = "s AS (SELECT *, least(640::FLOAT / h::FLOAT, 640::FLOAT / w::FLOAT) AS scale FROM sizes)"


@query(
    f"""WITH {_SIZES}, {_FIT}, n AS (SELECT *, greatest(round(w::FLOAT * scale)::INT, 1) AS new_w, greatest(round(h::FLOAT * scale)::INT, 1) AS new_h FROM s)
SELECT image_id, {rs('scale', 6)} AS scale, new_w, new_h, (greatest(640 - new_w, 0) // 2)::INT AS pad_left, (greatest(640 - new_h, 0) // 2)::INT AS pad_top FROM n"""
)
def letterbox_geometry(spark: SparkSession, d: str) -> DataFrame:
    g = _sizes(spark, d).withColumn("g", G.letterbox(F.col("h"), F.col("w"), 640, 640))
    return g.select("image_id", r("g.scale", 6).alias("scale"), "g.new_w", "g.new_h", "g.pad_left", "g.pad_top")


@query(
    f"""WITH {_SIZES}, {_FIT} SELECT image_id, greatest(ceil(round(h::FLOAT * scale)::DOUBLE / 32)::INT * 32, 32) AS rect_h,
greatest(ceil(round(w::FLOAT * scale)::DOUBLE / 32)::INT * 32, 32) AS rect_w FROM s"""
)
def rect_size(spark: SparkSession, d: str) -> DataFrame:
    g = _sizes(spark, d).withColumn("g", G.rect_size(F.col("h"), F.col("w"), 640, 640, 32))
    return g.select("image_id", F.col("g.h").alias("rect_h"), F.col("g.w").alias("rect_w"))


@query(
    f"""WITH {_SIZES}, s AS (SELECT *, 224::FLOAT / w::FLOAT AS sx, 224::FLOAT / h::FLOAT AS sy FROM sizes),
n AS (SELECT image_id, greatest(sx, sy) AS scale, CASE WHEN sx >= sy THEN 224 ELSE floor(w::FLOAT * sy)::INT END AS new_w,
  CASE WHEN sx >= sy THEN floor(h::FLOAT * sx)::INT ELSE 224 END AS new_h FROM s)
SELECT image_id, {rs('scale', 6)} AS scale, new_w, new_h, round_even(greatest(new_w - 224, 0) / 2, 0)::INT AS crop_x, round_even(greatest(new_h - 224, 0) / 2, 0)::INT AS crop_y FROM n"""
)
def center_crop_geometry(spark: SparkSession, d: str) -> DataFrame:
    g = _sizes(spark, d).withColumn("g", G.center_crop(F.col("h"), F.col("w"), 224))
    return g.select("image_id", r("g.scale", 6).alias("scale"), "g.new_w", "g.new_h", "g.crop_x", "g.crop_y")


@query(
    f"""WITH {_SIZES}, s AS (SELECT *, least(160::FLOAT / h::FLOAT, 160::FLOAT / w::FLOAT) AS gain FROM sizes),
p AS (SELECT image_id, (160::FLOAT - round(h::FLOAT * gain)) * 0.5::FLOAT AS ph, (160::FLOAT - round(w::FLOAT * gain)) * 0.5::FLOAT AS pw FROM s),
b AS (SELECT image_id, greatest(round(ph - 0.1::FLOAT)::INT, 0) AS top, greatest(round(pw - 0.1::FLOAT)::INT, 0) AS lft,
  greatest(160 - greatest(round(ph + 0.1::FLOAT)::INT, 0), 0) AS bottom, greatest(160 - greatest(round(pw + 0.1::FLOAT)::INT, 0), 0) AS rgt FROM p)
SELECT image_id, top, lft, bottom - top AS crop_h, rgt - lft AS crop_w FROM b WHERE bottom > top AND rgt > lft"""
)
def crop_bounds(spark: SparkSession, d: str) -> DataFrame:
    side = F.lit(160)
    g = _sizes(spark, d).withColumn("b", G.crop_bounds(side, side, F.col("h"), F.col("w"))).filter("b IS NOT NULL")
    return g.select("image_id", "b.top", F.col("b.left").alias("lft"), F.col("b.h").alias("crop_h"), F.col("b.w").alias("crop_w"))


@query(f"WITH {A.HEAD_SQL}, s AS (SELECT image_id, pred_id, orig_h, orig_w, {XYXY} FROM head) SELECT image_id, pred_id, " + ", ".join(f"{rs(clip_sql(c).rpartition(' AS ')[0])} AS {c}" for c in CLIP) + " FROM s")
def scale_clip(spark: SparkSession, d: str) -> DataFrame:
    h = A.head(spark, d)
    box = G.clip_coords(G.scale_coords(G.xywh_to_xyxy(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), F.col("scale"), F.col("pad_top"), F.col("pad_left")), F.col("orig_h"), F.col("orig_w"))
    return h.withColumn("b", box).select("image_id", "pred_id", *(r(f"b.{c}").alias(c) for c in CLIP))


# planes ----

_PLANES_SQL = """px AS (SELECT vec_id // 4 AS image_id, vec_id % 4 AS cls, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings),
best AS (SELECT image_id, i, cls FROM (SELECT *, row_number() OVER (PARTITION BY image_id, i ORDER BY v DESC, cls) AS k FROM px) WHERE k = 1)"""


@query(f"WITH {_PLANES_SQL} SELECT image_id, cls::INT AS cls, count(*) AS pixels FROM best GROUP BY ALL")
def semantic_argmax(spark: SparkSession, d: str) -> DataFrame:
    m = A.class_planes(spark, d).select("image_id", F.explode(V.argmax_planes(F.col("planes"))).alias("cls"))
    return m.groupBy("image_id", "cls").agg(F.count("*").alias("pixels"))


@query(f"WITH {_PLANES_SQL} SELECT image_id, CASE WHEN cls IN (1, 2) THEN cls ELSE 65535 END::INT AS cls, count(*) AS pixels FROM best GROUP BY ALL")
def semantic_filter(spark: SparkSession, d: str) -> DataFrame:
    m = A.class_planes(spark, d).select("image_id", F.explode(V.filter_classes(V.argmax_planes(F.col("planes")), [1, 2], 4)).alias("cls"))
    return m.groupBy("image_id", "cls").agg(F.count("*").alias("pixels"))


@query(f"WITH {_PLANES_SQL}, c AS (SELECT DISTINCT image_id, cls FROM best WHERE cls <> 3) SELECT image_id, string_agg(cls, ',' ORDER BY cls) AS ids, count(*)::INT AS present FROM c GROUP BY image_id")
def mask_class_ids(spark: SparkSession, d: str) -> DataFrame:
    m = A.class_planes(spark, d).select("image_id", V.class_ids(V.filter_classes(V.argmax_planes(F.col("planes")), [0, 1, 2], 4)).alias("ids"))
    return m.filter(F.size("ids") > 0).select("image_id", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"), F.size("ids").alias("present"))


@query(f"WITH {_PLANES_SQL}, {A.NAMES_SQL}, c AS (SELECT DISTINCT image_id, cls FROM best) SELECT image_id, string_agg(name, ', ' ORDER BY cls) AS summary FROM c JOIN names ON class_id = cls GROUP BY image_id")
def semantic_summary(spark: SparkSession, d: str) -> DataFrame:
    named = A.names(spark, d).agg(F.map_from_entries(F.collect_list(F.struct("class_id", "name"))).alias("names"))
    m = A.class_planes(spark, d).select("image_id", V.argmax_planes(F.col("planes")).alias("m")).crossJoin(named)
    return m.select("image_id", results.describe_mask(F.col("m"), F.col("names")).alias("summary"))


_DEPTH_SQL = "ok AS (SELECT vec_id AS image_id, list_filter(embedding, lambda v: v > 0) AS v FROM embeddings)"


@query(f"WITH {_DEPTH_SQL} SELECT image_id, {rs('list_min(v)', 5)} AS lo, {rs('list_max(v)', 5)} AS hi FROM ok")
def depth_range(spark: SparkSession, d: str) -> DataFrame:
    p = A.depth_planes(spark, d).withColumn("g", V.depth_range(F.col("depth")))
    return p.select("image_id", r("g.lo", 5).alias("lo"), r("g.hi", 5).alias("hi"))


@query(f"WITH {_DEPTH_SQL} SELECT image_id, printf('depth %.2f-%.2fm', list_min(v)::DOUBLE, list_max(v)::DOUBLE) AS summary FROM ok")
def depth_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.depth_planes(spark, d).select("image_id", results.describe_depth(F.col("depth")).alias("summary"))


@query(f"WITH {_DEPTH_SQL}, s AS (SELECT image_id, list_sort(list_transform(v, lambda x: 1.0 / x::DOUBLE)) AS s FROM ok) SELECT image_id, {rs('s[1 + round(0.02 * (len(s) - 1))::INT]', 5)} AS lo, {rs('s[1 + round(0.98 * (len(s) - 1))::INT]', 5)} AS hi FROM s")
def depth_percentiles(spark: SparkSession, d: str) -> DataFrame:
    inverse = F.transform(V.valid_depth(F.col("depth")), lambda x: F.lit(1.0) / x.cast("double"))
    p = A.depth_planes(spark, d).withColumn("g", V.percentiles(inverse))
    return p.select("image_id", r("g.lo", 5).alias("lo"), r("g.hi", 5).alias("hi"))


def _colormap_sql(name: str) -> str:
    unit = "least(greatest({}, 0), 1)"
    if name == "gray":
        channels = ["t * 255"] * 3
    elif name == "jet":
        channels = [unit.format(f"1.5 - abs(t * 4 - {c})") + " * 255" for c in (3, 2, 1)]
    elif name == "inferno":
        channels = []
        for row in color.INFERNO:
            v = f"{row[-1]!r}::DOUBLE"
            for c in reversed(row[:-1]):
                v = f"({v} * t + {c!r}::DOUBLE)"
            channels.append(unit.format(v) + " * 255")
    else:
        channels = []
        for c in range(3):
            a = "[" + ", ".join(f"{float(x)}::DOUBLE" for x in color.SPECTRAL[:, c]) + "]"
            i = "least(floor(t * 10), 9)::INT"
            channels.append(f"(t * 10 - {i}) * ({a}[{i} + 2] - {a}[{i} + 1]) + {a}[{i} + 1]")
    out = ", ".join(f"floor({v} + 0.5)::INT AS {k}" for k, v in zip("rgb", channels))
    return f"WITH {_DEPTH_SQL}, t AS (SELECT image_id, unnest(range(0, len(v))) AS i, (unnest(v)::DOUBLE - list_min(v)::DOUBLE) / (list_max(v)::DOUBLE - list_min(v)::DOUBLE) AS t FROM ok) SELECT image_id, i::INT AS i, {out} FROM t"


def _depth_colors(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = A.depth_planes(spark, d).select("image_id", V.valid_depth(F.col("depth")).alias("v")).withColumn("lo", F.array_min("v").cast("double")).withColumn("hi", F.array_max("v").cast("double"))
        px = p.select("image_id", "lo", "hi", F.posexplode("v").alias("i", "x"))
        c = color.sample((F.col("x").cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo")), name)
        return px.withColumn("c", c).select("image_id", "i", "c.r", "c.g", "c.b")

    return run


for _name in color.COLORMAPS:
    QUERIES[f"depth_colorize_{_name}"] = _depth_colors(_name)
    ORACLES[f"depth_colorize_{_name}"] = _colormap_sql(_name)

_RESIZE_SQL = """px AS (SELECT vec_id AS image_id, unnest(range(0, 64)) AS i, greatest(unnest(embedding), 0::FLOAT) AS v FROM embeddings),
ax AS (SELECT d, a, least(floor(a)::INT, 7) AS i0, least(least(floor(a)::INT, 7) + 1, 7) AS i1 FROM (SELECT d, greatest((d + 0.5) * (8 / 12) - 0.5, 0) AS a FROM (SELECT unnest(range(0, 12)) AS d))),
grid AS (SELECT y.d AS dy, x.d AS dx, y.i0 AS y0, y.i1 AS y1, y.a - y.i0 AS fy, x.i0 AS x0, x.i1 AS x1, x.a - x.i0 AS fx FROM ax y, ax x),
out AS (SELECT image_id, dy, dx, sum(v * CASE WHEN i = y0 * 8 + x0 THEN (1 - fy) * (1 - fx) ELSE 0 END + v * CASE WHEN i = y0 * 8 + x1 THEN (1 - fy) * fx ELSE 0 END
  + v * CASE WHEN i = y1 * 8 + x0 THEN fy * (1 - fx) ELSE 0 END + v * CASE WHEN i = y1 * 8 + x1 THEN fy * fx ELSE 0 END) AS v
  FROM px JOIN grid ON i IN (y0 * 8 + x0, y0 * 8 + x1, y1 * 8 + x0, y1 * 8 + x1) GROUP BY ALL)"""


@query(f"WITH {_RESIZE_SQL} SELECT image_id, count(*)::INT AS pixels, {rs('avg(v)', 3)} AS mean, {rs('max(v)', 3)} AS top FROM out GROUP BY image_id")
def depth_resize(spark: SparkSession, d: str) -> DataFrame:
    @F.arrow_udf("binary")
    def floats(v):
        import numpy as np
        import pyarrow as pa

        return pa.array([np.asarray(x, "<f4").tobytes() for x in v.to_pylist()], pa.binary())

    p = A.depth_planes(spark, d).select("image_id", floats("depth").alias("data"))
    out = p.select("image_id", planes.plane_values(planes.resized_depth(F.col("data"), F.lit(8), F.lit(8), F.lit(12), F.lit(12))).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return out.select("image_id", F.size("v").alias("pixels"), r(mean, 3).alias("mean"), r(F.array_max("v"), 3).alias("top"))


@query(
    f"WITH {_RESIZE_SQL.replace('greatest(unnest(embedding), 0::FLOAT)', 'unnest(embedding)')}, wide AS (SELECT image_id // 4 AS scene, image_id % 4 AS cls, dy, dx, v FROM out), "
    "win AS (SELECT scene, cls FROM (SELECT *, row_number() OVER (PARTITION BY scene, dy, dx ORDER BY v DESC, cls) AS k FROM wide) WHERE k = 1) SELECT scene AS image_id, cls::INT AS cls, count(*) AS pixels FROM win GROUP BY ALL"
)
def semantic_resize(spark: SparkSession, d: str) -> DataFrame:
    @F.arrow_udf("binary")
    def floats(v):
        import numpy as np
        import pyarrow as pa

        return pa.array([np.asarray(x, "<f4").tobytes() for x in v.to_pylist()], pa.binary())

    p = A.class_planes(spark, d).select("image_id", F.size("planes").alias("n"), floats(F.flatten("planes")).alias("data"))
    m = planes.semantic_map(F.col("data"), F.col("n"), F.lit(8), F.lit(8), F.lit(12), F.lit(12))
    return p.select("image_id", F.explode(planes.plane_values(m, "<u2")).alias("c")).groupBy("image_id", F.col("c").cast("int").alias("cls")).agg(F.count("*").alias("pixels"))


# colors, sources, text ----

_HEX = "[" + ", ".join(f"'#{bytes(c).hex().upper()}'" for c in color.COLORS) + "]"


@query(f"SELECT p_partkey AS class_id, {_HEX}[1 + p_partkey % 20] AS hex FROM part")
def class_color_hex(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("class_id"), color.hex_color(F.col("p_partkey")).alias("hex"))


@query("SELECT p_partkey AS class_id, CASE WHEN 0.299::DOUBLE * (p_partkey * 7 % 256) + 0.587::DOUBLE * (p_partkey * 13 % 256) + 0.114::DOUBLE * (p_partkey * 29 % 256) > 150 THEN 'black' ELSE 'white' END AS ink FROM part")
def text_contrast(spark: SparkSession, d: str) -> DataFrame:
    ch = lambda m: F.pmod(F.col("p_partkey") * m, F.lit(256))
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("class_id"), color.text_color(ch(7), ch(13), ch(29)).alias("ink"))


_IMG = "regexp_matches(split_part(lower(uri), '?', 1), '[^/]\\.(" + "|".join(text.IMAGE_SUFFIXES) + ")$')"


@query(f"WITH {A.URIS_SQL} SELECT page_id, {_IMG} AS is_image FROM uris")
def image_url_flag(spark: SparkSession, d: str) -> DataFrame:
    return A.uris(spark, d).select("page_id", text.is_image_url(F.col("uri")).alias("is_image"))


@query(
    f"""WITH {A.URIS_SQL} SELECT page_id, CASE WHEN regexp_full_match(uri, '[0-9]+') THEN 'webcam' WHEN regexp_matches(uri, '^https?://') AND {_IMG} THEN 'image_url'
WHEN regexp_matches(uri, '^(https?|rtsp|rtmp)://') THEN 'stream' WHEN contains(uri, '*') THEN 'glob' WHEN regexp_matches(lower(uri), '\\.({"|".join(text.VIDEO_SUFFIXES)})$') THEN 'video' ELSE 'image' END AS kind FROM uris"""
)
def source_kind(spark: SparkSession, d: str) -> DataFrame:
    return A.uris(spark, d).select("page_id", text.source_kind(F.col("uri")).alias("kind"))


@query(
    f"""WITH {A.URIS_SQL}, k AS (SELECT page_id, CASE WHEN regexp_full_match(uri, '[0-9]+') THEN 'webcam' WHEN regexp_matches(uri, '^https?://') AND {_IMG} THEN 'image_url'
WHEN regexp_matches(uri, '^(https?|rtsp|rtmp)://') THEN 'stream' WHEN contains(uri, '*') THEN 'glob' WHEN regexp_matches(lower(uri), '\\.({"|".join(text.VIDEO_SUFFIXES)})$') THEN 'video' ELSE 'image' END AS kind FROM uris)
SELECT page_id, kind IN ('image', 'image_url') AS is_image, kind IN ('video', 'webcam', 'stream') AS is_video, kind = 'glob' AS is_batch FROM k"""
)
def kind_flags(spark: SparkSession, d: str) -> DataFrame:
    kind = text.source_kind(F.col("uri"))
    return A.uris(spark, d).select("page_id", text.is_image_kind(kind).alias("is_image"), text.is_video_kind(kind).alias("is_video"), text.is_batch_kind(kind).alias("is_batch"))


@query(
    f"""WITH {A.FRAMES_SQL} SELECT event_id, CASE WHEN total_frames = 1 THEN split_part(path[7:], '.', 1) ELSE printf('%s_%06d', split_part(path[7:], '.', 1), frame_idx) END AS stem,
printf('%s_frames/%s_%d.jpg', split_part(path[7:], '.', 1), split_part(path[7:], '.', 1), frame_idx + 1) AS frame FROM frames"""
)
def output_stem(spark: SparkSession, d: str) -> DataFrame:
    f = A.frames(spark, d)
    return f.select("event_id", text.output_stem(F.col("path"), F.col("frame_idx"), F.col("total_frames")).alias("stem"), text.frame_name(F.col("path"), F.col("frame_idx")).alias("frame"))


@query(f"WITH {A.FRAMES_SQL} SELECT event_id, path, frame_idx // 8 AS batch, (frame_idx % 8)::BIGINT AS slot FROM frames")
def batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    f = A.frames(spark, d)
    return f.select("event_id", "path", F.floor(F.col("frame_idx") / 8).cast("long").alias("batch"), F.pmod("frame_idx", F.lit(8)).cast("long").alias("slot"))


@query(f"SELECT {rs('avg(value)', 4)} AS preprocess, {rs('avg(value * 2)', 4)} AS forward, 0.0::DOUBLE AS postprocess FROM events")
def speed_means(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").select(F.col("value").alias("preprocess"), (F.col("value") * 2).alias("forward"), F.lit(None).cast("double").alias("postprocess"))
    return results.speed_report(e).select(r("preprocess", 4).alias("preprocess"), r("forward", 4).alias("forward"), "postprocess")


@query("SELECT DISTINCT lower(p_brand) || s || v || '.onnx' AS model, s AS size, CASE v WHEN '' THEN 'detect' ELSE v[2:] END AS variant FROM part, (VALUES ('n'), ('s'), ('m'), ('l'), ('x')) AS a(s), (VALUES (''), ('-seg'), ('-pose'), ('-obb'), ('-cls'), ('-sem'), ('-depth')) AS b(v) WHERE v NOT IN ('-sem', '-depth') OR p_brand = (SELECT max(p_brand) FROM part)")
def model_catalog(spark: SparkSession, d: str) -> DataFrame:
    from ocellus.sources.models import catalog

    families = A.read(spark, d, "part").select(F.lower("p_brand").alias("family")).distinct()
    return catalog(families, families.agg(F.max("family").alias("newest")))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'm/' || o_orderkey || '.onnx' WHEN 1 THEN 'm/' || o_orderkey || '.onnx' ELSE 'm/' || o_orderkey || '.pt' END AS model FROM orders")
def model_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("o_orderkey", F.lit(3))
    given = F.concat(F.lit("m/"), F.col("o_orderkey").cast("string"), F.when(k == 0, "").when(k == 1, ".ONNX").otherwise(".pt"))
    return A.read(spark, d, "orders").select("o_orderkey", text.model_file(given).alias("model"))


@query(
    """SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.1fGB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.1fMB', b / 1048576) WHEN b >= 1024 THEN printf('%.1fKB', b / 1024) ELSE printf('%.0fB', b) END AS bytes,
CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN floor(s / 60)::INT || ':' || printf('%04.1f', s % 60) ELSE floor(s / 3600)::INT || ':' || printf('%02d', floor(s % 3600 / 60)::INT) || ':' || printf('%04.1f', s % 60) END AS took
FROM (SELECT o_orderkey, (o_orderkey::DOUBLE * o_orderkey * 37.3) AS b, (o_orderkey * 3)::DOUBLE AS s FROM orders)"""
)
def progress_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return A.read(spark, d, "orders").select("o_orderkey", text.format_bytes(k.cast("double") * k * 37.3).alias("bytes"), text.format_time(k * 3).alias("took"))


@query(
    f"WITH RECURSIVE {DETECT_HIGH}, {A.NAMES_SQL}, rows_ AS (SELECT image_id, det_rank, {_HEX}[1 + cls % 20] AS color, printf(' %s %.2f ', coalesce(name, 'class'), conf::DOUBLE) AS label FROM clipped LEFT JOIN names ON class_id = cls) SELECT * FROM rows_"
)
def draw_labels(spark: SparkSession, d: str) -> DataFrame:
    named = results.with_names(_dets(spark, d, PAIRS), A.names(spark, d), "class")
    return named.select("image_id", "det_rank", color.hex_color(F.col("cls")).alias("color"), F.format_string(" %s %.2f ", "name", F.col("conf").cast("double")).alias("label"))


@query(
    f"WITH RECURSIVE {DETECT_HIGH}, {A.NAMES_SQL} SELECT image_id, '[' || string_agg('{{\"name\":\"' || coalesce(name, '') || '\",\"class\":' || cls || ',\"rank\":' || det_rank || '}}', ',' ORDER BY det_rank) || ']' AS payload FROM clipped LEFT JOIN names ON class_id = cls GROUP BY image_id"
)
def json_payload(spark: SparkSession, d: str) -> DataFrame:
    named = results.with_names(_dets(spark, d, PAIRS), A.names(spark, d), "")
    return sinks.ranked_payload(named, "payload", **{"name": F.col("name"), "class": F.col("cls"), "rank": F.col("det_rank")})


@query(f"WITH RECURSIVE {DETECT_HIGH} SELECT {BOX_OUT} FROM clipped")
def frame_stream(spark: SparkSession, d: str) -> DataFrame:
    from ocellus.streaming.frames import replay

    return _boxes(replay(A.head(spark, d), PAIRS))
