"""Deterministic stand-ins for model outputs, made from relational tables.

Each adapter exists twice: as a DataFrame and as SQL with the same columns, so that every query can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ocellus.functions import geometry as G

INPUT = 640


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _geometry(df: DataFrame, height, width) -> DataFrame:
    out = df.withColumn("orig_h", height.cast("int")).withColumn("orig_w", width.cast("int"))
    box = G.letterbox(F.col("orig_h"), F.col("orig_w"), INPUT, INPUT)
    return out.withColumn("__g", box).select("*", F.col("__g.scale").alias("scale"), F.col("__g.pad_top").cast("float").alias("pad_top"), F.col("__g.pad_left").cast("float").alias("pad_left")).drop("__g")


_GEOMETRY_SQL = """
geo AS (
  SELECT *, least({n}::FLOAT / orig_h::FLOAT, {n}::FLOAT / orig_w::FLOAT) AS scale FROM raw
), head AS (
  SELECT *, (greatest({n} - greatest(round(orig_h::FLOAT * scale)::INT, 1), 0) // 2)::FLOAT AS pad_top,
    (greatest({n} - greatest(round(orig_w::FLOAT * scale)::INT, 1), 0) // 2)::FLOAT AS pad_left FROM geo
)""".format(n=INPUT)


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection head: a row of lineitem is a prediction in the image of its supplier, with 4 classes, an angle and 4 mask coefficients."""
    t = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    score = lambda k: (F.pmod(F.col("l_extendedprice") * (k + 1), F.lit(1000.0)) / 1000).cast("float")
    out = t.select(
        F.col("l_suppkey").alias("image_id"),
        F.row_number().over(order).cast("long").alias("pred_id"),
        (F.col("l_quantity") * 12).cast("float").alias("cx"),
        F.pmod(F.col("l_partkey") * 37, F.lit(640)).cast("float").alias("cy"),
        (20 + F.col("l_discount") * 1000).cast("float").alias("w"),
        (20 + F.col("l_tax") * 1000).cast("float").alias("h"),
        F.array(*(score(k) for k in range(4))).alias("scores"),
        (F.pmod(F.col("l_partkey"), F.lit(314)) / 100).cast("float").alias("angle"),
        F.array(*((c - 0.5).cast("float") for c in (F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.pmod(F.col("l_partkey"), F.lit(10)) / 10))).alias("coefficients"),
    )
    return _geometry(out, 480 + 240 * F.pmod("image_id", F.lit(3)), 640 + 320 * F.pmod("image_id", F.lit(2)))


HEAD_SQL = (
    """
raw AS (
  SELECT l_suppkey AS image_id,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS pred_id,
    (l_quantity * 12)::FLOAT AS cx, ((l_partkey * 37) % 640)::FLOAT AS cy, (20 + l_discount * 1000)::FLOAT AS w, (20 + l_tax * 1000)::FLOAT AS h,
    ["""
    + ", ".join(f"(((l_extendedprice * {k + 1}) % 1000.0::DOUBLE) / 1000)::FLOAT" for k in range(4))
    + """] AS scores,
    ((l_partkey % 314) / 100)::FLOAT AS angle,
    [(l_quantity / 50 - 0.5)::FLOAT, (l_discount * 10 - 0.5)::FLOAT, (l_tax * 10 - 0.5)::FLOAT, ((l_partkey % 10) / 10 - 0.5)::FLOAT] AS coefficients,
    480 + 240 * (l_suppkey % 3) AS orig_h, 640 + 320 * (l_suppkey % 2) AS orig_w
  FROM lineitem
),"""
    + _GEOMETRY_SQL
)


def pose_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose head: a row of orders is a person in the image of its customer's nation-sized group, with 2 classes and 4 keypoints."""
    t = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    mod = lambda x, n: F.pmod(x, F.lit(n))
    first = (mod(F.col("o_totalprice"), 100.0) / 100).cast("float")
    second = F.when(mod(k, 5) == 0, first).otherwise((mod(F.col("o_totalprice") * 3, 100.0) / 100).cast("float"))
    points = [v for p in range(4) for v in (mod(k * (7 + p), 640).cast("float"), mod(k * (11 + p), 640).cast("float"), (mod(k * (3 + p), 100) / 100).cast("float"))]
    out = t.select(
        F.floor(F.col("o_custkey") / 4).cast("long").alias("image_id"),
        k.alias("pred_id"),
        mod(k * 31, 640).cast("float").alias("cx"),
        mod(k * 17, 640).cast("float").alias("cy"),
        (40 + mod(k, 80)).cast("float").alias("w"),
        (60 + mod(k, 90)).cast("float").alias("h"),
        F.array(first, second).alias("scores"),
        F.array(*points).alias("extra"),
    )
    return _geometry(out, F.lit(480) + 0 * F.col("image_id"), F.lit(640) + 0 * F.col("image_id"))


_POINTS_SQL = ", ".join(f"((o_orderkey * {7 + p}) % 640)::FLOAT, ((o_orderkey * {11 + p}) % 640)::FLOAT, (((o_orderkey * {3 + p}) % 100) / 100)::FLOAT" for p in range(4))
POSE_SQL = (
    f"""
raw AS (
  SELECT o_custkey // 4 AS image_id, o_orderkey AS pred_id, ((o_orderkey * 31) % 640)::FLOAT AS cx, ((o_orderkey * 17) % 640)::FLOAT AS cy,
    (40 + o_orderkey % 80)::FLOAT AS w, (60 + o_orderkey % 90)::FLOAT AS h,
    [((o_totalprice % 100.0::DOUBLE) / 100)::FLOAT,
     CASE WHEN o_orderkey % 5 = 0 THEN ((o_totalprice % 100.0::DOUBLE) / 100)::FLOAT ELSE (((o_totalprice * 3) % 100.0::DOUBLE) / 100)::FLOAT END] AS scores,
    [{_POINTS_SQL}] AS extra, 480 AS orig_h, 640 AS orig_w
  FROM orders
),"""
    + _GEOMETRY_SQL
)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names: the nations, numbered by class."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class_id"), F.lower("n_name").alias("name"))


NAMES_SQL = "names AS (SELECT n_nationkey AS class_id, lower(n_name) AS name FROM nation)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores: an embedding is a vector of 64 logits."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("scores"))


def depth_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth maps of 8 x 8: the embedding's values where they are positive, else no depth."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: F.when(v > 0, v).otherwise(F.lit(0.0).cast("float"))).alias("depth"))


def class_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic logits of 8 x 8: four embeddings in a row are the planes of four classes."""
    e = read(spark, sf_dir, "embeddings")
    grouped = e.groupBy(F.floor(F.col("vec_id") / 4).cast("long").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("p"))
    return grouped.select("image_id", F.transform("p", lambda x: x["embedding"]).alias("planes"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video frames: the events of a user in time order; value is the payload."""
    e = read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    total = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return e.select(F.concat(F.lit("video/"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("path"), (F.row_number().over(order).cast("long") - 1).alias("frame_idx"), total.alias("total_frames"), "event_id", "ts", "event_type", "value")


FRAMES_SQL = """frames AS (
  SELECT 'video/' || user_id || '.mp4' AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
    count(*) OVER (PARTITION BY user_id) AS total_frames, event_id, ts, event_type, value FROM events
)"""


def uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source strings of every kind: a page's URL, or one made from its number."""
    p = read(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")
    made = F.array(F.col("url"), F.concat(F.lit("https://host/a/"), n, F.lit(".JPG?size=1")), F.concat(F.lit("rtsp://cam/"), n), F.concat(F.lit("dir"), n, F.lit("/*.png")), F.concat(F.lit("clips/"), n, F.lit(".MP4")), n, F.concat(F.lit("img/"), n, F.lit(".png")), F.concat(F.lit("http://host/"), n, F.lit(".m3u8")))
    return p.select("page_id", F.get(made, F.pmod("page_id", F.lit(8)).cast("int")).alias("uri"))


URIS_SQL = """uris AS (
  SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'https://host/a/' || page_id || '.JPG?size=1' WHEN 2 THEN 'rtsp://cam/' || page_id
    WHEN 3 THEN 'dir' || page_id || '/*.png' WHEN 4 THEN 'clips/' || page_id || '.MP4' WHEN 5 THEN page_id::VARCHAR
    WHEN 6 THEN 'img/' || page_id || '.png' ELSE 'http://host/' || page_id || '.m3u8' END AS uri FROM pages
)"""
