"""Summaries of results: counts, one-line descriptions, summary rows, lengths, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions import vectors as V
from ocellus.functions.text import counted

NOTHING = "(no detections)"


def with_names(df: DataFrame, names: DataFrame, default: Column | str, cls: str = "cls", out: str = "name") -> DataFrame:
    """df with the name of each class: a left join with (class_id, name); classes without one get the default."""
    fallback = F.lit(default) if isinstance(default, str) else default
    looked = names.select(F.col("class_id").alias("__class"), F.col("name").alias("__name"))
    return df.join(looked, F.col(cls) == F.col("__class"), "left").withColumn(out, F.coalesce("__name", fallback)).drop("__class", "__name")


def class_counts(dets: DataFrame, names: DataFrame) -> DataFrame:
    """(image_id, summary): "2 persons, 1 bus", classes ascending."""
    counts = dets.groupBy("image_id", "cls").agg(F.count("*").alias("n"))
    named = with_names(counts, names, "object")
    parts = F.array_sort(F.collect_list(F.struct("cls", counted(F.col("n"), F.col("name")).alias("text"))))
    return named.groupBy("image_id").agg(parts.alias("p")).select("image_id", F.array_join(F.transform("p", lambda x: x["text"]), ", ").alias("summary"))


def describe(images: DataFrame, dets: DataFrame, names: DataFrame) -> DataFrame:
    """class_counts() for every image, with a fixed text for those without detections."""
    return images.select("image_id").join(class_counts(dets, names), "image_id", "left").withColumn("summary", F.coalesce("summary", F.lit(NOTHING)))


def describe_depth(depth: Column) -> Column:
    ok = V.valid_depth(depth)
    return F.when(F.size(ok) > 0, F.format_string("depth %.2f-%.2fm", F.array_min(ok).cast("double"), F.array_max(ok).cast("double"))).otherwise("depth (no valid pixels)")


def describe_mask(mask: Column, names: Column) -> Column:
    """The names of the classes in a semantic mask; names: map of id to name."""
    shown = F.transform(V.class_ids(mask), lambda c: F.coalesce(F.element_at(names, c), F.lit("unknown")))
    return F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise(NOTHING)


def describe_probs(probs: Column, names: Column) -> Column:
    """The five best classes and their probabilities."""
    parts = F.transform(V.top_k(probs, 5), lambda r: F.format_string("%s %.2f", F.coalesce(F.element_at(names, r["idx"]), F.lit("unknown")), r["p"].cast("double")))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(NOTHING)


def describe_any(semantic: Column, depth: Column, boxes: Column, obb: Column, probs: Column) -> Column:
    """The first of the descriptions that is there, in this order; an empty one counts as none found."""
    text = F.coalesce(semantic, depth, boxes, obb, probs, F.lit(""))
    return F.when(text == "", NOTHING).otherwise(text)


def length(boxes: Column, masks: Column, keypoints: Column, probs: Column, obb: Column) -> Column:
    """How many results there are: of the first array that is there; probabilities count as 1, planes as 0."""
    count = lambda a: F.when(a.isNotNull(), F.size(a))
    return F.coalesce(count(boxes), count(masks), count(keypoints), F.when(probs.isNotNull(), F.when(F.size(probs) > 0, 1).otherwise(0)), count(obb), F.lit(0))


def summary_rows(dets: DataFrame, names: DataFrame, normalize: bool = False) -> DataFrame:
    """(image_id, det_rank, name, class, confidence, box): a row a box; names default to the class number.

    normalize divides by orig_w and orig_h, which dets then has to hold.
    """
    named = with_names(dets, names, F.col("cls").cast("string"))
    w, h = (F.col("orig_w").cast("float"), F.col("orig_h").cast("float")) if normalize else (F.lit(1.0).cast("float"),) * 2
    box = F.struct(*(F.try_divide(F.col(c), s).cast("float").alias(c) for c, s in (("x1", w), ("y1", h), ("x2", w), ("y2", h))))
    return named.select("image_id", "det_rank", "name", F.col("cls").alias("class"), F.col("conf").alias("confidence"), box.alias("box"))


def probs_rows(probs: DataFrame, names: DataFrame) -> DataFrame:
    """(image_id, name, class, confidence): the row of each image that was classified, its best class."""
    best = probs.withColumn("__best", F.get(V.top_k(F.col("probs"), 1), F.lit(0))).filter(F.col("__best").isNotNull())
    named = with_names(best.withColumn("cls", F.col("__best.idx").cast("int")), names, F.col("cls").cast("string"))
    return named.select("image_id", "name", F.col("cls").alias("class"), F.col("__best.p").alias("confidence"))


def speed_report(timings: DataFrame) -> DataFrame:
    """Mean milliseconds of each stage over images; a stage that was not timed counts as 0."""
    stage = lambda c: (F.coalesce(F.sum(c), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(c)
    return timings.agg(stage("preprocess"), stage("forward"), stage("postprocess"))


def speed_total(preprocess: Column, forward: Column, postprocess: Column) -> Column:
    zero = F.lit(0.0)
    return F.coalesce(preprocess, zero) + F.coalesce(forward, zero) + F.coalesce(postprocess, zero)


def verbose_line(number: Column, total: Column, path: Column, height: Column, width: Column, summary: Column, ms: Column) -> Column:
    return F.format_string("image %d/%d %s: %dx%d %s, %.1fms", number, total, path, height, width, summary, ms)
