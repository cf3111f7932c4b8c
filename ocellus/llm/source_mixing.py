"""Operator 6: mixing sources to target weights that vary over training (a curriculum).

A schedule gives every source a weight at each of a few points of training progress u (0 to 1), linear in between
and summing to 1 at every u. Over a horizon of T tokens, source s has by u been asked for
D_s(u) = T * integral of w_s from 0 to u tokens. Its documents, in an order that a hash of doc_id fixes, offer tokens
c, c + n, ...; a document is read when demand reaches its first token, so its position is D_s^-1(c). A source that is
asked for more than it has is read again (epoch 1, 2, ...); what a source offers beyond its demand is not read.
The result is range-sorted by position.

Running token counts are two-level: sums over hash ranges of each source, then a running sum inside each range, so
that no source, however hot, is one sort. There are as many ranges as keep one at about RANGE_ROWS documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import columns, cut, fresh, orderable, prepare

#: (progress, temperature): at each point weights are proportional to (share of tokens) ^ temperature, so training
#: begins with the corpus as it is and moves towards equal weights.
SCHEDULE: tuple[tuple[float, float], ...] = ((0.0, 1.0), (0.4, 0.8), (1.0, 0.5))
RANGE_ROWS = 100_000


def token_count(text: Column) -> Column:
    """Tokens of a text: its words between white space (blanks, tabs, line and page breaks). A null text has none."""

    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        raw, off = K.text_buffer(column)
        parts = [K.token_counts(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in K.slices(off)]
        return pa.chunked_array([pa.array(p) for p in parts], pa.int64()).combine_chunks()

    return run(text)


def demand(totals: DataFrame, schedule: Sequence[tuple[float, float]], horizon: int | None) -> DataFrame:
    """(source, tokens, T, w0.., c0..): each source's weights at the knots and its integrated demand up to them."""
    grand = totals.agg(F.sum("tokens").cast("double").alias("grand"))
    t = F.col("grand") if horizon is None else F.lit(float(horizon))
    rows = totals.crossJoin(grand).withColumn("T", t)
    for k, (_, tau) in enumerate(schedule):
        rows = rows.withColumn(f"r{k}", F.pow(F.col("tokens") / F.col("grand"), F.lit(float(tau))))
    norms = rows.agg(*(F.sum(f"r{k}").alias(f"z{k}") for k in range(len(schedule))))
    rows = rows.crossJoin(norms)
    for k in range(len(schedule)):
        rows = rows.withColumn(f"w{k}", F.col(f"r{k}") / F.col(f"z{k}"))
    rows = rows.withColumn("c0", F.lit(0.0))
    for k in range(1, len(schedule)):
        h = float(schedule[k][0]) - float(schedule[k - 1][0])
        rows = rows.withColumn(f"c{k}", F.col(f"c{k - 1}") + F.col("T") * h * (F.col(f"w{k - 1}") + F.col(f"w{k}")) / 2)
    return rows.select("source", "tokens", "T", *(f"{x}{k}" for x in "wc" for k in range(len(schedule))))


def inverse(c: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The progress at which a source's integrated demand reaches c: a quadratic in each piece of the schedule."""
    out = F.lit(None).cast("double")
    for k in reversed(range(len(schedule) - 1)):
        u0, h = float(schedule[k][0]), float(schedule[k + 1][0]) - float(schedule[k][0])
        r = (c - F.col(f"c{k}")) / F.col("T")
        w, slope = F.col(f"w{k}"), (F.col(f"w{k + 1}") - F.col(f"w{k}")) / h
        x = F.when(r <= 0, F.lit(0.0)).otherwise(2 * r / (w + F.sqrt(F.greatest(w * w + 2 * slope * r, F.lit(0.0)))))
        out = F.when(c < F.col(f"c{k + 1}"), u0 + F.least(x, F.lit(h))).otherwise(out)
    return out


def positions(docs: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, horizon: int | None = None) -> DataFrame:
    """(doc_id, k, source, n_tokens, epoch, progress), unsorted: each reading of each document; k names the row's number and text."""
    prepare(docs.sparkSession)
    number, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    name = F.md5(F.coalesce(number.cast("string"), text, F.lit("")))
    base = docs.select(number.alias("doc_id"), F.xxhash64(number, text).alias("k"), F.col("source").cast("string").alias("source"), token_count(text).alias("n_tokens"), name.alias("h"))
    base = cut(base.filter("n_tokens > 0"))
    digits, room = 1, 16 * RANGE_ROWS
    while room < base.count():
        digits, room = digits + 1, room * 16
    base = base.withColumn("b", F.substring("h", 1, digits))
    ranges = base.groupBy("source", "b").agg(F.sum("n_tokens").alias("tokens"))
    w = Window.partitionBy("source").orderBy("b")
    before = ranges.withColumn("before", F.sum("tokens").over(w) - F.col("tokens")).select(F.col("source").alias("s"), F.col("b").alias("rb"), "before")
    wanted = demand(ranges.groupBy("source").agg(F.sum("tokens").alias("tokens")), schedule, horizon).withColumnRenamed("source", "ds")
    params = before.join(wanted, F.col("s").eqNullSafe(F.col("ds"))).drop("ds")
    rows = base.join(params, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("rb"))).drop("s", "rb")
    inside = Window.partitionBy("source", "b").orderBy("h", "doc_id", "n_tokens", "k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    last = F.col(f"c{len(schedule) - 1}")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(last / F.col("tokens")).cast("int") - 1, F.lit(0)))))
    rows = rows.withColumn("c", (F.col("epoch") * F.col("tokens") + F.col("first")).cast("double")).filter(F.col("c") < last)
    return rows.select("doc_id", "k", "source", "n_tokens", "epoch", inverse(F.col("c"), schedule).alias("progress"))


def mix_sources(docs: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, horizon: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, progress), range-sorted by progress: the order in which documents are read.

    horizon: tokens to read; None reads as many as docs has. Uses doc_id, source and text alone. Defined cases: a null,
    empty or blank text has no tokens and no position; a null source is a source of its own; a row without
    doc_id takes its place by the hash of its text; repeated rows are read each; equal positions are ordered by source,
    epoch and doc_id; an empty table gives no rows; texts are counted whole, at any length. progress is rounded to 6 places
    for display; rows are sorted by the value before that.
    """
    rows = positions(docs, schedule, horizon)
    return rows.orderBy("progress", "source", "epoch", "doc_id").select("doc_id", "source", "n_tokens", "epoch", F.round("progress", 6).alias("progress"))


def mixed_documents(docs: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, horizon: int | None = None) -> DataFrame:
    """The rows of docs, all columns, as often as they are read and in that order; cases as in mix_sources().

    Rows that agree in doc_id and text are read as often as their positions say together: in the order of their columns
    they take the positions in turn.
    """
    rows = positions(docs, schedule, horizon)
    p_k, p_at, p_n, k, copy = fresh(docs, "told", "at", "copies", "key", "copy")
    # a row's readings travel as one list; rows that cannot be told apart deal the list out among themselves
    reads = rows.groupBy("k").agg(F.sort_array(F.collect_list("progress")).alias(p_at)).select(F.col("k").alias(p_k), p_at)
    keyed = docs.withColumn(k, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    joined = keyed.join(reads, F.col(k) == F.col(p_k))
    same = Window.partitionBy(k)
    joined = joined.withColumn(copy, F.row_number().over(same.orderBy(*orderable(docs)))).withColumn(p_n, F.count(F.lit(1)).over(same))
    own = F.filter(F.col(p_at), lambda x, i: F.pmod(i, F.col(p_n)) == F.col(copy) - 1)
    joined = joined.withColumn(p_at, F.explode(own))
    return joined.orderBy(p_at, "source", "doc_id").select(columns(docs))


def mixing_ctes(source: str, schedule: Sequence[tuple[float, float]] = SCHEDULE) -> str:
    """SQL common table expressions that end in mixed(doc_id, source, n_tokens, epoch, progress)."""
    n = len(schedule)
    raw = ", ".join(f"pow(tokens / sum(tokens) OVER (), {float(tau)}) AS r{k}" for k, (_, tau) in enumerate(schedule))
    norm = ", ".join(f"r{k} / sum(r{k}) OVER () AS w{k}" for k in range(n))
    cums = ["0.0::DOUBLE AS c0"]
    for k in range(1, n):
        terms = " + ".join(f"T * {float(schedule[i][0]) - float(schedule[i - 1][0])!r}::DOUBLE * (w{i - 1} + w{i}) / 2" for i in range(1, k + 1))
        cums.append(f"{terms} AS c{k}")
    whens = []
    for k in range(n - 1):
        u0, h = float(schedule[k][0]), float(schedule[k + 1][0]) - float(schedule[k][0])
        r = f"((c - c{k}) / T)"
        x = f"CASE WHEN {r} <= 0 THEN 0.0 ELSE 2 * {r} / (w{k} + sqrt(greatest(w{k} * w{k} + 2 * ((w{k + 1} - w{k}) / {h!r}::DOUBLE) * {r}, 0.0))) END"
        whens.append(f"WHEN c < c{k + 1} THEN {u0!r}::DOUBLE + least({x}, {h!r}::DOUBLE)")
    return f"""
tok AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS n_tokens FROM {source}),
tokd AS (SELECT *, md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM tok WHERE n_tokens > 0),
tot AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens FROM tokd GROUP BY source),
r AS (SELECT *, sum(tokens) OVER () AS T, {raw} FROM tot),
w AS (SELECT *, {norm} FROM r),
dem AS (SELECT *, {", ".join(cums)} FROM w),
cum AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens)::DOUBLE AS f FROM tokd),
rd AS (
  SELECT cum.doc_id, cum.source, n_tokens, e::INTEGER AS epoch, e * tokens + f AS c, dem.* EXCLUDE (source)
  FROM cum JOIN dem ON cum.source IS NOT DISTINCT FROM dem.source, unnest(range(0, greatest(ceil(c{n - 1} / tokens)::BIGINT, 1))) AS _(e)
),
mixed AS (SELECT doc_id, source, n_tokens, epoch, CASE {" ".join(whens)} END AS progress FROM rd WHERE c < c{n - 1})"""


ORACLE = f"WITH {mixing_ctes('documents')} SELECT doc_id, source, n_tokens, epoch, round(progress, 6) AS progress FROM mixed"
