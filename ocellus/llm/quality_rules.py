"""Operator 4: quality rules with adaptive thresholds.

Four signals a document, in thousandths and smoothed so that short texts stay near 0: signs, capitals, words
repeated at once, digits. Their distribution in each (lang, source) is kept as a mergeable quantile sketch:
counts in buckets of equal ratio (1 part in 32), so that two sketches merge by adding counts.

A signal's limit is read off the quantile function of its (lang, source). Going up from the median, the body of the
documents ends where the function jumps: where less than 1/TAIL of the documents lie up to RATIO times further on. The
limit is the far end of that jump, so what breaks it stands apart from nearly all that its source holds, and is junk
as long as that is less than half. Small groups lean on larger ones: to each sketch the distributions of its language and
of the corpus are added, as PRIOR documents each. Documents above a limit are rejected, after a join with the limits on
(lang, source). No limit and no distance is fixed; the parameters are shares and ratios.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import columns, cut, fresh, prepare, release, small

#: The body of a distribution ends where less than one in TAIL documents lie within RATIO times the value.
TAIL = 200
RATIO = 3.0
#: Documents that the language and the corpus each count as in every sketch.
PRIOR = 200
#: Buckets of a sketch: STEPS to a factor of e, over values from UNIT up.
STEPS, UNIT = 32, 5
WIDTH = int(np.log(RATIO) * STEPS)
BUCKETS = int(np.log((1000 + UNIT) / UNIT) * STEPS) + 1
#: Weights are integers, so that sums do not depend on their order.
_SCALE = 10_000
RULES = ("signs", "capitals", "repeats", "digits")
#: Groups up to which the limits are broadcast; beyond that they are joined by shuffling.
MAX_BROADCAST = 50_000
#: Added to the denominators: characters, letters, words, characters.
SMOOTH = {"signs": 40, "capitals": 60, "repeats": 20, "digits": 120}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[np.frombuffer(b".,;:'\"()-", np.uint8)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN = ~(K.WORD | _SPACE | _PLAIN)
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character
_LETTER = K.WORD & ~_DIGIT & _FIRST


def _signals(column: pa.Array) -> pa.Array:
    raw, off = K.text_buffer(column)
    found: list[np.ndarray] = []
    for i, j in K.slices(off):
        b, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        chars = K.segment_sum(_FIRST[b], o)
        upper = _UPPER[b]
        if len(b) > 1:  # capitals of Latin-1: C3 80 to C3 9E, but for the multiplication sign C3 97
            upper[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        d, h = K.word_hashes(b, o, lower=False)
        words = np.bincount(d, minlength=j - i)
        again = np.zeros(len(d), bool)
        again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        repeats = np.bincount(d[again], minlength=j - i)
        found.append(
            np.stack(
                [
                    1000 * K.segment_sum(_SIGN[b], o) // (chars + SMOOTH["signs"]),
                    1000 * K.segment_sum(upper, o) // (K.segment_sum(_LETTER[b], o) + SMOOTH["capitals"]),
                    1000 * repeats // (words + SMOOTH["repeats"]),
                    1000 * K.segment_sum(_DIGIT[b], o) // (chars + SMOOTH["digits"]),
                    words,
                ]
            )
        )
    all_ = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in all_], [*RULES, "words"])


_TYPE = "struct<" + ",".join(f"{r}:bigint" for r in (*RULES, "words")) + ">"


def signals(text: Column) -> Column:
    """The four signals and the number of words, as one struct. A null text has none of anything."""

    @F.arrow_udf(_TYPE)
    def run(column: pa.Array) -> pa.Array:
        try:
            return _signals(column)
        finally:
            release()

    return run(text)


def bucket(value: Column) -> Column:
    """The sketch bucket of a value of 0 to 1000."""
    return F.floor(F.log((value + UNIT) / F.lit(float(UNIT))) * STEPS).cast("int")


def sketches(docs: DataFrame, s: str) -> DataFrame:
    """(lang, source, cell, n): the sketches of every (lang, source) over documents with words; a cell is a bucket of a rule. s: the signals."""
    cells = F.array(*(F.lit(k * BUCKETS) + bucket(F.col(f"{s}.{r}")) for k, r in enumerate(RULES)))
    stacked = docs.select("lang", "source", F.explode(F.when(F.col(f"{s}.words") > 0, cells)).alias("cell"))
    return stacked.groupBy("lang", "source", "cell").agg(F.count("*").alias("n"))


def body_ends(weight: np.ndarray, occupied: np.ndarray, width: int, tail: int) -> np.ndarray:
    """The limits, as buckets, of sketches (groups, rules, buckets). occupied (rules, buckets): where a body may end."""
    upto = np.cumsum(weight, axis=2)
    total = upto[:, :, -1:]
    far = upto[:, :, np.minimum(np.arange(weight.shape[2]) + width, weight.shape[2] - 1)]
    return (occupied[None] & (2 * upto >= total) & ((far - upto) * tail < total)).argmax(axis=2) + width


def limits(sketch: DataFrame, prior: int = PRIOR, tail: int = TAIL, width: int = WIDTH) -> DataFrame:
    """(lang, source, the highest bucket that passes, a column a rule). sketch: small, and computed already.

    The driver reads the merged sketches of the languages; those of the sources stay with the executors.
    """
    wide = len(RULES) * BUCKETS
    by_lang: dict[str | None, np.ndarray] = {}
    for r in sketch.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        by_lang.setdefault(r["lang"], np.zeros(wide, np.int64))[r["cell"]] = r["n"]
    shape = (len(RULES), BUCKETS)
    share = lambda c: prior * _SCALE * c // max(1, int(c[:BUCKETS].sum()))  # noqa: E731  each document counts once in every rule
    corpus = sum(by_lang.values(), np.zeros(wide, np.int64))
    shared = sketch.sparkSession.sparkContext.broadcast((corpus.reshape(shape) > 0, {k: share(c) + share(corpus) for k, c in by_lang.items()}))

    @F.arrow_udf("struct<" + ",".join(f"{r}:int" for r in RULES) + ">")
    def run(lang: pa.Array, cells: pa.Array) -> pa.Array:
        occupied, priors = shared.value
        out = []
        for a in range(0, len(lang), 256):
            rows, own = lang[a : a + 256], cells[a : a + 256]
            weight = np.stack([priors[x] for x in rows.to_pylist()])
            flat = own.flatten()
            np.add.at(weight, (np.repeat(np.arange(len(rows)), own.value_lengths().to_numpy()), flat.field("cell").to_numpy()), _SCALE * flat.field("n").to_numpy())
            out.append(body_ends(weight.reshape(-1, *shape), occupied, width, tail))
        all_ = np.concatenate(out).astype(np.int32) if out else np.zeros((0, len(RULES)), np.int32)
        return pa.StructArray.from_arrays([pa.array(c) for c in all_.T], list(RULES))

    grouped = sketch.groupBy("lang", "source").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    return grouped.select("lang", "source", run("lang", "cells").alias("v")).select("lang", "source", *(F.col(f"v.{r}").alias(r) for r in RULES))


def judged(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with three more columns, named in names: the signals, the limits, and the array of rules that it breaks."""
    prepare(docs.sparkSession)
    s, v, failed = names
    signed = docs.withColumn(s, signals(F.col("text")))
    cut_ = cut(limits(cut(sketches(signed.select("lang", "source", s), s))))
    lang, source = fresh(signed, "limit_lang", "limit_source")
    cut_ = small(cut_.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*RULES).alias(v)), MAX_BROADCAST)
    joined = signed.join(cut_, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left")
    broken = F.when(F.col(f"{s}.words") == 0, F.array(F.lit("empty"))).otherwise(F.filter(F.array(*(F.when(bucket(F.col(f"{s}.{r}")) > F.col(f"{v}.{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull()))
    return joined.withColumn(failed, broken).drop(lang, source)


def quality_decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, signals, broken, keep): what the rules say of every row of docs.

    Uses doc_id, text, lang and source; other columns are ignored. Defined cases: a null, empty or wordless text
    breaks the rule "empty", and does not enter a sketch; null lang or source are groups of their own; repeated rows
    are judged each, ties with a limit pass; an empty table gives no rows; texts are read whole, at any length. `broken`
    names the rules, joined by commas.
    """
    s, v, failed = names = fresh(docs, "signals", "limits", "broken")
    out = judged(docs.select("doc_id", "text", "lang", "source"), names)
    return out.select("doc_id", "lang", "source", *(F.col(f"{s}.{r}").alias(r) for r in RULES), F.concat_ws(",", failed).alias("broken"), (F.size(failed) == 0).alias("keep"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that break no rule, with all their columns; cases as in quality_decisions()."""
    names = fresh(docs, "signals", "limits", "broken")
    return judged(docs, names).filter(F.size(names[2]) == 0).select(columns(docs))


def _sql_bucket(x: str) -> str:
    return f"floor(ln(({x} + {UNIT}) / {float(UNIT)}) * {STEPS})::INTEGER"


def signals_sql(source: str) -> str:
    """SQL for the signals of a table."""
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    return f"""
  SELECT *, 1000 * length(regexp_replace(t, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}\\t-\\r .,;:''"()-]', '', 'g')) // (length(t) + {SMOOTH["signs"]}) AS signs,
    1000 * length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) // (length(regexp_replace(t, '[^A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) + {SMOOTH["capitals"]}) AS capitals,
    1000 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) // (len(w) + {SMOOTH["repeats"]}) AS repeats,
    1000 * length(regexp_replace(t, '[^0-9]', '', 'g')) // (length(t) + {SMOOTH["digits"]}) AS digits, len(w) AS words
  FROM (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM {source})"""


def decisions_ctes(source: str) -> str:
    """SQL common table expressions that end in `judged`: the table with its signals and `broken`."""
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {_sql_bucket(r)} AS b FROM f WHERE words > 0" for r in RULES)
    wide = ", ".join(f"max(lim) FILTER (rule = '{r}') AS l_{r}" for r in RULES)
    names = ", ".join(f"CASE WHEN words > 0 AND {_sql_bucket(r)} > l_{r} THEN '{r}' END" for r in RULES)
    each = "PARTITION BY lang, source, rule"
    return f"""
f AS ({signals_sql(source)}),
stacked AS ({stacked}),
g AS (SELECT lang, source, rule, b, count(*) AS n FROM stacked GROUP BY ALL),
ln AS (SELECT lang, rule, b, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, rule) AS t FROM g GROUP BY lang, rule, b),
cp AS (SELECT rule, b, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY rule) AS t FROM g GROUP BY rule, b),
m AS (
  SELECT gr.lang, gr.source, cp.rule, cp.b, {_SCALE} * coalesce(g.n, 0) + coalesce({PRIOR * _SCALE} * ln.n // ln.t, 0) + {PRIOR * _SCALE} * cp.n // cp.t AS w
  FROM (SELECT DISTINCT lang, source FROM g) gr CROSS JOIN cp
  LEFT JOIN ln ON ln.lang IS NOT DISTINCT FROM gr.lang AND ln.rule = cp.rule AND ln.b = cp.b
  LEFT JOIN g ON g.lang IS NOT DISTINCT FROM gr.lang AND g.source IS NOT DISTINCT FROM gr.source AND g.rule = cp.rule AND g.b = cp.b
), r AS (
  SELECT *, sum(w) OVER ({each} ORDER BY b) AS upto, sum(w) OVER ({each}) AS total,
    coalesce(sum(w) OVER ({each} ORDER BY b RANGE BETWEEN 1 FOLLOWING AND {WIDTH} FOLLOWING), 0) AS beyond
  FROM m
), lim AS (SELECT lang, source, rule, min(b) + {WIDTH} AS lim FROM r WHERE 2 * upto >= total AND {TAIL} * beyond < total GROUP BY ALL),
picked AS (SELECT lang AS pl, source AS ps, {wide} FROM lim GROUP BY ALL),
judged AS (
  SELECT f.*, CASE WHEN words = 0 THEN 'empty' ELSE concat_ws(',', {names}) END AS broken
  FROM f LEFT JOIN picked ON pl IS NOT DISTINCT FROM lang AND ps IS NOT DISTINCT FROM source
)"""


ORACLE = f"WITH {decisions_ctes('documents')} SELECT doc_id, lang, source, {', '.join(RULES)}, broken, broken = '' AS keep FROM judged"
