"""Operator 9: language identification by multinomial naive Bayes over hashed character n-grams.

n-grams of 1 to 3 characters of the lower-cased text are hashed to BUCKETS buckets. The model is a matrix of log
probabilities, one column a language, fitted with add-ALPHA smoothing on a bounded sample (SAMPLE documents of each
label, those with the smallest hashes of doc_id) and broadcast: 4 bytes x BUCKETS x languages. Scoring treats a batch
as a sparse document-by-bucket matrix and sums rows of the matrix over each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import cut, prepare, small

SAMPLE = 1000
BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
ALPHA = 0.1
_SLICE = 1 << 19


def _buckets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each character (BUCKETS where a document ends first), and offsets in characters."""
    raw, offsets = K.lowered(raw, offsets)
    begins = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(begins)])[offsets]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != at[-1]:  # malformed text: characters can't be told apart
        points, at = raw.astype(np.uint32), offsets
    g = np.zeros(len(points), np.uint64)
    for n in ORDERS:
        if n <= len(points):
            g[: len(points) - n + 1] = (g[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[n - 1 :].astype(np.uint64) + np.uint64(n << 32))
        b = ((g * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)
        for k in range(1, n):
            last = at[1:] - k
            b[last[last >= at[:-1]]] = BUCKETS
        yield b, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        raw, off = K.text_buffer(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for i, j in K.slices(off, _SLICE):
            for b, at in _buckets(raw[off[i] : off[j]], off[i : j + 1] - off[i]):
                owner = np.repeat(langs[i:j], np.diff(at))
                for lang in set(langs[i:j]):
                    counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    counts[lang] += np.bincount(b[owner == lang], minlength=BUCKETS + 1)
    for lang, c in counts.items():
        hit = np.flatnonzero(c[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(c[hit])], ["lang", "bucket", "n"])


class Model:
    """Languages, log prior odds are equal; log_p has BUCKETS + 1 rows, the last of zeros."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts.T.astype(np.float64) + ALPHA
        self.log_p = np.zeros((BUCKETS + 1, len(languages)), np.float32)
        if languages:
            self.log_p[:BUCKETS] = np.log(p / p.sum(axis=0))

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each document in each language, and its number of n-grams."""
        docs = len(offsets) - 1
        total, grams = np.zeros((docs, len(self.languages))), np.zeros(docs, np.int64)
        for b, at in _buckets(raw, offsets):
            some = np.flatnonzero(np.diff(at))
            if len(some):
                for k in range(len(self.languages)):
                    total[some, k] += np.add.reduceat(self.log_p[:, k][b], at[some], dtype=np.float64)
                grams += K.segment_sum(b < BUCKETS, at)
        return total, grams


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` documents of each value of lang; null langs and texts are left out."""
    prepare(docs.sparkSession)
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = light.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("doc_id").distinct()
    counted = light.join(small(cut(chosen), 200 * sample), "doc_id").select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(rows.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(lang))
    counts = np.zeros((len(languages), BUCKETS), np.int64)
    number = {x: k for k, x in enumerate(languages)}
    counts[[number[x] for x in lang], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, predicted_lang, probability) for every row of docs; lang is the label that the row came with.

    probability is the posterior under equal priors, with the log-likelihoods divided by the number of orders, as
    orders see the same text. Uses doc_id, text and lang alone. Defined cases: a null or empty text (and any text,
    if no label could be learned from) gets a null predicted_lang and probability 0; ties go to the language that is
    first in the alphabet; null doc_ids and repeated rows are scored as they come; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, off = K.text_buffer(batch.column("text"))
            best, p = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for i, j in K.slices(off, _SLICE):
                total, grams = m.scores(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                if m.languages:
                    k = total.argmax(axis=1)
                    odds = np.exp(np.maximum((total - total.max(axis=1, keepdims=True)) / len(ORDERS), -700))
                    some = grams > 0
                    best[i:j] = np.where(some, k, -1)
                    p[i:j] = np.where(some, 1 / odds.sum(axis=1), 0)
            names = pa.array([None, *m.languages], pa.string()).take(pa.array(best + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), names, pa.array(p)], ["doc_id", "lang", "predicted_lang", "probability"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang string, predicted_lang string, probability double")


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on the labels that docs carries and scores all of docs."""
    return identify(docs, train(docs, sample))
