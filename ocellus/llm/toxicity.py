"""Operator 2: toxicity by cumulative-link ordinal regression.

A document is the set of its lower-cased words and of their beginnings (4, 5 and 6 bytes), as 64-bit hashes. The
model shares one weight vector w over all grades and has ordered thresholds: P(grade <= k) = sigmoid(theta_k - w.x).
Grades are 0 (not toxic) and, among the toxic, 1 (mild) and 2 (severe); labels that carry only a toxic flag are
graded by the number of different toxic features, above its median or not. The result is the expected grade.

Fitting uses a bounded sample of the labelled documents (SAMPLE of either class, those with the smallest hashes of
doc_id). Features are those that the sample ties to either class (|z| >= min_z, in min_docs documents at least, the
max_features strongest; parameters of the fit, MIN_Z, MIN_DOCS and MAX_FEATURES unless given). They are kept as exact hashes, not as buckets: rare words cannot collide with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, prepare, small, stable_sample

SAMPLE = 4000
MIN_DOCS = 4
MIN_Z = 5.0
MAX_FEATURES = 8192
STARTS = (4, 5, 6)
GRADES = 3
L2 = 2e-4
STEPS = 200


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of words and of their beginnings; repeats are still in."""
    raw, offsets = K.lowered(raw, offsets)
    d, s, e = K.word_spans(raw, offsets)
    c = K.prefix_hashes(raw)
    docs, hashes = [d], [K.span_hash(c, s, e)]
    for n in STARTS:
        long = e - s >= n
        docs.append(d[long])
        hashes.append(K.mix(K.span_hash(c, s[long], s[long] + n) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes)


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = K.text_buffer(batch.column("text"))
        for i, j in K.slices(off):
            d, h = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            order = np.lexsort((h, d))
            d, h = d[order], h[order]
            first = np.ones(len(d), bool)
            first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
            d, h = d[first], h[first]
            at = np.searchsorted(d, np.arange(j - i + 1))
            sets = [h[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), pa.array(sets, pa.binary())], ["toxic", "features"])


class Model:
    """Feature hashes (sorted), one weight each, and the ordered thresholds."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.keys, self.weights, self.thresholds = keys, weights, thresholds
        self.maybe = np.zeros(1 << 18, bool)  # most words are in no feature: told from 18 bits
        self.maybe[(keys >> np.uint64(46)).astype(np.int64)] = True

    def look_up(self, d: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature number), each once."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        may = self.maybe[(h >> np.uint64(46)).astype(np.int64)]
        d, h = d[may], h[may]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        key = np.unique(d[hit] * len(self.keys) + at[hit])
        return key // len(self.keys), key % len(self.keys)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(sets: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, grade: np.ndarray | None = None, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> Model:
    """Fits the model to documents given as sets of hashes. weight: what each document counts. grade: 0, 1, 2, if known."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([8.0, 16.0]))
    if not len(sets) or toxic.all() or not toxic.any():
        return empty
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys, feature = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.bincount(feature, minlength=len(keys))
    k = np.bincount(feature, weights=toxic[doc], minlength=len(keys))
    p = toxic.mean()
    z = (k - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
    strong = np.where(n >= min_docs, np.abs(z), 0.0)
    chosen = np.sort(np.argsort(-strong, kind="stable")[:max_features])
    chosen = chosen[strong[chosen] >= min_z]
    if not len(chosen):
        return empty
    number = np.full(len(keys), -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[feature] >= 0
    doc, feature = doc[keep], number[feature[keep]]
    positive = (z[chosen] > 0)[feature]
    if grade is None:
        evidence = np.bincount(doc[positive], minlength=len(sets))
        middle = np.median(evidence[toxic == 1])
        grade = np.where(toxic == 1, 1 + (evidence > middle), 0)
    size = len(chosen)
    w, theta, gap = np.zeros(size), 0.0, 1.0  # thresholds: theta, theta + exp(gap)
    state = np.zeros(size + 2), np.zeros(size + 2)
    total = weight.sum()
    for step in range(1, STEPS + 1):
        score = np.bincount(doc, weights=w[feature], minlength=len(sets))
        t = np.array([theta, theta + np.exp(gap)])
        below = 1 / (1 + np.exp(np.clip(score[:, None] - t, -40, 40)))  # P(grade <= k)
        edge = np.concatenate([np.zeros((len(sets), 1)), below, np.ones((len(sets), 1))], axis=1)
        slope = edge * (1 - edge)
        row = np.arange(len(sets))
        lower, upper = edge[row, grade], edge[row, grade + 1]
        mass = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = weight * slope[row, grade + 1] / mass / total, weight * slope[row, grade] / mass / total
        d_score = d_upper - d_lower  # of the negative log-likelihood
        g_w = np.bincount(feature, weights=d_score[doc], minlength=size) + L2 * w
        g_t = np.array([-(d_upper[grade == k].sum() - d_lower[grade == k + 1].sum()) for k in range(GRADES - 1)])
        g = np.concatenate([g_w, [g_t.sum(), g_t[1] * np.exp(gap)]])
        state[0][:] = 0.9 * state[0] + 0.1 * g
        state[1][:] = 0.99 * state[1] + 0.01 * g * g
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w -= move[:-2]
        theta, gap = theta - move[-2], gap - move[-1]
    return Model(keys[chosen], w, np.array([theta, theta + np.exp(gap)]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **bounds: float) -> Model:
    """Fits on at most `sample` toxic and as many other labelled documents; their true shares are restored by weights. bounds: of fit()."""
    prepare(docs.sparkSession)
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    share = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = stable_sample(lab.filter("toxic = 1"), "doc_id", sample).union(stable_sample(lab.filter("toxic = 0"), "doc_id", sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    rows = texts.join(small(cut(chosen), 2 * sample), "doc_id").select("toxic", "text").mapInArrow(_hash_sets, "toxic int, features binary").toArrow()
    toxic = rows.column("toxic").to_numpy().astype(np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("features").to_pylist()]
    order = sorted(range(len(sets)), key=lambda i: (toxic[i], sets[i].tobytes()))  # the same in every run
    toxic, sets = toxic[order], [sets[i] for i in order]
    n = np.bincount(toxic, minlength=2)
    weight = np.array([share.get(k, 0) / max(1, n[k]) for k in (0, 1)])[toxic] if len(toxic) else np.zeros(0)
    return fit(sets, toxic, weight, **bounds)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for every row of docs.

    severity is the expected grade (0 to 2), grade the likeliest one, toxic whether p_toxic = P(grade >= 1) >= 1/2.
    Uses doc_id and text alone. Defined cases: a null, empty or wordless text has no features and gets the score of
    such a document; null doc_ids and repeated rows are scored as they come; without usable labels nothing is toxic;
    an empty table gives no rows. Texts of any length are scored whole.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, off = K.text_buffer(batch.column("text"))
            score = np.zeros(batch.num_rows)
            for i, j in K.slices(off):
                d, f = m.look_up(*features(raw[off[i] : off[j]], off[i : j + 1] - off[i]), j - i)
                score[i:j] = np.bincount(d, weights=m.weights[f], minlength=j - i) if len(d) else 0
            over = m.at_least(score)
            p = np.concatenate([np.ones((len(score), 1)), over], axis=1) - np.concatenate([over, np.zeros((len(score), 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= 0.5)],
                ["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on labels and scores all of docs."""
    return score_toxicity(docs, train(docs, labels, sample))
