"""Operator 7: personal data by weak supervision.

Broad patterns propose candidate spans of six kinds. Four labelers vote on each, for (1), against (-1) or not (0):
a strict regex, a check of the content (checksums, ranges), a gazetteer (top-level domains, country codes, issuers) and
the words in front. Votes of all candidates are counted by (kind, votes), and expectation-maximisation on these counts
estimates each labeler's reliabilities and how common true spans are, kind by kind. The posteriors are the soft labels
of a logistic classifier over the span's shape, its context and the votes; it is fitted on a bounded sample of candidates
(SAMPLE: of each kind and votes, as many as fit, those with the smallest hashes) and decides every span.

A span's context is the words in front of it: the last CONTEXT_WORDS of the CONTEXT_CHARS characters before. Nothing
else of a text is out of sight: patterns run over whole texts, in time that is linear in their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import columns, cut, fresh, key_filter, lean, prepare, release

KINDS = ("EMAIL", "IBAN", "IP", "PHONE", "SSN", "CARD")
LABELERS = ("regex", "content", "gazetteer", "context")
SAMPLE = 20_000
BITS = 12
CONTEXT_CHARS, CONTEXT_WORDS = 60, 4
ROUNDS = 60

#: What an address may hold before its @. It begins where such a run does, so a run is read once, however long.
_LOCAL = r"[^\s@<>()\[\],;:\"']"
_CANDIDATE = re.compile(
    rf"(?P<EMAIL>(?<!{_LOCAL}){_LOCAL}++@[^\s@<>()\[\],;:\"'!?*#%&$]++)"
    r"|(?P<IBAN>\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b)"
    r"|(?P<IP>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<PHONE>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|(?<!\d)\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{1,4}){2,6}(?!\d)"
    r"|(?<![\d+.])0\d(?:[ .]\d{2}){4}(?!\d)|(?<![\d+.])0\d{2,4}[ /-]\d{5,8}(?!\d))"
    r"|(?P<SSN>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<CARD>(?<!\d)(?:\d{13,19}|\d{4}([ -])(?:\d{4}\7\d{4}\7\d{1,7}|\d{6}\7\d{5}))(?!\d))",
    re.ASCII,
)
_STRICT = {
    "EMAIL": re.compile(r"[\w.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.ASCII),
    "IBAN": re.compile(r"[A-Z]{2}\d{2}[0-9A-Z ]{11,}", re.ASCII),
    "IP": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|$)){4}", re.ASCII),
    "PHONE": re.compile(r"\+\d[\d ().-]+|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|0\d(?:[ .]\d{2}){4}|0\d{2,4}[ /-]\d{5,8}", re.ASCII),
    "SSN": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", re.ASCII),
    "CARD": re.compile(r"(?:4\d{12}(?:\d{3})?(?:\d{3})?|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|6(?:011|5\d\d)\d{12})", re.ASCII),
}
_TLDS = frozenset("com org net edu gov mil int info biz io ai co app dev eu uk de fr es it nl be ch at pl pt se no dk fi ie us ca mx br ar cl au nz jp cn kr in ru za".split())
_COUNTRY = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
_IBAN_LANDS = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
_FOR = {
    "EMAIL": {"email", "mail", "contact", "write", "courriel", "correo", "kontakt"},
    "IBAN": {"iban", "account", "konto", "compte", "cuenta"},
    "IP": {"ip", "address", "host", "server", "adresse"},
    "PHONE": {"phone", "call", "tel", "mobile", "fax", "telefon", "appelez", "llame"},
    "SSN": {"ssn", "social", "security"},
    "CARD": {"card", "visa", "credit", "karte", "carte", "tarjeta", "mastercard"},
}
_AGAINST = {"version", "v", "isbn", "doi", "sha", "build", "release", "section", "figure", "page", "order", "invoice", "ticket"}
_BEFORE = re.compile(r"\w+", re.ASCII)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, span) of each candidate, left to right and apart from each other; places in characters."""
    for m in _CANDIDATE.finditer(text):
        span = m[0].rstrip(".-") if m.lastgroup == "EMAIL" else m[0]
        kind = next(k for k in KINDS if m.start(k) >= 0)
        yield m.start(), m.start() + len(span), kind, span


def votes(kind: str, span: str, before: list[str]) -> tuple[int, ...]:
    """The labelers' votes; before: the last lower-cased words in front of the span."""
    digits = re.sub(r"\D", "", span)
    plain = digits if kind == "CARD" else span
    regex = 1 if _STRICT[kind].fullmatch(plain) else -1
    if kind == "EMAIL":
        local, _, domain = span.partition("@")
        content = 1 if len(local) <= 64 and ".." not in span and "." in domain and domain.rpartition(".")[2].isalpha() else -1
        gazetteer = 1 if domain.rpartition(".")[2].lower() in _TLDS else -1
    elif kind == "IBAN":
        content, gazetteer = (1 if _iban(span) else -1), (1 if span[:2] in _IBAN_LANDS else -1)
    elif kind == "IP":
        parts = span.split(".")
        content = 1 if all(int(p) <= 255 for p in parts) and not any(len(p) > 1 and p[0] == "0" for p in parts) else -1
        gazetteer = -1 if span in ("0.0.0.0", "127.0.0.1", "255.255.255.255", "1.2.3.4") else 1 if int(parts[0]) > 0 else 0
    elif kind == "PHONE":
        content = 1 if (8 if span[0] == "0" else 10) <= len(digits) <= 15 else -1
        gazetteer = 0 if not span.startswith("+") else 1 if digits.startswith(_COUNTRY) else -1
    elif kind == "SSN":
        content, gazetteer = (1 if digits not in ("123456789", "078051120") else -1), 0
    else:
        content = 1 if _luhn(digits) else -1
        gazetteer = 1 if digits[:1] in "3456" and len(digits) in (13, 14, 15, 16, 19) else -1
    context = -1 if before[-1:] and before[-1] in _AGAINST else 1 if _FOR[kind] & set(before) else 0
    return regex, content, gazetteer, context


def pattern_of(v: tuple[int, ...]) -> int:
    """The votes as one number, base 3."""
    out = 0
    for x in v:
        out = 3 * out + x + 1
    return out


def votes_of(pattern: int) -> tuple[int, ...]:
    out = []
    for _ in LABELERS:
        out.append(pattern % 3 - 1)
        pattern //= 3
    return tuple(reversed(out))


def span_features(kind: str, span: str, before: list[str], v: tuple[int, ...]) -> list[int]:
    """Hashed features: the kind's votes, the runs of the span's shape, its first and last characters, the words before."""
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"\d", "0", span)))
    names = [f"{kind}", f"{kind}|s|{shape}", f"{kind}|b|{span[:1]}", f"{kind}|e|{span[-3:].lower()}", f"{kind}|n|{min(len(span), 40) // 4}"]
    names += [f"{kind}|{j}|{x}" for j, x in zip(LABELERS, v)] + [f"{kind}|w|{w}" for w in before[-2:]]
    return [xxhash.xxh64_intdigest(n) >> (64 - BITS) for n in names]


def inspect(text: str) -> Iterator[tuple[int, int, str, int, list[int]]]:
    """(start, end, kind, votes as a number, features) of each candidate of a text."""
    for start, end, kind, span in candidates(text):
        before = [w.lower() for w in _BEFORE.findall(text[max(0, start - CONTEXT_CHARS) : start])[-CONTEXT_WORDS:]]
        v = votes(kind, span, before)
        yield start, end, kind, pattern_of(v), span_features(kind, span, before, v)


def estimate(counts: dict[tuple[str, int], int]) -> dict[tuple[str, int], float]:
    """P(true span) of each (kind, votes), by expectation-maximisation over the counts of all candidates.

    Each labeler's votes are independent given the truth. Priors of a few counts say that labelers are better than chance.
    """
    out: dict[tuple[str, int], float] = {}
    prior = {1: np.array([1.0, 2.0, 5.0]), 0: np.array([5.0, 2.0, 1.0])}  # votes -1, 0, 1
    for kind in sorted({k for k, _ in counts}):
        patterns = sorted(p for k, p in counts if k == kind)
        n = np.array([counts[kind, p] for p in patterns], float)
        v = np.array([votes_of(p) for p in patterns]) + 1
        truth = 1 / (1 + np.exp(-1.5 * (v - 1).sum(axis=1)))
        for _ in range(ROUNDS):
            share = ((n * truth).sum() + 2) / (n.sum() + 3)
            score = np.full(len(n), np.log(share) - np.log1p(-share))
            for j in range(v.shape[1]):
                p = {}
                for y, weight in ((1, n * truth), (0, n * (1 - truth))):
                    c = np.bincount(v[:, j], weights=weight, minlength=3) + prior[y]
                    p[y] = c / c.sum()
                score += np.log(p[1][v[:, j]]) - np.log(p[0][v[:, j]])
            truth = 1 / (1 + np.exp(-score))
        out |= {(kind, p): float(t) for p, t in zip(patterns, truth)}
    return out


def fit(features: list[list[int]], soft: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of the logistic span classifier; the last is the bias. weight: what each span counts."""
    w = np.zeros((1 << BITS) + 1)
    if not len(features):
        return w
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.concatenate([np.array(f, np.int64) for f in features])
    share = np.full(len(features), 1 / len(features)) if weight is None else weight / weight.sum()
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 201):
        z = np.bincount(row, weights=w[col], minlength=len(features)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - soft) * share
        g = 1e-5 * w
        g[:-1] += np.bincount(col, weights=d[row], minlength=len(w) - 1)
        g[-1] += d.sum()
        m = 0.9 * m + 0.1 * g
        s = 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return w


def probabilities(w: np.ndarray, features: pa.Array) -> np.ndarray:
    """P(true span) of each list of features; no list is empty."""
    if not len(features):
        return np.zeros(0)
    count = features.value_lengths().to_numpy()
    z = np.add.reduceat(w[features.flatten().to_numpy()], np.cumsum(count) - count) + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """(row, text) of the documents that may hold a candidate: those with a digit or an @."""
    raw, off = K.text_buffer(batch.column("text"))
    may = np.zeros(256, bool)
    may[48:58] = may[64] = True
    for i, j in K.slices(off):
        some = K.segment_sum(may[raw[off[i] : off[j]]], off[i : j + 1] - off[i]) > 0
        for k in np.flatnonzero(some) + i:
            yield int(k), raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "end", "kind", "votes", "features"]
    for batch in batches:
        rows = [(k, *found) for k, text in _documents(batch) for found in inspect(text)]
        if rows:
            at, start, end, kind, v, f = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind), pa.array(v, pa.int32()), pa.array(f, pa.list_(pa.int32()))], names)


def propose(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, votes, features) of every candidate span of docs."""
    prepare(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    return plain.mapInArrow(lean(_propose), "doc_id long, start int, end int, kind string, votes int, features array<int>")


def train(spans: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights: reliabilities from the votes on all spans, weights from at most `sample` of them.

    Of every kind and votes the same number is taken, or all, but one at least, whatever sample is. Within a kind the true
    shares of the votes are restored by weights. A kind counts as much as it has spans in the sample: its features are its
    own, and by its true share a rare one would be too light against the regulariser.
    """
    counts = {(r["kind"], r["votes"]): r["n"] for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    truth = estimate(counts)
    rows = spans.select("kind", "votes", "features", "doc_id", "start", F.xxhash64("doc_id", "start", "kind", "votes").alias("h"))
    order = "h", "doc_id", "start", "features"
    if sum(counts.values()) > sample:
        most = max([1, *(q for q in range(1, sample + 1) if sum(min(n, q) for n in counts.values()) <= sample)])
        for part in (F.pmod("h", F.lit(64)),), ():  # in parts first, so that no task sorts all of a hot kind
            rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("kind", "votes", *part).orderBy(*order))).filter(F.col("n") <= most)
    taken = rows.orderBy(*order).select("kind", "votes", "features").collect()
    group = [(r["kind"], r["votes"]) for r in taken]
    of_group, of_kind, all_of_kind = Counter(group), Counter(k for k, _ in group), Counter()
    for (kind, _), n in counts.items():
        all_of_kind[kind] += n
    weight = np.array([counts[g] / of_group[g] * of_kind[g[0]] / all_of_kind[g[0]] for g in group])
    return fit([r["features"] for r in taken], np.array([truth[g] for g in group]), weight)


def find_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, start, end, kind, probability) of each span that the classifier takes for personal data (>= 1/2).

    start and end count characters of the text. Uses doc_id and text alone. Defined cases: a null or empty text has no
    spans; null doc_ids and repeated rows are inspected as they come; spans of one row do not overlap; without any
    candidate, or on an empty table, there are no rows; texts are inspected whole, at any length.
    """
    spans = cut(propose(docs))
    weights = spans.sparkSession.sparkContext.broadcast(train(spans, sample))

    @F.arrow_udf("double")
    def judge(features: pa.Array) -> pa.Array:
        return pa.array(probabilities(weights.value, features))

    return spans.withColumn("probability", judge("features")).filter("probability >= 0.5").select("doc_id", "start", "end", "kind", "probability")


def masked(text: Column, key: Column, asked, weights) -> Column:
    """The text with every span of personal data replaced by its kind in brackets, where the filter holds the key.

    asked: a broadcast KeyFilter; weights: a broadcast of train(). Both are looked at here, so that a task needs one Python worker.
    """

    @F.arrow_udf("string")
    def run(column: pa.Array, keys: pa.Array) -> pa.Array:
        mine = np.flatnonzero(asked.value.holds(keys.to_numpy()))
        batch = pa.RecordBatch.from_arrays([column.take(pa.array(mine))], ["text"])
        texts: dict[int, str] = {}
        found: list[tuple[int, int, int, str, int, list[int]]] = []
        for k, whole in _documents(batch):
            own = [(k, *x) for x in inspect(whole)]
            if own:
                texts[k] = whole
                found += own
        if not found:
            return column
        true = probabilities(weights.value, pa.array([x[-1] for x in found], pa.list_(pa.int32()))) >= 0.5
        parts: dict[int, list[str]] = {}
        last: dict[int, int] = {}
        for (k, start, end, kind, _, _), yes in zip(found, true):
            if yes:
                parts.setdefault(k, []).extend((texts[k][last.get(k, 0) : start], f"[{kind}]"))
                last[k] = end
        out = column.to_pylist()
        for k, p in parts.items():
            out[mine[k]] = "".join(p) + texts[k][last[k] :]
        texts.clear()
        found.clear()
        parts.clear()
        new = pa.array(out, pa.string())
        del out, batch
        release()
        return new

    return run(text, key)


def mask_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with the same rows and columns; personal data in text is masked, and n_chars, if there, follows the new text.

    Cases as in find_pii(): rows without personal data are returned as they are, nulls too. Only doc_ids (and rows without
    one) that have a candidate are inspected again; a filter of their hashes tells which.
    """
    spans = cut(propose(docs))
    weights = spans.sparkSession.sparkContext.broadcast(train(spans, sample))
    name = lambda c: F.xxhash64(F.coalesce(c.cast("long"), F.lit(-1)))
    some = key_filter(spans.select(name(F.col("doc_id")).alias("k")).distinct(), "k")
    (new,) = fresh(docs, "masked")
    out = docs.withColumn(new, masked(F.col("text").cast("string"), name(F.col("doc_id")), some, weights))
    changed = ~F.col(new).eqNullSafe(F.col("text"))
    cells = []
    for c, own in zip(docs.columns, columns(docs)):
        if c == "text":
            cells.append(F.col(new).alias("text"))
        elif c == "n_chars":
            cells.append(F.when(changed, F.length(new)).otherwise(own).cast(docs.schema[c].dataType).alias(c))
        else:
            cells.append(own)
    return out.select(cells)
