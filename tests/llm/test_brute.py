"""Operators that SQL cannot express, held against plain versions of themselves that share none of their kernels."""

import random
import re
from collections import Counter
from math import gcd, log

import numpy as np
import pyarrow as pa
import pytest

from ocellus.llm import kernels as K
from ocellus.llm import language_id, license_scan, packing, pii, telephony, toxicity

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# 2 ----


def word_features(text):
    """The hashes of a text's words and of their beginnings, word by word."""
    out = set()
    for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()):
        raw = w.encode()
        whole = np.frombuffer(raw, np.uint8)
        c = K.prefix_hashes(whole)
        out.add(int(K.span_hash(c, np.array([0]), np.array([len(raw)]))[0]))
        for n in toxicity.STARTS:
            if len(raw) >= n:
                out.add(int(K.mix(K.span_hash(c, np.array([0]), np.array([n])) + np.uint64(n))[0]))
    return out


def test_toxicity_query_scored_by_hand(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for r in docs.collect():
        x = sum(weight.get(h, 0.0) for h in word_features(r.text or ""))
        over = [1 / (1 + np.exp(t - x)) for t in model.thresholds]
        p = [1 - over[0], over[0] - over[1], over[1]]
        own = got[r.doc_id]
        assert abs(own.severity - sum(over)) < 1e-9 and abs(own.p_toxic - over[0]) < 1e-9
        assert own.toxic == (over[0] >= 0.5) and (own.grade == int(np.argmax(p)) or max(p) - sorted(p)[1] < 1e-9)


def test_toxicity_fit_follows_the_likelihood(monkeypatch):
    """Steps taken with gradients of the likelihood that are measured, not derived."""
    rng = np.random.default_rng(2)
    grade = rng.integers(0, 3, 60)
    sets = [np.array(sorted({int(x) for x in rng.integers(100, 130, 4)} | set(range(1, 1 + 3 * g))), np.uint64) for g in grade]
    weight = rng.random(60) + 0.5
    monkeypatch.setattr(toxicity, "STEPS", 4)
    model = toxicity.fit(sets, (grade > 0).astype(int), weight, grade, min_z=1.0)
    column = {int(k): j for j, k in enumerate(model.keys)}
    has = np.zeros((60, len(column)))
    for i, s in enumerate(sets):
        for k in s.tolist():
            if k in column:
                has[i, column[k]] = 1

    def loss(v):
        w, t0 = v[:-2], v[-2]
        t = [-np.inf, t0, t0 + np.exp(v[-1]), np.inf]
        x = has @ w
        p = [1 / (1 + np.exp(x[i] - t[g + 1])) - 1 / (1 + np.exp(x[i] - t[g])) for i, g in enumerate(grade)]
        return -(weight * np.log(p)).sum() / weight.sum() + toxicity.L2 * (w * w).sum() / 2

    v = np.zeros(len(column) + 2)
    v[-1] = 1.0
    m, s = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, 5):
        g = np.array([(loss(v + e) - loss(v - e)) / 2e-6 for e in np.eye(len(v)) * 1e-6])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        v = v - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    assert np.abs(model.weights - v[:-2]).max() < 2e-3
    assert np.abs(model.thresholds - [v[-2], v[-2] + np.exp(v[-1])]).max() < 2e-3


# 3 ----


def test_companding_by_segments():
    """G.711: eight segments a sign, each with steps twice as wide as the one below, the value in the middle of its step."""
    for code in range(256):
        u, a = ~code & 0xFF, code ^ 0x55
        segment, step = (u >> 4) & 7, u & 15
        size = sum(16 * (8 << s) for s in range(segment)) + step * (8 << segment) + ((4 << segment) - 4)
        assert telephony.TABLES["mulaw"][code] == (-size if u & 128 else size)
        segment, step = (a >> 4) & 7, a & 15
        wide = 16 << max(segment - 1, 0)
        size = (0 if segment == 0 else 256 << (segment - 1)) + step * wide + wide // 2
        assert telephony.TABLES["alaw"][code] == (size if a & 128 else -size)


def resampled(x, rate, target):
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    wide = max(up, down)
    out = []
    for j in range(-(-len(x) * up // down)):
        total = 0.0
        for i, v in enumerate(x):
            z = (i - j * down / up) * up / wide
            if abs(z) <= telephony.ZEROS:
                total += v * np.sinc(z) * np.i0(8 * np.sqrt(max(0.0, 1 - (z / telephony.ZEROS) ** 2))) / np.i0(8) * up / wide
        out.append(total)
    return np.clip(np.rint(out), -32768, 32767)


@pytest.mark.parametrize("rate", [8000, 11025, 44100, 44101, 383_999])
@pytest.mark.parametrize("span", [telephony.SPAN, 64])
def test_resampling_sample_by_sample(monkeypatch, rate, span):
    monkeypatch.setattr(telephony, "SPAN", span)
    rng = np.random.default_rng(rate)
    clips = [rng.integers(-20_000, 20_000, n).astype(np.int16) for n in (0, 1, 9, 150, 400)]
    want = [resampled(c, rate, 16_000) for c in clips]
    for got in (telephony.resample(clips, rate, 16_000), telephony._resample_all(clips, rate, 16_000)):
        assert [len(g) for g in got] == [len(w) for w in want]
        assert all(np.abs(g - w).max(initial=0) <= 1 for g, w in zip(got, want))


def test_many_clips_of_an_awkward_rate():
    clips = [np.full(100, 1000, np.int16)] * 4096
    got = telephony._resample_all(clips, 383_999, 16_000)
    assert len(got) == 4096 and all(len(g) == 5 and (g == got[0]).all() for g in got)


def test_telephony_query_by_hand(spark):
    rows = {(r.conv_id, r.turn): r for r in telephony.telephony(table(spark, "conversations")).collect()}
    for r in table(spark, "conversations").limit(12).collect():
        raw = r.text.encode()
        if r.turn % 3 < 2:
            samples = [int(telephony.TABLES[("mulaw", "alaw")[r.turn % 3]][b]) for b in raw]
        else:
            samples = telephony.adpcm_decode([b"".join(b"\x00\x00\x10\x00" + raw[a : a + 252] for a in range(0, len(raw), 252))], 256)[0].tolist()
        own = np.frombuffer(rows[r.conv_id, r.turn].pcm, "<i2")
        part = resampled(samples[:300], 8000, 16_000)[:500]
        assert len(own) == 2 * len(samples) and np.abs(own[: len(part)].astype(int) - part).max(initial=0) <= 1


# 7 ----


def test_pii_query_by_hand(spark):
    """Candidates and votes as they are; estimation span by span, and a dense logistic regression."""
    docs = table(spark, "documents")
    spans = [(r.doc_id, s, e, kind, pattern, f) for r in docs.collect() for s, e, kind, pattern, f in pii.inspect(r.text or "")]
    truth = {}
    for kind in {s[3] for s in spans}:
        v = np.array([pii.votes_of(s[4]) for s in spans if s[3] == kind])
        soft = 1 / (1 + np.exp(-1.5 * v.sum(axis=1)))
        for _ in range(pii.ROUNDS):
            share = (soft.sum() + 2) / (len(v) + 3)
            score = np.full(len(v), np.log(share / (1 - share)))
            for j in range(v.shape[1]):
                yes = {k: soft[v[:, j] == k].sum() + p for k, p in ((-1, 1), (0, 2), (1, 5))}
                no = {k: (1 - soft)[v[:, j] == k].sum() + p for k, p in ((-1, 5), (0, 2), (1, 1))}
                score += [np.log(yes[k] / sum(yes.values())) - np.log(no[k] / sum(no.values())) for k in v[:, j]]
            soft = 1 / (1 + np.exp(-score))
        truth |= {(kind, pii.pattern_of(tuple(x))): p for x, p in zip(v.tolist(), soft)}
    x = np.zeros((len(spans), (1 << pii.BITS) + 1))
    for i, s in enumerate(spans):
        for f in s[5]:
            x[i, f] += 1
    x[:, -1] = 1
    y = np.array([truth[s[3], s[4]] for s in spans])
    w, m, q = (np.zeros(x.shape[1]) for _ in range(3))
    plain = np.ones(len(w))
    plain[-1] = 0
    for step in range(1, 201):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 1e-5 * w * plain
        m, q = 0.9 * m + 0.1 * g, 0.99 * q + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-9)
    p = 1 / (1 + np.exp(-x @ w))
    want = {s[:4]: p_ for s, p_ in zip(spans, p) if p_ >= 0.5}
    got = {(r.doc_id, r.start, r.end, r.kind): r.probability for r in pii.find_pii(docs).collect()}
    near = {s[:4] for s, p_ in zip(spans, p) if abs(p_ - 0.5) < 0.02}
    assert set(got) - near == set(want) - near and len(got) > 10
    assert all(abs(got[k] - want[k]) < 0.02 for k in set(got) & set(want))


def test_pii_of_long_unbroken_texts_is_linear():
    import time

    for unit in ("a1", "ab@", "4111", "+1234567890", "0612-", "AB12CDEF ", "1.2."):
        text = unit * (2_000_000 // len(unit) // (40 if unit == "ab@" else 4))
        began = time.perf_counter()
        count = sum(1 for _ in pii.candidates(text))
        assert time.perf_counter() - began < 20 and count >= 0


# 8 ----


def pack_by_hand(sizes, capacity):
    """Longest first, each into the fullest bin with room, of those the one that has had this room for longest."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], sizes[i][1:], i))
    bins, touched = [], []
    for now, i in enumerate(order):
        room = [capacity - sum(sizes[j][0] for j in b) for b in bins]
        fits = [(r, touched[k], k) for k, r in enumerate(room) if r >= sizes[i][0]]
        k = min(fits)[2] if fits else len(bins)
        if not fits:
            bins.append([])
            touched.append(0)
        bins[k].append(i)
        touched[k] = now
    return bins


def test_packing_of_one_part_by_hand(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(rng.choice([0, 1, 4, 9, 20, 33, 70])))) for k in range(120)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), capacity=32).collect()
    items = []
    for k, text in rows:
        n = len(text.split())
        items += [(min(32, n - a), k, a) for a in range(0, n, 32)]
    first = pack_by_hand(items, 32)
    full = lambda b, of: sum(of[i][0] for i in b) >= 32 * packing.FULL
    want = [[items[i] for i in sorted(b)] for b in first if full(b, items)]  # a sequence holds its items in their own order
    rest = [sorted(b) for b in first if not full(b, items)]
    rest.sort(key=lambda b: ([items[i][1] for i in b], [items[i][2] for i in b]))
    again = [(sum(items[i][0] for i in b), [items[i][1] for i in b], [items[i][2] for i in b]) for b in rest]
    want += [[items[i] for j in sorted(b) for i in rest[j]] for b in pack_by_hand(again, 32)]
    assert sorted([list(zip(r.lengths, r.doc_ids, r.starts)) for r in got]) == sorted(want)
    words = dict(rows)
    for r in got:
        assert [t.split() for t in r.texts] == [words[d].split()[s : s + n] for d, s, n in zip(r.doc_ids, r.starts, r.lengths)]


def test_packing_of_long_documents_stops_early(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('w ', 1100) AS text").repartition(6)
    got = packing.pack_documents(docs, part_items=20)
    rows = got.collect()
    assert len(rows) == 600 and all(r.used == 1100 for r in rows) and len({r.part for r in rows}) > 1


def test_packing_of_repeated_rows_and_rows_without_number(spark):
    docs = spark.createDataFrame([(5, "a b c")] * 40 + [(None, "d e")] * 40, "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(docs, capacity=10, part_items=8).collect()
    assert sum(r.used for r in rows) == 200 and len(rows) <= 23
    assert Counter(t for r in rows for t in r.texts) == {"a b c": 40, "d e": 40}


# 9 ----


def bucket_by_hand(gram, order):
    g = 0
    for n, c in enumerate(gram, 1):
        g = (g * 0x9E3779B97F4A7C15 & MASK) ^ (ord(c) + (n << 32))
    assert len(gram) == order
    return (g * 0xD6E8FEB86659FD93 & MASK) >> (64 - language_id.BITS)


def test_language_query_by_hand(spark):
    rows = table(spark, "documents").collect()
    counts, languages = {}, sorted({r.lang for r in rows})
    grams = lambda t: [bucket_by_hand(t[i : i + n], n) for n in language_id.ORDERS for i in range(len(t) - n + 1)]
    of = {r.doc_id: Counter(grams((r.text or "").lower())) for r in rows}
    for r in rows:
        counts.setdefault(r.lang, Counter()).update(of[r.doc_id])
    score = {}
    for lang in languages:
        total = sum(counts[lang].values()) + language_id.ALPHA * language_id.BUCKETS
        score[lang] = lambda b, c=counts[lang], t=total: log((c[b] + language_id.ALPHA) / t)
    got = {r.doc_id: r for r in language_id.language_id(table(spark, "documents")).collect()}
    for r in rows:
        own = {lang: sum(n * f(b) for b, n in of[r.doc_id].items()) for lang, f in score.items()}
        best = max(own.values())
        if not of[r.doc_id]:
            assert got[r.doc_id].predicted_lang is None
            continue
        assert abs(own[got[r.doc_id].predicted_lang] - best) < 1e-3
        p = 1 / sum(np.exp(max(-700, (x - best) / 3)) for x in own.values())
        assert abs(got[r.doc_id].probability - p) < 1e-3


def test_language_ties_go_to_the_first():
    counts = np.ones((3, language_id.BUCKETS), np.int64)
    m = language_id.Model(["a", "b", "c"], counts)
    raw = np.frombuffer(b"any text", np.uint8)
    total, _ = m.scores(raw, np.array([0, len(raw)]))
    assert m.languages[total.argmax(axis=1)[0]] == "a"


# 10 ----


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_licenses_by_every_window():
    """Nothing of coverage 0.75 or more is missed, nothing less is reported, and places are where the words are."""
    texts = {k: license_scan.TEMPLATES[k] for k in ("MIT-notice", "Apache-2.0-notice", "all-rights-reserved", "CC-BY-NC-4.0-notice", "GPL-3.0-notice", "Unlicense")}
    known = license_scan.Templates(texts, license_scan.MIN_COVERAGE)
    rng = random.Random(11)
    filler = "the of and to in a work for with license version software any use free all rights".split()
    found = 0
    for trial in range(60):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 4)):
            own = re.findall(r"\w+", texts[rng.choice(list(texts))].lower())
            words += [w for w in own if rng.random() > rng.choice([0, 0.1, 0.3])]
            words += [rng.choice(filler) for _ in range(rng.randrange(0, 6))]
        h = K.hash_of(" ".join(words)).tolist()
        got = known.matches(h, [k for k, w in enumerate(h) if w in known.owners])
        for t, template in enumerate(known.words):
            width = int(len(template) * license_scan.STRETCH) + license_scan.SLACK_WORDS
            own = sorted(m[1:] for m in got if m[0] == t)
            found += len(own)
            assert all(b <= c for (_, b, _), (c, _, _) in zip(own, own[1:]))
            for a, b, n in own:
                assert 0.75 * len(template) <= n <= common_subsequence(template, h[a:b])
                assert b - a <= width and h[a] in template and h[b - 1] in template
            for a in range(len(h)):
                for b in range(a + 1, min(len(h), a + width) + 1):
                    if len(license_scan.align(template, h[a:b])) >= 0.75 * len(template):
                        assert any(x < b and a < y for x, y, _ in own), (trial, t, a, b)
    assert found > 60


def test_license_query_over_verbatim_notices(spark):
    docs = table(spark, "documents")
    got = {(r.doc_id, r.license) for r in license_scan.license_scan(docs).collect() if r.coverage == 1}
    squeezed = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) + " "
    want = {(r.doc_id, name) for r in docs.collect() for name, text in license_scan.TEMPLATES.items() if squeezed(text) in squeezed(r.text)}
    assert want == got


def test_token_counts():
    texts = ["", "  ", "a b\tc\n", "x", " é ü ", "\x0bq", "a\r\nb\fc"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    assert K.token_counts(raw, off).tolist() == [len(re.findall(r"[^ \t\n\r\f]+", t)) for t in texts]
    row, start, length, got = packing.pieces(pa.array(texts), 2)
    words = lambda t: re.findall(r"[^ \t\n\r\f]+", t)
    assert [words(g.decode()) for g in got] == [words(texts[r])[s : s + n] for r, s, n in zip(row, start, length)]
