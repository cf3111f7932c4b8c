"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ocellus.llm import language_id, license_scan, ngram_jaccard, packing, pii, quality_rules, secret_scan, source_mixing, telephony, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[(i * i + i // 7) % 20] + WORDS[i % 19] + WORDS[i % 17] for i in range(40_000))
#: Columns that operators make for themselves or return; docs may have them too.
CLASHES = ["keep", "broken", "jaccard", "__masked", "__signals", "__at", "progress", "epoch", "doc_ids", "probability", "TX", "s1", "size", "a.b", "__key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    plain = [(i, f"{WORDS[i % 20]} {WORDS[(i + 3) % 20]} plain text number {i} with words enough to be kept whole", "en", "s0", 60) for i in range(12)]
    return plain + [
        (100, None, "en", "s0", None),
        (101, "", "en", "s0", 0),
        (102, "   \n\t ", "de", None, 5),
        (103, "!!! ???", None, "s1", 7),
        (104, LONG, "en", "s0", len(LONG)),
        (105, LONG, "en", "s0", len(LONG)),
        (None, "a text of a document without any number at all", "en", "s0", 46),
        (None, None, None, None, None),
        (106, "same words in this very row", "en", "s1", 27),
        (106, "same words in this very row", "en", "s1", 27),
        (106, "another text under the same number, which is not alike", "en", "s1", 50),
        (107, "write to jane.roe@mail.example.com or call +1 (619) 555-1368 today", None, "s1", 66),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for k, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(k))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, some):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(12)] if some else [], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda s, d: ngram_jaccard.ngram_jaccard_join(d),
    "op2": lambda s, d: toxicity.toxicity(d, labels(s, True)),
    "op4": lambda s, d: quality_rules.quality_decisions(d),
    "op5": lambda s, d: secret_scan.secret_scan(d),
    "op6": lambda s, d: source_mixing.mix_sources(d),
    "op7": lambda s, d: pii.find_pii(d),
    "op8": lambda s, d: packing.pack_documents(d),
    "op9": lambda s, d: language_id.language_id(d),
    "op10": lambda s, d: license_scan.license_scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op2", "op4", "op9"])
def test_every_row_is_answered(spark, docs, name):
    assert OPERATORS[name](spark, docs).count() == len(rows())


def test_op1_cases(spark, docs):
    pairs = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in ngram_jaccard.ngram_jaccard_join(docs).collect()}
    assert pairs[104, 105] == 1.0
    assert all(a is not None and b is not None and a < b for a, b in pairs)
    assert not any(100 <= x <= 103 for p in pairs for x in p)


def test_op2_without_usable_labels(spark, docs):
    got = toxicity.toxicity(docs, labels(spark, False))
    assert got.filter("toxic").count() == 0 and got.count() == len(rows())


def test_op4_cases(spark, docs):
    got = {r.doc_id: r for r in quality_rules.quality_decisions(docs).collect()}
    assert all(got[i].broken == "empty" and not got[i].keep for i in (100, 101, 102, 103))
    assert all(got[i].keep for i in (*range(12), 104, 106, 107))


def test_op5_repeated_rows(spark):
    d = spark.createDataFrame([(1, "password=32bb02aa3b580bf8ab and password=32bb02aa3b580bf8ab", "x", "y", 1)] * 2, SCHEMA)
    assert [(r.doc_id, r.rule, r.n) for r in secret_scan.secret_scan(d).collect()] == [(1, "password_assignment", 2)] * 2


def test_op6_cases(spark, docs):
    got = source_mixing.mix_sources(docs).collect()
    assert not {r.doc_id for r in got} & {100, 101, 102}
    assert [r.progress for r in got] == sorted(r.progress for r in got)


def test_op7_cases(spark, docs):
    assert {(r.doc_id, r.kind) for r in pii.find_pii(docs).collect()} == {(107, "EMAIL"), (107, "PHONE")}
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows())
    row = masked.filter("doc_id = 107").first()
    assert row.text == "write to [EMAIL] or call [PHONE] today" and row.n_chars == len(row.text)
    assert masked.filter("text IS NULL").count() == 2


def test_op8_cases(spark, docs):
    got = packing.pack_documents(docs, capacity=512).collect()
    assert all(sum(r.lengths) == r.used <= 512 for r in got)
    assert sum(r.used for r in got) == docs.agg(F.sum(source_mixing.token_count(F.col("text")))).first()[0]
    assert None in {i for r in got for i in r.doc_ids}
    assert sum(len(t.split()) for r in got for t in r.texts) == sum(r.used for r in got)


def test_op9_cases(spark, docs):
    got = {r.doc_id: r for r in language_id.language_id(docs).collect() if r.doc_id is not None}
    assert got[100].predicted_lang is None and got[101].predicted_lang is None and got[100].probability == 0
    assert got[104].predicted_lang == "en"


def test_op10_very_long_text(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    d = spark.createDataFrame([(1, f"{LONG} {notice} {LONG}", "x", "y", 1), (2, None, None, None, None), (3, f"{notice} {notice}", "x", "y", 1)], SCHEMA)
    got = license_scan.license_scan(d, {"Apache-2.0-notice": notice}).collect()
    assert sorted((r.doc_id, r.coverage) for r in got) == [(1, 1.0), (3, 1.0), (3, 1.0)]


def test_op3_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    d = spark.createDataFrame([(1, 0, "a", "hello"), (1, 1, "b", ""), (1, 2, "a", "x" * 700), (None, None, None, None), (2, 2, "a", None), (1, 0, "a", "hello")], schema)
    got = telephony.telephony(d).collect()
    assert sorted(r.n_samples for r in got if r.n_samples is not None) == [0, 10, 10, 2 * (1 * 3 + 2 * 700)]
    assert [r.error for r in got if r.pcm is None] == ["no payload"] * 2
    assert telephony.telephony(spark.createDataFrame([], schema)).count() == 0


def test_op3_bad_media_and_clashing_columns(spark):
    d = spark.createDataFrame([(b"\x00" * 8, "opus", 8000, 256, 1), (b"\x00", "mulaw", None, 256, 1), (b"\x00", "adpcm", 8000, 3, 1), (b"\x00" * 3, "adpcm", 8000, 256, 1)], "p binary, c string, r int, b int, pcm int")
    got = telephony.decode_media(d, "p", "c", "r", "b").collect()
    assert [r.error for r in got] == ["unknown codec", "bad rate", "bad block size", None]
    assert got[3].n_samples == 0 and len(got[0]) == 8


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, docs, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    last = name == corpus_pipeline.STAGES[-1][0]
    out = stage(spark, docs, "unused")
    assert last or out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, empty, "unused").count() == 0


def test_near_duplicate_stage(spark, docs):
    out = ngram_jaccard.drop_near_duplicates(docs).collect()
    ids = [r.doc_id for r in out]
    assert ids.count(104) == 1 and 105 not in ids
    assert ids.count(106) == 2 and ids.count(None) == 2
    assert {100, 101, 102, 103} <= set(ids)


def test_mixing_deals_repeated_rows_out(spark):
    d = spark.createDataFrame([(1, "one two three", "en", "a", 1)] * 3 + [(i, f"w{i} " * 30, "en", "b", 1) for i in range(2, 40)], SCHEMA)
    whole = source_mixing.mix_sources(d).filter("doc_id = 1").count()
    assert source_mixing.mixed_documents(d).filter("doc_id = 1").count() == whole


def test_near_copies_without_number(spark):
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words[:30], "other", *words[31:]])
    for a, b in ((None, None), (1, None)):
        d = spark.createDataFrame([(a, text, "en", "s", 1), (b, near, "en", "s", 1), (None, "nothing like the others here", "en", "s", 1)], SCHEMA)
        kept = ngram_jaccard.drop_near_duplicates(d).collect()
        assert len(kept) == 2 and (a is None or text in {r.text for r in kept})


def test_repeated_rows_that_differ_elsewhere(spark):
    rows = [(7, "the very same text in each row", lang, "s", 1) for lang in ("fr", "de", "en")]
    for order in (rows, rows[::-1]):
        assert [r.lang for r in ngram_jaccard.drop_near_duplicates(spark.createDataFrame(order, SCHEMA)).collect()] == ["de"]


BLOB = "a1" * 1_000_000


def test_long_texts_without_spaces(spark):
    d = spark.createDataFrame([(1, BLOB, "en", "s", len(BLOB)), (2, "x-" * 500_000 + "://", "en", "s", 1), (3, BLOB + " mail to ann@mail.example.com", "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in pii.find_pii(d).collect()] in ([3], [])
    assert secret_scan.secret_scan(d).count() == 0
    assert quality_rules.quality_decisions(d).count() == 3
    assert ngram_jaccard.drop_near_duplicates(d).count() == 3
    assert packing.pack_documents(d).agg(F.sum("used")).first()[0] == 6
    assert language_id.language_id(d).count() == 3 and license_scan.license_scan(d).count() == 0
    assert toxicity.toxicity(d, labels(spark, True)).count() == 3


def test_ties(spark):
    """Rows of one text get one answer each, whatever their number; licenses that tie are both reported."""
    text = "Released under the MIT License. All rights reserved."
    d = spark.createDataFrame([(k, text, "en", "s", 1) for k in (3, 1, 2)], SCHEMA)
    assert len({(r.severity, r.grade) for r in toxicity.toxicity(d, labels(spark, True)).collect()}) == 1
    assert len({(r.predicted_lang, r.probability) for r in language_id.language_id(d).collect()}) == 1
    assert sorted((r.doc_id, r.license) for r in license_scan.license_scan(d).collect()) == sorted((k, name) for k in (1, 2, 3) for name in ("MIT-notice", "all-rights-reserved"))


def test_mixing_spreads_rows_without_number(spark):
    d = spark.createDataFrame([(None, f"text number {k} of many", "en", "s", 1) for k in range(50)], SCHEMA)
    first, again = ([(r.n_tokens, r.progress) for r in source_mixing.mix_sources(x).collect()] for x in (d, d.repartition(3)))
    assert first == again and len({p for _, p in first}) == 50


def test_pii_forms(spark):
    forms = ["card 3782 822463 10005 please", "call +33 6 12 34 56 78 today", "tel 06 12 34 56 78 now", "telefon 030 12345678 bitte"]
    assert [[k for *_, k, _ in pii.candidates(f)] for f in forms] == [["CARD"], ["PHONE"], ["PHONE"], ["PHONE"]]
