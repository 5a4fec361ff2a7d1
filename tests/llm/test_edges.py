"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib

import pytest

from heddle.llm import bpe, decontaminate, fingerprint, langid, licenses, linededup, lm, packing, shards, simhash

SCHEMA = "doc_id long, text string, lang string, k string, t int, n int, body string, b int"
LONG = "the quick brown fox " * 20_000
#: None as id and text, no words, a long text, copies, a row given twice.
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "...!?"), (5, LONG), (6, "one two three four five six seven eight nine ten eleven"), (7, "one two three four five six seven eight nine ten eleven"),
    (8, "Licensed under CC BY 4.0.\nAll rights reserved"), (8, "Licensed under CC BY 4.0.\nAll rights reserved"), (None, "no key here"), (9, "Ünïcode İstanbul 漢字 😀"), (-5, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, "en" if i and i % 2 else "de", "K", 1, 2, "B", 3) for i, x in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x or 0))


ALL = sorted((i for i, _ in ROWS), key=lambda x: (x is not None, x or 0))


def test_fingerprint(docs, none):
    out = fingerprint.document_fingerprints(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ALL
    assert rows[1].n_chars == 0 and rows[1].fingerprint == rows[2].fingerprint != rows[3].fingerprint
    assert rows[6].fingerprint == rows[7].fingerprint and rows[6].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())
    assert fingerprint.document_fingerprints(none).count() == 0
    alone = fingerprint.document_fingerprints(docs.where("doc_id = 6")).first()
    text = ROWS[5][1]
    m = len(text) // 4
    assert alone.edited_sha256 == hashlib.sha256((text[:-m] + text[:m]).encode()).hexdigest()


def test_simhash(docs, none):
    rows = simhash.groups(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[1].component_id == by[3].component_id == 1
    assert by[7].component_id == 6 and by[None].component_id is None
    assert simhash.groups(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == [None, -5, 1, 4, 5, 6, 8, 9]
    assert simhash.keep_one(none).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([("a", "One two THREE four five six seven eight nine ten"), ("a", "漢字"), ("b", None), (None, "no key"), ("c", "..")], "item_id string, text string")
    out = decontaminate.contamination(docs, items, ["doc_id"])
    by = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ALL
    assert (by[6].n_words, by[6].n_hit, by[6].n_items) == (11, 10, 1) and by[9].n_hit == 1 and by[None].n_items == 1
    assert by[6].spans[0].asDict() == {"start": 0, "end": 48}
    assert (by[1].n_words, by[1].n_hit, by[1].contaminated) == (0, 0, False)
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0), ["doc_id"]).collect())
    assert decontaminate.contamination(none, items, ["doc_id"]).count() == 0
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and ids(clean) == [-5, 1, 2, 3, 4, 5, 8, 8]


def test_langid(docs, none):
    model = langid.train(docs.where("lang is not null"))
    out = langid.predict(docs, model, ["doc_id"])
    by = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ALL
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3, 4))
    assert by[9].lang_pred in ("de", "en") and 0 <= by[9].score <= 1
    empty = langid.train(none)
    assert empty.languages == [] and langid.predict(docs, empty, ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, model, ["doc_id"]).count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and not set(ids(kept)) & {1, 2, 3, 4}


def test_packing(docs, none):
    rows = packing.pack(docs, row_tokens=64).collect()
    parts = sorted((d is not None, d or 0, o) for r in rows for d, o in zip(r.doc_ids, r.doc_offsets))
    assert {d for _, d, _ in parts} == {i or 0 for i, _ in ROWS}
    assert all(len(r.input_ids) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 64 for r in rows)
    assert packing.pack(none).count() == 0


def test_licenses(docs, none):
    out = licenses.license_scan(docs, ["doc_id"])
    by = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ALL
    assert (by[8].n_base, by[8].first_word, by[8].last_word, by[8].base_labels) == (2, 2, 6, "cc-by,reserved")
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].labels, by[1].score) == (0, 0, None, "", 0.0)
    assert licenses.license_scan(none, ["doc_id"]).count() == 0


def test_linededup(docs, none):
    out = linededup.dedupe_lines(docs, min_words=5)
    by = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ALL and out.columns[: len(docs.columns)] == docs.columns
    assert (by[6].n_deleted, by[7].n_deleted, by[7].text) == (0, 1, "")
    assert by[1].text is None and by[1].n_lines == 0 and by[2].n_lines == 1
    assert by[8].n_deleted == 0  # a row given twice is one document
    assert linededup.dedupe_lines(none).count() == 0


def test_lm(docs, none):
    out = lm.score_documents(docs)
    by = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ALL
    assert by[1].n_tokens == 1 and by[5].n_tokens == 80_001 and all(r.score <= 0 for r in by.values())
    assert by[1].score == by[2].score and by[6].base_score == by[7].base_score
    assert lm.score_documents(none).count() == 0


def test_shards(docs, none):
    out = shards.slots(shards.dealt(docs.select("doc_id", "text"), shards=3, bucket_rows=2)).collect()
    assert len(out) == len(ROWS)
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 3) for r in out)
    assert {r.size for r in out if r.doc_id in (1, 2)} == {8} and {r.text_crc32 for r in out if r.doc_id in (1, 2)} == {0}
    assert shards.slots(shards.dealt(none.select("doc_id", "text"))).count() == 0


def test_bpe(docs, none):
    out = bpe.encode_documents(docs, ["doc_id"])
    by = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ALL
    assert by[1].n_tokens == 0 and by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(by[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest() for i, x in ROWS)
    assert bpe.encode_documents(none, ["doc_id"]).count() == 0
