"""Further plain versions and cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heddle.llm import bpe, decontaminate, fingerprint, langid, licenses, linededup, lm, packing, shards, simhash

D = "/root/testdata/sf0.001"


def plain_counts(text):
    """Feature counts, one n-gram at a time."""
    words = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).split()
    data = (" " + " ".join(words) + " ").encode()
    counts = [0] * langid.BUCKETS
    for n in langid.GRAMS:
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if n > 2 and 32 in gram[1:-1]:
                continue
            h = n * 374761393 & 0xFFFFFFFF
            for k, byte in enumerate(gram):
                h ^= byte * int(langid._MULTIPLIERS[k]) & 0xFFFFFFFF
                h = h * 2246822519 & 0xFFFFFFFF
                h ^= h >> 15
            counts[h % langid.BUCKETS] += 1
    return counts


def test_language_against_plain(spark):
    """Every prediction from counts, table, bias and temperature, without arrays of n-grams."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = langid._learn(docs)
    got = {r.doc_id: r for r in langid.op4_language_id(spark, D).collect()}
    for r in docs.limit(60).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        counts = np.array(plain_counts(r.text), float)
        z = (counts @ model.table.astype(float) / counts.sum() + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id].lang_pred == model.languages[int(p.argmax())] and abs(got[r.doc_id].score - p.max()) < 1e-4


def test_language_sample_reaches_rare_languages(spark):
    """A language with 5 of 3,005 rows is learned from a sample of 40 rows, and the bound holds for repeated rows too."""
    rows = [(i, f"the house and the garden number {i} of this town", "en") for i in range(3000)] + [(10_000 + i, f"das haus und der garten {i} dieser stadt", "de") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid._sample(df, "doc_id", "text", "lang", 40).collect()
    assert len(sample) <= 40 and sum(r.lang == "de" for r in sample) == 5 and sum(r.lang == "en" for r in sample) > 10
    assert langid.train(df, rows=40).languages == ["de", "en"]
    same = spark.createDataFrame([(1, "the same row", "en")] * 500 + [(2, "und noch eine", "de")], "doc_id long, text string, lang string")
    assert langid._sample(same, "doc_id", "text", "lang", 40).count() <= 40


def test_fingerprints_of_hot_keys(spark):
    """A key and null that hold most rows: every row's next one is that of the plain order, by key and hash of the text."""
    rnd = random.Random(3)
    rows = [(7, f"hot text {i} {rnd.random()}") for i in range(300)] + [(None, f"no key {i}") for i in range(80)] + [(i, f"own {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = sorted(df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    import hashlib

    want = Counter()
    for i, r in enumerate(hashed):
        m = len(r.text) // 4
        want[r.doc_id, hashlib.sha256((r.text[: len(r.text) - m] + hashed[(i + 1) % len(hashed)].text[:m]).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.edited_sha256) for r in fingerprint.document_fingerprints(df).collect())
    assert got == want
    buckets = fingerprint._buckets(df.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"), F.col("text").alias("body")))
    assert max(r["count"] for r in buckets.groupBy("b").count().collect()) < 150


def test_packing_encoders_agree(spark):
    """Texts on either side of the limit, and the limit itself, give the same packed rows."""
    docs = spark.createDataFrame([(1, "short one"), (2, "x" * 400), (3, "a b " * 300), (4, None), (5, "Ünï 漢字 " * 90)], "doc_id long, text string")
    parts = lambda n: sorted((d, o, r.input_ids[4 * a : 4 * b]) for r in packing.pack(docs, row_tokens=64, fast_chars=n).collect() for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]))
    assert parts(0) == parts(400) == parts(10**9)


def test_licenses_verify_spans(spark):
    """Positions count once; text around a notice doesn't hide it; words in its midst don't split it."""
    mit, cc = "released under the mit license", "licensed under cc by nc 4 0"
    long = licenses.TEMPLATES[1][0].split()
    rows = {
        1: ("under the under the under the", ""),
        2: (f"{mit} " + "mit license " * 6, "mit"),
        3: (f"{cc} " + "4 0 " * 5, "cc-by,cc-by-nc"),
        4: ("4 0 4 0 4 0 4 0 4 0 4 0", ""),
        5: ("2 0 " * 6, ""),
        6: (" ".join([*long[:8], "dear", "kind", "reader", *long[8:]]), "mit"),
        7: (" ".join(long[::-1]), ""),
        8: (f"{mit} and later {mit}", "mit"),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df, ["doc_id"]).collect()}
    assert {k: r.labels for k, r in got.items()} == {k: labels for k, (_, labels) in rows.items()}
    assert got[2].score == 1.0 and [(s.first_word, s.last_word) for s in got[2].spans if s.label == "mit"] == [(0, 4)]
    assert [(s.first_word, s.last_word) for s in got[8].spans] == [(0, 4), (7, 11)]


def test_licenses_against_plain(spark):
    """Labels and score from a plain search of every template at every band of every text."""
    rnd = random.Random(9)
    words = sorted({w for t, _ in licenses.TEMPLATES[:4] for w in t.split()})
    texts = []
    for _ in range(150):
        t = rnd.choice(licenses.TEMPLATES)[0].split()
        t = [w for w in t if rnd.random() > 0.1]
        for _ in range(rnd.randint(0, 4)):
            t.insert(rnd.randrange(len(t) + 1), rnd.choice(words))
        texts.append(" ".join([*rnd.choices(words, k=5), *t, *rnd.choices(words, k=5)]))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        w, labels, best = text.split(), set(), 0.0
        for phrase, label in licenses.PHRASES:
            if f" {phrase} " in f" {text} ":
                labels.add(label)
                best = 1.0
        for template, label in licenses.TEMPLATES:
            t = template.split()
            places = [(p - q, q) for p in range(len(w) - 1) for q in range(len(t) - 1) if w[p : p + 2] == t[q : q + 2]]
            shares = [len({q for d, q in places if first <= d <= first + licenses.drift(len(t))}) / (len(t) - 1) for first, _ in places]
            best = max([best, *shares])
            if any(x >= licenses.SHARE for x in shares):
                labels.add(label)
        assert got[i].labels == ",".join(sorted(labels)) and got[i].score == pytest.approx(best)


def test_line_ranks_are_ordered(spark):
    """At every level ranks follow the order of the line sequences, and equal sequences share one."""
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choice("abc") for _ in range(12))) for i in range(30)]
    lines = spark.createDataFrame([(k, p, x) for k, t in rows for p, x in enumerate(t.split("\n"))], "k long, pos int, line string")
    first = linededup._ranked(lines, ["line"])
    level = lines.join(first, "line").select("k", "pos", "rank")
    seqs = {k: t.split("\n") for k, t in rows}
    for size in (1, 2, 4):
        got = {(r.k, r.pos): r["rank"] for r in level.collect()}
        assert len(got) > 20
        of = lambda at: seqs[at[0]][at[1] : at[1] + size]
        order = sorted(got, key=of)
        assert all((of(a) == of(b)) == (got[a] == got[b]) and got[a] <= got[b] for a, b in zip(order, order[1:]))
        pairs = level.join(level.select("k", (F.col("pos") - size).alias("pos"), F.col("rank").alias("next")), ["k", "pos"])
        level = pairs.join(linededup._ranked(pairs, ["rank", "next"], "double"), ["rank", "next"]).select("k", "pos", F.col("double").alias("rank"))


@pytest.mark.parametrize("partitions", ["4", "7", "61"])
def test_slots_depend_on_records_alone(spark, partitions):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.slot for r in shards.slots(shards.dealt(docs, shards=3, bucket_rows=20), shards=3).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        again = shards.slots(shards.dealt(docs.repartition(int(partitions)), shards=3, bucket_rows=20), shards=3)
        assert {r.doc_id: r.slot for r in again.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


CLASHES = "doc_id long, text string, lang string, k int, t int, h int, fp int, n int, n_lines int, n_deleted int, deleted_runs int, runs int, size int, bucket int, shard int, slot int, n_words int, labels int, ids int, n_tokens int, score int, rejected int, `a.b` int, c0 int"


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["one line\nof some words", "one line\nanother end", None, "", "the last of all texts here", "the last of all texts here"]
    extra = len(CLASHES.split(", ")) - 3
    return spark.createDataFrame([(i if i < 4 else 4, t, "en" if i % 2 else "de", *range(extra)) for i, t in enumerate(texts)], CLASHES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_columns(spark, clashing, name):
    """Every stage takes any columns, repeated rows, null and empty texts, and an empty table; all but the last return the columns of their documents."""
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (clashing, clashing.limit(0)):
        out = stage(spark, docs, D)
        rows = out.collect()
        if name != "byte_bpe":
            assert out.columns == docs.columns
            assert all(list(r)[3:] == list(range(len(r) - 3)) for r in rows)
        if docs is not clashing:
            assert not rows
    kept = {"language_id": 4, "line_dedup": 6, "near_dedup": 4, "decontamination": 6, "byte_bpe": 6}
    assert len(stage(spark, clashing, D).collect()) == kept[name]


def test_operators_with_clashing_columns(spark, clashing, tmp_path):
    keep = [f"{c}" for c in clashing.columns if c not in ("text", "a.b")]
    assert linededup.dedupe_lines(clashing).columns[-4:] == ["c0", "n_lines", "n_deleted", "deleted_runs"] and "n_lines_doc" in linededup.dedupe_lines(clashing).columns
    found = decontaminate.contamination(clashing, spark.read.parquet(f"{D}/benchmark.parquet"), keep)
    assert "n_words_doc" in found.columns and found.count() == 6
    scanned = licenses.license_scan(clashing, keep)
    assert {"labels_doc", "score_doc"} <= set(scanned.columns) and scanned.count() == 6
    assert {"ids_doc", "n_tokens_doc"} <= set(bpe.encode_documents(clashing, keep).columns)
    assert {r.component_id for r in simhash.groups(clashing).collect()} == {0, 1, 2, 4}
    assert lm.score_documents(clashing).count() == 6 and fingerprint.document_fingerprints(clashing).count() == 6
    shards.write_shards(clashing, str(tmp_path / "s"), shards=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 6 and {"size_doc", "bucket_doc", "shard_doc", "slot_doc"} <= set(back.columns)
    # A key that repeats, with texts alike or not, loses no row but exact copies.
    a, b, c, d = ("".join(f"{x}{i} " for i in range(30)) for x in "abcd")
    rows = spark.createDataFrame([(None, a), (None, b), (7, c), (7, d)], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(rows).collect()) == [a, b, c, d]
    more = spark.createDataFrame([(3, b), (5, a), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(more).collect()) == [(3, b), (5, a)]
