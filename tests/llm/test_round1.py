"""Cases that a review found; each failed before its change."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from heddle.llm import linededup, lm, shards, simhash

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunk_tokens,order", [(200_000, 3), (60, 3), (1, 4)])
def test_lm_keeps_every_ngram(spark, chunk_tokens, order):
    """Every n-gram counts, however rare and whichever chunks hold it: the plain automaton over all of them and the plain recursion agree."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["a", "b", "c", *(f"w{rnd.randrange(400)}" for _ in range(3))]) for _ in range(rnd.randint(0, 30))) for _ in range(150)]
    texts += [f"rare{i} pair{i} here{i}" for i in range(40) for _ in range(2)] + [None, "", "a b", "a b"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), order=order, chunk_tokens=chunk_tokens).collect()}
    lists = {k: [*(x or "").encode().split(), lm.END] for k, x in rows}
    taught = [w for k, w in lists.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(tuple(w[i : i + n]) for w in taught for n in range(1, order + 1) for i in range(len(w) - n + 1))
    words = sorted(t[0] for t in count if len(t) == 1)
    number = {w: i for i, w in enumerate(words)}
    tokens = sum(map(len, taught))
    machine = lm.build([(w, count[w,]) for w in words], {tuple(number[t] for t in g): c for g, c in count.items() if len(g) > 1}, tokens, len(words))

    def p(history, word):
        if not history:
            return (count[word,] + 1) / (tokens + len(words) + 1)
        seen = count[history]
        shorter = p(history[1:], word)
        return (count[*history, word] + lm.STRENGTH * shorter) / (seen + lm.STRENGTH) if seen else shorter

    assert len(got) == len(rows)
    for k, w in lists.items():
        plain = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), t)) for i, t in enumerate(w))
        assert math.isclose(got[k].score, plain, rel_tol=1e-9)
        assert math.isclose(got[k].score, got[k].base_score + machine.gain([number.get(t) for t in w]), rel_tol=1e-9)


def test_line_dedup_deletes_short_lines(spark):
    """A single repeated line is a run, however short; a blank line goes with the run it stands in."""
    line = "The and attion to thanedble the, anea. Eriner thanea."
    rows = [(i, f"own{i} line\n{line}\n\nend{i}\nword") for i in range(6)]
    got = {r.doc_id: r.text for r in linededup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own{i} line\nend{i}" for i in range(1, 6))


def test_shard_files_hold_the_slots(spark, tmp_path):
    """Files hold whole records in the order of their slots, which is shuffled, and the query tells what they hold."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    shards.write_shards(docs, str(tmp_path / "s"), shards=3)
    whole = {r.doc_id: r for r in docs.collect()}
    for s in range(3):
        files = sorted((tmp_path / "s" / f"shard={s}").rglob("*.parquet"))
        rows = [r for f in files for r in pq.ParquetFile(f).read().to_pylist()]
        assert [r["slot"] for r in rows] == list(range(len(rows))) and len(rows) > 20
        assert all(r["text"] == whole[r["doc_id"]].text for r in rows)
        order = {r.doc_id: r.order_key for r in shards.dealt(docs.select("doc_id", "text"), shards=3).where(f"shard = {s}").collect()}
        assert [r["doc_id"] for r in rows] != sorted(order, key=order.get)


def test_sharding_reads_back_what_it_wrote(spark, tmp_path, monkeypatch):
    written = []
    write = shards.write_shards
    monkeypatch.setattr(shards, "write_shards", lambda docs, path, *a, **b: (write(docs, path, *a, **b), written.append(path)))
    got = {r.doc_id: (r.shard, r.slot) for r in shards.op9_sharding(spark, D).collect()}
    assert got == {r.doc_id: (r.shard, r.slot) for r in spark.read.parquet(written[0]).collect()} and len(got) == 200


def test_pipeline_line_dedup_keeps_null_texts(spark):
    """A row goes only where lines were deleted, and all of them."""
    rows = [(1, None, 0), (2, "", 0), (3, "some line", 9), (4, "some line", 9)]
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), D)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, None), (2, ""), (3, "some line")]


def test_keep_one_where_keys_repeat(spark):
    """Each group keeps exactly one row, whatever keys its rows share with others."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (None, a)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", a), ("2", b), ("None", c)]
    alone = simhash.keep_one(spark.createDataFrame([(1, a), (None, a), (2, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in alone) == [(1, a), (2, b)]
