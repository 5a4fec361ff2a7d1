"""Every operator against a plain version, over the smallest tables or random fixtures."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from heddle.llm import bpe, decontaminate, fingerprint, graph, langid, licenses, linededup, lm, packing, shards, simhash

D = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect())


def words(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


def groups_of(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in fingerprint.op1_fingerprints(spark, D).collect()}
    near, lanes = [], {}
    cosine = lambda a, b: 0.0 if not (a @ a and b @ b) else min(1.0, max(0.0, (a @ b) / math.sqrt((a @ a) * (b @ b))))
    for i, (k, x) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        m = len(x) // 4
        edited = x[: len(x) - m] + following[:m]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert got[k].fingerprint == plain_fingerprint(x)
        assert got[k].edited_fingerprint == plain_fingerprint(edited)
        for t in (x, following, edited):
            lanes.setdefault(t, plain_signs(t))
        assert math.isclose(got[k].near_edited, 1.0 if plain_fingerprint(edited) == plain_fingerprint(x) else cosine(lanes[x], lanes[edited]), abs_tol=1e-9)
        assert math.isclose(got[k].near_next, 1.0 if plain_fingerprint(following) == plain_fingerprint(x) else cosine(lanes[x], lanes[following]), abs_tol=1e-9)
        near.append((got[k].near_edited, got[k].near_next, len(x)))
    long = [(a, b) for a, b, n in near if n > 300]
    assert np.mean([a for a, _ in long]) > 0.65 and np.mean([b for _, b in long]) < 0.15
    assert np.mean([a > b for a, b in long]) > 0.97


def plain_fingerprint(text):
    h = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    after = lambda number: h(number.to_bytes(4, "little"), 42)  # noqa: E731  Spark's hash of an integer
    equal, counts = [0] * 8, [0] * 128
    for para in text.split("\n"):
        for seed in range(4):
            v = h(para.encode(), spark_int(seed))
            equal[2 * seed] += v & 0xFFFFFFFF
            equal[2 * seed + 1] += v >> 32
        w = para.split(" ")
        for i in range(len(w)):
            g = 42
            for x in w[i : i + 3]:
                g = h(x.encode(), g)
            g2 = spark_long(g, spark_int(1))
            for half, v in enumerate((g, g2)):
                for b in range(64):
                    counts[64 * half + b] += v >> b & 1
    pairs = [counts[64 * half + b] | counts[64 * half + b + 32] << 32 for half in (0, 1) for b in range(32)]
    return "".join(f"{e & 0xFFFFFFFF:08x}" for e in equal) + "".join(f"{p:016x}" for p in pairs)


def plain_signs(text):
    """Twice each bit's count less the number of shingles, from the fingerprint's pairs of lanes."""
    pairs = [int(plain_fingerprint(text)[64 + 16 * i : 80 + 16 * i], 16) for i in range(64)]
    n = sum(len(para.split(" ")) for para in text.split("\n"))
    return np.array([2 * (p & 0xFFFFFFFF) - n for p in pairs] + [2 * (p >> 32) - n for p in pairs], float)


def spark_int(value, seed=42):
    """XXH64 of four bytes."""
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def spark_long(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little"), seed)


def test_fingerprint_is_homomorphic(spark):
    """Order has no bearing, and paragraphs' sums add up to the text's."""
    a, b = "one two three\nfour five", "four five\none two three"
    rows = spark.createDataFrame([(1, a), (2, b), (3, "one two three"), (4, "four five")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.sum_vectors(rows, ["doc_id"], "text").collect()}
    assert (got[1].e, got[1].v) == (got[2].e, got[2].v)
    assert got[1].v == [x + y for x, y in zip(got[3].v, got[4].v, strict=True)]
    assert got[1].e == [(x + y) & 0xFFFFFFFF for x, y in zip(got[3].e, got[4].e, strict=True)]


def test_simhash(spark, docs):
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, D).collect()}
    prints = {}
    for k, x in docs:
        w = words(SPACED, x)
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[k].fingerprint == f"{prints[k]:016x}"
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {k: r.component_id for k, r in got.items()} == groups_of(prints, linked)


@pytest.mark.parametrize("radius,parities", [(4, simhash.PARITIES), (4, ()), (2, (0x5555,)), (0, ())])
def test_links_find_everything(spark, radius, parities):
    """Dense clusters, whatever the slices."""
    rnd = random.Random(3)
    prints = set()
    for _ in range(12):
        center = rnd.getrandbits(64)
        for _ in range(14):
            x = center
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                x ^= 1 << b
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.component for r in graph.connected_components(simhash.links(df, radius, parities)).collect()}
    linked = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    expected = {n: c for n, c in groups_of(signed, linked).items() if any(n in p for p in linked)}
    assert got == expected


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    proper = [(a, b) for a, b in edges if a != b]
    assert got == groups_of({n for e in proper for n in e}, proper)


def test_decontamination(spark, docs):
    got = {r.doc_id: r for r in decontaminate.contamination(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet"), ["doc_id"]).collect()}
    items = {}
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = words(ALNUM, r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            items.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id))
    for k, x in docs:
        w, hit, names = words(ALNUM, x), set(), set()
        for size in {len(i) for i in items}:
            for i in range(len(w) - size + 1):
                if found := items.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert sum(len(words(ALNUM, x[s.start : s.end])) for s in r.spans) == len(hit)
    assert sum(r.contaminated for r in got.values()) > 0


def test_decontamination_in_blocks(spark):
    """A benchmark that is dealt over several automata gives the same, spans included; long items are cut without losing a window."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = spark.read.parquet(f"{D}/benchmark.parquet")
    one = {r.doc_id: r for r in decontaminate.contamination(docs, items, ["doc_id"]).collect()}
    size = sum(len(r.text or "") for r in items.collect())
    many = {r.doc_id: r for r in decontaminate.contamination(docs, items, ["doc_id"], block_bytes=size // 4).collect()}
    assert one == many and any(r.contaminated for r in one.values())
    whole = items.agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).withColumn("item_id", F.lit("all"))
    a = {r.doc_id: (r.n_hit, r.spans) for r in decontaminate.contamination(docs, whole, ["doc_id"]).collect()}
    b = {r.doc_id: (r.n_hit, r.spans) for r in decontaminate.contamination(docs, whole, ["doc_id"], block_bytes=size // 3).collect()}
    assert a == b


def test_windows_against_plain():
    """Random items and texts over few words, for several windows."""
    rnd = random.Random(1)
    for _ in range(400):
        window = rnd.choice([2, 3, 4, 5, 10])
        items = [(str(i % 4), [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(0, 25))]) for i in range(rnd.randint(0, 6))]
        text = [rnd.choice([b"a", b"b", b"c", b"d", b"x"]) for _ in range(60)]
        hit, names = set(), set()
        for name, item in items:
            for i in range(max(1, len(item) - window + 1) if item else 0):
                part = item[i : i + window]
                for j in range(len(text) - len(part) + 1):
                    if text[j : j + len(part)] == part:
                        hit |= set(range(j, j + len(part)))
                        names.add(name)
        runs, found = decontaminate.Windows(items, window).scan(text)
        assert {x for a, b in runs for x in range(a, b)} == hit and found == names


def test_windows_with_many_words():
    """More distinct words than there are characters; each automaton is built once for its task."""
    items = [(str(i), [b"w%d" % (100 * i + j) for j in range(100)]) for i in range(12_000)]
    windows = decontaminate.Windows(items, 10)
    assert len(windows.code) == 1_200_000
    assert windows.scan([b"w%d" % k for k in range(1_150_005, 1_150_030)]) == ([(0, 25)], {"11500"})
    assert windows.scan([b"w5", b"w7"] * 20) == ([], set())


def test_language_held_out(spark):
    rows = langid.op4_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_language_never_learns_from_held_out(spark):
    """Other labels and texts of held-out rows change nothing."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    changed = docs.withColumns({"lang": F.when(held, "xx").otherwise(F.col("lang")), "text": F.when(held, "zzz").otherwise(F.col("text"))})
    a, b = langid._learn(docs), langid._learn(changed)
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.threshold == b.threshold


def test_packing_rows():
    rnd = random.Random(2)
    for cap in (1, 7, 64, 100):
        for _ in range(60):
            sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 60))]
            got = packing.best_fit_decreasing(sizes, cap)
            room = []
            for size in sorted(sizes, reverse=True):
                fits = [r for r in room if r >= size]
                if fits:
                    room.remove(min(fits))
                    room.append(min(fits) - size)
                else:
                    room.append(cap - size)
            assert sorted(p for r in got for p in r) == list(range(len(sizes)))
            assert sorted(cap - sum(sizes[p] for p in r) for r in got) == sorted(room)


def test_packing_round_trip(spark, docs):
    codec = bpe.BytePairCodec(bpe.parse_ranks(open(P.path(bpe.VOCABULARY), "rb").read()), P.PATTERN)
    parts = {}
    for r in packing.pack(spark.read.parquet(f"{D}/documents.parquet"), row_tokens=300, block_tokens=20_000).collect():
        ids = np.frombuffer(r.input_ids, "<u4")
        assert len(ids) == 300 and (ids[r.n_tokens :] == 50256).all()
        assert set(r.position_resets) >= set(r.cu_seqlens[:-1]) - {r.n_tokens}
        for a, b, doc, at in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_offsets):
            parts.setdefault(doc, []).append((at, ids[a:b].tobytes()))
    assert {k: codec.decode(b"".join(p for _, p in sorted(v))) for k, v in parts.items()} == {k: x.encode() for k, x in docs}


def test_license_base(spark, docs):
    extra = [(10_000 + i, x) for i, x in enumerate(["CC by cc BY", "all rights\nreserved. GENERAL Public license", "redistribution and use in source or binary forms with or without any modification are permitted provided that the following conditions are met"])]
    rows = spark.createDataFrame(docs + extra, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(rows, ["doc_id"]).collect()}
    for k, x in docs + extra:
        w, places, labels = words(ALNUM, x), [], set()
        for phrase, label in licenses.PHRASES:
            q = phrase.split()
            for i in range(len(w) - len(q) + 1):
                if w[i : i + len(q)] == q:
                    places.append(i)
                    labels.add(label)
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)
    assert got[10_002].labels == "bsd" and 0.75 <= got[10_002].score < 1  # two words changed, one added


def brute_lines(rows, least):
    rows = sorted(rows)
    seqs = [x.split("\n") for _, x in rows]
    gone = [set() for _ in seqs]
    places = {}
    for a, lines in enumerate(seqs):
        for p, line in enumerate(lines):
            for b, q in places.get(line, ()):
                m = 0
                while p + m < len(lines) and q + m < len(seqs[b]) and lines[p + m] == seqs[b][q + m]:
                    m += 1
                if sum(len(SPACED.findall(t)) for t in lines[p : p + m]) >= least:
                    gone[a] |= set(range(p, p + m))
            places.setdefault(line, []).append((a, p))
    return {k: (len(lines), len(gone[a]), "\n".join(t for i, t in enumerate(lines) if i not in gone[a])) for a, ((k, _), lines) in enumerate(zip(rows, seqs))}


@pytest.mark.parametrize("least", [3, 9])
def test_line_dedup(spark, least):
    rnd = random.Random(least)
    line = lambda: rnd.choice(["a b", "c", "d e f", "", "g h", "i"]) if rnd.random() < 0.6 else f"u{rnd.random()} x"
    rows = [(i, "\n".join(line() for _ in range(rnd.randint(1, 14)))) for i in range(60)]
    rows += [(100 + i, "c\nd e f\n\ng h\ni\na b\nc\n\n\nd e f") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in linededup.dedupe_lines(df, min_words=least).collect()}
    assert got == brute_lines(rows, least)


def test_lm_counts(spark, docs):
    got = {r.doc_id: r for r in lm.op8_lm_scores(spark, D).collect()}
    c = Counter()
    for k, x in docs:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update([*words(SPACED, x), "\n"])
    n, v = sum(c.values()), len(c)
    for k, x in docs:
        tokens = [*words(SPACED, x), "\n"]
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 7 == 2, len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_lm_automaton_is_a_distribution():
    """From every state the next token's probabilities sum to 1."""
    rnd = random.Random(4)
    text = [rnd.choice("aabbbccd") for _ in range(4000)]
    c1, c2, c3 = Counter(text), Counter(zip(text, text[1:])), Counter(zip(text, text[1:], text[2:]))
    order = sorted(c1)
    number = {w: i for i, w in enumerate(order)}
    grams = {tuple(number[w] for w in g): n for c in (c2, c3) for g, n in c.items()}
    n, v = len(text), len(c1)
    machine = lm.build([(w.encode(), c1[w]) for w in order], grams, n, v)
    base = {i: math.log10((c1[w] + 1) / (n + v + 1)) for w, i in number.items()}
    for history in [(), *((i,) for i in range(v)), *((i, j) for i in range(v) for j in range(v))]:
        before = machine.gain(list(history))
        total = sum(10 ** (base[w] + machine.gain([*history, w]) - before) for w in range(v))
        unknown = 10 ** (math.log10(1 / (n + v + 1)) + machine.gain([*history, None]) - before)
        # The end token is a word like any other here, so known words and one unknown class are all there is.
        assert math.isclose(total + unknown, 1, abs_tol=1e-9)


def test_shards(spark, docs):
    got = {r.doc_id: r for r in shards.op9_sharding(spark, D).collect()}
    for k, x in docs:
        assert (got[k].size, got[k].text_crc32) == (len(x.encode()) + 8, zlib.crc32(x.encode()))
        weights = [xxhash.xxh64_intdigest(k.to_bytes(8, "little"), spark_int(shards.SEED + i)) for i in range(25)]
        signed = [w - (1 << 64) if w >> 63 else w for w in weights]
        assert got[k].shard == signed[:24].index(max(signed[:24])) and got[k].grown_shard in (got[k].shard, 24)
    for s in range(24):
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shard_files(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    shards.write_shards(docs, str(tmp_path / "s"), shards=5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count() and back.select("shard").distinct().count() == 5


def test_bpe(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.op10_byte_bpe(spark, D).collect()}
    for k, x in docs:
        ids = np.array(enc.encode_ordinary(x), "<u4")
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(x.encode()).hexdigest()


def test_bpe_random_strings():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.BytePairCodec(ranks, P.PATTERN)
    rnd = random.Random(1)
    letters = " \n\tabcdeéñthing'srellve0123½² 　漢字😀\x1c\x85.,!-_="
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(5000)]
    for x in [*texts, "a" * 5000, "ab" * 3000, " " * 3000, "the" * 2000, "\n\n x", "=-" * 2000]:
        assert enc.encode_ordinary(x) == np.frombuffer(codec.encode(x), "<u4").tolist()


def test_pipeline(spark, docs):
    """All stages against plain ones; only the trained classifier's decisions are taken as they are."""
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    documents = spark.read.parquet(f"{D}/documents.parquet")
    kept = {r.doc_id for r in langid.keep_known(documents).select("doc_id").collect()}
    rows = brute_lines([(k, x) for k, x in docs if k in kept], linededup.MIN_WORDS)
    rows = {k: text for k, (n, gone, text) in rows.items() if gone < n}
    prints = {k: simhash.simhash(x.encode()) & (1 << 64) - 1 for k, x in rows.items()}
    group = groups_of(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    items = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = words(ALNUM, r.text)
        items |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(i) for i in items}
    clean = lambda w: not any(tuple(w[i : i + s]) in items for s in sizes for i in range(len(w) - s + 1))
    left = {k: x for k, x in rows.items() if group[k] == k and clean(words(ALNUM, x))}
    assert {k: r.decoded_sha256 for k, r in got.items()} == {k: hashlib.sha256(x.encode()).hexdigest() for k, x in left.items()}
    assert len(left) < len(docs)


def test_edges_are_links(spark):
    """Every edge is a link, and two fingerprints alone have the edge."""
    rnd = random.Random(8)
    prints = {rnd.getrandbits(62) for _ in range(40)}
    pairs = {(p, p ^ sum(1 << b for b in rnd.sample(range(62), rnd.randint(1, 6)))) for p in prints}
    df = spark.createDataFrame([(x,) for pair in pairs for x in pair], "fp long").distinct()
    found = {tuple(r) for r in simhash.links(df).collect()}
    assert found == {(min(p), max(p)) for p in pairs if (p[0] ^ p[1]).bit_count() <= 4}
