"""Operator 8: language-model scoring with a weighted backoff automaton.

Counts cover the whole training text: every word and every n-gram of it, however rare. A state is a
history that was seen; it has an arc for each word that followed, with its smoothed probability, and a
failure arc with the backoff weight to the state of the next shorter history:

    P(w | h) = (c(hw) + S P(w | shorter h)) / (c(h) + S)

and without history the add-one unigram, so every state's probabilities sum to 1. The traversal goes
over each text once from the left. The state it carries into a token is the longest seen history of at
most order - 1 tokens, so the traversals of all texts of a chunk advance together, in arrays.

No executor holds all n-grams. Documents are put into chunks of bounded size, once and for all in a
table. A chunk sends its own distinct n-grams, sorted and packed by ranges of their names, to the tasks
that count; these answer with the counts of those that other chunks have, too. What no other chunk has
is counted in the chunk already, and an n-gram can stand in two chunks only if both n-grams of the next
lower order in it do, so trigrams are asked for only where that holds.

Words and n-grams go by 64-bit hashes; of V of them about V^2 / 2^65 pairs share a name (one in 4 million
tables of three million words has one such pair).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..runtime import new_path, removed, written
from .common import crc_bucket, read_table, released, ship, space_words

ORDER = 3
#: Weight of the shorter history, in tokens; held-out texts score best near it.
STRENGTH = 32.0
#: Tokens in a chunk, bytes of names that one counting task gets, and ranges of names at least.
CHUNK_TOKENS, RANGE_BYTES, RANGES = 300_000, 32 << 20, 64
#: Parts in which names are asked for, one shuffle each, whose files go as soon as its answers are written.
SLICES = 2
#: Distinct words whose names a task remembers.
CACHE_WORDS = 150_000
#: The end token; no word holds a white space.
END = b"\n"


@dataclass
class Automaton:
    """States 0 (no history) and up. arcs: token to (gain over the unigram, next state); fail: (weight, state)."""

    words: dict[bytes, int]
    arcs: list[dict[int, tuple[float, int]]]
    weight: list[float]
    fail: list[int]
    #: Sum of the failure weights from a state down to state 0.
    down: list[float] = field(default_factory=list)

    def gain(self, ids: list[int | None]) -> float:
        """What the states add to the sum of the unigrams' log10 probabilities."""
        total, state = 0.0, 0
        arcs, weight, fail, down = self.arcs, self.weight, self.fail, self.down
        for i in ids:
            if i is None:
                if state:
                    total += down[state]
                    state = 0
                continue
            while True:
                arc = arcs[state].get(i)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                if not state:
                    break
                total += weight[state]
                state = fail[state]
        return total


def build(words: list[tuple[bytes, int]], grams: dict[tuple[int, ...], int], tokens: int, vocabulary: int, strength: float = STRENGTH) -> Automaton:
    """The automaton of words (word, count) and all n-grams of their numbers, held whole, for small corpora.

    The operator has the same arcs and weights in a chunk's arrays.
    """
    unigram = [(c + 1) / (tokens + vocabulary + 1) for _, c in words]
    followers: dict[tuple[int, ...], list[int]] = {}
    for gram in grams:
        followers.setdefault(gram[:-1], []).append(gram[-1])
    states = {(): 0} | {h: i + 1 for i, h in enumerate(sorted(followers, key=lambda h: (len(h), h)))}

    def longest(history: tuple[int, ...]) -> tuple[int, ...]:
        while history not in states:
            history = history[1:]
        return history

    machine = Automaton({w: i for i, (w, _) in enumerate(words)}, [{} for _ in states], [0.0] * len(states), [0] * len(states), [0.0] * len(states))
    machine.arcs[0] = {i: (0.0, states[longest((i,))]) for i in range(len(words))}
    backoff: dict[tuple[int, ...], float] = {}
    chance: dict[tuple[tuple[int, ...], int], float] = {}

    def p(h: tuple[int, ...], w: int) -> float:
        scale = 1.0
        while h:
            if (h, w) in chance:
                return scale * chance[h, w]
            scale *= backoff.get(h, 1.0)
            h = h[1:]
        return scale * unigram[w]

    for h, state in states.items():
        if not h:
            continue
        seen = sum(grams[(*h, w)] for w in followers[h])
        backoff[h] = strength / (seen + strength)
        for w in followers[h]:
            chance[h, w] = grams[(*h, w)] / (seen + strength) + backoff[h] * p(h[1:], w)
            machine.arcs[state][w] = (math.log10(chance[h, w]) - math.log10(unigram[w]), states[longest((*h, w))])
        machine.weight[state] = math.log10(backoff[h])
        machine.fail[state] = states[longest(h[1:])]
        machine.down[state] = machine.weight[state] + machine.down[machine.fail[state]]
    return machine


class _Names(dict):
    """The names of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        name = self[word] = xxh64_intdigest(word)
        return name


def _mix(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The 64-bit names of n-grams from those of their histories and last words."""
    x = history * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: A chunk: its documents' keys, whether each is held out, its tokens, the names of the chunk's distinct words
#: from the most frequent on (unsigned 64-bit) and every token's place among them (unsigned 32-bit, all
#: lowest bytes first and so on, which packs well).
CHUNK = "chunk bigint, keys array<bigint>, held array<boolean>, sizes array<int>, words binary, ids binary"


def _planes(ids: np.ndarray) -> bytes:
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _from_planes(data: bytes, n: int) -> np.ndarray:
    plain = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.frombuffer(plain, np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def _chunks(rows: DataFrame, chunk_tokens: int) -> DataFrame:
    """Rows (k, held, body) in chunks of at least `chunk_tokens` tokens; each task's last one may have fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, end, part, made = _Names(), xxh64_intdigest(END), TaskContext.get().partitionId(), 0
        keys, held, tokens, n = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            words, ids, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            falling = np.argsort(-counts, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[falling] = np.arange(len(words))
            columns = [[(part << 33) + made], [keys], [held], [[len(t) for t in tokens]], [words[falling].tobytes()], [_planes(rank[ids])]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CHUNK.split(", ")])

        for batch in batches:
            for key, out, body in zip(*batch.columns, strict=True):
                words = space_words(body.as_py())
                t = np.empty(len(words) + 1, np.uint64)
                t[:-1] = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
                t[-1] = end
                keys.append(key.as_py())
                held.append(out.as_py())
                tokens.append(t)
                n += len(t)
                if n >= chunk_tokens:
                    yield chunk()
                    made += 1
                    keys, held, tokens, n = [], [], [], 0
        if tokens:
            yield chunk()

    return rows.mapInArrow(released(run), CHUNK)


@dataclass
class _Level:
    """The n-grams of one order of a chunk."""

    #: Distinct names in order, and for every token the place of the n-gram that ends there (one past the last if none does).
    names: np.ndarray
    at: np.ndarray
    #: Whether another chunk may have it, whether one has, and its places in training rows: of the chunk, then of all.
    asked: np.ndarray
    shared: np.ndarray
    n: np.ndarray


class _Chunk:
    """A chunk's tokens in arrays: where texts start, each token's place in its text, whether its row teaches (1 or 0)."""

    def __init__(self, row: dict) -> None:
        sizes = np.array(row["sizes"], np.int64)
        self.row, self.number = row, row["chunk"]
        self.starts = np.cumsum(sizes) - sizes
        self.place = np.arange(sizes.sum()) - np.repeat(self.starts, sizes)
        self.taught = np.repeat(~np.array(row["held"], bool), sizes).astype(np.float64)
        words = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.at = words[order], rank[_from_planes(row["ids"], len(self.place))]

    def level(self, n: int, before: _Level | None) -> _Level:
        """The n-grams of order n, before any answer."""
        here = np.flatnonzero(self.place >= n - 1)
        if before is None:
            names, at = self.words, self.at
        else:
            names, inner = np.unique(_mix(before.names[before.at[here - 1]], self.words[self.at[here]]), return_inverse=True)
            at = np.full(len(self.place), len(names))
            at[here] = inner
        asked = np.ones(len(names), bool)
        if n > 2:
            asked[:] = False
            asked[at[here[before.shared[before.at[here - 1]] & before.shared[before.at[here]]]]] = True
        counts = np.bincount(at[here], self.taught[here], len(names)).astype(np.int64)
        return _Level(names, at, asked, np.zeros(len(names), bool), counts)

    def levels(self, told: pa.Table, order: int, bits: int) -> list[_Level]:
        """The levels up to `order` with their answers."""
        answers = {r: (s, t) for r, s, t in zip(told.column("range").to_pylist(), told.column("shared").to_pylist(), told.column("totals").to_pylist())}
        levels: list[_Level] = []
        for n in range(1, order + 1):
            levels.append(_learned(n, self.level(n, levels[-1] if levels else None), answers, bits))
        return levels


def _ranges(level: _Level, bits: int, part: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the asked names in order (of one slice), the ranges of names that have any, and where these start among the places."""
    places = np.flatnonzero(level.asked)
    of = level.names[places] >> np.uint64(64 - bits)
    if part is not None:
        mine = of % np.uint64(SLICES) == part
        places, of = places[mine], of[mine]
    starts = np.flatnonzero(np.diff(of, prepend=np.uint64(1 << bits)))
    return places, of[starts].astype(np.int64), starts


#: What a chunk asks: the range of names (the order and the leading bits), the names, their training places in the chunk.
ASK = "range bigint, chunk bigint, names binary, counts binary"
#: What it is told: which of the names another chunk has (packed bits) and how many training places these have in all.
#: Beside these, with a null chunk, the sum of all places of the range and the number of names that have any.
TELL = "range bigint, chunk bigint, shared binary, totals binary, places bigint, distinct bigint"


def _asked(n: int, level: _Level, chunk: int, bits: int, part: int) -> pa.Table:
    places, ranges, starts = _ranges(level, bits, part)
    ends = np.append(starts[1:], len(places))
    names, counts = level.names[places], level.n[places].astype("<u4")
    return pa.table({
        "range": pa.array(ranges + (n << bits), pa.int64()), "chunk": pa.array(np.full(len(ranges), chunk), pa.int64()),
        "names": pa.array([names[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
    })


def _told(table: pa.Table) -> pa.Table:
    """Counts all names of one range and answers every chunk that asked."""
    blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("names")]
    names, own = np.concatenate(blobs), np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("counts")])
    order = np.argsort(names)
    ordered = names[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sums, chunks = np.add.reduceat(own[order], first, dtype=np.int64), np.diff(first, append=len(names))
    total, many = np.empty(len(names), np.int64), np.empty(len(names), bool)
    total[order], many[order] = np.repeat(sums, chunks), np.repeat(chunks > 1, chunks)
    at, shared, totals, who = 0, [], [], []
    for chunk, blob in zip(table.column("chunk"), blobs):
        some, all_ = many[at : at + len(blob)], total[at : at + len(blob)]
        at += len(blob)
        if some.any():
            who.append(chunk.as_py())
            shared.append(np.packbits(some).tobytes())
            totals.append(all_[some].tobytes())
    size, number = len(who), table.column("range")[0].as_py()
    return pa.table({
        "range": pa.array([number] * (size + 1), pa.int64()), "chunk": pa.array([*who, None], pa.int64()), "shared": pa.array([*shared, None], pa.binary()), "totals": pa.array([*totals, None], pa.binary()),
        "places": pa.array([None] * size + [int(sums.sum())], pa.int64()), "distinct": pa.array([None] * size + [int((sums > 0).sum())], pa.int64()),
    })


def _learned(n: int, level: _Level, answers: dict[int, tuple[bytes, bytes]], bits: int) -> _Level:
    """The level with the answers to its ranges."""
    places, ranges, starts = _ranges(level, bits)
    for number, a, b in zip(ranges.tolist(), starts, np.append(starts[1:], len(places))):
        if (answer := answers.get(number + (n << bits))) is not None:
            some = places[a:b][np.unpackbits(np.frombuffer(answer[0], np.uint8), count=b - a).astype(bool)]
            level.shared[some] = True
            level.n[some] = np.frombuffer(answer[1], np.int64)
    # The place one past the last stands for tokens without an n-gram.
    level.shared, level.n = np.append(level.shared, False), np.append(level.n, 0)
    return level


def score_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, strength: float = STRENGTH, chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """`key`, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null text counts as empty: one token, the end. A null key is not held out and is learned from.
    Rows that repeat count and are scored each for itself. Without training rows no token is known and
    scores are those of the one unknown class. `key` is an integer column; other columns may have any
    name. The rows are written to the shared folder and stay there; working tables are deleted, after a
    failure too.
    """
    if order < 2 or strength <= 0:
        raise ValueError("n-grams have two words or more and the shorter history has a weight")
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    held = F.coalesce(crc_bucket(F.col(f"`{key}`"), 7) == 2, F.lit(False))
    folder = new_path(spark, "lm")
    try:
        taught = _score(docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), held.alias("held"), body.alias("body")), folder, order, strength, chunk_tokens)
    except BaseException:
        removed(spark, folder)
        raise
    out = spark.read.schema(SCORES).parquet(f"{folder}/scores")
    return out.select(F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(taught).cast("bigint").alias("train_tokens"), "base_score", "score")


SCORES = "k bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(rows: DataFrame, folder: str, order: int, strength: float, chunk_tokens: int) -> int:
    """Writes the scores of rows (k, held, body) into the folder and returns the number of training tokens."""
    spark = rows.sparkSession
    chunks = written(_chunks(rows, chunk_tokens), f"{folder}/chunks", compression="zstd")
    tokens = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
    bits = (max(-(-tokens * 12 // RANGE_BYTES), RANGES) - 1).bit_length()

    def ask_first(part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    chunk = _Chunk(batch.slice(i, 1).to_pylist()[0])
                    words = chunk.level(1, None)
                    yield from _asked(1, words, chunk.number, bits, part).to_batches()
                    yield from _asked(2, chunk.level(2, words), chunk.number, bits, part).to_batches()

        return released(run)

    def ask(n: int, part: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"range": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "names": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
            chunk = _Chunk(left.to_pylist()[0])
            return _asked(n, chunk.level(n, chunk.levels(right, n - 1, bits)[-1]), chunk.number, bits, part)

        return run

    beside = lambda told: chunks.groupBy("chunk").cogroup(told.where("chunk is not null").select("range", "chunk", "shared", "totals").groupBy("chunk"))

    def answers(n: int, asked: Callable[[int], DataFrame]) -> DataFrame:
        paths = [f"{folder}/told-{n}-{part}" for part in range(SLICES)]
        for part, path in enumerate(paths):
            written(asked(part).groupBy("range").applyInArrow(_told, TELL), path, compression="zstd")
        return spark.read.schema(TELL).parquet(*paths)

    told = first = answers(2, lambda part: chunks.mapInArrow(ask_first(part), ASK))
    for n in range(3, order + 1):
        before = told
        told = before.union(answers(n, lambda part: beside(before).applyInArrow(ask(n, part), ASK)))
    sums = first.where((F.shiftright("range", bits) == 1) & F.col("chunk").isNull()).agg(F.sum("places"), F.sum("distinct")).first()
    taught, vocabulary = sums[0] or 0, sums[1] or 0
    floor = taught + vocabulary + 1

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["k", "held_out", "n_tokens", "n_known", "base_score", "score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        row = left.to_pylist()[0]
        chunk = _Chunk(row)
        starts, place, levels = chunk.starts, chunk.place, chunk.levels(right, order, bits)
        n = levels[0].n[levels[0].at]
        p = (n + 1) / floor
        base, known = np.add.reduceat(np.log10(p), starts), np.add.reduceat((n > 0).astype(np.int64), starts)
        for shorter, level in zip(levels, levels[1:]):
            # Where this history was not seen, its state doesn't exist and that of the shorter one decides.
            history = np.zeros(len(p), np.int64)
            history[1:] = shorter.n[shorter.at[:-1]]
            history[starts] = 0
            here = np.flatnonzero((history > 0) & (place >= 1))
            p[here] = (level.n[level.at[here]] + strength * p[here]) / (history[here] + strength)
        columns = [row["keys"], row["held"], row["sizes"], known, base, np.add.reduceat(np.log10(p), starts)]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    written(beside(told).applyInArrow(score, SCORES), f"{folder}/scores")
    removed(spark, f"{folder}/chunks", *[f"{folder}/told-{n}-{part}" for n in range(2, order + 1) for part in range(SLICES)])
    return taught


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents."""
    return score_documents(read_table(spark, sf_dir, "documents"))
