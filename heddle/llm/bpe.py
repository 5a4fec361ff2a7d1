"""Operator 10: byte-level BPE encoding and decoding in linear time.

Bytes become Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds every
token that occurs in a piece. An encoding is read off from the left: take the longest token at a
position; if it may not stand after its left neighbour, or if the rest has no encoding, take the next
shorter one. A pair of neighbours is allowed if the merges, applied to their joined bytes, give just
the pair; that depends on the pair alone and is memoised. The encoding whose neighbours are all
allowed is unique and is the one the merges give.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, read_table

#: Words kept with their ids in each of two generations, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 125_000, 48
#: Pairs of neighbours remembered.
CACHE_PAIRS = 500_000
VOCABULARY = "byte_bpe_50k.tiktoken"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file in tiktoken's format: base64 of the token, a space, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class _Spaced(dict):
    """Ids, as little-endian bytes, of words with a prefix; computed when first asked for.

    When a generation of words is full the one before it is forgotten; what is asked for again moves on.
    """

    def __init__(self, prefix: str, encode) -> None:
        super().__init__()
        self.prefix, self.encode = prefix, encode
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(self.prefix + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class BytePairCodec:
    """Encodes texts to ids and decodes ids to bytes; exact, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = [len(t) for t in self.token]
        self.halves = self._halves()
        self.joined = {pair: rank for rank, pair in enumerate(self.halves) if pair and pair[0] != pair[1] or pair and self.length[rank] > 1}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            if len(token) == 1 or self.halves[rank]:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.allowed: dict[tuple[int, int], bool] = {}
        self.shorter = [self._shorter(t) for t in self.token]
        self.pieces = _Spaced("", self._ids)
        self.first, self.spaced = _Spaced("", self._chunk), _Spaced(" ", self._chunk)
        self.runs = re.compile(r"\s\s").search

    def _halves(self) -> list[tuple[int, int] | None]:
        """For each token the two tokens that its last merge joins; for a byte, itself twice.

        A token that the merges never make (its bytes end as more than two parts) has None.
        """
        halves: list[tuple[int, int] | None] = [None] * len(self.token)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                halves[rank] = (rank, rank)
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
                if best[0] >= rank:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2 and all(p in self.ranks for p in parts):
                halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return halves

    def _shorter(self, token: bytes) -> int:
        """The longest token that is a proper prefix of a token; -1 if there is none."""
        return next((r for k in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:k], -1)) >= 0 and self.halves[r]), -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two.

        The merges are undone from the latest on, on the sides that face the boundary. If at any
        moment the two facing parts have a merge that comes before the next one undone, the merges
        would have crossed the boundary.
        """
        key = (left, right)
        if (known := self.allowed.get(key)) is not None:
            return known
        # Of equal merges the leftmost goes first, hence a merge on the right side counts as later.
        before, good = 1 << 62, True
        while True:
            crossing = self.joined.get((left, right))
            if crossing is not None and 2 * crossing + 1 < before:
                good = False
                break
            single_left, single_right = self.length[left] == 1, self.length[right] == 1
            if single_left and single_right:
                break
            if single_right or not single_left and left > right:
                before = 2 * left
                left = self.halves[left][1]
            else:
                before = 2 * right + 2
                right = self.halves[right][0]
        if len(self.allowed) >= CACHE_PAIRS:
            self.allowed.clear()
        self.allowed[key] = good
        return good

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        length, allowed, shorter = self.length, self.allowed, self.shorter
        # Matches come by their end, so the last one kept for a start is the longest.
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[token] + 1] = token
        n, at, last, path, dead = len(piece), 0, -1, [], set()
        token = longest[0]
        while at < n:
            while token >= 0:
                if at + length[token] not in dead:
                    if last < 0:
                        break
                    ok = allowed.get((last, token))
                    if ok or ok is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += length[token]
                last = token
                if at < n:
                    token = longest[at]
            else:
                dead.add(at)
                token = path.pop()
                at -= length[token]
                last = path[-1] if path else -1
                token = shorter[token]
        return path

    def _ids(self, piece: str) -> bytes:
        ids = self._piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, text: str) -> bytes:
        found = self.find(text)
        # What is one piece is remembered by the caller already.
        return self._ids(found[0]) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Where no two white-space characters stand together, every match of the pattern lies within one
        space and the run up to the next space, so the text is cut at spaces and words are looked up.
        """
        if self.runs(text):
            return self._chunk(text)
        words = text.split(" ")
        if len(words) == 1:
            return self.first[text]
        return self.first[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(data: bytes, pattern: str) -> BytePairCodec:
    return BytePairCodec(parse_ranks(data), pattern)


def shared_codec(spark: SparkSession, vocabulary: str | None = None, pattern: str | None = None):
    """A function that executors call for the codec, the broadcast vocabulary file and the pattern.

    The vocabulary file is read on the driver and broadcast, so executors need no copy; its size is
    that of the file, which doesn't depend on the corpus.
    """
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    pattern = pattern or public_tokenizers.PATTERN
    return (lambda: _codec(shared.value, pattern)), shared, pattern


def encode_documents(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """`keep`, n_tokens, ids (little-endian unsigned 32-bit integers, if asked for), ids_sha256, decoded_sha256 of every text.

    A null text counts as empty: no ids, the hashes of no bytes. Texts of any length are encoded whole.
    Repeated rows give repeated results. Columns may have any name; a kept one named like a result gets
    _doc at its end.
    """
    codec, _, _ = shared_codec(docs.sparkSession, vocabulary, pattern)

    def make():
        c = codec()

        def each(data: bytes | None) -> tuple:
            ids = c.encode(data.decode()) if data else b""
            digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()
            return (len(ids) // 4, *([ids] if with_ids else []), *digests)

        return each

    fields = [("n_tokens", T.LongType()), *([("ids", T.BinaryType())] if with_ids else []), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_texts(docs, text, keep, fields, make)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded."""
    return encode_documents(read_table(spark, sf_dir, "documents"), ["doc_id"], with_ids=False)
