"""Operator 5: token ids packed into fixed rows by best-fit decreasing.

Documents are encoded, split into pieces no longer than a row where needed, and packed: pieces in
order of falling length each go to the open row with the least room that still holds them. A segment
tree over room, a leaf for every amount of room, finds that row in logarithmic time. Packing runs over
blocks of bounded size of each scan partition, so nothing is shuffled and memory doesn't grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import new_path, written
from .bpe import parse_ranks, shared_codec
from .common import read_table, released, ship

#: Tokens in a row, and tokens that are packed together. A block's last rows alone have room to spare.
ROW_TOKENS, BLOCK_TOKENS = 2048, 4_000_000
#: Characters up to which a text goes to tiktoken, whose pattern search gives up on very long runs; longer ones go to
#: operator 10's encoder. Both give the same ids, so this is a choice of time alone.
FAST_CHARS = 500_000


@lru_cache(maxsize=2)
def _fast(data: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={})


class Room:
    """Open rows by their room; a segment tree that counts them tells the smallest room that suffices."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns a row with the smallest room of at least `least`, and that room."""
        i = least + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        if room >= len(self.rows):
            return None
        self._count(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every piece has between 1 and `capacity` tokens."""
    rows: list[list[int]] = []
    room = Room(capacity)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[piece])
        row, left = found if found else (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(piece)
        if left > lengths[piece]:
            room.put(left - lengths[piece], row)
    return rows


SCHEMA = (
    "pack_id bigint, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_offsets array<bigint>, doc_tokens array<bigint>"
)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS, pad_id: int = 50256, vocabulary: str | None = None, pattern: str | None = None, fast_chars: int = FAST_CHARS) -> DataFrame:
    """Packed rows of token ids.

    input_ids holds row_tokens little-endian unsigned 32-bit ids, padded with pad_id after n_tokens;
    cu_seqlens the cumulative segment lengths from 0; position_resets where positions start again at
    0 (each segment's start, and the padding's); doc_ids, doc_offsets and doc_tokens say which document
    each segment is from, at which token of it, and how many tokens the document has, so documents can
    be put together again. Longer documents are split at multiples of row_tokens. Null and empty texts
    have no tokens and get one entry with a zero-length segment in a row of their own kind, so no
    document is lost. Documents that repeat are packed each for itself, and pieces of equal length go in
    the order of the scan; an empty table gives no row. Other columns may have any name. Which documents
    share a block depends on the scan's splits; write_packed fixes it.
    """
    ship(docs.sparkSession)
    codec, shared, pattern = shared_codec(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, fast = TaskContext.get().partitionId(), 0, _fast(shared.value, pattern)

        def encode(text: str) -> bytes:
            # Both give the same ids; the library is the faster one.
            return fast.encode_to_numpy(text).astype("<u4").tobytes() if len(text) <= fast_chars else codec().encode(text)

        def packed(block: list[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            pieces = []  # document, first token, ids, the document's tokens
            for doc, ids in block:
                n = len(ids) // 4
                pieces += [(doc, at, ids[4 * at : 4 * (at + row_tokens)], n) for at in range(0, n, row_tokens)]
                if not n:
                    pieces.append((doc, 0, b"", 0))
            full = [i for i, p in enumerate(pieces) if p[2]]
            rows = [[full[i] for i in row] for row in best_fit_decreasing([len(pieces[i][2]) // 4 for i in full], row_tokens)]
            if empty := [i for i, p in enumerate(pieces) if not p[2]]:
                rows += [empty[i : i + row_tokens] for i in range(0, len(empty), row_tokens)]
            for at in range(0, len(rows), 1000):
                out: list[list] = [[] for _ in range(8)]
                for row in rows[at : at + 1000]:
                    ids = b"".join(pieces[i][2] for i in row)
                    ends = np.cumsum([0] + [len(pieces[i][2]) // 4 for i in row]).tolist()
                    n = ends[-1]
                    pad = np.full(row_tokens - n, pad_id, "<u4").tobytes()
                    resets = sorted({e for e in ends[:-1] if e < n} | ({n} if n < row_tokens else set()))
                    for c, v in zip(out, ((part << 33) + made, n, ids + pad, ends, resets, [pieces[i][0] for i in row], [pieces[i][1] for i in row], [pieces[i][3] for i in row]), strict=True):
                        c.append(v)
                    made += 1
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        block: list[tuple[int | None, bytes]] = []
        tokens = 0
        for batch in batches:
            for doc, data in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py()
                ids = encode(data.decode()) if data else b""
                block.append((doc.as_py(), ids))
                tokens += len(ids) // 4 + 1
                if tokens >= block_tokens:
                    yield from packed(block)
                    block, tokens = [], 0
        if block:
            yield from packed(block)

    return docs.select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`").cast("binary")).mapInArrow(released(run), SCHEMA)


def write_packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Writes the packed rows of pack() as Parquet and returns them as they stand there: id matrix, cumulative lengths, resets."""
    return written(pack(docs, key, text, **options), path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents in packed rows of token ids, as written to the shared folder, where they stay."""
    return write_packed(read_table(spark, sf_dir, "documents"), new_path(spark, "packed"))
