"""Operator 3: benchmark decontamination with one Aho-Corasick automaton.

Words of the items become numbers of a few digits. The automaton holds short stretches of the items at a fixed stride,
chosen so that every window of an item contains one of them whole; items shorter than a window stand in
it whole. One scan of a document's words meets every stretch that occurs; each is extended to both sides
as long as document and item agree, and counts where at least a window agrees. So the automaton has
a few states for each word of the items, whatever the window. Offsets of hit words are mapped back to
characters of the original text.

The automaton is as large as the items. Its broadcast is bounded: a benchmark beyond the bound is dealt
into blocks, and the documents go through one scan with one automaton for each block, one after another.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import new_path, written
from .common import alnum_words, free_names, read_table, released, ship

WINDOW = 10
#: Bytes of normalised items in one block, so in one automaton and one broadcast.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _digits(words: set[bytes]) -> dict[bytes, str]:
    """A number for every word, in as many digits of 64 as the largest needs.

    A state finds its next one by looking through its arcs, so digits keep these few, at the root too. Each
    place has digits of its own, so matches begin and end with words.
    """
    count = 1
    while 64**count < len(words):
        count += 1
    return {w: "".join(chr(1 + 64 * k + (n >> 6 * k & 63)) for k in range(count)) for n, w in enumerate(sorted(words))}


class Windows:
    """The windows of items (name, words). An item of fewer words than a window, but not none, is one window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        size = (window + 1) // 2
        #: Of any window - size + 1 places in a row, one is a multiple of the stride.
        stride = window - size + 1
        self.code = _digits({w for _, words in items for w in words})
        self.items: list[tuple[str, list[str]]] = []
        #: For every stretch the items and the places in them where it stands.
        self.places: list[list[tuple[int, int]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for name, words in items:
            line = [self.code[w] for w in words]
            if not line:
                continue
            self.items.append((name, line))
            starts = range(0, len(line) - size + 1, stride) if len(line) >= window else (0,)
            for at in starts:
                key = "".join(line[at : at + size] if len(line) >= window else line)
                number = self.automaton.get(key, -1)
                if number < 0:
                    number = len(self.places)
                    self.automaton.add_word(key, number)
                    self.places.append([])
                self.places[number].append((len(self.items) - 1, at))
        if self.items:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs of hit words as (first, one past the last), and the items that occur."""
        if not self.items or not words:
            return [], set()
        get, digits = self.code.get, len(self.items[0][1][0])
        other = "\0" * digits
        line = [get(w, other) for w in words]
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        #: How far an item's stretch on a diagonal has been compared already.
        done: dict[tuple[int, int], int] = {}
        for last, number in self.automaton.iter("".join(line)):
            end = last // digits
            for item, at in self.places[number]:
                name, own = self.items[item]
                if len(own) < self.window:
                    runs.append((end - len(own) + 1, end + 1))
                    found.add(name)
                    continue
                # The stretch's length is that of all stretches of whole windows.
                first = end - (self.window + 1) // 2 + 1
                diagonal = (item, first - at)
                if done.get(diagonal, -1) > end:
                    continue
                a, b = first, end + 1
                while a and at - (first - a) and line[a - 1] == own[at - (first - a) - 1]:
                    a -= 1
                while b < len(line) and at + b - first < len(own) and line[b] == own[at + b - first]:
                    b += 1
                done[diagonal] = b
                if b - a >= self.window:
                    runs.append((a, b))
                    found.add(name)
        return _merge(runs), found


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets, in the original text, of runs of words."""
    wanted = sorted({a for a, _ in runs} | {b - 1 for _, b in runs})
    at, out = 0, {}
    for k, m in enumerate(_WORD.finditer(data.lower())):
        if at < len(wanted) and k == wanted[at]:
            out[k] = m.span()
            at += 1
    count = lambda end: len(data[:end].decode())
    return [(count(out[a][0]), count(out[b - 1][1])) for a, b in runs]


def item_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as words, in blocks of bounded size; one block at least. Rows come to the driver one partition at a time.

    An item that is too long for a block is cut into parts that overlap by all but one word of a window,
    so that no window is lost.
    """
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").cast("binary").alias("t"))
    for row in rows.toLocalIterator():
        words = alnum_words(bytes(row.t) if row.t is not None else None)
        part, bytes_ = [], 0
        for w in words:
            part.append(w)
            bytes_ += len(w) + 1
            if bytes_ >= block_bytes and len(part) > 2 * window:
                yield [("" if row.i is None else row.i, part)]
                part = part[-(window - 1) :]
                bytes_ = sum(map(len, part))
        if block and size + bytes_ > block_bytes:
            yield block
            block, size = [], 0
        # What is left of a longer item is in the part before, unless a further word came.
        if part and (len(part) >= window or len(part) == len(words)):
            block.append(("" if row.i is None else row.i, part))
            size += bytes_
    yield block


@lru_cache(maxsize=1)
def _windows(data: bytes, window: int) -> Windows:
    return Windows(pickle.loads(data), window)


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`keep`, n_words, n_hit, n_items, items_sha256, contaminated and spans of every document.

    spans holds the hit runs as [start, end) in characters of the original text. A null or empty text
    has no words and is clean. A null item text has no window; items with a null id count as one item
    with the empty name; rows that repeat an id count as one item. An empty benchmark hits nothing.
    Repeated documents give repeated rows. Ids are sorted as strings by code point. Kept columns may
    have any name; one named like a result gets _doc at its end.
    """
    spark = docs.sparkSession
    ship(spark)
    inner = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)], F.col(f"`{text}`").cast("binary").alias("body"), F.lit(None).cast("binary").alias("found"))
    result = T.StructType.fromDDL(RESULT)
    blocks, last = item_blocks(benchmark, item, item_text, window, block_bytes), None
    for block in blocks:
        if last is not None:  # more than one block: what is found so far goes into a table with the texts
            rows = written(rows.mapInArrow(_scan(last, window, False), rows.schema), new_path(spark, "decontamination"))
            last.unpersist()
        last = spark.sparkContext.broadcast(pickle.dumps(block))
    out = rows.mapInArrow(_scan(last, window, True), T.StructType(rows.schema.fields[:-2] + result.fields))
    return out.toDF(*free_names(keep, result.names), *result.names)


def _scan(shared, window: int, final: bool):
    """Scans batches of kept columns, text and what earlier blocks found with one block's automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared.value, window)
        for batch in batches:
            kept, bodies, before = batch.columns[:-2], batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            found = []
            for body, old in zip(bodies, before, strict=True):
                data = body.as_py()
                words = alnum_words(data)
                runs, items = windows.scan(words)
                if old.is_valid:
                    more, names = pickle.loads(old.as_py())
                    runs, items = _merge([*runs, *more]), items | names
                found.append(_told(data, words, runs, items) if final else pickle.dumps((runs, items)) if runs else None)
            if final:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:-2], "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([*kept, bodies, pa.array(found, pa.binary())], names=batch.schema.names)

    return released(run)


NOTHING = hashlib.sha256(b"").hexdigest()


def _told(data: bytes | None, words: list[bytes], runs: list[tuple[int, int]], items: set[str]) -> tuple:
    if not runs:
        return len(words), 0, 0, NOTHING, False, []
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(words), sum(b - a for a, b in runs), len(items), digest, True, [{"start": a, "end": b} for a, b in spans(data, runs)]


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against every benchmark item."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"]).drop("spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows, in their own columns, that hold no window of an item. Rows with a null or empty text stay; repeated rows share their fate."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    found = contamination(own, benchmark, names, names[docs.columns.index(text)])
    return found.where(~F.col("contaminated")).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
