"""Operator 2: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius have a variant in common within half the radius of each. Every
distinct fingerprint emits its whole ball of such variants (2,081 of 64 bits at radius 4), the variants
are shuffled, and those that two fingerprints emitted collide. Fingerprints that emitted one variant are
all within the radius of each other, so a star around the smallest keeps every component and no pairs
within a crowd are written; each edge of a star is verified.

All balls at once would be about fifteen times the texts. So variants are dealt into slices by a few
parities of their bits, one shuffle each, whose files go as soon as its edges are written: disk stays a
fixed multiple of the input. A variant's parities are those of its fingerprint and its mask together, so
each slice emits just its own variants. They travel packed, by ranges of a hash of the variant.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ..runtime import new_path, removed, written
from .common import cut, map_texts, read_table, released, ship, space_words
from .graph import connected_components

WORDS, SEED, RADIUS = 4, 42, 4
#: Bit sets whose parities number the slices: 2 to the power of their number, of which a small table needs fewer.
PARITIES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Fingerprints whose variants are emitted together, variants that one colliding task gets, and ranges at least.
BLOCK, RANGE_VARIANTS, RANGES = 4096, 1_000_000, 32
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def simhash(data: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer; of a text without words, zero."""
    found = space_words(data)
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if n > 1 else [b" ".join(found)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """`keep` and fp (bigint) of every text."""
    return map_texts(docs, text, keep, [("fp", T.LongType())], lambda: lambda data: (simhash(data, words),))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masks(radius: int) -> np.ndarray:
    """All 64-bit masks with at most `radius` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)


def _slice(x: np.ndarray, parities: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for j, bits in enumerate(parities):
        out |= (np.bitwise_count(x & np.uint64(bits)) & 1).astype(np.int64) << j
    return out


def _in_order(ranges: np.ndarray, bits: int) -> np.ndarray:
    """The places that sort numbers below 2^bits, by stable radix passes of 16 bits."""
    order = np.argsort((ranges & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for at in range(16, bits, 16):
        order = order[np.argsort((ranges[order] >> np.uint64(at) & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")]
    return order


#: Variants of one range, and for each the number of the mask that makes it from its fingerprint.
PACKED = "range bigint, variants binary, masks binary"


def _emitted(distinct: DataFrame, masks: np.ndarray, parities: tuple[int, ...], number: int, bits: int) -> DataFrame:
    """The variants of one slice, packed by range."""
    own = _slice(masks, parities)

    def packed(block: np.ndarray) -> pa.RecordBatch:
        of = _slice(block, parities)
        variants, numbers = [], []
        for k in range(1 << len(parities)):
            these, chosen = block[of == k], np.flatnonzero(own == (k ^ number))
            variants.append((these[:, None] ^ masks[chosen][None, :]).ravel())
            numbers.append(np.tile(chosen.astype("<u2"), len(these)))
        v, m = np.concatenate(variants), np.concatenate(numbers)
        ranges = v * _SPREAD >> np.uint64(64 - bits)
        order = _in_order(ranges, bits)
        v, m, ranges = v[order], m[order], ranges[order]
        starts = np.flatnonzero(np.diff(ranges, prepend=np.uint64(1 << bits)))
        ends = np.append(starts[1:], len(v))
        blobs = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for x in (v, m)]
        return pa.RecordBatch.from_arrays([pa.array(ranges[starts].astype(np.int64)), *blobs], names=["range", "variants", "masks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            held = np.append(held, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            while len(held) >= BLOCK:
                yield packed(held[:BLOCK])
                held = held[BLOCK:]
        if len(held):
            yield packed(held)

    return distinct.mapInArrow(released(run), PACKED)


def _collided(table: pa.Table, masks: np.ndarray, radius: int) -> pa.Table:
    """Edges (a, b), a the smallest, among the fingerprints that share a variant of the range."""
    v = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("variants")])
    m = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in table.column("masks")])
    order = np.argsort(v)
    ordered = v[order]
    same = ordered[1:] == ordered[:-1]
    met = np.append(False, same) | np.append(same, False)
    v, m = ordered[met], m[order[met]]
    if not len(v):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    prints = (v ^ masks[m]).view(np.int64)
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    center = np.repeat(np.minimum.reduceat(prints, first), np.diff(first, append=len(v)))
    near = (center != prints) & (np.bitwise_count(center.view(np.uint64) ^ prints.view(np.uint64)) <= radius)
    a, b = center[near], prints[near]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return pa.table({"a": pa.array(a[fresh]), "b": pa.array(b[fresh])})


def links(distinct: DataFrame, radius: int = RADIUS, parities: tuple[int, ...] | None = None, folder: str | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, connecting exactly what links within `radius` bits connect.

    Not every link has an edge of its own: a star stands for the links among the fingerprints that share
    a variant. Of an odd radius, balls could only meet beyond it, so such a radius is refused. The edges
    are read from tables in `folder`, which the caller may delete when it has used them.
    """
    if radius not in (0, 2, 4):
        raise ValueError("balls are built for radius 0, 2 and 4")
    spark = distinct.sparkSession
    ship(spark)
    masks = _masks(radius // 2)
    size = distinct.count()
    if parities is None:
        # Beyond a slice of this size only; it changes how many shuffles there are, not what meets in them.
        parities = PARITIES[: (max(1, -(-size * len(masks) // (RANGE_VARIANTS * RANGES))) - 1).bit_length()]
    bits = (max(-(-size * len(masks) // (RANGE_VARIANTS << len(parities))), RANGES) - 1).bit_length()
    # A few numbers a row: dealt out evenly, so that a task emits about a block.
    spread = cut(distinct.select("fp").repartition(max(1, -(-size // BLOCK))))
    folder = folder or new_path(spark, "balls")
    paths = []
    for number in range(1 << len(parities)):
        packed = _emitted(spread, masks, parities, number, bits)
        edges = packed.groupBy("range").applyInArrow(lambda table: _collided(table, masks, radius), "a bigint, b bigint")
        paths.append(f"{folder}/{number}")
        written(edges, paths[-1])
    return spark.read.schema("a bigint, b bigint").parquet(*paths).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """`key`, fp and component_id (the smallest key reachable) of every row.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal texts
    share a fingerprint and so a component. A null key keeps its row; it is no component's smallest
    key unless all of them are null. Rows that repeat give repeated results; an empty table gives none;
    other columns may have any name.
    """
    return _grouped(docs, key, text, words, radius).select(F.col("k").alias(key), "fp", "component_id")


def _grouped(docs: DataFrame, key: str, text: str, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(k, h, fp, component, component_id): key, a hash of the text, and component, a fingerprint that names the component where keys don't."""
    body = F.col(f"`{text}`")
    own = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(body, body.isNull()).alias("h"), body.alias("t"))
    prints = cut(fingerprints(own, ["k", "h"], "t", words))
    distinct = cut(prints.groupBy("fp").agg(F.min("k").alias("rep")))
    folder = new_path(docs.sparkSession, "balls")
    members = connected_components(links(distinct, radius, folder=folder)).withColumnsRenamed({"node": "fp"})
    # The components stand in checkpoints of their own by now.
    removed(docs.sparkSession, folder)
    named = distinct.join(members, "fp")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = named.join(smallest, "component").select("fp", "component", "component_id")
    # A table of its own, so that the last join reads two plain shuffles and a fingerprint with very many copies can be split.
    reps = cut(distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "rep").alias("component_id")))
    return prints.join(reps, "fp").select("k", "h", "fp", "component_id", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all whole documents."""
    found = groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, in its own columns: that with the smallest key, and of those that share it the one with the smallest hash of its text.

    A null key comes after all others. Rows that repeat both key and text count as one.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    k, t = (names[docs.columns.index(c)] for c in (key, text))
    own = docs.toDF(*names)
    found = _grouped(own, k, t).groupBy("component", "k", "h").agg(F.count("*").alias("n"))
    best = cut(found.groupBy("component").agg(F.min(F.struct(F.col("k").isNull().alias("last"), "k", "h", "n")).alias("b")).select("b.k", "b.h", "b.n"))
    rows = own.withColumn("h", F.xxhash64(F.col(t), F.col(t).isNull()))
    chosen = lambda which: rows.alias("r").join(best.where(which).alias("b"), F.col(f"r.{k}").eqNullSafe(F.col("b.k")) & (F.col("r.h") == F.col("b.h")), "left_semi")
    # Only rows given several times have to be brought together.
    kept = chosen("n = 1").unionByName(chosen("n > 1").dropDuplicates([k, "h"]))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
