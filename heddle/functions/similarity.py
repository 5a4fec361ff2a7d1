"""Jaro-Winkler similarity for columns of pairs.

Spark has no such function, so pairs pass to numpy in Arrow batches. A batch's values are numbered by Arrow, each
distinct pair is compared once, and workers remember pairs from batch to batch. Pairs of about the same length
behind their common prefix advance together: the loops run over character positions, not over pairs. Long strings
are compared one pair at a time, in time that grows with their length.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship

#: Prefix characters that count, their weight, and the Jaro similarity from which they count.
PREFIX, WEIGHT, BOOST = 4, 0.1, 0.7
#: Characters up to which pairs advance together.
SHORT = 64
#: Pairs of short strings that a worker remembers at most, some 40 MB.
REMEMBERED = 1 << 17
_known: dict[tuple[str, str], float] = {}


def _codes(values: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(v.ljust(width, "\0") for v in values).encode("utf-32-le"), np.uint32).reshape(len(values), width)


def _sizes(values: list[str]) -> np.ndarray:
    return np.fromiter(map(len, values), np.int64, len(values))


def jaro_winkler_values(left: list[str], right: list[str]) -> np.ndarray:
    """Similarities of equally many strings; 0 if one is empty."""
    number: dict[tuple[str, str], int] = {}
    of = np.fromiter((number.setdefault(pair, len(number)) for pair in zip(left, right, strict=True)), np.int64, len(left))
    return _distinct(list(number))[of] if number else np.zeros(0)


def _distinct(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Similarities of pairs; those that are remembered aren't compared again."""
    out = np.fromiter((_known.get(p, -1.0) for p in pairs), np.float64, len(pairs))
    new = np.flatnonzero(out < 0)
    if not len(new):
        return out
    some = [pairs[i] for i in new]
    short = np.fromiter((len(a) < SHORT and len(b) < SHORT for a, b in some), bool, len(some))
    found = np.zeros(len(some))
    found[~short] = [_long(*some[i]) for i in np.flatnonzero(~short)]
    if short.any():
        at = np.flatnonzero(short)
        found[at] = _together([some[i][0] for i in at], [some[i][1] for i in at])
        if len(_known) + len(at) > REMEMBERED:
            _known.clear()
        _known.update(zip((some[i] for i in at[:REMEMBERED]), found[at[:REMEMBERED]].tolist()))
    out[new] = found
    return out


def _long(a: str, b: str) -> float:
    """One pair. A character takes the first free equal one within reach, so the free ones of each kind wait in a queue."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    waiting: dict[str, deque[int]] = {}
    for j, c in enumerate(b):
        waiting.setdefault(c, deque()).append(j)
    hit_a, hit_b = [], []
    for i, c in enumerate(a):
        queue = waiting.get(c)
        while queue and queue[0] < i - reach:
            queue.popleft()
        if queue and queue[0] <= i + reach:
            hit_a.append(c)
            hit_b.append(queue.popleft())
    m = len(hit_a)
    if not m:
        return 0.0
    moved = sum(c != b[j] for c, j in zip(hit_a, sorted(hit_b))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    common = 0
    while common < min(PREFIX, len(a), len(b)) and a[common] == b[common]:
        common += 1
    return jaro + common * WEIGHT * (1 - jaro) if jaro > BOOST else jaro


def _together(left: list[str], right: list[str]) -> np.ndarray:
    na, nb = _sizes(left), _sizes(right)
    width = int(max(na.max(initial=0), nb.max(initial=0), 1))
    a, b = _codes(left, width), _codes(right, width)
    shorter = np.minimum(na, nb)
    same = np.logical_and.accumulate((a == b) & (np.arange(width) < shorter[:, None]), 1)
    prefix = same.sum(1)
    # A common prefix matches itself, place by place, whatever follows.
    rest = np.maximum(na, nb) - prefix
    m, moved, reach = prefix.copy(), np.zeros(len(left), np.int64), np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    group = np.where(rest > 0, np.ceil(np.log2(np.maximum(rest, 1))).astype(np.int64), -1)
    for g in np.unique(group[group >= 0]):
        at = np.flatnonzero(group == g)
        more, out_of_order = _matches(a[at], b[at], na[at], nb[at], prefix[at], reach[at])
        m[at] += more
        moved[at] = out_of_order
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / na + m / nb + (m - moved) / m) / 3, 0.0)
    return np.where(jaro > BOOST, jaro + np.minimum(prefix, PREFIX) * WEIGHT * (1 - jaro), jaro)


def _matches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, skip: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matching characters behind the first `skip` ones, and half of those out of order."""
    wide = max(int(a.max(initial=0)), int(b.max(initial=0))) + 2
    kind = np.uint8 if wide < 1 << 8 else np.uint16 if wide < 1 << 16 else np.uint32

    def rows(codes: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
        """Character positions by pairs; 0 and 1 stand behind the ends, so that ends never match."""
        place = np.arange(int((size - skip).max(initial=0)))[:, None] + skip
        inside = place < size
        return np.where(inside, codes.T[np.where(inside, place, 0), np.arange(len(size))] + np.uint32(2), np.uint32(pad)).astype(kind)

    a, b = rows(a, na, 0), rows(b, nb, 1)
    most = int(reach.max(initial=0))
    within = [reach >= d for d in range(most + 1)]
    used_a, free_b = np.zeros(a.shape, bool), np.ones(b.shape, bool)
    for i in range(len(a)):
        for j in range(max(0, i - most), min(len(b), i + most + 1)):
            hit = a[i] == b[j]
            hit &= free_b[j]
            hit &= within[abs(i - j)]
            hit &= ~used_a[i]
            used_a[i] |= hit
            free_b[j] &= ~hit
    # Pair by pair, as many characters of one side as of the other.
    by_a, by_b = np.ascontiguousarray(used_a.T), np.ascontiguousarray(~free_b.T)
    differ = a.T[by_a] != b.T[by_b]
    return by_a.sum(1), np.bincount(np.nonzero(by_a)[0], differ, len(by_a)).astype(np.int64) // 2


def _similarities(left: pa.Array, right: pa.Array) -> pa.Array:
    l, r = left.dictionary_encode(), right.dictionary_encode()
    known = (left.is_valid().to_numpy(zero_copy_only=False)) & (right.is_valid().to_numpy(zero_copy_only=False))
    out = np.zeros(len(left))
    if known.any():
        number = lambda x: x.indices.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        of, distinct = pd.factorize(number(l) * len(r.dictionary) + number(r))
        a, b = l.dictionary.to_pylist(), r.dictionary.to_pylist()
        at_a, at_b = np.divmod(distinct, len(b))
        out[known] = _distinct([(a[i], b[j]) for i, j in zip(at_a.tolist(), at_b.tolist())])[of]
    return pa.array(out, pa.float64(), mask=~known)


def jaro_winkler(left: Column, right: Column) -> Column:
    """Null if either is null. Where few different pairs recur in many batches, with_similarity compares each once in all."""
    ship(SparkSession.active(), bounded=False)
    return F.arrow_udf(_similarities, T.DoubleType())(left, right)


def with_similarity(pairs: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Adds `name`, computed once for each distinct pair of different values; equal values have 1.0 without a call."""
    l, r = F.col(left), F.col(right)
    distinct = pairs.where((l != r) & l.isNotNull() & r.isNotNull()).select(l.alias("_l"), r.alias("_r")).distinct()
    scored = distinct.withColumn("_s", jaro_winkler(F.col("_l"), F.col("_r")))
    out = pairs.join(scored, (l == F.col("_l")) & (r == F.col("_r")), "left")
    return out.withColumn(name, F.when(l == r, F.when(l == "", 0.0).otherwise(1.0)).otherwise(F.col("_s"))).drop("_l", "_r", "_s")
