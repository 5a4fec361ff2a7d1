"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, ship

__all__ = ["LOWER", "UPPER", "alnum_words", "ascii_lower", "crc_bucket", "cut", "free_names", "map_texts", "read_table", "released", "ship", "space_words"]

#: ASCII upper-case letters and their lower-case forms.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Maps every byte outside [0-9a-z\x80-\xff] to a space, after bytes.lower().
_KEEP = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(key: Column | str, modulus: int) -> Column:
    """crc32 of the key as text, modulo a number; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts that are all ASCII take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def alnum_words(data: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text after lower-casing A-Z."""
    return data.lower().translate(_KEEP).split() if data else []


def space_words(data: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a UTF-8 text after lower-casing A-Z."""
    return data.lower().split() if data else []


def free_names(keep: Sequence[str], results: Sequence[str]) -> list[str]:
    """Names for kept columns: their own, with _doc at the end of those that clash with results or with each other."""
    taken, out = {r.lower() for r in results}, []
    for name in keep:
        while name.lower() in taken:
            name = f"{name}_doc"
        taken.add(name.lower())
        out.append(name)
    return out


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Gives freed memory back to the system at the end of a task: Python workers live on and would keep it beside the next stage's."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
            if trim:
                trim(0)

    return wrapped


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[bytes | None], tuple]],
) -> DataFrame:
    """Columns `keep`, then for every row the tuple that a function returns for its text.

    `make` runs once in each task and returns the function; it gets UTF-8 bytes, or None for null.
    Rows pass in Arrow batches bounded by rows and by bytes; nothing is shuffled. A kept column named
    like a result gets _doc at its end.
    """
    ship(df.sparkSession)
    inner = [f"_k{i}" for i in range(len(keep))]
    columns = [F.col(f"`{k}`").alias(i) for k, i in zip(keep, inner)]
    # A text that is kept anyway crosses to Python once; its bytes are read in place.
    at = list(keep).index(text) if text in keep and df.schema[text].dataType == T.StringType() else len(keep)
    source = df.select(*columns, *([F.col(f"`{text}`").cast("binary").alias("_t")] if at == len(keep) else []))
    kept = T.StructType([T.StructField(n, df.schema[k].dataType) for n, k in zip(free_names(keep, [n for n, _ in fields]), keep, strict=True)])
    schema = T.StructType(kept.fields + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        each, kinds = make(), [to_arrow_type(t) for _, t in fields]
        for batch in batches:
            n = len(keep)
            texts = batch.column(at)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()) if at < n else texts
            rows = [each(x.as_py()) for x in texts]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[f.name for f in schema.fields])

    return source.mapInArrow(released(run), schema)
