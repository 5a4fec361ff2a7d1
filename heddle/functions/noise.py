"""Row-level noise. Uniform numbers are hashes of a row's id, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(row_id: Column, seed: int, k: int) -> Column:
    """The k-th number in [0, 1) of a row: the first 32 bits of an MD5 sum."""
    key = F.concat_ws("|", row_id.cast("string"), F.lit(str(seed)), F.lit(str(k)))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def split_columns(df: DataFrame, columns: Sequence[str], p: float, seed: int, row_id: str) -> DataFrame:
    """With probability p the columns' words are cut apart at the wrong places.

    Values (null as empty) are joined with spaces and cut at spaces and hyphens. With n separators and
    k columns, k - 1 sorted uniforms u give cut points ceil(u n); the words between two cuts go to one
    column, joined with spaces, without empty ones. Without a separator everything goes to the last column.
    """
    whole = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    words = F.split(whole, "[ -]")
    n = F.size(words) - 1
    cuts = F.array_sort(F.array(*[uniform(F.col(row_id), seed, i) for i in range(1, len(columns))]))
    bound = [F.lit(0), *[F.ceil(cuts[i] * n).cast("int") for i in range(len(columns) - 1)], F.size(words)]
    part = lambda i: F.array_join(F.filter(F.slice(words, bound[i] + 1, bound[i + 1] - bound[i]), lambda w: w != ""), " ")
    hit = uniform(F.col(row_id), seed, 0) < p
    return df.select("*", hit.alias("_hit"), F.array(*[part(i) for i in range(len(columns))]).alias("_parts")).select(
        *[F.when(F.col("_hit"), F.col("_parts")[columns.index(c)]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def shuffle_columns(df: DataFrame, columns: Sequence[str], p: float, seed: int, row_id: str) -> DataFrame:
    """With probability p the columns' values, nulls included, change places at random."""
    columns = list(columns)
    drawn = F.array_sort(F.array(*[F.struct(uniform(F.col(row_id), seed, i + 1).alias("u"), F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)]))
    hit = uniform(F.col(row_id), seed, 0) < p
    return df.select("*", hit.alias("_hit"), drawn.alias("_drawn")).select(
        *[F.when(F.col("_hit"), F.col("_drawn")[columns.index(c)]["v"]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def truncate_column(df: DataFrame, column: str, p: float, length: int, seed: int, row_id: str) -> DataFrame:
    """With probability p the first `length` characters stay."""
    return df.withColumn(column, F.when(uniform(F.col(row_id), seed, 0) < p, F.substring(column, 1, length)).otherwise(F.col(column)))


def name_noise(df: DataFrame, columns: Sequence[str], seed: int, row_id: str, truncate: str | None = None) -> DataFrame:
    """Split (1 %), then for tax files truncate (40 %, 4 characters), then shuffle (1 %)."""
    out = split_columns(df, columns, 0.01, seed, row_id)
    if truncate:
        out = truncate_column(out, truncate, 0.4, 4, seed + 1, row_id)
    return shuffle_columns(out, columns, 0.01, seed + 2, row_id)
