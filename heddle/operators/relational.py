"""Relational operators with the null rules that the linkage pipeline needs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut


# Identity


def number_rows(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Numbers rows from 0 in the order of keys, without ever bringing all rows into one task.

    A range-partitioned sort is fixed by a checkpoint; each partition's offset is a running sum over as
    many numbers as there are partitions.
    """
    low = (1 << 33) - 1
    rows = cut(df.orderBy(*[F.asc_nulls_first(k) for k in keys]).withColumn("_at", F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    # One row for each partition: the size bound of this broadcast is the number of partitions.
    joined = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, (F.col("_start") + F.col("_at").bitwiseAND(F.lit(low))).alias(name))


def add_unique_ids(df: DataFrame, column: str, prefix: str, keys: Sequence[str] | None = None) -> DataFrame:
    """A string id for every row: by rank if keys are given, else by place (fixed by a checkpoint)."""
    if keys is None:
        return cut(df.withColumn(column, F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string"))))
    return number_rows(df, keys, "_n").select(*df.columns, F.concat(F.lit(prefix), F.col("_n").cast("string")).alias(column))


def add_record_ids(df: DataFrame, dataset: str, keys: Sequence[str] | None = None) -> DataFrame:
    return add_unique_ids(df, "record_id", f"{dataset}_", keys)


def hashed_id(prefix: str, keys: Sequence[Column]) -> Column:
    """An id from the values of a unique key, nulls included: 128 bits of hashes, so no row has to know of the others.

    Among 10 billion keys the chance that any two share an id is about 1 in 10^18.
    """
    parts = [x for k in keys for x in (k, k.isNull())]
    digits = [F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0")) for seed in range(2)]
    return F.concat(F.lit(prefix), *digits)


# Projection


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Column names without a prefix."""
    return df.toDF(*[c.removeprefix(prefix) for c in df.columns])


def with_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Column names with a suffix, but for those kept; raises if a name ends with it already or two would be one."""
    if bad := [c for c in df.columns if c.endswith(suffix) or (c in keep and c.removesuffix(suffix) != c) or f"{c}{suffix}" in keep]:
        raise ValueError(f"columns clash with the suffix {suffix!r}: {bad}")
    return df.toDF(*[c if c in keep else f"{c}{suffix}" for c in df.columns])


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def unique_list(items: Sequence[str]) -> list[str]:
    """First places of the items, in order."""
    return list(dict.fromkeys(items))


# Sets


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns align by name and missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def except_keys(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key isn't in the other frame; a null key is never in it."""
    return df.join(other.select(*on), list(on), "left_anti")


def only_keys(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_semi")


# Joins


def join_dropping_nulls(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join after rows with a null key are dropped on both sides, for a left join too."""
    return left.dropna(subset=list(on)).join(right.dropna(subset=list(on)), list(on), how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(other, match, how).drop(*[f"_r_{c}" for c in on])


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right, common_columns(left, right), how)


def check_unique(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The frame; raises if a key occurs twice."""
    if not df.groupBy(*on).count().where("count > 1").isEmpty():
        raise ValueError(f"key is not unique: {list(on)}")
    return df


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "m:1") -> DataFrame:
    """A join after the sides written as 1 are checked for unique keys (m:1, 1:1, 1:m)."""
    one, other = validate.split(":")
    return (check_unique(left, on) if one == "1" else left).join(check_unique(right, on) if other == "1" else right, list(on), how)


def check_disjoint(df: DataFrame, other: DataFrame, on: Sequence[str]) -> None:
    if not only_keys(df, other, on).isEmpty():
        raise ValueError(f"keys occur in both: {list(on)}")


# Groups


def group_agg(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates by key; rows with a null key belong to no group."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(*aggregates)


def top_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by any order; null keys are a key. Order should end in a unique column.

    Spark keeps the first row of each key in each task before the shuffle (WindowGroupLimit).
    """
    best = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def latest_row(df: DataFrame, by: Sequence[str], at: Column, tie: str, latest: bool = True) -> DataFrame:
    """The row of each key with the latest (or earliest) `at`, ties to the smaller `tie`.

    Rows are compared as structs within each task before the shuffle, so a hot key stays cheap.
    """
    rest = [c for c in df.columns if c not in (*by, tie)]
    row = F.struct(*[F.col(c) for c in (tie, *rest)])
    kind = df.select(at.alias("at")).schema[0].dataType.simpleString()
    local = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    number = {"date": F.unix_date, "timestamp": F.unix_micros, "timestamp_ntz": local}.get(kind, lambda c: c)(at)
    # Undated rows come after dated ones either way.
    order = F.struct(at.isNull().alias("n"), (-number if latest else number).alias("a"), F.col(tie).alias("t"))
    tops = df.groupBy(*by).agg(F.min_by(row, order).alias("_row"))
    return tops.select(*[F.col(c) if c in by else F.col(f"_row.{c}") for c in df.columns])


def repeated_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once."""
    return only_keys(df, group_agg(df, on, F.count("*").alias("_n")).where("_n > 1"), on)


def rows_at_maximum(df: DataFrame, column: str) -> DataFrame:
    """Rows that have the column's largest value."""
    top = df.agg(F.max(column).alias("_top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_top")).drop("_top")


def histogram_of_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(group_size, groups): how many keys have each number of rows."""
    return group_agg(df, by, F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("groups"))


# Samples


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """About a fraction of the rows, chosen by a hash of the key: the same ones on every run."""
    from ..functions.noise import uniform

    return df.where(uniform(F.col(key), seed, 0) < fraction)


def capped_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """All rows, or about `rows` of them if there are more."""
    n = df.count()
    return df if n <= rows else hash_sample(df, key, rows / n, seed)


Transformation = Callable[[DataFrame], DataFrame]


def pipe(df: DataFrame, *steps: Transformation) -> DataFrame:
    return reduce(lambda d, step: step(d), steps, df)


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
