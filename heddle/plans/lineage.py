"""Datasets that remember the source records their rows come from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import check_unique, concat, hashed_id, join_dropping_nulls


@dataclass(frozen=True)
class Lineaged:
    """Rows with record_id, and pairs (record_id, source_record_id), many to many."""

    df: DataFrame
    pairs: DataFrame


def self_lineage(df: DataFrame) -> Lineaged:
    """Source rows: each comes from itself."""
    return Lineaged(df, df.select("record_id", F.col("record_id").alias("source_record_id")))


def merge(parts: Sequence[Lineaged], name: str, on: Sequence[str], how: str = "inner") -> Lineaged:
    """Joins parts one after another. Rows with a null key drop out; each result row comes from the
    sources of both its sides. Columns that both sides have beside the keys are not allowed."""

    def two(left: Lineaged, right: Lineaged) -> Lineaged:
        a, b = left.df.withColumnRenamed("record_id", "_l"), right.df.withColumnRenamed("record_id", "_r")
        both = join_dropping_nulls(a, b, on, how).withColumn("record_id", hashed_id(f"{name}_", [F.col("_l"), F.col("_r")]))
        from_left = both.select("record_id", F.col("_l").alias("o")).join(left.pairs.withColumnRenamed("record_id", "o"), "o")
        from_right = both.select("record_id", F.col("_r").alias("o")).join(right.pairs.withColumnRenamed("record_id", "o"), "o")
        return Lineaged(both.drop("_l", "_r"), from_left.unionByName(from_right).drop("o").distinct())

    return reduce(two, parts)


def dedupe(part: Lineaged, columns: Sequence[str], name: str) -> Lineaged:
    """Distinct values of columns, nulls being equal; each comes from the sources of all rows it stands for.

    A row's id follows from its values, so every row knows what it stands for without a join.
    """
    rows = part.df.select(hashed_id(f"{name}_", [F.col(c) for c in columns]).alias("record_id"), F.col("record_id").alias("o"), *columns)
    stands = rows.select("record_id", "o").join(part.pairs.withColumnRenamed("record_id", "o"), "o")
    return Lineaged(rows.drop("o").distinct(), stands.drop("o").distinct())


def concatenate(parts: Sequence[Lineaged], name: str, check: bool = True) -> Lineaged:
    """Rows of all parts under new ids."""
    tagged = [p.df.withColumnRenamed("record_id", "_o").withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = concat(tagged).withColumn("record_id", hashed_id(f"{name}_", [F.col("_part"), F.col("_o")]))
    if check:
        check_unique(rows, ["_part", "_o"])
    sources = concat([p.pairs.withColumnRenamed("record_id", "_o").withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    pairs = rows.select("record_id", "_part", "_o").join(sources, ["_part", "_o"]).select("record_id", "source_record_id")
    return Lineaged(rows.drop("_part", "_o"), pairs)


def split_truth(df: DataFrame, truth: str = "simulant_id") -> tuple[DataFrame, DataFrame]:
    """Data without the truth, and (record_id, truth)."""
    return df.drop(truth), df.select("record_id", truth)


def entities(pairs: DataFrame, truth: DataFrame, entity: str = "simulant_id") -> DataFrame:
    """(record_id, entity, n_unique_simulants): the distinct entities behind each record and their number."""
    source = truth.select(F.col("record_id").alias("source_record_id"), entity)
    found = pairs.join(source, "source_record_id").select("record_id", entity).distinct()
    counts = found.groupBy("record_id").agg(F.count(entity).alias("n_unique_simulants"))
    return found.join(counts, "record_id")


def collisions(truth: DataFrame) -> dict[str, DataFrame]:
    """Diagnostics of records that mix entities: a summary of the counts, and the worst record's rows."""
    per_record = truth.select("record_id", "n_unique_simulants").distinct()
    worst = per_record.orderBy(F.desc("n_unique_simulants"), "record_id").limit(1)
    return {"summary": per_record.select("n_unique_simulants").summary(), "worst": truth.join(F.broadcast(worst.select("record_id")), "record_id", "left_semi")}


def collision_sources(pairs: DataFrame, truth: DataFrame, sources: DataFrame, entity: str = "simulant_id") -> DataFrame:
    """The source rows behind the record that mixes the most entities (of ties the smallest id), each with its entity.

    pairs is (record_id, source_record_id), truth (record_id, entity) of the sources, and sources has record_id.
    """
    found = entities(pairs, truth, entity)
    worst = found.select("record_id", "n_unique_simulants").distinct().orderBy(F.desc("n_unique_simulants"), "record_id").limit(1).where("n_unique_simulants > 1")
    behind = pairs.join(F.broadcast(worst.select("record_id")), "record_id", "left_semi").select(F.col("source_record_id").alias("record_id")).distinct()
    return sources.join(behind, "record_id", "left_semi").join(truth.select("record_id", entity), "record_id", "left")


def id_crosswalk(frames: Sequence[DataFrame], column: str = "ssn", name: str = "pik") -> DataFrame:
    """(column, name): one id for every distinct non-null value in any of the frames."""
    from ..operators.relational import add_unique_ids

    values = concat([f.select(column) for f in frames]).dropna().distinct()
    return add_unique_ids(values, name, "", [column])


def attach_id(df: DataFrame, crosswalk: DataFrame, column: str = "ssn", name: str = "pik") -> DataFrame:
    """A left join with the crosswalk; raises if a row gets no id."""
    out = df.join(crosswalk, column, "left")
    if not out.where(F.col(name).isNull()).isEmpty():
        raise ValueError(f"rows without {name}")
    return out


def value_entities(frames: Sequence[tuple[DataFrame, DataFrame]], column: str = "ssn", entity: str = "simulant_id") -> DataFrame:
    """Distinct (column, entity) over frames paired with their truths."""
    return concat([df.select("record_id", column).join(truth.select("record_id", entity), "record_id").select(column, entity) for df, truth in frames]).distinct()
