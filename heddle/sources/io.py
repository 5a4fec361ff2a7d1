"""Sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import check_unique, except_keys


def read_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One scan of one or several files or folders; only the named columns are read."""
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", columns=columns)


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    """Replaces what is at the path and returns the written rows."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_with_truth(data: DataFrame, truth: DataFrame, path: str, id_column: str = "record_id") -> None:
    """Writes data and, beside it, its ground truth, after checking that ids are unique and truth has no others."""
    check_unique(data, [id_column])
    if not except_keys(truth, data, [id_column]).isEmpty():
        raise ValueError("truth has ids that the data lacks")
    write_parquet(data, path)
    write_parquet(truth, f"{path}_ground_truth")


def text_list(spark: SparkSession, path: str, missing: Sequence[str] = ("NA",)) -> DataFrame:
    """Distinct values of a text file with one per line and no header; marks of a missing value drop out."""
    return spark.read.text(path).select(F.col("value").alias("name")).where((F.col("name") != "") & ~F.col("name").isin(*missing)).distinct()


def save_model(model: Mapping, path: str, spark: SparkSession) -> None:
    """A trained model as one JSON line, in any file system that Spark writes."""
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(path).first().value)


def pairs_report(pairs: DataFrame, path: str, rows: int = 1000) -> None:
    """Pairs worth a look, the best first, as CSV; nothing is written if there are none."""
    if not pairs.isEmpty():
        pairs.orderBy(F.desc("match_probability")).limit(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
