"""Accuracy of links against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import histogram_of_counts, repeated_keys

#: Published counts of a real identification system, for comparison: 281,868 wrong of 157,279,733.
PUBLISHED_ACCURACY = 1 - 281_868 / 157_279_733
PUBLISHED_SHARE = 0.9028


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole of two counts, with the floating-point results where whole is 0: NaN for 0 / 0, else infinity."""
    return F.when(whole != 0, part / whole).when(part == 0, float("nan")).otherwise(float("inf"))


def identified_share(piked: DataFrame) -> DataFrame:
    return piked.agg(F.avg(F.col("pik").isNotNull().cast("int")).alias("identified"))


def duplicate_sizes(piked: DataFrame) -> DataFrame:
    """How many ids were given to how many rows."""
    return histogram_of_counts(piked, ["pik"])


def duplicates(piked: DataFrame) -> DataFrame:
    return repeated_keys(piked, ["pik"])


def possible(piked: DataFrame, truth: DataFrame, reference_entities: DataFrame) -> DataFrame:
    """rows, rows whose entity is in a reference file, and ids per such row."""
    known = reference_entities.select("simulant_id").distinct().withColumn("_in", F.lit(1))
    rows = piked.join(truth, "record_id").join(known, "simulant_id", "left")
    return rows.agg(
        F.count("*").alias("n_rows"), F.count("_in").alias("n_possible"), F.avg(F.col("_in").isNotNull().cast("int")).alias("possible"),
        _ratio(F.count("pik"), F.count("_in")).alias("ids_per_possible"),
    )


def entity_counts(pairs: DataFrame, key: str = "pik") -> DataFrame:
    """(key, simulant_id, n_unique_simulants)."""
    distinct = pairs.select(key, "simulant_id").distinct()
    return distinct.join(distinct.groupBy(key).agg(F.count("simulant_id").alias("n_unique_simulants")), key)


def _judged(assigned: DataFrame, truth: DataFrame, pairs: DataFrame, key: str = "pik") -> DataFrame:
    """One row for each assigned id: whether the id has one entity, is that entity, or has it among others.

    With another key, such as record_id_reference, each link is judged by the entities of what it was
    linked to; pairs is (key, simulant_id).
    """
    given = assigned.where(F.col(key).isNotNull()).join(truth.withColumnRenamed("simulant_id", "true_id"), "record_id", "left")
    known = given.join(entity_counts(pairs, key), key, "left")
    same = F.coalesce(F.col("simulant_id") == F.col("true_id"), F.lit(False))
    keys = [c for c in assigned.columns if c in ("record_id", key, "pik", "module_name", "pass_name")]
    return known.groupBy(*keys).agg(
        F.max("n_unique_simulants").alias("n_entities"), F.bool_or(same).alias("any_right"), F.bool_or(same & (F.col("n_unique_simulants") == 1)).alias("right")
    )


def accuracy(assigned: DataFrame, truth: DataFrame, pairs: DataFrame, key: str = "pik") -> DataFrame:
    """strict: right and the id has one entity, of all ids assigned; certain: the same of ids with one entity; lenient: any entity of the id is right.

    With record_id_reference as key, and pairs of reference records and entities, the records that were
    linked are judged, not the ids.
    """
    return _judged(assigned, truth, pairs, key).agg(
        F.count("*").alias("n"),
        F.avg(F.col("right").cast("int")).alias("strict"),
        _ratio(F.count_if("right"), F.count_if(F.col("n_entities") == 1)).alias("certain"),
        F.avg(F.col("any_right").cast("int")).alias("lenient"),
    )


def accuracy_by(assigned: DataFrame, truth: DataFrame, pairs: DataFrame, *by: str, key: str = "pik") -> DataFrame:
    """n, share right and number wrong by module or by module and pass; of ids, or with another key of links."""
    judged = _judged(assigned, truth, pairs, key)
    return judged.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("any_right").cast("int")).alias("right"), F.count_if(~F.col("any_right")).alias("wrong")).orderBy("right", *by)


def wrong_links(links: DataFrame, truth: DataFrame, pairs: DataFrame, inputs: DataFrame, reference: DataFrame, rows: int = 100) -> DataFrame:
    """Wrong links side by side with both records' columns; `rows` of them, as many as one looks at."""
    wrong = _judged(links.select("record_id", "pik"), truth, pairs).where(~F.col("any_right")).select("record_id", "pik")
    few = links.join(wrong, ["record_id", "pik"], "left_semi").orderBy("record_id").limit(rows)
    a = inputs.select("record_id", *[F.col(c).alias(f"{c}_input") for c in inputs.columns if c != "record_id"])
    b = reference.select(F.col("record_id").alias("record_id_reference"), *[F.col(c).alias(f"{c}_reference") for c in reference.columns if c not in ("record_id", "pik")])
    return few.join(a, "record_id").join(b, "record_id_reference")


def missed(piked: DataFrame, truth: DataFrame, reference_entities: DataFrame) -> DataFrame:
    """Rows without an id whose entity has a reference record of its own: (record_id, simulant_id, reference_id)."""
    single = reference_entities.where("n_unique_simulants = 1").select(F.col("record_id").alias("reference_id"), "simulant_id")
    return piked.where(F.col("pik").isNull()).select("record_id").join(truth, "record_id").join(single, "simulant_id").select("record_id", "simulant_id", "reference_id")
