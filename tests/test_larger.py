"""What shows only where people share ids or keys recur, as in larger tables."""

from __future__ import annotations

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle import catalog, runtime
from heddle.functions import similarity
from heddle.plans import evaluate, model
from heddle.plans.model import Comparison


@pytest.mark.parametrize("right", [True, False])
def test_accuracy_where_every_id_is_ambiguous(spark, right):
    """No id has one entity: a share of none is NaN, as in SQL's floating-point division, not an error."""
    assigned = spark.createDataFrame([("a", "p")], "record_id string, pik string")
    truth = spark.createDataFrame([("a", 1 if right else 3)], "record_id string, simulant_id long")
    pairs = spark.createDataFrame([("p", 1), ("p", 2)], "pik string, simulant_id long")
    got = evaluate.accuracy(assigned, truth, pairs).select("n", "strict", F.round("certain", 9).alias("certain"), "lenient").first()
    assert (got.n, got.strict, got.lenient) == (1, 0.0, float(right)) and math.isnan(got.certain)


def test_possible_where_no_entity_is_known(spark):
    truth = spark.createDataFrame([("a", 1)], "record_id string, simulant_id long")
    none = truth.select("simulant_id").limit(0)
    for pik, want in (("p", math.inf), (None, math.nan)):
        got = evaluate.possible(spark.createDataFrame([("a", pik)], "record_id string, pik string"), truth, none).first()
        assert (got.n_rows, got.n_possible) == (1, 0) and repr(got.ids_per_possible) == repr(want)


def test_patterns_of_blocks_count_every_pair(spark):
    """Counts of levels are those of all pairs, with nulls, whether rows recur or not."""
    names = ["Ann", "Anne", "Annabel", "Bob", None, ""]
    rows = [(names[i % 6], names[i * i % 5], i % 3, None if i % 7 == 0 else i % 4) for i in range(120)]
    a = spark.createDataFrame(rows, "first string, last string, year int, k int")
    b = spark.createDataFrame(rows[17:80], a.schema)
    some = (Comparison("first", "jaro_winkler", 0.8), Comparison("last", "jaro_winkler", 0.8), Comparison("year", "numeric", 1))
    want = model.gamma_patterns(model.blocking_join(a, b, ["k"]), some)
    got = model.blocked_patterns(a, b, ["k"], some)
    assert got.count() > 10 and sorted(got.collect()) == sorted(want.collect())


def test_patterns_of_a_block_too_large_for_its_pairs(spark):
    """Four times 10^10 pairs of rows that recur; compared one by one they would take hours."""
    rows = spark.range(200_000).selectExpr("1 as k", "if(id % 2 = 0, 'Smith', 'Smyth') as name")
    got = model.blocked_patterns(rows, rows, ["k"], (Comparison("name", "jaro_winkler", 0.8),))
    assert {r.gamma_name: r.n for r in got.collect()} == {2: 20_000_000_000, 1: 20_000_000_000}


def test_similarities_are_remembered_without_bounds_being_passed(monkeypatch):
    """Remembered pairs are as those compared anew, and there are never more than the bound."""
    monkeypatch.setattr(similarity, "REMEMBERED", 50)
    monkeypatch.setattr(similarity, "_known", known := {})
    words = ["", "a", "ab", "Smith", "Smyth", "Macdonald", "Donaldmac", "x" * 80, "x" * 79 + "y", "zip 10001"]
    pairs = [(a, b) for a in words for b in words]
    for _ in range(2):
        for some in (pairs, pairs[:40], pairs[30:60]):
            got = similarity._similarities(pa.array([a for a, _ in some] + [None]), pa.array([b for _, b in some] + ["a"])).to_pylist()
            assert got.pop() is None and got == pytest.approx([similarity._long(*p) for p in some], abs=1e-12)
            assert len(known) <= 50 and all(len(x) < similarity.SHORT for p in known for x in p)


def test_preparation_is_dealt_out(spark, monkeypatch):
    """A small file comes in one partition; what is prepared from it must not stay in one task."""
    seen = []

    def first(df):
        seen.append(df.rdd.getNumPartitions())
        raise RuntimeError("seen")

    monkeypatch.setattr(runtime, "stored", first)
    with pytest.raises(RuntimeError, match="seen"):
        catalog.queries()["full_cascade"](spark, "/root/testdata/sf0.001")
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_pairs_of_few_rows_are_dealt_out(spark):
    """The pairs of a small file's rows aren't all made in one task, and every one is there."""
    got = catalog.queries()["numeric_levels"](spark, "/root/testdata/sf0.01")
    by_task = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > spark.sparkContext.defaultParallelism and sum(r["count"] for r in by_task) == 28_982
