from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from heddle.operators import relational as R
from heddle.plans import lineage, reference
from heddle.plans.lineage import Lineaged
from heddle.sources import config, io, simulate


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_keys_in_three_ways(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert rows(R.null_safe_join(a, b, ["k"])) == [(1, "x", "p"), (None, "y", "q")]
    assert rows(R.join_dropping_nulls(a, b, ["k"], "left")) == [(1, "x", "p")]
    assert rows(R.group_agg(a, ["k"], F.count("*").alias("n"))) == [(1, 1)]
    assert rows(R.except_keys(a, b, ["k"])) == [(None, "y")]


def test_number_rows(spark):
    df = spark.range(1000).selectExpr("1000 - id as k").repartition(13)
    assert [tuple(r) for r in R.number_rows(df, ["k"]).orderBy("k").collect()] == [(i + 1, i) for i in range(1000)]
    ids = R.add_unique_ids(df, "id", "x_")
    assert ids.select("id").distinct().count() == 1000


def test_latest_row(spark):
    day = datetime.date
    df = spark.createDataFrame([("a", "1", day(2020, 1, 1)), ("a", "2", day(2021, 1, 1)), ("a", "3", day(2021, 1, 1)), ("b", "4", None), ("c", "6", None), ("c", "5", day(1850, 1, 1))], "k string, id string, at date")
    assert [(r.k, r.id) for r in R.latest_row(df, ["k"], F.col("at"), "id").orderBy("k").collect()] == [("a", "2"), ("b", "4"), ("c", "5")]
    assert [(r.k, r.id) for r in R.latest_row(df, ["k"], F.col("at"), "id", latest=False).orderBy("k").collect()] == [("a", "1"), ("b", "4"), ("c", "5")]


def test_validated_join(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, 2)], "k int, v int")
    assert R.validated_join(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError):
        R.validated_join(a, b, ["k"], validate="1:1")
    with pytest.raises(ValueError):
        R.check_disjoint(a, b, ["k"])


def test_suffix_and_ids(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (2, "x")], "k int, v string")
    assert R.with_suffix(df, "_l", ["k"]).columns == ["k", "v_l"]
    with pytest.raises(ValueError):
        R.with_suffix(df.withColumnRenamed("v", "v_l"), "_l")
    ids = [r.i for r in df.select(R.hashed_id("x_", [F.col("k"), F.col("v")]).alias("i")).collect()]
    assert len(set(ids)) == 3 and all(i.startswith("x_") and len(i) == 34 for i in ids)


def test_samples_repeat(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a, b = R.hash_sample(df, "k", 0.1, 3), R.hash_sample(df.repartition(9), "k", 0.1, 3)
    assert rows(a) == rows(b) and 120 < a.count() < 280
    assert R.capped_sample(df, "k", 5000).count() == 2000 and R.capped_sample(df, "k", 500).count() < 700


def test_lineage(spark):
    df = spark.createDataFrame([("r1", "s", "A", None), ("r2", "s", "A", None), ("r3", "s", "A", "m"), ("r4", None, "B", "n")], "record_id string, ssn string, a string, m string")
    out = lineage.dedupe(lineage.self_lineage(df), ["ssn", "a", "m"], "d")
    found = {}
    for r in out.df.join(out.pairs, "record_id").collect():
        found.setdefault((r.ssn, r.a, r.m), set()).add(r.source_record_id)
    assert found == {("s", "A", None): {"r1", "r2"}, ("s", "A", "m"): {"r3"}, (None, "B", "n"): {"r4"}}
    other = spark.createDataFrame([("t1", "s", 1), ("t2", "s", 2), ("t3", None, 3)], "record_id string, ssn string, z int")
    both = lineage.merge([out, lineage.self_lineage(other)], "m", ["ssn"], "left")
    assert both.df.count() == 4  # two names by two values; null numbers never match and drop out
    assert {r.source_record_id for r in both.pairs.collect()} == {"r1", "r2", "r3", "t1", "t2"}
    assert both.df.select("record_id").distinct().count() == 4


def test_reference_events(spark):
    events = spark.createDataFrame(
        [("1", "s", "Ann", "20000101", "creation"), ("2", "s", "Anna", "20100101", "creation"), ("3", "s", None, "20200101", "creation"), ("4", "s", "Late", "bad", "creation"), ("5", "t", None, None, "creation")],
        "record_id string, ssn string, first_name string, event_date string, event_type string",
    )
    from heddle.functions.text import parse_date

    best = reference.best_data(events, ["first_name"], parse_date(F.col("event_date"), "yyyyMMdd"))
    assert [(r.ssn, r.first_name) for r in best.collect()] == [("s", "Anna")]
    assert [r.o for r in spark.createDataFrame([("9x",), ("19",), (None,)], "v string").select(reference.is_itin(F.col("v")).alias("o")).collect()] == [True, False, False]


def test_crosswalk_and_truth(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "record_id string, ssn string")
    piks = lineage.id_crosswalk([df, df.where("ssn = '2'")])
    assert piks.count() == 2
    with pytest.raises(ValueError):
        lineage.attach_id(df, piks)
    data, truth = lineage.split_truth(df.withColumn("simulant_id", F.lit(1)))
    assert data.columns == df.columns and truth.columns == ["record_id", "simulant_id"]
    diagnostics = lineage.collisions(lineage.entities(Lineaged(df, df.selectExpr("record_id", "record_id as source_record_id")).pairs, truth))
    assert diagnostics["worst"].count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "record_id string, v int")
    io.write_with_truth(df, df.select("record_id"), str(tmp_path / "x"))
    assert io.read_parquet(spark, str(tmp_path / "x"), columns=["v"]).first().v == 1
    with pytest.raises(ValueError):
        io.write_with_truth(df.union(df), df, str(tmp_path / "y"))
    (tmp_path / "names.txt").write_text("Baby\nNA\nBaby\nTest\n")
    assert sorted(r.name for r in io.text_list(spark, str(tmp_path / "names.txt")).collect()) == ["Baby", "Test"]
    io.save_model({"m": {"a": {"2": 0.5}}}, str(tmp_path / "m"), spark)
    assert io.load_model(str(tmp_path / "m"), spark) == {"m": {"a": {"2": 0.5}}}
    io.pairs_report(spark.createDataFrame([], "match_probability double"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_config():
    low = {"ri": {"all": {"cores": 2, "mem": 5}, "link": {"cores": 4}, "make": {}}}
    assert config.layered(low, {"ri": {"link": {"mem": 9}}}) == {"ri": {"link": {"cores": 4, "mem": 9}, "make": {"cores": 2, "mem": 5}}}
    assert config.seconds("1-02:03:04") == 93_784 and config.seconds("00:10:00") == 600
    assert config.megabytes("15 GB") == 15_000 and config.megabytes("512MB") == 512
    with pytest.raises(ValueError):
        config.seconds("ten")


def test_simulated_sources(spark, tmp_path):
    """Files of the shape the workflow reads, the same however they are made; noise at its rates, and more where it is raised."""
    simulate.write_sources(spark, str(tmp_path), 1500, (2028,), seed=3)
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    counted, filed, events = read("simulated_census_2030"), read("simulated_taxes_1040_2028"), read("simulated_ssa_numident")
    assert {"simulant_id", "first_name", "middle_initial", "last_name", "date_of_birth", "street_number", "zipcode", "housing_type"} <= set(counted.columns)
    assert counted.count() > 1300 and 700 < filed.count() < 1300 and events.where("event_type = 'death'").count() > 10
    assert filed.select("simulant_id").distinct().count() == filed.count()
    people = simulate.population(spark, 1500, 3)
    again = simulate.census(people.repartition(13), 2030, seed=3)
    assert again.exceptAll(counted).isEmpty() and again.count() == counted.count()
    clean = simulate.census(people, 2030, {}, 3)
    differ = lambda df, c: df.select("simulant_id", F.col(c).alias("x")).join(clean.select("simulant_id", c), "simulant_id").where(f"x is null or x <> {c}").count()
    loud = simulate.census(people, 2030, simulate.noisier(simulate.NOISE, {"typo": 0.3, "wrong_digit": 0.001}), 3)
    assert 20 < differ(counted, "last_name") < 90 and differ(loud, "last_name") > 300
    assert differ(loud, "date_of_birth") == differ(counted, "date_of_birth") > 10
    assert loud.where("length(date_of_birth) <> 10").isEmpty()
    moved = simulate.with_address(people, 2029, seed=3).join(simulate.with_address(people, 2030, seed=3).select("simulant_id", F.col("street_number").alias("later")), "simulant_id").where("street_number <> later").count()
    assert 40 < moved < 220
