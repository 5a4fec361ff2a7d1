from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from heddle import catalog, catalog_linkage
from heddle.plans import cascade, model, prep
from heddle.plans.model import Comparison, Model
from heddle.streaming.incremental import link_stream

ONE = (Comparison("name", "exact"),)


def test_levels_and_scores(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None), (None, None)], "name_l string, name_r string")
    m = Model(ONE, {"name": {2: 0.9, 0: 0.1}}, {"name": {2: 0.1, 0: 0.9}}, 0.5)
    rows = model.score(pairs, m).collect()
    assert [r.gamma_name for r in rows] == [2, 0, -1, -1]
    assert [round(r.match_probability, 6) for r in rows] == [0.9, 0.1, 0.5, 0.5]
    assert rows[0].match_weight == pytest.approx(math.log2(9))
    assert Model.from_dict(m.as_dict()) == m


def test_blocking_ignores_nulls_and_salts_change_nothing(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None), ("3", "")], "record_id string, k string")
    plain = model.blocking_join(a, a, ["k"])
    assert sorted((r.record_id_l, r.record_id_r) for r in plain.collect()) == [("1", "1"), ("3", "3")]
    assert model.blocking_join(a, a, ["k"], salts=5).exceptAll(plain).isEmpty()
    assert model.count_blocked_pairs(a, a, ["k"]).agg(F.sum("n_pairs")).first()[0] == 2


def test_em_finds_the_parameters():
    """Pattern counts made from known parameters give them back."""
    c = tuple(Comparison(x, "exact") for x in "abc")
    m, u, prior, n = 0.9, 0.2, 0.3, 1_000_000
    patterns = []
    for i in range(8):
        agree = {x: 2 if i >> k & 1 else 0 for k, x in enumerate("abc")}
        p = prior * math.prod(m if g else 1 - m for g in agree.values()) + (1 - prior) * math.prod(u if g else 1 - u for g in agree.values())
        patterns.append((agree, p * n))
    got = model.maximise(patterns, c, {x: {2: u, 0: 1 - u} for x in "abc"}, prior / (1 - prior), rounds=200, tolerance=1e-9)
    assert all(got[x][2] == pytest.approx(m, abs=1e-3) for x in "abc")


def test_prior():
    assert model.prior_probability(0, 5, 0, 5) == 0.5
    assert model.prior_probability(100, 100, 100, 100) == pytest.approx(0.9 * 95 * 0.95 * 0.995 / 10_000)
    assert model.to_probability(model.to_odds(0.3)) == pytest.approx(0.3)


LINKS = "record_id_raw_input_file string, record_id_input string, record_id_reference string, match_probability double, module_name string, pass_name string"


def test_confirm(spark):
    """Ties between people drop a row; ties within a person don't; the dead go first; nickname twins share a row."""
    rows = [
        ("tie", "tie", "A", 0.99), ("tie", "tie", "B", 0.99), ("tie", "tie", "C", 0.98),
        ("same", "same", "A", 0.99), ("same", "same", "A2", 0.99),
        ("best", "best", "B", 0.99), ("best", "best", "C", 0.98),
        ("dead", "dead", "D", 0.999), ("dead", "dead", "C", 0.98), ("day", "day", "E", 0.99),
        ("twin", "twin1", "B", 0.98), ("twin", "twin2", "C", 0.99),
    ]
    links = spark.createDataFrame([(*r, "m", "p") for r in rows], LINKS)
    piks = spark.createDataFrame([("A", "a"), ("A2", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("E", "e")], "record_id_reference string, pik string")
    deaths = spark.createDataFrame([("d", "2020-01-01"), ("e", "2030-04-01"), ("c", None), ("b", "2030-04-02")], "pik string, x string").selectExpr("pik", "cast(x as date) as date_of_death")
    got = {r.record_id_raw_input_file: (r.pik, r.record_id_reference) for r in cascade.confirm(links, piks, deaths).collect()}
    assert got == {"same": ("a", "A"), "best": ("b", "B"), "dead": ("c", "C"), "twin": ("c", "C")}
    assert cascade.confirm(links.limit(0), piks, deaths).count() == 0


def test_switch_guard():
    with pytest.raises(ValueError):
        cascade.Module("x", "r", ("first_initial_cut",), (), (cascade.Pass("p", ("zip3",), prep.switch_names),))


def test_group_quarters(spark):
    gq, home = "Nursing home", "Household"
    rows = [("a", gq)] * 7 + [("a", home)] * 3 + [("b", gq)] * 69 + [("b", home)] * 31 + [("c", gq)] + [("d", gq), ("d", gq), ("d", None)] + [(None, gq)] * 3
    df = spark.createDataFrame(rows, "geokey string, housing_type string").withColumns({"street_number": F.lit("1"), "street_name": F.lit("X")})
    found = prep.group_quarters(df, 2)
    assert sorted(r.geokey for r in found.collect()) == ["a", "d"]
    out = prep.blocking_addresses(df, found).groupBy("geokey").agg(F.count("geokey_for_blocking").alias("n"), F.count("geokey").alias("k"))
    assert {r.geokey: r.n for r in out.collect()} == {"a": 0, "b": 100, "c": 1, "d": 0, None: 0}


def test_households(spark):
    inputs = spark.createDataFrame([("1", "h"), ("2", "h"), ("3", "full"), ("4", "none"), ("5", None)], "record_id_raw_input_file string, pseudo_household_id string")
    confirmed = spark.createDataFrame([("1", "p1"), ("3", "p3")], "record_id_raw_input_file string, pik string")
    rows = [("g1", "p1", "here"), ("g2", "p1", "there"), ("g3", "p9", "here"), ("g4", "p8", "there"), ("g5", "p7", "else"), ("g6", "p3", "here"), ("g7", "p1", "home"), ("g8", "p6", "home")]
    # A nursing home has an address but none for blocking, so nobody there joins a household.
    geobase = spark.createDataFrame([(*r, None if r[2] == "home" else r[2]) for r in rows], "record_id string, pik string, geokey string, geokey_for_blocking string")
    got = cascade.household_reference(inputs, confirmed, geobase)
    assert sorted((r.record_id, r.pseudo_household_id) for r in got.collect()) == [("g3", "h"), ("g4", "h")]


def test_linked_drops_nothing(spark):
    """The bound before strings are compared keeps every pair that reaches the threshold."""
    d = "/root/testdata/sf0.001"
    pairs = model.blocking_join(catalog_linkage.reference(spark, d), catalog_linkage.inputs(spark, d), ["first_name_1"])
    for threshold in (0.01, 0.5, 0.97):
        plain = model.score(pairs, catalog_linkage.MODEL).where(F.col("match_probability") >= threshold).select("record_id_l", "record_id_r")
        got = model.linked(pairs, catalog_linkage.MODEL, threshold).select("record_id_l", "record_id_r")
        assert plain.count() == got.count() > 0 and plain.exceptAll(got).isEmpty()


def test_report_and_transform(spark, tmp_path):
    """A pass may change its input rows in any way, and writes its best pairs, some below the threshold too."""
    d = "/root/testdata/sf0.001"
    p = cascade.Pass("upper", ("zipcode",), lambda df: df.withColumn("first_name_15", F.col("first_name_15")))
    module = cascade.Module("m", "people", (), catalog_linkage.ZIP.matching, (p,))
    links = cascade.run_pass(catalog_linkage.reference(spark, d), catalog_linkage.inputs(spark, d), module, p, catalog_linkage.MODEL, report=str(tmp_path))
    told = spark.read.option("header", True).csv(str(tmp_path / "m__upper"))
    assert links.count() > 0 and told.count() >= links.count() and float(told.agg(F.min("match_probability")).first()[0]) >= 0.77


def test_attach_checks_ids(spark):
    raw = spark.createDataFrame([("a",), ("b",)], "record_id string")
    ids = spark.createDataFrame([("a", "x"), ("a", "x")], "record_id_raw_input_file string, pik string")
    assert {r.record_id: r.pik for r in cascade.attach(raw, ids).collect()} == {"a": "x", "b": None}
    with pytest.raises(ValueError):
        cascade.attach(raw, ids.union(spark.createDataFrame([("a", "y")], ids.schema)))
    with pytest.raises(ValueError):
        cascade.attach(raw.union(raw), ids)


def test_full_cascade_is_accurate(spark):
    d = "/root/testdata/sf0.01"
    got = catalog.queries()["full_cascade"](spark, d).collect()
    given = [r for r in got if r.pik is not None]
    right = sum(r.pik == "pik" + r.record_id.removeprefix("in_") for r in given)
    assert len(given) > 0.85 * len(got) and right > 0.97 * len(given)


def test_streaming_matches_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    rows = catalog_linkage.inputs(spark, d)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    ref = catalog_linkage.reference(spark, d)

    def link(batch):
        return cascade.run_cascade(batch, {"people": ref}, catalog_linkage.MODEL, (catalog_linkage.ZIP,), households=False)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    link_stream(stream, link, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = link(rows)
    assert want.count() > 0 and want.select(got.columns).exceptAll(got).isEmpty() and got.count() == want.count()
