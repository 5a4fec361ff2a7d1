from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from heddle import session
from heddle.functions import noise, similarity, text
from heddle.functions.similarity import jaro_winkler, jaro_winkler_values, with_similarity


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_address_rules(spark):
    values = ["  main  street ", "12 Str", "", "   ", None, "strand", "a\tb\n c"]
    assert column(spark, values, text.standardize_address) == ["MAIN ST", "12 ST", None, None, None, "STRAND", "A B C"]
    assert column(spark, values[:2], lambda c: text.standardize_address(c, street_rule=False)) == ["MAIN STREET", "12 STR"]


def test_geokey(spark):
    df = spark.createDataFrame([("1", None, "X"), (None, None, None), ("", " ", "")], "a string, b string, c string")
    assert [r.g for r in df.select(text.geokey([F.col(c) for c in "abc"]).alias("g")).collect()] == ["1 X", None, None]


def test_dates(spark):
    values = ["01/02/1990", "1/2/1990", "02/30/1990", "x9/02/1990", None, "19900102"]
    got = column(spark, values, lambda c: text.parse_date(c, "M/d/yyyy").cast("string"))
    assert got == ["1990-01-02", "1990-01-02", None, None, None, None]


def test_initial_cut(spark):
    assert column(spark, [None, "", "Ann", "Ulla", "Zoe", "Bob", "bob"], text.initial_cut) == ["A-or-blank", None, "A-or-blank", "U-Z", "U-Z", "B", "b"]


def test_soundex(spark):
    values = ["Robert", "Rupert", "Ashcraft", "Tymczak", "Pfister", " 1st Main", "", "123", None]
    assert column(spark, values, text.soundex_key) == ["R163", "R163", "A261", "T522", "P236", "S355", "", "", None]
    assert column(spark, ["Smith"], text.reverse_soundex) == column(spark, ["htimS"], text.soundex_key)


NYSIIS = {
    "Worthy": "WARTY", "Ogata": "OGAT", "montgomery": "MANTGANARY", "Costales": "CASTAL", "Tu": "T", "martincevic": "MARTANCAFAC", "Catherine": "CATARAN", "Katherine": "CATARAN",
    "Katerina": "CATARAN", "Johnathan": "JANATAN", "Jonathan": "JANATAN", "John": "JAN", "Teresa": "TARAS", "Theresa": "TARAS", "Jessica": "JASAC", "Joshua": "JAS", "Bosch": "BAS",
    "Lapher": "LAFAR", "wiyh": "WY", "MacArthur": "MCARTAR", "Pheenard": "FANAD", "Schmittie": "SNATY", "Knaqze": "NAGS", "Knokno": "NAN", "Knoko": "NAC", "Macaw": "MC", "": "", "T": "T", "S": "S",
}


def test_nysiis(spark):
    assert column(spark, [*NYSIIS, None], text.nysiis) == [*NYSIIS.values(), None]


def test_jaro_winkler_is_duckdbs():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(0, 14)))
    pairs = [(word(), word()) for _ in range(1500)] + [("martha", "marhta"), ("", ""), ("a", ""), ("dixon", "dicksonx"), ("crate", "trace")]
    c = duckdb.connect()
    c.execute("create table t(i int, a varchar, b varchar)")
    c.executemany("insert into t values (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs) if a.isascii() and b.isascii()])
    want = dict(c.sql("select i, jaro_winkler_similarity(a, b) from t").fetchall())
    got = jaro_winkler_values([a for a, _ in pairs], [b for _, b in pairs])
    assert all(got[i] == pytest.approx(v, abs=1e-9) for i, v in want.items())


def test_jaro_winkler_column(spark):
    df = spark.createDataFrame([("ab", "ab"), ("ab", None), (None, None), ("", ""), ("martha", "marhta")], "a string, b string")
    direct = [r.s for r in df.select(jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()]
    assert direct[:4] == [1.0, None, None, 0.0] and direct[4] == pytest.approx(0.961111, abs=1e-6)
    once = {(r.a, r.b): r.s for r in with_similarity(df, "a", "b", "s").collect()}
    assert once[("ab", "ab")] == 1.0 and once[("ab", None)] is None and once[("", "")] == 0.0 and once[("martha", "marhta")] == direct[4]


def test_noise_keeps_rows_and_is_stable(spark):
    df = spark.createDataFrame([(str(i), "Mary-Ann", None, "van der Berg") for i in range(200)], "id string, first_name string, middle_name string, last_name string")
    once = noise.name_noise(df, ["first_name", "middle_name", "last_name"], 1, "id", "last_name")
    again = noise.name_noise(df.repartition(7), ["first_name", "middle_name", "last_name"], 1, "id", "last_name")
    assert once.exceptAll(again).isEmpty() and once.count() == 200
    always = noise.split_columns(df, ["first_name", "middle_name", "last_name"], 1.0, 1, "id").collect()
    assert all(" ".join(x for x in (r.first_name, r.middle_name, r.last_name) if x) == "Mary Ann van der Berg" for r in always)
    single = noise.split_columns(spark.createDataFrame([("1", "Cher")], "id string, first_name string"), ["first_name"], 1.0, 1, "id").first()
    assert single.first_name == "Cher"
    kept = noise.truncate_column(df, "first_name", 1.0, 4, 1, "id")
    assert {(r.first_name, r.last_name) for r in kept.collect()} == {("Mary", "van der Berg")}


def test_long_strings_are_compared_alike():
    """Pairs of any length in one batch, by both ways, and in time that grows with the length."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcde ") for _ in range(n))
    pairs = [(word(rnd.randint(0, 90)), word(rnd.randint(0, 90))) for _ in range(300)]
    pairs += [(a, a[:30] + word(3) + a[32:]) for a, _ in pairs]
    alone = [similarity._long(a, b) for a, b in pairs]
    assert similarity.jaro_winkler_values(*map(list, zip(*pairs))) == pytest.approx(alone, abs=1e-12)
    short = [p for p in pairs if max(map(len, p)) < 60]
    assert similarity._together(*map(list, zip(*short))) == pytest.approx([similarity._long(*p) for p in short], abs=1e-12)
    # All characters match and half of them are out of order.
    assert similarity.jaro_winkler_values(["ab" * 50_000, "x"], ["ba" * 50_000, "x"])[0] == pytest.approx(2.5 / 3)


def test_session_settings():
    few, many = session.settings(1 << 20, 8), session.settings(100 << 40, 4000, "hdfs://x")
    assert few["spark.sql.shuffle.partitions"] == "16" and int(many["spark.sql.shuffle.partitions"]) == 100_000 and many["spark.checkpoint.dir"] == "hdfs://x"
