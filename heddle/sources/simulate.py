"""Made sources of the workflow: people in households who move, are counted, file taxes and die.

Every value is a hash of a person's or household's number, so a table of any size is made in parallel,
row by row, and is the same on every cluster. Noise is drawn by the same means.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import uniform

FIRST = ("Abel", "Beate", "Carla", "Dmitri", "Edda", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Kira", "Lamar", "Mona", "Nils", "Olga", "Pavel", "Rosa", "Samir", "Tilda", "Yusuf")
LAST = ("Ahlgren", "Barlow", "Castano", "Dray", "Eklund", "Fontaine", "Garrick", "Holloway", "Ibarra", "Jespersen", "Kowal", "Lindqvist", "Marchetti", "Novak", "Okafor", "Petrov", "Quiroga", "Rasmussen", "Salinas", "Tremblay")
STREETS = ("Maple Street", "Harbor Road", "Mill Lane", "Quarry Avenue", "Orchard Str", "Bishop Court", "Canal Street", "Summit Drive")
#: Shares: with a social security number, moving in a year, in group quarters, filing and employed among adults.
NUMBERED, MOVING, QUARTERED, FILING, EMPLOYED = 0.93, 0.08, 0.02, 0.85, 0.7

#: Rates of noise by column and kind.
Noise = Mapping[str, Mapping[str, float]]
NOISE: Noise = {
    "first_name": {"missing": 0.01, "typo": 0.02}, "last_name": {"missing": 0.01, "typo": 0.02}, "date_of_birth": {"missing": 0.01, "wrong_digit": 0.02},
    "street_number": {"wrong_digit": 0.02}, "street_name": {"typo": 0.02}, "zipcode": {"wrong_digit": 0.02, "missing": 0.01}, "ssn": {"wrong_digit": 0.005},
}


def noisier(noise: Noise, rates: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """The configuration with the rates of some kinds raised, where a column has the kind at all; never lowered."""
    return {column: {kind: max(rate, rates.get(kind, 0.0)) for kind, rate in kinds.items()} for column, kinds in noise.items()}


def _choice(values: Sequence[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def population(spark: SparkSession, people: int, seed: int = 1) -> DataFrame:
    """simulant_id, household, names, birth (a date), ssn. Three people in a household share a last name; a number that starts with 9 is a taxpayer's."""
    rows = spark.range(people).select(F.col("id").alias("simulant_id"), F.floor(F.col("id") / 3).alias("household"))
    u = lambda k: uniform(F.col("simulant_id"), seed, k)
    number = F.lpad(F.col("simulant_id").cast("string"), 8, "0")
    return rows.select(
        "simulant_id", "household", _choice(FIRST, u(0)).alias("first_name"), _choice(FIRST, u(1)).alias("middle_name"), _choice(LAST, uniform(F.col("household"), seed, 2)).alias("last_name"),
        F.date_add(F.lit("1930-01-01").cast("date"), F.floor(u(3) * 33_000).cast("int")).alias("birth"), F.concat(F.when(u(4) < NUMBERED, "1").otherwise("9"), number).alias("ssn"),
    )


def with_address(people: DataFrame, year: int, since: int = 2020, seed: int = 1) -> DataFrame:
    """Adds the household's address in a year; every move since the first year gives a new one."""
    key = F.col("household").cast("string")
    moves = sum((F.when(uniform(key, seed, 100 + y - since) < MOVING, 1).otherwise(0) for y in range(since, year + 1)), F.lit(0))
    rows = people.withColumn("_home", F.concat_ws("/", key, moves.cast("string")))
    u = lambda k: uniform(F.col("_home"), seed, k)
    zipcode = F.lpad((F.floor(u(13) * 400) + 10_000).cast("string"), 5, "0")
    return rows.withColumns({
        "street_number": (F.floor(u(10) * 9999) + 1).cast("string"), "street_name": _choice(STREETS, u(11)), "unit_number": F.when(u(12) < 0.2, F.concat(F.lit("Apt "), (F.floor(u(12) * 100) + 1).cast("string"))),
        "zipcode": zipcode, "city": F.concat(F.lit("Town "), F.substring(zipcode, 3, 1)), "state": F.lit("RI"), "housing_type": F.when(u(14) < QUARTERED, "Nursing home").otherwise("Household"),
    }).drop("_home")


def with_noise(df: DataFrame, noise: Noise, key: str, seed: int) -> DataFrame:
    """Columns of the configuration with a letter or a digit replaced, or missing, at their rates; other columns of it are passed over."""
    changed = {}
    for i, (column, kinds) in enumerate(sorted(noise.items())):
        if column not in df.columns:
            continue
        value = F.col(column)
        u = lambda k: uniform(F.col(key), seed, 1000 + 10 * i + k)  # noqa: E731, B023
        at = (F.floor(u(0) * F.char_length(value)) + 1).cast("int")
        put = lambda v, c: F.when(F.char_length(v) > 0, F.concat(F.substring(v, F.lit(1), at - 1), c, F.substr(v, at + 1))).otherwise(v)  # noqa: E731, B023
        if rate := kinds.get("typo"):
            letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.floor(u(1) * 26) + 1).cast("int"), F.lit(1))
            value = F.when(u(2) < rate, put(F.col(column), letter)).otherwise(value)
        if rate := kinds.get("wrong_digit"):
            old = F.substring(F.col(column), at, F.lit(1))
            digit = F.when(old.rlike("[0-9]"), F.pmod(old.cast("int") + 1 + F.floor(u(3) * 9).cast("int"), F.lit(10)).cast("string")).otherwise(old)
            value = F.when(u(4) < rate, put(F.col(column), digit)).otherwise(value)
        if rate := kinds.get("missing"):
            value = F.when(u(5) >= rate, value)
        changed[column] = value
    return df.withColumns(changed) if changed else df


ADDRESS = ("street_number", "street_name", "unit_number", "city", "state", "zipcode")


def census(people: DataFrame, year: int, noise: Noise = NOISE, seed: int = 1) -> DataFrame:
    """The count of a year: everyone born before it, at their address."""
    rows = with_address(people, year, seed=seed).where(F.year("birth") < year)
    rows = rows.select("simulant_id", "first_name", F.substring("middle_name", 1, 1).alias("middle_initial"), "last_name", F.date_format("birth", "MM/dd/yyyy").alias("date_of_birth"), *ADDRESS, "housing_type")
    return with_noise(rows, noise, "simulant_id", seed + 1)


def taxes(people: DataFrame, year: int, share: float, noise: Noise = NOISE, seed: int = 1, kind: int = 0) -> DataFrame:
    """Filings of a year by a share of the adults, with mailing addresses; kinds of filings are drawn apart."""
    drawn = seed + year + 10_000 * kind
    adults = with_address(people, year, seed=seed).where((F.lit(year) - F.year("birth") >= 18) & (uniform(F.col("simulant_id"), drawn, 50) < share))
    rows = with_noise(adults, noise, "simulant_id", drawn)
    mail = [F.col(c).alias(f"mailing_address_{c}") for c in ADDRESS]
    return rows.select("simulant_id", "ssn", "first_name", F.substring("middle_name", 1, 1).alias("middle_initial"), "last_name", *mail, F.lit(None).cast("string").alias("mailing_address_po_box"))


def social_security(people: DataFrame, year: int, seed: int = 1) -> DataFrame:
    """Events up to a year of everyone with a social security number: the number's creation at birth, and the deaths of some of the old."""
    known = people.where(~F.col("ssn").startswith("9"))
    text = lambda d: F.date_format(d, "yyyyMMdd")
    columns = ["simulant_id", "ssn", "first_name", "middle_name", "last_name", text(F.col("birth")).alias("date_of_birth")]
    died = F.date_add("birth", F.floor(28_000 + uniform(F.col("simulant_id"), seed, 60) * 9000).cast("int"))
    births = known.select(*columns, F.lit("creation").alias("event_type"), text(F.col("birth")).alias("event_date"))
    deaths = known.where((F.year(died) <= year) & (uniform(F.col("simulant_id"), seed, 61) < 0.3)).select(*columns, F.lit("death").alias("event_type"), text(died).alias("event_date"))
    return births.union(deaths)


def write_sources(spark: SparkSession, path: str, people: int, tax_years: Sequence[int], noise: Noise = NOISE, seed: int = 1, census_year: int = 2030) -> None:
    """All source files of the workflow."""
    everyone = population(spark, people, seed)
    census(everyone, census_year, noise, seed).write.mode("overwrite").parquet(f"{path}/simulated_census_{census_year}.parquet")
    social_security(everyone, census_year - 1, seed).write.mode("overwrite").parquet(f"{path}/simulated_ssa_numident.parquet")
    for year in tax_years:
        taxes(everyone, year, FILING, noise, seed).write.mode("overwrite").parquet(f"{path}/simulated_taxes_1040_{year}.parquet")
        taxes(everyone, year, EMPLOYED, noise, seed, 1).write.mode("overwrite").parquet(f"{path}/simulated_taxes_w2_and_1099_{year}.parquet")
