"""Reference files built from administrative sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_date, standardize_address
from ..operators.relational import latest_row
from . import lineage
from .lineage import Lineaged

NAMES = ("first_name", "middle_name", "last_name")
EARLY, LATE = "1900-01-01", "2100-01-01"


def best_data(events: DataFrame, columns: Sequence[str], at: Column, by: str = "ssn", tie: str = "record_id", latest: bool = True) -> DataFrame:
    """For each key the latest (or earliest) row that has any of the columns; undated rows lose."""
    some = events.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
    dated = F.coalesce(at, F.lit(EARLY if latest else LATE).cast("date"))
    return latest_row(some.select(by, tie, *columns, dated.alias("_at")), [by], F.col("_at"), tie, latest).drop("_at")


def census_numident(ssa: Lineaged) -> Lineaged:
    """One row per number: best name, best birth date, best death date; numbers without a name are absent."""
    at = parse_date(F.col("event_date"), "yyyyMMdd")
    name = best_data(ssa.df, NAMES, at)
    birth = best_data(ssa.df, ["date_of_birth"], at)
    deaths = ssa.df.where("event_type = 'death'")
    death = best_data(deaths, ["event_date"], at).withColumnRenamed("event_date", "date_of_death")
    take = lambda df: Lineaged(df, df.select("record_id").join(ssa.pairs, "record_id"))
    return lineage.merge([take(name), take(birth), take(death)], "simulated_census_numident", ["ssn"], "left")


def alternate_names(ssa: Lineaged) -> Lineaged:
    return lineage.dedupe(ssa, ["ssn", *NAMES], "simulated_alternate_name_numident")


def alternate_birth_dates(ssa: Lineaged) -> Lineaged:
    return lineage.dedupe(ssa, ["ssn", "date_of_birth"], "simulated_alternate_dob_numident")


def is_itin(ssn: Column) -> Column:
    """A taxpayer number given to people without a social security number: it starts with 9."""
    return F.coalesce(ssn.startswith("9"), F.lit(False))


def itin_names(filings: Lineaged) -> Lineaged:
    """Distinct names on filings under such numbers; they have no birth date."""
    rows = filings.df.where(is_itin(F.col("ssn")))
    if "middle_name" not in rows.columns:
        rows = rows.withColumnRenamed("middle_initial", "middle_name")
    return lineage.dedupe(Lineaged(rows, filings.pairs), ["ssn", *NAMES], "itin_names")


def name_dob_file(names: Lineaged, births: Lineaged, itins: Lineaged) -> Lineaged:
    """All combinations of a number's names and birth dates, and the names under taxpayer numbers."""
    both = lineage.merge([names, births], "name_dob", ["ssn"], "left")
    return lineage.concatenate([both, itins], "simulated_name_dob_reference_file")


def tax_addresses(filings: Sequence[Lineaged], street_rule: bool = True) -> Lineaged:
    """Distinct standardised addresses of each number on any filing."""
    everything = lineage.concatenate(filings, "tax")
    columns = [f"mailing_address_{p}" for p in ("street_number", "street_name", "unit_number", "po_box", "city", "state", "zipcode")]
    rows = everything.df.where(F.col("ssn").isNotNull()).withColumns({c: standardize_address(F.col(c), street_rule) for c in columns})
    return lineage.dedupe(Lineaged(rows, everything.pairs), ["ssn", *columns], "tax_addresses")


def geobase_file(name_dob: Lineaged, addresses: Lineaged) -> Lineaged:
    """All combinations of a number's name and birth date rows with its addresses."""
    return lineage.merge([name_dob, addresses], "simulated_geobase_reference_file", ["ssn"], "left")


def expected_rows(left: DataFrame, right: DataFrame, key: str = "ssn") -> DataFrame:
    """A rough size of all combinations of two files by a key, before they are made: rows of one times the mean number of the other's rows for a key."""
    per_key = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).agg(F.avg("_n").alias("_mean"))
    return left.agg((F.count("*") * per_key.scalar()).alias("expected_rows"))


def itin_overlap(numident: DataFrame) -> int:
    return numident.where(is_itin(F.col("ssn"))).count()


