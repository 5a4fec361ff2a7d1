"""Preparation of the input and reference files for linkage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ADDRESS_PARTS, geokey, initial_cut, nysiis, parse_date, prefix, replace_values, reverse_soundex, soundex_key, standardize_address
from ..operators.relational import hashed_id

PREFIXES = {"first_name": {"first_name_15": 15, "first_name_1": 1, "first_name_2": 2, "first_name_3": 3}, "last_name": {"last_name_12": 12, "last_name_1": 1, "last_name_2": 2, "last_name_3": 3}}
GQ_SHARE = 0.70


def expand_nicknames(df: DataFrame, nicknames: Mapping[str, str], dataset: str = "census_2030") -> DataFrame:
    """Rows, and copies of those with a nickname under the formal name; old ids stay as record_id_raw_input_file.

    The copies come from an explode, so the input is scanned once.
    """
    formal = replace_values(F.col("first_name"), nicknames)
    rows = df.withColumnRenamed("record_id", "record_id_raw_input_file").withColumn("_n", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("v"), F.col("first_name").alias("f")), F.struct(F.lit(1).alias("v"), formal.alias("f"))), lambda x: (x["v"] == 0) | x["f"].isNotNull())))
    rows = rows.withColumns({"first_name": F.col("_n.f"), "_v": F.col("_n.v")}).drop("_n")
    return rows.withColumn("record_id", hashed_id(f"{dataset}_", [F.col("record_id_raw_input_file"), F.col("_v")])).drop("_v")


def blank_fake_names(df: DataFrame, names: DataFrame | Sequence[str], columns: Sequence[str] = ("first_name", "last_name")) -> DataFrame:
    """Names that, in upper case, are in the list become null. A list given as a frame is joined."""
    if isinstance(names, DataFrame):
        for c in columns:
            listed = names.select(F.upper("name").alias("_fake")).distinct()
            df = df.join(listed, F.upper(c) == F.col("_fake"), "left").withColumn(c, F.when(F.col("_fake").isNull(), F.col(c))).drop("_fake")
        return df
    fake = [n.upper() for n in names]
    return df.withColumns({c: F.when(~F.coalesce(F.upper(c).isin(fake), F.lit(False)), F.col(c)) for c in columns})


def standardize_addresses(df: DataFrame, parts: Sequence[str] = ADDRESS_PARTS, street_rule: bool = True) -> DataFrame:
    return df.withColumns({c: standardize_address(F.col(c), street_rule) for c in parts})


def sufficient(df: DataFrame) -> DataFrame:
    """Rows with a first or a last name; the empty string is one."""
    return df.where(F.col("first_name").isNotNull() | F.col("last_name").isNotNull())


def split_birth_date(df: DataFrame, fmt: str) -> DataFrame:
    """day, month and year of birth as integers; the text goes."""
    date = parse_date(F.col("date_of_birth"), fmt)
    return df.withColumns({"day_of_birth": F.dayofmonth(date), "month_of_birth": F.month(date), "year_of_birth": F.year(date)}).drop("date_of_birth")


def add_geokey(df: DataFrame, parts: Sequence[str] = ADDRESS_PARTS) -> DataFrame:
    return df.withColumn("geokey", geokey([F.col(c) for c in parts]))


def group_quarters(df: DataFrame, least: int, share: float = GQ_SHARE) -> DataFrame:
    """geokeys where enough rows, and a large enough share of those that say, live in group quarters."""
    told = df.where(F.col("housing_type").isNotNull() & F.col("geokey").isNotNull()).withColumn("_gq", (F.col("housing_type") != "Household").cast("int"))
    return told.groupBy("geokey").agg(F.sum("_gq").alias("n"), F.avg("_gq").alias("share")).where((F.col("n") >= least) & (F.col("share") >= share)).select("geokey")


def blocking_addresses(df: DataFrame, quarters: DataFrame) -> DataFrame:
    """Address columns for blocking: null at group quarters, else the address."""
    marked = df.join(quarters.withColumn("_gq", F.lit(True)), "geokey", "left")
    blank = lambda c: F.when(F.col("_gq").isNull(), F.col(c))
    return marked.withColumns({f"{c}_for_blocking": blank(c) for c in ("geokey", "street_number", "street_name")}).select(*df.columns, "geokey_for_blocking", "street_number_for_blocking", "street_name_for_blocking")


def add_prefixes(df: DataFrame) -> DataFrame:
    """Name prefixes; a missing middle initial comes from the middle name."""
    columns = {out: prefix(F.col(c), k) for c, outs in PREFIXES.items() for out, k in outs.items()}
    if "middle_initial" not in df.columns:
        columns["middle_initial"] = prefix(F.col("middle_name"), 1)
    return df.withColumns(columns)


def switch_names(df: DataFrame) -> DataFrame:
    """First and last name change places and their prefixes follow; phonetic keys and cuts don't, so passes that switch must not use them."""
    other = {"first_name": "last_name", "last_name": "first_name"}
    new = other | {out: f"substring({other[c]}, 1, {k})" for c, outs in PREFIXES.items() for out, k in outs.items()}
    return df.selectExpr(*[f"{new[c]} as `{c}`" if c in new else f"`{c}`" for c in df.columns])


#: Columns that a name switch leaves as they were.
NOT_SWITCHED = ("first_name_nysiis", "last_name_nysiis", "first_name_reverse_soundex", "last_name_reverse_soundex", "first_initial_cut", "last_initial_cut")


def add_name_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"{c}_nysiis": nysiis(F.col(c)) for c in ("first_name", "last_name")}
        | {f"{c}_reverse_soundex": reverse_soundex(F.col(c)) for c in ("first_name", "last_name")}
        | {"first_initial_cut": initial_cut(F.col("first_name")), "last_initial_cut": initial_cut(F.col("last_name"))}
    )


def add_address_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"street_name_for_blocking_soundex": soundex_key(F.col("street_name_for_blocking")), "zip3": prefix(F.col("zipcode"), 3)})


def prepare_input(df: DataFrame, nicknames: Mapping[str, str], fake: DataFrame | Sequence[str], street_rule: bool = True) -> DataFrame:
    """The input file up to its geokey: nickname copies, fake names, addresses, sufficiency, birth date."""
    steps = [
        lambda d: expand_nicknames(d, nicknames),
        lambda d: blank_fake_names(d, fake),
        lambda d: standardize_addresses(d, street_rule=street_rule),
        sufficient,
        lambda d: split_birth_date(d, "M/d/yyyy"),
        add_geokey,
    ]
    return reduce(lambda d, step: step(d), steps, df)


def finish_input(df: DataFrame, quarters: DataFrame) -> DataFrame:
    return add_address_keys(add_name_keys(add_prefixes(blocking_addresses(df, quarters))))


def prepare_geobase(df: DataFrame, quarters: DataFrame) -> DataFrame:
    """The address reference file: prefixes and address keys."""
    return add_address_keys(add_prefixes(blocking_addresses(add_geokey(split_birth_date(df, "yyyyMMdd")), quarters)))


def prepare_name_dob(df: DataFrame) -> DataFrame:
    """The name and birth date reference file: prefixes and name keys."""
    return add_name_keys(add_prefixes(split_birth_date(df, "yyyyMMdd")))
