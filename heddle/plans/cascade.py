"""The linkage cascade: modules of passes, each seeing only what is still without a link."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import check_disjoint, concat, except_keys, unique_list, validated_join
from ..runtime import stored
from ..sources.io import pairs_report
from .model import Model, blocking_join, count_blocked_pairs, linked
from .prep import NOT_SWITCHED, switch_names

THRESHOLD, CENSUS_DAY = 0.97, "2030-04-01"
#: How far below the threshold pairs are shown in a pass's report.
BELOW = 0.2


@dataclass(frozen=True)
class Pass:
    """`transform` changes the input rows before they are blocked."""

    name: str
    blocking: tuple[str, ...]
    transform: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Module:
    """Cut columns are added to every pass's blocking columns; bayes_factor is what agreeing on them says beyond the comparisons."""

    name: str
    reference: str
    cuts: tuple[str, ...]
    matching: tuple[str, ...]
    passes: tuple[Pass, ...]
    bayes_factor: float = 1.0

    def __post_init__(self) -> None:
        for p in self.passes:
            if p.transform is switch_names and (bad := {*self.cuts, *p.blocking} & set(NOT_SWITCHED)):
                raise ValueError(f"{p.name} switches names but blocks on {sorted(bad)}, which a switch leaves as they were")


# The modules' and passes' names, cut columns, blocking columns and Bayes factor are part of the results.
_DATE = ("day_of_birth", "month_of_birth", "year_of_birth")
_PERSON = ("first_name_15", "last_name_12", "middle_initial", *_DATE)
_FIRST2 = ("first_name_2", "last_name_2")

GEOSEARCH = Module("geosearch", "geobase", ("zip3",), (*_PERSON, "geokey"), (
    Pass("geokey", ("geokey_for_blocking",)),
    Pass("geokey name switch", ("geokey_for_blocking",), switch_names),
    Pass("house number and street name Soundex", ("street_number_for_blocking", "street_name_for_blocking_soundex")),
    Pass("house number and street name Soundex name switch", ("street_number_for_blocking", "street_name_for_blocking_soundex"), switch_names),
    Pass("some name and DOB information", (*_FIRST2, "year_of_birth")),
))
NAMESEARCH = Module("namesearch", "name_dob", ("first_initial_cut", "last_initial_cut"), _PERSON, (
    Pass("DOB and NYSIIS of name", (*_DATE, "first_name_nysiis", "last_name_nysiis")),
    Pass("DOB and initials", (*_DATE, "first_name_1", "last_name_1")),
    Pass("year of birth and first two characters of name", ("year_of_birth", *_FIRST2)),
    Pass("birthday and first two characters of name", ("day_of_birth", "month_of_birth", *_FIRST2)),
))
DOBSEARCH = Module("dobsearch", "name_dob", ("day_of_birth", "month_of_birth"), _PERSON, (
    Pass("initials name switch", ("first_name_1", "last_name_1"), switch_names),
    Pass("first three characters of name", ("first_name_3", "last_name_3")),
    Pass("reverse Soundex of name", ("first_name_reverse_soundex", "last_name_reverse_soundex")),
    Pass("first two characters of first name and year of birth", ("first_name_2", "year_of_birth")),
))
HHCOMPSEARCH = Module("hhcompsearch", "households", ("pseudo_household_id",), _PERSON, (
    Pass("initials", ("first_name_1", "last_name_1")),
    Pass("year of birth", ("year_of_birth",)),
), 1000.0)
CASCADE = (GEOSEARCH, NAMESEARCH, DOBSEARCH)


def run_pass(reference: DataFrame, inputs: DataFrame, module: Module, p: Pass, model: Model, threshold: float = THRESHOLD, salts: int = 1, most_pairs: int | None = None, report: str | None = None) -> DataFrame:
    """Links (record_id_raw_input_file, record_id_input, record_id_reference, match_probability, module_name, pass_name) of one pass.

    With `most_pairs`, blocks are counted first and the pass is refused beyond it. With `report`, a folder,
    the best pairs down to some way below the threshold are written there for inspection.
    """
    by = unique_list([*module.cuts, *p.blocking])
    rows = p.transform(inputs) if p.transform else inputs
    if most_pairs is not None:
        total = count_blocked_pairs(reference, rows, by).agg(F.sum("n_pairs")).first()[0] or 0
        if total > most_pairs:
            raise ValueError(f"{module.name}, {p.name}: {total} pairs")
    # Only what blocking and comparisons need crosses the shuffle.
    columns = unique_list(["record_id", *module.matching, *by])
    pairs = blocking_join(reference.select(columns), rows.select(*columns, "record_id_raw_input_file"), by, salts)
    scored = linked(pairs, model.only(module.matching), threshold - (BELOW if report else 0.0), module.bayes_factor)
    if report:
        scored = stored(scored)
        pairs_report(scored, f"{report}/{module.name}__{p.name}".replace(" ", "_"))
        scored = scored.where(F.col("match_probability") >= threshold)
    told = scored.selectExpr("record_id_raw_input_file_r as record_id_raw_input_file", "record_id_r as record_id_input", "record_id_l as record_id_reference", "match_probability")
    return told.withColumns({"module_name": F.lit(module.name), "pass_name": F.lit(p.name)})


def run_module(reference: DataFrame, inputs: DataFrame, module: Module, model: Model, threshold: float = THRESHOLD, report: str | None = None) -> DataFrame:
    """Provisional links of all passes. A record linked in one pass is out of the next ones; its nickname twin isn't."""
    links: list[DataFrame] = []
    for p in module.passes:
        remaining = inputs
        if links:
            remaining = except_keys(inputs, concat(links).select(F.col("record_id_input").alias("record_id")), ["record_id"])
        links.append(stored(run_pass(reference, remaining, module, p, model, threshold, report=report)))
    return concat(links)


def confirm(links: DataFrame, piks: DataFrame, deaths: DataFrame | None = None, day: str = CENSUS_DAY) -> DataFrame:
    """One link for each raw input row, or none.

    piks is (record_id_reference, pik); deaths (pik, date_of_death). Links to people who died by the day
    go first, so a living second best can win. Of the rest, a row whose best probability is reached by
    different people loses all its links; else its best link stays, ties going to the smaller ids.
    """
    known = links.join(piks, "record_id_reference", "left")
    if deaths is not None:
        known = known.join(deaths.groupBy("pik").agg(F.min("date_of_death").alias("_died")), "pik", "left")
        known = known.where(F.col("_died").isNull() | (F.col("_died") > F.lit(day).cast("date"))).drop("_died")
    row = Window.partitionBy("record_id_raw_input_file")
    top = F.max("match_probability").over(row)
    best = known.withColumn("_top", top).withColumn("_piks", F.size(F.collect_set(F.when(F.col("match_probability") == F.col("_top"), F.col("pik"))).over(row)))
    order = row.orderBy(F.desc("match_probability"), "pik", "record_id_reference", "record_id_input", "module_name", "pass_name")
    kept = best.where("_piks <= 1").withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return kept.select("record_id_raw_input_file", "record_id_input", "record_id_reference", "pik", "module_name", "pass_name", "match_probability")


def household_reference(inputs: DataFrame, confirmed: DataFrame, geobase: DataFrame) -> DataFrame:
    """Reference rows at any address of the people of households where some but not all rows have an id.

    `inputs` has pseudo_household_id and record_id_raw_input_file, `confirmed` (record_id_raw_input_file,
    pik), `geobase` pik and geokey_for_blocking, which leaves out group quarters. People with an id
    anywhere are left out. A row may come with several households.
    """
    rows = inputs.join(confirmed.select("record_id_raw_input_file", "pik"), "record_id_raw_input_file", "left").where(F.col("pseudo_household_id").isNotNull())
    sizes = rows.groupBy("pseudo_household_id").agg(F.count("pik").alias("piked"), (F.count("*") - F.count("pik")).alias("unpiked"))
    eligible = sizes.where("piked > 0 and unpiked > 0").select("pseudo_household_id")
    people = rows.join(eligible, "pseudo_household_id", "left_semi").select("pseudo_household_id", "pik").dropna().distinct()
    address = "geokey_for_blocking"
    places = people.join(geobase.select("pik", address).dropna().distinct(), "pik").select("pseudo_household_id", address).distinct()
    open_ = geobase.where(F.col(address).isNotNull()).join(confirmed.select("pik").distinct(), "pik", "left_anti")
    return open_.join(places, address)


def with_household_ids(inputs: DataFrame) -> DataFrame:
    """pseudo_household_id: the address for blocking; an id of its own would say no more."""
    return inputs.withColumn("pseudo_household_id", F.col("geokey_for_blocking"))


def run_cascade(
    inputs: DataFrame, references: dict[str, DataFrame], model: Model, modules: Sequence[Module] = CASCADE, households: bool = True, deaths: DataFrame | None = None,
    threshold: float = THRESHOLD, report: str | None = None,
) -> DataFrame:
    """Confirmed links of all modules. A raw row confirmed in one module is out of the later ones.

    references maps a module's reference name to a frame with record_id and pik.
    """
    confirmed: list[DataFrame] = []
    order = [*modules, *([HHCOMPSEARCH] if households else [])]
    for module in order:
        so_far = concat(confirmed) if confirmed else None
        remaining = except_keys(inputs, so_far, ["record_id_raw_input_file"]) if so_far is not None else inputs
        reference = references.get(module.reference)
        if module.reference == "households":
            if so_far is None:
                continue
            everyone = with_household_ids(inputs)
            reference = stored(household_reference(everyone, so_far, references["geobase"]))
            remaining = with_household_ids(remaining)
        links = run_module(reference, remaining, module, model, threshold, report)
        piks = reference.select(F.col("record_id").alias("record_id_reference"), "pik").distinct()
        new = stored(confirm(links, piks, deaths))
        if so_far is not None:
            check_disjoint(new, so_far, ["record_id_raw_input_file"])
        confirmed.append(new)
    return concat(confirmed)


def attach(raw: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The raw input with pik, null where there is no link; raises if a row has two ids or a record id occurs twice."""
    ids = confirmed.select(F.col("record_id_raw_input_file").alias("record_id"), "pik").distinct()
    return validated_join(raw, ids, ["record_id"], "left", "1:1")


def by_pass(links: DataFrame) -> DataFrame:
    return links.groupBy("module_name", "pass_name").agg(F.count("*").alias("links")).orderBy(F.desc("links"), "module_name", "pass_name")
