"""The whole workflow from source files to accuracy, in three stages that meet in Parquet files.

Sources (Parquet in one folder): simulated_census_2030; simulated_taxes_1040_<year> and
simulated_taxes_w2_and_1099_<year>; simulated_ssa_numident. All have simulant_id, the ground truth,
which is split off when a source is read. The linking stage is given no truth.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import name_noise
from ..functions.text import parse_date
from ..operators.relational import add_record_ids, concat, strip_prefix
from ..runtime import stored
from ..sources.io import read_parquet, write_parquet, write_with_truth
from . import cascade, evaluate, lineage, model, prep, reference
from .lineage import Lineaged

YEARS = tuple(range(2025, 2030))
REFERENCES = ("simulated_census_numident", "simulated_alternate_name_numident", "simulated_alternate_dob_numident", "simulated_name_dob_reference_file", "simulated_geobase_reference_file")
SESSIONS = ((("first_name_15", "zipcode"), ("first_name_15",)), (("geokey",), ("geokey",)))


def _source(df: DataFrame, name: str, names: Sequence[str], seed: int, truncate: str | None = None) -> tuple[Lineaged, DataFrame]:
    """A source with ids, noise in its names, its own lineage, and its truth."""
    rows = name_noise(add_record_ids(df, name), names, seed, "record_id", truncate)
    data, truth = lineage.split_truth(stored(rows))
    return lineage.self_lineage(data), truth


def generate_files(spark: SparkSession, sources: str, out: str, years: Sequence[int] = YEARS, street_rule: bool = True) -> None:
    """Reference files with ids, their ground truth, the input file, and the (pik, simulant_id) pairs."""
    years_of = lambda kind: concat([read_parquet(spark, f"{sources}/{kind}_{y}.parquet").withColumn("tax_year", F.lit(y)) for y in years])
    initial = ("first_name", "middle_initial", "last_name")
    individual, t1 = _source(years_of("simulated_taxes_1040"), "simulated_taxes_1040", initial, 1, "last_name")
    employer, t2 = _source(years_of("simulated_taxes_w2_and_1099"), "simulated_taxes_w2_and_1099", initial, 4, "last_name")
    ssa, t3 = _source(read_parquet(spark, f"{sources}/simulated_ssa_numident.parquet"), "simulated_ssa_numident", reference.NAMES, 7)
    census, t4 = _source(read_parquet(spark, f"{sources}/simulated_census_2030.parquet"), "simulated_census_2030", initial, 9)
    truth = concat([t1, t2, t3])

    names, births = reference.alternate_names(ssa), reference.alternate_birth_dates(ssa)
    name_dob = reference.name_dob_file(names, births, reference.itin_names(individual))
    geobase = reference.geobase_file(name_dob, reference.tax_addresses([individual, employer], street_rule))
    files = dict(zip(REFERENCES, (reference.census_numident(ssa), names, births, name_dob, geobase), strict=True))
    files = {k: Lineaged(stored(v.df), stored(v.pairs)) for k, v in files.items()}

    piks = stored(lineage.id_crosswalk([v.df for v in files.values()]))
    frames = []
    for name, part in files.items():
        known = lineage.entities(part.pairs, truth)
        write_with_truth(lineage.attach_id(part.df, piks), known, f"{out}/{name}")
        frames.append((part.df, known))
    pairs = lineage.value_entities(frames).join(piks, "ssn").select("pik", "simulant_id").distinct()
    write_parquet(pairs, f"{out}/simulated_pik_simulant_pairs")
    write_with_truth(census.df, t4, f"{out}/simulated_census_2030")


def link(
    spark: SparkSession, files: str, out: str, nicknames: Mapping[str, str], fake_names: DataFrame | Sequence[str], gq_least: int = 250,
    threshold: float = cascade.THRESHOLD, training_rows: int = 1_000_000, training_pairs: int = 10_000_000, street_rule: bool = True, report: str | None = None,
) -> model.Model:
    """Writes confirmed_piks and census_2030_piked, and returns the trained model. With `report`, a folder, each pass's best pairs are written there."""
    raw = read_parquet(spark, f"{files}/simulated_census_2030")
    prepared = stored(prep.prepare_input(raw, nicknames, fake_names, street_rule))
    quarters = stored(prep.group_quarters(prepared, gq_least))
    rows = stored(prep.finish_input(prepared, quarters))
    geobase = strip_prefix(read_parquet(spark, f"{files}/simulated_geobase_reference_file"), "mailing_address_")
    geobase = stored(prep.prepare_geobase(geobase, quarters))
    name_dob = stored(prep.prepare_name_dob(read_parquet(spark, f"{files}/simulated_name_dob_reference_file")))
    trained = model.train(rows, geobase, model.COMPARISONS, SESSIONS, "record_id", "record_id", model.estimate_prior(rows, geobase), training_rows, training_pairs)
    numident = read_parquet(spark, f"{files}/simulated_census_numident", columns=["pik", "date_of_death"])
    deaths = numident.select("pik", parse_date(F.col("date_of_death"), "yyyyMMdd").alias("date_of_death"))
    links = cascade.run_cascade(rows, {"geobase": geobase, "name_dob": name_dob}, trained, deaths=deaths, threshold=threshold, report=report)
    confirmed = write_parquet(links.withColumnRenamed("record_id_input", "record_id_census_2030").withColumnRenamed("record_id_reference", "record_id_reference_file"), f"{out}/confirmed_piks")
    write_parquet(cascade.attach(raw, confirmed), f"{out}/census_2030_piked")
    return trained


def run_stages(spark: SparkSession, sources: str, files: str, out: str, nicknames: Mapping[str, str], fake_names: DataFrame | Sequence[str], years: Sequence[int] = YEARS, **options) -> list[str]:
    """Runs, in order, the stages whose outputs are missing or older than their inputs; returns their names.

    Options go to link(). A stage's output counts once Spark has marked it complete.
    """
    first = [f"{sources}/{n}.parquet" for n in ("simulated_census_2030", "simulated_ssa_numident", *[f"{kind}_{y}" for kind in ("simulated_taxes_1040", "simulated_taxes_w2_and_1099") for y in years])]
    made = [f"{files}/{n}" for n in (*REFERENCES, *[f"{n}_ground_truth" for n in REFERENCES], "simulated_pik_simulant_pairs", "simulated_census_2030", "simulated_census_2030_ground_truth")]
    linked = [f"{out}/{n}" for n in ("confirmed_piks", "census_2030_piked")]
    stages = [
        ("generate_files", first, made, lambda: generate_files(spark, sources, files, years)),
        ("link", made, linked, lambda: link(spark, files, out, nicknames, fake_names, **options)),
    ]
    ran = []
    for name, inputs, outputs, stage in stages:
        written = [_written_at(spark, p) for p in outputs]
        if not all(written) or min(written) < max(_written_at(spark, p) for p in inputs):
            stage()
            ran.append(name)
    return ran


def _written_at(spark: SparkSession, path: str) -> int:
    """When a file, or a folder that Spark completed, was written, in milliseconds; 0 if it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop.Path(path)):
        return 0
    if system.getFileStatus(hadoop.Path(path)).isFile():
        return system.getFileStatus(hadoop.Path(path)).getModificationTime()
    done = hadoop.Path(f"{path}/_SUCCESS")
    return system.getFileStatus(done).getModificationTime() if system.exists(done) else 0


def accuracy(spark: SparkSession, files: str, out: str) -> dict[str, DataFrame]:
    """identified, accuracy, by_module, by_pass, possible, duplicates, missed; links, links_by_module, links_by_pass judge the reference records that were linked."""
    piked, links = read_parquet(spark, f"{out}/census_2030_piked"), read_parquet(spark, f"{out}/confirmed_piks")
    truth = read_parquet(spark, f"{files}/simulated_census_2030_ground_truth")
    pairs = read_parquet(spark, f"{files}/simulated_pik_simulant_pairs")
    known = [read_parquet(spark, f"{files}/{n}_ground_truth") for n in REFERENCES]
    assigned = links.withColumnRenamed("record_id_raw_input_file", "record_id")
    judged = assigned.withColumnRenamed("record_id_reference_file", "record_id_reference")
    of = reduce(DataFrame.unionByName, [k.select(F.col("record_id").alias("record_id_reference"), "simulant_id") for k in known])
    if links.count() != piked.where(F.col("pik").isNotNull()).count():
        raise ValueError("links and assigned ids differ in number")
    return {
        "identified": evaluate.identified_share(piked), "accuracy": evaluate.accuracy(assigned, truth, pairs), "by_module": evaluate.accuracy_by(assigned, truth, pairs, "module_name"),
        "by_pass": evaluate.accuracy_by(assigned, truth, pairs, "module_name", "pass_name"), "possible": evaluate.possible(piked, truth, reduce(DataFrame.unionByName, [k.select("simulant_id") for k in known])),
        "duplicates": evaluate.duplicate_sizes(piked), "missed": evaluate.missed(piked, truth, known[-1]),
        "links": evaluate.accuracy(judged, truth, of, "record_id_reference"), "links_by_module": evaluate.accuracy_by(judged, truth, of, "module_name", key="record_id_reference"),
        "links_by_pass": evaluate.accuracy_by(judged, truth, of, "module_name", "pass_name", key="record_id_reference"),
    }
