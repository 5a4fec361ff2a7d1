"""Source files to accuracy on made people."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from heddle.cases import census, people
from heddle.plans import workflow

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    p = people(spark, D).withColumn("simulant_id", F.col("k")).where("ssn is not null")
    address = [F.col(c).alias(f"mailing_address_{c}") for c in ("street_number", "street_name", "unit_number", "city", "state", "zipcode")]
    tax = p.select("simulant_id", "ssn", "first_name", F.substring("middle_name", 1, 1).alias("middle_initial"), "last_name", *address, F.lit(None).cast("string").alias("mailing_address_po_box"))
    for y in (2028, 2029):
        tax.where(F.col("simulant_id") % 2 == y % 2).write.parquet(f"{root}/simulated_taxes_1040_{y}.parquet")
        tax.where(F.col("simulant_id") % 3 == y % 3).write.parquet(f"{root}/simulated_taxes_w2_and_1099_{y}.parquet")
    birth = F.date_format(F.try_to_timestamp("date_of_birth", F.lit("M/d/yyyy")), "yyyyMMdd")
    ssa = p.where("ssn not like '9%'").select("simulant_id", "ssn", "first_name", "middle_name", "last_name", birth.alias("date_of_birth"), F.lit("creation").alias("event_type"), F.lit("19900101").alias("event_date"))
    dead = ssa.where("simulant_id % 20 = 0").withColumns({"event_type": F.lit("death"), "event_date": F.lit("20200101")})
    ssa.union(dead).write.parquet(f"{root}/simulated_ssa_numident.parquet")
    census(spark, D).drop("record_id").write.parquet(f"{root}/simulated_census_2030.parquet")
    return str(root)


def test_workflow(spark, sources, tmp_path):
    files, out = str(tmp_path / "files"), str(tmp_path / "out")
    workflow.generate_files(spark, sources, files, years=(2028, 2029))
    geobase = spark.read.parquet(f"{files}/simulated_geobase_reference_file")
    assert geobase.where("pik is null").isEmpty() and geobase.select("record_id").distinct().count() == geobase.count()
    trained = workflow.link(spark, files, out, {"Bill": "William", "Bobby": "Robert"}, ["Unknown"], gq_least=2, training_pairs=100_000)
    assert trained.parameters(spark).count() == 20
    got = workflow.accuracy(spark, files, out)
    row = got["accuracy"].first()
    assert got["identified"].first().identified > 0.6 and row.lenient > 0.95
    links = spark.read.parquet(f"{out}/confirmed_piks")
    numident = spark.read.parquet(f"{files}/simulated_census_numident")
    dead = numident.where("date_of_death is not null").select("pik")
    assert dead.count() > 0 and links.join(dead, "pik", "left_semi").isEmpty()
    assert got["by_pass"].agg(F.sum("n")).first()[0] == links.count()
    assert spark.read.parquet(f"{out}/census_2030_piked").count() == census(spark, D).count()
    assert got["links"].first().n == links.count() and got["links"].first().lenient > 0.9
    assert got["links_by_pass"].agg(F.sum("n")).first()[0] == links.count()
    assert {"identified", "possible", "duplicates", "missed"} <= set(got) and got["missed"].count() >= 0
    # Complete and newer than what they were made from: nothing to do; without a mark of completion a stage runs again.
    again = lambda: workflow.run_stages(spark, sources, files, out, {"Bill": "William"}, ["Unknown"], years=(2028, 2029), gq_least=2, training_pairs=50_000)
    assert again() == []
    os.remove(f"{out}/confirmed_piks/_SUCCESS")
    assert again() == ["link"]
