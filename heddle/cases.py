"""People made from the test tables, in SQL that Spark and DuckDB both run.

The tables hold no persons, so customers stand for them: every customer is one person in a reference
file, and the input file is a copy of the customers in which hash-like rules on the key misspell,
switch, blank and move things. The customer key is the ground truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FIRST = "Bill,William,Mary,Ann,Robert,Elizabeth,Ulysses,Kathy,Macy,Phoebe,Knight,Schuyler,Ava,Zoe,Quincy,Bobby"
_LAST = "Smith,Macdonald,Knuth,Pfister,Schmitt,Johnson,Brandt,Lee,Harvey,Whitman,Evans,Zhang,Queen,Orr,Ashby,Dwight,Unknown"

#: k, ssn, names, birth date as text, address, housing type.
PEOPLE = f"""
select c_custkey as k, 'ref_' || cast(c_custkey as string) as record_id,
  case when c_custkey % 37 = 0 then null when c_custkey % 11 = 0 then '9' || lpad(cast(c_custkey as string), 8, '0')
       else lpad(cast(c_custkey * 7 as string), 9, '0') end as ssn,
  case when c_custkey % 53 = 0 then null when c_custkey % 59 = 0 then '' else split_part('{_FIRST}', ',', cast(1 + c_custkey % 16 as int)) end as first_name,
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + (c_custkey * 5) % 26 as int), 1) || 'n' as middle_name,
  case when c_custkey % 61 = 0 then null else split_part('{_LAST}', ',', cast(1 + (c_custkey * c_custkey) % 17 as int)) || substr('aeioustrnlmkdghbwz', cast(1 + (c_custkey * 3) % 18 as int), 1) end as last_name,
  case when c_custkey % 29 = 0 then null when c_custkey % 41 = 0 then 'x9/02/1990'
       else cast(1 + (c_custkey * 7) % 12 as string) || '/' || cast(1 + (c_custkey * 11) % 31 as string) || '/' || cast(1930 + (c_custkey * 13) % 80 as string) end as date_of_birth,
  case when c_custkey % 23 = 0 then null else cast(100 + c_custkey % 50 as string) end as street_number,
  case c_custkey % 5 when 0 then 'Main  Street' when 1 then ' oak Str ' when 2 then 'ELM AVE' when 3 then 'strand Way' else '' end as street_name,
  case when c_custkey % 3 = 0 then ' ' when c_custkey % 3 = 1 then null else 'Apt ' || cast(c_custkey % 9 as string) end as unit_number,
  n_name as city, substr(n_name, 1, 2) as state,
  case when c_custkey % 47 = 0 then null else cast(10000 + (c_custkey * 13) % 900 as string) end as zipcode,
  case when c_custkey % 31 = 0 then null when (c_custkey % 50) % 7 = 0 and c_custkey % 11 <> 0 then 'Nursing home' else 'Household' end as housing_type
from {{customer}} join {{nation}} on c_nationkey = n_nationkey
"""

#: The input file: raw record id and the same columns, misspelt and moved by rules on the key.
CENSUS = """
select 'in_' || cast(k as string) as record_id, k as simulant_id,
  case when k % 13 = 0 then last_name when k % 7 = 0 then replace(first_name, 'i', 'y') else first_name end as first_name,
  case when k % 9 = 0 then null else substr(middle_name, 1, 1) end as middle_initial,
  case when k % 13 = 0 then first_name when k % 8 = 0 then replace(last_name, 'e', 'ee') else last_name end as last_name,
  case when k % 17 = 0 then replace(date_of_birth, '/19', '/18') else date_of_birth end as date_of_birth,
  case when k % 19 = 0 then '7' else street_number end as street_number, street_name, unit_number, city, state,
  case when k % 43 = 0 then '99999' else zipcode end as zipcode, housing_type
from ({people}) as p
where k % 25 <> 3
"""


def _names(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation")}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PEOPLE, **_names(spark, sf_dir))


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CENSUS.format(people=PEOPLE), **_names(spark, sf_dir))


PEOPLE_SQL = PEOPLE.format(customer="customer", nation="nation")
CENSUS_SQL = CENSUS.format(people=PEOPLE_SQL)
