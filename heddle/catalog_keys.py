"""Queries of the preparation steps and of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import CENSUS_SQL, PEOPLE_SQL, census, people
from .catalog import query
from .functions.similarity import jaro_winkler, with_similarity
from .functions.text import geokey, initial_cut, nysiis, parse_date, reverse_soundex, soundex_key, standardize_address
from .plans import prep
from .sources.io import table

NICKNAMES = {"Bill": "William", "Kathy": "Katherine", "Bobby": "Robert"}
FAKE = ("Unknown", "Ava", "Baby")
PARTS = ("street_number", "street_name", "unit_number", "city", "state", "zipcode")


def std(c: str) -> str:
    return f"nullif(regexp_replace(upper(regexp_replace(trim({c}), '\\s+', ' ', 'g')), '\\b(STREET|STR)\\b', 'ST', 'g'), '')"


STD = ", ".join(f"{std(c)} as {c}" for c in PARTS)
GEO = "nullif(trim(regexp_replace(" + " || ' ' || ".join(f"coalesce({c}, '')" for c in PARTS) + ", '\\s+', ' ', 'g')), '')"
#: The input after addresses and geokey.
PLACED = f"p as ({PEOPLE_SQL}), a as (select k, record_id, first_name, last_name, housing_type, {STD} from p), g as (select *, {GEO} as geokey from a)"


def placed(spark: SparkSession, d: str) -> DataFrame:
    return prep.add_geokey(prep.standardize_addresses(people(spark, d)))


@query(f"with p as ({PEOPLE_SQL}) select record_id, {STD} from p")
def address_standardize(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("record_id", *[standardize_address(F.col(c)).alias(c) for c in PARTS])


@query(f"with p as ({PEOPLE_SQL}) select record_id, {std('street_name').replace(chr(92) + 'b(STREET|STR)' + chr(92) + 'b', 'NO RULE')} as street_name from p")
def address_without_street_rule(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("record_id", standardize_address(F.col("street_name"), street_rule=False).alias("street_name"))


@query(f"with {PLACED} select record_id, geokey from g")
def geokeys(spark: SparkSession, d: str) -> DataFrame:
    rows = prep.standardize_addresses(people(spark, d))
    return rows.select("record_id", geokey([F.col(c) for c in PARTS]).alias("geokey"))


@query(f"""
with p as ({PEOPLE_SQL}), t as (select record_id, cast(try_strptime(date_of_birth, '%m/%d/%Y') as date) as b from p)
select record_id, day(b) as day_of_birth, month(b) as month_of_birth, year(b) as year_of_birth from t""")
def dob_split(spark: SparkSession, d: str) -> DataFrame:
    return prep.split_birth_date(people(spark, d).select("record_id", "date_of_birth"), "M/d/yyyy")


@query("""
with t as (select o_orderkey, case when o_orderkey % 7 = 0 then strftime(o_orderdate, '%Y%m') || '31' when o_orderkey % 11 = 0 then 'bad' else strftime(o_orderdate, '%Y%m%d') end as s from orders)
select o_orderkey, cast(cast(try_strptime(s, '%Y%m%d') as date) as varchar) as parsed from t""")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyyMM")
    s = F.when(F.col("o_orderkey") % 7 == 0, F.concat(month, F.lit("31"))).when(F.col("o_orderkey") % 11 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", parse_date(s, "yyyyMMdd").cast("string").alias("parsed"))


@query(f"""
with p as ({PEOPLE_SQL}) select record_id, substr(first_name, 1, 15) as first_name_15, substr(first_name, 1, 1) as first_name_1, substr(first_name, 1, 2) as first_name_2, substr(first_name, 1, 3) as first_name_3,
substr(last_name, 1, 12) as last_name_12, substr(last_name, 1, 1) as last_name_1, substr(last_name, 1, 2) as last_name_2, substr(last_name, 1, 3) as last_name_3, substr(middle_name, 1, 1) as middle_initial from p""")
def name_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return prep.add_prefixes(people(spark, d).select("record_id", "first_name", "middle_name", "last_name")).drop("first_name", "middle_name", "last_name")


CUT = "case when {c} is null or substr({c}, 1, 1) = 'A' then 'A-or-blank' when {c} = '' then null when substr({c}, 1, 1) in ('U','V','W','X','Y','Z') then 'U-Z' else substr({c}, 1, 1) end"


@query(f"with p as ({PEOPLE_SQL}) select record_id, {CUT.format(c='first_name')} as first_initial_cut, {CUT.format(c='last_name')} as last_initial_cut from p")
def initial_cuts(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("record_id", initial_cut(F.col("first_name")).alias("first_initial_cut"), initial_cut(F.col("last_name")).alias("last_initial_cut"))


@query(f"""
with p as ({PEOPLE_SQL}) select record_id, case when upper(first_name) in ('UNKNOWN', 'AVA', 'BABY') then null else first_name end as first_name,
case when upper(last_name) in ('UNKNOWN', 'AVA', 'BABY') then null else last_name end as last_name from (select * replace (case when k % 2 = 0 then lower(first_name) else first_name end as first_name, case when last_name like 'Unknown%' then 'unknown' else last_name end as last_name) from p)""")
def fake_name_blank(spark: SparkSession, d: str) -> DataFrame:
    rows = people(spark, d).withColumns({"first_name": F.when(F.col("k") % 2 == 0, F.lower("first_name")).otherwise(F.col("first_name")), "last_name": F.when(F.col("last_name").startswith("Unknown"), "unknown").otherwise(F.col("last_name"))})
    listed = spark.createDataFrame([(n,) for n in FAKE], "name string")
    return prep.blank_fake_names(rows.select("record_id", "first_name", "last_name"), listed)


@query(f"""
with p as ({PEOPLE_SQL}) select record_id as record_id_raw_input_file, first_name, last_name from p
union all select record_id, case first_name when 'Bill' then 'William' when 'Kathy' then 'Katherine' when 'Bobby' then 'Robert' end, last_name from p where first_name in ('Bill', 'Kathy', 'Bobby')""")
def nickname_expand(spark: SparkSession, d: str) -> DataFrame:
    return prep.expand_nicknames(people(spark, d).select("record_id", "first_name", "last_name"), NICKNAMES).drop("record_id")


@query(f"with p as ({PEOPLE_SQL}) select record_id, first_name, last_name from p where first_name is not null or last_name is not null")
def sufficient_names(spark: SparkSession, d: str) -> DataFrame:
    return prep.sufficient(people(spark, d)).select("record_id", "first_name", "last_name")


@query(f"""
with p as ({PEOPLE_SQL}) select record_id, last_name as first_name, first_name as last_name, substr(last_name, 1, 15) as first_name_15, substr(first_name, 1, 12) as last_name_12, substr(last_name, 1, 2) as first_name_2, substr(first_name, 1, 3) as last_name_3 from p""")
def name_switch(spark: SparkSession, d: str) -> DataFrame:
    rows = prep.add_prefixes(people(spark, d).select("record_id", "first_name", "middle_name", "last_name"))
    return prep.switch_names(rows).select("record_id", "first_name", "last_name", "first_name_15", "last_name_12", "first_name_2", "last_name_3")




@query(f"""
with {PLACED}, h as (select *, street_number || '/' || zipcode as place from g),
q as (select place as qp from h where housing_type is not null and place is not null group by 1 having sum(case when housing_type <> 'Household' then 1 else 0 end) >= 2 and avg(case when housing_type <> 'Household' then 1.0 else 0.0 end) >= 0.7)
select record_id, place as geokey, case when qp is null then place end as geokey_for_blocking, case when qp is null then street_number end as street_number_for_blocking, case when qp is null then street_name end as street_name_for_blocking
from h left join q on place = qp""")
def gq_suppression(spark: SparkSession, d: str) -> DataFrame:
    rows = placed(spark, d).withColumn("geokey", F.concat("street_number", F.lit("/"), "zipcode"))
    out = prep.blocking_addresses(rows, prep.group_quarters(rows, 2))
    return out.select("record_id", "geokey", "geokey_for_blocking", "street_number_for_blocking", "street_name_for_blocking")


def soundex_sql(c: str) -> str:
    """Soundex of a word of letters in DuckDB: codes, H and W dropped, repeats collapsed, vowels dropped."""
    u = f"upper({c})"
    codes = f"replace(translate({u}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202'), '7', '')"
    for k in range(7):
        codes = f"regexp_replace({codes}, '{k}+', '{k}', 'g')"
    rest = f"replace(case when substr({u}, 1, 1) in ('H', 'W') then {codes} else substr({codes}, 2) end, '0', '')"
    return f"case when {c} = '' then '' else substr({u}, 1, 1) || rpad(substr({rest}, 1, 3), 3, '0') end"


@query(f"with p as ({PEOPLE_SQL}), l as (select record_id, regexp_replace(last_name, '[^A-Za-z]', '', 'g') as n from p) select record_id, {soundex_sql('n')} as key from l")
def soundex_keys(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("record_id", soundex_key(F.col("last_name")).alias("key"))


@query(f"with p as ({PEOPLE_SQL}), l as (select record_id, reverse(last_name) as n from p) select record_id, {soundex_sql('n')} as key from l")
def reverse_soundex_keys(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("record_id", reverse_soundex(F.col("last_name")).alias("key"))


_NAMES_SQL = "select first_name as n from p where first_name is not null union select last_name from p where last_name is not null"
_VOWEL = "in ('A', 'E', 'I', 'O', 'U')"
#: The code letter by letter: a name is walked from its second letter on, and the key grows by what each letter or group becomes.
NYSIIS_SQL = f"""
begun as (select n, case when u like 'MAC%' then 'MCC' || substr(u, 4) when u like 'KN%' then substr(u, 2) when u like 'K%' then 'C' || substr(u, 2) when u like 'PH%' or u like 'PF%' then 'FF' || substr(u, 3) when u like 'SCH%' then 'SSS' || substr(u, 4) else u end as s from (select n, upper(n) as u from names)),
ended as (select n, case when right(s, 2) in ('IE', 'EE') then substr(s, 1, length(s) - 2) || 'Y' when right(s, 2) in ('DT', 'RT', 'RD', 'NT', 'ND') then substr(s, 1, length(s) - 2) || 'D' else s end as s from begun),
walk as (
  select n, s, 2 as i, substr(s, 1, 1) as key from ended
  union all
  select n, s, i + step, case when ch = '' or right(ch, 1) = right(key, 1) then key else key || ch end from (
    select n, s, i, key, case when c || behind in ('EV', 'PH') then 2 when c = 'S' and substr(s, i + 1, 2) = 'CH' then 3 else 1 end as step,
      case when c || behind = 'EV' then 'AF' when c {_VOWEL} then 'A' when c = 'Q' then 'G' when c = 'Z' then 'S' when c = 'M' then 'N' when c || behind = 'KN' then 'N' when c = 'K' then 'C'
        when c = 'S' and substr(s, i + 1, 2) = 'CH' then 'SS' when c || behind = 'PH' then 'F'
        when c = 'H' and (not before {_VOWEL} or (behind <> '' and not behind {_VOWEL})) then case when before {_VOWEL} then 'A' else before end
        when c = 'W' and before {_VOWEL} then before else c end as ch
    from (select n, s, i, key, substr(s, i, 1) as c, substr(s, i - 1, 1) as before, substr(s, i + 1, 1) as behind from walk where i <= length(s)))),
walked as (select n, max_by(key, i) as key from walk group by n),
no_s as (select n, case when key like '%S' and key <> 'S' then substr(key, 1, length(key) - 1) else key end as key from walked),
no_ay as (select n, case when key like '%AY' then substr(key, 1, length(key) - 2) || 'Y' else key end as key from no_s),
coded as (select n, case when key like '%A' and key <> 'A' then substr(key, 1, length(key) - 1) else key end as key from no_ay)"""


@query(f"with recursive p as ({PEOPLE_SQL}), names as ({_NAMES_SQL}), {NYSIIS_SQL} select p.record_id, a.key as first_name_nysiis, b.key as last_name_nysiis from p left join coded a on p.first_name = a.n left join coded b on p.last_name = b.n")
def nysiis_keys(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("record_id", nysiis(F.col("first_name")).alias("first_name_nysiis"), nysiis(F.col("last_name")).alias("last_name_nysiis"))


@query(f"with p as ({PEOPLE_SQL}), z as (select record_id, substr(zipcode, 1, 3) as zip3 from p) select zip3, count(*) as n from z group by 1")
def zip3_counts(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select(F.substring("zipcode", 1, 3).alias("zip3")).groupBy("zip3").agg(F.count("*").alias("n"))


PAIRS = f"""
p as ({PEOPLE_SQL}), c as ({CENSUS_SQL}), x as (select p.record_id as a, c.record_id as b, p.first_name as fa, c.first_name as fb, p.last_name as la, c.last_name as lb from p join c on p.zipcode = c.zipcode)"""


def _zip_pairs(spark: SparkSession, d: str) -> DataFrame:
    p, c = people(spark, d), census(spark, d)
    p = p.select(F.col("record_id").alias("a"), F.col("first_name").alias("fa"), F.col("last_name").alias("la"), "zipcode")
    return p.join(c.select(F.col("record_id").alias("b"), F.col("first_name").alias("fb"), F.col("last_name").alias("lb"), "zipcode"), "zipcode").drop("zipcode")


@query(f"with {PAIRS} select a, b, round(jaro_winkler_similarity(fa, fb), 6) as first_similarity, round(jaro_winkler_similarity(la, lb), 6) as last_similarity from x")
def jaro_winkler_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = with_similarity(_zip_pairs(spark, d), "fa", "fb", "s")
    return rows.select("a", "b", F.round("s", 6).alias("first_similarity"), F.round(jaro_winkler(F.col("la"), F.col("lb")), 6).alias("last_similarity"))


JW = "case when {l} is null or {r} is null then -1 when {l} = {r} then 2 when jaro_winkler_similarity({l}, {r}) >= {t} then 1 else 0 end"
NUM = "case when {l} is null or {r} is null then -1 when {l} = {r} then 2 when abs({l} - {r}) <= {t} then 1 else 0 end"
EQ = "case when {l} is null or {r} is null then -1 when {l} = {r} then 2 else 0 end"


@query(f"with {PAIRS} select {JW.format(l='fa', r='fb', t='750/900.0')} as g_first, {JW.format(l='la', r='lb', t='750/900.0')} as g_last, count(*) as n from x group by 1, 2")
def jaro_winkler_levels(spark: SparkSession, d: str) -> DataFrame:
    from .plans.model import Comparison, with_gammas

    levels = with_gammas(_zip_pairs(spark, d), [Comparison(c, "jaro_winkler", 750 / 900) for c in ("f", "l")], "a", "b")
    return levels.groupBy(F.col("gamma_f").alias("g_first"), F.col("gamma_l").alias("g_last")).agg(F.count("*").alias("n"))


@query(f"with x as (select a.p_partkey as a, b.p_partkey as b, case when a.p_partkey % 9 = 0 then null else a.p_size end as sa, b.p_size as sb from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type) select a, b, {NUM.format(l='sa', r='sb', t=5)} as g from x")
def numeric_levels(spark: SparkSession, d: str) -> DataFrame:
    from .plans import model

    part = table(spark, d, "part")
    a = part.select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("s"))
    b = part.select("p_partkey", "p_brand", "p_type", F.col("p_size").alias("s"))
    # Few rows make many pairs: their blocks are dealt out by number, not by the size of what is shuffled.
    pairs = model.blocking_join(a, b, ["p_brand", "p_type"], model.SALTS, ["p_partkey", "s"], model.many_tasks(spark))
    return model.with_gammas(pairs, [model.Comparison("s", "numeric", 5)]).selectExpr("p_partkey_l as a", "p_partkey_r as b", "gamma_s as g")
