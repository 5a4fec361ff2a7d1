"""Queries of the relational, lineage and reference-file operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query
from .cases import PEOPLE_SQL, people
from .functions.noise import uniform
from .functions.text import parse_date
from .operators import relational as R
from .plans import lineage, reference
from .plans.lineage import Lineaged
from .sources import simulate
from .sources.io import read_parquet, table

# Sources and sets


@query("""
select c_custkey as party_key, c_name as name, c_nationkey as nationkey, c_acctbal as acctbal, c_mktsegment as segment, 'customer' as kind from customer
union all select s_suppkey, s_name, s_nationkey, s_acctbal, null, 'supplier' from supplier""")
def concat_sources(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("party_key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("kind"))
    return R.concat([c, s])


@query("select l_orderkey, l_extendedprice from lineitem where l_shipdate >= timestamp '1997-01-01' and l_returnflag = 'R'")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = read_parquet(spark, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_extendedprice", "l_shipdate", "l_returnflag"])
    return rows.where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_extendedprice")


@query("select o_orderkey, 'order_' || cast(row_number() over (order by o_custkey, o_orderkey) - 1 as varchar) as record_id from orders")
def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.add_record_ids(table(spark, d, "orders", ["o_orderkey", "o_custkey"]), "order", ["o_custkey", "o_orderkey"]).select("o_orderkey", "record_id")


@query("select distinct p_brand, p_type from part")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", ["p_brand", "p_type"]).distinct()


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def anti_join_remaining(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.except_keys(table(spark, d, "customer", ["c_custkey"]), done, ["c_custkey"])


@query("""
select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') or c_nationkey in (select s_nationkey from supplier where s_acctbal < 0)""")
def semi_join_observed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    near = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    seen = R.concat([R.only_keys(c, urgent, ["c_custkey"]), R.only_keys(c, near, ["c_nationkey"])])
    return seen.select("c_custkey").distinct()


@query("""
with a as (select case when c_custkey % 5 = 0 then null else c_nationkey end as x, c_mktsegment as y, count(*) as n_a from customer group by 1, 2),
b as (select case when s_suppkey % 3 = 0 then null else s_nationkey end as x, count(*) as n_b from supplier group by 1)
select a.x, a.y, a.n_a, b.n_b from a join b on a.x is not distinct from b.x""")
def null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").groupBy(F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("x"), F.col("c_mktsegment").alias("y")).agg(F.count("*").alias("n_a"))
    b = table(spark, d, "supplier").groupBy(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("x")).agg(F.count("*").alias("n_b"))
    return R.null_safe_join(a, b, ["x"])


@query("select n_name, r_name, c_custkey from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def validated_left_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey"]).withColumnRenamed("c_nationkey", "n_nationkey")
    n = R.validated_join(table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region"), ["r_regionkey"], "left")
    return R.validated_join(c, n, ["n_nationkey"], "left").select("n_name", "r_name", "c_custkey")


@query("select n_nationkey, n_regionkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def natural_join(spark: SparkSession, d: str) -> DataFrame:
    return R.natural_join(table(spark, d, "nation"), table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")).select("n_nationkey", "n_regionkey", "n_name", "r_name")


@query("select * from (select o_orderkey, o_custkey, count(*) over (partition by o_custkey, o_orderstatus, o_orderpriority) as copies from orders) where copies > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    by = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    rows = table(spark, d, "orders", ["o_orderkey", *by])
    counts = R.group_agg(rows, by, F.count("*").alias("copies"))
    return R.repeated_keys(rows, by).join(counts, by).select("o_orderkey", "o_custkey", "copies")


# Groups


@query("""
select o_custkey, count(*) as n, count(distinct o_orderpriority) as priorities, max(o_totalprice) as top, bool_or(o_orderstatus = 'F') as any_f,
count(*) filter (o_orderstatus = 'F') as n_f from orders group by o_custkey having count(*) >= 3""")
def group_statistics(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("o_orderstatus") == "F"
    return R.group_agg(
        table(spark, d, "orders"), ["o_custkey"], F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("priorities"), F.max("o_totalprice").alias("top"), F.bool_or(f).alias("any_f"), F.count_if(f).alias("n_f")
    ).where("n >= 3")


@query("select case when o_custkey % 4 = 0 then null else o_custkey % 50 end as g, count(*) as n_rows, count(case when o_orderkey % 3 = 0 then 1 end) as n_some, round(avg(o_totalprice), 4) as mean_price from orders where o_custkey % 4 <> 0 group by 1")
def group_without_nulls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("g", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 50))
    return R.group_agg(rows, ["g"], F.count("*").alias("n_rows"), F.count(F.when(F.col("o_orderkey") % 3 == 0, 1)).alias("n_some"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("select n as group_size, count(*) as groups from (select o_custkey, count(*) as n from orders group by 1) group by 1")
def duplicate_id_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram_of_counts(table(spark, d, "orders", ["o_custkey"]), ["o_custkey"])


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as mean_price from orders group by 1, 2")
def mean_and_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""
with p as (select o_custkey, count(distinct o_orderpriority) as n from orders group by 1)
select count(*) as n_groups, round(avg(n), 6) as mean_n, round(stddev_samp(n), 6) as sd_n, min(n) as min_n, max(n) as max_n, count(*) filter (n > 1) as n_collisions from p""")
def collision_describe(spark: SparkSession, d: str) -> DataFrame:
    p = R.group_agg(table(spark, d, "orders"), ["o_custkey"], F.count_distinct("o_orderpriority").alias("n"))
    return p.agg(F.count("*").alias("n_groups"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.stddev_samp("n"), 6).alias("sd_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.count_if(F.col("n") > 1).alias("n_collisions"))


@query("with g as (select o_custkey, count(*) as n from orders group by 1) select o_custkey, n from g where n = (select max(n) from g)")
def rows_at_maximum(spark: SparkSession, d: str) -> DataFrame:
    return R.rows_at_maximum(R.group_agg(table(spark, d, "orders", ["o_custkey"]), ["o_custkey"], F.count("*").alias("n")), "n")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_after_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


_U = "(cast(concat('0x', substr(md5(cast({id} as varchar) || '|{seed}|{k}'), 1, 8)) as bigint) / 4294967296.0)"


@query(f"select o_orderkey from orders where {_U.format(id='o_orderkey', seed=1234, k=0)} < 0.2")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_sample(table(spark, d, "orders", ["o_orderkey"]), "o_orderkey", 0.2, 1234)


# Best data


@query("select o_custkey, o_orderkey, o_orderdate, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) where r = 1")
def best_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"])
    return R.latest_row(rows, ["o_custkey"], F.col("o_orderdate"), "o_orderkey")


@query("select o_custkey, o_orderkey, o_orderdate, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")
def best_earliest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"])
    return R.latest_row(rows, ["o_custkey"], F.col("o_orderdate"), "o_orderkey", latest=False)


@query("""
with e as (select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then null else o_orderpriority end as p, case when o_orderkey % 5 = 0 then timestamp '1900-01-01' else cast(cast(o_orderdate as date) as timestamp) end as seen from orders)
select o_custkey as ssn, o_orderkey as record_id, p from (select *, row_number() over (partition by o_custkey order by seen desc, o_orderkey) as r from e where p is not null) where r = 1""")
def best_data_by_event(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("ssn"), F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("p"),
        F.when(F.col("o_orderkey") % 5 == 0, "19999999").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("event_date"),
    )
    return reference.best_data(rows, ["p"], parse_date(F.col("event_date"), "yyyyMMdd"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1")
def top_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.top_row(table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice"]), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


# Lineage: ids depend on order, so results are told by what they stand for


def _orders(spark: SparkSession, d: str) -> Lineaged:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").alias("ssn"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("a"), F.col("o_orderstatus").alias("b"))
    return lineage.self_lineage(rows)


_ORDERS = "o as (select cast(o_orderkey as varchar) as record_id, o_custkey as ssn, case when o_orderkey % 4 <> 0 then o_orderpriority end as a, o_orderstatus as b from orders)"


@query(f"with {_ORDERS} select distinct ssn, a, b, record_id as source_record_id from o")
def dedupe_lineage(spark: SparkSession, d: str) -> DataFrame:
    out = lineage.dedupe(_orders(spark, d), ["ssn", "a", "b"], "kind")
    return out.df.join(out.pairs, "record_id").drop("record_id")


@query(f"""
with {_ORDERS}, x as (select distinct ssn, a from o where a is not null), y as (select distinct ssn, b from o where ssn % 3 <> 0),
j as (select x.ssn, x.a, y.b from x left join y on x.ssn = y.ssn)
select j.ssn, j.a, j.b, o.record_id as source_record_id from j join o on o.ssn = j.ssn and o.a = j.a
union select j.ssn, j.a, j.b, o.record_id from j join o on o.ssn = j.ssn and o.b = j.b""")
def merge_lineage(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    x = lineage.dedupe(Lineaged(o.df.where("a is not null"), o.pairs), ["ssn", "a"], "x")
    y = lineage.dedupe(Lineaged(o.df.where("ssn % 3 <> 0"), o.pairs), ["ssn", "b"], "y")
    out = lineage.merge([x, y], "xy", ["ssn"], "left")
    return out.df.join(out.pairs, "record_id").drop("record_id")


@query(f"with {_ORDERS} select ssn, a, b, record_id as source_record_id from o where b = 'F' union all select ssn, a, null, record_id from o where b = 'O'")
def concat_lineage(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    out = lineage.concatenate([Lineaged(o.df.where("b = 'F'"), o.pairs), Lineaged(o.df.where("b = 'O'").drop("b"), o.pairs)], "both")
    return out.df.join(out.pairs, "record_id").drop("record_id")


@query(f"""
with {_ORDERS}, g as (select distinct a, b, ssn % 7 as simulant_id from o), n as (select a, b, count(distinct simulant_id) as n_unique_simulants from g group by 1, 2)
select g.a, g.b, g.simulant_id, n.n_unique_simulants from g join n on g.a is not distinct from n.a and g.b = n.b""")
def lineage_entities(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    out = lineage.dedupe(o, ["a", "b"], "kind")
    truth = o.df.select("record_id", (F.col("ssn") % 7).alias("simulant_id"))
    return lineage.entities(out.pairs, truth).join(out.df, "record_id").drop("record_id")


@query(f"""
with {_ORDERS}, g as (select distinct coalesce(a, '-') as a, b, ssn % 7 as e from o), n as (select a, b, count(distinct e) as n from g group by 1, 2),
w as (select a, b from n order by n desc, a, b limit 1) select o.record_id, o.ssn, o.ssn % 7 as simulant_id from o join w on coalesce(o.a, '-') = w.a and o.b = w.b""")
def collision_sources(spark: SparkSession, d: str) -> DataFrame:
    """The orders behind the kind that mixes the most of seven entities; ids here are the kinds' names, so that ties fall alike."""
    o = _orders(spark, d)
    pairs = o.df.select(F.concat_ws("|", F.coalesce("a", F.lit("-")), "b").alias("record_id"), F.col("record_id").alias("source_record_id"))
    truth = o.df.select("record_id", (F.col("ssn") % 7).alias("simulant_id"))
    return lineage.collision_sources(pairs, truth, o.df.select("record_id", "ssn"))


@query(f"with {_ORDERS}, x as (select ssn, count(*) as n from o where b = 'F' group by 1) select (select count(*) from o) * (select avg(n) from x) as expected_rows")
def expected_join_rows(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).df
    return reference.expected_rows(o, o.where("b = 'F'"))


@query(f"with {_ORDERS} select distinct ssn % 500 as ssn, 'p' as kind, dense_rank() over (order by ssn % 500) - 1 as pik from o")
def id_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).df.withColumn("ssn", F.col("ssn") % 500)
    piks = lineage.id_crosswalk([o.where("b = 'F'"), o.where("b <> 'F'")])
    attached = lineage.attach_id(o, piks).select("ssn", F.lit("p").alias("kind"), F.col("pik").cast("bigint").alias("pik"))
    return attached.distinct()


# Reference files over the people


@query(f"with p as ({PEOPLE_SQL}) select record_id, ssn from p where ssn like '9%'")
def itin_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).where(reference.is_itin(F.col("ssn"))).select("record_id", "ssn")


_EVENTS = f"""
p as ({PEOPLE_SQL}), n as (select distinct ssn, first_name, middle_name, last_name from p where ssn is not null and ssn not like '9%'),
b as (select distinct ssn, dob from (select ssn, date_of_birth as dob from p union all select ssn, '1/1/2000' from p where k % 2 = 0) where ssn is not null and ssn not like '9%'),
i as (select distinct ssn, first_name, middle_name, last_name from p where ssn like '9%'),
nd as (select n.ssn, first_name, middle_name, last_name, dob from n left join b on n.ssn = b.ssn union all select ssn, first_name, middle_name, last_name, null from i)"""


def _name_dob(spark: SparkSession, d: str) -> Lineaged:
    p = people(spark, d).drop("k")
    ssa = p.where(F.col("ssn").isNotNull() & ~reference.is_itin(F.col("ssn")))
    twice = ssa.join(people(spark, d).where("k % 2 = 0").select("record_id"), "record_id", "left_semi").withColumn("date_of_birth", F.lit("1/1/2000")).withColumn("record_id", F.concat(F.col("record_id"), F.lit("b")))
    names, births = reference.alternate_names(lineage.self_lineage(ssa)), reference.alternate_birth_dates(lineage.self_lineage(ssa.unionByName(twice)))
    return reference.name_dob_file(names, births, reference.itin_names(lineage.self_lineage(p)))


@query(f"with {_EVENTS} select ssn, first_name, middle_name, last_name, dob as date_of_birth from nd")
def alternate_expansion(spark: SparkSession, d: str) -> DataFrame:
    return _name_dob(spark, d).df.drop("record_id")


def _std(c: str) -> str:
    return f"nullif(regexp_replace(upper(regexp_replace(trim({c}), '\\s+', ' ', 'g')), '\\b(STREET|STR)\\b', 'ST', 'g'), '')"


_ADDR = {"street_number": "street_number", "street_name": "street_name", "unit_number": "unit_number", "city": "city", "state": "state", "zipcode": "zipcode"}


@query(f"""
with {_EVENTS}, a as (select distinct ssn, {', '.join(f'{_std(c)} as {c}' for c in _ADDR)} from p where ssn is not null)
select nd.ssn, first_name, middle_name, last_name, dob as date_of_birth, {', '.join(_ADDR)} from nd left join a on nd.ssn = a.ssn""")
def geobase_expansion(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d)
    filings = p.select("record_id", "ssn", *[F.col(c).alias(f"mailing_address_{c}") for c in _ADDR], F.lit(None).cast("string").alias("mailing_address_po_box"))
    out = reference.geobase_file(_name_dob(spark, d), reference.tax_addresses([lineage.self_lineage(filings)]))
    return R.strip_prefix(out.df, "mailing_address_").drop("record_id", "po_box")


@query(f"""
with p as ({PEOPLE_SQL}), e as (select k, 'n' || cast(k % 400 as varchar) as ssn, first_name, middle_name, last_name, date_of_birth as dob,
  case when k % 6 = 0 then 'death' else 'creation' end as kind, case when k % 10 = 0 then null else date '1990-01-01' + cast(k % 4000 as int) end as seen from p),
nm as (select * from (select *, row_number() over (partition by ssn order by coalesce(seen, date '1900-01-01') desc, k) as r from e where coalesce(first_name, middle_name, last_name) is not null) where r = 1),
bd as (select * from (select *, row_number() over (partition by ssn order by coalesce(seen, date '1900-01-01') desc, k) as r from e where dob is not null) where r = 1),
dd as (select * from (select *, row_number() over (partition by ssn order by coalesce(seen, date '1900-01-01') desc, k) as r from e where kind = 'death' and seen is not null) where r = 1)
select nm.ssn, nm.first_name, nm.middle_name, nm.last_name, bd.dob as date_of_birth, strftime(dd.seen, '%Y%m%d') as date_of_death from nm left join bd on nm.ssn = bd.ssn left join dd on nm.ssn = dd.ssn""")
def census_numident(spark: SparkSession, d: str) -> DataFrame:
    e = people(spark, d).select(
        F.lpad(F.col("k").cast("string"), 12, "0").alias("record_id"), F.col("k").alias("tie"), F.concat(F.lit("n"), (F.col("k") % 400).cast("string")).alias("ssn"), "first_name", "middle_name", "last_name", "date_of_birth",
        F.when(F.col("k") % 6 == 0, "death").otherwise("creation").alias("event_type"),
        F.when(F.col("k") % 10 != 0, F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("k") % 4000).cast("int")), "yyyyMMdd")).alias("event_date"),
    )
    events = e.withColumn("record_id", F.col("tie")).drop("tie")
    return reference.census_numident(Lineaged(events, events.select("record_id", F.col("record_id").alias("source_record_id")))).df.select("ssn", "first_name", "middle_name", "last_name", "date_of_birth", "date_of_death")


# Noise


@query(f"""
with p as ({PEOPLE_SQL}), w as (select *, string_split_regex(coalesce(first_name, '') || ' ' || coalesce(middle_name, '') || ' ' || coalesce(last_name, ''), '[ -]') as t,
 {_U.format(id='record_id', seed=5, k=0)} as u0, {_U.format(id='record_id', seed=5, k=1)} as u1, {_U.format(id='record_id', seed=5, k=2)} as u2 from p),
c as (select *, len(t) - 1 as n, cast(ceil(least(u1, u2) * (len(t) - 1)) as int) as c1, cast(ceil(greatest(u1, u2) * (len(t) - 1)) as int) as c2 from w)
select record_id, case when u0 < 0.3 then array_to_string(list_filter(t[1:c1], lambda x: x <> ''), ' ') else first_name end as first_name,
 case when u0 < 0.3 then array_to_string(list_filter(t[c1 + 1:c2], lambda x: x <> ''), ' ') else middle_name end as middle_name,
 case when u0 < 0.3 then array_to_string(list_filter(t[c2 + 1:], lambda x: x <> ''), ' ') else last_name end as last_name from c""")
def noise_split(spark: SparkSession, d: str) -> DataFrame:
    from .functions.noise import split_columns

    return split_columns(people(spark, d).select("record_id", "first_name", "middle_name", "last_name"), ["first_name", "middle_name", "last_name"], 0.3, 5, "record_id")


@query(f"""
with p as ({PEOPLE_SQL}), w as (select *, {_U.format(id='record_id', seed=6, k=0)} as u0,
 list_sort([{{'u': {_U.format(id='record_id', seed=6, k=1)}, 'v': first_name}}, {{'u': {_U.format(id='record_id', seed=6, k=2)}, 'v': last_name}}]) as s from p)
select record_id, case when u0 < 0.3 then s[1].v else first_name end as first_name, case when u0 < 0.3 then s[2].v else last_name end as last_name from w""")
def noise_shuffle(spark: SparkSession, d: str) -> DataFrame:
    from .functions.noise import shuffle_columns

    return shuffle_columns(people(spark, d).select("record_id", "first_name", "last_name"), ["first_name", "last_name"], 0.3, 6, "record_id")


@query(f"with p as ({PEOPLE_SQL}) select record_id, case when {_U.format(id='record_id', seed=7, k=0)} < 0.4 then substr(last_name, 1, 4) else last_name end as last_name, round({_U.format(id='record_id', seed=7, k=0)}, 9) as u from p")
def noise_truncate(spark: SparkSession, d: str) -> DataFrame:
    from .functions.noise import truncate_column

    rows = people(spark, d).select("record_id", "last_name")
    return truncate_column(rows, "last_name", 0.4, 4, 7, "record_id").withColumn("u", F.round(uniform(F.col("record_id"), 7, 0), 9))


# Simulated sources


def _pick(values: tuple[str, ...], u: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], cast(floor({u} * {len(values)}) as int) + 1)"


def _people_sql(n: int, seed: int) -> str:
    own = lambda k: _U.format(id="i", seed=seed, k=k)
    return f"""
select i as simulant_id, i // 3 as household, {_pick(simulate.FIRST, own(0))} as first_name, {_pick(simulate.FIRST, own(1))} as middle_name, {_pick(simulate.LAST, _U.format(id='(i // 3)', seed=seed, k=2))} as last_name,
  date '1930-01-01' + cast(floor({own(3)} * 33000) as int) as birth, case when {own(4)} < {simulate.NUMBERED} then '1' else '9' end || lpad(cast(i as varchar), 8, '0') as ssn from range({n}) t(i)"""


@query(f"with p as ({_people_sql(3000, 7)}) select simulant_id, household, first_name, middle_name, last_name, cast(birth as date) as birth, ssn from p")
def simulated_people(spark: SparkSession, d: str) -> DataFrame:
    return simulate.population(spark, 3000, 7)


@query(f"""
with p as ({_people_sql(3000, 7)}), e as (select *, cast(birth as date) + cast(floor(28000 + {_U.format(id='simulant_id', seed=7, k=60)} * 9000) as int) as died from p where ssn not like '9%')
select simulant_id, ssn, first_name, middle_name, last_name, strftime(birth, '%Y%m%d') as date_of_birth, 'creation' as event_type, strftime(birth, '%Y%m%d') as event_date from e
union all select simulant_id, ssn, first_name, middle_name, last_name, strftime(birth, '%Y%m%d'), 'death', strftime(died, '%Y%m%d') from e where year(died) <= 2029 and {_U.format(id='simulant_id', seed=7, k=61)} < 0.3""")
def simulated_events(spark: SparkSession, d: str) -> DataFrame:
    return simulate.social_security(simulate.population(spark, 3000, 7), 2029, 7)
