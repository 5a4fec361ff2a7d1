"""Queries of the linkage model, the cascade and its evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import CENSUS_SQL, PEOPLE_SQL, census, people
from .catalog import query
from .catalog_keys import EQ, JW, NUM
from .operators.relational import except_keys, top_row
from .plans import cascade, evaluate, model, prep
from .plans.model import EXACT, Comparison, Model

COMPARISONS = (
    Comparison("first_name_15", "jaro_winkler", 750 / 900),
    Comparison("last_name_12", "jaro_winkler", 750 / 900),
    Comparison("middle_initial", "exact"),
    Comparison("year_of_birth", "numeric", 5),
)
#: Set by hand, so that scores have an exact counterpart in SQL.
M = {"first_name_15": {2: 0.85, 1: 0.09, 0: 0.06}, "last_name_12": {2: 0.85, 1: 0.1, 0: 0.05}, "middle_initial": {2: 0.95, 0: 0.05}, "year_of_birth": {2: 0.9, 1: 0.03, 0: 0.07}}
U = {"first_name_15": {2: 0.06, 1: 0.05, 0: 0.89}, "last_name_12": {2: 0.005, 1: 0.02, 0: 0.975}, "middle_initial": {2: 0.04, 0: 0.96}, "year_of_birth": {2: 0.0125, 1: 0.12, 0: 0.8675}}
MODEL = Model(COMPARISONS, M, U, 0.001)

_PARSED = "cast(try_strptime(date_of_birth, '%m/%d/%Y') as date)"
_KEYS = f"substr(first_name, 1, 15) as first_name_15, substr(last_name, 1, 12) as last_name_12, {{mi}} as middle_initial, year({_PARSED}) as year_of_birth, month({_PARSED}) as month_of_birth, day({_PARSED}) as day_of_birth, substr(first_name, 1, 1) as first_name_1, substr(last_name, 1, 1) as last_name_1"
BASE = f"""
p as ({PEOPLE_SQL}), c0 as ({CENSUS_SQL}),
r as (select record_id, 'pik' || cast(k % 1400 as varchar) as pik, k, zipcode, {_KEYS.format(mi='substr(middle_name, 1, 1)')} from p),
c as (select record_id, simulant_id, zipcode, {_KEYS.format(mi='middle_initial')} from c0),
s as (select record_id, simulant_id, zipcode, last_name_12 as first_name_15, first_name_15 as last_name_12, middle_initial, year_of_birth, month_of_birth, day_of_birth, last_name_1 as first_name_1, first_name_1 as last_name_1 from c)"""


def reference(spark: SparkSession, d: str) -> DataFrame:
    rows = prep.add_prefixes(prep.split_birth_date(people(spark, d), "M/d/yyyy"))
    return rows.withColumn("pik", F.concat(F.lit("pik"), (F.col("k") % 1400).cast("string")))


def inputs(spark: SparkSession, d: str) -> DataFrame:
    return prep.add_prefixes(prep.split_birth_date(census(spark, d), "M/d/yyyy")).withColumn("record_id_raw_input_file", F.col("record_id"))


def _levels_sql(l: str, r: str) -> dict[str, str]:
    kinds = {"jaro_winkler": JW, "numeric": NUM, "exact": EQ}
    shown = {750 / 900: "750/900.0", 5: "5", None: "0"}
    return {c.column: kinds[c.kind].format(l=f"{l}.{c.column}", r=f"{r}.{c.column}", t=shown[c.threshold]) for c in COMPARISONS}


def _gammas_sql(l: str = "r", r: str = "c") -> str:
    return ", ".join(f"{x} as gamma_{n}" for n, x in _levels_sql(l, r).items())


def _weight_sql(bayes_factor: float = 1.0) -> str:
    prior = MODEL.prior / (1 - MODEL.prior) * bayes_factor
    parts = [repr(math.log2(prior))]
    for c in COMPARISONS:
        parts.append("case gamma_" + c.column + "".join(f" when {k} then {math.log2(M[c.column][k] / U[c.column][k])!r}" for k in c.levels) + " else 0.0 end")
    return " + ".join(parts)


def _links_sql(name: str, source: str, on: str, module: str, pass_name: str, threshold: float, bayes_factor: float = 1.0) -> str:
    """A CTE `name` with the links of a pass from the input CTE `source`."""
    return f"""
{name}_g as (select x.record_id as raw, x.simulant_id, r.record_id as ref, r.pik, {_gammas_sql('r', 'x')} from r join {source} x on {on}),
{name} as (select raw, simulant_id, ref, pik, 1 / (1 + power(2.0, -({_weight_sql(bayes_factor)}))) as match_probability, '{module}' as module_name, '{pass_name}' as pass_name from {name}_g
  where 1 / (1 + power(2.0, -({_weight_sql(bayes_factor)}))) >= {threshold})"""


# Blocking


@query(f"with {BASE} select r.record_id as reference_id, c.record_id as input_id from r join c on r.zipcode = c.zipcode and r.first_name_1 = c.first_name_1")
def blocking_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = model.blocking_join(reference(spark, d), inputs(spark, d), ["zipcode", "first_name_1"], columns=["record_id"])
    return pairs.select(F.col("record_id_l").alias("reference_id"), F.col("record_id_r").alias("input_id"))


@query(f"with {BASE} select r.record_id as reference_id, c.record_id as input_id from r join c on r.first_name_1 = c.first_name_1 and r.last_name_1 = c.last_name_1 and r.year_of_birth = c.year_of_birth")
def blocking_pairs_salted(spark: SparkSession, d: str) -> DataFrame:
    pairs = model.blocking_join(reference(spark, d), inputs(spark, d), ["first_name_1", "last_name_1", "year_of_birth"], salts=10, columns=["record_id"])
    return pairs.select(F.col("record_id_l").alias("reference_id"), F.col("record_id_r").alias("input_id"))


@query(f"""
with {BASE}, a as (select first_name_1, year_of_birth, count(*) as n_reference from r group by 1, 2), b as (select first_name_1, year_of_birth, count(*) as n_input from c group by 1, 2)
select a.first_name_1, a.year_of_birth, n_reference, n_input, n_reference * n_input as n_pairs from a join b on a.first_name_1 = b.first_name_1 and a.year_of_birth = b.year_of_birth""")
def blocking_pair_count(spark: SparkSession, d: str) -> DataFrame:
    return model.count_blocked_pairs(reference(spark, d), inputs(spark, d), ["first_name_1", "year_of_birth"])


# Model


@query(f"""
with {BASE}, i as (select count(*) as n, count(distinct record_id) as k from c), q as (select count(*) as n, count(distinct pik) as k from r)
select round(0.9 * (0.95 * i.k) * (0.95 * i.k / i.n) * (0.995 * q.k / q.n) / (i.n * q.n), 12) as prior,
round(0.9 * (0.95 * i.k) * (0.95 * i.k / i.n) * (0.995 * q.k / q.n) / (i.n * q.n) * 1000 / (1 - 0.9 * (0.95 * i.k) * (0.95 * i.k / i.n) * (0.995 * q.k / q.n) / (i.n * q.n)), 9) as raised_odds from i, q""")
def prior_lambda(spark: SparkSession, d: str) -> DataFrame:
    p = model.estimate_prior(inputs(spark, d), reference(spark, d))
    return spark.range(1).select(F.lit(round(p, 12)).alias("prior"), F.lit(round(model.to_odds(p) * 1000, 9)).alias("raised_odds"))


_BITS = "cast(concat('0x', substr(md5(r.record_id || '#' || cast(t.i as varchar) || '|1234|{k}'), 1, 8)) as bigint) / 4294967296.0"
_DRAW = f"cast(floor(({_BITS.format(k=0)} + {_BITS.format(k=1)} / 4294967296.0) * (select count(*) from c)) as bigint)"
_RANDOM = f"""
n as (select *, row_number() over (order by record_id) - 1 as num from c),
g as (select {_gammas_sql('r', 'n')} from r cross join range(1, 11) as t(i) join n on n.num = {_DRAW})"""


def _shares_sql() -> str:
    rows = [f"select '{c.column}' as comparison, {k} as level, round(count(*) filter (gamma_{c.column} = {k}) / count(*) filter (gamma_{c.column} >= 0)::double, 9) as u from g" for c in COMPARISONS for k in c.levels]
    return " union all ".join(rows)


@query(f"with {BASE}, {_RANDOM} {_shares_sql()}")
def u_probabilities(spark: SparkSession, d: str) -> DataFrame:
    pairs = model.training_pairs(reference(spark, d), inputs(spark, d), "record_id", "record_id")
    shares = model.level_shares(pairs, COMPARISONS)
    return spark.createDataFrame([(c, k, round(v, 9)) for c, by in shares.items() for k, v in by.items()], "comparison string, level int, u double")


def _em_sql(rounds: int) -> str:
    """Unrolled rounds over the pattern counts of pairs that agree on year and first initial."""
    open_ = [c for c in COMPARISONS if c.column != "year_of_birth"]
    odds = MODEL.prior / (1 - MODEL.prior) * 0.95 / U["year_of_birth"][EXACT]
    gammas = {n: x for n, x in _levels_sql("r", "c").items() if n != "year_of_birth"}
    sql = f"with {BASE}, pat as (select {', '.join(f'{x} as g_{n}' for n, x in gammas.items())}, count(*) as n from r join c on r.year_of_birth = c.year_of_birth and r.first_name_1 = c.first_name_1 group by all)"
    start = {c.column: model._first_guess(c) for c in open_}
    sql += ", m0 as (select " + ", ".join(f"{start[c.column][k]!r} as {c.column}_{k}" for c in open_ for k in c.levels) + ")"
    for i in range(1, rounds + 1):
        o = repr(odds) + "".join(" * case g_" + c.column + "".join(f" when {k} then m.{c.column}_{k} / {U[c.column][k]!r}" for k in c.levels) + " else 1.0 end" for c in open_)
        sql += f", w{i} as (select pat.*, n * ({o}) / (1 + {o}) as w from pat, m{i - 1} as m)"
        sql += f", m{i} as (select " + ", ".join(f"sum(w) filter (g_{c.column} = {k}) / sum(w) filter (g_{c.column} >= 0) as {c.column}_{k}" for c in open_ for k in c.levels) + f" from w{i})"
    return sql + " " + " union all ".join(f"select '{c.column}' as comparison, {k} as level, round({c.column}_{k}, 8) as m from m{rounds}" for c in open_ for k in c.levels)


@query(_em_sql(4))
def em_m_probabilities(spark: SparkSession, d: str) -> DataFrame:
    open_ = [c for c in COMPARISONS if c.column != "year_of_birth"]
    rows = model.blocked_patterns(reference(spark, d), inputs(spark, d), ["year_of_birth", "first_name_1"], open_).collect()  # one row for each vector of levels
    patterns = [({c.column: r[f"gamma_{c.column}"] for c in open_}, r["n"]) for r in rows]
    odds = model.to_odds(MODEL.prior) * 0.95 / U["year_of_birth"][EXACT]
    m = model.maximise(patterns, open_, U, odds, rounds=4, tolerance=0)
    return spark.createDataFrame([(c, k, round(v, 8)) for c, by in m.items() for k, v in by.items()], "comparison string, level int, m double")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    pairs = model.blocking_join(reference(spark, d), inputs(spark, d), ["zipcode"])
    return model.score(pairs, MODEL)


_SCORED = f"g as (select r.record_id as reference_id, c.record_id as input_id, r.pik, r.k, {_gammas_sql()} from r join c on r.zipcode = c.zipcode), w as (select *, {_weight_sql()} as weight from g)"


@query(f"with {BASE}, {_SCORED} select reference_id, input_id, {', '.join('gamma_' + c.column for c in COMPARISONS)}, round(weight, 6) as match_weight, round(1 / (1 + power(2.0, -weight)), 6) as match_probability from w")
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(
        F.col("record_id_l").alias("reference_id"), F.col("record_id_r").alias("input_id"), *[f"gamma_{c.column}" for c in COMPARISONS],
        F.round("match_weight", 6).alias("match_weight"), F.round("match_probability", 6).alias("match_probability"),
    )


@query(f"with {BASE}, {_SCORED} select reference_id, input_id, round(1 / (1 + power(2.0, -weight)), 6) as match_probability from w where 1 / (1 + power(2.0, -weight)) >= 0.97")
def threshold_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).where(F.col("match_probability") >= cascade.THRESHOLD)
    return rows.select(F.col("record_id_l").alias("reference_id"), F.col("record_id_r").alias("input_id"), F.round("match_probability", 6).alias("match_probability"))


@query(f"""
with {BASE}, {_SCORED}, b as (select *, row_number() over (partition by input_id order by weight desc, reference_id) as n from w where 1 / (1 + power(2.0, -weight)) >= 0.5)
select input_id, reference_id, round(weight, 6) as match_weight from b where n = 1""")
def best_link(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).where(F.col("match_probability") >= 0.5).select(F.col("record_id_r").alias("input_id"), F.col("record_id_l").alias("reference_id"), "match_weight")
    return top_row(rows, ["input_id"], [F.desc("match_weight"), F.col("reference_id")]).withColumn("match_weight", F.round("match_weight", 6))


# Cascade

ZIP = cascade.Module("zipsearch", "people", ("zipcode",), tuple(c.column for c in COMPARISONS), (cascade.Pass("initial", ("first_name_1",)), cascade.Pass("initial switch", ("first_name_1",), prep.switch_names)))
BIRTH = cascade.Module("birthsearch", "people", ("day_of_birth", "month_of_birth"), tuple(c.column for c in COMPARISONS), (cascade.Pass("year", ("year_of_birth",)), cascade.Pass("last initial", ("last_name_1",))), 10.0)

_DEATHS = "d as (select distinct 'pik' || cast(k % 1400 as varchar) as pik, case when k % 12 = 0 then date '2030-04-01' else date '2030-04-02' end as died from p where k % 4 = 0)"


def _confirm_sql(name: str, links: str, deaths: bool) -> str:
    """A CTE `name`: the confirmed links of a module's CTE `links`."""
    alive = f"select l.* from {links} l left join (select pik, min(died) as died from d group by 1) d on l.pik = d.pik where d.died is null or d.died > date '2030-04-01'" if deaths else f"select * from {links}"
    return f"""
{name}_a as ({alive}), {name}_t as (select *, max(match_probability) over (partition by raw) as top from {name}_a),
{name}_k as (select raw, count(distinct pik) filter (match_probability = top) as piks from {name}_t group by 1),
{name} as (select * from (select t.*, row_number() over (partition by t.raw order by match_probability desc, pik, ref, module_name, pass_name) as n from {name}_t t join {name}_k k on t.raw = k.raw where k.piks <= 1) where n = 1)"""


def _deaths(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("k") % 12 == 0, "2030-04-01").otherwise("2030-04-02").cast("date")
    return reference(spark, d).where("k % 4 = 0").select("pik", day.alias("date_of_death"))


def _piks(spark: SparkSession, d: str) -> DataFrame:
    return reference(spark, d).select(F.col("record_id").alias("record_id_reference"), "pik")


_Z1 = _links_sql("z1", "c", "r.zipcode = x.zipcode and r.first_name_1 = x.first_name_1", "zipsearch", "initial", 0.97)
_Z2 = "zs as (select * from s where record_id not in (select raw from z1)), " + _links_sql("z2", "zs", "r.zipcode = x.zipcode and r.first_name_1 = x.first_name_1", "zipsearch", "initial switch", 0.97)
_ZLINKS = f"{_Z1}, {_Z2}, z as (select * from z1 union all select * from z2)"


@query(f"""
with {BASE}, {_DEATHS}, {_ZLINKS}, {_confirm_sql('zc', 'z', True)}
select raw as record_id_raw_input_file, ref as record_id_reference, pik, module_name, pass_name, round(match_probability, 6) as match_probability from zc""")
def confirm_links(spark: SparkSession, d: str) -> DataFrame:
    links = cascade.run_module(reference(spark, d), inputs(spark, d), ZIP, MODEL)
    out = cascade.confirm(links, _piks(spark, d), _deaths(spark, d))
    return out.drop("record_id_input").withColumn("match_probability", F.round("match_probability", 6))


_B1 = "bc as (select * from c where record_id not in (select raw from zc)), " + _links_sql("b1", "bc", "r.day_of_birth = x.day_of_birth and r.month_of_birth = x.month_of_birth and r.year_of_birth = x.year_of_birth", "birthsearch", "year", 0.97, 10.0)
_B2 = "bc2 as (select * from bc where record_id not in (select raw from b1)), " + _links_sql("b2", "bc2", "r.day_of_birth = x.day_of_birth and r.month_of_birth = x.month_of_birth and r.last_name_1 = x.last_name_1", "birthsearch", "last initial", 0.97, 10.0)
CASCADE_SQL = f"{BASE}, {_DEATHS}, {_ZLINKS}, {_confirm_sql('zc', 'z', False)}, {_B1}, {_B2}, b as (select * from b1 union all select * from b2), {_confirm_sql('bconf', 'b', False)}, conf as (select * from zc union all select * from bconf)"


def confirmed(spark: SparkSession, d: str) -> DataFrame:
    return cascade.run_cascade(inputs(spark, d), {"people": reference(spark, d)}, MODEL, (ZIP, BIRTH), households=False)


@query(f"with {CASCADE_SQL} select raw as record_id_raw_input_file, ref as record_id_reference, pik, module_name, pass_name, round(match_probability, 6) as match_probability from conf")
def cascade_two_modules(spark: SparkSession, d: str) -> DataFrame:
    return confirmed(spark, d).drop("record_id_input").withColumn("match_probability", F.round("match_probability", 6))


@query(f"with {CASCADE_SQL} select c.record_id, c.simulant_id, conf.pik from c left join conf on c.record_id = conf.raw")
def attach_ids(spark: SparkSession, d: str) -> DataFrame:
    return cascade.attach(census(spark, d).select("record_id", "simulant_id"), confirmed(spark, d))


@query(f"with {CASCADE_SQL} select module_name, pass_name, count(*) as links from conf group by 1, 2")
def links_by_pass(spark: SparkSession, d: str) -> DataFrame:
    return cascade.by_pass(confirmed(spark, d))


@query(f"""
with {BASE}, pick as (select record_id as raw, 'pik' || cast(simulant_id % 1400 as varchar) as pik from c where simulant_id % 3 = 0), hh as (select c.record_id, c.zipcode as household, pick.pik from c left join pick on c.record_id = pick.raw where c.zipcode is not null),
e as (select household from hh group by 1 having count(pik) > 0 and count(*) > count(pik)), people_ as (select distinct hh.household, pik from hh join e on hh.household = e.household where pik is not null),
open_ as (select * from r where cast(r.zipcode as int) % 7 <> 0), places as (select distinct people_.household, open_.zipcode as geokey from people_ join open_ on people_.pik = open_.pik where open_.zipcode is not null)
select open_.record_id, open_.pik, places.household as pseudo_household_id from open_ join places on open_.zipcode = places.geokey where open_.pik not in (select pik from pick)""")
def household_composition(spark: SparkSession, d: str) -> DataFrame:
    rows = cascade.with_household_ids(inputs(spark, d).withColumn("geokey_for_blocking", F.col("zipcode")))
    done = census(spark, d).where("simulant_id % 3 = 0").select(F.col("record_id").alias("record_id_raw_input_file"), F.concat(F.lit("pik"), (F.col("simulant_id") % 1400).cast("string")).alias("pik"))
    # Every seventh zip code plays a group quarters, which has an address but none for blocking.
    geobase = reference(spark, d).withColumns({"geokey": F.col("zipcode"), "geokey_for_blocking": F.when(F.col("zipcode").cast("int") % 7 != 0, F.col("zipcode"))})
    return cascade.household_reference(rows, done, geobase).select("record_id", "pik", "pseudo_household_id")


@query(f"with {CASCADE_SQL} select record_id from c where record_id not in (select raw from conf)")
def remaining_inputs(spark: SparkSession, d: str) -> DataFrame:
    done = confirmed(spark, d).select(F.col("record_id_raw_input_file").alias("record_id"))
    return except_keys(census(spark, d).select("record_id"), done, ["record_id"])


# Evaluation

_TRUTH = "pairs as (select distinct pik, k as simulant_id from r), ent as (select *, count(*) over (partition by pik) as n_ent from pairs)"
_JUDGED = f"{_TRUTH}, j as (select conf.raw, conf.pik, module_name, pass_name, max(n_ent) as n_entities, bool_or(coalesce(ent.simulant_id = c.simulant_id, false)) as any_right, bool_or(coalesce(ent.simulant_id = c.simulant_id and n_ent = 1, false)) as right_ from conf join c on conf.raw = c.record_id left join ent on conf.pik = ent.pik group by 1, 2, 3, 4)"


def _evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    assigned = confirmed(spark, d).withColumnRenamed("record_id_raw_input_file", "record_id")
    truth = census(spark, d).select("record_id", "simulant_id")
    pairs = reference(spark, d).select("pik", F.col("k").alias("simulant_id"))
    return assigned, truth, pairs


def _accuracy(spark: SparkSession, d: str, column: str) -> DataFrame:
    return evaluate.accuracy(*_evaluation(spark, d)).select("n", F.round(column, 9).alias(column))


@query(f"with {CASCADE_SQL}, {_JUDGED} select count(*) as n, round(avg(cast(right_ as int)), 9) as strict from j")
def accuracy_strict(spark: SparkSession, d: str) -> DataFrame:
    return _accuracy(spark, d, "strict")


@query(f"with {CASCADE_SQL}, {_JUDGED} select count(*) as n, round(count(*) filter (right_) / cast(count(*) filter (n_entities = 1) as double), 9) as certain from j")
def accuracy_excluding_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return _accuracy(spark, d, "certain")


@query(f"with {CASCADE_SQL}, {_JUDGED} select count(*) as n, round(avg(cast(any_right as int)), 9) as lenient from j")
def accuracy_lenient(spark: SparkSession, d: str) -> DataFrame:
    return _accuracy(spark, d, "lenient")


@query(f"with {CASCADE_SQL}, {_JUDGED} select module_name, pass_name, count(*) as n, round(avg(cast(any_right as int)), 9) as right_share, count(*) filter (not any_right) as wrong from j group by 1, 2")
def accuracy_by_pass(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.accuracy_by(*_evaluation(spark, d), "module_name", "pass_name")
    return out.select("module_name", "pass_name", "n", F.round("right", 9).alias("right_share"), "wrong")


# Links judged by the reference record: every fourth one mixes two entities, and the truth of every tenth person is moved on.
_LINKED = f"""mixed as (select record_id as ref, k as simulant_id from r union select record_id, k + 1 from r where k % 4 = 1), ent as (select *, count(*) over (partition by ref) as n_ent from mixed),
j as (select conf.raw, conf.ref, module_name, pass_name, max(n_ent) as n_entities, bool_or(ent.simulant_id = c.simulant_id + case when c.simulant_id % 10 = 0 then 1 else 0 end) as any_right, bool_or(ent.simulant_id = c.simulant_id + case when c.simulant_id % 10 = 0 then 1 else 0 end and n_ent = 1) as right_
  from conf join c on conf.raw = c.record_id join ent on conf.ref = ent.ref group by 1, 2, 3, 4)"""


def _link_evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    assigned, truth, _ = _evaluation(spark, d)
    truth = truth.withColumn("simulant_id", F.col("simulant_id") + F.when(F.col("simulant_id") % 10 == 0, 1).otherwise(0))
    of = reference(spark, d).select(F.col("record_id").alias("record_id_reference"), F.explode(F.when(F.col("k") % 4 == 1, F.array("k", F.col("k") + 1)).otherwise(F.array("k"))).alias("simulant_id"))
    return assigned, truth, of


@query(f"with {CASCADE_SQL}, {_LINKED} select count(*) as n, round(avg(cast(right_ as int)), 9) as strict, round(count(*) filter (right_) / cast(count(*) filter (n_entities = 1) as double), 9) as certain, round(avg(cast(any_right as int)), 9) as lenient from j")
def link_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.accuracy(*_link_evaluation(spark, d), "record_id_reference")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("strict", "certain", "lenient")])


@query(f"with {CASCADE_SQL}, {_LINKED} select module_name, pass_name, count(*) as n, round(avg(cast(any_right as int)), 9) as right_share, count(*) filter (not any_right) as wrong from j group by 1, 2")
def link_accuracy_by_pass(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.accuracy_by(*_link_evaluation(spark, d), "module_name", "pass_name", key="record_id_reference")
    return out.select("module_name", "pass_name", "n", F.round("right", 9).alias("right_share"), "wrong")


@query(f"with {CASCADE_SQL} select round(avg(case when conf.pik is not null then 1.0 else 0.0 end), 9) as identified from c left join conf on c.record_id = conf.raw")
def identified_share(spark: SparkSession, d: str) -> DataFrame:
    piked = cascade.attach(census(spark, d).select("record_id"), confirmed(spark, d))
    return evaluate.identified_share(piked).select(F.round("identified", 9).alias("identified"))


@query(f"""
with {CASCADE_SQL}, known as (select distinct k from r where k % 5 <> 0)
select count(*) as n_rows, count(known.k) as n_possible, round(avg(case when known.k is not null then 1.0 else 0.0 end), 9) as possible, round(count(conf.pik) / cast(count(known.k) as double), 9) as ids_per_possible
from c left join conf on c.record_id = conf.raw left join known on c.simulant_id = known.k""")
def identifiable_share(spark: SparkSession, d: str) -> DataFrame:
    truth = census(spark, d).select("record_id", "simulant_id")
    piked = cascade.attach(truth.select("record_id"), confirmed(spark, d))
    known = reference(spark, d).where("k % 5 <> 0").select(F.col("k").alias("simulant_id"))
    return evaluate.possible(piked, truth, known).select("n_rows", "n_possible", F.round("possible", 9).alias("possible"), F.round("ids_per_possible", 9).alias("ids_per_possible"))


@query(f"""
with {CASCADE_SQL}, ents as (select record_id as reference_id, k as simulant_id from r where k % 4 <> 1)
select c.record_id, c.simulant_id, ents.reference_id from c left join conf on c.record_id = conf.raw join ents on c.simulant_id = ents.simulant_id where conf.pik is null""")
def missed_links(spark: SparkSession, d: str) -> DataFrame:
    truth = census(spark, d).select("record_id", "simulant_id")
    piked = cascade.attach(truth.select("record_id"), confirmed(spark, d))
    entities = reference(spark, d).select("record_id", F.col("k").alias("simulant_id"), F.when(F.col("k") % 4 == 1, 2).otherwise(1).alias("n_unique_simulants"))
    return evaluate.missed(piked, truth, entities)


_MOVED = "j as (select conf.raw, conf.pik, bool_or(coalesce(ent.simulant_id = c.simulant_id + case when c.simulant_id % 10 = 0 then 1 else 0 end, false)) as any_right from conf join c on conf.raw = c.record_id left join ent on conf.pik = ent.pik group by 1, 2)"


@query(f"with {CASCADE_SQL}, {_TRUTH}, {_MOVED}, few as (select raw, pik from j where not any_right order by raw limit 100) select c.record_id, conf.pik, c.first_name_15 as first_name_15_input, r.first_name_15 as first_name_15_reference from conf join few on conf.raw = few.raw join c on conf.raw = c.record_id join r on conf.ref = r.record_id")
def wrong_links(spark: SparkSession, d: str) -> DataFrame:
    """The truth of every tenth person is moved to the next one, so that there are wrong links."""
    assigned, truth, pairs = _evaluation(spark, d)
    truth = truth.withColumn("simulant_id", F.col("simulant_id") + F.when(F.col("simulant_id") % 10 == 0, 1).otherwise(0))
    rows = evaluate.wrong_links(assigned.select("record_id", "record_id_reference", "pik"), truth, pairs, inputs(spark, d).select("record_id", "first_name_15"), reference(spark, d).select("record_id", "pik", "first_name_15"))
    return rows.select("record_id", "pik", "first_name_15_input", "first_name_15_reference")


@query(f"with {CASCADE_SQL}, n as (select pik, count(*) as group_size from conf group by 1) select group_size, count(*) as groups from n group by 1")
def duplicate_pik_sizes(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.duplicate_sizes(confirmed(spark, d))



@query()
def full_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline with a trained model: preparation, prior, u, m, four modules, attached ids."""
    from .catalog_keys import FAKE, NICKNAMES
    from .runtime import stored

    # Preparing a row costs far more than moving it, and a file of few bytes would be prepared in one task.
    dealt = lambda df: df.repartition(model.many_tasks(spark), "record_id")
    raw = census(spark, d).drop("simulant_id")
    prepared = stored(prep.prepare_input(dealt(raw), NICKNAMES, FAKE))
    quarters = stored(prep.group_quarters(prepared, 2))
    rows = stored(prep.finish_input(dealt(prepared), quarters))
    piks = dealt(people(spark, d)).withColumn("pik", F.concat(F.lit("pik"), F.col("k").cast("string")))
    as_ssa = piks.withColumn("date_of_birth", F.date_format(F.try_to_timestamp("date_of_birth", F.lit("M/d/yyyy")), "yyyyMMdd"))
    geobase = stored(prep.prepare_geobase(prep.standardize_addresses(as_ssa), quarters))
    name_dob = stored(prep.prepare_name_dob(as_ssa))
    prior = model.estimate_prior(rows, geobase)
    trained = model.train(rows, geobase, model.COMPARISONS, [(("first_name_15", "zipcode"), ("first_name_15",)), (("geokey",), ("geokey",))], "record_id", "record_id", prior, pairs=200_000)
    links = cascade.run_cascade(rows, {"geobase": geobase, "name_dob": name_dob}, trained)
    return cascade.attach(raw.select("record_id"), links)
