"""Probabilistic matching after Fellegi and Sunter: comparison levels, their parameters, scores."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler

#: Levels, the first that holds counts: a side is null, equal, close, otherwise.
NULL, EXACT, CLOSE, ELSE = -1, 2, 1, 0


#: Parts of a block whose pairs are many though its rows are few.
SALTS = 8


@dataclass(frozen=True)
class Comparison:
    """How a column is compared. kind: jaro_winkler or numeric, with a threshold for CLOSE, or exact, without that level."""

    column: str
    kind: str
    threshold: float | None = None

    @property
    def levels(self) -> tuple[int, ...]:
        return (EXACT, ELSE) if self.kind == "exact" else (EXACT, CLOSE, ELSE)


COMPARISONS = (
    Comparison("first_name_15", "jaro_winkler", 750 / 900),
    Comparison("last_name_12", "jaro_winkler", 750 / 900),
    Comparison("middle_initial", "exact"),
    Comparison("day_of_birth", "numeric", 5),
    Comparison("month_of_birth", "numeric", 3),
    Comparison("year_of_birth", "numeric", 5),
    Comparison("geokey", "jaro_winkler", 650 / 900),
)


@dataclass(frozen=True)
class Model:
    """m and u by column and level, and the probability that two random records match."""

    comparisons: tuple[Comparison, ...]
    m: Mapping[str, Mapping[int, float]]
    u: Mapping[str, Mapping[int, float]]
    prior: float = 0.5
    notes: Mapping[str, float] = field(default_factory=dict)

    def only(self, columns: Iterable[str]) -> Model:
        """The model over the comparisons of some columns."""
        keep = set(columns)
        return Model(tuple(c for c in self.comparisons if c.column in keep), self.m, self.u, self.prior, self.notes)

    def parameters(self, spark: SparkSession) -> DataFrame:
        """(comparison, level, m, u, weight): what a chart of the model would show; weight is log2 m/u."""
        rows = [(c.column, k, self.m[c.column][k], self.u[c.column][k]) for c in self.comparisons for k in c.levels]
        table = spark.createDataFrame(rows, "comparison string, level int, m double, u double")
        return table.withColumn("weight", F.log2(F.col("m") / F.col("u")))

    def as_dict(self) -> dict:
        plain = lambda x: {c: {str(k): v for k, v in d.items()} for c, d in x.items()}
        return {"comparisons": [[c.column, c.kind, c.threshold] for c in self.comparisons], "m": plain(self.m), "u": plain(self.u), "prior": self.prior}

    @staticmethod
    def from_dict(d: Mapping) -> Model:
        typed = lambda x: {c: {int(k): v for k, v in e.items()} for c, e in x.items()}
        return Model(tuple(Comparison(*c) for c in d["comparisons"]), typed(d["m"]), typed(d["u"]), d["prior"])


# Levels


def with_gammas(pairs: DataFrame, comparisons: Sequence[Comparison], left: str = "_l", right: str = "_r") -> DataFrame:
    """Adds gamma_<column> for every comparison of <column><left> with <column><right>."""
    close, kept = {}, pairs.columns
    for c in comparisons:
        l, r = f"`{c.column}{left}`", f"`{c.column}{right}`"
        if c.kind == "jaro_winkler":
            # Spark runs the function for every row, whatever stands around it; null inputs cost nothing.
            close[f"_close_{c.column}"] = jaro_winkler(F.expr(f"case when {l} <> {r} then {l} end"), F.expr(f"case when {l} <> {r} then {r} end"))
    if close:
        pairs = pairs.withColumns(close)
    level = {"jaro_winkler": "`_close_{c}` >= {t!r}D", "numeric": "abs({l} - {r}) <= {t!r}D", "exact": "false"}
    gammas = []
    for c in comparisons:
        l, r = f"`{c.column}{left}`", f"`{c.column}{right}`"
        near = level[c.kind].format(c=c.column, l=l, r=r, t=float(c.threshold or 0))
        gammas.append(f"case when {l} is null or {r} is null then {NULL} when {l} = {r} then {EXACT} when {near} then {CLOSE} else {ELSE} end as `gamma_{c.column}`")
    # Expressions as text are one call to Spark each.
    return pairs.selectExpr(*[f"`{c}`" for c in kept], *gammas)


# Prior


def prior_probability(n_input: int, n_reference: int, distinct_input: int, distinct_reference: int) -> float:
    """Expected matches over pairs: 95 % of input rows and 99.5 % of reference ids are distinct people,
    90 % of whom match; each person's rows over all rows scale the product. 0.5 without pairs."""
    if not n_input * n_reference:
        return 0.5
    people_in, people_ref = 0.95 * distinct_input, 0.995 * distinct_reference
    return 0.9 * people_in * (people_in / n_input) * (people_ref / n_reference) / (n_input * n_reference)


def estimate_prior(inputs: DataFrame, reference: DataFrame, raw_id: str = "record_id_raw_input_file", ref_id: str = "pik") -> float:
    a = inputs.agg(F.count("*"), F.count_distinct(raw_id)).first()
    b = reference.agg(F.count("*"), F.count_distinct(ref_id)).first()
    return prior_probability(a[0], b[0], a[1], b[1])


def to_odds(p: float) -> float:
    return p / (1 - p)


def to_probability(odds: float) -> float:
    return odds / (1 + odds)


# u


def random_pairs(left: DataFrame, right: DataFrame, per_row: int, seed: int, left_id: str, right_id: str) -> DataFrame:
    """`per_row` pairs for every left row with right rows drawn by a hash; an equi-join on row numbers, no cross join.

    A sample of the left rows bounds the work: see training_pairs.
    """
    from ..functions.noise import uniform
    from ..operators.relational import number_rows

    numbered = number_rows(right, [right_id], "_n")
    size = right.count()
    drawn = left.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(per_row))))
    key = F.concat_ws("#", F.col(left_id).cast("string"), F.col("_k").cast("string"))
    # Two draws of 32 bits, so that rows beyond 2^32 are reached evenly.
    place = uniform(key, seed, 0) + uniform(key, seed, 1) / 4294967296.0
    drawn = drawn.withColumn("_n", F.least(F.floor(place * size).cast("bigint"), F.lit(size - 1)))
    l = drawn.select(*[F.col(c).alias(f"{c}_l") for c in left.columns], "_n")
    r = numbered.select(*[F.col(c).alias(f"{c}_r") for c in right.columns], "_n")
    return l.join(r, "_n").drop("_n")


def training_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, pairs: int = 10_000_000, per_row: int = 10, seed: int = 1234) -> DataFrame:
    """About `pairs` random pairs at most: a hash sample of the left rows, `per_row` right rows for each."""
    from ..operators.relational import capped_sample

    return random_pairs(capped_sample(left, left_id, max(1, pairs // per_row), seed), right, per_row, seed, left_id, right_id)


def level_shares(pairs: DataFrame, comparisons: Sequence[Comparison]) -> dict[str, dict[int, float]]:
    """The share of each non-null level among pairs, all comparisons in one pass; the u-probabilities over random pairs."""
    g = with_gammas(pairs, comparisons)
    row = g.agg(*[F.count_if(F.col(f"gamma_{c.column}") == k).alias(f"{c.column}:{k}") for c in comparisons for k in c.levels]).first()
    out = {}
    for c in comparisons:
        counts = {k: row[f"{c.column}:{k}"] for k in c.levels}
        total = sum(counts.values())
        out[c.column] = {k: (n / total if total else 1 / len(counts)) for k, n in counts.items()}
    return out


# m


def gamma_patterns(pairs: DataFrame, comparisons: Sequence[Comparison], weight: str = "1L") -> DataFrame:
    """Counts of the vectors of levels: at most 4^6 * 3 rows whatever the number of pairs. `weight` is how many pairs a row stands for."""
    names = [f"gamma_{c.column}" for c in comparisons]
    return with_gammas(pairs, comparisons).groupBy(*names).agg(F.expr(f"sum({weight})").alias("n"))


def many_tasks(spark: SparkSession) -> int:
    """Tasks for work that the size of a shuffle doesn't show."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocked_patterns(reference: DataFrame, inputs: DataFrame, by: Sequence[str], comparisons: Sequence[Comparison]) -> DataFrame:
    """gamma_patterns of the pairs of blocking_join.

    Rows that are equal in all that is blocked on and compared are counted before the join, so that two groups
    of such rows are compared once, however many pairs they make.
    """
    compared = [c.column for c in comparisons]
    counted = lambda df: df.groupBy(*dict.fromkeys([*by, *compared])).agg(F.count("*").alias("_rows"))
    pairs = blocking_join(counted(reference), counted(inputs), by, SALTS, [*compared, "_rows"], many_tasks(reference.sparkSession))
    return gamma_patterns(pairs, comparisons, "_rows_l * _rows_r")


def maximise(
    patterns: Sequence[tuple[Mapping[str, int], int]], comparisons: Sequence[Comparison], u: Mapping[str, Mapping[int, float]], odds: float,
    start: Mapping[str, Mapping[int, float]] | None = None, rounds: int = 25, tolerance: float = 1e-4,
) -> dict[str, dict[int, float]]:
    """m-probabilities by expectation maximisation over pattern counts; u and the prior stay."""
    m = {c.column: dict(start[c.column]) if start else _first_guess(c) for c in comparisons}
    for _ in range(rounds):
        sums = {c.column: dict.fromkeys(c.levels, 0.0) for c in comparisons}
        for levels, n in patterns:
            o = odds
            for c in comparisons:
                if (k := levels[c.column]) != NULL:
                    o *= m[c.column][k] / max(u[c.column][k], 1e-12)
            weight = n * (o / (1 + o) if o < 1e300 else 1.0)
            for c in comparisons:
                if (k := levels[c.column]) != NULL:
                    sums[c.column][k] += weight
        moved, fresh = 0.0, {}
        for column, by in sums.items():
            total = sum(by.values())
            fresh[column] = {k: (v / total if total else m[column][k]) for k, v in by.items()}
            moved = max(moved, *(abs(fresh[column][k] - m[column][k]) for k in by))
        m = fresh
        if moved < tolerance:
            break
    return m


def _first_guess(c: Comparison) -> dict[int, float]:
    rest = [k for k in c.levels if k != EXACT]
    return {EXACT: 0.95} | {k: 0.05 / len(rest) for k in rest}


def train_session(reference: DataFrame, inputs: DataFrame, by: Sequence[str], comparisons: Sequence[Comparison], blocked: Iterable[str], u: Mapping, prior: float) -> dict[str, dict[int, float]]:
    """One session over pairs that agree on the columns `by`: the columns `blocked` aren't trained, and the prior
    odds are raised by what their agreement says."""
    blocked = set(blocked)
    odds = to_odds(prior)
    for c in comparisons:
        if c.column in blocked:
            odds *= 0.95 / max(u[c.column][EXACT], 1e-12)
    open_ = [c for c in comparisons if c.column not in blocked]
    rows = blocked_patterns(reference, inputs, by, open_).collect()
    patterns = [({c.column: r[f"gamma_{c.column}"] for c in open_}, r["n"]) for r in rows]
    return maximise(patterns, open_, u, odds)


def combine(sessions: Sequence[Mapping[str, Mapping[int, float]]], comparisons: Sequence[Comparison]) -> dict[str, dict[int, float]]:
    """For each comparison the median over the sessions that trained it."""
    out = {}
    for c in comparisons:
        found = [s[c.column] for s in sessions if c.column in s]
        out[c.column] = {k: median(f[k] for f in found) for k in c.levels} if found else _first_guess(c)
    return out


def train(inputs: DataFrame, reference: DataFrame, comparisons: Sequence[Comparison], sessions: Sequence[tuple[Sequence[str], Sequence[str]]], input_id: str, reference_id: str, prior: float, rows: int = 1_000_000, pairs: int = 10_000_000) -> Model:
    """u from random pairs, m from sessions, each (blocking columns, columns it leaves untrained), over samples of at most `rows` rows."""
    from ..operators.relational import capped_sample
    from ..runtime import stored

    a, b = stored(capped_sample(inputs, input_id, rows)), stored(capped_sample(reference, reference_id, rows))
    u = level_shares(training_pairs(b, a, reference_id, input_id, pairs), comparisons)
    trained = [train_session(b, a, by, comparisons, untrained, u, prior) for by, untrained in sessions]
    return Model(tuple(comparisons), combine(trained, comparisons), u, prior)


# Pairs and scores


def blocking_join(reference: DataFrame, inputs: DataFrame, by: Sequence[str], salts: int = 1, columns: Sequence[str] | None = None, tasks: int | None = None) -> DataFrame:
    """All (reference _l, input _r) pairs that are equal on all columns `by`; a null never matches.

    With salts, input rows spread over so many copies of the reference rows, so that a block with many
    rows is many tasks; adaptive execution splits large blocks without that, too. With `tasks`, the blocks are
    dealt into so many, even where the rows are few and only their pairs are many.
    """
    side = lambda df, s: df.selectExpr(*[f"`{c}` as `{c}_{s}`" for c in (columns or df.columns)], *[f"`{c}` as `_b{i}`" for i, c in enumerate(by)])
    l, r = side(reference, "l"), side(inputs, "r")
    on = [f"_b{i}" for i in range(len(by))]
    if salts > 1:
        l = l.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        r = r.withColumn("_salt", F.pmod(F.xxhash64(*r.columns), F.lit(salts)).cast("int"))
        on.append("_salt")
    if tasks:
        # The hint keeps adaptive execution from reading a side, once broadcast, in fewer tasks.
        l, r = l.repartition(tasks, *on).hint("merge"), r.repartition(tasks, *on)
    return l.join(r, on).drop(*on)


def count_blocked_pairs(reference: DataFrame, inputs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_reference, n_input, n_pairs) of each block, from sizes alone."""
    sizes = lambda df, name: df.dropna(subset=list(by)).groupBy(*by).agg(F.count("*").alias(name))
    return sizes(reference, "n_reference").join(sizes(inputs, "n_input"), list(by)).withColumn("n_pairs", F.col("n_reference") * F.col("n_input"))


def _bits(model: Model, c: Comparison) -> dict[int, float]:
    return {k: math.log2(max(model.m[c.column][k], 1e-12) / max(model.u[c.column][k], 1e-12)) for k in c.levels}


def most_weight(model: Model, bayes_factor: float = 1.0, left: str = "_l", right: str = "_r") -> Column:
    """The weight that a pair reaches at most, from what is known without comparing unequal strings."""
    parts = [f"{math.log2(to_odds(model.prior) * bayes_factor)!r}D"]
    for c in model.comparisons:
        bits, l, r = _bits(model, c), f"`{c.column}{left}`", f"`{c.column}{right}`"
        rest = f"{max(v for k, v in bits.items() if k != EXACT)!r}D"
        if c.kind == "numeric":
            rest = f"case when abs({l} - {r}) <= {c.threshold} then {bits[CLOSE]!r}D else {bits[ELSE]!r}D end"
        parts.append(f"case when {l} is null or {r} is null then 0.0D when {l} = {r} then {bits[EXACT]!r}D else {rest} end")
    return F.expr(" + ".join(parts))


def linked(pairs: DataFrame, model: Model, threshold: float, bayes_factor: float = 1.0) -> DataFrame:
    """The scored pairs of at least a probability. Strings are compared only where the rest of a pair leaves it a chance."""
    if 0 < threshold < 1:
        # A little slack, as sums in another order may differ in their last digits.
        pairs = pairs.where(most_weight(model, bayes_factor) >= math.log2(to_odds(threshold)) - 1e-6)
    return score(pairs, model, bayes_factor).where(F.col("match_probability") >= threshold)


def score(pairs: DataFrame, model: Model, bayes_factor: float = 1.0, gammas: bool = True) -> DataFrame:
    """Adds match_weight (log2 odds) and match_probability. A null level says nothing; `bayes_factor` is what belonging to a cut says."""
    g = with_gammas(pairs, model.comparisons) if gammas else pairs
    parts = [f"{math.log2(to_odds(model.prior) * bayes_factor)!r}D"]
    for c in model.comparisons:
        parts.append(f"case `gamma_{c.column}` {' '.join(f'when {k} then {bits!r}D' for k, bits in _bits(model, c).items())} else 0.0D end")
    return g.withColumn("match_weight", F.expr(" + ".join(parts))).withColumn("match_probability", 1 / (1 + F.pow(F.lit(2.0), -F.col("match_weight"))))
