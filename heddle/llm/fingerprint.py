"""Operator 1: document fingerprints by a homomorphic multiset hash. DataFrame functions only.

A text is the multiset of its paragraphs (lines). Each paragraph hashes to a wide vector, and a
fingerprint is the sum of its paragraphs' vectors, lane by lane modulo 2^32: the order of paragraphs
has no bearing, equal multisets have equal sums, and a paragraph is inserted or deleted by adding or
subtracting its vector.

The vector has two parts. Eight lanes are 256 bits of the whole paragraph's hash and decide equality.
128 lanes count, over the paragraph's word shingles, how often each bit of a shingle's 128-bit hash is
set. Twice such a count less the number of shingles is a sum of signs, so the cosine of two texts'
lanes estimates the cosine of their shingle counts (standard error 1/sqrt(128)): their likeness.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

SHINGLE = 3
#: Buckets of consecutive keys for each shuffle partition, small enough that a bucket's window stays in memory,
#: and the most of them: their bounds stand in the plan. Beyond it buckets grow, and windows spill.
BUCKETS, MOST_BUCKETS = 4, 50_000
#: Two 32-bit lanes in a 64-bit integer.
LANE = 0xFFFFFFFF
BOTH = 1 | 1 << 32


def _vector() -> tuple[list[Column], list[Column]]:
    """The columns whose sums make a fingerprint, for rows (para, words, pos): equality lanes, packed likeness lanes.

    Lanes can't overflow their 32 bits in a text below 2^32 shingles, and sums of equality lanes are
    taken modulo 2^32 afterwards.
    """
    equal = []
    for seed in range(4):
        h = F.xxhash64(F.lit(seed), F.col("para"))
        for part in (h.bitwiseAND(F.lit(LANE)), F.shiftrightunsigned(h, 32)):
            equal.append(F.when(F.col("pos") == 0, part).otherwise(F.lit(0).cast("bigint")))
    bits = [F.shiftrightunsigned(h, b).bitwiseAND(F.lit(BOTH)) for h in (F.col("g"), F.col("g2")) for b in range(32)]
    return equal, bits


def sum_vectors(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """`by`, n (shingles), e (array of the 8 equality lanes) and v (array of 64 packed pairs of lanes) of each group's texts.

    Sums only: groups of texts, or partial sums of the same text, add up.
    """
    paragraphs = texts.select(*by, F.explode(F.split(text, "\n")).alias("para"))
    shingles = paragraphs.select(*by, "para", F.split("para", " ").alias("words")).select(*by, "para", "words", F.posexplode("words").alias("pos", "word"))
    hashed = shingles.select(*by, "para", "pos", F.xxhash64("word", *[F.get("words", F.col("pos") + i) for i in range(1, SHINGLE)]).alias("g"))
    hashed = hashed.select("*", F.xxhash64(F.lit(1), "g").alias("g2"))
    equal, bits = _vector()
    sums = hashed.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"e{i}") for i, c in enumerate(equal)], *[F.sum(c).alias(f"v{i}") for i, c in enumerate(bits)]
    )
    return sums.select(
        *by, "n", F.array(*[F.col(f"e{i}").bitwiseAND(F.lit(LANE)) for i in range(len(equal))]).alias("e"), F.array(*[F.col(f"v{i}") for i in range(len(bits))]).alias("v")
    )


def as_text(e: Column, v: Column) -> Column:
    """The fingerprint in hex: 8 lanes of 8 digits, then 64 pairs of lanes of 16 digits."""
    digits = lambda a, n: F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), n, "0"))), "")
    return F.concat(digits(e, 8), digits(v, 16))


def _signs(v: Column, n: Column) -> Column:
    """The 128 sums of signs of packed counts."""
    one = lambda x: (x * 2 - n).cast("double")
    return F.concat(F.transform(v, lambda x: one(x.bitwiseAND(F.lit(LANE)))), F.transform(v, lambda x: one(F.shiftrightunsigned(x, 32))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two structs (f, s, q): fingerprint, sums of signs, their squared length."""
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a["s"], b["s"]) / F.sqrt(a["q"] * b["q"])))
    return F.when(a["f"] == b["f"], 1.0).when((a["q"] == 0) | (b["q"] == 0), 0.0).otherwise(cosine)


def _buckets(docs: DataFrame) -> DataFrame:
    """Adds b, a bucket of rows that follow each other in the order of k and h, and repeats each bucket's first rows in the bucket before it (wrap 1).

    The bounds are quantiles of the keys. A key that holds several quantiles, and null, gets as many
    buckets of its own, by ranges of the text's hash h, so a hot key is many buckets. Bounds and the
    buckets' first rows are a few numbers for each shuffle partition, whatever the number of rows.
    """
    spark = docs.sparkSession
    n = max(2, min(MOST_BUCKETS, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    told = docs.agg(F.percentile_approx("k", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("cuts"), F.count_if(F.col("k").isNull()).alias("nulls"), F.count("*").alias("rows")).first()
    times = Counter(told.cuts or [])
    nulls = 1 + told.nulls * n // max(1, told.rows)
    # Per bound: the key, its buckets, and the number of the first of them; before these come the nulls' buckets and that of the keys below all bounds.
    bounds, at = [], nulls + 1
    for key in sorted(times):
        bounds.append((key, times[key], at))
        at += times[key] + 1 if times[key] > 1 else 1
    share = F.col("h") / F.lit(2.0**64) + 0.5
    part = lambda count: F.least(F.floor(share * count).cast("int"), (count - 1).cast("int"))
    bucket = F.lit(nulls)
    if bounds:
        # Two steps of a square root's length find the last bound up to a key.
        wide = max(1, math.isqrt(len(bounds)))
        table = lambda j, kind: [[b[j] for b in bounds[i : i + wide]] for i in range(0, len(bounds), wide)]
        number = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
        two = lambda j, kind: F.array(*[number(row, kind) for row in table(j, kind)])
        upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("k")))
        docs = docs.withColumn("i", upto(number([row[0] for row in table(0, "bigint")], "bigint")) - 1)
        docs = docs.withColumn("j", F.when(F.col("i") >= 0, upto(F.get(two(0, "bigint"), F.col("i"))) - 1))
        of = lambda j, kind: F.get(F.get(two(j, kind), F.col("i")), F.col("j"))
        docs = docs.withColumns({"bound": of(0, "bigint"), "many": of(1, "int"), "at": of(2, "int")})
        after = F.when(F.col("many") == 1, F.col("at")).when(F.col("k") == F.col("bound"), F.col("at") + part(F.col("many"))).otherwise(F.col("at") + F.col("many"))
        bucket = F.when(F.col("i") < 0, F.lit(nulls)).otherwise(after)
    bucket = F.when(F.col("k").isNull(), part(F.lit(nulls))).otherwise(bucket)
    bucketed = docs.select("k", "h", "body", bucket.cast("int").alias("b"))
    row = F.struct(F.col("k").isNotNull().alias("known"), "k", "h")
    firsts = {r.b: (r.f.k, r.f.h) for r in bucketed.groupBy("b").agg(F.min(row).alias("f")).collect()}
    used = sorted(firsts)
    top = (used[-1] + 1) if used else 1
    before = {b: used[i - 1] for i, b in enumerate(used)}
    look = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("b"))
    first = F.col("k").eqNullSafe(look([firsts.get(b, (None, None))[0] for b in range(top)], "bigint")) & (F.col("h") == look([firsts.get(b, (None, None))[1] for b in range(top)], "bigint"))
    prior = look([before.get(b, 0) for b in range(top)], "int")
    place = lambda b, wrap: F.struct(b.cast("int").alias("b"), F.lit(wrap).alias("wrap"))
    places = F.when(first, F.array(place(F.col("b"), 0), place(prior, 1))).otherwise(F.array(place(F.col("b"), 0)))
    return bucketed.select("k", "h", "body", F.explode(places).alias("p")).select("k", "h", "body", "p.b", "p.wrap")


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one with the next larger key (null keys come first, rows that share a key
    are ordered by a hash of the text, and after the last comes the first); the edited text has the last quarter of
    the code points replaced by as many of the next document's first ones. A null text counts as
    empty. Repeated rows give a row each. `key` is an integer column; other columns may have any name.
    """
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    source = source.select("k", F.xxhash64("body").alias("h"), "body")
    order = Window.partitionBy("b").orderBy("wrap", F.asc_nulls_first("k"), "h", "body")
    rows = _buckets(source).withColumns({"next": F.lead("body").over(order), "r": F.row_number().over(order)})
    length = F.char_length("body")
    quarter = F.floor(length / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("body"), F.lit(1), length - quarter), F.substring(F.col("next"), F.lit(1), quarter)))
    rows = rows.select("b", "wrap", "r", "k", length.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("sha"), "body", "edited")
    side = lambda i, c: F.struct(F.lit(i).alias("side"), F.col(c).alias("t"))
    # The repeated first row of the following bucket only serves as its predecessor's next document.
    sides = rows.withColumn("x", F.explode(F.when(F.col("wrap") == 0, F.array(side(0, "body"), side(1, "edited"))).otherwise(F.array(side(0, "body")))))
    by = ["b", "wrap", "r", "side", "k", "n_chars", "sha"]
    # All that follows groups by the bucket, by which the rows are dealt already.
    sums = sum_vectors(sides.select("b", "wrap", "r", F.col("x.side").alias("side"), "k", "n_chars", "sha", F.col("x.t").alias("t")), by, "t")
    signed = sums.select(*by, as_text(F.col("e"), F.col("v")).alias("f"), _signs(F.col("v"), F.col("n")).alias("s"))
    prints = signed.select(*by, F.struct("f", "s", _dot(F.col("s"), F.col("s")).alias("q")).alias("fp"))
    row = Window.partitionBy("b").orderBy("r", "side")
    beside = prints.withColumns({"fp1": F.lead("fp", 1).over(row), "fp2": F.lead("fp", 2).over(row)}).where("side = 0 and wrap = 0")
    return beside.select(
        F.col("k").alias(key), "n_chars", F.col("sha").alias("edited_sha256"), F.col("fp.f").alias("fingerprint"), F.col("fp1.f").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fp1")).alias("near_edited"), likeness(F.col("fp"), F.col("fp2")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole documents and of their edited texts."""
    return document_fingerprints(read_table(spark, sf_dir, "documents"))
