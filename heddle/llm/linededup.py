"""Operator 7: removal of repeated line runs. DataFrame functions only.

Prefix doubling builds the suffix array of all documents' line sequences. Lines are ranked in the order
of their ids, and the rank of 2^j lines comes from the pair of ranks of their halves: the pairs are
sorted by range partitions and numbered in order, so at every level suffixes with a greater prefix have a
greater rank and those that agree share one. Only suffixes whose prefix occurs at least twice go on, so
each level holds the suffix array's intervals with a common prefix of 2^j lines or more. The interval
with a common prefix of any length m between 2^j and 2^(j+1) is named by two overlapping blocks of 2^j
lines, the one that begins the prefix and the one that ends it. The interval's first member in the
corpus keeps the run, and the later copies are deleted.

A run counts if it has at least `min_words` words. A maximal repeated run that counts is the union of
the shortest counting prefixes at its lines and the shortest counting suffixes of its lines, so only the
intervals of those lengths are looked up, and doubling stops at the longest of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_names, read_table

MIN_WORDS = 1
ROW = ["k", "t"]
WORD = r"[^\x20\x09-\x0D]+"


def _with_row_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k and t name a row by its key and text, null keys included."""
    return docs.select(
        "*",
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0)).alias("k"),
        F.xxhash64(F.col(f"`{text}`"), F.col(f"`{key}`").isNull()).alias("t"),
    )


def _ranked(pairs: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """Ranks, in the order of `by`, of the classes with at least two members; fixed by a checkpoint before they are used.

    The sort deals classes to partitions by range, and the numbers grow with the partition and within it.
    """
    classes = pairs.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    return cut(classes.orderBy(*by).withColumn(name, F.monotonically_increasing_id()))


def _repeated_lines(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(k, t, seg, pos, c0, c1, rank): lines that occur twice, in unbroken stretches of enough words.

    c0 and c1 are the stretch's words before and after the line.
    """
    named = _with_row_key(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", "text")
    lines = named.select("k", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "k", "t", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("w")
    )
    rows = lines.join(_ranked(lines, ["h1", "h2"]), ["h1", "h2"]).select("k", "t", "pos", "w", "rank").dropDuplicates(["k", "t", "pos"])
    row = Window.partitionBy(*ROW).orderBy("pos")
    seg = Window.partitionBy(*ROW, "seg")
    rows = rows.withColumn("seg", F.col("pos") - F.row_number().over(row))
    rows = rows.withColumn("c1", F.sum("w").over(seg.orderBy("pos"))).withColumn("all", F.sum("w").over(seg))
    return cut(rows.where(F.col("all") >= min_words).select(*ROW, "seg", "pos", (F.col("c1") - F.col("w")).alias("c0"), "c1", "rank"))


def _shortest(rows: DataFrame, min_words: int) -> DataFrame:
    """(k, t, pos, m): the shortest counting stretches of m lines from each line on and up to each line."""
    seg = Window.partitionBy(*ROW, "seg")
    here = seg.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ask, tell = F.lit(1), F.lit(0)
    event = lambda at, kind, pos: F.struct(at.cast("bigint").alias("at"), kind.alias("kind"), pos.alias("pos"))
    told = F.when(F.col("kind") == 0, F.col("pos"))
    fore = rows.select(*ROW, "seg", F.explode(F.array(event(F.col("c1"), tell, F.col("pos")), event(F.col("c0") + min_words, ask, F.col("pos")))).alias("e")).select(*ROW, "seg", "e.*")
    fore = fore.withColumn("end", F.last(told, ignorenulls=True).over(here.orderBy(F.desc("at"), "kind", F.desc("pos"))))
    fore = fore.where("kind = 1 and end is not null").select(*ROW, "pos", (F.col("end") - F.col("pos") + 1).alias("m"))
    back = rows.select(*ROW, "seg", F.explode(F.array(event(F.col("c0"), tell, F.col("pos")), event(F.col("c1") - min_words, ask, F.col("pos")))).alias("e")).select(*ROW, "seg", "e.*")
    back = back.withColumn("start", F.last(told, ignorenulls=True).over(here.orderBy("at", "kind", "pos")))
    back = back.where("kind = 1 and start is not null").select(*ROW, F.col("start").alias("pos"), (F.col("pos") - F.col("start") + 1).alias("m"))
    return fore.union(back).where("m > 0").distinct()


def later_copies(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(k, t, runs): for each row the line runs, as [start, end] in line numbers, that an earlier place has too.

    Places are ordered by key, then by a hash of the text for rows that share a key, then by line.
    """
    rows = _repeated_lines(docs, key, text, min_words)
    wanted = cut(_shortest(rows, min_words).withColumn("j", F.floor(F.log2(F.col("m") + 0.5)).cast("int")))
    deepest = wanted.agg(F.max("j")).first()[0] or 0
    level = rows.select(*ROW, "pos", "rank")
    levels = level.withColumn("j", F.lit(0))
    for j in range(1, deepest + 1):
        half = 1 << (j - 1)
        ahead = level.select(*ROW, (F.col("pos") - half).alias("pos"), F.col("rank").alias("next"))
        pairs = cut(level.join(ahead, [*ROW, "pos"]))
        level = cut(pairs.join(_ranked(pairs, ["rank", "next"], "double"), ["rank", "next"]).select(*ROW, "pos", F.col("double").alias("rank")))
        levels = levels.union(level.withColumn("j", F.lit(j)))
    first = levels.withColumnRenamed("rank", "r1")
    last = levels.select(*ROW, "j", F.col("pos").alias("at"), F.col("rank").alias("r2"))
    named = wanted.join(first, [*ROW, "j", "pos"]).withColumn("at", F.col("pos") + F.col("m") - F.expr("shiftleft(1, j)"))
    named = cut(named.join(last, [*ROW, "j", "at"]).select(*ROW, "pos", "m", "r1", "r2"))
    place = F.struct("k", "t", "pos")
    # A table of its own, so that the join reads two plain shuffles and an interval with very many suffixes can be split.
    interval = cut(named.groupBy("m", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("m", "r1", "r2", "first"))
    later = named.join(interval, ["m", "r1", "r2"]).where(place > F.col("first")).select(*ROW, "pos", (F.col("pos") + F.col("m") - 1).alias("end"))
    row = Window.partitionBy(*ROW).orderBy("pos", "end")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("pos") > F.coalesce(F.max("end").over(before), F.lit(-2)) + 1).cast("int")
    islands = later.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy(*ROW, "island").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return islands.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _left(lines: Column, runs: Column) -> Column:
    return F.filter(lines, lambda line, i: ~F.exists(runs, lambda r: (i >= r["start"]) & (i <= r["end"])))


RESULTS = ("n_lines", "n_deleted", "deleted_runs")


def _deduped(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """The columns of `docs` as c0, c1, ... with what is left of the text, then the RESULTS."""
    runs = later_copies(docs, key, text, min_words).withColumnsRenamed({"k": "rk", "t": "rt"})
    names = [f"c{i}" for i in range(len(docs.columns))]
    k, t = (names[docs.columns.index(c)] for c in (key, text))
    keyed = _with_row_key(docs.toDF(*names), k, t)
    joined = keyed.join(runs, (F.col("k") == F.col("rk")) & (F.col("t") == F.col("rt")), "left")
    lines = F.split(t, "\n")
    new = F.when(F.col("runs").isNull(), F.col(t)).otherwise(F.array_join(_left(lines, F.col("runs")), "\n"))
    count = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + (r["end"] - r["start"] + 1))
    return joined.select(
        *[new.alias(n) if n == t else F.col(n) for n in names],
        F.when(F.col(t).isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("n_deleted"),
        F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")).alias("deleted_runs"),
    )


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of `docs` with the text's later copies of repeated line runs deleted, then n_lines, n_deleted and deleted_runs.

    Lines end at newlines. A run is deleted where an earlier place (smaller key, or earlier in the
    text) has the same lines, if it has at least `min_words` words; overlapping runs merge, and a
    line's first place in the corpus always stays. `key` is an integer column. A null text stays null
    and has no lines; an empty text is one empty line. Rows that repeat both key and text are the same
    document and are treated alike; of rows that share a key alone, that with the smaller hash of its
    text comes first. Columns of `docs` may have any name; one named like a result gets _doc at its end.
    """
    return _deduped(docs, key, text, min_words).toDF(*free_names(docs.columns, RESULTS), *RESULTS)


def keep_left(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, length: str = "n_chars") -> DataFrame:
    """`docs`, in its own columns, with what dedupe_lines leaves of the texts, and without the rows whose lines were all deleted.

    Rows from which nothing was deleted stay, null and empty texts among them. A column `length` follows
    the text where there is one; null where the text is.
    """
    left = _deduped(docs, key, text, min_words).where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    body = F.col(f"c{docs.columns.index(text)}")
    # Only a text that was changed gets a new length.
    new = lambda i, f: F.when(F.col("n_deleted") > 0, F.char_length(body).cast(f.dataType)).otherwise(F.col(f"c{i}"))
    return left.select(*[(new(i, f) if f.name == length and length != text else F.col(f"c{i}")).alias(f.name) for i, f in enumerate(docs.schema)])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with what is left of its text; deleted_runs lists first-last line numbers."""
    out = dedupe_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.array_join(F.transform("deleted_runs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.select("doc_id", "n_lines", "n_deleted", runs.alias("deleted_runs"), "text")
