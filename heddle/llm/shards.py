"""Operator 9: sharding by a two-pass external shuffle. DataFrame functions only.

First pass: a key's shard is the one with the largest seeded hash of key and shard number, so one more
shard takes keys only into itself; within a shard, seeded hashes scatter rows uniformly over buckets
that fit in memory. Second pass: each bucket's whole records are put in a Fisher-Yates shuffled order
and written with their slots, one file for each bucket. What the query tells is read from these files.

Slots depend on the records alone: a bucket's permutation is drawn in a partition whose number, and
whose buckets before it, follow from the number of buckets, not from the cluster or from how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import new_path, shuffles_removed
from .common import cut, read_table

SHARDS, SEED = 24, 20_240_229
#: A bucket holds about so many bytes of records and rows at most.
BUCKET_BYTES, BUCKET_ROWS = 64 << 20, 50_000
#: Columns that sharding adds; a document's own column of such a name gets _doc at its end.
ADDED = ("size", "text_crc32", "shard", "grown_shard", "bucket", "buckets", "order_key", "slot")


def _shard(key: Column, shards: int) -> Column:
    weights = F.array(*[F.xxhash64(F.lit(SEED + i), key) for i in range(shards)])
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def dealt(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The columns of `docs` with size, text_crc32, shard, grown_shard, bucket, buckets (in a shard) and order_key.

    The number of buckets comes from one sum over all rows; hashes of key, size and checksum keep
    buckets near their mean, and only rows alike in all three must share one. A null text has no bytes
    (size 8, checksum 0); a null key is a key like any other.
    """
    own = docs.toDF(*[f"{c}_doc" if c.lower() in ADDED else c for c in docs.columns])
    key, text = (own.columns[docs.columns.index(c)] for c in (key, text))
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    total = own.agg(F.sum(F.octet_length(body) + 8), F.count("*")).first()
    buckets = max(1, -(-(total[0] or 0) // (shards * bucket_bytes)), -(-total[1] // (shards * bucket_rows)))
    rows = own.withColumns({"size": (F.octet_length(body) + 8).cast("bigint"), "text_crc32": F.crc32(body), "shard": _shard(F.col(f"`{key}`"), shards), "grown_shard": _shard(F.col(f"`{key}`"), shards + 1)})
    spread = lambda seed: F.xxhash64(F.lit(seed), F.col(f"`{key}`"), "size", "text_crc32")
    return rows.withColumns({"bucket": F.pmod(spread(SEED - 1), F.lit(buckets)).cast("int"), "buckets": F.lit(buckets), "order_key": spread(SEED - 2)})


def shuffled(rows: DataFrame, parts: int) -> DataFrame:
    """Dealt rows with slot, which runs from 0 without a gap in each shard; buckets follow each other within their shard.

    Records are shuffled once, by bucket, into `parts` partitions. A bucket's rows are numbered in hash
    order, which doesn't depend on how they arrive; each looks up its place in the bucket's Fisher-Yates
    permutation, which one row holds. Rows that repeat get a slot each.
    """
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = cut(counts.select("shard", "bucket", before.alias("_start"), (F.col("n") - 1).cast("int").alias("_last")))
    # Explicit numbers of partitions are kept as they are, and sorted buckets draw in turn: the generator's state is the same on every run.
    dealt_out = starts.repartition(parts, "shard", "bucket").sortWithinPartitions("shard", "bucket")
    drawn = dealt_out.select("shard", "bucket", "_start", F.shuffle(F.sequence(F.lit(0), F.col("_last")), SEED).alias("_p"))
    bucket = Window.partitionBy("shard", "bucket").orderBy("order_key")
    placed = rows.repartition(parts, "shard", "bucket").withColumn("_i", F.row_number().over(bucket))
    both = placed.join(drawn.hint("merge"), ["shard", "bucket"])
    return both.withColumn("slot", F.col("_start") + F.element_at("_p", F.col("_i"))).select(*[F.col(f"`{c}`") for c in rows.columns], "slot")


def _parts(rows: DataFrame, shards: int) -> int:
    """As many partitions as there are buckets in all."""
    found = rows.select("buckets").first()
    return shards * (found.buckets if found else 1)


def slots(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """`key`, size, text_crc32, shard, grown_shard, slot of rows dealt into so many shards."""
    return shuffled(rows, _parts(rows, shards)).select(F.col(f"`{key}`"), "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Writes whole records with their slots into shard folders, one file for each bucket, each in the order of its slots.

    A document's own columns named as one of ADDED have _doc at the end. Repeated rows are records of
    their own; which of two rows alike in key and text gets which of their two slots is not defined. An
    empty table writes no record.
    """
    rows = dealt(docs, key, text, shards)
    out = shuffled(rows, _parts(rows, shards)).drop("size", "text_crc32", "grown_shard", "buckets", "order_key")
    with shuffles_removed(docs.sparkSession):
        out.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard", "bucket").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the law `key`, as the shards' files hold them. A null text has no bytes (size 8, checksum 0); repeated rows get a slot each."""
    path = new_path(spark, "shards")
    docs = read_table(spark, sf_dir, "documents")
    write_shards(docs, path)
    # With the columns' types, an empty table can be read back too.
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    found = spark.read.schema(f"{fields}, slot bigint, shard int, bucket int").parquet(path)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return found.select(
        "doc_id", (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", _shard(F.col("doc_id"), SHARDS + 1).alias("grown_shard")
    )
