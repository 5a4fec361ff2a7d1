"""Settings of a Spark session for the size of the data and of the cluster."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Bytes of shuffled data that a task should get, and partitions for each core at least and in all at most.
PARTITION_BYTES, WAVES, MOST_PARTITIONS = 128 << 20, 2, 100_000


def settings(shuffled_bytes: int, cores: int, shared: str | None = None) -> dict[str, str]:
    """Shuffle partitions for the largest shuffle, adaptive execution that joins small partitions and splits skewed ones, and the shared folder.

    Partitions come from the data; adaptive execution merges what turns out small, so too many cost
    little, while too few spill.
    """
    partitions = min(MOST_PARTITIONS, max(WAVES * cores, -(-shuffled_bytes // PARTITION_BYTES)))
    out = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES // 2),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return out | ({"spark.checkpoint.dir": shared} if shared else {})


def session(name: str, shuffled_bytes: int, cores: int, shared: str | None = None, more: Mapping[str, str] = {}) -> SparkSession:
    """A session with these settings and any others, which win."""
    builder = SparkSession.builder.appName(name)
    for key, value in (settings(shuffled_bytes, cores, shared) | dict(more)).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
