"""Linking records as they arrive.

The reference files stand still and the input streams: each micro-batch goes through the same passes
as a batch run and its confirmed links are appended. Records already linked in an earlier batch are
left out, so a batch that is replayed after a failure adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import except_keys


def link_stream(stream: DataFrame, link: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "record_id_raw_input_file") -> StreamingQuery:
    """Runs `link` (records to confirmed links) on every micro-batch and appends its rows to Parquet at `path`."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = link(batch)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            # Of what is there the keys alone are read.
            out = except_keys(out, spark.read.schema(out.schema).parquet(path).select(key), [key])
        out.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_per_key(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first row seen of each key within the watermark; later repeats are dropped with bounded state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
