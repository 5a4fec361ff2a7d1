"""What operators need from the running Spark application."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_tables: dict[str, list[str]] = {}

#: Rows and bytes of an Arrow batch between Spark and Python. Spark's own bounds (10,000 rows, 64 MB or more) are copied
#: several times over on both sides, beyond the heap, in every task at once; whole texts need far smaller ones.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names in spark.checkpoint.dir.

    Only where that is unset and the application runs in one process, as in tests, a temporary one is made.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (own := spark.conf.get("spark.heddle.folder", None)):
        own = tempfile.mkdtemp(prefix="heddle-")
        spark.conf.set("spark.heddle.folder", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, a write removes its shuffle files as soon as it is done, rather than when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """The rows as a Parquet table, which cuts the lineage in less room than a checkpoint; empty tables can be read back, too."""
    with shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table of their own in the shared folder, for results that are read again and again.

    Unlike a checkpoint, a table has a known size, so joins with small ones need no shuffle, and its columns
    are read as needed. Tables stay until clear() is called.
    """
    path = new_path(df.sparkSession, "table")
    _tables.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return written(df, path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's stored tables; results that still read them are no longer usable."""
    removed(spark, *_tables.pop(spark.sparkContext.applicationId, []))


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders in whatever file system they are."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession, bounded: bool = True) -> None:
    """Sends this package's source to the executors, once for each application.

    Executors then need no installed copy, and Python workers can keep what they have built, such as an
    automaton, in module-level caches. Arrow batches are bounded where the session itself doesn't bound them; short
    columns do without that.
    """
    context = spark.sparkContext
    for name, value in BATCHES.items() if bounded else ():
        if spark.conf.get(name) == spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(name):
            spark.conf.set(name, value)
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # On the driver only; Spark serves the file to the executors.
    target = os.path.join(tempfile.mkdtemp(), "heddle_source.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "heddle")):
            for name in names:
                if name.endswith(".py"):
                    z.write(path := os.path.join(folder, name), os.path.relpath(path, root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
