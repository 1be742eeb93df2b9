"""Write an intermediate result once so that several readers, or the next round of a
loop, start from stored rows instead of recomputing the lineage.

The rows go to Parquet in the shared folder named by ``spark.checkpoint.dir``, so a
lost executor costs nothing and later readers prune columns.  The shuffle files that led to
the rows go with the end of the write: left to the driver's garbage collection, those of all
steps of a chain would lie on the disks at once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
#: Spark's own switch: the shuffle files of a query are removed when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: So many rows of a side may be sent to all tasks of a join.
FEW = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a throw-away one only for local sessions without it."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="quirework-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def new_path(spark: SparkSession) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    rows = spark.read.schema(df.schema).parquet(path)
    rows.settled_at = path
    return rows


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join, for which both sides are dealt out by key and none is collected.

    Spark sizes rows by the files they come from and by the width of their columns: stored rows that
    compress well, a few columns of a table and the rows of an explode are taken for far smaller than
    they are, and the driver would collect them to send them to all tasks."""
    return df.hint("merge")


def few_or_dealt(df: DataFrame) -> DataFrame:
    """A side of a join: as it is where it is counted to have few rows, which Spark may then send to all tasks; else dealt out."""
    return df if df.limit(FEW + 1).count() <= FEW else dealt(df)


def discard(*frames: DataFrame) -> None:
    """Delete the stored rows of settled frames that nothing reads any more, such as the
    rounds of a loop that a later round replaces.  Other frames are left alone."""
    for df in frames:
        path = getattr(df, "settled_at", None) if "settled_at" in vars(df) else None
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
            del df.settled_at
