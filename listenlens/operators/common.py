"""Small shared helpers: keys, per-group top-k, written intermediates."""

from __future__ import annotations

import re
import threading
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_KEYS = ("user_id",)
# seconds between two sweeps of a long fit
SWEEP_S = 10.0
# most rows that many passes read from the file of a single part
PART_ROWS = 100_000


def as_keys(keys) -> list[str]:
    if keys is None:
        return list(DEFAULT_KEYS)
    if isinstance(keys, str):
        return [keys]
    return list(keys)


def top_k(df: DataFrame, keys: list[str], order: list[Column], n: int,
          rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n per key group.

    With keys, ``row_number() <= n`` lets the planner insert a partial
    ``WindowGroupLimit`` before the shuffle, so a hot key ships at most n rows
    per map task.  Without keys it is a global ``orderBy().limit()``
    (TakeOrderedAndProject).
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)
    w = Window.orderBy(*order)
    return (df.orderBy(*order).limit(n)
            .withColumn(rank_col, F.row_number().over(w)))


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two per-key results; with no keys both sides are single rows."""
    if keys:
        return left.join(right, keys, how)
    # whole-frame results are one-row aggregates: attach the right row as a
    # struct-valued scalar subquery (no join, no cross product)
    r = right.select(F.struct(*right.columns).alias("_r")).scalar()
    return left.withColumn("_r", r).select(*left.columns, *[
        F.col("_r").getField(c).alias(c) for c in right.columns if c not in left.columns])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used where one expensive input feeds several branches (or a count and a
    later pass): each branch then scans the written table instead of
    recomputing the upstream plan, and the lineage is cut, so a lost executor
    re-reads files instead of recomputing from the raw tables.
    """
    return df.sparkSession.read.parquet(materialize_path(df, name))


def spread(df: DataFrame, name: str) -> DataFrame:
    """``df`` for many passes: more rows than one part should hold are written once and
    dealt over all cores, since every pass over a file of few row groups runs on few of them."""
    if df.count() <= PART_ROWS:
        return df
    return materialize(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), name)


def materialize_path(df: DataFrame, name: str) -> str:
    """Write ``df`` once under the shared checkpoint folder; return the path (read it
    as often as needed: each read is an independent scan with its own lineage)."""
    from listenlens.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def write_parts(df: DataFrame, name: str) -> str:
    """Write ``df`` once with a subfolder for each value of its column ``part``; return the folder
    as tasks on any machine need it for ``read_part`` (S3A is S3 to Arrow)."""
    path = scratch_uri(df.sparkSession, name)
    df.write.partitionBy("part").parquet(path)
    return re.sub("^s3[an]:", "s3:", path)


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, with its file system."""
    from listenlens.session import scratch_path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    p = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return f"{p.getScheme()}://{p.getAuthority() or ''}{p.getPath()}"


def read_part(folder: str, k: int) -> pa.Table | None:
    """The rows of a part, read by a task; None where there are none."""
    files, path = fs.FileSystem.from_uri(f"{folder}/part={k}")
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return pq.read_table(path, filesystem=files, partitioning=None)


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that nothing refers to any more.

    It does so once the driver's garbage collector finds them, and by itself has that run
    every half an hour only; a long fit leaves more with every pass.
    """
    spark._jvm.System.gc()


@contextmanager
def swept(spark: SparkSession):
    """Sweeps before, meanwhile and after."""
    done = threading.Event()

    def run():
        while not done.wait(SWEEP_S):
            sweep(spark)

    sweep(spark)
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        sweep(spark)
