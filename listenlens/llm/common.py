"""Helpers shared by the corpus operators: tables, written intermediates, prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenlens.session import scratch_path

# words as most operators count them: anything between ASCII white space
# the files replace the shuffles below them, so those go at once; rows hold whole
# texts, so Python gets few at a time
_WHILE_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                  "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Later passes scan the files, so nothing upstream runs twice and a lost
    executor costs a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write
    if codec:
        w = w.option("compression", codec)
    before = {k: spark.conf.get(k, None) for k in _WHILE_STORING}
    for k, v in _WHILE_STORING.items():
        spark.conf.set(k, v)
    try:
        w.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a stored frame that no later result reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def crc_mod(column: str, modulus: int):
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def word_count(column: str):
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def running_start(parts: DataFrame, order: str, size: str, out: str) -> DataFrame:
    """Sum of ``size`` over all earlier rows of a small table (one row a partition)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stored rows with ``index``, their place (from 0) in the whole sorted table.

    Rows are range-partitioned and sorted; a row's index is its place in its file
    plus the rows of the files before, so no task sees more than one part.
    """
    cols = [F.col(c).asc_nulls_last() for c in order]
    kept = store(df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                 .withColumn("part", F.spark_partition_id()), name)
    parts = running_start(kept.groupBy("part").agg(F.count(F.lit(1)).alias("size")), "part", "size", "before")
    return (kept.withColumn("inside", F.expr("_metadata.row_index")).join(parts.select("part", "before"), "part")
            .withColumn("index", F.col("before") + F.col("inside")).drop("part", "before", "inside"))


def text_key(column: str):
    """Join key of a nullable column: null has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]
