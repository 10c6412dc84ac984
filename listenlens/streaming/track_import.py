"""K2: track import stream keeping the first row per track_uri.

Each micro-batch is reduced to one row per ``track_uri`` (smallest
``track_id`` wins), anti-joined against what the table already holds, and
written into its own ``batch=<id>`` folder with overwrite, so a retried
batch replaces its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlens.session import path_exists, scratch_path
from listenlens.sources.ingest import first_per_uri


def import_batch(table_path: str):
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = first_per_uri(batch)
        if path_exists(spark, table_path):
            stored = (spark.read.parquet(table_path)
                      .filter(F.col("batch") != batch_id).select("track_uri"))
            fresh = fresh.join(stored, "track_uri", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
    return handle


def run_track_import(spark: SparkSession, tracks_stream: DataFrame,
                     table_path: str | None = None) -> DataFrame:
    """Run K2 over the available input and return the stored track table."""
    table_path = table_path or scratch_path(spark, "k2-tracks")
    q = (tracks_stream.writeStream.foreachBatch(import_batch(f"{table_path}/data"))
         .option("checkpointLocation", f"{table_path}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{table_path}/data").drop("batch")
