"""K1: interaction stream -> weighted (user, track) score per event-time window.

File-source ``readStream`` -> interaction mapping (B14/B15) -> watermark ->
tumbling ``window`` -> ``sum``.  Every event counts, as in the batch matrix (D23);
a source that may deliver an event twice names its id column, and events with an
id seen within the watermark are dropped.
Append mode emits a window once the watermark passes its end; late rows
are dropped.  ``run_interaction_latest`` uses update mode instead: every batch writes
the windows it changed, so windows still open are part of the result.
Checkpoints and output live under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlens.functions import columns as C
from listenlens.session import path_exists, scratch_path


def interactions_from_events(events: DataFrame, n_tracks: int) -> DataFrame:
    """The fixture interaction mapping as column expressions (stream-safe: the
    track count is a literal)."""
    e = F.col("event_id")
    track = (F.when(e % 5 == 0, (e * 31) % F.lit(n_tracks))
             .otherwise(((e * 31) % F.lit(n_tracks // 10)) * 10 + F.col("user_id") % 10))
    etype = F.col("event_type")
    itype = (F.when(etype == "purchase", "save").when(etype == "signup", "replay")
             .when(etype == "error", "skip").otherwise("listen"))
    dur = (F.when(etype == "error", 1000 + (e * 37) % 29000)
           .otherwise(30000 + (e * 37) % 200000))
    return events.select(
        "user_id", track.alias("track_id"), itype.alias("interaction_type"),
        (1 + e % 4).cast("int").alias("count"), dur.alias("duration_ms"),
        F.col("ts").cast("timestamp").alias("ts"))


def windowed_scores(interactions: DataFrame, window: str = "1 day",
                    watermark: str = "1 hour", event_id: str | None = None) -> DataFrame:
    """Weighted score per (window, user, track); works on batch and streaming frames."""
    itype = C.derive_skip("interaction_type", "duration_ms")
    df = interactions.withWatermark("ts", watermark) if interactions.isStreaming else interactions
    if event_id:
        df = df.dropDuplicatesWithinWatermark([event_id]) if interactions.isStreaming else df.dropDuplicates([event_id])
    df = df.withColumn("_w", C.interaction_weight(itype) * F.col("count"))
    return (df.groupBy(F.window("ts", window).alias("w"), "user_id", "track_id")
            .agg(F.sum("_w").alias("score"), F.count(F.lit(1)).alias("interactions"))
            .select("user_id", "track_id",
                    F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
                    "score", "interactions"))


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state (dedup keys, open windows) in RocksDB: off-heap, spills to
    local disk, snapshots to the checkpoint folder.  Only set when the session has
    not chosen a provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, None):
        spark.conf.set(key, ROCKSDB_PROVIDER)


def run_interaction_stream(spark: SparkSession, events_dir: str, n_tracks: int,
                           window: str = "1 day", watermark: str = "1 hour",
                           file_glob: str = "events*.parquet", out: str | None = None,
                           max_files_per_trigger: int | None = None) -> DataFrame:
    """Run K1 to completion over the files present (``availableNow``, which honours
    the rate limit when one is given) and return the emitted (closed) windows read
    back from the Parquet sink."""
    use_rocksdb_state(spark)
    src = _event_files(spark, events_dir, file_glob, max_files_per_trigger)
    out = out or scratch_path(spark, "k1-windows")
    q = (windowed_scores(interactions_from_events(src, n_tracks), window, watermark)
         .writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", f"{out}/_checkpoint").option("path", f"{out}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def _event_files(spark: SparkSession, events_dir: str, file_glob: str, max_files_per_trigger: int | None) -> DataFrame:
    schema = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
              "value double, props string")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(events_dir)


def run_interaction_latest(spark: SparkSession, events_dir: str, n_tracks: int, window: str = "1 day",
                           watermark: str = "1 hour", file_glob: str = "events*.parquet", out: str | None = None,
                           max_files_per_trigger: int | None = None) -> DataFrame:
    """K1 with its open windows: the latest score of every window.

    Each micro-batch writes the windows it changed into its own folder with overwrite,
    so a retried batch replaces its own output; a window's row is that of its last
    batch.  State is bounded as in append mode: windows the watermark has passed leave it,
    and rows later than that are dropped.  Called again with the same ``out``, the stream
    goes on from its checkpoint with the files that are new.  No input gives no rows.
    """
    use_rocksdb_state(spark)
    src = _event_files(spark, events_dir, file_glob, max_files_per_trigger)
    out = out or scratch_path(spark, "k1-latest")
    scores = windowed_scores(interactions_from_events(src, n_tracks), window, watermark)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    q = (scores.writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, f"{out}/data"):
        return spark.createDataFrame([], scores.schema)
    last = F.max_by(F.struct("score", "interactions"), "batch")
    return (spark.read.parquet(f"{out}/data")
            .groupBy("user_id", "track_id", "window_start", "window_end").agg(last.alias("_last"))
            .select("user_id", "track_id", "window_start", "window_end", "_last.*"))
