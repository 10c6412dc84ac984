"""Ingest and output.

CSV columns are bound by name: the header gives the schema (no inference pass),
known columns are cast, and what cannot be cast is reported per row.  The genres
literal of the trainer CSVs is parsed with string functions, never evaluated.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.operators.common import materialize
from listenlens.operators.enrich import normalise_column_names, require_columns
from listenlens.session import path_exists

# The reference export's header names, in file order.
LIBRARY_CSV_HEADERS = ["Track URI", "Track Name", "Artist Name(s)", "Album Name", "Genres",
                       "Release Date", "Added At", "Duration (ms)", "Explicit", "Popularity",
                       "Danceability", "Energy", "Key", "Loudness", "Mode", "Speechiness",
                       "Acousticness", "Instrumentalness", "Liveness", "Valence", "Tempo",
                       "Time Signature"]
# types by normalised name; every other column, ids included, stays text
_DOUBLES = ("danceability", "energy", "loudness", "speechiness", "acousticness", "instrumentalness",
            "liveness", "valence", "tempo")
LIBRARY_TYPES = {"duration_ms": "bigint", "popularity": "int", "key": "int", "mode": "int",
                 "time_signature": "int", **{c: "double" for c in _DOUBLES}}
INTERACTION_TYPES = {"count": "int", "duration_ms": "bigint"}
CORRUPT = "corrupt_fields"
_RECORD = "_corrupt_record"

REQUIRED_TRACK_COLUMNS = ["track_uri", "track_name", "energy", "valence", "danceability",
                          "tempo", "acousticness"]


def read_csv(spark: SparkSession, path: str, types: dict[str, str], multiline: bool = False,
             failfast: bool = False) -> DataFrame:
    """A CSV with header, bound by column name, double quotes escaped by doubling.

    Columns named in ``types`` are cast; any column may be missing.  The names that a
    row could not be read for are listed in ``corrupt_fields`` ("record" for a row of
    the wrong length), or raise an error with ``failfast``.  Files of one folder must
    share their header.
    """
    # without pruning a row of the wrong length is noticed whatever columns are read
    opts = {"header": True, "quote": '"', "escape": '"', "multiLine": multiline, "columnPruning": False}
    names = spark.read.options(**opts).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RECORD]])
    raw = (spark.read.schema(schema).options(**opts, enforceSchema=False, columnNameOfCorruptRecord=_RECORD,
                                             mode="FAILFAST" if failfast else "PERMISSIVE").csv(path))
    raw = normalise_column_names(raw)
    cast = {c: t for c, t in types.items() if c in raw.columns}
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    bad = F.array_compact(F.array(
        F.when(F.col(_RECORD).isNotNull(), F.lit("record")),
        *[F.when(~blank(c) & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in cast.items()]))
    values = {c: F.col(c).try_cast(t) for c, t in cast.items()}
    if failfast:
        values = {c: F.when(blank(c), F.lit(None)).otherwise(F.col(c).cast(t)) for c, t in cast.items()}
    return raw.withColumn(CORRUPT, bad).withColumns(values).drop(_RECORD)


def corrupt_report(df: DataFrame) -> DataFrame:
    """Rows that could not be read whole, counted by field."""
    return df.select(F.explode(CORRUPT).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("rows"))


def load_library_csv(spark: SparkSession, path: str, multiline: bool = False, failfast: bool = False) -> DataFrame:
    """A1 + A2: a library export with header; names normalised, timestamps parsed."""
    df = read_csv(spark, path, LIBRARY_TYPES, multiline, failfast)
    if "added_at" in df.columns:
        df = df.withColumn("added_at", F.try_to_timestamp("added_at").cast("timestamp_ntz"))
    return df


def load_interactions_csv(spark: SparkSession, path: str, failfast: bool = False) -> DataFrame:
    """A4: user_id and track_id as text, interaction_type, optional count, duration_ms and timestamp."""
    df = require_columns(read_csv(spark, path, INTERACTION_TYPES, failfast=failfast),
                         ["user_id", "track_id", "interaction_type"])
    if "timestamp" in df.columns:
        df = df.withColumn("ts", F.try_to_timestamp("timestamp").cast("timestamp_ntz"))
    return df


def parse_genre_literal(c: str = "genres"):
    """A5: "['rock', 'r&b, soul']" -> ["rock", "r&b, soul"]; null/blank -> [].

    Quoted items are taken whole; a list without quotes is split at commas.
    """
    body = F.regexp_replace(F.trim(F.col(c)), r"^\[|\]$", "")
    quoted = F.regexp_extract_all(body, F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""))
    bare = F.transform(quoted, lambda x: F.regexp_replace(F.substring(x, 2, F.length(x) - 2), r"\\(.)", "$1"))
    split = F.transform(F.split(body, ","), lambda x: F.trim(x))
    return (F.when(F.col(c).isNull() | (F.trim(body) == ""), F.array().cast("array<string>"))
            .when(F.size(quoted) > 0, bare).otherwise(split))


def validate_tracks(df: DataFrame) -> DataFrame:
    """A3: fail fast when a required column is missing."""
    return require_columns(df, REQUIRED_TRACK_COLUMNS)


def first_per_uri(tracks: DataFrame) -> DataFrame:
    """One row per track_uri: that with the smallest track_id."""
    w = Window.partitionBy("track_uri").orderBy(F.asc("track_id"))
    return tracks.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def import_tracks(tracks: DataFrame, table_path: str) -> int:
    """Keep the first row per track_uri (smallest track_id), append those not yet in
    a Parquet table, return how many were imported."""
    spark = tracks.sparkSession
    fresh = first_per_uri(tracks)
    if path_exists(spark, table_path):
        fresh = fresh.join(spark.read.parquet(table_path).select("track_uri"), "track_uri", "left_anti")
    fresh = materialize(fresh, "import")
    fresh.write.mode("append").parquet(table_path)
    return fresh.count()


def read_tracks_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A6 input: API-style track objects as JSON lines, explicit schema."""
    return spark.read.schema(schema).json(path)


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """One folder per result table of a run; returns name -> path."""
    return {name: path for name, (path, _) in write_counted(tables, folder, fmt).items()}


def write_counted(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet",
                  parallelism: int = 4) -> dict[str, tuple[str, int]]:
    """One folder per table; returns name -> (path, rows).  The rows are counted by the
    writing tasks (no table is read again), and independent tables are written side by side."""
    def write(item: tuple[str, DataFrame]) -> tuple[str, tuple[str, int]]:
        name, df = item
        path = f"{folder.rstrip('/')}/{name}"
        seen = Observation(f"rows-{name}-{uuid.uuid4().hex[:8]}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt).save(path)
        return name, (path, int(seen.get["rows"]))

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(tables) or 1))) as pool:
        return dict(pool.map(write, tables.items()))
