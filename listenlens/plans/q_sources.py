"""Registered source/sink queries (A1, A2, A4-A6, A8): data derived from the given
tables is written in an ingest format, read back with the ingest operators, and
aggregated; the oracle is the aggregate's own SQL."""

from __future__ import annotations

from listenlens.plans.catalog import register, round_doubles
from listenlens.plans.q_profile import D1_BODY, D3_SQL
from listenlens.plans.sqltext import oracle_ctes, rq, with_enriched
from listenlens.sources.fixtures import Views

LISTENING_STATS_ORACLE = with_enriched() + D1_BODY


@register("csv_library_roundtrip", LISTENING_STATS_ORACLE)
def q_csv_library_roundtrip(spark, sf_dir):
    """A1 + A2 + A8: the enriched library written as an export-style CSV (reference
    headers), read back by column name, then D1."""
    from pyspark.sql import functions as F
    from listenlens.operators import profile as P
    from listenlens.operators.enrich import clean_tracks, enrich_library
    from listenlens.session import scratch_path
    from listenlens.sources.ingest import LIBRARY_CSV_HEADERS, load_library_csv
    v = Views(spark, sf_dir)
    raw = v.library.join(v.tracks, "track_id")
    names = ["track_uri", "track_name", "artist_name", "album_name", "genres", "release_date",
             "added_at", "duration_ms", "explicit", "popularity", "danceability", "energy", "key",
             "loudness", "mode", "speechiness", "acousticness", "instrumentalness", "liveness",
             "valence", "tempo", "time_signature"]
    export = raw.select("user_id", *[F.col(n).alias(h) for n, h in zip(names, LIBRARY_CSV_HEADERS)])
    export = export.withColumn("Added At", F.date_format("Added At", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    path = scratch_path(spark, "library-csv")
    export.write.option("header", True).csv(path)
    back = load_library_csv(spark, path).withColumn("user_id", F.col("user_id").cast("bigint"))
    lib = back.select("user_id", "track_uri", "added_at")
    tracks = clean_tracks(back.drop("user_id", "added_at", "corrupt_fields").dropDuplicates(["track_uri"]))
    return P.listening_stats(enrich_library(lib, tracks, "track_uri"))


def _interaction_matrix_oracle():
    from listenlens.plans.q_taste import _MATRIX
    return oracle_ctes("interactions") + _MATRIX.replace("\n, typed", ", typed", 1) + \
        f"SELECT user_id, track_id, {rq('score')} AS score, interactions FROM matrix"


@register("csv_interactions_roundtrip", _interaction_matrix_oracle())
def q_csv_interactions_roundtrip(spark, sf_dir):
    """A4: interactions exported as CSV (user_id, track_id, interaction_type, count,
    timestamp), read back by column name, then D23."""
    from pyspark.sql import functions as F
    from listenlens.operators import taste as TA
    from listenlens.session import scratch_path
    from listenlens.sources.ingest import load_interactions_csv
    v = Views(spark, sf_dir)
    path = scratch_path(spark, "interactions-csv")
    (v.interactions.select("user_id", "track_id", "interaction_type", "count",
                           F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"))
     .write.option("header", True).csv(path))
    back = load_interactions_csv(spark, path).withColumns({c: F.col(c).cast("bigint") for c in ("user_id", "track_id")})
    # the export carries no duration: B15 needs none when types are already final
    return round_doubles(TA.interaction_matrix(back, derive_skips=False))


def _text_ids_oracle():
    from listenlens.plans.q_taste import _MATRIX
    return oracle_ctes("interactions") + _MATRIX.replace("\n, typed", ", typed", 1) + f"""
SELECT 'user_' || user_id AS user_id, 'track_' || track_id AS track_id, {rq('score')} AS score, interactions FROM matrix"""


@register("csv_text_ids", _text_ids_oracle())
def q_csv_text_ids(spark, sf_dir):
    """A4 + D23 with text ids (user_..., track_...) and durations, columns in another order."""
    from pyspark.sql import functions as F
    from listenlens.operators import taste as TA
    from listenlens.session import scratch_path
    from listenlens.sources.ingest import load_interactions_csv
    v = Views(spark, sf_dir)
    path = scratch_path(spark, "interactions-text-ids")
    (v.interactions.select("duration_ms", "interaction_type", F.concat(F.lit("track_"), "track_id").alias("track_id"),
                           "count", F.concat(F.lit("user_"), "user_id").alias("user_id"))
     .write.option("header", True).csv(path))
    return round_doubles(TA.interaction_matrix(load_interactions_csv(spark, path)))


@register("genre_literal_roundtrip", D3_SQL)
def q_genre_literal_roundtrip(spark, sf_dir):
    """A5: tracks exported with the trainer's list-literal genres ("['a', 'b']"),
    parsed back with string functions (no eval), then D3 on the library."""
    from pyspark.sql import functions as F
    from listenlens.operators import profile as P
    from listenlens.operators.enrich import clean_tracks, enrich_library
    from listenlens.session import scratch_path
    from listenlens.sources.ingest import parse_genre_literal
    v = Views(spark, sf_dir)
    lit = clean_tracks(v.tracks, median_fill=None).select(
        "track_id", "artist_name", F.concat(F.lit("["), F.array_join(F.transform(
            "genres_list", lambda g: F.concat(F.lit("'"), g, F.lit("'"))), ", "), F.lit("]"))
        .alias("genres"))
    path = scratch_path(spark, "genre-literal-csv")
    lit.write.option("header", True).csv(path)
    back = (spark.read.schema("track_id long, artist_name string, genres string")
            .option("header", True).csv(path)
            .withColumn("genres_list", parse_genre_literal("genres")))
    lib = v.library.join(back, "track_id")
    return round_doubles(P.genre_distribution(lib))


@register("json_track_import", oracle_ctes("tracks") + """
SELECT track_id, track_uri, track_name, artist_name, popularity FROM tracks
""")
def q_json_track_import(spark, sf_dir):
    """API-style track objects as JSON lines (each sent twice), imported with
    first-row-per-track_uri dedup into a Parquet table."""
    from listenlens.session import scratch_path
    from listenlens.sources.ingest import import_tracks, read_tracks_json
    v = Views(spark, sf_dir)
    src = scratch_path(spark, "tracks-json")
    v.tracks.unionByName(v.tracks).write.json(src)
    table = scratch_path(spark, "tracks-table")
    import_tracks(read_tracks_json(spark, src, v.tracks.schema), table)
    return spark.read.parquet(table).select("track_id", "track_uri", "track_name",
                                            "artist_name", "popularity")


@register("report_output", LISTENING_STATS_ORACLE)
def q_report_output(spark, sf_dir):
    """A run's result tables written one folder each; D1 read back."""
    from listenlens.operators import profile as P
    from listenlens.operators.enrich import enriched
    from listenlens.session import scratch_path
    from listenlens.sources.ingest import write_report
    paths = write_report({"listening_stats": P.listening_stats(enriched(Views(spark, sf_dir)))},
                         scratch_path(spark, "report"))
    return spark.read.parquet(paths["listening_stats"])


@register("full_report_manifest")
def q_full_report_manifest(spark, sf_dir):
    """A8 production run: all per-listener tables written from one materialised
    library; returns (table, path, rows) (side-effecting: rows-only check)."""
    from listenlens.operators.enrich import enriched
    from listenlens.plans.report import full_report
    from listenlens.session import scratch_path
    return full_report(enriched(Views(spark, sf_dir)), scratch_path(spark, "full-report")) \
        .select("table", "rows")
