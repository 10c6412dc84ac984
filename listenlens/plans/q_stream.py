"""Registered streaming queries (K1, K2)."""

from __future__ import annotations

from listenlens.plans.catalog import register, round_doubles
from listenlens.plans.q_taste import WEIGHT_SQL
from listenlens.plans.sqltext import oracle_ctes, rq
from listenlens.sources.fixtures import TRACKS_SQL, Views
from listenlens.streaming.interactions import run_interaction_latest, run_interaction_stream
from listenlens.streaming.track_import import run_track_import


_WINDOWS = oracle_ctes("interactions") + f"""
, typed AS (SELECT user_id, track_id, count, ts,
                   CASE WHEN interaction_type = 'listen' AND duration_ms < 30000 THEN 'skip'
                        ELSE interaction_type END AS t FROM interactions),
b AS (SELECT user_id, track_id, date_trunc('day', ts) AS ws, sum({WEIGHT_SQL} * count) AS score,
             count(*) AS interactions FROM typed GROUP BY ALL)
SELECT user_id, track_id, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       {rq('score')} AS score, interactions
FROM b
"""


@register("stream_interaction_windows", _WINDOWS + """
WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM interactions) - INTERVAL 1 HOUR
""")
def q_stream_interaction_windows(spark, sf_dir):
    """K1: daily weighted scores from the event file stream; closed windows only."""
    n_tracks = Views(spark, sf_dir).n_tracks
    return round_doubles(run_interaction_stream(spark, sf_dir, n_tracks))


@register("stream_interaction_latest", _WINDOWS)
def q_stream_interaction_latest(spark, sf_dir):
    """K1: the same scores with the windows that are still open."""
    n_tracks = Views(spark, sf_dir).n_tracks
    return round_doubles(run_interaction_latest(spark, sf_dir, n_tracks))


@register("stream_track_import", oracle_ctes("tracks") + """
SELECT track_id, track_uri, track_name, artist_name, album_name, genres, release_date, popularity
FROM tracks
""")
def q_stream_track_import(spark, sf_dir):
    """K2: track rows streamed from the part files, first row per track_uri kept."""
    part_stream = (spark.readStream.schema(Views(spark, sf_dir).table("part").schema)
                   .option("pathGlobFilter", "part*.parquet").parquet(sf_dir))
    tracks = spark.sql(TRACKS_SQL, part=part_stream)
    return run_track_import(spark, tracks).select(
        "track_id", "track_uri", "track_name", "artist_name", "album_name", "genres",
        "release_date", "popularity")

