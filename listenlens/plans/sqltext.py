"""Helpers to write the DuckDB oracle texts."""

from __future__ import annotations

from listenlens.sources.fixtures import oracle_ctes

__all__ = ["oracle_ctes", "rh", "rq", "ENRICHED_CTE", "with_enriched"]


def rh(expr: str, digits: int) -> str:
    """SQL twin of columns.round_half_up."""
    s = f"{10 ** digits:.1f}"
    return f"(floor(({expr}) * {s} + 0.5) / {s})"


def rq(expr: str) -> str:
    return rh(expr, 9)


_INT_FEATURES = ("key", "mode", "time_signature")
_MEDIAN_FILL = ", ".join(
    (f"coalesce({c}, CAST(round((SELECT median({c}) FROM tracks)) AS INTEGER)) AS {c}"
     if c in _INT_FEATURES else f"coalesce({c}, (SELECT median({c}) FROM tracks)) AS {c}")
    for c in ["danceability", "energy", "key", "loudness", "mode", "speechiness",
              "acousticness", "instrumentalness", "liveness", "valence", "tempo",
              "time_signature"])

# The cleaned track dimension and the enriched library, in DuckDB SQL.
ENRICHED_CTE = f""",
clean_tracks AS (
  SELECT track_id, track_uri, track_name, artist_name, album_name, genres, release_date,
         duration_ms, popularity, explicit,
         CASE WHEN genres IS NULL OR genres = '' THEN []::VARCHAR[]
              ELSE list_transform(string_split(genres, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) END AS genres_list,
         CASE WHEN regexp_matches(release_date, '^[0-9]{{4}}(-[0-9]{{1,2}}(-[0-9]{{1,2}})?)?$')
              THEN CAST(left(release_date, 4) AS INTEGER) END AS release_year,
         duration_ms / 60000.0 AS duration_min,
         {_MEDIAN_FILL}
  FROM tracks
),
clean_tracks2 AS (
  SELECT *, coalesce(genres_list[1], 'unknown') AS primary_genre,
         CAST(len(genres_list) AS INTEGER) AS genre_count
  FROM clean_tracks
),
enriched AS (
  SELECT l.add_id, l.user_id, l.added_at, t.*,
         CAST(hour(l.added_at) AS INTEGER) AS added_hour,
         CAST(isodow(l.added_at) - 1 AS INTEGER) AS added_day,
         CAST(month(l.added_at) AS INTEGER) AS added_month,
         CAST(year(l.added_at) AS INTEGER) AS added_year,
         CAST(l.added_at AS DATE) AS added_date,
         coalesce(isodow(l.added_at) - 1 IN (5, 6), false) AS is_weekend,
         coalesce(hour(l.added_at) >= 22 OR hour(l.added_at) < 6, false) AS is_night
  FROM library l JOIN clean_tracks2 t ON l.track_id = t.track_id
)
"""


def with_enriched(*extra_views: str) -> str:
    """WITH clause: tracks, library (+ extras), then the enriched CTEs."""
    names = ["tracks", "library", *[v for v in extra_views if v not in ("tracks", "library")]]
    return oracle_ctes(*names).rstrip("\n") + ENRICHED_CTE
