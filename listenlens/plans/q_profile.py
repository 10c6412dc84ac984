"""Registered profile queries (D1-D3, D6-D8, D25, D26, F1) with oracles."""

from __future__ import annotations

from listenlens.functions.columns import AUDIO_FEATURES
from listenlens.operators import profile as P
from listenlens.operators.enrich import enriched
from listenlens.plans.catalog import register, round_doubles
from listenlens.plans.sqltext import rq as s6, rh, with_enriched
from listenlens.sources.fixtures import Views


def _enriched(spark, sf_dir):
    return enriched(Views(spark, sf_dir))


_D1_MEASURES = f"""count(*) AS total_tracks,
       count(DISTINCT artist_name) AS total_artists,
       count(DISTINCT album_name) AS total_albums,
       {rh('sum(duration_ms) / 3600000.0', 1)} AS total_hours,
       {rh('sum(duration_ms) / 60000.0', 0)} AS total_minutes,
       {rh('avg(duration_min)', 2)} AS avg_track_duration_min,
       coalesce(strftime(min(added_at), '%Y-%m-%d'), 'N/A') AS date_range_start,
       coalesce(strftime(max(added_at), '%Y-%m-%d'), 'N/A') AS date_range_end,
       CAST(count_if(explicit) AS BIGINT) AS explicit_tracks,
       {rh('avg(CAST(explicit AS DOUBLE)) * 100', 1)} AS explicit_percentage,
       {rh('avg(popularity)', 1)} AS avg_popularity"""
D1_BODY = f"""
SELECT user_id, {_D1_MEASURES}
FROM enriched GROUP BY user_id
"""


@register("listening_stats", with_enriched() + D1_BODY)
def q_listening_stats(spark, sf_dir):
    """D1 per listener."""
    return P.listening_stats(_enriched(spark, sf_dir))


_AVG = ",\n       ".join(f"avg({c}) AS avg_{c}" for c in AUDIO_FEATURES)

# D2 as CTEs over ``enriched`` (unrounded); reused by later oracles.
D2_CTES = f""",
uf_base AS (
  SELECT user_id, {_AVG},
         avg(CAST(is_night AS DOUBLE)) AS night_listener_ratio,
         avg(CAST(is_weekend AS DOUBLE)) AS weekend_ratio,
         avg(CAST(explicit AS DOUBLE)) AS explicit_ratio,
         count(*) AS total_tracks, avg(popularity) AS avg_popularity,
         avg(duration_min) AS avg_duration_min
  FROM enriched GROUP BY user_id),
uf_tagc AS (
  SELECT user_id, genre, count(*) AS n
  FROM (SELECT user_id, unnest(genres_list) AS genre FROM enriched) GROUP BY user_id, genre),
uf_tags AS (
  SELECT user_id, count(*) AS total_genres, sum(n) AS _tags, max(n) AS _top_n,
         arg_min(genre, (-n, genre)) AS top_genre
  FROM uf_tagc GROUP BY user_id),
uf_art AS (
  SELECT user_id, count(*) AS total_artists, count_if(n > 1) AS _repeat
  FROM (SELECT user_id, artist_name, count(*) AS n FROM enriched
        WHERE artist_name IS NOT NULL GROUP BY user_id, artist_name)
  GROUP BY user_id),
user_features AS (
  SELECT b.user_id, {", ".join(f"b.avg_{c}" for c in AUDIO_FEATURES)},
         CAST(coalesce(t.total_genres, 0) AS BIGINT) AS total_genres,
         coalesce(t.total_genres / t._tags, 0.0) AS genre_diversity,
         coalesce(t.top_genre, 'unknown') AS top_genre,
         coalesce(t._top_n / t._tags * 100, 0.0) AS top_genre_percentage,
         b.night_listener_ratio, b.weekend_ratio,
         coalesce(a._repeat / a.total_artists, 0.0) AS repeat_artist_ratio,
         b.explicit_ratio, b.total_tracks,
         CAST(coalesce(a.total_artists, 0) AS BIGINT) AS total_artists,
         b.avg_popularity, b.avg_duration_min
  FROM uf_base b LEFT JOIN uf_tags t ON b.user_id = t.user_id
                 LEFT JOIN uf_art a ON b.user_id = a.user_id)
"""

USER_FEATURE_DOUBLES = ([f"avg_{c}" for c in AUDIO_FEATURES] +
                        ["genre_diversity", "top_genre_percentage", "night_listener_ratio",
                         "weekend_ratio", "repeat_artist_ratio", "explicit_ratio",
                         "avg_popularity", "avg_duration_min"])


def rounded_select(table: str, cols_all: list[str], doubles: list[str]) -> str:
    items = [s6(c) + f" AS {c}" if c in doubles else c for c in cols_all]
    return f"SELECT {', '.join(items)} FROM {table}"


USER_FEATURE_COLS = (["user_id"] + [f"avg_{c}" for c in AUDIO_FEATURES] +
                     ["total_genres", "genre_diversity", "top_genre", "top_genre_percentage",
                      "night_listener_ratio", "weekend_ratio", "repeat_artist_ratio",
                      "explicit_ratio", "total_tracks", "total_artists", "avg_popularity",
                      "avg_duration_min"])


@register("user_features", with_enriched() + D2_CTES +
          rounded_select("user_features", USER_FEATURE_COLS, USER_FEATURE_DOUBLES))
def q_user_features(spark, sf_dir):
    """D2 per listener."""
    return round_doubles(P.user_features(_enriched(spark, sf_dir)))


D3_SQL = with_enriched() + f"""
, c AS (SELECT user_id, genre, count(*) AS n
        FROM (SELECT user_id, unnest(genres_list) AS genre FROM enriched) GROUP BY user_id, genre),
p AS (SELECT user_id, genre, n, n / sum(n) OVER (PARTITION BY user_id) * 100 AS percentage,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS INTEGER) AS rank FROM c)
SELECT user_id, genre, n, {s6('percentage')} AS percentage, rank FROM p WHERE rank <= 20
"""


@register("genre_distribution", D3_SQL)
def q_genre_distribution(spark, sf_dir):
    """D3: top 20 genre shares per listener."""
    return round_doubles(P.genre_distribution(_enriched(spark, sf_dir)))


def _artist_sql(n: int, detail: bool) -> str:
    dance = ", avg(danceability) AS avg_danceability" if detail else ""
    cols = ["avg_popularity", "avg_energy", "avg_valence"] + (["avg_danceability"] if detail else [])
    fmt = (lambda c: f"{rh(c, 2)} AS {c}") if detail else (lambda c: f"{s6(c)} AS {c}")
    return with_enriched() + f"""
, a AS (SELECT user_id, artist_name, count(*) AS track_count, avg(popularity) AS avg_popularity,
               avg(energy) AS avg_energy, avg(valence) AS avg_valence{dance}
        FROM enriched WHERE artist_name IS NOT NULL GROUP BY user_id, artist_name),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY track_count DESC, artist_name) AS INTEGER) AS rank FROM a)
SELECT user_id, artist_name, track_count, {", ".join(fmt(c) for c in cols)}, rank
FROM r WHERE rank <= {n}
"""


@register("top_artists", _artist_sql(10, False))
def q_top_artists(spark, sf_dir):
    """Top 10 artists per listener."""
    return round_doubles(P.top_artists(_enriched(spark, sf_dir), n=10))


@register("artist_detail", _artist_sql(15, True))
def q_artist_detail(spark, sf_dir):
    """Top 15 artists with danceability, 2 dp."""
    return P.top_artists(_enriched(spark, sf_dir), n=15, detail=True)


@register("top_tracks", with_enriched() + """
, r AS (SELECT user_id, track_id, add_id, track_name, artist_name, album_name, popularity, energy,
               valence, danceability, primary_genre,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY popularity DESC, track_id, add_id) AS INTEGER) AS rank
        FROM enriched)
SELECT * FROM r WHERE rank <= 10
""")
def q_top_tracks(spark, sf_dir):
    """top 10 tracks by popularity per listener."""
    return P.top_tracks(_enriched(spark, sf_dir), n=10)


@register("recap_stats", with_enriched() + f"""
, k AS (SELECT user_id, key, count(*) AS n FROM enriched GROUP BY user_id, key),
m AS (SELECT user_id, arg_min(key, (-n, key)) AS most_common_key FROM k GROUP BY user_id),
s AS (SELECT user_id, count(*) AS total_tracks, avg(energy) AS avg_energy, avg(valence) AS avg_valence,
             avg(tempo) AS avg_tempo, count_if(explicit) / count(*) * 100 AS explicit_percentage
      FROM enriched GROUP BY user_id)
SELECT s.user_id, total_tracks, {s6('avg_energy')} AS avg_energy, {s6('avg_valence')} AS avg_valence,
       {s6('avg_tempo')} AS avg_tempo, most_common_key, {s6('explicit_percentage')} AS explicit_percentage
FROM s JOIN m ON s.user_id = m.user_id
""")
def q_recap_stats(spark, sf_dir):
    """The recap stats block per listener."""
    return round_doubles(P.recap_stats(_enriched(spark, sf_dir)))


_D1_NO_OVERLAP = ["total_albums", "total_hours", "total_minutes", "avg_track_duration_min",
                  "date_range_start", "date_range_end", "explicit_tracks", "explicit_percentage"]


@register("stats_summary", with_enriched() + D2_CTES + f"""
, d1 AS ({D1_BODY})
SELECT d1.user_id, {", ".join("d1." + c for c in _D1_NO_OVERLAP)},
       {", ".join((s6("u." + c) + " AS " + c) if c in USER_FEATURE_DOUBLES else "u." + c
                  for c in USER_FEATURE_COLS[1:])}
FROM d1 JOIN user_features u ON d1.user_id = u.user_id
""")
def q_stats_summary(spark, sf_dir):
    """D1 ∪ D2 per listener."""
    out = P.stats_summary(_enriched(spark, sf_dir))
    return round_doubles(out.drop(*[c for c in out.columns if c in ()]))


@register("profile_summary", with_enriched() + D2_CTES + f"""
, d1 AS ({D1_BODY}),
ac AS (SELECT user_id, artist_name, count(*) AS n FROM enriched WHERE artist_name IS NOT NULL GROUP BY ALL),
ta AS (SELECT user_id, arg_min(artist_name, (-n, artist_name)) AS top_artist, max(n) AS top_artist_tracks
       FROM ac GROUP BY user_id),
mc AS (SELECT user_id, CASE WHEN energy > 0.5 AND valence > 0.5 THEN 'Happy & Energetic'
              WHEN energy > 0.5 THEN 'Angry & Intense' WHEN valence > 0.5 THEN 'Peaceful & Happy'
              ELSE 'Sad & Calm' END AS mood, count(*) AS n FROM enriched GROUP BY ALL),
dm AS (SELECT user_id, arg_min(mood, (-n, mood)) AS dominant_mood,
              {s6('max(n) / sum(n) * 100')} AS dominant_mood_percentage FROM mc GROUP BY user_id)
SELECT d1.user_id, {", ".join("d1." + c for c in _D1_NO_OVERLAP)},
       {", ".join((s6("u." + c) + " AS " + c) if c in USER_FEATURE_DOUBLES else "u." + c
                  for c in USER_FEATURE_COLS[1:])},
       dominant_mood, dominant_mood_percentage, top_artist, coalesce(top_artist_tracks, 0) AS top_artist_tracks
FROM d1 JOIN user_features u ON d1.user_id = u.user_id JOIN dm ON d1.user_id = dm.user_id
LEFT JOIN ta ON d1.user_id = ta.user_id
""")
def q_profile_summary(spark, sf_dir):
    """The printed summary, with top artist and dominant mood."""
    return round_doubles(P.profile_summary(_enriched(spark, sf_dir)))


@register("listening_stats_grains", with_enriched() + f"""
SELECT CASE WHEN grouping(user_id) = 0 THEN user_id ELSE -1 END AS user_id,
       CASE WHEN grouping(user_id) = 0 THEN 'user' ELSE 'all' END AS grain,
       {_D1_MEASURES}
FROM enriched GROUP BY GROUPING SETS ((user_id), ())
""")
def q_listening_stats_grains(spark, sf_dir):
    """All D1 measures per listener and overall in one pass."""
    return P.listening_stats_both_grains(_enriched(spark, sf_dir))


PERIOD = ("2024-01-08 00:00:00", "2024-01-22 00:00:00")


def _period_oracle() -> str:
    from listenlens.plans.sqltext import ENRICHED_CTE
    from listenlens.sources.fixtures import LIBRARY_SQL, oracle_ctes as _oc
    events = (f"(SELECT * FROM events WHERE ts >= TIMESTAMP '{PERIOD[0]}' "
              f"AND ts < TIMESTAMP '{PERIOD[1]}')")
    lib = LIBRARY_SQL.format(events=events, n_tracks="(SELECT count(*) FROM part)")
    return _oc("tracks").rstrip("\n") + f",\nlibrary AS ({lib})" + ENRICHED_CTE + D1_BODY


@register("listening_stats_period", _period_oracle())
def q_listening_stats_period(spark, sf_dir):
    """D1 over one recap period: the event-time bounds are pushed into the scan."""
    from listenlens.operators.enrich import cleaned_tracks, enrich_library
    v = Views(spark, sf_dir)
    return P.listening_stats(enrich_library(v.library_between(*PERIOD), cleaned_tracks(v)))
