"""Registered timeline queries (D4, D5, D9-D13, E1) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlens.operators import timeline as T
from listenlens.operators.enrich import enriched
from listenlens.plans.catalog import register, round_doubles
from listenlens.plans.sqltext import rq, with_enriched
from listenlens.sources.fixtures import Views


def _enriched(spark, sf_dir):
    return enriched(Views(spark, sf_dir))


_F5 = ["energy", "valence", "danceability", "tempo", "acousticness"]


@register("monthly_taste", with_enriched() + f"""
, t AS (SELECT *, strftime(added_at, '%Y-%m') AS year_month FROM enriched WHERE added_at IS NOT NULL),
m AS (SELECT user_id, year_month, {", ".join(f"avg({c}) AS {c}" for c in _F5)},
             count(track_uri) AS track_count FROM t GROUP BY user_id, year_month),
g AS (SELECT user_id, year_month, genre, count(*) AS n
      FROM (SELECT user_id, year_month, unnest(genres_list) AS genre FROM t)
      GROUP BY user_id, year_month, genre),
d AS (SELECT user_id, year_month, arg_min(genre, (-n, genre)) AS dominant_genre
      FROM g GROUP BY user_id, year_month)
SELECT m.user_id, m.year_month, {", ".join(f"{rq('m.' + c)} AS {c}" for c in _F5)}, m.track_count,
       coalesce(d.dominant_genre, 'unknown') AS dominant_genre
FROM m LEFT JOIN d ON m.user_id = d.user_id AND m.year_month = d.year_month
""")
def q_monthly_taste(spark, sf_dir):
    """D4 + D5 per listener-month."""
    return round_doubles(T.monthly_taste(_enriched(spark, sf_dir)))


@register("daily_timeline", with_enriched() + f"""
, d AS (SELECT user_id, added_date, count(*) AS tracks FROM enriched
        WHERE added_date IS NOT NULL GROUP BY user_id, added_date)
SELECT user_id, strftime(added_date, '%Y-%m-%d') AS added_date, tracks,
       {rq('avg(tracks) OVER (PARTITION BY user_id ORDER BY added_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')}
         AS rolling_avg
FROM d
""")
def q_daily_timeline(spark, sf_dir):
    """D9 + E1 per listener-day."""
    out = round_doubles(T.daily_timeline(_enriched(spark, sf_dir)))
    return out.withColumn("added_date", F.date_format("added_date", "yyyy-MM-dd"))


_HCOLS = ", ".join(f"CAST(count_if(added_hour = {h}) AS BIGINT) AS h{h:02d}" for h in range(24))
_HFILL = ", ".join(f"coalesce(c.h{h:02d}, 0) AS h{h:02d}" for h in range(24))


@register("hour_heatmap", with_enriched() + f"""
, t AS (SELECT * FROM enriched WHERE added_at IS NOT NULL),
c AS (SELECT user_id, added_day, {_HCOLS} FROM t GROUP BY user_id, added_day),
s AS (SELECT u.user_id, CAST(d.added_day AS INTEGER) AS added_day
      FROM (SELECT DISTINCT user_id FROM t) u, range(0, 7) d(added_day))
SELECT s.user_id, s.added_day, {_HFILL}
FROM s LEFT JOIN c ON s.user_id = c.user_id AND s.added_day = c.added_day
""")
def q_hour_heatmap(spark, sf_dir):
    """Full 7 x 24 grid per listener."""
    return T.hour_heatmap(_enriched(spark, sf_dir))


@register("monthly_counts", with_enriched() + """
SELECT user_id, strftime(added_at, '%Y-%m') AS year_month, count(*) AS tracks
FROM enriched WHERE added_at IS NOT NULL GROUP BY ALL
""")
def q_monthly_counts(spark, sf_dir):
    """D11."""
    return T.monthly_counts(_enriched(spark, sf_dir))


@register("release_years", with_enriched() + """
SELECT user_id, release_year, count(*) AS tracks
FROM enriched WHERE release_year >= 1980 GROUP BY ALL
""")
def q_release_years(spark, sf_dir):
    """D12 with the 1980 filter."""
    return T.release_years(_enriched(spark, sf_dir))


@register("weekend_split", with_enriched() + """
SELECT user_id, CAST(count_if(NOT is_weekend) AS BIGINT) AS weekday_tracks,
       CAST(count_if(is_weekend) AS BIGINT) AS weekend_tracks
FROM enriched GROUP BY user_id
""")
def q_weekend_split(spark, sf_dir):
    """D13."""
    return T.weekend_split(_enriched(spark, sf_dir))
