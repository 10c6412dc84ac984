"""Registered distribution queries (D14-D22, B18/B19) with oracles."""

from __future__ import annotations

from itertools import combinations


from listenlens.operators import distribution as D
from listenlens.operators.enrich import enriched
from listenlens.plans.catalog import register, round_doubles
from listenlens.plans.sqltext import oracle_ctes, rh, rq, with_enriched
from listenlens.sources.fixtures import Views


def _enriched(spark, sf_dir):
    return enriched(Views(spark, sf_dir))


_MOOD = ("CASE WHEN energy > 0.5 AND valence > 0.5 THEN 'Happy & Energetic' "
         "WHEN energy > 0.5 THEN 'Angry & Intense' WHEN valence > 0.5 THEN 'Peaceful & Happy' "
         "ELSE 'Sad & Calm' END")


@register("mood_quadrants", with_enriched() + f"""
, c AS (SELECT user_id, {_MOOD} AS mood, count(*) AS tracks FROM enriched GROUP BY ALL)
SELECT user_id, mood, tracks,
       {rq('tracks / sum(tracks) OVER (PARTITION BY user_id) * 100')} AS percentage,
       row_number() OVER (PARTITION BY user_id ORDER BY tracks DESC, mood) = 1 AS is_dominant
FROM c
""")
def q_mood_quadrants(spark, sf_dir):
    """D14."""
    return round_doubles(D.mood_quadrants(_enriched(spark, sf_dir)))


_PF = D.PROFILE_FEATURES
_BASE = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in D.RADAR_BASELINE.items())


@register("audio_profile", with_enriched() + f"""
, m AS (SELECT user_id, {", ".join(f"avg({f}) AS {f}" for f in _PF)} FROM enriched GROUP BY user_id),
u AS (UNPIVOT m ON {", ".join(_PF)} INTO NAME feature VALUE value)
SELECT user_id, feature, {rq('value')} AS value, CASE feature {_BASE} END AS baseline FROM u
""")
def q_audio_profile(spark, sf_dir):
    """D15."""
    return round_doubles(D.audio_profile(_enriched(spark, sf_dir)))


def _hist_sql(features, bins):
    return with_enriched() + f"""
, w AS (SELECT user_id, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in features)} FROM enriched),
l AS (SELECT * FROM (UNPIVOT w ON {", ".join(features)} INTO NAME feature VALUE value) WHERE value IS NOT NULL),
r AS (SELECT user_id, feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY ALL),
b AS (SELECT l.user_id, l.feature, lo, hi,
             CAST(CASE WHEN hi - lo = 0 THEN 1
                       ELSE least(floor((value - lo) / (hi - lo) * {bins}) + 1, {bins}) END AS INTEGER) AS bin
      FROM l JOIN r ON l.user_id = r.user_id AND l.feature = r.feature),
c AS (SELECT user_id, feature, bin, lo, hi, count(*) AS n FROM b GROUP BY ALL)
SELECT user_id, feature, bin, n, {rq(f'lo + (bin - 1) * (hi - lo) / {bins}')} AS bin_start,
       {rq(f'lo + bin * (hi - lo) / {bins}')} AS bin_end FROM c
"""


@register("feature_histograms", _hist_sql(D.HISTOGRAM_FEATURES, 30))
def q_feature_histograms(spark, sf_dir):
    """30-bin histograms of eight features per listener."""
    return round_doubles(D.histogram(_enriched(spark, sf_dir), bins=30))


@register("tempo_histogram", _hist_sql(["tempo"], 50))
def q_tempo_histogram(spark, sf_dir):
    """50-bin tempo histogram per listener."""
    return round_doubles(D.histogram(_enriched(spark, sf_dir), features=["tempo"], bins=50))


_AF = ["danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness",
       "instrumentalness", "liveness", "valence", "tempo", "time_signature", "popularity", "duration_ms"]


def _long_sql(features):
    return f"""
, w AS (SELECT user_id, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in features)} FROM enriched),
l AS (SELECT * FROM (UNPIVOT w ON {", ".join(features)} INTO NAME feature VALUE value) WHERE value IS NOT NULL)
"""


@register("describe_features", with_enriched() + _long_sql(_AF) + f"""
, d AS (SELECT user_id, feature, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std,
               min(value) AS min, quantile_cont(value, [0.25, 0.5, 0.75]) AS q, max(value) AS max
        FROM l GROUP BY ALL)
SELECT user_id, feature, count, {rq('mean')} AS mean, {rq('std')} AS std, min,
       {rq('q[1]')} AS p25, {rq('q[2]')} AS p50, {rq('q[3]')} AS p75, max FROM d
""")
def q_describe_features(spark, sf_dir):
    """D18."""
    return round_doubles(D.describe(_enriched(spark, sf_dir)))


@register("box_stats", with_enriched() + _long_sql(D.BOX_FEATURES) + f"""
, q AS (SELECT user_id, feature, quantile_cont(value, [0.25, 0.5, 0.75]) AS qs FROM l GROUP BY ALL),
q2 AS (SELECT user_id, feature, qs[1] AS q1, qs[2] AS median, qs[3] AS q3, qs[3] - qs[1] AS iqr FROM q),
q3 AS (SELECT *, q1 - 1.5 * iqr AS lower_fence, q3 + 1.5 * iqr AS upper_fence FROM q2),
j AS (SELECT l.value, q3.*, (l.value >= lower_fence AND l.value <= upper_fence) AS inside
      FROM l JOIN q3 ON l.user_id = q3.user_id AND l.feature = q3.feature)
SELECT user_id, feature, {rq('q1')} AS q1, {rq('median')} AS median, {rq('q3')} AS q3, {rq('iqr')} AS iqr,
       {rq('lower_fence')} AS lower_fence, {rq('upper_fence')} AS upper_fence,
       min(CASE WHEN inside THEN value END) AS lower_whisker,
       max(CASE WHEN inside THEN value END) AS upper_whisker,
       CAST(count_if(NOT inside) AS BIGINT) AS outliers, min(value) AS min, max(value) AS max
FROM j GROUP BY user_id, feature, q1, median, q3, iqr, lower_fence, upper_fence
""")
def q_box_stats(spark, sf_dir):
    """D17."""
    return round_doubles(D.box_stats(_enriched(spark, sf_dir)))


_RAW_COLS = ["track_uri", "track_name", "artist_name", "album_name", "genres", "release_date",
             "added_at", "explicit", *_AF]


@register("missing_report", oracle_ctes("tracks", "library") + f"""
, j AS (SELECT l.user_id, l.added_at, t.* EXCLUDE (track_id) FROM library l JOIN tracks t ON l.track_id = t.track_id),
c AS (SELECT user_id, count(*) AS _rows, {", ".join(f"count_if({c} IS NULL) AS {c}" for c in _RAW_COLS)}
      FROM j GROUP BY user_id),
u AS (UNPIVOT c ON {", ".join(_RAW_COLS)} INTO NAME "column" VALUE missing)
SELECT user_id, "column", CAST(missing AS BIGINT) AS missing,
       {rh('missing / _rows * 100', 2)} AS percentage,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY missing DESC, "column") AS INTEGER) AS rank
FROM u WHERE missing > 0
""")
def q_missing_report(spark, sf_dir):
    """D19 on library rows joined with the raw (uncleaned) track attributes."""
    v = Views(spark, sf_dir)
    raw = v.library.join(v.tracks, "track_id")
    return D.missing_report(raw.select("user_id", *_RAW_COLS))


_CF = D.CORRELATION_FEATURES
_PAIRS = list(combinations(_CF, 2))


@register("feature_correlations", with_enriched() + f"""
, w AS (SELECT user_id, {", ".join(f"corr({a}, {b}) AS {a}__{b}" for a, b in _PAIRS)} FROM enriched GROUP BY user_id),
u AS (FROM w UNPIVOT INCLUDE NULLS (r FOR pair IN ({", ".join(f"{a}__{b}" for a, b in _PAIRS)})))
SELECT user_id, split_part(pair, '__', 1) AS feature_a, split_part(pair, '__', 2) AS feature_b,
       {rq('r')} AS r FROM u
""")
def q_feature_correlations(spark, sf_dir):
    """Pearson r of 9 features, 36 pairs per listener."""
    return round_doubles(D.correlations(_enriched(spark, sf_dir)))


@register("genre_tag_summary", with_enriched() + f"""
, t AS (SELECT user_id, count(DISTINCT genre) AS distinct_genres
        FROM (SELECT user_id, unnest(genres_list) AS genre FROM enriched) GROUP BY user_id),
p AS (SELECT user_id, avg(genre_count) AS avg_genres_per_track FROM enriched GROUP BY user_id)
SELECT p.user_id, {rq('avg_genres_per_track')} AS avg_genres_per_track,
       coalesce(t.distinct_genres, 0) AS distinct_genres
FROM p LEFT JOIN t ON p.user_id = t.user_id
""")
def q_genre_tag_summary(spark, sf_dir):
    """D21."""
    return round_doubles(D.genre_tag_summary(_enriched(spark, sf_dir)))


@register("genre_top15_other", with_enriched() + f"""
, c AS (SELECT user_id, genre, count(*) AS n
        FROM (SELECT user_id, unnest(genres_list) AS genre FROM enriched) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS rank FROM c),
g AS (SELECT user_id, CASE WHEN rank > 15 THEN 'Other' ELSE genre END AS genre, sum(n) AS n
      FROM r GROUP BY ALL)
SELECT user_id, genre, CAST(n AS BIGINT) AS n,
       {rq('n / sum(n) OVER (PARTITION BY user_id) * 100')} AS percentage FROM g
""")
def q_genre_top15_other(spark, sf_dir):
    """D22."""
    return round_doubles(D.genre_top_other(_enriched(spark, sf_dir)))


_POINTS = ("track_name, artist_name, energy, valence, danceability, popularity, " + _MOOD + " AS mood")


@register("mood_scatter_sample", with_enriched() + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(add_id || '-42'), add_id) AS rank FROM enriched)
SELECT user_id, add_id, {_POINTS} FROM r WHERE rank <= 25
""")
def q_mood_scatter_sample(spark, sf_dir):
    """B18 + B19: 25 hash-sampled points per listener, fewer than most have."""
    return D.mood_scatter(_enriched(spark, sf_dir), n=25)


@register("mood_scatter_all", with_enriched() + f"""
SELECT add_id, {_POINTS} FROM enriched ORDER BY md5(add_id || '-42'), add_id LIMIT 500
""")
def q_mood_scatter_all(spark, sf_dir):
    """B18 + B19 on the whole frame: the reference's 500 sampled points."""
    return D.mood_scatter(_enriched(spark, sf_dir), keys=[], n=500)


_PAIRS = [*combinations(D.PAIR_FEATURES, 2), *[(f, "popularity") for f in D.PAIR_FEATURES]]


@register("feature_pair_points", with_enriched() + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(add_id || '-42'), add_id) AS rank FROM enriched),
s AS (SELECT *, {_MOOD} AS mood FROM r WHERE rank <= 25)
""" + "\nUNION ALL ".join(f"""SELECT user_id, add_id, mood, '{a}' AS x_feature, '{b}' AS y_feature,
  CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM s""" for a, b in _PAIRS))
def q_feature_pair_points(spark, sf_dir):
    """Scatter matrix and popularity points of 25 sampled rows per listener."""
    return D.pair_points(_enriched(spark, sf_dir), n=25)
