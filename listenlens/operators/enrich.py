"""Cleaning and feature engineering (B1-B11, C1): the enriched library table.

``clean_tracks`` works on the track dimension (one row per track);
``enrich_library`` attaches track attributes to library rows and derives
time features.  Missing audio features are filled with the median of the
track dimension, computed once when the plan is built (one number a feature).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlens.functions import columns as C


def normalise_column_names(df: DataFrame) -> DataFrame:
    """strip / lower / ' ' -> '_' on headers; then the two odd names are renamed."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    rename = {"artist_name(s)": "artist_name", "duration_(ms)": "duration_ms"}
    return df.toDF(*[rename.get(n, n) for n in names])


def require_columns(df: DataFrame, required) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


_INTEGRAL = ("int", "bigint", "smallint", "tinyint")


def feature_medians(tracks: DataFrame, feats: list[str], exact: bool = True) -> dict[str, float | None]:
    """Median of each feature over all tracks: at most one number a feature.

    Exact medians come from value counts and their running totals in buckets
    (``distribution.quantiles``), so no task holds a whole column; otherwise from
    ``percentile_approx``.
    """
    if not feats:
        return {}
    wide = tracks.select(*[F.col(c).cast("double").alias(c) for c in feats])
    if not exact:
        r = wide.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in feats]).first()
        return r.asDict()
    from listenlens.operators.distribution import quantiles, value_counts
    found = quantiles(value_counts(tracks, [], feats), ["feature"], [0.5]).collect()
    return {r["feature"]: r["q"][0] for r in found}


def clean_tracks(tracks: DataFrame, median_fill: str | None = "exact") -> DataFrame:
    """Track dimension with parsed genres, release year, duration and filled features.

    median_fill: "exact" (value counts), "approx" (percentile_approx) or None.
    """
    cols = set(tracks.columns)
    out = tracks
    out = out.withColumn("genres_list", C.parse_genres("genres"))
    out = out.withColumn("primary_genre", C.primary_genre("genres_list"))
    out = out.withColumn("genre_count", F.size("genres_list"))
    if "release_date" in cols:
        out = out.withColumn("release_year", C.release_year("release_date"))
    if "duration_ms" in cols:
        out = out.withColumn("duration_min", F.col("duration_ms") / F.lit(60000.0))
    else:
        out = out.withColumn("duration_min", F.lit(C.DEFAULT_DURATION_MIN))
    if "explicit" in cols:
        out = out.withColumn("explicit", C.to_bool("explicit"))
    if median_fill:
        types = dict(tracks.dtypes)
        feats = [c for c in C.AUDIO_FEATURES if c in cols]
        meds = feature_medians(tracks, feats, exact=median_fill == "exact")
        fills = {}
        for c in feats:
            if meds.get(c) is not None:
                m = F.lit(meds[c])
                # integral features (key, mode, time_signature) keep their type
                fills[c] = F.coalesce(F.col(c), F.round(m).cast(types[c]) if types[c] in _INTEGRAL else m)
        out = out.withColumns(fills)
    return out


def audio_features(df: DataFrame) -> DataFrame:
    """The audio-feature columns present in ``df``."""
    return df.select(*[c for c in C.AUDIO_FEATURES if c in df.columns])


def enrich_library(library: DataFrame, tracks: DataFrame,
                   track_key: str = "track_id") -> DataFrame:
    """Library rows ⋈ cleaned tracks plus added_* time features.

    The join strategy is left to Spark: the planner broadcasts the track side only
    when its size estimate is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE
    re-checks with runtime sizes), otherwise it shuffles both sides; AQE splits
    skewed partitions.
    """
    df = library.join(tracks, track_key, "inner")
    ts = F.col("added_at")
    if dict(library.dtypes).get("added_at") == "string":
        df = df.withColumn("added_at", C.parse_timestamp("added_at"))
    df = df.withColumns({
        "added_hour": F.hour(ts),
        "added_day": F.weekday(ts),
        "added_month": F.month(ts),
        "added_year": F.year(ts),
        "added_date": F.to_date(ts),
    })
    return df.withColumns({
        "is_weekend": C.is_weekend("added_day"),
        "is_night": C.is_night("added_hour"),
    })


def cleaned_tracks(views, median_fill: str | None = "exact") -> DataFrame:
    """The cleaned track dimension of a fixture ``Views`` object (plan memoised)."""
    key = ("clean_tracks", median_fill)
    if key not in views.memo:
        views.memo[key] = clean_tracks(views.tracks, median_fill)
    return views.memo[key]


def enriched(views, median_fill: str | None = "exact") -> DataFrame:
    """The enriched library for a fixture ``Views`` object (plan memoised)."""
    key = ("enriched", median_fill)
    if key not in views.memo:
        views.memo[key] = enrich_library(views.library, cleaned_tracks(views, median_fill))
    return views.memo[key]
