"""Composite per-listener reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlens.operators import personality as PE
from listenlens.operators import profile as P
from listenlens.operators import timeline as T


def _nested(df: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """Rows of one per-listener table folded into an ordered array of structs.

    Each input here is bounded per listener (top-k lists, months, metrics)."""
    cols = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order])))
                                .alias(name)))


def recap(enriched_lib: DataFrame, key: str = "user_id", top: int = 5, mood_model=None, genre_probs: DataFrame | None = None,
          taste=None, candidates: DataFrame | None = None, n_recommendations: int = 10) -> DataFrame:
    """One nested row per listener: listening and recap stats, features, top artists
    and genres, monthly taste, personality, comparisons and insights; given a mood
    model the mood profile, given (track_id, genre, p) rows the genre profile, given a
    taste model the taste profile with the most similar listeners, and given candidate
    tracks (with moods and genres) the recommendations.  A listener without rows in a
    section has null there."""
    from listenlens.operators.common import materialize
    keys = [key]
    # nine branches read the enriched library: write it once (the track join and
    # the derivations then run once), and the per-listener features once
    enriched_lib = materialize(enriched_lib, "recap-library")
    stats = P.listening_stats(enriched_lib, keys)
    feats = materialize(P.user_features(enriched_lib, keys), "recap-features")
    pcts = PE.percentiles(feats, keys=keys)
    types = PE.classify(feats, keys)
    artists = P.top_artists(enriched_lib, keys, n=top).select(key, "rank", "artist_name", "track_count")
    genres = P.genre_distribution(enriched_lib, keys, top=top).select(key, "rank", "genre", "percentage")
    monthly = T.monthly_taste(enriched_lib, keys)
    comps = PE.comparison_stats(feats, keys=keys)
    ins = PE.insights(pcts, keys)
    block = P.recap_stats(enriched_lib, keys)
    row = (stats.select(key, _section(stats, key, "stats"))
           .join(feats.select(key, _section(feats, key, "features")), key)
           .join(block.select(key, _section(block, key, "recap_stats")), key)
           .join(types.select(key, F.struct("type_id", "type_name", "emoji", "description", "traits",
                                            "confidence").alias("personality")), key)
           .join(_nested(artists, key, "top_artists", ["rank"]), key, "left")
           .join(_nested(genres, key, "top_genres", ["rank"]), key, "left")
           .join(_nested(monthly, key, "monthly", ["year_month"]), key, "left")
           .join(_nested(comps, key, "comparisons", ["metric_no"]), key, "left")
           .join(_nested(ins, key, "insights", ["insight_no"]), key, "left"))
    if mood_model is not None:
        from listenlens.operators.mood import mood_profile
        mood = mood_profile(mood_model, enriched_lib, keys)
        row = row.join(mood.select(key, _section(mood, key, "mood_profile")), key, "left")
    if genre_probs is not None:
        from listenlens.operators.genre import weighted_genre_vector
        vector = weighted_genre_vector(enriched_lib, genre_probs, keys)
        # the whole distribution: at most one entry per genre of the model
        dist = vector.groupBy(key).agg(F.sort_array(F.collect_list(
            F.struct((-F.col("score")).alias("_n"), "genre", "score"))).alias("_d"))
        dist = dist.select(key, F.transform("_d", lambda x: F.struct(x["genre"].alias("genre"), x["score"].alias("score")))
                           .alias("genre_distribution"))
        row = row.join(dist.select(key, F.struct(
            F.slice("genre_distribution.genre", 1, 10).alias("top_genres"), "genre_distribution")
            .alias("genre_profile")), key, "left")
    if taste is not None:
        from listenlens.operators.taste import listener_profiles
        prof = listener_profiles(taste).withColumnRenamed("user_id", key)
        row = row.join(prof.select(key, _section(prof, key, "taste_profile")), key, "left")
    if candidates is not None:
        from listenlens.operators.recommend import recommend
        lib = enriched_lib if key == "user_id" else enriched_lib.withColumnRenamed(key, "user_id")
        recs = recommend(lib, candidates, mood_model, genre_probs, taste=taste,
                         n=n_recommendations).withColumnRenamed("user_id", key)
        row = row.join(_nested(recs, key, "recommendations", ["rank"]), key, "left")
    return row


def _section(df: DataFrame, key: str, name: str) -> Column:
    return F.struct(*[c for c in df.columns if c != key]).alias(name)


def full_report(enriched_lib: DataFrame, folder: str, key: str = "user_id") -> DataFrame:
    """A8 as a production run: every per-listener result table of the run, written
    one folder each under ``folder``.

    The enriched library is materialised once (one pass of the track join and the
    derivations); each aggregate then scans that table with column pruning.
    Returns a manifest (table, path, rows); the writes count their rows themselves.
    """
    from listenlens.operators import distribution as D
    from listenlens.operators.common import materialize
    from listenlens.sources.ingest import write_counted
    keys = [key]
    lib = materialize(enriched_lib, "report-library")
    feats = materialize(P.user_features(lib, keys), "report-features")
    # histograms, box plots and descriptions all read the value counts: counted once
    names = list(dict.fromkeys([*D.describe_names(lib), *D.HISTOGRAM_FEATURES, *D.BOX_FEATURES]))
    counts = materialize(D.value_counts(lib, keys, names), "report-counts")
    found = materialize(D.quartiles(counts, keys), "report-quartiles")
    tables = {
        "listening_stats": P.listening_stats(lib, keys),
        "user_features": feats,
        "genre_distribution": P.genre_distribution(lib, keys),
        "top_artists": P.top_artists(lib, keys),
        "top_tracks": P.top_tracks(lib, keys),
        "recap_stats": P.recap_stats(lib, keys),
        "monthly_taste": T.monthly_taste(lib, keys),
        "daily_timeline": T.daily_timeline(lib, keys),
        "hour_heatmap": T.hour_heatmap(lib, keys),
        "release_years": T.release_years(lib, keys),
        "weekend_split": T.weekend_split(lib, keys),
        "mood_quadrants": D.mood_quadrants(lib, keys),
        "audio_profile": D.audio_profile(lib, keys),
        "feature_histograms": D.histogram(lib, keys, counts=counts),
        "tempo_histogram": D.histogram(lib, keys, features=["tempo"], bins=50, counts=counts),
        "box_stats": D.box_stats(lib, keys, counts=counts, found=found),
        "mood_scatter": D.mood_scatter(lib, keys),
        "artist_detail": P.top_artists(lib, keys, detail=True),
        "missing_report": D.missing_report(lib, keys),
        "profile_summary": P.profile_summary(lib, keys),
        "describe_features": D.describe(lib, keys, counts=counts, found=found),
        "feature_correlations": D.correlations(lib, keys),
        "genre_top15_other": D.genre_top_other(lib, keys),
        "percentiles": PE.percentiles(feats, keys=keys),
        "personality": PE.classify(feats, keys),
        "comparison_stats": PE.comparison_stats(feats, keys=keys),
        "listening_insights": PE.insights(PE.percentiles(feats, keys=keys), keys),
    }
    rows = [(name, path, n) for name, (path, n) in write_counted(tables, folder).items()]
    return enriched_lib.sparkSession.createDataFrame(rows, "table string, path string, rows long")
