"""Per-listener profile aggregates.

Each function scans the enriched library once per aggregate family and
groups by ``keys``.  Spark plans every ``groupBy`` as partial + final hash
aggregation, so a listener holding a large share of rows is pre-reduced on
the map side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlens.functions import columns as C
from listenlens.operators.common import as_keys, join_on_keys, top_k


def _ratio(c):
    return F.avg(F.col(c).cast("double"))


def _distinct(c: str, approx: bool):
    return F.approx_count_distinct(c, 0.01) if approx else F.count_distinct(c)


def listening_stats(df: DataFrame, keys=None, approx_distinct: bool = False) -> DataFrame:
    """Counts, hours, date range, explicit share, popularity per key group.

    ``approx_distinct`` swaps the exact distinct counts (an Expand + two-level
    aggregation) for HyperLogLog++ sketches at 1% relative error.
    """
    return df.groupBy(*as_keys(keys)).agg(*_listening_measures(df, approx_distinct))


def _listening_measures(df: DataFrame, approx_distinct: bool) -> list[Column]:
    has_ms = "duration_ms" in df.columns
    total_ms = (F.sum("duration_ms") if has_ms
                else F.count(F.lit(1)) * F.lit(C.DEFAULT_DURATION_MIN * 60000))
    return [
        F.count(F.lit(1)).alias("total_tracks"),
        _distinct("artist_name", approx_distinct).alias("total_artists"),
        _distinct("album_name", approx_distinct).alias("total_albums"),
        C.round_half_up(total_ms / F.lit(3600000.0), 1).alias("total_hours"),
        C.round_half_up(total_ms / F.lit(60000.0), 0).alias("total_minutes"),
        C.round_half_up(F.avg("duration_min"), 2).alias("avg_track_duration_min"),
        F.coalesce(F.date_format(F.min("added_at"), "yyyy-MM-dd"), F.lit("N/A")).alias("date_range_start"),
        F.coalesce(F.date_format(F.max("added_at"), "yyyy-MM-dd"), F.lit("N/A")).alias("date_range_end"),
        F.count_if(F.col("explicit")).alias("explicit_tracks"),
        C.round_half_up(_ratio("explicit") * 100, 1).alias("explicit_percentage"),
        C.round_half_up(F.avg("popularity"), 1).alias("avg_popularity"),
    ]


def listening_stats_both_grains(df: DataFrame, key: str = "user_id", approx_distinct: bool = False) -> DataFrame:
    """All D1 measures per listener and overall in one pass (grouping sets).

    ``grain`` is 'user' or 'all'; the overall row carries key -1 (a non-null key
    keeps the column's integer type through every consumer).
    """
    return (df.groupingSets([[key], []], key).agg(
        F.grouping_id().alias("_gid"), *_listening_measures(df, approx_distinct),
    ).withColumn("grain", F.when(F.col("_gid") == 0, "user").otherwise("all"))
     .withColumn(key, F.when(F.col("_gid") == 0, F.col(key)).otherwise(F.lit(-1).cast("long")))
     .drop("_gid"))


def _genre_tag_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, genre, n): one row per tag occurrence, pre-aggregated."""
    return (df.select(*keys, F.explode("genres_list").alias("genre"))
            .groupBy(*keys, "genre").agg(F.count(F.lit(1)).alias("n")))


def _modal(value_col: str, count_col: str = "n"):
    """Most frequent value; ties go to the smallest value (deterministic)."""
    return F.min_by(F.col(value_col), F.struct(-F.col(count_col), F.col(value_col)))


def user_features(df: DataFrame, keys=None, with_valence_variance: bool = False) -> DataFrame:
    """D2 (D2a-D2d): audio averages, genre metrics, ratios, repeat-artist ratio."""
    keys = as_keys(keys)
    feats = [c for c in C.AUDIO_FEATURES if c in df.columns]
    base_aggs = [F.avg(c).alias(f"avg_{c}") for c in feats] + [
        _ratio("is_night").alias("night_listener_ratio"),
        _ratio("is_weekend").alias("weekend_ratio"),
        _ratio("explicit").alias("explicit_ratio"),
        F.count(F.lit(1)).alias("total_tracks"),
        F.avg("popularity").alias("avg_popularity"),
        F.avg("duration_min").alias("avg_duration_min"),
    ]
    if with_valence_variance:
        base_aggs.append(F.var_samp("valence").alias("valence_variance"))
    base = df.groupBy(*keys).agg(*base_aggs)

    tags = _genre_tag_counts(df, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_genres"),
        F.sum("n").alias("_tags"),
        _modal("genre").alias("top_genre"),
        F.max("n").alias("_top_n"),
    )
    artists = (df.filter(F.col("artist_name").isNotNull())
               .groupBy(*keys, "artist_name").agg(F.count(F.lit(1)).alias("n"))
               .groupBy(*keys).agg(
                   F.count(F.lit(1)).alias("total_artists"),
                   F.count_if(F.col("n") > 1).alias("_repeat")))

    out = join_on_keys(join_on_keys(base, tags, keys, "left"), artists, keys, "left")
    return out.select(
        *keys, *[f"avg_{c}" for c in feats],
        F.coalesce(F.col("total_genres"), F.lit(0)).alias("total_genres"),
        F.coalesce(F.try_divide("total_genres", "_tags"), F.lit(0.0)).alias("genre_diversity"),
        F.coalesce(F.col("top_genre"), F.lit("unknown")).alias("top_genre"),
        F.coalesce(F.try_divide("_top_n", "_tags") * 100, F.lit(0.0)).alias("top_genre_percentage"),
        "night_listener_ratio", "weekend_ratio",
        F.coalesce(F.try_divide("_repeat", "total_artists"), F.lit(0.0)).alias("repeat_artist_ratio"),
        "explicit_ratio", "total_tracks",
        F.coalesce(F.col("total_artists"), F.lit(0)).alias("total_artists"),
        "avg_popularity", "avg_duration_min",
        *(["valence_variance"] if with_valence_variance else []),
    )


def genre_distribution(df: DataFrame, keys=None, top: int | None = 20) -> DataFrame:
    """D3: share (%) of all genre tags, top ``top`` per key group (ties by name)."""
    keys = as_keys(keys)
    counts = _genre_tag_counts(df, keys)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    out = join_on_keys(counts, totals, keys).withColumn(
        "percentage", F.col("n") / F.col("_total") * 100).drop("_total")
    if top is None:
        return out
    return top_k(out, keys, [F.desc("n"), F.asc("genre")], top)


def top_artists(df: DataFrame, keys=None, n: int = 10, detail: bool = False) -> DataFrame:
    """Track count and average popularity/energy/valence per artist, top n."""
    keys = as_keys(keys)
    aggs = [F.count(F.lit(1)).alias("track_count"),
            F.avg("popularity").alias("avg_popularity"),
            F.avg("energy").alias("avg_energy"),
            F.avg("valence").alias("avg_valence")]
    if detail:
        aggs.append(F.avg("danceability").alias("avg_danceability"))
    per_artist = (df.filter(F.col("artist_name").isNotNull())
                  .groupBy(*keys, "artist_name").agg(*aggs))
    if detail:
        per_artist = per_artist.withColumns({
            c: C.round_half_up(c, 2) for c in
            ["avg_popularity", "avg_energy", "avg_valence", "avg_danceability"]})
    return top_k(per_artist, keys, [F.desc("track_count"), F.asc("artist_name")], n)


TOP_TRACK_COLUMNS = ["track_name", "artist_name", "album_name", "popularity", "energy",
                     "valence", "danceability", "primary_genre"]


def top_tracks(df: DataFrame, keys=None, n: int = 10) -> DataFrame:
    """top n library rows by popularity (ties by track id, then add id)."""
    keys = as_keys(keys)
    order = [F.desc("popularity"), F.asc("track_id")]
    if "add_id" in df.columns:
        order.append(F.asc("add_id"))
    cols = [c for c in TOP_TRACK_COLUMNS if c in df.columns]
    extra = [c for c in ("track_id", "add_id") if c in df.columns]
    return top_k(df.select(*keys, *extra, *cols), keys, order, n)


def recap_stats(df: DataFrame, keys=None) -> DataFrame:
    """Count, average energy/valence/tempo, most common key, explicit %."""
    keys = as_keys(keys)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tracks"),
        F.avg("energy").alias("avg_energy"),
        F.avg("valence").alias("avg_valence"),
        F.avg("tempo").alias("avg_tempo"),
        F.expr("mode() WITHIN GROUP (ORDER BY key)").alias("most_common_key"),
        (F.count_if(F.col("explicit")) / F.count(F.lit(1)) * 100).alias("explicit_percentage"),
    )


def stats_summary(df: DataFrame, keys=None) -> DataFrame:
    """D1 ∪ D2 in one row per key group (D2 names win on overlap)."""
    keys = as_keys(keys)
    d1 = listening_stats(df, keys).drop("total_tracks", "total_artists", "avg_popularity")
    d2 = user_features(df, keys)
    return join_on_keys(d1, d2, keys)


def profile_summary(df: DataFrame, keys=None) -> DataFrame:
    """D25 with its top artist and dominant mood: one row per key group.

    The dominant mood is the most frequent energy/valence quadrant (ties by name); a
    group without artist names has a null top artist and a count of 0.
    """
    keys = as_keys(keys)
    artist = top_artists(df, keys, n=1).select(
        *keys, F.col("artist_name").alias("top_artist"), F.col("track_count").alias("top_artist_tracks"))
    mood = (df.groupBy(*keys, C.mood_quadrant().alias("mood")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy(*keys).agg(_modal("mood").alias("dominant_mood"), F.max("n").alias("_n"), F.sum("n").alias("_all"))
            .withColumn("dominant_mood_percentage", F.col("_n") / F.col("_all") * 100).drop("_n", "_all"))
    out = join_on_keys(stats_summary(df, keys), mood, keys)
    return join_on_keys(out, artist, keys, "left").withColumn("top_artist_tracks", F.coalesce("top_artist_tracks", F.lit(0)))


def top_artist_card(df: DataFrame, keys=None) -> DataFrame:
    """The first artist of each key group as shown on a card: name in capitals, track
    count, and the line with the first word of the name.  A name without a word
    gives an empty first word."""
    first = F.regexp_extract("artist_name", r"\S+", 0)
    return top_artists(df, keys, n=1).select(
        *as_keys(keys), F.upper("artist_name").alias("headline"), "track_count",
        F.concat(F.lit("You were in your "), first, F.lit(" era ✨")).alias("fun_text"))
