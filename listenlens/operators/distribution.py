"""Distributions, summaries and correlations.

Per-feature statistics first ``unpivot`` the features and count equal values
(partial sums split a hot listener over its values); ranges, bins, quartiles and
moments are then taken from the counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlens.functions import columns as C
from listenlens.operators.common import as_keys, join_on_keys, materialize, top_k

# Radar baseline of the "average listener" and feature lists.
RADAR_BASELINE = {"energy": 0.55, "valence": 0.5, "danceability": 0.6, "acousticness": 0.3}
PROFILE_FEATURES = ["danceability", "energy", "speechiness", "acousticness",
                    "instrumentalness", "liveness", "valence", "tempo"]
HISTOGRAM_FEATURES = PROFILE_FEATURES
CORRELATION_FEATURES = ["energy", "valence", "danceability", "acousticness", "speechiness",
                        "instrumentalness", "liveness", "tempo", "loudness", "popularity"]
BOX_FEATURES = ["danceability", "energy", "speechiness", "acousticness", "instrumentalness",
                "liveness", "valence"]
MOODS = ["Happy & Energetic", "Angry & Intense", "Peaceful & Happy", "Sad & Calm"]


# most values of a group that one task ranks
FEW = 10_000


def _long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value) rows, nulls dropped."""
    cols = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return (cols.unpivot(keys or [], features, "feature", "value")
            .filter(F.col("value").isNotNull()))


def value_counts(df: DataFrame, keys=None, features=None) -> DataFrame:
    """(keys, feature, value, n): map-side sums spread a hot listener over its values."""
    keys = as_keys(keys)
    return (_long(df, keys, features or HISTOGRAM_FEATURES).groupBy(*keys, "feature", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def quantiles(counts: DataFrame, group: list[str], qs: list[float], buckets: int = 64, stored: bool = False,
              few: int = FEW) -> DataFrame:
    """Exact linear-interpolated quantiles of value counts: (group, q array, count).

    A group of at most ``few`` values is ranked as it is.  The values of a larger one are
    cut into buckets (``_bucket_quantiles``), so no task holds all of them; there is at
    most one such group for every ``few`` values.  ``stored``: the counts are written already.
    """
    counts = counts if stored else materialize(counts, "value-counts")
    large = materialize(counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_values")).filter(F.col("_values") > few)
                        .select(*group), "large-groups")
    if large.isEmpty():
        return _ranked_quantiles(counts, group, qs)
    return _ranked_quantiles(counts.join(large, group, "left_anti"), group, qs).unionByName(
        _bucket_quantiles(materialize(counts.join(large, group, "left_semi"), "large-counts"), group, qs, buckets))


def _wanted(qs: list[float]) -> list[Column]:
    """Ranks (from 0) below and above every quantile, of _all values."""
    return [f(F.lit(q) * (F.col("_all") - 1)) for q in qs for f in (F.floor, F.ceil)]


def _picked(ranked: DataFrame, group: list[str], qs: list[float]) -> DataFrame:
    """Quantiles from values that hold the ranks _lo to _lo + n - 1 of _all."""
    pick = lambda r: F.max(F.when((r >= F.col("_lo")) & (r < F.col("_lo") + F.col("n")), F.col("value")))
    out = ranked.groupBy(*group, "_all").agg(*[pick(r).alias(f"_v{i}") for i, r in enumerate(_wanted(qs))])
    rank = lambda q: F.lit(q) * (F.col("_all") - 1)
    value = lambda i, q: (F.col(f"_v{2 * i}") + (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}"))
                          * (rank(q) - F.floor(rank(q))))
    return out.select(*group, F.array(*[value(i, q) for i, q in enumerate(qs)]).alias("q"), F.col("_all").alias("count"))


def _ranked_quantiles(counts: DataFrame, group: list[str], qs: list[float]) -> DataFrame:
    every = Window.partitionBy(*group)
    before = every.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return _picked(counts.withColumns({"_lo": F.coalesce(F.sum("n").over(before), F.lit(0)), "_all": F.sum("n").over(every)}),
                   group, qs)


def _bucket_quantiles(counts: DataFrame, group: list[str], qs: list[float], buckets: int) -> DataFrame:
    """Values are cut into buckets at approximate bounds; bucket totals tell which buckets
    hold the wanted ranks, and only those are ranked, each on its own."""
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    # written once: approximate bounds must not change if a stage is run again
    bounds = materialize(counts.groupBy(*group).agg(F.percentile_approx("value", probs, 1000).alias("_bounds"),
                                                    F.sum("n").alias("_all")), "value-bounds")
    cut = counts.join(bounds, group).withColumn(
        "_b", F.size(F.filter("_bounds", lambda b: b < F.col("value")))).drop("_bounds")
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (cut.groupBy(*group, "_b", "_all").agg(F.sum("n").alias("_size"))
              .withColumn("_from", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_all"))
    inside = Window.partitionBy(*group, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    held = lambda r, lo, hi: (r >= lo) & (r < hi)
    some = F.lit(False)
    for r in _wanted(qs):
        some = some | held(r, F.col("_from"), F.col("_from") + F.col("_size"))
    ranked = (cut.join(totals, [*group, "_b"]).filter(some)
              .withColumn("_lo", F.col("_from") + F.coalesce(F.sum("n").over(inside), F.lit(0))))
    return _picked(ranked, group, qs)


def _counts_of(df: DataFrame, keys: list[str], features: list[str], counts: DataFrame | None) -> DataFrame:
    """Value counts of the features, of stored ``counts`` where given."""
    return value_counts(df, keys, features) if counts is None else counts.filter(F.col("feature").isin(features))


def describe_names(df: DataFrame) -> list[str]:
    return [c for c in (*C.AUDIO_FEATURES, "popularity", "duration_ms") if c in df.columns]


def mood_quadrants(df: DataFrame, keys=None) -> DataFrame:
    """Counts and share per energy/valence quadrant, with the dominant one flagged."""
    keys = as_keys(keys)
    counts = (df.withColumn("mood", C.mood_quadrant())
              .groupBy(*keys, "mood").agg(F.count(F.lit(1)).alias("tracks")))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return (counts.withColumn("percentage", F.col("tracks") / F.sum("tracks").over(w) * 100)
            .withColumn("is_dominant", F.row_number().over(
                w.orderBy(F.desc("tracks"), F.asc("mood"))) == 1))


def audio_profile(df: DataFrame, keys=None, features=None) -> DataFrame:
    """Mean per feature (long form) with the fixed radar baseline where defined."""
    keys = as_keys(keys)
    features = features or PROFILE_FEATURES
    means = df.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in features])
    base = F.create_map(*[x for k, v in RADAR_BASELINE.items() for x in (F.lit(k), F.lit(v))])
    return (means.unpivot(keys or [], features, "feature", "value")
            .withColumn("baseline", F.try_element_at(base, F.col("feature"))))


def histogram(df: DataFrame, keys=None, features=None, bins: int = 30, counts: DataFrame | None = None) -> DataFrame:
    """Equal-width bins between each group's min and max; max falls in the last bin.

    Output rows only for non-empty bins.  Range and bins are taken from value
    counts, so raw rows never meet on a listener's key.  ``counts``: value counts that are
    written already, of these features at least.
    """
    keys = as_keys(keys)
    g = [*keys, "feature"]
    counts = _counts_of(df, keys, features or HISTOGRAM_FEATURES, counts)
    rng = counts.groupBy(*g).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = (F.when(width == 0, F.lit(1))
         .otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / width * bins) + 1,
                            F.lit(bins))))
    binned = counts.join(rng, g).withColumn("bin", b.cast("int"))
    out = binned.groupBy(*g, "bin", "lo", "hi").agg(F.sum("n").alias("n"))
    return (out.withColumn("bin_start", F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins)
            .withColumn("bin_end", F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins)
            .drop("lo", "hi"))


QUARTILES = [0.25, 0.5, 0.75]


def quartiles(counts: DataFrame, keys=None) -> DataFrame:
    """(keys, feature, q): the quartiles of stored value counts."""
    g = [*as_keys(keys), "feature"]
    return quantiles(counts, g, QUARTILES, stored=True).select(*g, "q")


def describe(df: DataFrame, keys=None, features=None, counts: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per feature (long form).

    All from value counts; the deviation is taken around the mean in a second
    pass over the counts, which loses no digits to cancellation.  ``counts``, ``found``:
    value counts and ``quartiles`` that are written already, of these features at least.
    """
    keys = as_keys(keys)
    features = features or describe_names(df)
    g = [*keys, "feature"]
    # read by the sums, the quartiles and the spread: counted and written once
    counts = materialize(value_counts(df, keys, features), "value-counts") if counts is None else _counts_of(df, keys, features, counts)
    out = counts.groupBy(*g).agg(
        F.sum("n").alias("count"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = (quartiles(counts, keys) if found is None else found).withColumnRenamed("q", "_q")
    spread = (counts.join(out.select(*g, "mean"), g).groupBy(*g)
              .agg(F.sum((F.col("value") - F.col("mean")) ** 2 * F.col("n")).alias("_ss")))
    return (out.join(spread, g).join(q, g)
            .withColumns({"std": F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1))),
                          "p25": F.col("_q")[0], "p50": F.col("_q")[1], "p75": F.col("_q")[2]})
            .select(*g, "count", "mean", "std", "min", "max", "p25", "p50", "p75"))


def box_stats(df: DataFrame, keys=None, features=None, counts: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers (extreme points inside), outliers, min, max.
    ``counts``, ``found``: as in ``describe``."""
    keys = as_keys(keys)
    g = [*keys, "feature"]
    features = features or BOX_FEATURES
    counts = materialize(value_counts(df, keys, features), "value-counts") if counts is None else _counts_of(df, keys, features, counts)
    q = (quartiles(counts, keys) if found is None else found).select(
        *g, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "lower_fence": F.col("q1") - 1.5 * F.col("iqr"),
        "upper_fence": F.col("q3") + 1.5 * F.col("iqr")})
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    agg = counts.join(q, g).groupBy(*g, "q1", "median", "q3", "iqr", "lower_fence", "upper_fence").agg(
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return agg


def missing_report(df: DataFrame, keys=None, columns=None) -> DataFrame:
    """Null count and share (2 dp) per column, only columns with nulls, ranked
    by count descending."""
    keys = as_keys(keys)
    columns = columns or [c for c in df.columns if c not in keys]
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot([*keys, "_rows"], columns, "column", "missing")
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(
        F.desc("missing"), F.asc("column"))
    # "descending" made explicit: rank 1 = most nulls (at most one row per column)
    return (long.filter(F.col("missing") > 0)
            .withColumn("percentage", C.round_half_up(F.col("missing") / F.col("_rows") * 100, 2))
            .withColumn("rank", F.row_number().over(w))
            .drop("_rows"))


def correlations(df: DataFrame, keys=None, features=None) -> DataFrame:
    """Pearson r for every feature pair (pairwise-complete rows), long form."""
    keys = as_keys(keys)
    features = features or CORRELATION_FEATURES
    pairs = list(combinations(features, 2))
    names = [f"{a}__{b}" for a, b in pairs]
    wide = df.groupBy(*keys).agg(*[F.corr(a, b).alias(n) for (a, b), n in zip(pairs, names)])
    long = wide.unpivot(keys or [], names, "pair", "r")
    parts = F.split("pair", "__")
    return long.select(*keys, parts[0].alias("feature_a"), parts[1].alias("feature_b"), "r")


def _tag_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return (df.select(*keys, F.explode("genres_list").alias("genre"))
            .groupBy(*keys, "genre").agg(F.count(F.lit(1)).alias("n")))


def genre_tag_summary(df: DataFrame, keys=None) -> DataFrame:
    """Distinct tags and average tags per track."""
    keys = as_keys(keys)
    distinct_tags = _tag_counts(df, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_genres"))
    per_track = df.groupBy(*keys).agg(F.avg("genre_count").alias("avg_genres_per_track"))
    return (join_on_keys(per_track, distinct_tags, keys, "left")
            .withColumn("distinct_genres", F.coalesce("distinct_genres", F.lit(0))))


def genre_top_other(df: DataFrame, keys=None, top: int = 15) -> DataFrame:
    """The top ``top`` tags and one 'Other' bucket for all the rest."""
    keys = as_keys(keys)
    counts = _tag_counts(df, keys)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), F.asc("genre"))))
    labelled = ranked.withColumn("genre", F.when(F.col("rank") > top, F.lit("Other"))
                                 .otherwise(F.col("genre")))
    out = labelled.groupBy(*keys, "genre").agg(F.sum("n").alias("n"))
    return out.withColumn("percentage", F.col("n") / F.sum("n").over(w) * 100)


def bounded_sample(df: DataFrame, n: int, keys=None, id_col: str = "add_id",
                   seed: int = 42) -> DataFrame:
    """min(n, group size) rows per group, repeatable: smallest md5 of "id-seed"."""
    keys = as_keys(keys)
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    return top_k(df.withColumn("_h", h), keys, [F.asc("_h"), F.asc(id_col)], n).drop("_h")


def mood_scatter(df: DataFrame, keys=None, n: int = 500) -> DataFrame:
    """Sampled (energy, valence, danceability, mood, names) points per listener."""
    keys = as_keys(keys)
    s = bounded_sample(df, n, keys)
    return s.select(*keys, "add_id", "track_name", "artist_name", "energy", "valence",
                    "danceability", "popularity", C.mood_quadrant().alias("mood"))


# The feature pairs of the scatter matrix, and those drawn against popularity.
PAIR_FEATURES = ["energy", "valence", "danceability", "acousticness"]


def pair_points(df: DataFrame, keys=None, n: int = 500, features=None, against: str = "popularity") -> DataFrame:
    """The points of a scatter matrix, long form: every pair of ``features``, and each
    of them with ``against``, on min(n, group size) sampled rows (as in B18)."""
    keys = as_keys(keys)
    features = features or PAIR_FEATURES
    point = lambda a, b: F.struct(F.lit(a).alias("x_feature"), F.lit(b).alias("y_feature"),
                                  F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    pairs = [*combinations(features, 2), *[(f, against) for f in features]]
    return bounded_sample(df, n, keys).select(
        *keys, "add_id", C.mood_quadrant().alias("mood"), F.inline(F.array(*[point(a, b) for a, b in pairs])))
