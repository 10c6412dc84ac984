"""Registered model-backed queries.

Trained models cannot be reproduced in SQL; their queries get the rows-only
check.  The parts that are pure aggregation or arithmetic (I3, I15, I22,
I23, B16) also run on model-free inputs and have SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlens.functions import columns as C
from listenlens.operators import genre as G
from listenlens.operators import mood as M
from listenlens.operators import personality as PE
from listenlens.operators import profile as P
from listenlens.operators import recommend as R
from listenlens.operators import taste as TA
from listenlens.operators import training as TR
from listenlens.operators.common import materialize
from listenlens.operators.enrich import cleaned_tracks, enriched
from listenlens.operators.forest import NODES
from listenlens.plans.catalog import register, round_doubles
from listenlens.plans.q_personality import TYPES_CTE
from listenlens.plans.q_profile import D2_CTES
from listenlens.plans.q_taste import WEIGHT_SQL
from listenlens.plans.sqltext import rq, with_enriched
from listenlens.session import scratch_path
from listenlens.sources.fixtures import Views

# Model settings of the registered queries: the reference's values.
MOOD_K = 4
ALS_RANK, ALS_ITER, ALS_REG = 50, 15, 0.01
RF_TREES, RF_DEPTH = 100, 15

_MODELS: dict = {}


def _ctx(spark, sf_dir):
    v = Views(spark, sf_dir)
    return v, cleaned_tracks(v), enriched(v)


def _cached(kind, spark, sf_dir, build):
    app = spark.sparkContext.applicationId
    for old in [k for k in _MODELS if k[1] != app]:  # models of sessions that ended
        del _MODELS[old]
    key = (kind, app, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def mood_model(spark, sf_dir):
    _, tracks, _ = _ctx(spark, sf_dir)
    return _cached("mood", spark, sf_dir, lambda: M.fit_mood(tracks, k=MOOD_K))


def genre_model(spark, sf_dir):
    _, tracks, _ = _ctx(spark, sf_dir)
    return _cached("genre", spark, sf_dir,
                   lambda: G.fit_genre(tracks, RF_TREES, RF_DEPTH))


def taste_model(spark, sf_dir):
    v = Views(spark, sf_dir)
    return _cached("taste", spark, sf_dir, lambda: TA.train_taste(
        TA.interaction_matrix(v.interactions), ALS_RANK, ALS_ITER, ALS_REG))


# ---------------------------------------------------------------------------
# mood
# ---------------------------------------------------------------------------
@register("mood_label_rule", with_enriched() + f"""
, a AS (SELECT user_id, avg(energy) AS e, avg(valence) AS v, avg(danceability) AS d,
               avg(acousticness) AS ac FROM enriched GROUP BY user_id)
SELECT user_id, {rq('e')} AS avg_energy, {rq('v')} AS avg_valence,
       CASE WHEN e > 0.7 AND v > 0.6 THEN 'high_energy_happy'
            WHEN e < 0.4 AND v < 0.4 THEN 'sad_melancholic'
            WHEN ac > 0.6 THEN 'acoustic_folk'
            WHEN d > 0.7 THEN 'upbeat_dance'
            WHEN e > 0.6 AND v < 0.4 THEN 'dark_intense'
            ELSE 'chill_mellow' END AS label
FROM a
""")
def q_mood_label_rule(spark, sf_dir):
    """The cluster-label rule applied to each listener's average features."""
    _, _, lib = _ctx(spark, sf_dir)
    a = lib.groupBy("user_id").agg(*[F.avg(c).alias(c) for c in
                                     ("energy", "valence", "danceability", "acousticness")])
    out = a.select("user_id", F.col("energy").alias("avg_energy"), F.col("valence").alias("avg_valence"),
                   C.cluster_label("energy", "valence", "danceability", "acousticness").alias("label"))
    return round_doubles(out)


@register("mood_clusters")
def q_mood_clusters(spark, sf_dir):
    """I1 + I2: K-Means profiles (size, raw means, label) over the track dimension."""
    return mood_model(spark, sf_dir).profiles


@register("mood_distribution")
def q_mood_distribution(spark, sf_dir):
    """I4 + I5: weighted mood shares per listener, ranked."""
    _, _, lib = _ctx(spark, sf_dir)
    return M.dominant_mood(M.mood_distribution(mood_model(spark, sf_dir), lib))


@register("mood_insights")
def q_mood_insights(spark, sf_dir):
    """I6."""
    _, _, lib = _ctx(spark, sf_dir)
    return M.mood_insights(mood_model(spark, sf_dir), lib)


@register("mood_pca")
def q_mood_pca(spark, sf_dir):
    """2-D PCA points of every track with its cluster."""
    _, tracks, _ = _ctx(spark, sf_dir)
    return M.pca_points(mood_model(spark, sf_dir), tracks)


@register("user_type_clusters")
def q_user_type_clusters(spark, sf_dir):
    """6-cluster K-Means over the per-listener feature table."""
    _, _, lib = _ctx(spark, sf_dir)
    _, out = PE.fit_user_type_clusters(P.user_features(lib))
    return out.select("user_id", "cluster")


# ---------------------------------------------------------------------------
# genre
# ---------------------------------------------------------------------------
@register("genre_probabilities")
def q_genre_probabilities(spark, sf_dir):
    """I13 + I14: P(genre) of every track and genre from the shared forest (absent: 0)."""
    _, tracks, _ = _ctx(spark, sf_dir)
    return genre_model(spark, sf_dir).predict(tracks)


@register("genre_top_predicted")
def q_genre_top_predicted(spark, sf_dir):
    """I15 on model probabilities: top 5 genres per listener."""
    _, tracks, lib = _ctx(spark, sf_dir)
    return G.top_genres(lib, genre_model(spark, sf_dir).predict(tracks), n=5)


@register("genre_hamming_loss")
def q_genre_hamming_loss(spark, sf_dir):
    """Hamming loss of every track, judged by the trees grown without its fold."""
    _, tracks, _ = _ctx(spark, sf_dir)
    return G.out_of_fold_loss(genre_model(spark, sf_dir), tracks)


# fixed trees (feature number, threshold, left, right; feature -1 is a leaf), to hold the
# counting and scoring of leaves against SQL
FIXED_TREES = [
    [(0, 0.5, 1, 2), (1, 0.4, 3, 4), (-1, 0.0, -1, -1), (-1, 0.0, -1, -1), (-1, 0.0, -1, -1)],
    [(3, 0.6, 1, 2), (-1, 0.0, -1, -1), (2, 0.7, 3, 4), (-1, 0.0, -1, -1), (-1, 0.0, -1, -1)],
    [(-1, 0.0, -1, -1)],
]
_FIXED_LEAVES = """
, m AS (SELECT avg(energy) AS e, avg(valence) AS v, avg(danceability) AS d, avg(tempo) AS t FROM clean_tracks2),
x AS (SELECT track_id, coalesce(energy, m.e) AS e, coalesce(valence, m.v) AS v, coalesce(danceability, m.d) AS d,
             coalesce(tempo, m.t) / 200.0 AS t FROM clean_tracks2, m),
leaf AS (SELECT track_id, 0 AS tree, CASE WHEN e > 0.5 THEN 2 WHEN v <= 0.4 THEN 3 ELSE 4 END AS leaf FROM x
         UNION ALL SELECT track_id, 1, CASE WHEN t <= 0.6 THEN 1 WHEN d <= 0.7 THEN 3 ELSE 4 END FROM x
         UNION ALL SELECT track_id, 2, 0 FROM x),
size AS (SELECT tree, leaf, count(*) AS n FROM leaf GROUP BY ALL),
tags AS (SELECT DISTINCT track_id, unnest(genres_list) AS genre FROM clean_tracks2),
share AS (SELECT tree, leaf, genre, count(*) / any_value(n) AS p FROM leaf JOIN tags USING (track_id) JOIN size USING (tree, leaf)
          GROUP BY tree, leaf, genre),
"""


@register("genre_fixed_forest", with_enriched() + _FIXED_LEAVES.rstrip().rstrip(",") + f"""
SELECT track_id, genre, {rq('sum(p) / 3.0')} AS p FROM leaf JOIN share USING (tree, leaf) GROUP BY track_id, genre
""")
def q_genre_fixed_forest(spark, sf_dir):
    """I14 with given trees: leaf shares counted over all tracks, every track scored."""
    _, tracks, _ = _ctx(spark, sf_dir)
    nodes = spark.createDataFrame([(t, -1, i, *n) for t, tree in enumerate(FIXED_TREES) for i, n in enumerate(tree)], NODES)
    return round_doubles(G.counted(G.prepare(tracks), nodes, tracks, 1).predict(tracks))


_TAGS = """
, tags AS (SELECT DISTINCT track_id, unnest(genres_list) AS genre FROM clean_tracks2),
tot AS (SELECT user_id, count(*) AS tw FROM enriched GROUP BY user_id),
num AS (SELECT e.user_id, t.genre, count(*) AS s FROM enriched e JOIN tags t ON e.track_id = t.track_id GROUP BY ALL),
gv AS (SELECT num.user_id, genre, s / tw AS score FROM num JOIN tot ON num.user_id = tot.user_id)
"""


@register("weighted_genre_tags", with_enriched() + _TAGS + f"""
SELECT user_id, genre, {rq('score')} AS score,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, genre) AS INTEGER) AS rank
FROM gv
""")
def q_weighted_genre_tags(spark, sf_dir):
    """I15 on 0/1 genre tags: Σ p·w / Σ w per listener and genre, ranked."""
    from pyspark.sql import Window
    _, tracks, lib = _ctx(spark, sf_dir)
    vector = G.weighted_genre_vector(lib, G.genre_tags(tracks))
    return round_doubles(vector.withColumn("rank", F.row_number().over(
        Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("genre")))))


@register("genre_match_tags", with_enriched() + _TAGS + f"""
, un AS (SELECT user_id, sqrt(sum(score * score)) AS un FROM gv GROUP BY user_id),
tn AS (SELECT track_id, sqrt(count(*)) AS tn FROM tags GROUP BY track_id),
pairs AS (SELECT DISTINCT user_id, track_id FROM enriched),
dots AS (SELECT p.user_id, p.track_id, sum(g.score) AS dot
         FROM pairs p JOIN tags t ON p.track_id = t.track_id
         JOIN gv g ON g.user_id = p.user_id AND g.genre = t.genre GROUP BY ALL)
SELECT p.user_id, p.track_id,
       {rq('greatest(coalesce(d.dot / (un.un * tn.tn), 0.0), 0.0)')} AS genre_match
FROM pairs p LEFT JOIN dots d ON p.user_id = d.user_id AND p.track_id = d.track_id
LEFT JOIN un ON p.user_id = un.user_id LEFT JOIN tn ON p.track_id = tn.track_id
""")
def q_genre_match_tags(spark, sf_dir):
    """I22 on 0/1 tags for every (listener, owned track) pair."""
    _, tracks, lib = _ctx(spark, sf_dir)
    tags = G.genre_tags(tracks)
    return round_doubles(R.genre_match_sparse(lib, G.weighted_genre_vector(lib, tags), tags))


_F5 = R.RECENT_FEATURES
_RECENT = f"""
, mx AS (SELECT max(added_at) AS m FROM enriched),
rv AS (SELECT user_id, count_if(added_at >= (SELECT m FROM mx) - INTERVAL 30 DAY) AS nr,
              {", ".join(f"avg(CASE WHEN added_at >= (SELECT m FROM mx) - INTERVAL 30 DAY THEN {c} END) AS r_{c}, avg({c}) AS a_{c}" for c in _F5)}
       FROM enriched GROUP BY user_id),
rv2 AS (SELECT user_id, {", ".join(f"CASE WHEN nr > 0 THEN r_{c} ELSE a_{c} END AS recent_{c}" for c in _F5)} FROM rv)
"""


@register("recent_taste_vectors", with_enriched() + _RECENT + f"""
SELECT user_id, {", ".join(f"{rq('recent_' + c)} AS recent_{c}" for c in _F5)} FROM rv2
""")
def q_recent_taste_vectors(spark, sf_dir):
    """Mean of 5 features over the last 30 days before the latest add, with fallback."""
    _, _, lib = _ctx(spark, sf_dir)
    return round_doubles(R.recent_vectors(lib))


_DOT = " + ".join(f"r.recent_{c} * e.{c}" for c in _F5)
_RN = "sqrt(" + " + ".join(f"r.recent_{c} * r.recent_{c}" for c in _F5) + ")"
_TN = "sqrt(" + " + ".join(f"e.{c} * e.{c}" for c in _F5) + ")"


@register("recent_taste_scores", with_enriched() + _RECENT + f"""
SELECT e.user_id, e.add_id, e.track_id,
       {rq(f'greatest(coalesce(({_DOT}) / ({_RN} * {_TN}), 0.0), 0.0)')} AS recent_taste
FROM enriched e JOIN rv2 r ON e.user_id = r.user_id
""")
def q_recent_taste_scores(spark, sf_dir):
    """I23 for each library row against its listener's recent vector."""
    _, _, lib = _ctx(spark, sf_dir)
    return round_doubles(R.recent_scores(lib, R.recent_vectors(lib)))


# ---------------------------------------------------------------------------
# the parts of the hybrid score on model-free inputs: quadrant moods, 0/1 tags
# ---------------------------------------------------------------------------
_QUADRANT = ("CASE WHEN energy > 0.5 AND valence > 0.5 THEN 'Happy & Energetic' WHEN energy > 0.5 THEN 'Angry & Intense' "
             "WHEN valence > 0.5 THEN 'Peaceful & Happy' ELSE 'Sad & Calm' END")
_MOODS = f"""
, lab AS (SELECT user_id, {_QUADRANT} AS mood, popularity FROM enriched),
per AS (SELECT user_id, mood, count(*) AS n, sum(popularity) AS w FROM lab GROUP BY ALL),
names AS (SELECT unnest(['Angry & Intense', 'Happy & Energetic', 'Peaceful & Happy', 'Sad & Calm']) AS mood),
spine AS (SELECT u.user_id, mood, tn, tw FROM (SELECT user_id, sum(n) AS tn, sum(w) AS tw FROM per GROUP BY user_id) u, names),
dist AS (SELECT s.user_id, s.mood, coalesce(n / tn * 100, 0.0) AS percentage,
                CASE WHEN tw > 0 THEN coalesce(w / tw * 100, 0.0) ELSE 0.0 END AS weighted
         FROM spine s LEFT JOIN per p ON p.user_id = s.user_id AND p.mood = s.mood)
"""


@register("mood_distribution_quadrants", with_enriched() + _MOODS + f"""
SELECT user_id, mood, {rq('percentage')} AS percentage,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY percentage DESC, mood) AS INTEGER) AS mood_rank FROM dist
""")
def q_mood_distribution_quadrants(spark, sf_dir):
    """I4 + I5 with quadrant moods."""
    _, _, lib = _ctx(spark, sf_dir)
    return round_doubles(M.dominant_mood(M.mood_distribution(M.QuadrantMood(), lib)))


@register("mood_distribution_weighted", with_enriched() + _MOODS + f"""
SELECT user_id, mood, {rq('weighted')} AS percentage FROM dist
""")
def q_mood_distribution_weighted(spark, sf_dir):
    """I4 with a weight column (popularity standing in for play counts)."""
    _, _, lib = _ctx(spark, sf_dir)
    return round_doubles(M.mood_distribution(M.QuadrantMood(), lib, weight="popularity"))


_PARTS = _TAGS + _RECENT + _MOODS + f"""
, un AS (SELECT user_id, sqrt(sum(score * score)) AS un FROM gv GROUP BY user_id),
tn AS (SELECT track_id, sqrt(count(*)) AS tn FROM tags GROUP BY track_id),
cand AS (SELECT track_id, track_name, artist_name, album_name, {_QUADRANT} AS mood,
                {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _F5)} FROM clean_tracks2),
allpairs AS (SELECT u.user_id, c.track_id FROM (SELECT DISTINCT user_id FROM enriched) u, cand c),
dots AS (SELECT g.user_id, t.track_id, sum(g.score) AS dot FROM gv g JOIN tags t ON g.genre = t.genre GROUP BY ALL),
scored AS (
  SELECT p.user_id, p.track_id, 0.5 AS collaborative_filtering, least(1.0, m.percentage / 100) AS mood_match,
         greatest(coalesce(d.dot / (un.un * tn.tn), 0.0), 0.0) AS genre_match,
         greatest(coalesce(({_DOT.replace('e.', 'c.')}) / ({_RN} * {_TN.replace('e.', 'c.')}), 0.0), 0.0) AS recent_taste,
         c.track_name, c.artist_name, c.album_name
  FROM allpairs p JOIN cand c ON c.track_id = p.track_id JOIN rv2 r ON r.user_id = p.user_id
  JOIN dist m ON m.user_id = p.user_id AND m.mood = c.mood
  LEFT JOIN dots d ON d.user_id = p.user_id AND d.track_id = p.track_id
  LEFT JOIN un ON un.user_id = p.user_id LEFT JOIN tn ON tn.track_id = p.track_id),
final AS (SELECT *, 0.5 * collaborative_filtering + 0.3 * (mood_match + genre_match) / 2 + 0.2 * recent_taste AS score FROM scored)
"""
_ROUNDED = ", ".join(f"{rq(c)} AS {c}" for c in ["score", *R.PARTS])


@register("pair_scores", with_enriched() + _PARTS + f"""
SELECT f.user_id, f.track_id, {_ROUNDED} FROM final f JOIN (SELECT DISTINCT user_id, track_id FROM enriched) e
ON e.user_id = f.user_id AND e.track_id = f.track_id
""")
def q_pair_scores(spark, sf_dir):
    """I21-I24 for every (listener, owned track) pair, with quadrant moods and 0/1 tags."""
    _, tracks, lib = _ctx(spark, sf_dir)
    s = R.score_pairs(lib, lib, tracks, M.QuadrantMood(), G.genre_tags(tracks))
    return round_doubles(s.select("user_id", "track_id", "score", *[f"score_breakdown.{p}" for p in R.PARTS]))


@register("recommendations_rules", with_enriched() + _PARTS + f"""
, open AS (SELECT f.* FROM final f WHERE NOT EXISTS (SELECT 1 FROM enriched e WHERE e.user_id = f.user_id AND e.track_id = f.track_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {rq('score')} DESC, track_id) AS INTEGER) AS rank FROM open)
SELECT user_id, rank, {rq('score')} AS score FROM ranked WHERE rank <= 10
""")
def q_recommendations_rules(spark, sf_dir):
    """I25 with quadrant moods and 0/1 tags: the ten best unowned scores of each listener."""
    _, tracks, lib = _ctx(spark, sf_dir)
    recs = R.recommend(lib, tracks, M.QuadrantMood(), G.genre_tags(tracks), n=10)
    return round_doubles(recs.select("user_id", "rank", "score"))


@register("recommendation_pruning")
def q_recommendation_pruning(spark, sf_dir):
    """How many (listener, block) pairs of the rules' search the bounds skip (one row)."""
    _, tracks, lib = _ctx(spark, sf_dir)
    return R.pruning(lib, tracks, M.QuadrantMood(), G.genre_tags(tracks), n=10)


# ---------------------------------------------------------------------------
# recommendations and training report
# ---------------------------------------------------------------------------
@register("recommendations")
def q_recommendations(spark, sf_dir):
    """Exact hybrid top-10 over every unowned track, per listener."""
    _, tracks, lib = _ctx(spark, sf_dir)
    gm = genre_model(spark, sf_dir)
    # read by the listener side, the candidate side and the genre numbers
    probs = materialize(gm.predict(tracks), "genre-probabilities")
    recs = R.recommend(lib, tracks, mood_model(spark, sf_dir), probs,
                       taste=taste_model(spark, sf_dir), n=10)
    return recs.select("user_id", "rank", "track_id", "track_name", "artist_name", "album_name", "score",
                       "score_breakdown.*", "reason").drop("final_score")


@register("training_report")
def q_training_report(spark, sf_dir):
    """One-row report of the fitted models (counts and parameters)."""
    _, tracks, _ = _ctx(spark, sf_dir)
    tm, mm, gm = taste_model(spark, sf_dir), mood_model(spark, sf_dir), genre_model(spark, sf_dir)
    from listenlens.operators.common import join_on_keys
    return join_on_keys(tracks.agg(F.count(F.lit(1)).alias("tracks_count")), tm.fitted_counts(), []).select(
        "tracks_count", "als_users", "als_tracks", F.lit(tm.model.rank).alias("user_embedding_size"),
        F.lit(mm.k).alias("mood_clusters"), F.lit(len(gm.genres)).alias("genre_labels"),
        F.lit(RF_TREES).alias("genre_trees"), F.lit(True).alias("fitted"))


@register("als_taste_profiles")
def q_als_taste_profiles(spark, sf_dir):
    """J5 (I9, I11, I12): taste profile of each listener's ALS factors plus its
    10 most similar listeners (exact cosine)."""
    return TA.listener_profiles(taste_model(spark, sf_dir))


@register("recap_report")
def q_recap_report(spark, sf_dir):
    """One nested recap row per listener (its parts are checked by their own oracles)."""
    from listenlens.plans.report import recap
    _, tracks, lib = _ctx(spark, sf_dir)
    probs = materialize(genre_model(spark, sf_dir).predict(tracks), "genre-probabilities")
    return recap(lib, mood_model=mood_model(spark, sf_dir), genre_probs=probs, taste=taste_model(spark, sf_dir),
                 candidates=tracks)


@register("recap_rules", with_enriched() + D2_CTES + TYPES_CTE + _PARTS + f"""
, open AS (SELECT f.* FROM final f WHERE NOT EXISTS (SELECT 1 FROM enriched e WHERE e.user_id = f.user_id AND e.track_id = f.track_id)),
ranked AS (SELECT user_id, {rq('score')} AS score, row_number() OVER (PARTITION BY user_id ORDER BY {rq('score')} DESC, track_id) AS rk FROM open),
rec AS (SELECT user_id, least(count(*), 10) AS recommendations, max(CASE WHEN rk = 1 THEN score END) AS best_score,
               max(CASE WHEN rk = 10 THEN score END) AS tenth_score FROM ranked GROUP BY user_id),
kc AS (SELECT user_id, key, count(*) AS n FROM enriched GROUP BY user_id, key),
km AS (SELECT user_id, arg_min(key, (-n, key)) AS most_common_key FROM kc GROUP BY user_id),
st AS (SELECT user_id, count(*) AS total_tracks, {rq('avg(tempo)')} AS avg_tempo,
              count(DISTINCT strftime(added_at, '%Y-%m')) AS months, avg(energy) AS e, avg(valence) AS v FROM enriched GROUP BY user_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY percentage DESC, mood) AS rk FROM dist),
md AS (SELECT user_id, string_agg(mood, '|' ORDER BY rk) AS moods, {rq('max(percentage)')} AS dominant_percentage FROM dr GROUP BY user_id),
gp AS (SELECT user_id, count(*) AS genres, {rq('sum(score)')} AS genre_scores FROM gv GROUP BY user_id)
SELECT st.user_id, total_tracks, avg_tempo, most_common_key, months, type_id, moods, dominant_percentage,
       CAST(2 + (e > 0.7 OR e < 0.4)::INT + (v > 0.6 OR v < 0.4)::INT AS INTEGER) AS mood_insights,
       CAST(genres AS INTEGER) AS genres, genre_scores,
       CAST(recommendations AS INTEGER) AS recommendations, best_score, tenth_score
FROM st JOIN km USING (user_id) JOIN ty USING (user_id) JOIN md USING (user_id)
LEFT JOIN gp USING (user_id) LEFT JOIN rec USING (user_id)
""")
def q_recap_rules(spark, sf_dir):
    """J1 + J5 with quadrant moods and 0/1 tags: figures read out of every section of the nested row."""
    from listenlens.plans.report import recap
    _, tracks, lib = _ctx(spark, sf_dir)
    row = recap(lib, mood_model=M.QuadrantMood(), genre_probs=G.genre_tags(tracks), candidates=tracks)
    genres = F.col("genre_profile.genre_distribution")
    return round_doubles(row.select(
        "user_id", "recap_stats.total_tracks", "recap_stats.avg_tempo", "recap_stats.most_common_key",
        F.size("monthly").cast("long").alias("months"), "personality.type_id",
        F.array_join("mood_profile.distribution.mood", "|").alias("moods"), "mood_profile.dominant_percentage",
        F.size("mood_profile.insights").alias("mood_insights"), F.size(genres).alias("genres"),
        F.aggregate(genres["score"], F.lit(0.0), lambda a, x: a + x).alias("genre_scores"),
        F.size("recommendations").alias("recommendations"),
        F.col("recommendations")[0]["score"].alias("best_score"), F.col("recommendations")[9]["score"].alias("tenth_score")))


@register("mood_profile")
def q_mood_profile(spark, sf_dir):
    """One row per listener with distribution, insights and cluster profiles."""
    _, _, lib = _ctx(spark, sf_dir)
    return M.mood_profile(mood_model(spark, sf_dir), lib)


@register("training_run", with_enriched("interactions") + f"""
, typed AS (SELECT user_id, track_id, count,
                   CASE WHEN interaction_type = 'listen' AND duration_ms < 30000 THEN 'skip'
                        ELSE interaction_type END AS t FROM interactions),
matrix AS (SELECT user_id, track_id, sum({WEIGHT_SQL} * count) AS score FROM typed GROUP BY user_id, track_id),
pos AS (SELECT * FROM matrix WHERE score > 0)
SELECT (SELECT count(*) FROM clean_tracks2) AS tracks_count, {ALS_RANK} AS factors,
       (SELECT count(DISTINCT user_id) FROM pos) AS users, (SELECT count(DISTINCT track_id) FROM pos) AS tracks,
       {MOOD_K} AS clusters, true AS fitted, {RF_TREES}::BIGINT AS estimators,
       (SELECT count(DISTINCT g)::INT FROM (SELECT unnest(genres_list) AS g FROM clean_tracks2)) AS genres
""")
def q_training_run(spark, sf_dir):
    """I26 + A7: every model written, read back and reported as JSON; the report's figures."""
    _, tracks, _ = _ctx(spark, sf_dir)
    folder = scratch_path(spark, "training-run")
    TR.save_models(TR.Models(mood_model(spark, sf_dir), genre_model(spark, sf_dir), taste_model(spark, sf_dir)), folder)
    report = TR.write_training_report(TR.load_models(spark, folder), tracks, f"{folder}/report")
    return report.select("tracks_count", "models.taste_matcher.factors", "models.taste_matcher.users",
                         "models.taste_matcher.tracks", "models.mood_analyzer.clusters", "models.mood_analyzer.fitted",
                         "models.genre_classifier.estimators", "models.genre_classifier.genres")
