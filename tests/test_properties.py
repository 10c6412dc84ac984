"""Properties of model-backed and custom operators (SURVEY §5 (4)-(6))."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from listenlens.operators import personality as PE
from listenlens.operators import profile as P
from listenlens.operators import taste as TA
from listenlens.operators.enrich import enriched
from listenlens.sources.fixtures import Views
from tests.conftest import SF_SMALL

Q = E.queries()


def test_mood_distribution_sums_to_100(spark):
    d = Q["mood_distribution"](spark, SF_SMALL)
    sums = d.groupBy("user_id").agg(F.sum("percentage").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-6 for r in sums)
    labels = {r.mood for r in d.select("mood").distinct().collect()}
    assert labels <= {"high_energy_happy", "chill_mellow", "dark_intense", "acoustic_folk",
                      "upbeat_dance", "sad_melancholic"}


def test_recommendations_properties(spark):
    recs = Q["recommendations"](spark, SF_SMALL)
    lib = Views(spark, SF_SMALL).library
    assert recs.join(lib, ["user_id", "track_id"]).count() == 0          # nothing owned
    per = recs.groupBy("user_id").count().collect()
    assert per and max(r["count"] for r in per) <= 10
    rows = recs.collect()
    for r in rows:
        cb = (r.mood_match + r.genre_match) / 2
        assert r.score == pytest.approx(0.5 * r.collaborative_filtering + 0.3 * cb + 0.2 * r.recent_taste)
        assert 0 <= r.mood_match <= 1 and r.genre_match >= 0 and r.recent_taste >= 0


def test_similar_vectors_equals_brute_force(spark):
    emb = Views(spark, SF_SMALL).embeddings
    got = TA.similar_vectors(emb, "vec_id", n=3, block_rows=16).collect()
    pdf = emb.toPandas()
    X = np.stack(pdf.embedding.to_numpy()).astype(float)
    X = X / np.linalg.norm(X, axis=1)[:, None]
    S = X @ X.T
    ids = pdf.vec_id.to_numpy()
    np.fill_diagonal(S, -np.inf)
    want = {}
    for i, vid in enumerate(ids):
        order = np.lexsort((ids, -S[i]))[:3]
        want[vid] = [int(ids[j]) for j in order]
    have = {}
    for r in sorted(got, key=lambda r: (r.vec_id, r["rank"])):
        have.setdefault(r.vec_id, []).append(r.similar_vec_id)
    assert have == want


def test_percent_rank_equals_window(spark):
    e = enriched(Views(spark, SF_SMALL))
    uf = P.user_features(e)
    got = PE.global_percent_rank(uf, ["avg_energy"], buckets=4).toPandas()
    pdf = uf.select("user_id", "avg_energy").toPandas()
    n = len(pdf)
    exp = pdf.avg_energy.rank(method="min").sub(1).div(n - 1)
    m = dict(zip(pdf.user_id, exp))
    for r in got.itertuples():
        assert r.percent_rank == pytest.approx(m[r.user_id])


def test_repartition_invariance(spark):
    e = enriched(Views(spark, SF_SMALL))
    a = sorted(P.listening_stats(e).collect())
    b = sorted(P.listening_stats(e.repartition(13, "add_id")).collect())
    assert a == b


def test_same_seed_same_model(spark):
    from listenlens.operators import mood as M
    t = Views(spark, SF_SMALL).tracks
    a = M.fit_mood(t, n_init=1).profiles.orderBy("cluster").collect()
    b = M.fit_mood(t, n_init=1).profiles.orderBy("cluster").collect()
    assert a == b


def test_all_registered_queries_run(spark):
    for name, fn in Q.items():
        assert fn(spark, SF_SMALL).limit(1).count() >= 0, name


def test_recent_fallback_and_owned_everything(spark):
    import datetime as dt
    from listenlens.operators import genre as G
    from listenlens.operators import mood as M
    from listenlens.operators import recommend as R
    from listenlens.operators.enrich import clean_tracks, enrich_library
    v = Views(spark, SF_SMALL)
    tracks = clean_tracks(v.tracks)
    ids = [r.track_id for r in tracks.select("track_id").collect()]
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
    rows = [(1, i, ids[i], old) for i in range(5)]                        # listener 1: nothing recent
    rows += [(2, 100 + i, t, new) for i, t in enumerate(ids)]              # listener 2: owns everything
    lib = enrich_library(spark.createDataFrame(rows, "user_id long, add_id long, track_id long, "
                                                     "added_at timestamp_ntz"), tracks)
    rv = {r.user_id: r for r in R.recent_vectors(lib).collect()}
    all_e = lib.filter("user_id = 1").agg(F.avg("energy")).first()[0]
    assert rv[1].recent_energy == pytest.approx(all_e)                     # fallback to all adds
    mm = M.fit_mood(v.tracks, n_init=1)
    tags = G.genre_tags(tracks)
    recs = R.recommend(lib, tracks, mm, tags, taste=None, n=3).collect()
    assert {r.user_id for r in recs} == {1}                                # 2 owns every candidate
    assert all(r.score_breakdown.collaborative_filtering == 0.5 for r in recs)  # no factors: neutral


def test_similar_vectors_query_subset_equals_full(spark):
    emb = Views(spark, SF_SMALL).embeddings
    full = TA.similar_vectors(emb, "vec_id", n=4, block_rows=64)
    ids = spark.createDataFrame([(i,) for i in (0, 7, 42, 99, 123)], "vec_id long")
    sub = TA.similar_vectors(emb, "vec_id", n=4, block_rows=64, queries=ids)
    want = sorted(full.join(ids, "vec_id").collect())
    got = sorted(sub.collect())
    assert len(want) == 20
    assert [(r.vec_id, r.similar_vec_id, r["rank"]) for r in got] == \
        [(r.vec_id, r.similar_vec_id, r["rank"]) for r in want]
    assert all(abs(a.similarity - b.similarity) < 1e-12 for a, b in zip(got, want))


def test_approximate_medians_close_to_exact(spark):
    from listenlens.operators.enrich import clean_tracks
    t = Views(spark, SF_SMALL).tracks
    ex = clean_tracks(t, "exact").filter("track_id % 29 = 0").select("track_id", "energy")
    ap = clean_tracks(t, "approx").filter("track_id % 29 = 0").select("track_id", "energy")
    a = dict(ex.collect()); b = dict(ap.collect())
    assert all(abs(a[k] - b[k]) < 0.05 for k in a)


def test_nearest_by_stretches_equals_sorting_every_row(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(TA, "_CELLS", 900)  # stretches of three queries
    c = rng.integers(-2, 3, (300, 2)).astype(float)  # many ties
    ids = np.sort(rng.choice(1000, 300, replace=False))
    at = np.sort(rng.choice(300, 20, replace=False))
    got = list(zip(*[np.concatenate(x).tolist() for x in zip(*TA._nearest(ids[at], c[at], ids, c, 4))]))
    want = []
    for i in at:
        s = c @ c[i]
        s[i] = -np.inf
        want += [(ids[i], ids[j], s[j]) for j in np.lexsort((ids, -s))[:4]]
    assert got == want


def test_mood_texts_read_the_library_once(spark):
    from listenlens.operators import mood as M
    lib = enriched(Views(spark, SF_SMALL))
    for df in (M.mood_insights(M.QuadrantMood(), lib), M.mood_profile(M.QuadrantMood(), lib)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "event_id" not in plan  # only the written sums are read
    e = lib.groupBy("user_id").agg(F.avg("energy").alias("e")).filter("e > 0.7 OR e < 0.4").count()
    said = M.mood_insights(M.QuadrantMood(), lib).filter("insight LIKE '%avg energy%'").count()
    assert said == e


def test_mood_fit_spreads_rows_of_one_file(spark, monkeypatch):
    from listenlens.operators import mood as M
    t = Views(spark, SF_SMALL).tracks.coalesce(1)
    monkeypatch.setattr(M, "PART_ROWS", 20)
    seen = []
    real = M.KMeans.fit
    monkeypatch.setattr(M.KMeans, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or real(self, df, *a))
    m = M.fit_mood(t, n_init=1)
    assert seen[0] > 1 and m.profiles.agg(F.sum("size")).first()[0] == t.count()


def test_quantiles_of_small_and_large_groups(spark):
    from listenlens.operators import distribution as D
    rng = np.random.default_rng(9)
    rows = [("few", float(v)) for v in rng.integers(0, 5, 30)] + [("many", float(v)) for v in rng.normal(size=400)] + [("one", 2.0)]
    counts = spark.createDataFrame(rows, "feature string, value double").groupBy("feature", "value").agg(F.count("*").alias("n"))
    want = {f: np.quantile([v for g, v in rows if g == f], [0.1, 0.5, 0.75]) for f in ("few", "many", "one")}
    for few in (1, 50, 10_000):  # all, one and none of the groups in buckets
        got = {r.feature: r.q for r in D.quantiles(counts, ["feature"], [0.1, 0.5, 0.75], few=few).collect()}
        assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=1e-12) for f in want)


def test_descriptions_read_the_library_once(spark):
    from listenlens.operators import distribution as D
    lib = enriched(Views(spark, SF_SMALL))
    for df in (D.describe(lib), D.box_stats(lib)):
        assert "event_id" not in df._jdf.queryExecution().optimizedPlan().toString()  # only the written counts are read


def test_taste_fit_has_work_for_every_core(spark, monkeypatch):
    from pyspark.ml import recommendation
    seen = {}

    class Stop(Exception):
        pass

    def als(**kw):
        seen.update(kw)
        raise Stop

    monkeypatch.setattr(recommendation, "ALS", als)
    matrix = spark.createDataFrame([(1, 1, 1.0)], "user_id long, track_id long, score double")
    with pytest.raises(Stop):
        TA.train_taste(matrix)
    assert min(seen["numUserBlocks"], seen["numItemBlocks"]) >= 2 * spark.sparkContext.defaultParallelism
