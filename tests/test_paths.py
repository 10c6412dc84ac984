"""Less common paths: big ids in ALS, valence variance, global top-k."""

import pytest
from pyspark.sql import functions as F

from listenlens.operators import personality as PE
from listenlens.operators import profile as P
from listenlens.operators import taste as TA
from listenlens.operators.enrich import audio_features, enriched
from listenlens.sources.fixtures import Views
from tests.conftest import SF_SMALL


def test_als_with_ids_beyond_int(spark):
    v = Views(spark, SF_SMALL)
    big = 2 ** 40
    m = (TA.interaction_matrix(v.interactions)
         .withColumn("user_id", F.col("user_id") + big).withColumn("track_id", F.col("track_id") + big))
    model = TA.train_taste(m, rank=4, max_iter=3)
    uf = model.user_factors
    assert uf.filter(F.col("user_id") < big).count() == 0 and uf.count() > 0
    scores = model.match_scores(m.select("user_id", "track_id").limit(20)).collect()
    assert all(r.taste_score is not None for r in scores)


def test_valence_variance_drives_mood_rider(spark):
    e = enriched(Views(spark, SF_SMALL))
    f = P.user_features(e, with_valence_variance=True)
    assert "valence_variance" in f.columns
    out = PE.classify(f).join(f.select("user_id", "valence_variance"), "user_id").collect()
    for r in out:
        if r.valence_variance and r.valence_variance > 0:
            assert r.score_mood_rider == pytest.approx(5 * r.valence_variance)


def test_global_top_k_and_audio_projection(spark):
    e = enriched(Views(spark, SF_SMALL))
    g = P.top_tracks(e, keys=[], n=5).orderBy("rank").collect()
    pdf = e.select("track_id", "add_id", "popularity").toPandas().sort_values(
        ["popularity", "track_id", "add_id"], ascending=[False, True, True]).head(5)
    assert [(r.track_id, r.add_id) for r in g] == list(zip(pdf.track_id, pdf.add_id))
    assert [r["rank"] for r in g] == [1, 2, 3, 4, 5]
    assert audio_features(e).columns == ["danceability", "energy", "key", "loudness", "mode",
                                         "speechiness", "acousticness", "instrumentalness",
                                         "liveness", "valence", "tempo", "time_signature"]
