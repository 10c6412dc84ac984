"""Sources/sinks (A3-A8) and model persistence round trips."""

import time

import pytest
from pyspark.sql import functions as F

from listenlens.operators import genre as G
from listenlens.operators import mood as M
from listenlens.operators import taste as TA
from listenlens.operators.enrich import clean_tracks, require_columns
from listenlens.session import scratch_path
from listenlens.sources import ingest as I
from listenlens.sources.fixtures import Views
from tests.conftest import SF_SMALL


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "track_uri long")
    with pytest.raises(ValueError):
        I.validate_tracks(df)
    assert require_columns(df, ["track_uri"]) is df


def test_interactions_csv(spark):
    v = Views(spark, SF_SMALL)
    path = scratch_path(spark, "interactions-csv")
    (v.interactions.select("user_id", "track_id", "interaction_type", "count",
                           F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
     .write.option("header", True).csv(path))
    back = I.load_interactions_csv(spark, path)
    assert back.count() == v.interactions.count()
    assert back.filter(F.col("ts").isNull()).count() == 0


def test_import_tracks_json_dedups(spark):
    v = Views(spark, SF_SMALL)
    path = scratch_path(spark, "tracks-json")
    twice = v.tracks.unionByName(v.tracks)
    twice.write.json(path)
    table = scratch_path(spark, "tracks-table")
    n = I.import_tracks(I.read_tracks_json(spark, path, v.tracks.schema), table)
    assert n == v.tracks.count()
    assert I.import_tracks(I.read_tracks_json(spark, path, v.tracks.schema), table) == 0  # nothing is new
    assert spark.read.parquet(table).count() == n


def test_write_report(spark):
    v = Views(spark, SF_SMALL)
    out = I.write_report({"tracks": v.tracks.limit(5)}, scratch_path(spark, "report"))
    assert spark.read.parquet(out["tracks"]).count() == 5


def test_mood_save_load_same_predictions(spark):
    t = Views(spark, SF_SMALL).tracks
    m = M.fit_mood(t, n_init=1)
    p = scratch_path(spark, "mood-model")
    M.save_mood(m, p)
    m2 = M.load_mood(spark, p)
    a = m.predict(t).select("track_id", "cluster").orderBy("track_id").collect()
    b = m2.predict(t).select("track_id", "cluster").orderBy("track_id").collect()
    assert a == b


def test_genre_save_load_same_predictions(spark):
    t = clean_tracks(Views(spark, SF_SMALL).tracks)
    g = G.fit_genre(t, num_trees=3, max_depth=3)
    p = scratch_path(spark, "genre-model")
    G.save_genre(g, p)
    g2 = G.load_genre(spark, p)
    a = g.predict(t).orderBy("track_id", "genre").collect()
    b = g2.predict(t).orderBy("track_id", "genre").collect()
    assert a == b
    # every tag of the tracks is predicted somewhere, and nothing else
    tags = {r.genre for r in G.genre_tags(t).collect()}
    assert {r.genre for r in a} == tags and all(0 < r.p <= 1 for r in a)


def test_taste_save_load_and_defaults(spark):
    v = Views(spark, SF_SMALL)
    m = TA.train_taste(TA.interaction_matrix(v.interactions), rank=4, max_iter=3)
    p = scratch_path(spark, "taste-model")
    m.save(p)
    m2 = TA.TasteModel.load(spark, p)
    pairs = spark.createDataFrame([(10 ** 9, 1), (0, 10 ** 9)], "user_id long, track_id long")
    assert [r.taste_score for r in m2.match_scores(pairs).collect()] == [0.5, 0.5]
    assert m2.user_factors.count() == m.user_factors.count()


def test_taste_fit_leaves_no_shuffles_of_its_passes(spark):
    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b.split("_")[1] for b in blocks.split() if b.startswith("shuffle_")}

    matrix = TA.interaction_matrix(Views(spark, SF_SMALL).interactions)
    before = shuffles()
    m = TA.train_taste(matrix, rank=4, max_iter=12)
    for _ in range(20):  # Spark deletes them in the background
        if len(shuffles() - before) < 10:
            break
        time.sleep(0.5)
    # those of the matrix and of the blocks of ratings may stay, two a pass may not
    assert len(shuffles() - before) < 10
    assert m.user_factors.count() and m.model.rank == 4
