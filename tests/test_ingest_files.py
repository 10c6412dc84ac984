"""Hand-made files: column order, quoting, text ids, junk rows, optional columns, genre literals."""

import pytest
from pyspark.sql import functions as F

from listenlens.operators import genre as G
from listenlens.operators import mood as M
from listenlens.operators import recommend as R
from listenlens.operators import taste as TA
from listenlens.sources import ingest as I
from listenlens.streaming.interactions import windowed_scores


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_columns_are_bound_by_name(spark, tmp_path):
    path = _file(tmp_path, "lib.csv", "Energy,Track URI,Danceability,Track Name\n0.1,t:1,0.9,A\n0.2,t:2,0.8,B\n")
    rows = I.load_library_csv(spark, path).orderBy("track_uri").collect()
    assert [(r.energy, r.danceability, r.track_name) for r in rows] == [(0.1, 0.9, "A"), (0.2, 0.8, "B")]
    assert "tempo" not in rows[0].asDict()


def test_doubled_quotes_and_line_breaks(spark, tmp_path):
    path = _file(tmp_path, "q.csv", 'Track URI,Track Name,Energy\nt:1,"Say ""Hi"", now",0.5\nt:2,"two\nlines",0.6\n')
    rows = I.load_library_csv(spark, path, multiline=True).orderBy("track_uri").collect()
    assert [(r.track_name, r.energy) for r in rows] == [('Say "Hi", now', 0.5), ("two\nlines", 0.6)]


def test_junk_is_counted_or_refused(spark, tmp_path):
    path = _file(tmp_path, "j.csv", "track_uri,energy,tempo\nt:1,0.5,120\nt:2,loud,\nt:3,0.1,fast\nt:4,0.2\n")
    df = I.load_library_csv(spark, path)
    assert {r.field: r.rows for r in I.corrupt_report(df).collect()} == {"energy": 1, "tempo": 1, "record": 1}
    assert df.filter("track_uri = 't:2'").first().energy is None
    with pytest.raises(Exception):
        I.load_library_csv(spark, path, failfast=True).collect()


def test_text_ids_survive(spark, tmp_path):
    path = _file(tmp_path, "i.csv", "user_id,track_id,interaction_type,count\nuser_1,track_9,save,2\nuser_2,track_9,skip,1\n"
                                    "user_1,track_8,listen,3\nuser_3,track_8,replay,1\n")
    m = TA.interaction_matrix(I.load_interactions_csv(spark, path))
    assert {(r.user_id, r.track_id): r.score for r in m.collect()} == {
        ("user_1", "track_9"): 4.0, ("user_2", "track_9"): -1.0, ("user_1", "track_8"): 3.0, ("user_3", "track_8"): 1.5}
    model = TA.train_taste(m, rank=3, max_iter=2)
    vectors = {r.user_id: r.embedding for r in model.user_factors.collect()}
    assert set(vectors) == {"user_1", "user_2", "user_3"} and not any(vectors["user_2"])
    scores = {(r.user_id, r.track_id): r.taste_score for r in model.match_scores(m).collect()}
    assert scores["user_2", "track_9"] == 0.5
    assert model.embedding("user", "user_1") == list(vectors["user_1"])
    with pytest.raises(KeyError):
        model.embedding("track", "track_0")
    assert model.fitted_counts().first().als_users == 2


@pytest.mark.parametrize("text, genres", [
    ("['r&b, soul', 'pop']", ["r&b, soul", "pop"]), ('["it\'s", "x"]', ["it's", "x"]), ("[rock, pop]", ["rock", "pop"]),
    ("[]", []), (None, []), ("['a']", ["a"]), ("[' spaced ']", [" spaced "]), (r"['it\'s']", ["it's"])])
def test_genre_literals(spark, text, genres):
    df = spark.createDataFrame([(text,)], "genres string")
    assert df.select(I.parse_genre_literal().alias("g")).first().g == genres


def test_import_counts_what_is_new(spark, tmp_path):
    table = str(tmp_path / "tracks")
    df = lambda *ids: spark.createDataFrame([(i, f"t:{i}") for i in ids], "track_id long, track_uri string")
    assert I.import_tracks(df(1, 2, 3), table) == 3
    assert I.import_tracks(df(2, 3, 4), table) == 1
    assert I.import_tracks(df(1), table) == 0
    assert spark.read.parquet(table).count() == 4


def test_equal_timestamps_all_count(spark):
    rows = [("u", "t", "listen", 1, 60000, "2024-01-01 10:00:00"), ("u", "t", "listen", 4, 60000, "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "user_id string, track_id string, interaction_type string, count int, duration_ms long, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    assert windowed_scores(df).first().score == TA.interaction_matrix(df).first().score == 5.0
    assert windowed_scores(df.withColumn("id", F.lit(1)), event_id="id").count() == 1


def test_recommendations_with_text_ids_and_an_untagged_listener(spark):
    feats = "energy double, valence double, danceability double, tempo double, acousticness double"
    t = [(f"track_{i}", f"N{i}", f"A{i}", f"L{i}", i / 10, 1 - i / 10, 0.5, 100.0 + i, 0.1,
          ["rock"] if i % 3 == 0 else ["pop", "jazz"] if i % 3 == 1 else []) for i in range(9)]
    tracks = spark.createDataFrame(t, f"track_id string, track_name string, artist_name string, album_name string, {feats}, genres_list array<string>")
    lib = spark.createDataFrame([("user_a", "track_0", 1), ("user_a", "track_1", 5), ("user_b", "track_2", 1), ("user_b", "track_5", 2)],
                                "user_id string, track_id string, plays int").join(tracks, "track_id") \
        .withColumn("added_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    tags = G.genre_tags(tracks)
    recs = R.recommend(lib, tracks, M.QuadrantMood(), tags, n=20, weight="plays").collect()
    assert {r.user_id for r in recs} == {"user_a", "user_b"}
    assert {r.track_id for r in recs if r.user_id == "user_b"} == {f"track_{i}" for i in range(9)} - {"track_2", "track_5"}
    assert all(r.track_name == "N" + r.track_id[6:] and r.score_breakdown.genre_match == 0.0 for r in recs if r.user_id == "user_b")
    pairs = spark.createDataFrame([(r.user_id, r.track_id) for r in recs], "user_id string, track_id string")
    one = {(r.user_id, r.track_id): r.score for r in R.score_pairs(pairs, lib, tracks, M.QuadrantMood(), tags, weight="plays").collect()}
    assert all(abs(one[r.user_id, r.track_id] - r.score) < 1e-12 for r in recs) and len(one) == len(recs)
