"""Hand-made edge rows (FIXTURES §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listenlens.functions import columns as C
from listenlens.operators import personality as PE
from listenlens.operators import profile as P
from listenlens.operators import timeline as T
from listenlens.operators.enrich import clean_tracks, enrich_library, normalise_column_names
from listenlens.sources.ingest import parse_genre_literal


def test_parse_genres(spark):
    df = spark.createDataFrame([(None,), ("",), (" a ,b",), ("a,,b",)], "genres string")
    out = [r[0] for r in df.select(C.parse_genres("genres")).collect()]
    assert out == [[], [], ["a", "b"], ["a", "", "b"]]
    prim = [r[0] for r in df.select(C.primary_genre(C.parse_genres("genres"))).collect()]
    assert prim == ["unknown", "unknown", "a", "a"]


def test_time_flags(spark):
    rows = [(dt.datetime(2024, 1, 6, 5), ), (dt.datetime(2024, 1, 7, 6),),
            (dt.datetime(2024, 1, 8, 21),), (dt.datetime(2024, 1, 9, 22),), (None,)]
    df = spark.createDataFrame(rows, "added_at timestamp_ntz")
    out = df.select(F.hour("added_at").alias("h"), F.weekday("added_at").alias("d")).select(
        C.is_night("h").alias("n"), C.is_weekend("d").alias("w")).collect()
    assert [r.n for r in out] == [True, False, False, True, False]
    assert [r.w for r in out] == [True, True, False, False, False]  # Sat, Sun, Mon, Tue, null


def test_release_year_and_bool(spark):
    df = spark.createDataFrame([("2020", "False"), ("2020-05", "x"), ("2020-05-01", None),
                                ("n/a", "true")], "release_date string, explicit string")
    out = df.select(C.release_year("release_date").alias("y"), C.to_bool("explicit").alias("e")).collect()
    assert [r.y for r in out] == [2020, 2020, 2020, None]
    assert [r.e for r in out] == [False, False, False, True]


def test_bad_timestamp_is_null(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00",), ("not a date",)], "s string")
    out = [r[0] for r in df.select(C.parse_timestamp("s")).collect()]
    assert out[0] is not None and out[1] is None


def test_skip_and_weights(spark):
    df = spark.createDataFrame([("listen", 29999), ("listen", 30000), ("save", 1), ("odd", 1)],
                               "interaction_type string, duration_ms int")
    out = df.select(C.derive_skip().alias("t")).select(
        "t", C.interaction_weight("t").alias("w")).collect()
    assert [(r.t, r.w) for r in out] == [("skip", -1.0), ("listen", 1.0), ("save", 2.0), ("odd", 1.0)]


def test_tempo_clip_and_quadrants(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.6, 0.6), (0.7, 0.4), (0.4, 0.7)], "energy double, valence double")
    out = [r[0] for r in df.select(C.mood_quadrant()).collect()]
    assert out == ["Sad & Calm", "Happy & Energetic", "Angry & Intense", "Peaceful & Happy"]
    lab = [r[0] for r in spark.createDataFrame(
        [(0.71, 0.61, 0.1, 0.1), (0.3, 0.3, 0.1, 0.1), (0.5, 0.5, 0.1, 0.7), (0.5, 0.5, 0.8, 0.1),
         (0.65, 0.3, 0.1, 0.1), (0.7, 0.6, 0.1, 0.1)], "e double, v double, d double, a double")
        .select(C.cluster_label("e", "v", "d", "a")).collect()]
    assert lab == ["high_energy_happy", "sad_melancholic", "acoustic_folk", "upbeat_dance",
                   "dark_intense", "chill_mellow"]


def test_normal_cdf(spark):
    import math
    zs = [-6.0, -1.5, 0.0, 0.3, 2.0, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(C.normal_cdf("z")).collect()]
    for z, g in zip(zs, got):
        assert abs(g - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 2e-7


def test_std_zero_percentile_is_50(spark):
    df = spark.createDataFrame([(1, 0.9)], "user_id long, avg_energy double")
    out = PE.percentiles(df, {"avg_energy": (0.5, 0.0)}).first()
    assert out["avg_energy_pct"] == 50.0
    missing = PE.percentiles(spark.createDataFrame([(1,)], "user_id long"),
                             {"avg_energy": (0.55, 0.15)}).first()
    assert missing["avg_energy_pct"] == 50.0


def test_worked_example_party_animal(spark):
    # the reference's sample listener
    row = dict(genre_diversity=0.05, repeat_artist_ratio=0.35, night_listener_ratio=0.25,
               avg_energy=0.72, avg_valence=0.58, avg_danceability=0.68, avg_acousticness=0.22)
    df = spark.createDataFrame([(1, *row.values())], "user_id long, " + ", ".join(f"{k} double" for k in row))
    out = PE.classify(df).first()
    assert out.type_id == "party_animal"
    assert out.score_party_animal == pytest.approx(3.38)
    assert out.score_explorer == pytest.approx(1.45)
    assert out.score_loyalist == pytest.approx(2.95)
    assert out.score_night_owl == pytest.approx(1.25)
    assert out.score_chill_seeker == pytest.approx(1.32)
    assert out.score_mood_rider == pytest.approx(0.16)
    assert out.confidence == pytest.approx(3.38 / (1.45 + 2.95 + 1.25 + 3.38 + 1.32 + 0.16))


def test_type_ties_follow_declared_order(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.5)],
                               "user_id long, genre_diversity double, repeat_artist_ratio double, "
                               "night_listener_ratio double, avg_energy double, avg_valence double, "
                               "avg_danceability double, avg_acousticness double")
    out = PE.classify(df).first()
    # explorer = 2, loyalist = 2, party = 2.5, chill = 2.5: the earlier of the tied maxima wins
    assert out.type_id == "party_animal"


def _library(spark, rows):
    schema = ("user_id long, add_id long, track_id long, added_at timestamp_ntz")
    return spark.createDataFrame(rows, schema)


def _tracks(spark):
    rows = [(1, "t:1", "a", "A", "al1", "x, y", "2001", 180000, 10, True, 0.5, None, 0.2, 100.0, 0.1),
            (2, "t:2", "b", "A", "al1", None, "junk", 240000, 20, False, 0.7, 0.6, 0.3, 260.0, 0.2),
            (3, "t:3", "c", "B", "al2", "", "1999-05", 60000, 30, False, None, 0.4, 0.4, 0.0, 0.3)]
    return spark.createDataFrame(rows, "track_id long, track_uri string, track_name string, artist_name string, "
                                       "album_name string, genres string, release_date string, duration_ms long, "
                                       "popularity int, explicit boolean, energy double, valence double, "
                                       "danceability double, tempo double, acousticness double")


def test_stats_and_features_small(spark):
    lib = _library(spark, [(7, 1, 1, dt.datetime(2024, 3, 2, 23)), (7, 2, 2, dt.datetime(2024, 3, 4, 12)),
                           (7, 3, 3, None), (8, 4, 1, dt.datetime(2024, 4, 1, 1))])
    e = enrich_library(lib, clean_tracks(_tracks(spark)))
    s = {r.user_id: r for r in P.listening_stats(e).collect()}
    assert s[7].total_tracks == 3 and s[7].total_artists == 2 and s[7].total_albums == 2
    assert s[7].total_minutes == 8.0 and s[7].date_range_start == "2024-03-02"
    f = {r.user_id: r for r in P.user_features(e).collect()}
    assert f[7].total_genres == 2 and f[7].genre_diversity == 1.0
    assert f[7].top_genre == "x"  # tie x/y -> smallest name
    assert f[7].repeat_artist_ratio == 0.5
    assert f[7].night_listener_ratio == pytest.approx(1 / 3)
    # median fill: energy of track 3 = median(0.5, 0.7) = 0.6
    assert f[7].avg_energy == pytest.approx((0.5 + 0.7 + 0.6) / 3)


def test_heatmap_full_grid(spark):
    lib = _library(spark, [(7, 1, 1, dt.datetime(2024, 3, 2, 23))])
    e = enrich_library(lib, clean_tracks(_tracks(spark)))
    g = T.hour_heatmap(e).collect()
    assert len(g) == 7
    assert sum(r.h23 for r in g) == 1 and sum(r.h00 for r in g) == 0


def test_empty_library(spark):
    lib = _library(spark, [])
    e = enrich_library(lib, clean_tracks(_tracks(spark)))
    assert P.listening_stats(e).count() == 0
    assert P.listening_stats(e, keys=[]).first().total_tracks == 0


def test_normalise_names_and_genre_literal(spark):
    df = spark.createDataFrame([(1, "['rock', 'indie pop']")], "`Artist Name(s)` int, ` Genres ` string")
    n = normalise_column_names(df)
    assert n.columns == ["artist_name", "genres"]
    assert n.select(parse_genre_literal("genres")).first()[0] == ["rock", "indie pop"]
