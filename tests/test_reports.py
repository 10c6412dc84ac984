"""Recap sections, training run, counted report, open stream windows, exact quartiles."""

import datetime as dt
import json
import statistics

import pytest
from pyspark.sql import functions as F

from listenlens.operators import distribution as D
from listenlens.operators import mood as M
from listenlens.operators import profile as P
from listenlens.operators import training as TR
from listenlens.operators.enrich import cleaned_tracks, enriched
from listenlens.plans.report import full_report, recap
from listenlens.session import scratch_path
from listenlens.sources.fixtures import Views
from listenlens.sources.ingest import write_counted
from listenlens.streaming.interactions import run_interaction_latest, windowed_scores, interactions_from_events
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def models(spark):
    v = Views(spark, SF_SMALL)
    return TR.train_all(cleaned_tracks(v), v.interactions, rank=4, als_iterations=2, trees=5, depth=3)


def test_training_run_round_trip(spark, models):
    tracks = cleaned_tracks(Views(spark, SF_SMALL))
    folder = scratch_path(spark, "training")
    TR.save_models(models, folder)
    back = TR.load_models(spark, folder)
    a, b = (m.mood.predict(tracks).select("track_id", "cluster").orderBy("track_id").collect() for m in (models, back))
    assert a == b and back.taste.user_factors.count() == models.taste.user_factors.count()
    report = TR.write_training_report(back, tracks, f"{folder}/report").first()
    assert report.tracks_count == tracks.count()
    assert report.models.genre_classifier.estimators == 5
    assert report.models.taste_matcher.factors == 4
    assert report.models.mood_analyzer.fitted is True


def test_report_without_interactions_has_no_taste_entry(spark, models):
    tracks = cleaned_tracks(Views(spark, SF_SMALL))
    only = TR.Models(models.mood, models.genre)
    folder = scratch_path(spark, "training")
    TR.save_models(only, folder)
    assert TR.load_models(spark, folder).taste is None
    report = json.loads(TR.training_report(only, tracks).first().value)
    assert set(report["models"]) == {"mood_analyzer", "genre_classifier"}


def test_recap_has_every_section(spark, models):
    v = Views(spark, SF_SMALL)
    tracks, lib = cleaned_tracks(v), enriched(v)
    row = recap(lib, mood_model=models.mood, genre_probs=models.genre.predict(tracks), taste=models.taste,
                candidates=tracks, n_recommendations=3)
    rows = row.collect()
    assert len(rows) == lib.select("user_id").distinct().count()
    for r in rows:
        assert len(r.mood_profile.cluster_profiles) == models.mood.k
        shares = [x.percentage for x in r.mood_profile.distribution]
        assert shares == sorted(shares, reverse=True) and abs(sum(shares) - 100) < 1e-6
        assert r.mood_profile.dominant_mood == r.mood_profile.distribution[0].mood
        scores = [x.score for x in r.genre_profile.genre_distribution]
        assert scores == sorted(scores, reverse=True)
        assert r.genre_profile.top_genres == [x.genre for x in r.genre_profile.genre_distribution][:10]
        assert [x.rank for x in r.recommendations] == [1, 2, 3]
        assert r.recap_stats.total_tracks == r.stats.total_tracks


def test_summary_and_card_of_a_listener_without_artists(spark):
    lib = enriched(Views(spark, SF_SMALL)).withColumn("artist_name", F.lit(None).cast("string"))
    out = P.profile_summary(lib).collect()
    assert out and all(r.top_artist is None and r.top_artist_tracks == 0 for r in out)
    assert P.top_artist_card(lib).count() == 0
    whole = P.profile_summary(lib, keys=[]).collect()
    assert len(whole) == 1 and whole[0].dominant_mood in D.MOODS


def test_card_words(spark):
    df = spark.createDataFrame([(1, "the who"), (2, "  x y"), (3, " ")], "user_id long, artist_name string") \
        .withColumns({"popularity": F.lit(1), "energy": F.lit(0.1), "valence": F.lit(0.1)})
    out = {r.user_id: (r.headline, r.fun_text) for r in P.top_artist_card(df).collect()}
    assert out[1] == ("THE WHO", "You were in your the era ✨")
    assert out[2] == ("  X Y", "You were in your x era ✨")
    assert out[3] == (" ", "You were in your  era ✨")


def test_write_counted_counts_what_is_written(spark):
    tables = {"a": spark.range(7).toDF("x"), "none": spark.range(0).toDF("x"),
              "b": spark.range(1000).repartition(5).toDF("x")}
    out = write_counted(tables, scratch_path(spark, "counted"))
    assert {n: c for n, (_, c) in out.items()} == {"a": 7, "none": 0, "b": 1000}
    assert spark.read.parquet(out["b"][0]).count() == 1000
    assert write_counted({}, scratch_path(spark, "counted")) == {}


def test_full_report_manifest_rows(spark):
    manifest = full_report(enriched(Views(spark, SF_SMALL)), scratch_path(spark, "full")).collect()
    assert {"box_stats", "tempo_histogram", "mood_scatter", "artist_detail", "missing_report"} <= {r.table for r in manifest}
    for r in manifest:
        assert spark.read.parquet(r.path).count() == r.rows


@pytest.mark.parametrize("keys", [["user_id"], []])
def test_quartiles_of_one_dominant_value(spark, keys):
    values = [0.5] * 400 + [i / 97 for i in range(97)] + [None] * 5
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 0.25)], "user_id long, energy double")
    out = D.describe(df, keys, ["energy"]).collect()
    box = D.box_stats(df, keys, ["energy"]).collect()
    groups = {(1,): [v for v in values if v is not None], (2,): [0.25]}
    if not keys:
        groups = {(): groups[(1,)] + [0.25]}
    assert len(out) == len(box) == len(groups)
    for r, b in zip(sorted(out), sorted(box)):
        g = groups[tuple(r[k] for k in keys)]
        want = statistics.quantiles(g, n=4, method="inclusive") if len(g) > 1 else g * 3
        assert [r.p25, r.p50, r.p75] == pytest.approx(want)
        assert r["count"] == len(g) and (r["min"], r["max"]) == (min(g), max(g))
    assert D.describe(df.limit(0), keys, ["energy"]).count() == 0


def test_pair_points_hold_every_pair(spark):
    out = D.pair_points(enriched(Views(spark, SF_SMALL)), n=3)
    per = out.groupBy("user_id", "add_id").count().collect()
    assert per and {r["count"] for r in per} == {10}


def _events(spark, rows, path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, t, u, k, 0.0, "") for i, t, u, k in rows], schema).coalesce(1).write.mode("append").parquet(path)


def test_open_windows_and_restart(spark):
    folder, out = scratch_path(spark, "k1-in"), scratch_path(spark, "k1-out")
    day = dt.datetime(2024, 1, 1)
    first = [(i, day + dt.timedelta(minutes=37 * i), i % 3, "purchase" if i % 2 else "view") for i in range(30)]
    _events(spark, first, folder)
    seen = run_interaction_latest(spark, folder, 50, file_glob="*.parquet", out=out)

    def want(rows):
        _events(spark, rows, p := scratch_path(spark, "k1-batch"))
        return sorted(windowed_scores(interactions_from_events(spark.read.parquet(p), 50)).collect())
    assert sorted(seen.collect()) == want(first)
    # later files of the last window: the stream goes on and its rows replace the earlier ones
    more = [(i, day + dt.timedelta(minutes=37 * i), i % 3, "signup") for i in range(30, 40)]
    _events(spark, more, folder)
    again = run_interaction_latest(spark, folder, 50, file_glob="*.parquet", out=out)
    assert sorted(again.collect()) == want(first + more)


def test_no_events_no_windows(spark):
    folder = scratch_path(spark, "k1-in")
    _events(spark, [], folder)
    assert run_interaction_latest(spark, folder, 50, file_glob="*.parquet").count() == 0


def test_mood_profile_without_clusters(spark):
    out = M.mood_profile(M.QuadrantMood(), enriched(Views(spark, SF_SMALL)))
    assert "cluster_profiles" not in out.columns
    for r in out.collect():
        assert 2 <= len(r.insights) <= 4 and len(r.distribution) == 4
