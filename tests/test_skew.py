"""A listener holding a third of all rows: results stay exact (SURVEY scale rules)."""

from pyspark.sql import functions as F

from listenlens.operators import profile as P
from listenlens.operators import timeline as T
from listenlens.operators.enrich import enriched
from listenlens.sources.fixtures import Views
from tests.conftest import SF_SMALL


def _skewed(spark):
    e = enriched(Views(spark, SF_SMALL))
    return e.withColumn("user_id", F.when(F.col("add_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))


def test_hot_listener_counts_and_distincts(spark):
    e = _skewed(spark)
    pdf = e.select("user_id", "artist_name", "album_name", "duration_ms").toPandas()
    got = {r.user_id: r for r in P.listening_stats(e).collect()}
    want = pdf.groupby("user_id").agg(n=("artist_name", "size"), a=("artist_name", "nunique"),
                                      al=("album_name", "nunique"))
    assert got[0].total_tracks >= len(pdf) // 3       # the hot listener holds a third
    for uid, row in want.iterrows():
        assert got[uid].total_tracks == row.n
        assert got[uid].total_artists == row.a
        assert got[uid].total_albums == row.al


def test_hot_listener_top_k_exact(spark):
    e = _skewed(spark)
    got = [(r.track_id, r.add_id) for r in P.top_tracks(e, n=10).filter("user_id = 0")
           .orderBy("rank").collect()]
    pdf = e.filter("user_id = 0").select("track_id", "add_id", "popularity").toPandas()
    want = pdf.sort_values(["popularity", "track_id", "add_id"], ascending=[False, True, True]).head(10)
    assert got == list(zip(want.track_id, want.add_id))


def test_hot_listener_modal_genre_and_timeline(spark):
    e = _skewed(spark)
    f = {r.user_id: r for r in P.user_features(e).collect()}
    tags = (e.filter("user_id = 0").select(F.explode("genres_list").alias("g")).toPandas().g
            .value_counts())
    top = sorted(tags[tags == tags.max()].index)[0]
    assert f[0].top_genre == top
    d = T.daily_timeline(e).filter("user_id = 0").toPandas()
    pdf = e.filter("user_id = 0 AND added_date IS NOT NULL").select("added_date").toPandas()
    assert d.tracks.sum() == len(pdf)
    d = d.sort_values("added_date")
    exp = d.tracks.rolling(7, min_periods=1).mean().to_numpy()
    assert all(abs(a - b) < 1e-9 for a, b in zip(d.rolling_avg.to_numpy(), exp))


def test_hot_listener_distributions_match_numpy(spark):
    import numpy as np
    from listenlens.operators import distribution as D
    e = _skewed(spark)
    for col in ("energy", "tempo"):
        x = np.array([r[0] for r in e.filter("user_id = 0").select(F.col(col).cast("double")).collect() if r[0] is not None])
        d = D.describe(e, features=[col]).filter("user_id = 0").first()
        assert d["count"] == len(x) and abs(d["mean"] - x.mean()) < 1e-9 and abs(d["std"] - x.std(ddof=1)) < 1e-9
        q = np.percentile(x, [25, 50, 75])
        assert np.allclose([d["p25"], d["p50"], d["p75"]], q)
        b = D.box_stats(e, features=[col]).filter("user_id = 0").first()
        lo, hi = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
        assert b.outliers == ((x < lo) | (x > hi)).sum() and np.allclose([b.q1, b.median, b.q3], q)
        h = {r.bin: r.n for r in D.histogram(e, features=[col]).filter("user_id = 0").collect()}
        assert sum(h.values()) == len(x) and h[1] == (np.floor((x - x.min()) / (x.max() - x.min()) * 30) == 0).sum()
        got = D.quantiles(D.value_counts(e.filter("user_id = 0"), [], [col]), ["feature"], [0.1, 0.5, 0.9], buckets=5).first()
        assert np.allclose(got.q, np.percentile(x, [10, 50, 90])) and got["count"] == len(x)
