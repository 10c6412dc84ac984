"""Plan properties that matter at scale: pruning, partial aggregation, partial top-k."""

import contextlib
import io

import __spark_entry__ as E
from tests.conftest import SF_SMALL

Q = E.queries()


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_scan_is_pruned_and_aggregation_is_partial(spark):
    p = _plan(Q["listening_stats"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in p
    assert "partial_count" in p and "partial_sum" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_k_per_listener_is_limited_before_the_shuffle(spark):
    p = _plan(Q["top_tracks"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p
    part = p.index("Partial")
    exch = p.index("Exchange hashpartitioning(user_id")
    assert part > exch  # printed below the exchange = runs before it


def test_modal_values_aggregate_partially(spark):
    p = _plan(Q["user_features"](spark, SF_SMALL))
    assert "partial_min_by" in p


def test_no_cartesian_products_anywhere(spark):
    for name in ["user_features", "hour_heatmap", "feature_histograms", "box_stats",
                 "percent_rank_empirical", "percentiles_measured", "summary_card",
                 "genre_match_tags", "recent_taste_scores"]:
        p = _plan(Q[name](spark, SF_SMALL))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_period_bounds_are_pushed_into_the_scan(spark):
    p = _plan(Q["listening_stats_period"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(ts," in p and "LessThan(ts," in p


def test_approx_distinct_close_to_exact(spark):
    from listenlens.operators import profile as P
    from listenlens.operators.enrich import enriched
    from listenlens.sources.fixtures import Views
    e = enriched(Views(spark, SF_SMALL))
    a = {r.user_id: r for r in P.listening_stats(e).collect()}
    b = {r.user_id: r for r in P.listening_stats(e, approx_distinct=True).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k].total_artists - b[k].total_artists) <= max(1, 0.05 * a[k].total_artists)
               for k in a)
    assert "approx_count_distinct" in _plan(P.listening_stats(e, approx_distinct=True)) or \
        "HyperLogLogPlusPlus" in _plan(P.listening_stats(e, approx_distinct=True))


def test_raw_rows_do_not_feed_the_joins_of_distributions(spark):
    """Every exchange below the range and quartile joins carries value counts."""
    for name in ("feature_histograms", "tempo_histogram", "box_stats", "describe_features"):
        p = _plan(Q[name](spark, SF_SMALL))
        join = p[p.index("Join"):]
        assert join.count("partial_count(1)") >= 1, name
        assert "value#" in join.split("Exchange hashpartitioning(")[1].split("\n")[0] or "partial" in join, name
