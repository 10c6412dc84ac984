"""Registered personality and card queries (I16-I19, B13, E5, J2-J4) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlens.operators import personality as PE
from listenlens.operators import profile as P
from listenlens.operators.common import join_on_keys
from listenlens.operators.enrich import enriched
from listenlens.plans.catalog import register, round_doubles
from listenlens.plans.q_profile import D1_BODY, D2_CTES
from listenlens.plans.sqltext import rh, rq, with_enriched
from listenlens.sources.fixtures import Views


def _features(spark, sf_dir):
    e = enriched(Views(spark, sf_dir))
    return e, P.user_features(e)


def _d(v) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def phi_sql(z: str) -> str:
    """SQL twin of columns.normal_cdf (A&S 7.1.26)."""
    from listenlens.functions.columns import _AS_A, _AS_P
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + {_d(_AS_P)} * {x}))"
    a1, a2, a3, a4, a5 = (_d(a) for a in _AS_A)
    poly = f"((((({a5} * {t} + {a4}) * {t} + {a3}) * {t} + {a2}) * {t} + {a1}) * {t})"
    erf = f"(1.0 - {poly} * exp(-{x} * {x}))"
    return f"(0.5 * (1.0 + sign({z}) * {erf}))"


def _pct_sql(feat: str, mean: float, std: float) -> str:
    x = f"coalesce({feat}, {_d(mean)})"
    z = f"(({x} - {_d(mean)}) / {_d(std)})" if std > 0 else "0.0"
    return rh(f"{phi_sql(z)} * 100", 1)


PCT_CTE = ",\npcts AS (SELECT user_id, " + ", ".join(
    f"{_pct_sql(f, m, s)} AS {f}_pct" for f, (m, s) in PE.DEFAULT_POPULATION_STATS.items()
) + " FROM user_features)\n"


@register("percentiles", with_enriched() + D2_CTES + PCT_CTE + "SELECT * FROM pcts")
def q_percentiles(spark, sf_dir):
    """I16 with the fixed population statistics."""
    _, uf = _features(spark, sf_dir)
    return PE.percentiles(uf)


_PR_FEATS = list(PE.DEFAULT_POPULATION_STATS)


@register("percent_rank_empirical", with_enriched() + D2_CTES + f"""
, w AS (SELECT user_id, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in _PR_FEATS)} FROM user_features),
l AS (SELECT * FROM (UNPIVOT w ON {", ".join(_PR_FEATS)} INTO NAME feature VALUE value) WHERE value IS NOT NULL)
SELECT user_id, feature, {rq('value')} AS value,
       {rq('percent_rank() OVER (PARTITION BY feature ORDER BY value)')} AS percent_rank
FROM l
""")
def q_percent_rank_empirical(spark, sf_dir):
    """E5: exact percent_rank of each listener among all listeners, per feature."""
    _, uf = _features(spark, sf_dir)
    return round_doubles(PE.global_percent_rank(uf, _PR_FEATS))


def _score_sql():
    gd, rr, nr = "coalesce(genre_diversity, 0.0)", "coalesce(repeat_artist_ratio, 0.0)", \
        "coalesce(night_listener_ratio, 0.0)"
    e, v, d, a = ("coalesce(avg_energy, 0.5)", "coalesce(avg_valence, 0.5)",
                  "coalesce(avg_danceability, 0.5)", "coalesce(avg_acousticness, 0.5)")
    return {
        "explorer": f"{gd} * 3 + (1 - {rr}) * 2",
        "loyalist": f"{rr} * 3 + (1 - {gd}) * 2",
        "night_owl": f"{nr} * 5",
        "party_animal": f"{e} * 2 + {d} * 2 + {v}",
        "chill_seeker": f"{a} * 2 + (1 - {e}) * 2 + (1 - {d})",
        "mood_rider": f"abs({v} - 0.5) * 2",
    }


def _case_map(idx: int) -> str:
    return "CASE type_id " + " ".join(
        f"WHEN '{k}' THEN '{t[idx]}'" for k, t in PE.USER_TYPES.items()) + " END"


_TRAITS = "CASE type_id " + " ".join(
    f"WHEN '{k}' THEN '{' • '.join(t[3])}'" for k, t in PE.USER_TYPES.items()) + " END"
_SC = _score_sql()
_BEST = "greatest(" + ", ".join(f"score_{k}" for k in PE.TYPE_ORDER) + ")"
TYPES_CTE = f""",
sc AS (SELECT user_id, {", ".join(f"{v} AS score_{k}" for k, v in _SC.items())} FROM user_features),
ty AS (SELECT *, CASE {" ".join(f"WHEN score_{k} = {_BEST} THEN '{k}'" for k in PE.TYPE_ORDER)} END AS type_id,
              {_BEST} / ({" + ".join(f"score_{k}" for k in PE.TYPE_ORDER)}) AS confidence FROM sc)
"""


@register("personality", with_enriched() + D2_CTES + TYPES_CTE + f"""
SELECT user_id, type_id, {_case_map(0)} AS type_name, {_case_map(1)} AS emoji,
       {_case_map(2)} AS description, {_TRAITS} AS traits, {rq('confidence')} AS confidence,
       {", ".join(f"{rq('score_' + k)} AS score_{k}" for k in PE.TYPE_ORDER)}
FROM ty
""")
def q_personality(spark, sf_dir):
    """Rule-based listener type per listener."""
    _, uf = _features(spark, sf_dir)
    out = PE.classify(uf).withColumn("traits", F.array_join("traits", " • "))
    return round_doubles(out)


def _p0(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def _txt(key: str, *vals: str) -> str:
    parts = PE.INSIGHT_TEXTS[key].replace("'", "''").split("{}")
    out = f"'{parts[0]}'"
    for v, rest in zip(vals, parts[1:]):
        out += f" || {v} || '{rest}'"
    return out


_INSIGHT_SLOTS = [
    f"CASE WHEN avg_energy_pct > 75 THEN {_txt('energy_high', _p0('100 - avg_energy_pct'))} "
    f"WHEN avg_energy_pct < 25 THEN {_txt('energy_low', _p0('avg_energy_pct'))} END",
    f"CASE WHEN genre_diversity_pct > 80 THEN {_txt('diversity_high', _p0('genre_diversity_pct'))} "
    f"WHEN genre_diversity_pct < 20 THEN {_txt('diversity_low')} END",
    f"CASE WHEN night_listener_ratio_pct > 70 THEN {_txt('night_high', _p0('100 - night_listener_ratio_pct'))} END",
    f"CASE WHEN repeat_artist_ratio_pct > 70 THEN {_txt('repeat_high', _p0('repeat_artist_ratio_pct'))} END",
    f"CASE WHEN avg_danceability_pct > 75 THEN {_txt('dance_high', _p0('avg_danceability_pct'))} END",
    f"CASE WHEN avg_valence_pct > 70 THEN {_txt('valence_high', _p0('avg_valence_pct'))} "
    f"WHEN avg_valence_pct < 30 THEN {_txt('valence_low')} END",
]


@register("listening_insights", with_enriched() + D2_CTES + PCT_CTE + """
, s AS (""" + "\nUNION ALL ".join(
    f"SELECT user_id, {i} AS slot, {expr} AS insight FROM pcts" for i, expr in enumerate(_INSIGHT_SLOTS)) + """)
SELECT user_id, insight, CAST(row_number() OVER (PARTITION BY user_id ORDER BY slot) AS INTEGER) AS insight_no
FROM s WHERE insight IS NOT NULL
""")
def q_listening_insights(spark, sf_dir):
    """Insight sentences per listener."""
    _, uf = _features(spark, sf_dir)
    return PE.insights(PE.percentiles(uf))


def _cmp_sql():
    sel = []
    for i, (metric, feat, default) in enumerate(PE.COMPARISON_METRICS, start=1):
        p = f"coalesce(p.{feat}_pct, 50.0)"
        label = (f"CASE WHEN {p} > 50 THEN 'Top ' || {_p0('100 - ' + p)} || '%' "
                 f"ELSE 'Bottom ' || {_p0(p)} || '%' END")
        sel.append(f"SELECT u.user_id, {i} AS metric_no, '{metric}' AS metric, "
                   f"{rq(f'coalesce(CAST(u.{feat} AS DOUBLE), {_d(default)})')} AS value, "
                   f"{p} AS percentile, {label} AS label "
                   f"FROM user_features u JOIN pcts p ON u.user_id = p.user_id")
    return "\nUNION ALL\n".join(sel)


@register("comparison_stats", with_enriched() + D2_CTES + PCT_CTE + _cmp_sql())
def q_comparison_stats(spark, sf_dir):
    """Four comparison rows per listener."""
    _, uf = _features(spark, sf_dir)
    return round_doubles(PE.comparison_stats(uf))


@register("vibe", with_enriched() + D2_CTES + """
SELECT user_id,
  CASE WHEN coalesce(avg_energy, 0.5) > 0.6 AND coalesce(avg_valence, 0.5) > 0.5 THEN 'HIGH ENERGY'
       WHEN coalesce(avg_energy, 0.5) > 0.6 THEN 'INTENSE'
       WHEN coalesce(avg_valence, 0.5) > 0.5 THEN 'GOOD VIBES' ELSE 'IN YOUR FEELS' END AS vibe,
  CASE WHEN coalesce(avg_energy, 0.5) > 0.6 AND coalesce(avg_valence, 0.5) > 0.5 THEN 'You kept the party going all year 🔥'
       WHEN coalesce(avg_energy, 0.5) > 0.6 THEN 'Raw power defined your year ⚡'
       WHEN coalesce(avg_valence, 0.5) > 0.5 THEN 'Positivity was your soundtrack 😊'
       ELSE 'You embraced the emotions 🌙' END AS vibe_subtitle
FROM user_features
""")
def q_vibe(spark, sf_dir):
    """Vibe label and subtitle per listener."""
    _, uf = _features(spark, sf_dir)
    return PE.vibe(uf)


def _int_pct(c: str) -> str:
    return f"CAST(CAST(trunc(coalesce({c}, 0.5) * 100) AS INTEGER) AS VARCHAR)"


@register("personality_why", with_enriched() + D2_CTES + TYPES_CTE + f"""
SELECT u.user_id, ty.type_id,
  CASE ty.type_id
    WHEN 'party_animal' THEN 'Your music is ' || {_int_pct('u.avg_danceability')} || '% danceable, '
         || {_int_pct('u.avg_energy')} || '% energetic, and ' || {_int_pct('u.avg_valence')} || '% happy!'
    WHEN 'night_owl' THEN 'You add ' || {_int_pct('u.night_listener_ratio')} || '% of your music between 10PM-6AM 🌙'
    WHEN 'explorer' THEN 'You explore ' || CAST(coalesce(u.total_genres, 0) AS VARCHAR) || ' different genres - that''s variety!'
    WHEN 'loyalist' THEN 'You come back to ' || {_int_pct('u.repeat_artist_ratio')} || '% of your artists - you know what you love!'
    WHEN 'chill_seeker' THEN 'Your music is ' || {_int_pct('u.avg_acousticness')} || '% acoustic and only '
         || {_int_pct('u.avg_energy')} || '% energetic - you keep it mellow'
    ELSE 'Your happiness ranges widely - you ride the emotional waves' END AS why
FROM user_features u JOIN ty ON u.user_id = ty.user_id
""")
def q_personality_why(spark, sf_dir):
    """Explanation line per listener."""
    _, uf = _features(spark, sf_dir)
    return PE.why_text(uf)


@register("summary_card", with_enriched() + D2_CTES + TYPES_CTE + f"""
, d1 AS ({D1_BODY}),
ta AS (SELECT user_id, artist_name, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, artist_name) AS rk
       FROM (SELECT user_id, artist_name, count(*) AS n FROM enriched WHERE artist_name IS NOT NULL GROUP BY ALL))
SELECT d1.user_id, d1.total_tracks AS songs, CAST(round_even(d1.total_hours, 0) AS BIGINT) AS hours,
       d1.total_artists AS artists, coalesce(ta.artist_name, 'Unknown') AS top_artist,
       {_case_map(0).replace('type_id', 'ty.type_id')} AS type_name,
       {_case_map(1).replace('type_id', 'ty.type_id')} AS emoji
FROM d1 JOIN ty ON d1.user_id = ty.user_id LEFT JOIN ta ON d1.user_id = ta.user_id AND ta.rk = 1
""")
def q_summary_card(spark, sf_dir):
    """Songs, hours, artists, top artist, personality per listener."""
    e, uf = _features(spark, sf_dir)
    return summary_card(e, uf)


def summary_card(e, uf, keys=("user_id",)):
    keys = list(keys)
    d1 = P.listening_stats(e, keys)
    top1 = P.top_artists(e, keys, n=1).select(*keys, F.col("artist_name").alias("top_artist"))
    ty = PE.classify(uf, keys).select(*keys, "type_name", "emoji")
    out = join_on_keys(join_on_keys(d1, ty, keys), top1, keys, "left")
    return out.select(*keys, F.col("total_tracks").alias("songs"),
                      F.bround("total_hours", 0).cast("bigint").alias("hours"),
                      F.col("total_artists").alias("artists"),
                      F.coalesce("top_artist", F.lit("Unknown")).alias("top_artist"),
                      "type_name", "emoji")


@register("top_artist_card", with_enriched() + """
, a AS (SELECT user_id, artist_name, count(*) AS n FROM enriched WHERE artist_name IS NOT NULL GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, artist_name) AS rk FROM a)
SELECT user_id, upper(artist_name) AS headline, n AS track_count,
       'You were in your ' || regexp_extract(artist_name, '\\S+') || ' era ✨' AS fun_text
FROM t WHERE rk = 1
""")
def q_top_artist_card(spark, sf_dir):
    """The first artist's card per listener (capitals, first word)."""
    return P.top_artist_card(enriched(Views(spark, sf_dir)))


@register("top5_artist_bars", with_enriched() + f"""
, a AS (SELECT user_id, artist_name, count(*) AS track_count FROM enriched WHERE artist_name IS NOT NULL GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY track_count DESC, artist_name) AS INTEGER) AS rank FROM a),
t AS (SELECT * FROM r WHERE rank <= 5)
SELECT user_id, rank, artist_name, track_count,
       {rq('track_count / max(track_count) OVER (PARTITION BY user_id) * 100')} AS bar_pct
FROM t
""")
def q_top5_artist_bars(spark, sf_dir):
    """J3 (E2, E3): top-5 artists with rank and bar width relative to the first."""
    e = enriched(Views(spark, sf_dir))
    return round_doubles(top5_artist_bars(e))


def top5_artist_bars(e, keys=("user_id",)):
    from pyspark.sql import Window
    keys = list(keys)
    t = P.top_artists(e, keys, n=5).select(*keys, "rank", "artist_name", "track_count")
    w = Window.partitionBy(*keys)
    return t.withColumn("bar_pct", F.col("track_count") / F.max("track_count").over(w) * 100)


@register("top5_genre_bars", with_enriched() + f"""
, c AS (SELECT user_id, genre, count(*) AS n
        FROM (SELECT user_id, unnest(genres_list) AS genre FROM enriched) GROUP BY ALL),
p AS (SELECT user_id, genre, n / sum(n) OVER (PARTITION BY user_id) * 100 AS percentage,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS INTEGER) AS rank FROM c)
SELECT user_id, rank, genre, {rq('percentage')} AS percentage, {rq('percentage * 2')} AS bar_pct
FROM p WHERE rank <= 5
""")
def q_top5_genre_bars(spark, sf_dir):
    """Top-5 genres with share and bar width (2 x share)."""
    e = enriched(Views(spark, sf_dir))
    g = P.genre_distribution(e, top=5).select("user_id", "rank", "genre", "percentage")
    return round_doubles(g.withColumn("bar_pct", F.col("percentage") * 2))


def _measured_pct_sql() -> str:
    parts = []
    for f in PE.DEFAULT_POPULATION_STATS:
        z = f"CASE WHEN s.s_{f} > 0 THEN (coalesce(u.{f}, s.m_{f}) - s.m_{f}) / s.s_{f} ELSE 0.0 END"
        parts.append(f"{rh(phi_sql(z) + ' * 100', 1)} AS {f}_pct")
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in PE.DEFAULT_POPULATION_STATS)
    return (f", pop AS (SELECT {stats} FROM user_features)\n"
            f"SELECT u.user_id, {', '.join(parts)} FROM user_features u, pop s")


@register("percentiles_measured", with_enriched() + D2_CTES + _measured_pct_sql())
def q_percentiles_measured(spark, sf_dir):
    """I16 + C9: percentiles against the population measured over all listeners."""
    _, uf = _features(spark, sf_dir)
    return PE.percentiles_measured(uf)
