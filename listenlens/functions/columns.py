"""Scalar column expressions shared by the operators.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen.  Fixed values that results depend on are grouped at the top.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
AUDIO_FEATURES = ["danceability", "energy", "key", "loudness", "mode", "speechiness",
                  "acousticness", "instrumentalness", "liveness", "valence", "tempo",
                  "time_signature"]
MOOD_FEATURES = ["energy", "valence", "danceability", "tempo", "acousticness"]
GENRE_MODEL_FEATURES = ["energy", "valence", "danceability", "tempo", "acousticness",
                        "loudness", "speechiness", "instrumentalness"]
INTERACTION_WEIGHTS = {"listen": 1.0, "save": 2.0, "replay": 1.5, "skip": -1.0}
DEFAULT_INTERACTION_WEIGHT = 1.0
SKIP_THRESHOLD_MS = 30000
NIGHT_START_HOUR, NIGHT_END_HOUR = 22, 6
WEEKEND_DAYS = (5, 6)  # Monday = 0
DEFAULT_DURATION_MIN = 3.5

# Abramowitz & Stegun 7.1.26 coefficients for erf (public, |error| <= 1.5e-7)
_AS_P = 0.3275911
_AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Cleaning (B1-B7)
# ---------------------------------------------------------------------------
def strip_ws(c) -> Column:
    """Python's str.strip(): leading/trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(col_or(c), r"^\s+|\s+$", "")


def parse_genres(c="genres") -> Column:
    """null / '' -> []; else split on ',' and strip each token (blank tokens kept)."""
    g = col_or(c)
    return (F.when(g.isNull() | (g == ""), F.array().cast("array<string>"))
            .otherwise(F.transform(F.split(g, ","), strip_ws)))


def primary_genre(genres_list="genres_list") -> Column:
    return F.coalesce(F.try_element_at(col_or(genres_list), F.lit(1)), F.lit("unknown"))


def parse_timestamp(c) -> Column:
    """Coerce to timestamp: strings that do not parse become null."""
    return F.try_to_timestamp(col_or(c).cast("string"))


def release_year(c="release_date") -> Column:
    """Year of a full or partial ISO date ('2020', '2020-05', '2020-05-01'); junk -> null."""
    return F.year(F.expr(f"try_cast({c} AS DATE)") if isinstance(c, str)
                  else F.try_to_date(col_or(c)))


def to_bool(c) -> Column:
    """Parsed boolean; unparseable and null -> False."""
    return F.coalesce(F.expr(f"try_cast(`{c}` AS BOOLEAN)"), F.lit(False))


def is_weekend(day) -> Column:
    return F.coalesce(col_or(day).isin(*WEEKEND_DAYS), F.lit(False))


def is_night(hour) -> Column:
    h = col_or(hour)
    return F.coalesce((h >= NIGHT_START_HOUR) | (h < NIGHT_END_HOUR), F.lit(False))


# ---------------------------------------------------------------------------
# Labels and weights
# ---------------------------------------------------------------------------
def mood_quadrant(energy="energy", valence="valence") -> Column:
    e, v = col_or(energy), col_or(valence)
    return (F.when((e > 0.5) & (v > 0.5), "Happy & Energetic")
            .when(e > 0.5, "Angry & Intense")
            .when(v > 0.5, "Peaceful & Happy")
            .otherwise("Sad & Calm"))


def vibe_label(energy="avg_energy", valence="avg_valence") -> Column:
    e, v = col_or(energy), col_or(valence)
    return (F.when((e > 0.6) & (v > 0.5), "HIGH ENERGY").when(e > 0.6, "INTENSE")
            .when(v > 0.5, "GOOD VIBES").otherwise("IN YOUR FEELS"))


def vibe_subtitle(energy="avg_energy", valence="avg_valence") -> Column:
    e, v = col_or(energy), col_or(valence)
    return (F.when((e > 0.6) & (v > 0.5), "You kept the party going all year 🔥")
            .when(e > 0.6, "Raw power defined your year ⚡")
            .when(v > 0.5, "Positivity was your soundtrack 😊")
            .otherwise("You embraced the emotions 🌙"))


def cluster_label(energy, valence, danceability, acousticness) -> Column:
    """Mood-cluster label from a cluster's average raw features."""
    e, v, d, a = map(col_or, (energy, valence, danceability, acousticness))
    return (F.when((e > 0.7) & (v > 0.6), "high_energy_happy")
            .when((e < 0.4) & (v < 0.4), "sad_melancholic")
            .when(a > 0.6, "acoustic_folk")
            .when(d > 0.7, "upbeat_dance")
            .when((e > 0.6) & (v < 0.4), "dark_intense")
            .otherwise("chill_mellow"))


def interaction_weight(itype="interaction_type") -> Column:
    t = col_or(itype)
    expr = None
    for name, w in INTERACTION_WEIGHTS.items():
        expr = (F.when(t == name, F.lit(w)) if expr is None
                else expr.when(t == name, F.lit(w)))
    return expr.otherwise(F.lit(DEFAULT_INTERACTION_WEIGHT))


def derive_skip(itype="interaction_type", duration_ms="duration_ms") -> Column:
    """A 'listen' shorter than 30 s counts as a skip."""
    t, d = col_or(itype), col_or(duration_ms)
    return F.when((t == "listen") & (d < SKIP_THRESHOLD_MS), F.lit("skip")).otherwise(t)


# ---------------------------------------------------------------------------
# Maths
# ---------------------------------------------------------------------------
def round_half_up(c, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE steps in Spark and the oracle."""
    s = float(10 ** digits)
    return F.floor(col_or(c) * F.lit(s) + F.lit(0.5)) / F.lit(s)


ORACLE_DIGITS = 9


def rq(c) -> Column:
    """Rounding applied to order-dependent floating results before comparison."""
    return round_half_up(c, ORACLE_DIGITS)


def normal_cdf(z) -> Column:
    """Standard normal CDF via A&S 7.1.26 erf (no erf in Spark SQL)."""
    z = col_or(z)
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_AS_P) * x)
    a1, a2, a3, a4, a5 = (F.lit(a) for a in _AS_A)
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(z) * erf)


def dot(cols_a, cols_b) -> Column:
    return reduce(lambda x, y: x + y, [col_or(a) * col_or(b) for a, b in zip(cols_a, cols_b)])


def norm(cols) -> Column:
    return F.sqrt(dot(cols, cols))


def cosine(cols_a, cols_b) -> Column:
    """Cosine of two vectors given as column lists; zero norm -> null."""
    return F.try_divide(dot(cols_a, cols_b), norm(cols_a) * norm(cols_b))


def array_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_or(a), col_or(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def array_norm(a) -> Column:
    return F.sqrt(array_dot(a, a))


def format_fixed(c, digits: int) -> Column:
    """Python's ``f'{x:.<digits>f}'``: half-even rounding, then fixed digits."""
    return F.format_string(f"%.{digits}f", F.bround(col_or(c), digits))


def format_pct0(c) -> Column:
    """Python's ``f'{x:.0f}'`` for the values used here: half-even to an integer."""
    return F.bround(col_or(c), 0).cast("bigint").cast("string")
