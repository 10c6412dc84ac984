"""Registered queries: name -> Spark callable (spark, sf_dir) and DuckDB oracle text.

Every query reads the given tables (through the fixture views) and runs over
them whole.  Floating results that depend on summation order are rounded to
9 decimals on both sides; rounding is half-up via floor(x*10^d+0.5) so both
engines take the same IEEE steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from listenlens.plans import (q_profile, q_timeline, q_distribution,  # noqa: F401
                                  q_personality, q_taste, q_models, q_stream,
                                  q_sources)


def round_doubles(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column half-up (see module doc); for oracle comparison."""
    from listenlens.functions.columns import round_half_up
    return df.withColumns({f.name: round_half_up(f.name, digits)
                           for f in df.schema.fields if f.dataType.simpleString() == "double"})
