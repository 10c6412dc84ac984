"""Music views derived from the given tables.

The given tables hold no music data, so ``tracks``, ``library`` and
``interactions`` are derived deterministically from ``part`` and ``events``.
One SQL text serves both Spark (``spark.sql`` with DataFrame arguments) and
the DuckDB oracle (as CTEs over the registered raw views), so both sides see
identical rows.  The track count is a scalar subquery: Spark computes it once
and inlines it as a literal, no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlens.sources.tables import read_table

TRACKS_SQL = """
SELECT p_partkey AS track_id,
       concat('track:', CAST(p_partkey AS STRING)) AS track_uri,
       p_name AS track_name, p_brand AS artist_name,
       concat(p_brand, ' / ', p_type) AS album_name,
       CASE WHEN p_partkey % 37 = 0 THEN NULL
            WHEN p_partkey % 41 = 0 THEN ''
            ELSE concat(lower(p_type), ', ', replace(p_name, ' ', ' , ')) END AS genres,
       CASE WHEN p_partkey % 53 = 0 THEN 'n/a'
            WHEN p_partkey % 3 = 0 THEN CAST(1960 + p_partkey % 64 AS STRING)
            WHEN p_partkey % 3 = 1 THEN concat(CAST(1960 + p_partkey % 64 AS STRING), '-07')
            ELSE concat(CAST(1960 + p_partkey % 64 AS STRING), '-07-15') END AS release_date,
       120000 + (p_partkey * 7919) % 240000 AS duration_ms,
       CAST(p_partkey % 101 AS INT) AS popularity,
       (p_partkey % 4 = 0) AS explicit,
       CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE ((p_partkey % 10) * 80 + (p_partkey * 7919) % 200) / 1000 END AS energy,
       CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE ((p_partkey % 100 - p_partkey % 10) * 8 + (p_partkey * 104729) % 200) / 1000 END AS valence,
       ((p_partkey % 7) * 100 + (p_partkey * 1299709) % 300) / 1000 AS danceability,
       60 + ((p_partkey * 15485863) % 1400) / 10 AS tempo,
       ((9 - p_partkey % 10) * 80 + (p_partkey * 611953) % 200) / 1000 AS acousticness,
       -1 * ((p_partkey * 3571) % 2000) / 100 AS loudness,
       ((p_partkey * 2749) % 500) / 1000 AS speechiness,
       ((p_partkey * 5051) % 1000) / 1000 AS instrumentalness,
       ((p_partkey * 6367) % 1000) / 1000 AS liveness,
       CAST(p_partkey % 12 AS INT) AS key,
       CAST(p_partkey % 2 AS INT) AS mode,
       CAST(3 + p_partkey % 3 AS INT) AS time_signature
FROM {part}
"""

# {n_tracks} is the number of tracks: the oracle fills in a scalar subquery over
# ``part``; Spark binds the value once per session (a footer-only Parquet count),
# so the queries carry no subquery job for it.
_TRACK_OF_EVENT = ("CASE WHEN event_id % 5 = 0 THEN (event_id * 31) % {n_tracks} "
                   "ELSE ((event_id * 31) % CAST({n_tracks} / 10 AS BIGINT)) * 10 "
                   "+ user_id % 10 END")

LIBRARY_SQL = f"""
SELECT event_id AS add_id, user_id, {_TRACK_OF_EVENT} AS track_id,
       CASE WHEN event_id % 97 = 0 THEN NULL
            ELSE ts - INTERVAL '1' DAY * CAST(event_id % 360 AS INT) END AS added_at
FROM {{events}}
"""

INTERACTIONS_SQL = f"""
SELECT user_id, {_TRACK_OF_EVENT} AS track_id,
       CASE event_type WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'replay'
                       WHEN 'error' THEN 'skip' ELSE 'listen' END AS interaction_type,
       CAST(1 + event_id % 4 AS INT) AS count,
       CASE WHEN event_type = 'error' THEN 1000 + (event_id * 37) % 29000
            ELSE 30000 + (event_id * 37) % 200000 END AS duration_ms,
       ts
FROM {{events}}
"""

VIEW_SQL = {"tracks": TRACKS_SQL, "library": LIBRARY_SQL, "interactions": INTERACTIONS_SQL}


def oracle_ctes(*names: str) -> str:
    """``WITH`` clause defining the named views over the raw oracle tables."""
    parts = []
    for n in names:
        body = VIEW_SQL[n].format(part="part", events="events",
                                  n_tracks="(SELECT count(*) FROM part)")
        parts.append(f"{n} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"


class Views:
    """Lazily built fixture views for one scale-factor directory.

    Instances are shared per (session, directory), so the DataFrame plans
    (not data) are analysed once and reused by every query of a session.
    """

    _instances: dict = {}

    def __new__(cls, spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"))
        inst = cls._instances.get(key)
        if inst is None:
            inst = super().__new__(cls)
            inst.spark, inst.sf_dir = spark, sf_dir.rstrip("/")
            inst._cache, inst._tables, inst.memo = {}, {}, {}
            cls._instances[key] = inst
        return inst

    def __init__(self, spark: SparkSession, sf_dir: str):
        pass

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.sf_dir, name)
        return self._tables[name]

    @property
    def n_tracks(self) -> int:
        if "n_tracks" not in self.memo:
            self.memo["n_tracks"] = self.table("part").count()
        return self.memo["n_tracks"]

    def _view(self, name: str) -> DataFrame:
        if name not in self._cache:
            args = {"part": self.table("part")} if name == "tracks" else {
                "events": self.table("events"), "n_tracks": self.n_tracks}
            self._cache[name] = self.spark.sql(VIEW_SQL[name], **args)
        return self._cache[name]

    @property
    def tracks(self) -> DataFrame:
        return self._view("tracks")

    @property
    def library(self) -> DataFrame:
        return self._view("library")

    @property
    def interactions(self) -> DataFrame:
        return self._view("interactions")

    def library_between(self, ts_from: str, ts_to: str) -> DataFrame:
        """The library of events with ``ts_from <= ts < ts_to`` (a recap period).

        The bounds filter the raw ``events.ts`` column, so Catalyst pushes them
        into the Parquet scan (row-group skipping by min/max statistics)."""
        key = ("library_between", ts_from, ts_to)
        if key not in self.memo:
            ev = self.table("events").filter(
                (F.col("ts") >= F.lit(ts_from).cast("timestamp_ntz")) &
                (F.col("ts") < F.lit(ts_to).cast("timestamp_ntz")))
            self.memo[key] = self.spark.sql(VIEW_SQL["library"], events=ev,
                                            n_tracks=self.n_tracks)
        return self.memo[key]

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    @property
    def events(self) -> DataFrame:
        return self.table("events")
