"""All models in one run, their files and the JSON report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlens.operators import genre as G
from listenlens.operators import mood as M
from listenlens.operators import taste as TA
from listenlens.operators.common import join_on_keys


@dataclass
class Models:
    """The fitted models of a run; ``taste`` is None where no interactions were given."""

    mood: M.MoodModel
    genre: G.GenreModel
    taste: TA.TasteModel | None = None


def train_all(tracks: DataFrame, interactions: DataFrame | None = None, rank: int = 50, als_iterations: int = 15,
              reg: float = 0.01, clusters: int = 4, trees: int = 100, depth: int = 15, seed: int = 42) -> Models:
    """Fit the mood clusters and the genre forest on cleaned tracks and, given raw
    interactions, the taste factors.  The fits run in sequence, each over the whole cluster."""
    taste = None
    if interactions is not None:
        taste = TA.train_taste(TA.interaction_matrix(interactions), rank, als_iterations, reg, seed)
    return Models(M.fit_mood(tracks, k=clusters, seed=seed), G.fit_genre(tracks, trees, depth, seed), taste)


def save_models(models: Models, folder: str) -> None:
    """One folder a model under ``folder``."""
    M.save_mood(models.mood, f"{folder}/mood")
    G.save_genre(models.genre, f"{folder}/genre")
    if models.taste is not None:
        models.taste.save(f"{folder}/taste")


def load_models(spark: SparkSession, folder: str) -> Models:
    from listenlens.session import path_exists
    taste = TA.TasteModel.load(spark, f"{folder}/taste") if path_exists(spark, f"{folder}/taste") else None
    return Models(M.load_mood(spark, f"{folder}/mood"), G.load_genre(spark, f"{folder}/genre"), taste)


REPORT_SCHEMA = ("timestamp string, tracks_count long, models struct<"
                 "taste_matcher: struct<type: string, factors: int, users: long, tracks: long>, "
                 "mood_analyzer: struct<type: string, clusters: int, fitted: boolean>, "
                 "genre_classifier: struct<type: string, genres: int, estimators: long>>")


def training_report(models: Models, tracks: DataFrame) -> DataFrame:
    """One row, one JSON string (fields of REPORT_SCHEMA): track count and each model's
    size.  A model that was not fitted has no entry."""
    out = tracks.agg(F.count(F.lit(1)).alias("tracks_count"))
    trees = models.genre.nodes.agg(F.count_distinct("tree").alias("estimators"))
    out = join_on_keys(out, trees, [])
    parts = [F.struct(F.lit("K-Means Clustering").alias("type"), F.lit(models.mood.k).alias("clusters"),
                      F.lit(True).alias("fitted")).alias("mood_analyzer"),
             F.struct(F.lit("Random Forest Multi-Label").alias("type"),
                      F.lit(len(models.genre.genres)).alias("genres"), "estimators").alias("genre_classifier")]
    if models.taste is not None:
        out = join_on_keys(out, models.taste.fitted_counts(), [])
        parts.insert(0, F.struct(F.lit("ALS Matrix Factorization").alias("type"),
                                 F.lit(models.taste.model.rank).alias("factors"), F.col("als_users").alias("users"),
                                 F.col("als_tracks").alias("tracks")).alias("taste_matcher"))
    return out.select(F.to_json(F.struct(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "tracks_count",
        F.struct(*parts).alias("models"))).alias("value"))


def write_training_report(models: Models, tracks: DataFrame, path: str) -> DataFrame:
    """Write the report as JSON text under ``path`` and return it parsed."""
    training_report(models, tracks).write.mode("overwrite").text(path)
    return tracks.sparkSession.read.schema(REPORT_SCHEMA).json(path)
