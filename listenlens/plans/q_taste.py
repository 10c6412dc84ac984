"""Registered taste queries."""

from __future__ import annotations

from listenlens.operators import taste as TA
from listenlens.plans.catalog import register, round_doubles
from listenlens.plans.sqltext import oracle_ctes, rq
from listenlens.sources.fixtures import Views

WEIGHT_SQL = ("CASE t WHEN 'listen' THEN 1.0 WHEN 'save' THEN 2.0 WHEN 'replay' THEN 1.5 "
              "WHEN 'skip' THEN -1.0 ELSE 1.0 END")
_MATRIX = f"""
, typed AS (SELECT user_id, track_id, count,
                   CASE WHEN interaction_type = 'listen' AND duration_ms < 30000 THEN 'skip'
                        ELSE interaction_type END AS t FROM interactions),
matrix AS (SELECT user_id, track_id, sum({WEIGHT_SQL} * count) AS score, count(*) AS interactions
           FROM typed GROUP BY user_id, track_id)
"""


@register("interaction_matrix", oracle_ctes("interactions") + _MATRIX.replace("\n, typed", ", typed", 1)
          + f"SELECT user_id, track_id, {rq('score')} AS score, interactions FROM matrix")
def q_interaction_matrix(spark, sf_dir):
    """Weighted (user, track) scores."""
    return round_doubles(TA.interaction_matrix(Views(spark, sf_dir).interactions))


@register("matrix_shape", oracle_ctes("interactions") + _MATRIX.replace("\n, typed", ", typed", 1) + f"""
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT track_id) AS n_tracks, count(*) AS nnz,
       {rq('1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT track_id))')} AS sparsity
FROM matrix
""")
def q_matrix_shape(spark, sf_dir):
    """D24."""
    return round_doubles(TA.matrix_shape(TA.interaction_matrix(Views(spark, sf_dir).interactions)))


_VD = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@register("taste_profile", f"""
WITH v AS (SELECT vec_id, {_VD} AS e FROM embeddings),
m AS (SELECT vec_id, e, CAST(len(e) AS INTEGER) AS d, list_sum(e) / len(e) AS mean FROM v)
SELECT vec_id, d AS embedding_dimension,
       {rq('sqrt(list_sum(list_transform(e, lambda x: x * x)))')} AS embedding_magnitude,
       {rq('mean')} AS embedding_mean,
       {rq('sqrt(list_sum(list_transform(e, lambda x: (x - mean) * (x - mean))) / d)')} AS embedding_std
FROM m
""")
def q_taste_profile(spark, sf_dir):
    """I11 on the given embedding vectors (stand-ins for listener factors)."""
    p = TA.taste_profile(Views(spark, sf_dir).embeddings, "vec_id").drop("embedding_vector")
    return round_doubles(p)


@register("similar_users", f"""
WITH v AS (SELECT vec_id, {_VD} AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM v WHERE nrm > 0),
p AS (SELECT a.vec_id, b.vec_id AS similar_vec_id,
             list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.nrm * b.nrm) AS similarity
      FROM n a JOIN n b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, similar_vec_id) AS INTEGER) AS rank FROM p)
SELECT vec_id, similar_vec_id, {rq('similarity')} AS similarity, rank FROM r WHERE rank <= 10
""")
def q_similar_users(spark, sf_dir):
    """Exact top-10 cosine neighbours of every vector (blocked, bounded groups)."""
    return round_doubles(TA.similar_vectors(Views(spark, sf_dir).embeddings, "vec_id", n=10))


@register("similar_users_text_ids", f"""
WITH v AS (SELECT 'user_' || vec_id AS vec_id, {_VD} AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM v WHERE nrm > 0),
p AS (SELECT a.vec_id, b.vec_id AS similar_vec_id,
             list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.nrm * b.nrm) AS similarity
      FROM n a JOIN n b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, similar_vec_id) AS INTEGER) AS rank FROM p)
SELECT vec_id, similar_vec_id, {rq('similarity')} AS similarity, rank FROM r WHERE rank <= 3
""")
def q_similar_users_text_ids(spark, sf_dir):
    """I12 with text ids: exact top-3 cosine neighbours."""
    from pyspark.sql import functions as F
    v = Views(spark, sf_dir).embeddings.withColumn("vec_id", F.concat(F.lit("user_"), "vec_id"))
    return round_doubles(TA.similar_vectors(v, "vec_id", n=3))


@register("taste_match_scores")
def q_taste_match_scores(spark, sf_dir):
    """Implicit ALS on the interaction matrix, then (dot + 1) / 2 for every
    observed (user, track) pair (trained model: rows-only check)."""
    from listenlens.plans.q_models import taste_model
    m = TA.interaction_matrix(Views(spark, sf_dir).interactions)
    return taste_model(spark, sf_dir).match_scores(m.select("user_id", "track_id"))
