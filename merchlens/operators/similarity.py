"""Matching people by face vectors: best match, top-k and similar customers. All results are exact.

Searches run on ids and vectors; customers are joined to the few rows found. ``dim`` is the vectors' length;
``vector_search.misfits`` names the rows of another length or with gaps, which take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from merchlens.functions import vectors as V
from merchlens.functions.bands import distance_band, similarity_band
from merchlens.operators.spread import latest_by
from merchlens.operators.vector_search import search


def _units(df: DataFrame, *ids: str) -> DataFrame:
    return df.select(*ids, V.unit(V.as_vector(F.col("embedding"))).alias("v"))


def _live(embeddings: DataFrame, customers: DataFrame) -> DataFrame:
    """Unit vectors of active customers."""
    active = customers.filter("is_active").select("customer_id")
    people = embeddings.filter("is_active").join(active, "customer_id", "left_semi")
    return _units(people, "embedding_id", "customer_id")


def best_match(
    queries: DataFrame, embeddings: DataFrame, customers: DataFrame, threshold: float = 0.85, dim: int = 128
) -> DataFrame:
    """The most similar active customer of each ``queries(query_id, embedding)`` row.

    ``found`` tells whether it reaches the threshold. A query without a usable vector gives NONE.
    """
    best = search(_units(queries, "query_id"), _live(embeddings, customers), dim, 1, cosine=True)
    found = best.join(customers.select("customer_id", "first_name", "last_name"), "customer_id")
    score = F.col("score")
    return (
        queries.select("query_id")
        .join(found, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(score >= threshold, F.lit(False)).alias("found"),
            "customer_id",
            "first_name",
            "last_name",
            score.alias("similarity_score"),
            F.when(score.isNull(), "NONE").otherwise(similarity_band(score)).alias("confidence_level"),
        )
    )


def topk_cosine(
    queries: DataFrame, embeddings: DataFrame, customers: DataFrame, threshold: float = 0.7, k: int = 5, dim: int = 128
) -> DataFrame:
    """Up to ``k`` active customers per query with at least the threshold similarity."""
    best = search(_units(queries, "query_id"), _live(embeddings, customers), dim, k, cosine=True, limit=threshold)
    who = ["customer_id", "email", "first_name", "last_name", "loyalty_tier"]
    return best.join(customers.select(*who), "customer_id").select(
        "query_id", "rank", *who, F.col("score").alias("similarity_score"), similarity_band(F.col("score")).alias("confidence_level")
    )


def primary_vectors(embeddings: DataFrame) -> DataFrame:
    """One active primary vector per customer (the smallest id when there are several)."""
    own = embeddings.filter("is_active AND is_primary").select("customer_id", "embedding_id", "embedding")
    return latest_by(own, ["customer_id"], [F.col("embedding_id")], earliest=True)


def similar_entities(
    source_ids: DataFrame, embeddings: DataFrame, customers: DataFrame, threshold: float = 0.8, k: int = 10, dim: int = 128
) -> DataFrame:
    """Up to ``k`` other customers similar to the primary vector of each ``source_ids(source_id)``."""
    asked = primary_vectors(embeddings).join(
        source_ids.select(F.col("source_id").alias("customer_id")).distinct(), "customer_id", "left_semi"
    )
    queries = _units(asked, "customer_id").select(F.col("customer_id").alias("query_id"), F.col("customer_id").alias("own"), "v")
    best = search(queries, _live(embeddings, customers), dim, k, cosine=True, limit=threshold, differ=True)
    who = ["customer_id", "email", "first_name", "last_name"]
    return best.join(customers.select(*who), "customer_id").select(
        F.col("query_id").alias("source_id"), "rank", *who, F.col("score").alias("similarity_score")
    )


def topk_l2(
    queries: DataFrame,
    embeddings: DataFrame,
    customers: DataFrame,
    threshold: float = 0.55,
    k: int = 5,
    compat: bool = False,
    dim: int = 128,
) -> DataFrame:
    """Nearest customers by straight distance over primary vectors, with a match level.

    ``compat`` ignores threshold and ``k`` (always the five nearest) and also sees inactive vectors.
    """
    own = embeddings.filter("is_primary")
    own = own if compat else own.filter("is_active")
    who = ["customer_id", "first_name", "last_name", "email", "loyalty_tier", "points_balance"]
    people = own.join(customers.select("customer_id"), "customer_id", "left_semi").select(
        "embedding_id", "customer_id", V.as_vector(F.col("embedding")).alias("v")
    )
    asked = queries.select("query_id", V.as_vector(F.col("embedding")).alias("v"))
    # A distance must be under the threshold; the next number above minus the threshold is the least score.
    limit = None if compat else float(np.nextafter(-threshold, np.inf))
    best = search(asked, people, dim, 5 if compat else k, cosine=False, limit=limit)
    distance = -F.col("score")
    return best.join(customers.select(*who), "customer_id").select(
        "query_id", "rank", *who, F.round(distance, 4).alias("distance"), distance_band(distance).alias("match_level")
    )
