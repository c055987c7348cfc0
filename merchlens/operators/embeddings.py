"""Registering and retiring customer embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchlens.functions.text import uuid_from


def register_embeddings(new: DataFrame, customers: DataFrame, dim: int = 128) -> tuple[DataFrame, DataFrame]:
    """Split ``new(customer_id, embedding, ...)`` into rows to append and rejected rows with an error.

    Accepted rows are active and never primary. Their id is a digest of customer and vector.
    """
    known = customers.filter("is_active").select("customer_id").distinct().withColumn("__known", F.lit(True))
    judged = new.join(known, "customer_id", "left").withColumn(
        "error",
        F.when(F.col("__known").isNull(), "Customer not found or inactive").when(
            F.coalesce(F.size("embedding"), F.lit(-1)) != dim, f"Embedding must have {dim} numbers"
        ),
    ).drop("__known")
    accepted = judged.filter("error IS NULL").drop("error").withColumns(
        {
            "embedding_id": uuid_from(F.col("customer_id"), F.to_json("embedding")),
            "is_active": F.lit(True),
            "is_primary": F.lit(False),
        }
    )
    return accepted, judged.filter("error IS NOT NULL")


def deactivate(embeddings: DataFrame, keys: DataFrame, by: str = "embedding_id") -> tuple[DataFrame, DataFrame]:
    """Set ``is_active`` to false for the given ``embedding_id`` or ``customer_id`` values.

    Returns the new table and, per key, how many of its rows are now inactive (rows that already were
    count too; an unknown key counts 0).
    """
    marks = keys.select(by).distinct().withColumn("__hit", F.lit(True))
    updated = embeddings.join(marks, by, "left").withColumn(
        "is_active", F.when(F.col("__hit"), F.lit(False)).otherwise(F.col("is_active"))
    ).drop("__hit").select(*embeddings.columns)
    per_key = embeddings.groupBy(by).agg(F.count("*").alias("embeddings_deactivated"))
    counts = marks.drop("__hit").join(per_key, by, "left").select(
        by, F.coalesce("embeddings_deactivated", F.lit(0)).alias("embeddings_deactivated")
    )
    return updated, counts


def promote_latest(embeddings: DataFrame) -> DataFrame:
    """Make the newest active vector of each customer the primary one."""
    newest = (
        embeddings.filter("is_active")
        .groupBy("customer_id")
        .agg(F.max_by("embedding_id", F.struct("created_at", "embedding_id")).alias("__newest"))
    )
    return (
        embeddings.join(newest, "customer_id", "left")
        .withColumn("is_primary", F.coalesce(F.col("embedding_id") == F.col("__newest"), F.lit(False)))
        .drop("__newest")
        .select(*embeddings.columns)
    )
