"""Catalogue filters by skin type, undertone and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def products_quick_match_view(products: DataFrame) -> DataFrame:
    return products.filter("is_active").select(
        "product_id",
        "name",
        "brand",
        "category",
        "current_price",
        F.array_join("skin_type_compatibility", ", ", "").alias("skin_types"),
        F.array_join("undertone_compatibility", ", ", "").alias("undertones"),
    )


def quick_product_match(
    products: DataFrame,
    skin_type: str | None = None,
    undertone: str | None = None,
    category: str | None = None,
    k: int = 10,
) -> DataFrame:
    """Cheapest ``k`` active products; a missing or empty argument filters nothing."""
    kept = products.filter("is_active")
    if skin_type:
        kept = kept.filter(F.array_contains("skin_type_compatibility", skin_type.lower()))
    if undertone:
        kept = kept.filter(F.array_contains("undertone_compatibility", undertone.lower()))
    if category:
        kept = kept.filter(F.lower("category") == category.lower())
    return (
        kept.select("product_id", "name", "brand", "category", F.col("current_price").alias("price"))
        .orderBy(F.col("price").asc_nulls_last(), "product_id")
        .limit(k)
    )
