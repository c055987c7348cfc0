"""Questions with an agreed answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LISTED = ("product_id", "name", "brand", "category", "subcategory", "current_price")
COMPARED = LISTED + (
    "base_price", "color_name", "finish", "is_active", "is_cruelty_free", "is_vegan", "launch_date",
    "skin_tone_compatibility", "skin_type_compatibility", "undertone_compatibility", "spf_value",
)


def products_suiting(
    products: DataFrame,
    category: str | None = None,
    subcategory: str | None = None,
    undertone: str | None = None,
    skin_type: str | None = None,
    skin_tone: str | None = None,
    k: int = 20,
) -> DataFrame:
    """Cheapest active products that fit every given trait."""
    kept = products.filter("is_active")
    for column, value in (("category", category), ("subcategory", subcategory)):
        if value:
            kept = kept.filter(F.col(column) == value)
    for column, value in (("undertone", undertone), ("skin_type", skin_type), ("skin_tone", skin_tone)):
        if value:
            kept = kept.filter(F.array_contains(f"{column}_compatibility", value))
    return kept.select(*LISTED).orderBy(F.col("current_price").asc_nulls_last(), "product_id").limit(k)


def categories_and_brands(products: DataFrame, anchor: str) -> DataFrame:
    launched = products.filter(F.col("launch_date") <= F.lit(anchor).cast("timestamp_ntz"))
    return (
        launched.groupBy("category", "brand")
        .agg(F.count_distinct("product_id").alias("product_count"), F.avg("current_price").alias("avg_price"))
        .orderBy("category", "brand")
    )


def compare_products(products: DataFrame, ids) -> DataFrame:
    return products.filter(F.col("product_id").isin(*ids)).select(*[c for c in COMPARED if c in products.columns]).orderBy("name")


def review_summary(reviews: DataFrame, anchor: str, product_id=None) -> DataFrame:
    """Review counts, ratings and dates per product, or of one product."""
    kept = reviews.filter(F.col("created_at") <= F.lit(anchor).cast("timestamp_ntz"))
    if product_id is not None:
        kept = kept.filter(F.col("product_id") == product_id)
    return (
        kept.groupBy("product_id")
        .agg(
            F.count_distinct("review_id").alias("review_count"),
            F.avg("rating").alias("avg_rating"),
            F.min("rating").alias("min_rating"),
            F.max("rating").alias("max_rating"),
            F.min("created_at").alias("earliest_review_date"),
            F.max("created_at").alias("latest_review_date"),
        )
        .orderBy(F.col("latest_review_date").desc_nulls_last(), "product_id")
    )
