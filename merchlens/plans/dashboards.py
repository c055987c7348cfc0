"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def revenue(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.coalesce(F.sum("total_cents") / F.lit(100.0), F.lit(0.0)).alias("total_revenue"),
        F.count_distinct("order_id").alias("total_orders"),
        (F.avg("total_cents") / 100.0).alias("avg_order_value"),
    )


def customers(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count_distinct("customer_id").alias("total_customers"),
        F.count_distinct(F.when(F.col("is_active"), F.col("customer_id"))).alias("active_customers"),
        F.sum("points_balance").alias("total_points"),
    )


def inventory(stock: DataFrame) -> DataFrame:
    """Low stock here is strictly under the reorder point, counted in rows."""
    return stock.agg(
        F.count_distinct("location_id").alias("total_locations"),
        F.sum("quantity_on_hand").alias("total_units"),
        F.count_if(F.col("quantity_on_hand") < F.col("reorder_point")).alias("low_stock_count"),
    )


def social(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("total_reviews"), F.round(F.avg("rating"), 2).alias("avg_rating"))


def products(products: DataFrame) -> DataFrame:
    return products.agg(F.count_distinct("product_id").alias("total_products"))


def loyalty(customers: DataFrame) -> DataFrame:
    return customers.groupBy("loyalty_tier").agg(F.count("*").alias("customer_count")).orderBy(
        F.col("customer_count").desc(), F.col("loyalty_tier").asc_nulls_last()
    )


def categories(products: DataFrame, k: int = 10) -> DataFrame:
    return (
        products.groupBy("category")
        .agg(F.count("*").alias("product_count"), F.round(F.avg("current_price"), 2).alias("avg_price"))
        .orderBy(F.col("product_count").desc(), F.col("category").asc_nulls_last())
        .limit(k)
    )


def low_stock_items(stock: DataFrame, products: DataFrame, locations: DataFrame, k: int = 10) -> DataFrame:
    low = stock.filter("quantity_on_hand < reorder_point").select(
        "stock_id", "product_id", "location_id", "quantity_on_hand", "reorder_point"
    )
    return (
        low.join(products.select("product_id", F.col("name").alias("product_name")), "product_id")
        .join(locations.select("location_id", F.col("city").alias("location")), "location_id")
        .orderBy("quantity_on_hand", "stock_id")
        .limit(k)
        .select("product_name", "quantity_on_hand", "reorder_point", "location")
    )


def top_rated(reviews: DataFrame, products: DataFrame, k: int = 10, min_reviews: int = 5) -> DataFrame:
    """Best-rated products with enough reviews. Reviews shrink to one row per product before the join."""
    per_product = reviews.groupBy("product_id").agg(
        F.sum("rating").alias("__sum"), F.count("rating").alias("__rated"), F.count("review_id").alias("__n")
    )
    named = per_product.join(products.select("product_id", "name", "brand"), "product_id")
    return (
        named.groupBy(F.col("name").alias("product_name"), "brand")
        .agg(F.round(F.sum("__sum") / F.sum("__rated"), 2).alias("avg_rating"), F.sum("__n").alias("review_count"))
        .filter(F.col("review_count") >= min_reviews)
        .orderBy(F.col("avg_rating").desc_nulls_last(), F.col("review_count").desc(), "product_name", "brand")
        .limit(k)
    )
