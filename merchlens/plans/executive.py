"""Business questions across products, sales, reviews and stock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from merchlens.plans.metric_views import MetricView


def within(time: str, anchor: str, months: int = 0, days: int = 0) -> Column:
    """Times in the given span that ends at ``anchor``."""
    end = F.lit(anchor).cast("timestamp_ntz")
    span = f"INTERVAL {months} MONTHS" if months else f"INTERVAL {days} DAYS"
    return F.col(time).cast("timestamp_ntz").between(end - F.expr(span), end)


def top_products(sales: DataFrame, products: DataFrame, anchor: str, months: int = 6, k: int = 10) -> DataFrame:
    """Best-selling products by revenue over ``sales(product_id, sold_at, quantity, subtotal_cents)``."""
    per_product = (
        sales.filter(within("sold_at", anchor, months=months))
        .groupBy("product_id")
        .agg(F.sum("subtotal_cents").alias("revenue_cents"), F.sum("quantity").alias("units"))
    )
    return (
        per_product.join(products.select("product_id", "name", "brand", "category"), "product_id")
        .orderBy(F.col("revenue_cents").desc(), "product_id")
        .limit(k)
    )


def category_scorecard(sales: DataFrame, reviews: DataFrame, mentions: DataFrame, products: DataFrame) -> DataFrame:
    """Sales, share of sales, rating and engagement per category, each summed per product before any join."""
    sold = sales.groupBy("product_id").agg(F.sum("subtotal_cents").alias("sales"), F.sum("quantity").alias("units"))
    rated = reviews.groupBy("product_id").agg(F.sum("rating").alias("stars"), F.count("rating").alias("ratings"))
    talked = mentions.groupBy("product_id").agg(F.sum(F.col("likes") + F.col("comments") + F.col("shares")).alias("engagement"))
    facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [sold, rated, talked])
    per_category = (
        facts.join(products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(*[F.sum(c).alias(c) for c in ("sales", "units", "stars", "ratings", "engagement")])
    )
    # One row per category from here on.
    total = F.sum("sales").over(Window.partitionBy())
    return per_category.select(
        "category",
        (F.col("sales") / 100.0).alias("revenue"),
        "units",
        F.try_divide(F.col("sales"), total).alias("revenue_share"),
        F.try_divide(F.col("stars"), F.col("ratings")).alias("avg_rating"),
        F.col("ratings").alias("review_count"),
        "engagement",
    )


def stock_outside_category(inventory: MetricView, category: str = "lips") -> DataFrame:
    return inventory.query(
        ["total_on_hand", "total_reserved", "total_available"],
        ["product.category"],
        where={"product.category": lambda c: F.lower(c) != category},
    )


def stock_by_location(inventory: MetricView) -> DataFrame:
    """Where each product can be had now."""
    dims = {"product_id": "stock.product_id", "location_id": "stock.location_id", "name": "product.name", "city": "location.city"}
    return inventory.query(["total_available"], dims).filter("total_available > 0")


def ratings_by(social: MetricView, column: str = "product.brand") -> DataFrame:
    return social.query(["avg_rating", "review_count"], [column])


def orders_by_customer(carts: MetricView) -> DataFrame:
    return carts.query(["order_count", "total_revenue"], ["session.customer_id"])
