"""The 28 tables of the data model: domain, keys and references, and a rule for column types.

Column names come from the data (CSV headers or DataFrame columns); their types follow from the name.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from merchlens.sources.csv import load_csv


@dataclass(frozen=True)
class Table:
    domain: str
    key: str | None
    unique: tuple[tuple[str, ...], ...] = ()
    refs: dict[str, str] = field(default_factory=dict)


def _t(domain: str, key: str | None, *unique: tuple[str, ...], **refs: str) -> Table:
    return Table(domain, key, unique, refs)


# Table -> domain, primary key, unique keys, column = referenced table.
TABLES: dict[str, Table] = {
    "products": _t("products", "product_id", ("sku",)),
    "product_variants": _t("products", "variant_id", ("sku",), product_id="products"),
    "product_media": _t("products", "media_id", product_id="products", variant_id="product_variants"),
    "product_labels": _t("products", "label_id", product_id="products", source_media_id="product_media"),
    "product_ingredients": _t("products", "ingredient_id", product_id="products", label_id="product_labels"),
    "product_warnings": _t("products", "warning_id", product_id="products", label_id="product_labels"),
    "product_label_files": _t("products", None),
    "price_history": _t("products", "history_id", product_id="products", variant_id="product_variants"),
    "promotions": _t("products", "promotion_id"),
    "label_extractions_staging": _t("products", "extraction_id"),
    "product_reviews": _t("social", "review_id"),
    "social_mentions": _t("social", "mention_id"),
    "influencer_mentions": _t("social", "mention_id"),
    "trending_products": _t("social", "trend_id"),
    "locations": _t("inventory", "location_id", ("location_code",)),
    "stock_levels": _t("inventory", "stock_id", ("product_id", "variant_id", "location_id"), location_id="locations"),
    "inventory_transactions": _t("inventory", "transaction_id", stock_id="stock_levels"),
    "customers": _t("customers", "customer_id", ("email",)),
    "customer_face_embeddings": _t("customers", "embedding_id", customer_id="customers"),
    "face_image_processing": _t("customers", "processing_id"),
    "skin_analysis_history": _t("customers", "analysis_id", customer_id="customers"),
    "cart_sessions": _t("cart", "session_id"),
    "fulfillment_options": _t("cart", "option_id"),
    "payment_methods": _t("cart", "payment_method_id"),
    "cart_items": _t("cart", "item_id", session_id="cart_sessions"),
    "orders": _t("cart", "order_id", session_id="cart_sessions"),
    "order_items": _t("cart", "order_item_id", order_id="orders"),
    "payment_transactions": _t("cart", "transaction_id", session_id="cart_sessions"),
}

MONEY = T.DecimalType(10, 2)
# Columns whose type the endings below do not tell.
NAMED_TYPES: dict[str, T.DataType] = {
    "cost": MONEY, "price": MONEY, "base_price": MONEY, "current_price": MONEY, "previous_price": MONEY,
    "price_modifier": MONEY, "discount_value": MONEY, "min_purchase_amount": MONEY,
    "start_date": T.TimestampNTZType(), "end_date": T.DateType(),
    "verified_purchase": T.BooleanType(), "processed": T.BooleanType(), "makeup_detected": T.BooleanType(),
    "lip_is_natural": T.BooleanType(),
    "color_lab": T.ArrayType(T.DoubleType()), "skin_lab": T.ArrayType(T.DoubleType()), "lip_lab": T.ArrayType(T.DoubleType()),
    "skin_rgb": T.ArrayType(T.IntegerType()), "lip_rgb": T.ArrayType(T.IntegerType()),
    "embedding": T.ArrayType(T.FloatType()),
    "product_ids": T.ArrayType(T.StringType()), "category_ids": T.ArrayType(T.StringType()),
    "brand_names": T.ArrayType(T.StringType()), "trending_platforms": T.ArrayType(T.StringType()),
    "top_hashtags": T.ArrayType(T.StringType()), "detected_makeup_types": T.ArrayType(T.StringType()),
    "operating_hours": T.MapType(T.StringType(), T.StringType()), "skin_profile": T.VariantType(),
    "preferences": T.VariantType(), "audience_demographics": T.VariantType(), "structured_data": T.VariantType(),
    "extracted_data": T.VariantType(),
    "rating": T.LongType(), "position": T.LongType(), "width": T.LongType(), "height": T.LongType(),
    "likes": T.LongType(), "comments": T.LongType(), "shares": T.LongType(), "views": T.LongType(),
    "spf_value": T.LongType(), "reorder_point": T.LongType(), "monk_shade": T.LongType(),
    "fitzpatrick_type": T.LongType(), "points_balance": T.LongType(), "display_order": T.LongType(),
    "quantity": T.LongType(), "percentage": T.DoubleType(), "latitude": T.DoubleType(), "longitude": T.DoubleType(),
    "ita_angle": T.DoubleType(), "mention_velocity": T.DoubleType(), "sentiment_average": T.DoubleType(),
    "engagement_rate": T.DoubleType(), "extraction_confidence": T.DoubleType(), "trend_rank": T.LongType(),
    "updated_at": T.TimestampNTZType(), "window_start": T.TimestampNTZType(), "window_end": T.TimestampNTZType(),
    "extraction_timestamp": T.TimestampNTZType(), "extraction_date": T.TimestampNTZType(),
    "last_updated": T.TimestampNTZType(),
}
# Same column name, other type in one table.
TABLE_TYPES = {
    ("products", "updated_at"): T.TimestampType(),
    ("promotions", "end_date"): T.TimestampNTZType(),
}
ENDINGS: tuple[tuple[tuple[str, ...], T.DataType], ...] = (
    (("_at",), T.TimestampNTZType()),
    (("_date",), T.DateType()),
    (("_compatibility",), T.ArrayType(T.StringType())),
    (("_score",), T.DoubleType()),
    (("_cents", "_votes", "_count", "_points", "_uses", "_uses_per_customer", "_bytes", "_order", "_min", "_max", "_ms", "_month", "_year"), T.LongType()),
)


def column_type(table: str, column: str) -> T.DataType:
    """The type a column name stands for; text when nothing else is known."""
    name = column.lower()
    if (table, name) in TABLE_TYPES:
        return TABLE_TYPES[(table, name)]
    if name in NAMED_TYPES:
        return NAMED_TYPES[name]
    if name.startswith("is_"):
        return T.BooleanType()
    if name.startswith("quantity_") or name.startswith("reorder_"):
        return T.LongType()
    for endings, kind in ENDINGS:
        if name.endswith(endings):
            return kind
    return T.StringType()


def load_table(
    spark: SparkSession, table: str, path: str, multi_line: bool = False, types: dict[str, T.DataType] | None = None
) -> DataFrame:
    """Load one table's CSV files; names come from the files' headers, types from ``types`` or else the naming rule."""
    if table not in TABLES:
        raise KeyError(f"unknown table {table}")
    given = {name.lower(): kind for name, kind in (types or {}).items()}

    def schema(columns: list[str]) -> T.StructType:
        return T.StructType([T.StructField(c, given.get(c, column_type(table, c))) for c in columns])

    return load_csv(spark, path, schema, multi_line=multi_line)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table stored as parquet under ``root``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{table}.parquet")


# Defaults by column; "uuid" and "now" as in with_defaults.
DEFAULTS: dict[str, object] = {
    "is_vegan": False, "is_cruelty_free": False, "is_active": True, "is_featured": False, "price_modifier": 0,
    "is_available": True, "is_default": False, "display_order": 0, "is_primary": False, "is_processed": False,
    "is_allergen": False, "current_uses": 0, "helpful_votes": 0, "not_helpful_votes": 0, "verified_purchase": False,
    "is_approved": True, "likes": 0, "comments": 0, "shares": 0, "views": 0, "is_sponsored": False,
    "is_affiliate": False, "is_viral": False, "country": "US", "is_pickup_enabled": False, "quantity_on_hand": 0,
    "quantity_reserved": 0, "reorder_point": 10, "reorder_quantity": 50, "loyalty_tier": "Bronze",
    "points_balance": 0, "lifetime_points": 0, "processed": False, "makeup_detected": False, "status": "active",
    "subtotal_cents": 0, "tax_cents": 0, "shipping_cents": 0, "discount_cents": 0, "total_cents": 0,
    "currency": "USD", "applied_loyalty_points": 0, "is_gift": False, "is_valid": True, "is_verified": False,
    "quantity": 1, "created_at": "now", "ingested_at": "now", "calculated_at": "now", "analyzed_at": "now",
    "added_at": "now", "last_updated": "now", "extraction_date": "now", "extraction_timestamp": "now",
}
# Same column, other default in one table; None means no default.
TABLE_DEFAULTS: dict[tuple[str, str], object] = {
    ("product_ingredients", "is_active"): False,
    ("orders", "status"): "pending", ("payment_transactions", "status"): None,
    ("orders", "subtotal_cents"): None, ("orders", "tax_cents"): None, ("orders", "shipping_cents"): None,
    ("orders", "total_cents"): None, ("cart_items", "subtotal_cents"): None, ("order_items", "subtotal_cents"): None,
    ("order_items", "quantity"): None, ("inventory_transactions", "quantity"): None,
}
ID_WITHOUT_DEFAULT = ("cart",)


def defaults_for(table: str, columns: Iterable[str]) -> dict[str, object]:
    """Column defaults of a table, for ``with_defaults``."""
    out: dict[str, object] = {}
    spec = TABLES[table]
    for column in columns:
        if column == spec.key and spec.domain not in ID_WITHOUT_DEFAULT:
            out[column] = "uuid"
            continue
        value = TABLE_DEFAULTS.get((table, column), DEFAULTS.get(column))
        if value is not None:
            out[column] = value
    return out


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, columns, violations) for every key and reference between the given tables."""
    from merchlens.operators import quality as Q

    parts = []

    def count(violations: DataFrame, table: str, rule: str, columns: str) -> None:
        parts.append(
            violations.agg(F.count("*").alias("violations")).select(
                F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.lit(columns).alias("columns"), "violations"
            )
        )

    for name, df in tables.items():
        spec = TABLES[name]
        for rule, key in [("primary key", (spec.key,) if spec.key else ())] + [("unique", u) for u in spec.unique]:
            if key and set(key) <= set(df.columns):
                count(Q.unique_violations(df, key), name, rule, ",".join(key))
        for column, parent in spec.refs.items():
            if parent in tables and column in df.columns:
                bad = Q.fk_violations(df, tables[parent], column, TABLES[parent].key)
                count(bad, name, "reference", column)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
