"""One search table out of several catalogue, label and social tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

PRODUCT_CONTENT = (
    "content_type", "id", "product_id", "title", "content", "brand", "category", "subcategory", "color_name",
    "finish", "current_price", "is_vegan", "is_cruelty_free", "source_image_url", "severity",
)
LABEL_CONTENT = (
    "content_type", "id", "product_id", "product_name", "title", "content", "brand", "category", "subcategory",
    "is_allergen", "allergen_type", "current_price", "is_vegan", "is_cruelty_free", "label_image_url", "severity",
)
SOCIAL_CONTENT = (
    "content_type", "id", "product_id", "title", "content", "url", "author_handle", "author_name", "platform",
    "rating", "engagement_score", "verified_purchase", "skin_tone", "skin_type", "undertone", "sentiment_label",
    "is_sponsored", "posted_at",
)


def _stack(parts: list[DataFrame], columns) -> DataFrame:
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*columns)


def _kind(name: str) -> Column:
    return F.lit(name).alias("content_type")


def _active(products: DataFrame) -> DataFrame:
    return products.filter("is_active").select(
        "product_id", "name", "brand", "category", "subcategory", "current_price", "is_vegan", "is_cruelty_free"
    )


SHARED = ("brand", "category", "subcategory", "current_price", "is_vegan", "is_cruelty_free")


def product_search_content(
    products: DataFrame, labels: DataFrame, ingredients: DataFrame, warnings: DataFrame
) -> DataFrame:
    """Products, label texts, ingredients and warnings of active products as one table."""
    live = _active(products)
    own = products.filter("is_active").select(
        _kind("product"), F.col("product_id").cast("string").alias("id"), "product_id", F.col("name").alias("title"),
        F.coalesce("description", "short_description", F.lit("")).alias("content"), *SHARED, "color_name", "finish",
    )
    label = labels.join(live, "product_id").select(
        _kind("label"), F.col("label_id").cast("string").alias("id"), "product_id",
        F.concat("name", F.lit(" - "), "label_type").alias("title"), F.col("extracted_text").alias("content"),
        *SHARED, "source_image_url",
    )
    allergen = F.concat(F.lit(" [ALLERGEN: "), F.coalesce("allergen_type", F.lit("unknown")), F.lit("]"))
    ingredient = ingredients.join(live, "product_id").select(
        _kind("ingredient"), F.col("ingredient_id").cast("string").alias("id"), "product_id",
        F.concat("name", F.lit(" - Ingredient: "), "ingredient_name").alias("title"),
        F.concat(
            "ingredient_name",
            F.coalesce(F.concat(F.lit(" ("), "ingredient_name_normalized", F.lit(")")), F.lit("")),
            F.when(F.col("is_allergen"), allergen).otherwise(""),
        ).alias("content"),
        *SHARED, "source_image_url",
    )
    warning = warnings.join(live, "product_id").select(
        _kind("warning"), F.col("warning_id").cast("string").alias("id"), "product_id",
        F.concat("name", F.lit(" - Warning")).alias("title"), F.col("warning_text").alias("content"),
        *SHARED, "source_image_url", "severity",
    )
    return _stack([own, label, ingredient, warning], PRODUCT_CONTENT)


def label_search_content(products: DataFrame, ingredients: DataFrame, warnings: DataFrame) -> DataFrame:
    """Ingredients and warnings of active products, with the label image written into the title."""
    live = _active(products)
    image = F.coalesce("source_image_url", F.lit("N/A"))

    def title(kind: str, what: str) -> Column:
        return F.concat(
            "name", F.lit(" (ID:"), F.col("product_id").cast("string"), F.lit(f") - {kind}: "), what,
            F.lit(" | Label: "), image,
        ).alias("title")

    def content(what: str) -> Column:
        return F.concat_ws(" ", "name", "brand", what).alias("content")

    def whole(what: str) -> Column:
        # A missing part makes the text NULL, as plain concatenation does.
        return F.when(F.col("name").isNotNull() & F.col("brand").isNotNull() & F.col(what).isNotNull(), content(what)).alias("content")

    ingredient = ingredients.join(live, "product_id").select(
        _kind("ingredient"), F.col("ingredient_id").cast("string").alias("id"), "product_id",
        F.col("name").alias("product_name"), title("Ingredient", "ingredient_name"), whole("ingredient_name"),
        *SHARED, "is_allergen", "allergen_type", image.alias("label_image_url"),
    )
    warning = warnings.join(live, "product_id").select(
        _kind("warning"), F.col("warning_id").cast("string").alias("id"), "product_id",
        F.col("name").alias("product_name"), title("Warning", "warning_text"), whole("warning_text"),
        *SHARED, F.lit(False).alias("is_allergen"), image.alias("label_image_url"), "severity",
    )
    return _stack([ingredient, warning], LABEL_CONTENT)


def social_search_content(reviews: DataFrame, mentions: DataFrame, influencers: DataFrame) -> DataFrame:
    """Approved reviews, mentions and influencer posts as one table.

    Engagement is helpful votes for reviews, likes + comments + shares for mentions, and
    likes + comments + views for influencers.
    """
    review = reviews.filter("is_approved").select(
        _kind("review"), F.col("review_id").cast("string").alias("id"), "product_id", "title",
        F.coalesce("review_text", F.lit("")).alias("content"), F.col("review_url").alias("url"), "platform", "rating",
        F.col("helpful_votes").cast("long").alias("engagement_score"), "verified_purchase",
        F.col("reviewer_skin_tone").alias("skin_tone"), F.col("reviewer_skin_type").alias("skin_type"),
        F.col("reviewer_undertone").alias("undertone"), F.col("created_at").alias("posted_at"),
    )
    mention = mentions.select(
        _kind("social_mention"), F.col("mention_id").cast("string").alias("id"), "product_id",
        F.coalesce("content_text", F.lit("")).alias("content"), F.col("post_url").alias("url"),
        "author_handle", "author_name", "platform",
        (F.col("likes") + F.col("comments") + F.col("shares")).cast("long").alias("engagement_score"),
        "sentiment_label", "posted_at",
    )
    influencer = influencers.select(
        _kind("influencer"), F.col("mention_id").cast("string").alias("id"), "product_id",
        F.concat("influencer_name", F.lit(" on "), "platform").alias("title"),
        F.coalesce("content_text", F.lit("")).alias("content"), F.col("post_url").alias("url"),
        F.col("influencer_handle").alias("author_handle"), F.col("influencer_name").alias("author_name"), "platform",
        (F.col("likes") + F.col("comments") + F.col("views")).cast("long").alias("engagement_score"),
        F.col("influencer_skin_tone").alias("skin_tone"), F.col("influencer_skin_type").alias("skin_type"),
        F.col("influencer_undertone").alias("undertone"), "is_sponsored", "posted_at",
    )
    return _stack([review, mention, influencer], SOCIAL_CONTENT)
