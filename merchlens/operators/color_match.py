"""Products whose shades are closest to a target colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from merchlens.functions import colors as C
from merchlens.operators.nearest import color_nearest
from merchlens.operators.spread import top_k

# Words shoppers use for a category.
CATEGORY_WORDS = {
    "lips": ("lipstick", "lip", "lip gloss", "lipgloss"),
    "face": ("foundation", "concealer", "powder", "blush", "bronzer", "highlighter", "primer"),
    "eyes": ("eyeshadow", "eyeliner", "mascara", "brow", "eye"),
    "skincare": ("moisturizer", "serum", "cleanser", "skin"),
    "nails": ("nail", "nail polish", "nails"),
}
# Categories searched when none is asked for, and their order on equal distance.
DEFAULT_CATEGORIES = ("lips", "face", "eyes", "skincare")
CATEGORY_ORDER = ("face", "lips", "eyes", "skincare")

RESULT = ("rank", "product_id", "name", "brand", "category", "swatch_hex", "color_distance", "price", "image_url")


def category_priority(category: Column) -> Column:
    out = F.lit(len(CATEGORY_ORDER) + 1)
    for place, name in enumerate(CATEGORY_ORDER, start=1):
        out = F.when(F.lower(category) == name, place).otherwise(out)
    return out


def categories_for(word: str | None) -> tuple[str, ...]:
    """Categories a shopper's word stands for; the defaults when it is missing or empty."""
    if not word:
        return DEFAULT_CATEGORIES
    word = word.lower()
    return (word, *[cat for cat, names in CATEGORY_WORDS.items() if word in names and cat != word])


def in_category(category: Column, word: str | None) -> Column:
    return F.lower(category).isin(*categories_for(word))


def category_words(spark) -> DataFrame:
    """(filter_term, category) rows, one per known word."""
    rows = [(word, cat) for cat, names in CATEGORY_WORDS.items() for word in names]
    return spark.createDataFrame(rows, "filter_term string, category string")


def _shades(products: DataFrame, variants: DataFrame, media: DataFrame, k: int) -> DataFrame:
    """Shade rows with product fields and each primary image; several primary images repeat the row.

    Of a product's images only the first ``k`` can be in an answer, so they become a short list on the
    product; the shades then need one join, which Spark can split where a product has very many of them.
    """
    primary = media.filter("is_primary").select("product_id", "url")
    first = top_k(primary, ["product_id"], [F.col("url").asc_nulls_last()], k, "__n")
    images = first.groupBy("product_id").agg(F.collect_list(F.struct("url")).alias("__images"))
    p = products.select("product_id", "name", "brand", "category", F.col("current_price").alias("price"))
    v = variants.filter(F.col("color_hex").isNotNull()).select(
        "product_id", "variant_id", F.col("color_hex").alias("swatch_hex")
    )
    shades = v.join(p.join(images, "product_id", "left"), "product_id")
    return shades.withColumn("__image", F.explode_outer("__images")).withColumn("image_url", F.col("__image.url")).drop("__images", "__image")


def match_products(
    targets: DataFrame,
    products: DataFrame,
    variants: DataFrame,
    media: DataFrame,
    category: str | None = None,
    k: int = 10,
    active_only: bool = False,
) -> DataFrame:
    """Top ``k`` shades per row of ``targets(target_id, target_hex)``, any category or one word for it.

    Unreadable shade channels count as 0 and unreadable target channels as 128. Distance ties go to
    face, lips, eyes, skincare, then by id.
    """
    chosen = products.filter(in_category(F.col("category"), category))
    if active_only:
        chosen = chosen.filter("is_active")
    points = (
        _shades(chosen, variants.filter(F.length("color_hex") == 7), media, k)
        .withColumn("__priority", category_priority(F.col("category")))
        .select("*", *[C.hex_channel(F.col("swatch_hex"), i, 0).alias(ch) for i, ch in enumerate("rgb")])
    )
    hexed = C.with_hash(F.col("target_hex"))
    asked = targets.select("*", *[C.hex_channel(hexed, i, 128).alias(f"t{ch}") for i, ch in enumerate("rgb")])
    order = ["__priority", "product_id", "variant_id", "image_url"]
    return color_nearest(asked, points, k, order, round_first=False).select("target_id", *RESULT)


def match_products_in_category(
    targets: DataFrame, products: DataFrame, variants: DataFrame, media: DataFrame, category: str, k: int = 10, strict: bool = False
) -> DataFrame:
    """Top ``k`` shades of one category by the rounded distance.

    Shades and targets with an unreadable colour take no part; with ``strict`` they raise.
    """
    chosen = products.filter(F.lower("category") == category.lower())
    default = None if strict else -1

    def channels(df: DataFrame, hexed: Column, prefix: str) -> DataFrame:
        names = [prefix + ch for ch in "rgb"]
        read = df.select("*", *[C.hex_channel(hexed, i, default).alias(n) for i, n in enumerate(names)])
        return read if strict else read.filter(F.least(*names) >= 0)

    points = channels(_shades(chosen, variants, media, k), F.col("swatch_hex"), "")
    asked = channels(targets, F.col("target_hex"), "t")
    order = ["product_id", "variant_id", "image_url"]
    return color_nearest(asked, points, k, order, round_first=True).select("target_id", *RESULT)


def as_array(matches: DataFrame, key: str, keys_df: DataFrame | None = None) -> DataFrame:
    """One array of records per key in rank order; keys without a match get an empty array.

    Arrays hold at most the ``k`` rows the match kept per key.
    """
    fields = [c for c in matches.columns if c != key]
    lists = matches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("matches"))
    if keys_df is None:
        return lists
    blank = F.array().cast(lists.schema["matches"].dataType)
    return keys_df.select(key).join(lists, key, "left").withColumn("matches", F.coalesce("matches", blank))
