"""Products an assistant's text talks about, tied back to product rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from merchlens.functions.text import brand_guess, first_word
from merchlens.operators.spread import top_k

# How products are written in a text, and the words and lengths that make a bold text a product.
MENTION = (
    r"(?i)\*\*([^*]+)\*\*\s*\(ID:\s*([a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})\)\s*-?\s*\$?([\d.]+)?"
)
PRICED = r"(?i)\*\*([^*]+(?:Foundation|Lipstick|Concealer|Blush|Bronzer|Primer)[^*]*)\*\*\s*-\s*\$?([\d.]+)"
DESCRIBED = r"(?i)\*\*([^*]*(?:Foundation|Lipstick|Concealer|Blush|Bronzer|Primer|Beauty)[^*]*)\*\*\s*-\s*([^$\n]+)"
BULLET = r"[-•]\s*\*\*([^*]+)\*\*"
BULLET_WORDS = ("foundation", "lipstick", "beauty", "concealer", "blush", "glow", "matte", "pro", "ultra")
TEXT_LIMIT, FALLBACK = 8, 4
ID_LENGTH = 36
# What a product that only the text names is given.
TEXT_SWATCH, TEXT_DISTANCE, TEXT_IMAGE = "#f0f0f0", 5.0, ""
TEXT_CATEGORY_WORD, TEXT_CATEGORY = "foundation", "beauty"

DETAILS = ("name", "brand", "category", "swatch_hex", "color_distance", "price", "image_url")


def _groups(text: Column, pattern: str, *groups: int) -> Column:
    """Array of structs g1, g2, ... with the wanted groups of every match."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    return F.arrays_zip(*found)


def parse_mentions(turns: DataFrame, text: str = "text") -> DataFrame:
    """One row per ``**name** (ID: uuid) - $price`` in the text, with its position."""
    found = _groups(F.col(text), MENTION, 1, 2, 3)
    return turns.select("turn_id", F.posexplode_outer(found).alias("pos", "m")).filter("pos IS NOT NULL").select(
        "turn_id",
        "pos",
        F.lower("m.g2").alias("product_id"),
        F.trim("m.g1").alias("name"),
        F.coalesce(F.col("m.g3").try_cast("double"), F.lit(0.0)).alias("price"),
    )


def _text_products(text: Column) -> Column:
    """Bold product names when no ids are written: with a price, else described, else in a list."""
    priced = F.transform(
        _groups(text, PRICED, 1, 2),
        lambda m: F.struct(F.trim(m["g1"]).alias("name"), F.coalesce(m["g2"].try_cast("double"), F.lit(0.0)).alias("price")),
    )
    free = lambda m: F.struct(F.trim(m).alias("name"), F.lit(0.0).alias("price"))
    described = F.transform(F.regexp_extract_all(text, F.lit(DESCRIBED), F.lit(1)), free)
    bullets = F.transform(F.regexp_extract_all(text, F.lit(BULLET), F.lit(1)), free)

    def sized(items: Column, below: int | None) -> Column:
        longer = lambda p: F.length(p["name"]) > 5
        return F.filter(items, longer if below is None else lambda p: longer(p) & (F.length(p["name"]) < below))

    priced, described = sized(priced, None), sized(described, 100)
    bullets = F.filter(sized(bullets, 80), lambda p: F.lower(p["name"]).rlike("|".join(BULLET_WORDS)))
    chosen = F.when(F.size(priced) > 0, priced).when(F.size(described) > 0, described).otherwise(bullets)
    return F.slice(chosen, 1, TEXT_LIMIT)


def _details(name: Column, brand: Column, price: Column, category: Column) -> list[Column]:
    """DETAILS of a product known from the text alone."""
    told = (name, brand, category, F.lit(TEXT_SWATCH), F.lit(TEXT_DISTANCE), price, F.lit(TEXT_IMAGE))
    return [value.alias(column) for value, column in zip(told, DETAILS, strict=True)]


def ground_mentions(turns: DataFrame, tool_products: DataFrame, fallback_k: int = FALLBACK) -> DataFrame:
    """Products of each turn: those named with an id, else the first few the tools returned.

    ``turns(turn_id, text, product_tool_used)``; ``tool_products(turn_id, pos, product_id, *DETAILS)``, of which
    category, swatch_hex, color_distance and image_url may be missing. A named id the tools did not return keeps
    what the text says. When the tools returned nothing but were used, bold names in the text stand in.
    """
    for column in set(DETAILS) - set(tool_products.columns):
        tool_products = tool_products.withColumn(column, F.lit(None).cast("double" if column == "color_distance" else "string"))
    named = parse_mentions(turns)
    lookup = (
        tool_products.filter(F.length("product_id") == ID_LENGTH)
        .groupBy("turn_id", F.lower("product_id").alias("product_id"))
        .agg(F.max_by(F.struct(*DETAILS), "pos").alias("t"))
    )
    plain = F.struct(*_details(F.col("name"), first_word(F.col("name")), F.col("price"), F.lit("")))
    by_id = (
        named.join(lookup, ["turn_id", "product_id"], "left")
        .select("turn_id", "pos", "product_id", F.when(F.col("t").isNotNull(), F.col("t")).otherwise(plain).alias("d"), F.col("t").isNotNull().alias("grounded"), "name")
        .select("turn_id", "pos", "product_id", F.coalesce("d.name", "name").alias("name"), *[f"d.{c}" for c in DETAILS[1:]], "grounded")
    )
    unnamed = turns.filter(~F.col("text").rlike(MENTION))
    first = top_k(tool_products, ["turn_id"], [F.col("pos")], fallback_k, "__r")
    from_tools = first.join(unnamed.select("turn_id"), "turn_id", "left_semi").select(
        "turn_id", F.col("pos").cast("int").alias("pos"), "product_id", *DETAILS, F.lit(True).alias("grounded")
    )
    no_tools = unnamed.filter("product_tool_used").join(tool_products.select("turn_id").distinct(), "turn_id", "left_anti")
    category = F.when(F.lower("p.name").contains(TEXT_CATEGORY_WORD), TEXT_CATEGORY_WORD).otherwise(TEXT_CATEGORY)
    from_text = no_tools.select(
        "turn_id", F.posexplode_outer(F.slice(_text_products(F.col("text")), 1, fallback_k)).alias("pos", "p")
    ).filter("pos IS NOT NULL").select(
        "turn_id", "pos", F.lit("").alias("product_id"),
        *_details(F.col("p.name"), brand_guess(F.col("p.name")), F.col("p.price"), category), F.lit(False).alias("grounded"),
    )
    return by_id.unionByName(from_tools).unionByName(from_text)
