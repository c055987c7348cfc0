"""Derived product columns and skin profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from merchlens.functions import colors as C

# Skin types a finish suits.
FINISH_SKIN_TYPES = (
    (("matte", "powder"), ("oily", "combination")),
    (("dewy", "cream", "satin"), ("dry", "combination")),
    (("natural", "semi-matte"), ("normal", "combination")),
)
OTHER_SKIN_TYPES = ("combination",)


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def skin_types_of_finish(finish: Column) -> Column:
    out = _texts(OTHER_SKIN_TYPES)
    for finishes, types in reversed(FINISH_SKIN_TYPES):
        out = F.when(finish.isin(*finishes), _texts(types)).otherwise(out)
    return out


def non_allergen_products(ingredients: DataFrame) -> DataFrame:
    """Products with at least one ingredient that is not an allergen."""
    return ingredients.filter(~F.col("is_allergen")).select("product_id").distinct()


def derive_skin_types(products: DataFrame, ingredients: DataFrame, strict: bool = False) -> DataFrame:
    """Fill empty skin types from the finish, then add 'sensitive'.

    By default a product earns 'sensitive' with one non-allergen ingredient; with ``strict`` only when
    it has ingredients and none of them is an allergen.
    """
    types = F.col("skin_type_compatibility")
    filled = products.withColumn(
        "skin_type_compatibility",
        F.when(types.isNull() | (F.size(types) == 0), skin_types_of_finish(F.col("finish"))).otherwise(types),
    )
    if strict:
        mild = (
            ingredients.groupBy("product_id")
            .agg(F.max(F.col("is_allergen").cast("int")).alias("worst"))
            .filter("worst = 0")
            .select("product_id")
        )
    else:
        mild = non_allergen_products(ingredients)
    marked = filled.join(mild.withColumn("__mild", F.lit(True)), "product_id", "left")
    types = F.col("skin_type_compatibility")
    return marked.withColumn(
        "skin_type_compatibility",
        F.when(F.col("__mild") & ~F.array_contains(types, "sensitive"), F.array_append(types, F.lit("sensitive"))).otherwise(types),
    ).drop("__mild")


def skin_profile(samples: DataFrame) -> DataFrame:
    """Skin and lip colour, CIELAB, skin scales and undertone per image, from sampled pixels.

    ``samples(image_id, region, x, y, w, h, r, g, b)``; points outside the image are ignored and images
    without a skin sample give no row. Channel means are cut to whole numbers.
    """
    inside = samples.filter("x >= 0 AND x < w AND y >= 0 AND y < h")

    def mean(region: str, channel: str) -> Column:
        return F.avg(F.when(F.col("region") == region, F.col(channel))).cast("int").alias(f"{region}_{channel}")

    means = inside.groupBy("image_id").agg(*[mean(reg, ch) for reg in ("skin", "lip") for ch in "rgb"])
    skin = [F.col(f"skin_{ch}") for ch in "rgb"]
    lip = [F.col(f"lip_{ch}") for ch in "rgb"]
    light, a, b = C.rgb_to_lab(*skin)
    lab = (
        means.filter("skin_r IS NOT NULL")
        .withColumns({"lab_l": light, "lab_a": a, "lab_b": b})
        .withColumn("ita_angle", C.ita_angle(F.col("lab_l"), F.col("lab_b")))
    )
    ita = F.col("ita_angle")
    return lab.select(
        "image_id",
        C.rgb_to_hex(*skin).alias("skin_hex"),
        F.array(*skin).alias("skin_rgb"),
        F.array("lab_l", "lab_a", "lab_b").alias("skin_lab"),
        F.when(lip[0].isNotNull(), C.rgb_to_hex(*lip)).alias("lip_hex"),
        F.when(lip[0].isNotNull(), F.array(*lip)).alias("lip_rgb"),
        C.fitzpatrick_type(ita).alias("fitzpatrick_type"),
        C.monk_shade(ita).alias("monk_shade"),
        C.undertone(F.col("lab_a"), F.col("lab_b")).alias("undertone"),
        "ita_angle",
        F.lit(0.9).alias("confidence_score"),
    )
