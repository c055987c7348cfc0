import math

import pytest
from pyspark.sql import functions as F

from merchlens.functions import bands, colors, json_text, text, vectors


def values(spark, kind, items, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("out")).collect()]


def test_similarity_band_edges(spark):
    got = values(spark, "double", [1.0, 0.95, 0.9499, 0.85, 0.70, 0.6999, None], bands.similarity_band)
    assert got == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "NONE", "NONE"]


def test_distance_band_edges(spark):
    assert values(spark, "double", [0.0, 0.3999, 0.40, 0.5499, 0.55], bands.distance_band) == [
        "high", "high", "medium", "medium", "none",
    ]


def test_match_confidence(spark):
    assert values(spark, "double", [0.0, 0.3, 2.0, None], bands.match_confidence) == [1.0, 0.7, 0.0, 0.5]
    assert values(spark, "double", [0.0], lambda c: bands.match_confidence(c, compat=True)) == [0.5]


def test_hex_channels(spark):
    items = ["#0aFf10", "#GG0000", None, "#12"]
    assert values(spark, "string", items, lambda c: colors.hex_channel(c, 0, 7)) == [10, 7, 7, 18]
    assert values(spark, "string", items[:2], lambda c: colors.hex_channel(c, 1, 7)) == [255, 0]
    with pytest.raises(Exception, match="bad colour"):
        values(spark, "string", ["#GG0000"], lambda c: colors.hex_channel(c, 0))


def test_with_hash(spark):
    assert values(spark, "string", ["aabbcc", "#aabbcc"], colors.with_hash) == ["#aabbcc", "#aabbcc"]


def test_lab_of_known_colors(spark):
    known = {(255, 255, 255): (100.0, 0.01, -0.01), (0, 0, 0): (0.0, 0.0, 0.0), (255, 0, 0): (53.24, 80.09, 67.2)}
    df = spark.createDataFrame(list(known), "r int, g int, b int")
    for r in df.select("*", *[c.alias(n) for c, n in zip(colors.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")), "LAB")]).collect():
        want = known[(r.r, r.g, r.b)]
        assert all(math.isclose(a, w, abs_tol=0.02) for a, w in zip((r.L, r.A, r.B), want)), (r, want)


def test_skin_scales_are_strict(spark):
    edges = [55.01, 55.0, 41.0, 28.0, 10.0, -10.0, -30.0]
    assert values(spark, "double", edges, colors.fitzpatrick_type) == [1, 2, 3, 4, 5, 5, 6]
    assert values(spark, "double", edges, colors.monk_shade) == [1, 2, 4, 6, 8, 9, 10]


def test_undertone(spark):
    assert values(spark, "double", [15.01, 15.0, 5.0, 4.99, None], lambda c: colors.undertone(c, F.lit(0.0))) == [
        "warm", "neutral", "neutral", "cool", None,
    ]


def test_uuid_shape(spark):
    good = "026912b9-b508-421e-b807-7d265158b96a"
    assert values(spark, "string", [good, good[:-1], good.replace("-", "x"), "x" * 36], text.looks_like_uuid) == [True, False, False, False]
    made = values(spark, "string", ["a", "b"], lambda c: text.uuid_from(c))
    assert len(set(made)) == 2 and all(len(m) == 36 for m in made)


def test_sku_from_path(spark):
    path = ["labels/ANA-EYE-0013_tabular.png", "ANA-Lipstick-Label.jpeg"]
    assert values(spark, "string", path, text.sku_from_path) == ["ANA-EYE-0013", "ANA-Lipstick-Label"]
    assert values(spark, "string", path, lambda c: text.sku_from_path(c, compat=True))[0] == "labels/ANA-EYE-0013"


def test_brand_guess(spark):
    names = ["The Ordinary Serum", "Luxe Pro Foundation", "Solo", "mac Blush"]
    assert values(spark, "string", names, text.brand_guess) == ["The", "Luxe Pro", "Solo", "mac"]


def test_human_numbers(spark):
    assert values(spark, "double", [950.0, 1234.0, 2_500_000.0], text.human_number) == ["950", "1.2K", "2.5M"]
    assert values(spark, "double", [1500.0], text.human_currency) == ["$1.5K"]


def test_cents(spark):
    assert values(spark, "decimal(10,2)", [None], text.cents) == [None]
    assert values(spark, "double", [11.67, 0.29], text.cents) == [1167, 29]


def test_joined_blank_keeps_gaps(spark):
    assert values(spark, "string", [None], lambda c: text.joined_blank(F.lit("a"), c, F.lit("b"))) == ["a  b"]


def test_words_cover_other_alphabets(spark):
    assert values(spark, "string", ["Été, L'Oréal 24h!"], text.words) == [["été", "l", "oréal", "24h"]]


def test_strict_json(spark):
    items = ['{"a":1}', '{"a":1} {b}', "{bad", '{"a":"}"}', None, '{"a":1},{"b":2}']
    assert values(spark, "string", items, lambda c: json_text.strict_variant(c).isNotNull()) == [True, False, False, True, False, False]


def test_outermost_object_is_greedy(spark):
    assert values(spark, "string", ['x {"a":\n{}} y } z', "none"], json_text.outermost_object) == ['{"a":\n{}} y }', None]


def test_vectors(spark):
    assert values(spark, "array<double>", [[3.0, 4.0]], vectors.norm) == [5.0]
    assert values(spark, "array<double>", [[3.0, 4.0], [0.0, 0.0]], vectors.unit) == [[0.6, 0.8], None]
    assert values(spark, "array<double>", [[3.0, 4.0]], lambda c: vectors.cosine(c, c)) == [1.0]
    assert values(spark, "string", ["[1,2]", "[1]", "[1,null]", "x"], lambda c: vectors.vector_from_json(c, 2)) == [[1.0, 2.0], None, None, None]
