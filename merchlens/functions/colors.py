"""Colour columns: hex parsing, RGB distance, CIELAB and the skin scales derived from it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# sRGB companding, linear RGB to XYZ rows, D65 white, CIELAB curve.
SRGB_CUTOFF, SRGB_OFFSET, SRGB_SCALE, SRGB_GAMMA, SRGB_SLOPE = 0.04045, 0.055, 1.055, 2.4, 12.92
XYZ_ROWS = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.0721750),
    (0.0193339, 0.1191920, 0.9503041),
)
D65_WHITE = (0.95047, 1.0, 1.08883)
LAB_CUTOFF, LAB_SLOPE, LAB_OFFSET = 0.008856, 7.787, 16 / 116

# An ITA angle above the bound gets the grade beside it; below all, the last grade.
FITZPATRICK_BOUNDS = ((55, 1), (41, 2), (28, 3), (10, 4), (-30, 5))
FITZPATRICK_LAST = 6
MONK_BOUNDS = ((55, 1), (48, 2), (41, 3), (34, 4), (28, 5), (19, 6), (10, 7), (-10, 8), (-30, 9))
MONK_LAST = 10


def hex_channel(color: Column, channel: int, default: int | None = None) -> Column:
    """Channel 0, 1 or 2 of ``#rrggbb`` as int.

    A pair that is not two hex digits becomes ``default``; without a default it raises.
    """
    pair = F.substring(color, 2 + 2 * channel, 2)
    value = F.conv(pair, 16, 10).cast("int")
    bad = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("bad colour: "), color)).cast("int")
    return F.when(pair.rlike("^[0-9A-Fa-f]{2}$"), value).otherwise(bad)


def with_hash(color: Column) -> Column:
    return F.when(F.substring(color, 1, 1) == "#", color).otherwise(F.concat(F.lit("#"), color))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0") for c in (r, g, b)])


def _linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c > SRGB_CUTOFF, F.pow((c + SRGB_OFFSET) / SRGB_SCALE, SRGB_GAMMA)).otherwise(c / SRGB_SLOPE)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a and b, each to 2 places."""
    lin = [_linear(c) for c in (r, g, b)]
    curve = []
    for row, white in zip(XYZ_ROWS, D65_WHITE):
        t = sum((c * w for c, w in zip(lin[1:], row[1:])), lin[0] * row[0]) / white
        curve.append(F.when(t > LAB_CUTOFF, F.pow(t, 1 / 3)).otherwise(t * LAB_SLOPE + LAB_OFFSET))
    fx, fy, fz = curve
    return F.round(fy * 116 - 16, 2), F.round((fx - fy) * 500, 2), F.round((fy - fz) * 200, 2)


def ita_angle(lightness: Column, b: Column) -> Column:
    return F.round(F.degrees(F.atan2(lightness - 50, b)), 2)


def _grade(ita: Column, bounds, last: int) -> Column:
    out = F.lit(last)
    for bound, grade in reversed(bounds):
        out = F.when(ita > bound, grade).otherwise(out)
    return F.when(ita.isNotNull(), out)


def fitzpatrick_type(ita: Column) -> Column:
    return _grade(ita, FITZPATRICK_BOUNDS, FITZPATRICK_LAST)


def monk_shade(ita: Column) -> Column:
    return _grade(ita, MONK_BOUNDS, MONK_LAST)


def undertone(a: Column, b: Column) -> Column:
    """warm above 15, cool below 5, neutral between, on a + b."""
    warmth = a + b
    return F.when(warmth > 15, "warm").when(warmth < 5, "cool").when(warmth.isNotNull(), "neutral")
