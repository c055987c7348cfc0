"""Text columns: ids, paths, titles, tokens and number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}]+"
UUID_DASHES = (9, 14, 19, 24)


def looks_like_uuid(value: Column) -> Column:
    """36 characters with dashes at positions 9, 14, 19 and 24."""
    shape = F.length(value) == 36
    for at in UUID_DASHES:
        shape = shape & (F.substring(value, at, 1) == "-")
    return shape


def uuid_from(*parts: Column) -> Column:
    """A UUID-shaped id that depends only on ``parts``, so a re-run task gives the same id."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in cuts])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sku_from_path(path: Column, compat: bool = False) -> Column:
    """First ``_`` token of the file name without ``.png`` / ``.jpeg``.

    ``compat`` keeps folder names in front of the SKU.
    """
    name = path if compat else base_name(path)
    bare = F.replace(F.replace(name, F.lit(".png"), F.lit("")), F.lit(".jpeg"), F.lit(""))
    return F.split_part(bare, F.lit("_"), F.lit(1))


def without_quotes(text: Column) -> Column:
    """The text without single and double quotation marks."""
    return F.translate(text, "\"'", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, over the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def joined_blank(*parts: Column) -> Column:
    """Parts joined by one space each, NULL as ''. Unlike concat_ws this keeps the gap."""
    out = []
    for part in parts:
        out += [F.lit(" "), F.coalesce(part, F.lit(""))]
    return F.concat(*out[1:])


# Brands that are one word long.
ONE_WORD_BRANDS = ("the", "nars", "mac", "nyx")


def first_word(name: Column) -> Column:
    return F.regexp_extract(name, r"^\s*(\S+)", 1)


def brand_guess(name: Column) -> Column:
    """First two words of a product name, or one when it is a known one-word brand."""
    parts = F.split(F.trim(name), r"\s+")
    head = F.element_at(parts, 1)
    return F.when((F.size(parts) < 2) | F.lower(head).isin(*ONE_WORD_BRANDS), head).otherwise(
        F.array_join(F.slice(parts, 1, 2), " ")
    )


def human_number(value: Column, prefix: str = "") -> Column:
    """1.5M, 2.3K or 950."""
    x = value.cast("double")
    return (
        F.when(x >= 1_000_000, F.format_string(f"{prefix}%.1fM", x / 1_000_000))
        .when(x >= 1_000, F.format_string(f"{prefix}%.1fK", x / 1_000))
        .otherwise(F.format_string(f"{prefix}%,.0f", x))
    )


def human_currency(value: Column) -> Column:
    return human_number(value, "$")


def cents(price: Column) -> Column:
    return F.round(price * 100).cast("long")


def dollars(amount_cents: Column) -> Column:
    return F.round(amount_cents / F.lit(100.0), 2)


def order_number(at: Column, *seed: Column) -> Column:
    """ORD-YYYYMMDD-xxxxxx with the tail taken from a digest of ``seed``."""
    tail = F.substring(F.md5(F.concat_ws("|", *[s.cast("string") for s in seed])), 1, 6)
    return F.concat(F.lit("ORD-"), F.date_format(at, "yyyyMMdd"), F.lit("-"), tail)
