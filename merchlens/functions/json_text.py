"""JSON held in text columns, read through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def outermost_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, across lines."""
    return F.regexp_substr(text, F.lit(r"(?s)\{.*\}"))


def strict_variant(text: Column) -> Column:
    """The text as one JSON value; NULL when it is not valid or when anything follows it.

    The parser stops after the first value, so the text is read as the only element of an array.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    only = F.size(F.try_variant_get(boxed, "$", "array<variant>")) == 1
    return F.when(only, F.try_variant_get(boxed, "$[0]", "variant"))


def json_string(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def json_strings(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<string>")


def joined_section(value: Column, path: str) -> Column:
    """A JSON array as text joined by `` | ``; NULL when absent, '' when empty."""
    return F.array_join(json_strings(value, path), " | ", "")


def first_filled(value: Column, names, kind: str = "string") -> Column:
    """First of several spellings of a field that is neither NULL nor empty ('' or 0)."""
    empty = F.lit("") if kind == "string" else F.lit(0).cast(kind)
    return F.coalesce(*[F.nullif(F.try_variant_get(value, f"$.{n}", kind), empty) for n in names])


def json_shape(value: Column) -> Column:
    """ARRAY, OBJECT or a scalar type name."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)
