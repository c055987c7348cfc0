"""Label documents: from file path and model text to columns, report rows and search text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from merchlens.functions import json_text as J
from merchlens.functions.text import joined_blank, sku_from_path
from merchlens.operators.infer import batch_infer

FIELDS = ("brand", "product_name", "net_weight", "spf")
SECTIONS = ("warnings", "directions", "other_information", "inactive_ingredients")

# The report's captions and sort numbers.
RULE_NAME, RULE_VALUE = "─────────────", "─────────────────────────────────────────"
FIELD_ROWS = ((1, "🏷️ Brand", "brand"), (2, "📦 Product Name", "product_name"), (3, "⚖️ Net Weight", "net_weight"), (4, "☀️ SPF", "spf"))
RULE_ROWS = (5, 50, 80, 100)
SECTION_ROWS = (
    (6, 10, "⚠️ WARNINGS", "  ⚠️ #", "warnings"),
    (51, 60, "📝 DIRECTIONS", "  📝 #", "directions"),
    (81, 90, "ℹ️ OTHER INFO", "  ℹ️ #", "other_information"),
    (101, 110, "🧪 INGREDIENTS", "  🧪 #", "inactive_ingredients"),
)


def parse_labels(raw: DataFrame, compat_sku: bool = False) -> DataFrame:
    """``raw(file_path, raw_result)`` to SKU, four fields, four joined sections and the JSON itself.

    The JSON is whatever lies between the first ``{`` and the last ``}``; anything malformed gives NULLs.
    """
    data = F.col("__data")
    return (
        raw.withColumn("__data", J.strict_variant(J.outermost_object(F.col("raw_result"))))
        .select(
            "file_path",
            sku_from_path(F.col("file_path"), compat_sku).alias("sku"),
            *[J.json_string(data, f"$.{f}").alias(f) for f in FIELDS],
            *[J.joined_section(data, f"$.{s}").alias(s) for s in SECTIONS],
            data.alias("raw_json"),
        )
    )


def extract_labels(files: DataFrame, model_fn: Callable[[object], str]) -> DataFrame:
    """Run the model over ``files(file_path, content)`` and parse what it says."""
    said = batch_infer(files, "file_path", "content", model_fn)
    return parse_labels(said.select("file_path", F.col("result").alias("raw_result")))


def flatten_label(parsed: DataFrame) -> DataFrame:
    """Label report rows ``(file_path, sort, property, value)``, in one pass over the parsed table.

    A section that is absent has a heading with a NULL count; NULL entries give no row.
    """
    data = F.col("raw_json")

    def row(sort: Column, name: Column, value: Column) -> Column:
        return F.struct(sort.cast("int").alias("sort"), name.alias("property"), value.alias("value"))

    def numbering(base: int, item: str):
        return lambda v, i: row(i + base, F.concat(F.lit(item), (i + 1).cast("string")), v)

    rows = []
    for sort, caption, field in FIELD_ROWS:
        value = J.json_string(data, f"$.{field}")
        rows.append(row(F.lit(sort), F.lit(caption), F.coalesce(value, F.lit("N/A")) if field == "spf" else value))
    rows += [row(F.lit(s), F.lit(RULE_NAME), F.lit(RULE_VALUE)) for s in RULE_ROWS]
    lists = []
    for sort, base, caption, item, section in SECTION_ROWS:
        entries = J.json_strings(data, f"$.{section}")
        rows.append(row(F.lit(sort), F.lit(caption), F.concat(F.lit("("), F.size(entries).cast("string"), F.lit(" items)"))))
        numbered = F.filter(F.transform(entries, numbering(base, item)), lambda x: x["value"].isNotNull())
        lists.append(F.coalesce(numbered, F.array().cast("array<struct<sort:int,property:string,value:string>>")))
    return parsed.select("file_path", F.inline_outer(F.concat(F.array(*rows), *lists)))


def label_search_text(parsed: DataFrame) -> DataFrame:
    """Label rows with one searchable text; missing parts leave their gap."""
    text = joined_blank(*[F.col(c) for c in ("brand", "product_name", *SECTIONS)])
    return parsed.select("sku", "file_path", "brand", "product_name", "net_weight", "spf", text.alias("search_content"))
