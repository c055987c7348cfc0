"""Product and customer rows out of loosely shaped JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from merchlens.functions import json_text as J

# Spellings of each product field, best first, and the value when none is filled.
PRODUCT_FIELDS = (
    ("product_id", "string", ("product_id", "PRODUCT_ID"), ""),
    ("name", "string", ("name", "NAME", "PRODUCT_NAME"), None),
    ("brand", "string", ("brand", "BRAND"), ""),
    ("category", "string", ("category", "CATEGORY"), ""),
    ("swatch_hex", "string", ("swatch_hex", "SWATCH_HEX", "color_hex", "COLOR_HEX"), "#f0f0f0"),
    ("color_distance", "double", ("color_distance", "COLOR_DISTANCE"), 5.0),
    ("price", "double", ("price", "PRICE", "current_price", "CURRENT_PRICE"), 0.0),
    ("image_url", "string", ("image_url", "IMAGE_URL", "hero_image_url", "HERO_IMAGE_URL"), ""),
)
CUSTOMER_FIELDS = (
    ("customer_id", "string", ("customer_id", "CUSTOMER_ID"), None),
    ("first_name", "string", ("first_name", "FIRST_NAME"), None),
    ("last_name", "string", ("last_name", "LAST_NAME"), ""),
    ("email", "string", ("email", "EMAIL"), ""),
    ("loyalty_tier", "string", ("loyalty_tier", "LOYALTY_TIER"), "Member"),
    ("points_balance", "double", ("points_balance", "POINTS_BALANCE"), 0.0),
)
ROW_KEYS = ("rows", "data", "results")
EMPTY_JSON = ("null", '""', "[]", "{}", "0", "0.0", "false")
MIN_CONFIDENCE = 0.45
# A table with one of these in its column names holds products.
PRODUCT_COLUMNS = ("product", "name", "brand", "price")
# What a tool returns is told by the words in its name.
PRODUCT_TOOLS = ("match", "product", "search", "analyst")
CUSTOMER_TOOLS = ("identify", "customer")
CART_TOOLS = ("cart", "acp")


def _text(value: Column) -> Column:
    return F.to_json(value)


def _is(value: Column, opener: str) -> Column:
    return F.coalesce(_text(value).startswith(opener), F.lit(False))


def _filled(value: Column) -> Column:
    return F.coalesce(~_text(value).isin(*EMPTY_JSON), F.lit(False))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _items(value: Column) -> Column:
    return F.when(_is(value, "["), F.try_variant_get(value, "$", "array<variant>"))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once per row: later uses do not repeat its expression."""
    return df.withColumn("__once", F.explode(F.array(value))).drop(name).withColumnRenamed("__once", name)


def _opened(df: DataFrame, column: str) -> DataFrame:
    """Read ``column`` as JSON in ``__v``: JSON inside a JSON string is read again, and the one-element
    envelope ``[{"json": ..., "type": ...}]`` is taken off unless it reports an empty error."""
    v = F.col("__v")
    inner = _at(v, "$[0].json")
    enveloped = _is(v, "[") & inner.isNotNull() & _at(v, "$[0].type").isNotNull()
    silent = _is(inner, "{") & _at(inner, "$.error").isNotNull() & ~_filled(_at(inner, "$.error"))
    read = _held(df, "__v", J.strict_variant(F.col(column))).withColumn("__quoted", _is(v, '"'))
    again = F.when(F.col("__quoted"), J.strict_variant(F.try_variant_get(v, "$", "string"))).otherwise(v)
    unquoted = _held(read, "__v", again)
    return _held(unquoted, "__v", F.when(enveloped & ~silent & (_is(inner, "[") | _is(inner, "{")), inner).otherwise(v))


def _first_filled(value: Column, keys) -> Column:
    return F.coalesce(*[F.when(_filled(_at(value, f"$.{k}")), _at(value, f"$.{k}")) for k in keys])


def _fields(item: Column, spec) -> list[Column]:
    out = []
    for name, kind, spellings, default in spec:
        value = J.first_filled(item, spellings, kind)
        out.append((value if default is None else F.coalesce(value, F.lit(default))).alias(name))
    return out


def normalize_products(results: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """Product rows ``(key, pos, product_id, name, ...)`` of every JSON result.

    Understands a list, an object with ``result`` (JSON text, list or object inside), ``rows`` / ``data`` /
    ``results``, and any of these as JSON text. Items without a name are dropped.
    """
    opened = _opened(results.select(key, content), content)
    v = F.col("__v")
    result = _at(v, "$.result")
    reread = J.strict_variant(F.try_variant_get(result, "$", "string"))
    held = F.col("__held")
    rows = (
        opened.withColumn("__result", F.when(_filled(result), F.when(_is(result, '"'), reread).otherwise(result)))
        .withColumn("__has_result", _filled(result) & ~F.col("__quoted"))
        .withColumn("__held", F.when(F.col("__quoted"), _first_filled(v, ROW_KEYS[:2])).otherwise(_first_filled(v, ROW_KEYS)))
    )
    given = F.col("__result")
    from_result = F.when(_is(given, "["), _items(given)).when(_is(result, '"') & _is(given, "{"), F.array(given))
    from_object = F.when(F.col("__has_result"), from_result).when(_is(held, "["), _items(held)).when(
        held.isNotNull() & ~F.col("__quoted"), F.array(v)
    )
    items = F.when(_is(v, "["), _items(v)).when(_is(v, "{"), from_object)
    listed = rows.select(key, F.posexplode_outer(items).alias("pos", "__item"))
    return listed.select(key, "pos", *_fields(F.col("__item"), PRODUCT_FIELDS)).filter("name IS NOT NULL")


def normalize_tables(tables: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """Product rows of JSON tables: ``columns`` with ``rows`` (or ``data``) that are lists or objects.

    A table counts only when a column name speaks of products; a row of another length than the columns
    is dropped. A plain list is read as a list of objects.
    """
    v = F.col("__v")
    read = _held(tables.select(key, content), "__v", J.strict_variant(F.col(content)))
    heads = F.transform(
        F.try_variant_get(v, "$.columns", "array<variant>"),
        lambda c: F.when(_is(c, "{"), F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit(""))).otherwise(F.try_variant_get(c, "$", "string")),
    )
    named = _held(read, "__heads", heads)
    spoken = F.lower(F.array_join("__heads", " ")).rlike("|".join(PRODUCT_COLUMNS))
    rows = F.when(_is(v, "["), _items(v)).when(spoken, _items(_first_filled(v, ROW_KEYS[:2])))
    listed = named.select(key, "__heads", F.posexplode_outer(rows).alias("pos", "__row"))
    cells = F.try_variant_get("__row", "$", "array<variant>")
    as_list = _is(F.col("__row"), "[") & (F.size(cells) == F.size("__heads"))
    by_head = F.to_json(F.map_from_arrays(F.col("__heads"), cells))
    item = F.when(_is(F.col("__row"), "{"), F.col("__row")).when(as_list, F.try_parse_json(by_head))
    items = _held(listed, "__item", item)
    return items.select(key, "pos", *_fields(F.col("__item"), PRODUCT_FIELDS)).filter("name IS NOT NULL")


def pick_match(
    results: DataFrame, key: str = "key", content: str = "content", min_conf: float = MIN_CONFIDENCE, compat: bool = False
) -> DataFrame:
    """The first customer in each result whose confidence is above ``min_conf``.

    Confidence is stated or 1 - distance; without either 0.5. ``compat`` reads distance 0 as missing.
    """
    opened = _opened(results.select(key, content), content).filter(
        ~(_is(F.col("__v"), "{") & _at(F.col("__v"), "$.error").isNotNull())
    )
    v = F.col("__v")
    held = _first_filled(v, ROW_KEYS)
    from_object = (
        F.when(_at(v, "$.matches").isNotNull(), _items(_at(v, "$.matches")))
        .when(F.col("__quoted"), None)
        .when(_is(held, "["), _items(held))
        .when(held.isNotNull(), F.array(v))
    )
    items = F.when(_is(v, "["), _items(v)).when(_is(v, "{"), from_object)
    zero_free = (lambda c: F.nullif(c, F.lit(0.0))) if compat else (lambda c: c)

    def confidence(item: Column) -> Column:
        distance = F.coalesce(*[zero_free(F.try_variant_get(item, f"$.{n}", "double")) for n in ("distance", "DISTANCE")])
        stated = F.coalesce(
            F.nullif(F.try_variant_get(item, "$.match_confidence", "double"), F.lit(0.0)),
            F.try_variant_get(item, "$.MATCH_CONFIDENCE", "double"),
        )
        return F.coalesce(stated, F.greatest(F.lit(0.0), 1 - F.coalesce(distance, F.lit(0.5))))

    listed = _held(opened, "__items", items)
    people = F.transform("__items", lambda i: F.struct(*_fields(i, CUSTOMER_FIELDS), confidence(i).alias("confidence")))
    good = F.filter(people, lambda p: p["customer_id"].isNotNull() & p["first_name"].isNotNull() & (p["confidence"] > min_conf))
    return listed.select(key, F.inline_outer(F.slice(good, 1, 1))).filter("customer_id IS NOT NULL")


def _calls(turns: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """``(key(turn_id, call), content)`` of the results whose tool's name holds one of the words, in any case."""
    named = F.coalesce(F.lower(F.col("__result.name")), F.lit("")).rlike("|".join(words))
    calls = turns.filter(F.size("tool_results") > 0).select("turn_id", F.posexplode("tool_results").alias("call", "__result"))
    return calls.filter(named).select(F.struct("turn_id", "call").alias("key"), F.col("__result.content").alias("content"))


def products_of_turns(turns: DataFrame) -> DataFrame:
    """(turn_id, source, call, pos, product_id, name, ...): products of assembled turns.

    Those of product tools come first, chosen by the tool's name, in the order of calls; then those of the turn's
    tables. Failed turns have neither. ``source`` is 'tool' or 'table', ``call`` the place of the result or table.
    """
    tables = turns.filter(F.size("tables") > 0).select("turn_id", F.posexplode("tables").alias("call", "content"))
    tables = tables.select(F.struct("turn_id", "call").alias("key"), "content")
    told = normalize_products(_calls(turns, PRODUCT_TOOLS)).withColumn("source", F.lit("tool")).unionByName(
        normalize_tables(tables).withColumn("source", F.lit("table"))
    )
    return told.select("key.turn_id", "source", "key.call", "pos", *[name for name, *_ in PRODUCT_FIELDS])


def customer_of_turns(turns: DataFrame, min_conf: float = MIN_CONFIDENCE, compat: bool = False) -> DataFrame:
    """The customer that each assembled turn has identified: of several identifying calls the last with a match counts."""
    found = pick_match(_calls(turns, CUSTOMER_TOOLS), min_conf=min_conf, compat=compat)
    row = F.struct(*[name for name, *_ in CUSTOMER_FIELDS], "confidence")
    return found.groupBy(F.col("key.turn_id").alias("turn_id")).agg(F.max_by(row, "key.call").alias("__row")).select("turn_id", "__row.*")


def cart_of_turns(turns: DataFrame) -> DataFrame:
    """(turn_id, cart_update): the last readable result of a cart tool in each assembled turn, as JSON text."""
    calls = _calls(turns, CART_TOOLS).withColumn("__v", J.strict_variant(F.col("content"))).filter("__v IS NOT NULL")
    return calls.groupBy(F.col("key.turn_id").alias("turn_id")).agg(F.max_by(F.to_json("__v"), "key.call").alias("cart_update"))
