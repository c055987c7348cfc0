"""Carts and orders as a fold of a command log.

``log(seq, ts, session_id, customer_id, command, item_ref, product_id, variant_id, quantity)`` holds one
row per command, ``seq`` unique and increasing. Commands: create, add, update, remove, checkout. Every add
opens a new line. Update and remove act on the newest open line of the same ``item_ref`` in the session.
Neither a session nor an item has to fit into one task: see ``spread``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from merchlens.functions.text import cents, dollars, order_number, uuid_from
from merchlens.operators.spread import CHUNK_ROWS, following, running, seq_chunk
from merchlens.session import settled

ITEM = ["session_id", "item_ref"]
LINE = [*ITEM, "level", "line"]


def priced_commands(log: DataFrame, products: DataFrame) -> DataFrame:
    """Item commands; adds carry the product's name and price at that time, unknown products drop out."""
    catalog = products.select(
        "product_id", F.col("name").alias("product_name"), cents(F.col("current_price")).alias("unit_price_cents")
    ).filter("unit_price_cents IS NOT NULL")
    adds = log.filter("command = 'add'").join(catalog, "product_id")
    return adds.unionByName(log.filter("command IN ('update', 'remove')"), allowMissingColumns=True)


def rejected_adds(log: DataFrame, products: DataFrame) -> DataFrame:
    known = products.filter("current_price IS NOT NULL").select("product_id")
    return log.filter("command = 'add'").join(known, "product_id", "left_anti").select(
        "seq", "session_id", "product_id",
        F.concat(F.lit("Product not found with ID: "), F.coalesce(F.col("product_id").cast("string"), F.lit(""))).alias("error"),
    )


def with_levels(commands: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``level``: how deep in the item's stack of open lines a command acts (0 = no open line).

    Open lines are counted as adds minus removes, never below zero. The count runs inside chunks; each
    chunk passes on its total and its lowest point.
    """
    step = F.when(F.col("command") == "add", 1).when(F.col("command") == "remove", -1).otherwise(0)
    cut = commands.withColumn("__chunk", seq_chunk("seq", chunk_rows)).withColumn("__step", step)
    inside = Window.partitionBy(*ITEM, "__chunk").orderBy("seq")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__sum", F.sum("__step").over(upto)).withColumn("__low", F.min("__sum").over(before))
    chunks = local.groupBy(*ITEM, "__chunk").agg(F.sum("__step").alias("__total"), F.min("__sum").alias("__dip"))
    earlier = Window.partitionBy(*ITEM).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunks.withColumn("__base", F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
        .withColumn("__floor", F.min(F.col("__base") + F.col("__dip")).over(earlier))
        .select(*ITEM, "__chunk", "__base", "__floor")
    )
    joined = local.join(carried, [*ITEM, "__chunk"])
    lowest = F.least(F.lit(0), "__floor", F.col("__base") + F.col("__low"))
    open_before = F.col("__base") + F.col("__sum") - F.col("__step") - lowest
    level = F.when(F.col("command") == "add", open_before + 1).otherwise(open_before)
    return joined.select(*commands.columns, level.cast("int").alias("level"))


def line_commands(log: DataFrame, products: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Item commands that act on a line, with ``level`` and ``line`` naming it.

    The levels are stored first: the running count reads them twice.
    """
    acting = settled(with_levels(priced_commands(log, products), chunk_rows).filter("level > 0"), "levels")
    is_add = (F.col("command") == "add").cast("int")
    return running(acting, [*ITEM, "level"], [F.col("seq")], seq_chunk("seq", chunk_rows), {"line": ("sum", is_add)})


def not_found(log: DataFrame, products: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Update and remove commands that met no open line."""
    return with_levels(priced_commands(log, products), chunk_rows).filter("level = 0").select(
        "seq", "session_id", "command",
        F.concat(F.lit("Cart item not found: "), F.col("item_ref").cast("string")).alias("error"),
    )


def _lines(commands: DataFrame) -> DataFrame:
    add = F.col("command") == "add"
    sets = F.col("command").isin("add", "update")
    return commands.groupBy(*LINE).agg(
        F.max(F.when(add, F.col("seq"))).alias("add_seq"),
        F.max(F.when(add, F.col("ts"))).alias("added_at"),
        F.max(F.when(add, F.col("product_id"))).alias("product_id"),
        F.max(F.when(add, F.col("variant_id"))).alias("variant_id"),
        F.max(F.when(add, F.col("product_name"))).alias("product_name"),
        F.max(F.when(add, F.col("unit_price_cents"))).alias("unit_price_cents"),
        F.max_by("quantity", F.when(sets, F.col("seq"))).alias("quantity"),
        F.max((F.col("command") == "remove").cast("int")).alias("removed"),
    )


def _item_id() -> Column:
    return uuid_from(F.col("session_id"), F.col("item_ref"), F.col("add_seq")).alias("item_id")


def fold_items(log: DataFrame, products: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Open cart lines at the end of the log, priced when they were added."""
    return (
        _lines(line_commands(log, products, chunk_rows))
        .filter("removed = 0")
        .select(
            _item_id(), "session_id", "product_id", "variant_id", "quantity", "unit_price_cents",
            (F.col("unit_price_cents") * F.col("quantity")).alias("subtotal_cents"), "product_name", "added_at", "add_seq",
        )
    )


def cart_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("session_id").agg(
        F.coalesce(F.sum("subtotal_cents"), F.lit(0)).alias("subtotal_cents"), F.count("*").alias("item_count")
    )


def fold_sessions(log: DataFrame, items: DataFrame) -> DataFrame:
    """One row per session in the log; completed once a checkout ran. Total equals subtotal."""
    heads = log.groupBy("session_id").agg(
        F.min_by("customer_id", "seq").alias("customer_id"),
        F.max((F.col("command") == "checkout").cast("int")).alias("__done"),
        F.min("ts").alias("created_at"),
        F.max(F.when(F.col("command") != "create", F.col("ts"))).alias("updated_at"),
    )
    totals = cart_totals(items).select("session_id", "subtotal_cents")
    subtotal = F.coalesce("subtotal_cents", F.lit(0))
    return heads.join(totals, "session_id", "left").select(
        "session_id",
        "customer_id",
        F.when(F.col("__done") == 1, "completed").otherwise("active").alias("status"),
        subtotal.alias("subtotal_cents"),
        subtotal.alias("total_cents"),
        F.lit("USD").alias("currency"),
        "created_at",
        "updated_at",
    )


def cart_snapshot(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Cart header repeated on each of its items; an empty cart keeps one row without an item."""
    counts = items.groupBy("session_id").agg(F.count("*").alias("item_count"))
    heads = sessions.join(counts, "session_id", "left").select(
        "session_id", "customer_id", "status", "currency", F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.col("subtotal_cents").alias("cart_subtotal_cents"), F.col("total_cents").alias("cart_total_cents"), "created_at",
    )
    lines = items.select(
        "session_id", "item_id", "product_id", "product_name", "variant_id", "quantity", "unit_price_cents", "subtotal_cents"
    )
    return heads.join(lines, "session_id", "left")


ITEM_FIELDS = ("add_seq", "item_id", "product_id", "product_name", "variant_id", "quantity", "unit_price_cents", "subtotal_cents")


def cart_documents(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """One row per cart: its header, and all its items as an array in add order, however many there are."""
    listed = items.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*ITEM_FIELDS))).alias("items"))
    blank = F.array().cast(listed.schema["items"].dataType)
    whole = F.coalesce("items", blank)
    return sessions.join(listed, "session_id", "left").select(
        "session_id", "customer_id", "status", "currency", whole.alias("items"), F.size(whole).cast("long").alias("item_count"),
        "subtotal_cents", "total_cents", "created_at",
    )


def cart_pages(sessions: DataFrame, items: DataFrame, page_rows: int = 1000, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``cart_documents`` in pages of at most ``page_rows`` items, for readers that ask for bounded rows."""
    placed = running(items, ["session_id"], [F.col("add_seq")], seq_chunk("add_seq", chunk_rows), {"__pos": ("sum", F.lit(1))})
    record = F.struct(*ITEM_FIELDS)
    pages = (
        placed.withColumn("page", F.floor((F.col("__pos") - 1) / page_rows))
        .groupBy("session_id", "page")
        .agg(F.array_sort(F.collect_list(record)).alias("items"))
    )
    counts = items.groupBy("session_id").agg(F.count("*").alias("item_count"))
    blank = F.array().cast(pages.schema["items"].dataType)
    return (
        sessions.join(counts, "session_id", "left")
        .join(pages, "session_id", "left")
        .select(
            "session_id", "customer_id", "status", "currency", F.coalesce("page", F.lit(0)).alias("page"),
            F.coalesce("items", blank).alias("items"), F.coalesce("item_count", F.lit(0)).alias("item_count"),
            "subtotal_cents", "total_cents", "created_at",
        )
    )


def checkout(
    log: DataFrame, products: DataFrame, chunk_rows: int = CHUNK_ROWS, tile_orders: int = 1024
) -> tuple[DataFrame, DataFrame]:
    """(orders, order_items). Every checkout copies the lines open at that moment; an empty cart gives a
    0-total order and a second checkout copies the cart again.

    Per line only the last state before each checkout is kept, as a span of checkouts it is part of. Spans are cut
    where tiles of ``tile_orders`` checkouts end, and each piece meets the checkouts of its tile: a line that stays open
    over many checkouts is worked on in as many places, and no row lists them.
    """
    seq = [F.col("seq")]
    counted = running(
        log, ["session_id"], seq, seq_chunk("seq", chunk_rows),
        {"orders_before": ("sum", (F.col("command") == "checkout").cast("long"))}, exclude_current=True,
    )
    counted = settled(counted, "counted-commands")
    commands = settled(line_commands(counted, products, chunk_rows), "line-commands")
    states = commands.groupBy(*LINE, "orders_before").agg(
        F.max_by(F.struct("command", "quantity"), "seq").alias("state")
    )
    spans = following(
        states, LINE, [F.col("orders_before")], seq_chunk("orders_before", chunk_rows), {"__until": F.col("orders_before")}
    ).filter("state.command <> 'remove'")
    ends = log.filter("command = 'checkout'").groupBy("session_id").agg(F.count("*").alias("__orders"))
    closed = spans.join(ends, "session_id").withColumn("__until", F.coalesce("__until", "__orders"))
    tile = lambda ordinal: F.floor(ordinal / tile_orders)
    pieces = closed.filter("__until > orders_before").withColumn(
        "__tile", F.explode(F.sequence(tile(F.col("orders_before") + 1), tile(F.col("__until"))))
    )
    ordinal = F.col("orders_before") + 1
    made = counted.filter("command = 'checkout'").select("session_id", ordinal.alias("order_ordinal"), tile(ordinal).alias("__tile"))
    inside = F.col("order_ordinal").between(F.col("orders_before") + 1, F.col("__until"))
    sold = pieces.join(made, ["session_id", "__tile"]).filter(inside).drop("__tile", "orders_before")
    lines = _lines(commands).select(*LINE, "add_seq", "product_id", "variant_id", "product_name", "unit_price_cents")
    order_id = uuid_from(F.col("session_id"), F.col("order_ordinal"))
    order_items = sold.join(lines, LINE).select(
        uuid_from(F.col("session_id"), F.col("order_ordinal"), F.col("item_ref"), F.col("add_seq")).alias("order_item_id"),
        order_id.alias("order_id"), "session_id", "order_ordinal", "product_id", "variant_id",
        F.col("state.quantity").alias("quantity"), "unit_price_cents",
        (F.col("unit_price_cents") * F.col("state.quantity")).alias("subtotal_cents"), "product_name",
    )
    totals = order_items.groupBy("session_id", "order_ordinal").agg(
        F.sum("subtotal_cents").alias("__sum"), F.count("*").alias("__n")
    )
    total = F.coalesce("__sum", F.lit(0))
    orders = (
        counted.filter("command = 'checkout'")
        .withColumn("order_ordinal", F.col("orders_before") + 1)
        .join(totals, ["session_id", "order_ordinal"], "left")
        .select(
            order_id.alias("order_id"),
            order_number(F.col("ts"), F.col("session_id"), F.col("order_ordinal")).alias("order_number"),
            "session_id", "order_ordinal", "customer_id", F.lit("confirmed").alias("status"),
            F.coalesce("__n", F.lit(0)).alias("item_count"), total.alias("subtotal_cents"),
            F.lit(0).alias("tax_cents"), F.lit(0).alias("shipping_cents"), F.lit(0).alias("discount_cents"),
            total.alias("total_cents"), dollars(total).alias("total_dollars"), F.lit("USD").alias("currency"),
            F.col("ts").alias("created_at"),
        )
    )
    return orders, order_items
