"""Carts, orders, shipping, prices, promotions, ledger and trends."""

from pyspark.sql import functions as F

from merchlens.functions.text import uuid_from
from merchlens.operators import cart as C
from merchlens.operators.ledger import ledger_check
from merchlens.operators.names import resolve_names
from merchlens.operators.pricing import active_promotions, choose_shipping, price_asof
from merchlens.operators.spread import latest_by
from merchlens.operators.trending import trending
from merchlens.session import settled
from registry.core import query

# Small enough that the driver's tables fall into many chunks per key.
CHUNK = 512

UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
ITEM_ID = UUID.format("md5(concat_ws('|', session_id, item_ref, add_seq))")
LINES = """
  priced AS (SELECT c.seq, c.ts, c.session_id, c.item_ref, c.command, c.quantity, p.product_id, p.name AS product_name,
      CAST(round(p.current_price * 100) AS BIGINT) AS unit_price_cents, CASE command WHEN 'add' THEN 1 WHEN 'remove' THEN -1 ELSE 0 END AS step
    FROM commands c LEFT JOIN products p ON c.product_id = p.product_id AND c.command = 'add'
    WHERE c.command IN ('update', 'remove') OR (c.command = 'add' AND p.product_id IS NOT NULL)),
  summed AS (SELECT *, sum(step) OVER w AS s FROM priced WINDOW w AS (PARTITION BY session_id, item_ref ORDER BY seq)),
  floored AS (SELECT *, coalesce(min(s) OVER (PARTITION BY session_id, item_ref ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM summed),
  leveled AS (SELECT *, s - step - least(0, low) + CASE WHEN command = 'add' THEN 1 ELSE 0 END AS level FROM floored),
  acting AS (SELECT *, sum(CASE WHEN command = 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, item_ref, level ORDER BY seq) AS line
    FROM leveled WHERE level > 0),
  lines AS (SELECT session_id, item_ref, level, line, max(seq) FILTER (command = 'add') AS add_seq, max(ts) FILTER (command = 'add') AS added_at,
      max(product_id) FILTER (command = 'add') AS product_id, max(product_name) AS product_name, max(unit_price_cents) AS unit_price_cents,
      arg_max(quantity, seq) FILTER (command <> 'remove') AS quantity, bool_or(command = 'remove') AS removed FROM acting GROUP BY ALL),
  items AS (SELECT *, unit_price_cents * quantity AS subtotal_cents FROM lines WHERE NOT removed),
  sessions AS (SELECT session_id, arg_min(customer_id, seq) AS customer_id, CASE WHEN bool_or(command = 'checkout') THEN 'completed' ELSE 'active' END AS status,
      min(ts) AS created_at, max(ts) FILTER (command <> 'create') AS updated_at FROM commands GROUP BY session_id),
  totals AS (SELECT session_id, CAST(sum(subtotal_cents) AS BIGINT) AS subtotal_cents, count(*) AS item_count FROM items GROUP BY session_id)
"""


def items(d):
    return C.fold_items(d.commands, d.products, CHUNK)


def stored_items(d):
    """The cart lines as a table, as a shop would keep them."""
    return settled(items(d), "cart-items")


SESSIONS_SQL = f"""WITH {LINES} SELECT session_id, customer_id, status, coalesce(subtotal_cents, 0) AS subtotal_cents, coalesce(subtotal_cents, 0) AS total_cents,
        'USD' AS currency, created_at, updated_at FROM sessions LEFT JOIN totals USING (session_id)"""


@query("cart_sessions_from_log", SESSIONS_SQL, "commands products")
def _(d):
    return C.fold_sessions(d.commands, items(d))


@query(
    "cart_lines_from_log",
    f"""WITH {LINES} SELECT {ITEM_ID} AS item_id, session_id, product_id, quantity, unit_price_cents, subtotal_cents, product_name, added_at, add_seq FROM items""",
    "commands products",
)
def _(d):
    return items(d).drop("variant_id")


@query(
    "cart_totals",
    f"WITH {LINES} SELECT session_id, subtotal_cents, item_count FROM totals",
    "commands products",
)
def _(d):
    return C.cart_totals(items(d))


@query(
    "cart_rejected",
    f"""WITH {LINES} SELECT seq, session_id, 'Product not found with ID: ' || CAST(c.product_id AS VARCHAR) AS error
          FROM commands c ANTI JOIN products p ON c.product_id = p.product_id WHERE command = 'add'
        UNION ALL SELECT seq, session_id, 'Cart item not found: ' || CAST(item_ref AS VARCHAR) FROM leveled WHERE level = 0""",
    "commands products",
)
def _(d):
    bad = C.rejected_adds(d.commands, d.products).select("seq", "session_id", "error")
    return bad.unionByName(C.not_found(d.commands, d.products, CHUNK).select("seq", "session_id", "error"))


@query(
    "cart_snapshot",
    f"""WITH {LINES} SELECT s.session_id, customer_id, status, 'USD' AS currency, coalesce(t.item_count, 0) AS item_count,
          coalesce(t.subtotal_cents, 0) AS cart_subtotal_cents, coalesce(t.subtotal_cents, 0) AS cart_total_cents, created_at,
          CASE WHEN add_seq IS NOT NULL THEN {UUID.format("md5(concat_ws('|', s.session_id, item_ref, add_seq))")} END AS item_id,
          product_id, product_name, quantity, unit_price_cents, i.subtotal_cents
        FROM sessions s LEFT JOIN totals t USING (session_id) LEFT JOIN items i USING (session_id)""",
    "commands products",
)
def _(d):
    i = stored_items(d)
    return C.cart_snapshot(C.fold_sessions(d.commands, i), i).drop("variant_id")


@query(
    "cart_documents",
    f"""WITH {LINES}, listed AS (SELECT session_id, string_agg(product_id || 'x' || quantity, ',' ORDER BY add_seq) AS items FROM items GROUP BY ALL)
        SELECT s.session_id, coalesce(items, '') AS items, coalesce(t.item_count, 0) AS item_count
        FROM sessions s LEFT JOIN totals t USING (session_id) LEFT JOIN listed USING (session_id)""",
    "commands products",
)
def _(d):
    i = stored_items(d)
    docs = C.cart_documents(C.fold_sessions(d.commands, i), i)
    text = F.transform("items", lambda x: F.concat_ws("x", x["product_id"], x["quantity"]))
    return docs.select("session_id", F.array_join(text, ",").alias("items"), "item_count")


@query(
    "cart_pages",
    f"""WITH {LINES}, placed AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY session_id ORDER BY add_seq) - 1) / 5) AS BIGINT) AS page FROM items),
        pages AS (SELECT session_id, page, string_agg(product_id || 'x' || quantity, ',' ORDER BY add_seq) AS items FROM placed GROUP BY ALL)
        SELECT s.session_id, coalesce(page, 0) AS page, coalesce(items, '') AS items, coalesce(t.item_count, 0) AS item_count
        FROM sessions s LEFT JOIN totals t USING (session_id) LEFT JOIN pages USING (session_id)""",
    "commands products",
)
def _(d):
    i = stored_items(d)
    docs = C.cart_pages(C.fold_sessions(d.commands, i), i, page_rows=5, chunk_rows=CHUNK)
    text = F.transform("items", lambda x: F.concat_ws("x", x["product_id"], x["quantity"]))
    return docs.select("session_id", "page", F.array_join(text, ",").alias("items"), "item_count")


ORDERS = f"""{LINES},
  checkouts AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS order_ordinal FROM commands WHERE command = 'checkout'),
  sold AS (SELECT o.session_id, o.order_ordinal, l.item_ref, l.add_seq, l.product_id, l.product_name, l.unit_price_cents,
      arg_max(a.quantity, a.seq) AS quantity, arg_max(a.command, a.seq) AS last_command
    FROM checkouts o JOIN acting a ON a.session_id = o.session_id AND a.seq < o.seq
    JOIN lines l ON l.session_id = a.session_id AND l.item_ref = a.item_ref AND l.level = a.level AND l.line = a.line
    GROUP BY ALL HAVING arg_max(a.command, a.seq) <> 'remove')
"""


CHECKOUT_SQL = f"""WITH {ORDERS}, sums AS (SELECT session_id, order_ordinal, CAST(sum(unit_price_cents * quantity) AS BIGINT) AS cents, count(*) AS n FROM sold GROUP BY ALL)
        SELECT o.session_id, o.order_ordinal, customer_id, 'confirmed' AS status, coalesce(n, 0) AS item_count, coalesce(cents, 0) AS total_cents,
          coalesce(cents, 0) / 100.0 AS total_dollars, {UUID.format("md5(concat_ws('|', o.session_id, o.order_ordinal))")} AS order_id,
          'ORD-' || strftime(ts, '%Y%m%d') || '-' || substr(md5(concat_ws('|', o.session_id, o.order_ordinal)), 1, 6) AS order_number, ts AS created_at
        FROM checkouts o LEFT JOIN sums s ON s.session_id = o.session_id AND s.order_ordinal = o.order_ordinal"""
ORDER_ITEMS_SQL = f"""WITH {ORDERS} SELECT {UUID.format("md5(concat_ws('|', session_id, order_ordinal))")} AS order_id, session_id, order_ordinal, product_id, product_name,
        quantity, unit_price_cents, unit_price_cents * quantity AS subtotal_cents,
        {UUID.format("md5(concat_ws('|', session_id, order_ordinal, item_ref, add_seq))")} AS order_item_id FROM sold"""
ORDER_COLUMNS = (
    "session_id", "order_ordinal", "customer_id", "status", "item_count", "total_cents", "total_dollars", "order_id", "order_number", "created_at",
)


@query("cart_checkout", CHECKOUT_SQL, "commands products")
def _(d):
    orders, _items = C.checkout(d.commands, d.products, CHUNK)
    return orders.select(*ORDER_COLUMNS)


@query("cart_order_items", ORDER_ITEMS_SQL, "commands products")
def _(d):
    return C.checkout(d.commands, d.products, CHUNK)[1].drop("variant_id")


@query(
    "cart_item_resolve",
    f"""WITH {LINES}, refs AS (SELECT DISTINCT session_id, ref FROM (SELECT session_id, upper(product_name) AS ref FROM items
          UNION ALL SELECT session_id, split_part(lower(product_name), ' ', 1) FROM items UNION ALL SELECT session_id, 'ghost ' || item_ref FROM commands)),
        cand AS (SELECT session_id, lower(product_name) AS name, add_seq FROM items),
        hits AS (SELECT r.session_id, r.ref, max(add_seq) FILTER (name = lower(ref)) AS exact, max(add_seq) FILTER (contains(name, lower(ref))) AS part
          FROM refs r LEFT JOIN cand c USING (session_id) GROUP BY ALL)
        SELECT session_id, ref, CAST(coalesce(exact, part) AS VARCHAR) AS id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN part IS NOT NULL THEN 'contains' END AS how,
          CASE WHEN part IS NULL THEN 'Cart item not found: ' || ref END AS error FROM hits""",
    "commands products",
)
def _(d):
    lines = stored_items(d)
    own = lines.select("session_id", F.col("add_seq").alias("id"), F.col("product_name").alias("name"))
    refs = (
        own.select("session_id", F.upper("name").alias("ref"))
        .unionByName(own.select("session_id", F.split_part(F.lower("name"), F.lit(" "), F.lit(1)).alias("ref")))
        .unionByName(d.commands.select("session_id", F.concat(F.lit("ghost "), F.col("item_ref").cast("string")).alias("ref")))
    )
    return resolve_names(refs, own, scope=["session_id"], order=[-F.col("id")], what="Cart item")


@query(
    "cart_item_resolve_all",
    f"""WITH {LINES}, refs AS (SELECT DISTINCT ref FROM (SELECT upper(product_name) AS ref FROM items
          UNION ALL SELECT split_part(lower(product_name), ' ', 1) FROM items UNION ALL SELECT '' UNION ALL SELECT 'ghost')),
        cand AS (SELECT lower(product_name) AS name, max(add_seq) AS newest FROM items GROUP BY ALL),
        hits AS (SELECT r.ref, max(newest) FILTER (name = lower(ref)) AS exact, max(newest) FILTER (contains(name, lower(ref))) AS part
          FROM refs r CROSS JOIN cand c GROUP BY ALL)
        SELECT ref, CAST(coalesce(exact, part) AS VARCHAR) AS id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN part IS NOT NULL THEN 'contains' END AS how,
          CASE WHEN part IS NULL THEN 'Cart item not found: ' || ref END AS error FROM hits""",
    "commands products",
)
def _(d):
    """Names looked up among the items of all carts, the newest one first; an empty name is in every name."""
    own = stored_items(d).select(F.col("add_seq").alias("id"), F.col("product_name").alias("name"))
    first_words = own.select(F.split_part(F.lower("name"), F.lit(" "), F.lit(1)).alias("ref"))
    refs = own.select(F.upper("name").alias("ref")).unionByName(first_words).unionByName(d.spark.sql("SELECT '' AS ref UNION ALL SELECT 'ghost'"))
    return resolve_names(refs, own, order=[-F.col("id")], what="Cart item")


@query(
    "latest_per_key",
    """SELECT user_id, event_type, event_id, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(d):
    feedback = d.events.select("user_id", "event_type", "event_id", "value", "ts")
    return latest_by(feedback, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query(
    "price_asof",
    """WITH h AS (SELECT product_id, effective_date, max(price) AS price, arg_max(end_date, price) AS end_date, bool_or(end_date IS NULL) AS x
         FROM price_history GROUP BY ALL),
       hist AS (SELECT product_id, effective_date, price, end_date FROM price_history
         QUALIFY row_number() OVER (PARTITION BY product_id, effective_date ORDER BY price DESC, end_date) = 1),
       asks AS (SELECT s_suppkey, l_partkey AS product_id, CAST(l_shipdate AS DATE) + 45 AS at_date FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
       SELECT a.product_id, CAST(a.at_date AS VARCHAR) AS at_date, CASE WHEN h.end_date IS NULL OR a.at_date < h.end_date THEN h.price END AS price,
         CASE WHEN h.end_date IS NULL OR a.at_date < h.end_date THEN CAST(h.effective_date AS VARCHAR) END AS effective_date
       FROM asks a ASOF LEFT JOIN hist h ON a.product_id = h.product_id AND a.at_date >= h.effective_date""",
    "price_history",
)
def _(d):
    asks = d.lineitem.select(F.col("l_partkey").alias("product_id"), F.date_add(F.col("l_shipdate").cast("date"), 45).alias("at_date"))
    r = price_asof(asks, d.price_history)
    return r.withColumns({c: F.col(c).cast("string") for c in ("at_date", "effective_date")})


MOMENT = "1997-03-01 00:00:00"


@query(
    "active_promotions",
    f"""WITH live AS (SELECT * FROM promotions WHERE is_active AND start_date <= TIMESTAMP '{MOMENT}' AND TIMESTAMP '{MOMENT}' < end_date)
        SELECT DISTINCT promotion_id, promo_code, product_id FROM live JOIN products p
          ON list_contains(product_ids, CAST(p.product_id AS VARCHAR)) OR list_contains(category_ids, p.category) OR list_contains(brand_names, p.brand)
        UNION ALL SELECT promotion_id, promo_code, NULL FROM live WHERE product_ids IS NULL AND category_ids IS NULL AND brand_names IS NULL""",
    "promotions products",
)
def _(d):
    return active_promotions(d.promotions, d.products, MOMENT)


@query(
    "trending_products",
    """WITH steps AS (SELECT product_id, CAST(floor(epoch(posted_at) / 3600) AS BIGINT) AS step, sentiment_score FROM mentions),
       windows AS (SELECT w, product_id, count(*) AS mention_count, avg(sentiment_score) AS sentiment
         FROM (SELECT *, unnest(range(step - 23, step + 1)) AS w FROM steps) GROUP BY ALL),
       scored AS (SELECT w, product_id, mention_count, round(mention_count / 24.0, 4) AS mention_velocity, round(sentiment + 1e-11, 4) AS sentiment_average,
         round(mention_count / 24.0 * (1 + sentiment) + 1e-11, 4) AS trend_score FROM windows)
       SELECT make_timestamp(w * 3600000000) AS window_start, make_timestamp((w + 24) * 3600000000) AS window_end, product_id, mention_count, mention_velocity,
         sentiment_average, trend_score,
         CAST(row_number() OVER (PARTITION BY w ORDER BY trend_score DESC, mention_count DESC, product_id) AS INT) AS trend_rank
       FROM scored QUALIFY trend_rank <= 10""",
    "mentions",
)
def _(d):
    return trending(d.mentions)


@query(
    "ledger_check",
    """WITH l AS (SELECT *, lead(quantity_before) OVER (PARTITION BY stock_id ORDER BY seq) AS nxt FROM (
         SELECT event_id AS seq, user_id AS stock_id, event_id % 9 - 4 AS quantity, CAST(floor(value) AS BIGINT) AS quantity_before,
           CAST(floor(value) AS BIGINT) + event_id % 9 - 4 + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS quantity_after FROM events))
       SELECT stock_id, count(*) AS entries, CAST(sum(quantity) AS BIGINT) AS net_quantity,
         count(*) FILTER (quantity_before + quantity <> quantity_after) AS bad_sums, count(*) FILTER (nxt <> quantity_after) AS broken_links,
         arg_max(quantity_after, seq) AS closing_quantity FROM l GROUP BY stock_id""",
)
def _(d):
    before = F.floor("value")
    delta = F.col("event_id") % 9 - 4
    ledger = d.events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("stock_id"), delta.alias("quantity"), before.alias("quantity_before"),
        (before + delta + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0)).alias("quantity_after"),
    )
    return ledger_check(ledger, CHUNK)


OPTIONS = """options AS (SELECT 'opt' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS option_id, CASE WHEN s_nationkey % 2 = 0 THEN 'shipping' ELSE 'pickup' END AS fulfillment_type,
    CAST(round(abs(s_acctbal)) AS BIGINT) + 50 AS price_cents, CAST(round(abs(s_acctbal) * 1000) AS BIGINT) + 1 AS free_threshold_cents, s_acctbal > 0 AS is_available FROM supplier)"""


@query(
    "shipping_choice",
    f"""WITH {OPTIONS}, offers AS (SELECT session_id, fulfillment_type, option_id,
          CASE WHEN total_cents >= free_threshold_cents THEN 0 ELSE price_cents END AS price, CASE WHEN total_cents >= free_threshold_cents THEN free_threshold_cents END AS th
          FROM shop_orders CROSS JOIN options WHERE is_available)
        SELECT session_id, fulfillment_type, option_id, CAST(price AS BIGINT) AS price_cents FROM offers
        QUALIFY row_number() OVER (PARTITION BY session_id, fulfillment_type ORDER BY price, th NULLS LAST, option_id) = 1""",
    "shop_orders",
)
def _(d):
    key = F.lpad(F.col("s_suppkey").cast("string"), 8, "0")
    options = d.supplier.select(
        F.concat(F.lit("opt"), key).alias("option_id"),
        F.when(F.col("s_nationkey") % 2 == 0, "shipping").otherwise("pickup").alias("fulfillment_type"),
        (F.round(F.abs("s_acctbal")).cast("long") + 50).alias("price_cents"),
        (F.round(F.abs("s_acctbal") * 1000).cast("long") + 1).alias("free_threshold_cents"),
        (F.col("s_acctbal") > 0).alias("is_available"),
    )
    return choose_shipping(d.shop_orders.select("session_id", F.col("total_cents").alias("subtotal_cents")), options)


@query(
    "ids_from_parts",
    f"SELECT event_id, {UUID.format(chr(109))} AS id FROM (SELECT event_id, md5(concat_ws('|', event_id, user_id, event_type)) AS m FROM events)",
)
def _(d):
    return d.events.select("event_id", uuid_from(F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("id"))
