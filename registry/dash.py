"""Dashboards, verified questions and executive questions."""

from pyspark.sql import functions as F

from merchlens.functions.text import human_currency, human_number
from merchlens.plans import dashboards as D, executive as X, verified as V
from registry.core import query
from registry.views import carts, inventory, social

ANCHOR = "2001-06-01 00:00:00"


@query(
    "dash_top_rated",
    """SELECT p.name AS product_name, p.brand, round(avg(r.rating) + 1e-9, 2) AS avg_rating, count(*) AS review_count
       FROM reviews r JOIN products p USING (product_id) GROUP BY p.name, p.brand HAVING count(*) >= 5
       ORDER BY avg_rating DESC, review_count DESC, product_name, brand LIMIT 10""",
    "reviews products",
)
def _(d):
    return D.top_rated(d.reviews, d.products)


@query(
    "dash_categories",
    """SELECT category, count(*) AS product_count, round(avg(current_price) + 1e-9, 2) AS avg_price FROM products
       GROUP BY category ORDER BY product_count DESC, category LIMIT 10""",
    "products",
)
def _(d):
    return D.categories(d.products)


@query("dash_products", "SELECT count(DISTINCT product_id) AS total_products FROM products", "products")
def _(d):
    return D.products(d.products)


@query(
    "dash_revenue",
    """SELECT round(coalesce(sum(total_cents) / 100.0, 0), 2) AS total_revenue, count(DISTINCT order_id) AS total_orders,
       round(avg(total_cents) / 100.0, 8) AS avg_order_value FROM shop_orders""",
    "shop_orders",
)
def _(d):
    r = D.revenue(d.shop_orders)
    return r.select(F.round("total_revenue", 2).alias("total_revenue"), "total_orders", F.round("avg_order_value", 8).alias("avg_order_value"))


@query(
    "dash_customers",
    """SELECT count(DISTINCT customer_id) AS total_customers, count(DISTINCT CASE WHEN is_active THEN customer_id END) AS active_customers,
       CAST(sum(points_balance) AS BIGINT) AS total_points FROM customers""",
    "customers",
)
def _(d):
    return D.customers(d.customers)


@query(
    "dash_loyalty",
    "SELECT loyalty_tier, count(*) AS customer_count FROM customers GROUP BY loyalty_tier ORDER BY customer_count DESC, loyalty_tier",
    "customers",
)
def _(d):
    return D.loyalty(d.customers)


@query(
    "dash_inventory",
    """SELECT count(DISTINCT location_id) AS total_locations, CAST(sum(quantity_on_hand) AS BIGINT) AS total_units,
       count(CASE WHEN quantity_on_hand < reorder_point THEN 1 END) AS low_stock_count FROM stock""",
    "stock",
)
def _(d):
    return D.inventory(d.stock)


@query("dash_social", "SELECT count(*) AS total_reviews, round(avg(rating) + 1e-9, 2) AS avg_rating FROM reviews", "reviews")
def _(d):
    return D.social(d.reviews)


@query(
    "dash_low_stock_items",
    """SELECT p.name AS product_name, quantity_on_hand, reorder_point, l.city AS location
       FROM stock i JOIN products p USING (product_id) JOIN locations l USING (location_id)
       WHERE quantity_on_hand < reorder_point ORDER BY quantity_on_hand, stock_id LIMIT 10""",
    "stock products locations",
)
def _(d):
    return D.low_stock_items(d.stock, d.products, d.locations)


@query(
    "dash_formatted",
    """SELECT customer_id, CASE WHEN cents >= 100000000 THEN printf('$%.1fM', cents / 100000000.0)
         WHEN cents >= 100000 THEN printf('$%.1fK', cents / 100000.0) ELSE printf('$%.0f', cents / 100.0) END AS revenue_text,
       CASE WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0) ELSE CAST(n AS VARCHAR) END AS orders_text
       FROM (SELECT customer_id, CAST(floor(sum(total_cents) / 100000) AS BIGINT) * 100000 + 20000 AS cents, count(*) AS n FROM shop_orders GROUP BY customer_id)""",
    "shop_orders",
)
def _(d):
    per = d.shop_orders.groupBy("customer_id").agg(F.sum("total_cents").alias("cents"), F.count("*").alias("n"))
    # Whole thousands plus 200, so that no value sits on a rounding edge.
    cents = F.floor(F.col("cents") / 100000) * 100000 + 20000
    return per.select("customer_id", human_currency(cents / 100).alias("revenue_text"), human_number(F.col("n")).alias("orders_text"))


FACE = "SELECT {0} AS question, product_id, name, brand, category, subcategory, current_price FROM (SELECT * FROM products WHERE is_active AND {1} ORDER BY current_price, product_id LIMIT 20)"


@query(
    "vq_face_filters",
    ""
    + " UNION ALL ".join(
        FACE.format(f"'{name}'", test)
        for name, test in (
            ("warm", "category = 'face' AND list_contains(undertone_compatibility, 'warm')"),
            ("dry", "category = 'face' AND list_contains(skin_type_compatibility, 'dry')"),
            ("dry warm", "category = 'face' AND list_contains(skin_type_compatibility, 'dry') AND list_contains(undertone_compatibility, 'warm')"),
            ("medium", "subcategory = 'standard' AND list_contains(skin_tone_compatibility, 'medium')"),
        )
    ),
    "products",
)
def _(d):
    p = d.products
    asked = {
        "warm": V.products_suiting(p, category="face", undertone="warm"),
        "dry": V.products_suiting(p, category="face", skin_type="dry"),
        "dry warm": V.products_suiting(p, category="face", skin_type="dry", undertone="warm"),
        "medium": V.products_suiting(p, subcategory="standard", skin_tone="medium"),
    }
    out = None
    for name, rows in asked.items():
        rows = rows.withColumn("question", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "vq_category_brand",
    f"""SELECT category, brand, count(DISTINCT product_id) AS product_count, round(avg(current_price), 8) AS avg_price
        FROM products WHERE launch_date <= TIMESTAMP '{ANCHOR}' GROUP BY category, brand""",
    "products",
)
def _(d):
    return V.categories_and_brands(d.products, ANCHOR).withColumn("avg_price", F.round("avg_price", 8))


@query(
    "vq_compare_products",
    """SELECT product_id, name, brand, category, subcategory, current_price, base_price, color_name, finish, is_active, is_cruelty_free,
       is_vegan, CAST(launch_date AS VARCHAR) AS launch_date, array_to_string(skin_tone_compatibility, ',') AS skin_tone_compatibility,
       array_to_string(skin_type_compatibility, ',') AS skin_type_compatibility,
       array_to_string(undertone_compatibility, ',') AS undertone_compatibility, spf_value
       FROM products WHERE product_id IN (17, 101)""",
    "products",
)
def _(d):
    r = V.compare_products(d.products, (17, 101))
    arrays = {c: F.array_join(c, ",") for c in r.columns if c.endswith("_compatibility")}
    return r.withColumns({**arrays, "launch_date": F.col("launch_date").cast("string")})


@query(
    "vq_review_summary",
    f"""SELECT product_id, count(DISTINCT review_id) AS review_count, round(avg(rating), 8) AS avg_rating, min(rating) AS min_rating,
        max(rating) AS max_rating, min(created_at) AS earliest_review_date, max(created_at) AS latest_review_date
        FROM reviews WHERE created_at <= TIMESTAMP '{ANCHOR}' GROUP BY product_id""",
    "reviews",
)
def _(d):
    return V.review_summary(d.reviews, ANCHOR).withColumn("avg_rating", F.round("avg_rating", 8))


@query(
    "period_over_period",
    f"""WITH marked AS (SELECT status, total_cents, created_at > TIMESTAMP '{ANCHOR}' - INTERVAL 30 DAYS AS cur FROM shop_orders
          WHERE created_at > TIMESTAMP '{ANCHOR}' - INTERVAL 60 DAYS AND created_at <= TIMESTAMP '{ANCHOR}'),
        both_ AS (SELECT status, sum(total_cents) FILTER (WHERE cur) * 0.01 AS cur, sum(total_cents) FILTER (WHERE NOT cur) * 0.01 AS prev
          FROM marked GROUP BY status)
        SELECT status, round(CAST(cur AS DOUBLE), 2) AS current, round(CAST(prev AS DOUBLE), 2) AS previous,
          round(CAST(coalesce(cur, 0) - coalesce(prev, 0) AS DOUBLE), 2) AS delta,
          round((coalesce(cur, 0) - coalesce(prev, 0)) / nullif(CAST(prev AS DOUBLE), 0), 4) AS pct FROM both_""",
    "shop_orders",
)
def _(d):
    r = carts(d).compare("revenue", "order_tbl.created_at", ANCHOR, ["order_tbl.status"])
    return r.select("status", *[F.round(c, 2).alias(c) for c in ("current", "previous", "delta")], F.round("pct", 4).alias("pct"))


@query(
    "top_products_window",
    f"""SELECT product_id, CAST(sum(subtotal_cents) AS BIGINT) AS revenue_cents, CAST(sum(quantity) AS BIGINT) AS units, name, brand, category
        FROM shop_items JOIN products USING (product_id)
        WHERE sold_at BETWEEN TIMESTAMP '{ANCHOR}' - INTERVAL 6 MONTHS AND TIMESTAMP '{ANCHOR}'
        GROUP BY ALL ORDER BY revenue_cents DESC, product_id LIMIT 10""",
    "shop_items products",
)
def _(d):
    return X.top_products(d.shop_items, d.products, ANCHOR)


@query(
    "category_scorecard",
    """WITH s AS (SELECT category, sum(subtotal_cents) AS sales, sum(quantity) AS units FROM shop_items JOIN products USING (product_id) GROUP BY 1),
       r AS (SELECT category, avg(rating) AS avg_rating, count(*) AS review_count FROM reviews JOIN products USING (product_id) GROUP BY 1),
       m AS (SELECT category, sum(likes + comments + shares) AS engagement FROM mentions JOIN products USING (product_id) GROUP BY 1)
       SELECT category, round(sales / 100.0, 2) AS revenue, CAST(units AS BIGINT) AS units, round(sales / sum(sales) OVER (), 6) AS revenue_share,
         round(avg_rating, 8) AS avg_rating, review_count, CAST(engagement AS BIGINT) AS engagement
       FROM s LEFT JOIN r USING (category) LEFT JOIN m USING (category)""",
    "shop_items reviews mentions products",
)
def _(d):
    r = X.category_scorecard(d.shop_items, d.reviews, d.mentions, d.products)
    return r.withColumns(
        {"revenue": F.round("revenue", 2), "revenue_share": F.round("revenue_share", 6), "avg_rating": F.round("avg_rating", 8)}
    )


@query(
    "stock_non_category",
    """SELECT category, CAST(sum(quantity_on_hand) AS BIGINT) AS total_on_hand, CAST(sum(quantity_reserved) AS BIGINT) AS total_reserved,
       CAST(sum(quantity_on_hand - quantity_reserved) AS BIGINT) AS total_available
       FROM stock JOIN products USING (product_id) WHERE category <> 'lips' GROUP BY category""",
    "stock products",
)
def _(d):
    return X.stock_outside_category(inventory(d))


@query(
    "stock_by_location",
    """SELECT product_id, location_id, p.name, l.city, CAST(sum(quantity_on_hand - quantity_reserved) AS BIGINT) AS total_available
       FROM stock JOIN products p USING (product_id) JOIN locations l USING (location_id) GROUP BY ALL
       HAVING sum(quantity_on_hand - quantity_reserved) > 0""",
    "stock products locations",
)
def _(d):
    return X.stock_by_location(inventory(d))


@query(
    "mv_social_by_brand",
    """SELECT brand, round(avg(rating), 8) AS avg_rating, count(DISTINCT review_id) AS review_count
       FROM reviews JOIN products USING (product_id) GROUP BY brand""",
    "reviews products",
)
def _(d):
    return X.ratings_by(social(d)).withColumn("avg_rating", F.round("avg_rating", 8))


@query(
    "orders_by_customer",
    """SELECT s.customer_id, count(DISTINCT o.order_id) AS order_count, round(sum(o.total_cents) / 100.0, 2) AS total_revenue
       FROM shop_orders o JOIN shop_sessions s USING (session_id) GROUP BY s.customer_id""",
    "shop_orders shop_sessions",
)
def _(d):
    return X.orders_by_customer(carts(d)).withColumn("total_revenue", F.round("total_revenue", 2))
