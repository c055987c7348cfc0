"""Metric views over the driver's tables, and queries on them."""

from functools import reduce

from pyspark.sql import functions as F

from merchlens.plans import metric_views as M
from registry.core import query


def products(d):
    return M.product_view(d.products, d.variants, d.price_history.withColumn("history_id", F.lit(None).cast("long")), d.promotions)


def social(d):
    return M.social_view(d.reviews, d.mentions, d.influencers, d.trends, d.products)


def carts(d):
    options = d.promotions.select(F.col("promotion_id").alias("option_id"))
    order_items = d.shop_items.select("order_id", "product_id", "quantity")
    return M.cart_view(d.shop_sessions, d.shop_items, d.shop_orders, order_items, options, d.products)


def customers(d):
    analyses = d.documents.select(F.col("doc_id").alias("analysis_id"), F.col("doc_id").alias("customer_id"))
    return M.customer_view(d.customers, analyses)


def inventory(d):
    return M.inventory_view(d.locations, d.stock, d.products)


def rounded(df, *cols, places=8):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(
    "mv_product",
    """SELECT brand, round(avg(current_price), 8) AS avg_price, max(current_price) AS max_price, min(current_price) AS min_price,
       count(DISTINCT product_id) AS product_count FROM products GROUP BY brand""",
    "products",
)
def _(d):
    return rounded(products(d).query(["avg_price", "most expensive", "min_price", "product_count"], ["product.brand"]), "avg_price")


@query(
    "mv_variant",
    "SELECT category, count(DISTINCT variant_id) AS variant_count FROM variants JOIN products USING (product_id) GROUP BY category",
    "variants products",
)
def _(d):
    return products(d).query(["variant_count"], ["product.category"])


@query(
    "mv_promo",
    "SELECT start_date, count(DISTINCT CASE WHEN is_active THEN promotion_id END) AS active_promos FROM promotions GROUP BY start_date",
    "promotions",
)
def _(d):
    return products(d).query(["active_promos"], ["promo.start_date"])


@query(
    "mv_social",
    """WITH r AS (SELECT category, round(avg(rating), 8) AS avg_rating, count(DISTINCT review_id) AS review_count
         FROM reviews JOIN products USING (product_id) GROUP BY 1),
       m AS (SELECT category, count(DISTINCT mention_id) AS mention_count, CAST(sum(likes + comments + shares) AS BIGINT) AS total_engagement
         FROM mentions JOIN products USING (product_id) GROUP BY 1),
       i AS (SELECT category, count(DISTINCT mention_id) AS influencer_mention_count FROM influencers JOIN products USING (product_id) GROUP BY 1)
       SELECT category, avg_rating, review_count, mention_count, total_engagement, influencer_mention_count
       FROM r FULL JOIN m USING (category) FULL JOIN i USING (category)""",
    "reviews mentions influencers products",
)
def _(d):
    names = ["avg_rating", "review_count", "mention_count", "total_engagement", "influencer_mention_count"]
    return rounded(social(d).query(names, ["product.category"]), "avg_rating")


@query(
    "mv_trending",
    "SELECT brand, count(DISTINCT CASE WHEN is_viral THEN product_id END) AS viral_product_count FROM trends JOIN products USING (product_id) GROUP BY brand",
    "trends products",
)
def _(d):
    return social(d).query(["viral_product_count"], ["product.brand"])


@query(
    "mv_orders",
    """SELECT status, count(DISTINCT order_id) AS order_count, round(sum(total_cents) / 100.0, 2) AS total_revenue FROM shop_orders GROUP BY status""",
    "shop_orders",
)
def _(d):
    return rounded(carts(d).query(["order_count", "total_revenue"], ["order_tbl.status"]), "total_revenue", places=2)


@query(
    "mv_cart",
    """WITH s AS (SELECT customer_id, count(DISTINCT session_id) AS cart_count,
         count(DISTINCT CASE WHEN status = 'completed' THEN session_id END) AS completed_cart_count,
         round(avg(total_cents) / 100.0, 8) AS avg_cart_value FROM shop_sessions GROUP BY 1),
       i AS (SELECT customer_id, CAST(sum(quantity) AS BIGINT) AS total_items FROM shop_items JOIN shop_sessions USING (session_id) GROUP BY 1)
       SELECT customer_id, cart_count, completed_cart_count, avg_cart_value, total_items FROM s FULL JOIN i USING (customer_id)""",
    "shop_sessions shop_items",
)
def _(d):
    names = ["cart_count", "completed_cart_count", "avg_cart_value", "total_items"]
    return rounded(carts(d).query(names, ["session.customer_id"]), "avg_cart_value")


@query(
    "mv_customer",
    """WITH c AS (SELECT loyalty_tier, count(DISTINCT customer_id) AS customer_count, round(avg(points_balance), 8) AS avg_points,
         CAST(sum(points_balance) AS BIGINT) AS total_points FROM customers GROUP BY 1),
       a AS (SELECT loyalty_tier, count(DISTINCT doc_id) AS analysis_count FROM documents LEFT JOIN customers ON customer_id = doc_id GROUP BY 1)
       SELECT coalesce(c.loyalty_tier, a.loyalty_tier) AS loyalty_tier, customer_count, avg_points, total_points, analysis_count
       FROM c FULL JOIN a ON c.loyalty_tier IS NOT DISTINCT FROM a.loyalty_tier""",
    "customers",
)
def _(d):
    names = ["customer_count", "avg_points", "total_points", "analysis_count"]
    return rounded(customers(d).query(names, ["tier"]), "avg_points")


@query(
    "mv_inventory",
    """WITH s AS (SELECT state, CAST(sum(quantity_on_hand) AS BIGINT) AS total_on_hand, CAST(sum(quantity_reserved) AS BIGINT) AS total_reserved,
         CAST(sum(quantity_on_hand - quantity_reserved) AS BIGINT) AS total_available,
         count(DISTINCT CASE WHEN quantity_on_hand <= reorder_point THEN stock_id END) AS low_stock_count
         FROM stock JOIN locations USING (location_id) GROUP BY 1),
       l AS (SELECT state, count(DISTINCT location_id) AS location_count FROM locations GROUP BY 1)
       SELECT state, location_count, total_on_hand, total_reserved, total_available, low_stock_count FROM s FULL JOIN l USING (state)""",
    "stock locations",
)
def _(d):
    names = ["location_count", "total_on_hand", "total_reserved", "total_available", "low_stock_count"]
    return inventory(d).query(names, ["location.state"])


@query(
    "mv_revenue_by_category",
    """SELECT category, CAST(sum(quantity) AS BIGINT) AS total_items FROM shop_items JOIN products USING (product_id) GROUP BY category""",
    "shop_items products",
)
def _(d):
    return carts(d).query(["total_items"], ["product.category"])


@query(
    "mv_synonym",
    """SELECT round(avg(total_cents) / 100.0, 8) AS avg_cart_value, (SELECT round(sum(total_cents) / 100.0, 2) FROM shop_orders) AS total_revenue
       FROM shop_sessions""",
    "shop_sessions shop_orders",
)
def _(d):
    r = carts(d).query(["AOV", "sales"])
    return r.select(F.round("avg_cart_value", 8).alias("avg_cart_value"), F.round("total_revenue", 2).alias("total_revenue"))


REPEATED = """
  reviews_2 AS (SELECT review_id, product_id, rating FROM reviews
    UNION ALL SELECT review_id, product_id + CASE WHEN rating = 5 THEN 1 ELSE 0 END, rating FROM reviews WHERE rating >= 4),
  mentions_2 AS (SELECT mention_id, product_id FROM mentions UNION ALL SELECT mention_id, product_id + 1 FROM mentions WHERE mention_id % 3 = 0),
  influencers_2 AS (SELECT mention_id, product_id FROM influencers UNION ALL SELECT mention_id, product_id FROM influencers),
  variants_2 AS (SELECT variant_id, product_id FROM variants UNION ALL SELECT variant_id, product_id + 1 FROM variants WHERE variant_id % 2 = 0),
  orders_2 AS (SELECT order_id, session_id FROM shop_orders UNION ALL SELECT order_id, session_id + 1 FROM shop_orders WHERE order_id % 4 = 0),
  stock_2 AS (SELECT * FROM stock UNION ALL SELECT stock_id, product_id, location_id + 1, quantity_on_hand, quantity_reserved, reorder_point FROM stock
    WHERE product_id % 2 = 0),
  analyses_2 AS (SELECT doc_id AS analysis_id, doc_id AS customer_id FROM documents UNION ALL SELECT doc_id, doc_id + 1 FROM documents)"""


@query(
    "mv_repeated_ids",
    f"""WITH {REPEATED},
       cats AS (SELECT product_id, category FROM products)
       SELECT 'review_count' AS metric, category AS dim, count(DISTINCT review_id) AS value FROM reviews_2 LEFT JOIN cats USING (product_id) GROUP BY ALL
       UNION ALL SELECT 'mention_count', category, count(DISTINCT mention_id) FROM mentions_2 LEFT JOIN cats USING (product_id) GROUP BY ALL
       UNION ALL SELECT 'influencer_mention_count', category, count(DISTINCT mention_id) FROM influencers_2 LEFT JOIN cats USING (product_id) GROUP BY ALL
       UNION ALL SELECT 'variant_count', category, count(DISTINCT variant_id) FROM variants_2 LEFT JOIN cats USING (product_id) GROUP BY ALL
       UNION ALL SELECT 'order_count', CAST(s.status AS VARCHAR), count(DISTINCT o.order_id) FROM orders_2 o LEFT JOIN shop_sessions s USING (session_id) GROUP BY ALL
       UNION ALL SELECT 'low_stock_count', state, count(DISTINCT CASE WHEN quantity_on_hand <= reorder_point THEN stock_id END)
         FROM stock_2 LEFT JOIN locations USING (location_id) GROUP BY ALL
       UNION ALL SELECT 'analysis_count', loyalty_tier, count(DISTINCT analysis_id) FROM analyses_2 LEFT JOIN customers USING (customer_id) GROUP BY ALL""",
    "reviews mentions influencers variants products shop_orders shop_sessions stock locations customers",
)
def _(d):
    """Distinct counts over tables that hold an id twice, with the same reference or another one."""
    c = F.col

    def again(df, test, **changed):
        return df.unionByName(df.filter(test).withColumns(changed))

    reviews = again(d.reviews, c("rating") >= 4, product_id=c("product_id") + (c("rating") == 5).cast("long"))
    mentions = again(d.mentions, c("mention_id") % 3 == 0, product_id=c("product_id") + 1)
    influencers = again(d.influencers, F.lit(True), product_id=c("product_id"))
    variants = again(d.variants, c("variant_id") % 2 == 0, product_id=c("product_id") + 1)
    orders = again(d.shop_orders, c("order_id") % 4 == 0, session_id=c("session_id") + 1)
    stock = again(d.stock, c("product_id") % 2 == 0, location_id=c("location_id") + 1)
    analyses = d.documents.select(c("doc_id").alias("analysis_id"), c("doc_id").alias("customer_id"))
    analyses = again(analyses, F.lit(True), customer_id=c("customer_id") + 1)
    shop = M.cart_view(d.shop_sessions, d.shop_items, orders, d.shop_items.select("order_id", "product_id"), d.promotions.select("promotion_id"), d.products)
    seen = M.social_view(reviews, mentions, influencers, d.trends, d.products)
    shades = M.product_view(d.products, variants, d.price_history, d.promotions)
    asked = [
        (seen, "review_count", "product.category"), (seen, "mention_count", "product.category"), (seen, "influencer_mention_count", "product.category"),
        (shades, "variant_count", "product.category"), (shop, "order_count", "session.status"),
        (M.inventory_view(d.locations, stock, d.products), "low_stock_count", "location.state"),
        (M.customer_view(d.customers, analyses), "analysis_count", "customer.loyalty_tier"),
    ]
    out = [view.query([name], {"dim": dim}).select(F.lit(name).alias("metric"), "dim", c(name).alias("value")) for view, name, dim in asked]
    return reduce(lambda a, b: a.unionByName(b), out)
