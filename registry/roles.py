"""The driver's tables in the roles the library works on.

A role is a SELECT in the SQL both engines share; the few names that differ are filled in per engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_NAMES = {
    "list": "array", "empty": "CAST(array() AS array<string>)", "json": "get_json_object",
    "each": "explode", "zip": "zip_with(a.embedding, b.embedding, (x, y) -> {0} * CAST(x AS double) + {1} * CAST(y AS double))",
}
DUCK_NAMES = {
    "list": "list_value", "empty": "CAST([] AS VARCHAR[])", "json": "json_extract_string", "each": "unnest",
    "zip": "list_transform(list_zip(a.embedding, b.embedding), lambda p: {0} * CAST(p[1] AS DOUBLE) + {1} * CAST(p[2] AS DOUBLE))",
}
K = "CAST(<json>(props, '$.k') AS BIGINT)"
CENTS = "CAST(round({0} * 100) AS BIGINT)"

ROLES = {
    "products": """
        SELECT p_partkey AS product_id, p_name || ' ' || p_brand || ' ' || CAST(p_partkey AS STRING) AS name,
          p_brand AS brand, lower(p_type) AS subcategory, p_retailprice AS current_price, p_retailprice + 10 AS base_price,
          CASE p_type WHEN 'ECONOMY' THEN 'face' WHEN 'STANDARD' THEN 'lips' WHEN 'MEDIUM' THEN 'eyes'
            WHEN 'LARGE' THEN 'skincare' WHEN 'SMALL' THEN 'nails' ELSE 'fragrance' END AS category,
          CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'About ' || p_name END AS description,
          CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_name END AS short_description,
          p_retailprice * (0.5 + 0.1 * (p_partkey % 7)) AS cost, split_part(p_name, ' ', 1) AS color_name,
          CASE p_size % 5 WHEN 0 THEN 'matte' WHEN 1 THEN 'dewy' WHEN 2 THEN 'natural' WHEN 3 THEN 'satin' END AS finish,
          CASE p_size % 3 WHEN 0 THEN <list>('warm', 'neutral') WHEN 1 THEN <list>('cool') ELSE <list>('neutral') END
            AS undertone_compatibility,
          CASE p_size % 4 WHEN 0 THEN <list>('fair', 'light') WHEN 1 THEN <list>('medium') WHEN 2 THEN <list>('tan', 'medium')
            ELSE <list>('deep') END AS skin_tone_compatibility,
          CASE WHEN p_partkey % 7 = 3 THEN <list>('dry', 'sensitive') WHEN p_partkey % 2 = 0 THEN NULL ELSE <empty> END
            AS skin_type_compatibility,
          p_partkey % 3 = 0 AS is_vegan, p_partkey % 4 <> 0 AS is_cruelty_free, p_partkey % 10 <> 0 AS is_active,
          DATE '1995-01-01' + CAST(p_partkey % 3000 AS INT) AS launch_date, CAST(p_size AS BIGINT) AS spf_value
        FROM part""",
    "variants": """
        SELECT p_partkey * 4 + i AS variant_id, p_partkey AS product_id,
          CASE WHEN (p_partkey + i) % 29 = 0 THEN NULL WHEN (p_partkey + i) % 31 = 0 THEN '#GG' || substr(lower(lpad(hex((p_partkey * 7919 + i * 104729) % 16777216), 6, '0')), 3)
            ELSE '#' || lower(lpad(hex((p_partkey * 7919 + i * 104729) % 16777216), 6, '0')) END AS color_hex
        FROM (SELECT p_partkey, <each>(<list>(0, 1, 2, 3)) AS i FROM part)""",
    "media": """
        SELECT p_partkey AS product_id, 'img/' || CAST(p_partkey AS STRING) || '_' || CAST(i AS STRING) || '.png' AS url,
          p_partkey % 3 <> 0 AND (p_partkey % 2 = i OR p_partkey % 11 = 0) AS is_primary
        FROM (SELECT p_partkey, <each>(<list>(0, 1)) AS i FROM part)""",
    "pairs": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "ingredients": """
        SELECT CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS ingredient_id, l_partkey AS product_id,
          s_name AS ingredient_name, CASE WHEN l_suppkey % 3 = 0 THEN lower(s_name) END AS ingredient_name_normalized,
          l_suppkey % 4 = 0 AS is_allergen, CASE WHEN l_suppkey % 8 = 0 THEN 'group ' || CAST(l_suppkey % 5 AS STRING) END AS allergen_type,
          CASE WHEN l_partkey % 2 = 0 THEN 'labels/' || CAST(l_partkey AS STRING) || '_a.png' END AS source_image_url
        FROM pairs JOIN supplier ON s_suppkey = l_suppkey""",
    "warnings": """
        SELECT 'w' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS warning_id, l_partkey AS product_id,
          'Keep away from ' || s_name AS warning_text, CASE WHEN l_suppkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity,
          CASE WHEN l_partkey % 2 = 0 THEN 'labels/' || CAST(l_partkey AS STRING) || '_w.png' END AS source_image_url
        FROM pairs JOIN supplier ON s_suppkey = l_suppkey""",
    "label_texts": """
        SELECT doc_id AS label_id, doc_id AS product_id, lang AS label_type, text AS extracted_text, source AS source_image_url
        FROM documents""",
    "reviews": """
        SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING),
            CAST(CAST(l_quantity AS INT) AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), l_returnflag, l_linestatus)) AS review_id,
          l_partkey AS product_id, CAST(1 + CAST(l_quantity AS INT) % 5 AS BIGINT) AS rating, CAST(l_linenumber AS BIGINT) AS helpful_votes,
          'r' || l_returnflag AS title, CASE WHEN l_linenumber = 3 THEN NULL ELSE 'ship ' || l_linestatus END AS review_text,
          CAST(NULL AS STRING) AS review_url, 'website' AS platform, l_linestatus = 'F' AS verified_purchase,
          CAST(NULL AS STRING) AS reviewer_skin_tone, CAST(NULL AS STRING) AS reviewer_skin_type, CAST(NULL AS STRING) AS reviewer_undertone,
          l_returnflag <> 'N' AS is_approved, l_shipdate AS created_at
        FROM lineitem""",
    "mentions": f"""
        SELECT event_id AS mention_id, {K} AS product_id, event_type AS platform, 'p/' || CAST(event_id AS STRING) AS post_url,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'likes ' || props END AS content_text, 'u' || CAST(user_id AS STRING) AS author_handle,
          'User ' || CAST(user_id AS STRING) AS author_name, CAST(floor(value) AS BIGINT) AS likes, {K} AS comments,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 7 END AS shares, ({K} % 21 - 10) / 10.0 AS sentiment_score,
          CASE WHEN {K} % 21 > 12 THEN 'positive' ELSE 'neutral' END AS sentiment_label, ts AS posted_at
        FROM events""",
    "influencers": f"""
        SELECT 1000000000 + event_id AS mention_id, {K} AS product_id, 'c' || CAST(user_id AS STRING) AS influencer_handle,
          CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'Creator ' || CAST(user_id AS STRING) END AS influencer_name, event_type AS platform,
          'i/' || CAST(event_id AS STRING) AS post_url, props AS content_text, CAST(floor(value) AS BIGINT) AS likes, {K} AS comments,
          {K} * 10 AS views, user_id * 100 AS follower_count, 'fair' AS influencer_skin_tone, 'dry' AS influencer_skin_type,
          'cool' AS influencer_undertone, event_id % 2 = 0 AS is_sponsored, ts AS posted_at
        FROM events WHERE event_type IN ('purchase', 'view')""",
    "trends": f"""
        SELECT event_id AS trend_id, {K} AS product_id, value > 50 AS is_viral FROM events""",
    "stock": """
        SELECT l_partkey * 1000000 + l_suppkey AS stock_id, l_partkey AS product_id, l_suppkey AS location_id,
          CAST(min(l_quantity) AS BIGINT) AS quantity_on_hand, CAST(min(l_linenumber) AS BIGINT) AS quantity_reserved,
          CAST(10 AS BIGINT) AS reorder_point
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "locations": """
        SELECT s_suppkey AS location_id, s_name AS name, n_name AS city, r_name AS state, s_suppkey % 2 = 0 AS is_pickup_enabled
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "customers": """
        SELECT c_custkey AS customer_id, lower(c_name) || '@example.com' AS email, split_part(c_name, '#', 1) AS first_name,
          split_part(c_name, '#', 2) AS last_name, c_mktsegment AS loyalty_tier, CAST(floor(c_acctbal) AS BIGINT) AS points_balance,
          c_acctbal > 0 AS is_active
        FROM customer""",
    "shop_orders": f"""
        SELECT o_orderkey AS order_id, o_orderkey AS session_id, o_custkey AS customer_id, o_orderstatus AS status,
          {CENTS.format('o_totalprice')} AS total_cents, o_orderdate AS created_at
        FROM orders""",
    "shop_sessions": f"""
        SELECT o_orderkey AS session_id, o_custkey AS customer_id,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'pending_payment' END AS status,
          {CENTS.format('o_totalprice')} AS total_cents, o_orderdate AS created_at
        FROM orders""",
    "shop_items": f"""
        SELECT l_orderkey AS session_id, l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
          {CENTS.format('l_extendedprice')} AS subtotal_cents, l_shipdate AS sold_at
        FROM lineitem""",
    "promotions": """
        SELECT s_suppkey AS promotion_id, 'CODE' || CAST(s_suppkey AS STRING) AS promo_code, s_suppkey % 3 <> 0 AS is_active,
          CAST(DATE '1996-01-01' + CAST(s_suppkey % 900 AS INT) AS <ntz>) AS start_date,
          CAST(DATE '1998-01-01' + CAST(s_suppkey % 700 AS INT) AS <ntz>) AS end_date,
          CASE WHEN s_suppkey % 4 = 0 THEN <list>(CAST(s_suppkey AS STRING), CAST(s_suppkey + 7 AS STRING)) END AS product_ids,
          CASE WHEN s_suppkey % 4 = 1 THEN <list>('lips', 'eyes') END AS category_ids,
          CASE WHEN s_suppkey % 4 = 2 THEN <list>('Brand#1', 'Brand#2') END AS brand_names
        FROM supplier""",
    "price_history": f"""
        SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS effective_date,
          CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_shipdate AS DATE) + 90 END AS end_date, {CENTS.format('l_extendedprice')} AS price
        FROM lineitem""",
    "people_vectors": """
        SELECT vec_id AS embedding_id, vec_id AS customer_id, CAST(embedding AS <doubles>) AS embedding,
          vec_id % 7 <> 0 AS is_active, vec_id % 2 = 0 AS is_primary
        FROM embeddings
        UNION ALL
        SELECT 1000000000 + a.vec_id, a.vec_id + 1, <zip8>, a.vec_id % 5 <> 1, a.vec_id % 3 = 0
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 2""",
    "query_vectors": """
        SELECT a.vec_id AS query_id, CASE a.vec_id % 3 WHEN 0 THEN <zip8> WHEN 1 THEN <zip7> ELSE <zip55> END AS embedding
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "pixels": """
        SELECT CAST(floor(doc_id / 4) AS BIGINT) AS image_id, CASE WHEN doc_id % 3 = 2 THEN 'lip' ELSE 'skin' END AS region,
          CAST(n_chars % 100 AS INT) AS x, CAST(n_chars % 70 AS INT) AS y, 90 AS w, 64 AS h,
          CAST((n_chars * 37) % 256 AS INT) AS r, CAST((n_chars * 59) % 256 AS INT) AS g, CAST((n_chars * 83) % 256 AS INT) AS b
        FROM documents""",
    "commands": f"""
        SELECT event_id AS seq, ts, user_id AS session_id, user_id + 5000 AS customer_id,
          CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'add' WHEN 'view' THEN 'update' WHEN 'error' THEN 'remove'
            ELSE 'checkout' END AS command,
          {K} % 10 AS item_ref, CASE WHEN event_type = 'click' THEN {K} * 3 END AS product_id, CAST(NULL AS BIGINT) AS variant_id,
          1 + CAST(floor(value) AS BIGINT) % 9 AS quantity
        FROM events""",
    "model_output": f"""
        SELECT 'labels/ANA-' || event_type || '-' || CAST(event_id AS STRING) || '_dense' || CASE WHEN event_id % 2 = 0 THEN '.png' ELSE '.jpeg' END AS file_path,
          CASE WHEN event_id % 17 = 0 THEN 'no label found'
               WHEN event_id % 19 = 0 THEN 'Result: ' || props || ' and {{more}}'
               ELSE 'Result:\n{{"brand":"' || event_type || '","product_name":"P' || CAST({K} AS STRING) || '","net_weight":"' || CAST(user_id AS STRING) || ' g","spf":'
                 || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"' || CAST({K} AS STRING) || '"' END
                 || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"warnings":["keep away","w' || CAST({K} AS STRING) || '"]' END
                 || ',"directions":[' || CASE WHEN event_id % 5 = 0 THEN '' ELSE '"apply ' || event_type || '"' END
                 || '],"other_information":["lot ' || CAST(event_id AS STRING) || '",null],"inactive_ingredients":["a","b","c' || CAST({K} AS STRING) || '"]}} end'
          END AS raw_result
        FROM events""".replace("{{", "{").replace("}}", "}"),
}
DEPENDS = {"ingredients": ["pairs"], "warnings": ["pairs"]}
WEIGHTS = {"zip8": ("0.8D", "0.2D"), "zip7": ("0.7D", "0.3D"), "zip55": ("0.55D", "0.45D")}


def role_sql(role: str, engine: str) -> str:
    names = dict(SPARK_NAMES if engine == "spark" else DUCK_NAMES)
    zipped = names.pop("zip")
    for tag, (a, b) in WEIGHTS.items():
        if engine == "duck":
            a, b = (f"CAST({w[:-1]} AS DOUBLE)" for w in (a, b))
        names[tag] = zipped.format(a, b)
    names["ntz"] = "TIMESTAMP_NTZ" if engine == "spark" else "TIMESTAMP"
    names["doubles"] = "array<double>" if engine == "spark" else "DOUBLE[]"
    text = ROLES[role]
    for tag, value in names.items():
        text = text.replace(f"<{tag}>", value)
    return text


def with_roles(body: str, *roles: str) -> str:
    """DuckDB SQL with the named roles in front of ``body``."""
    ordered: list[str] = []
    for role in roles:
        for name in [*DEPENDS.get(role, []), role]:
            if name not in ordered:
                ordered.append(name)
    parts = [f"{r} AS ({role_sql(r, 'duck').strip()})" for r in ordered]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"


class Data:
    """Tables and roles as DataFrames: ``data.part``, ``data.products`` ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def _made(self) -> dict[str, DataFrame]:
        return {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._table(name) if name in TABLES else self._role(name)
        return self._made[name]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _role(self, name: str) -> DataFrame:
        if name not in ROLES:
            raise AttributeError(name)
        text = role_sql(name, "spark")
        sources = {}
        for other in [*TABLES, *DEPENDS.get(name, [])]:
            for word in ("FROM", "JOIN"):
                if f"{word} {other}" in text:
                    sources[other] = getattr(self, other)
                    text = text.replace(f"{word} {other}", f"{word} <<{other}>>")
        text = text.replace("{", "{{").replace("}", "}}")
        for other in sources:
            text = text.replace(f"<<{other}>>", "{" + other + "}")
        return self.spark.sql(text, **sources) if sources else self.spark.sql(text)
