"""Catalogue matching, colours, skin profiles, names and face vectors."""

from pyspark.sql import functions as F

from merchlens.functions import colors as C
from merchlens.functions.bands import face_quality, match_confidence
from merchlens.functions.text import looks_like_uuid, uuid_from
from merchlens.operators import color_match as M, derive as D, embeddings as E, names as N, quick_match as Q, similarity as S
from registry.core import query

DERIVED = """
  derived AS (SELECT p.* EXCLUDE (skin_type_compatibility),
    CASE WHEN mild AND NOT list_contains(base, 'sensitive') THEN list_append(base, 'sensitive') ELSE base END AS skin_type_compatibility
    FROM (SELECT *, CASE WHEN skin_type_compatibility IS NULL OR len(skin_type_compatibility) = 0 THEN
        CASE WHEN finish IN ('matte', 'powder') THEN ['oily', 'combination'] WHEN finish IN ('dewy', 'cream', 'satin') THEN ['dry', 'combination']
          WHEN finish IN ('natural', 'semi-matte') THEN ['normal', 'combination'] ELSE ['combination'] END
        ELSE skin_type_compatibility END AS base,
      EXISTS (SELECT 1 FROM ingredients i WHERE i.product_id = products.product_id AND NOT i.is_allergen) AS mild FROM products) p)
"""


def derived(d):
    return D.derive_skin_types(d.products, d.ingredients)


@query(
    "derive_skin_types",
    f"WITH {DERIVED} SELECT product_id, finish, array_to_string(skin_type_compatibility, ',') AS skin_types FROM derived",
    "products ingredients",
)
def _(d):
    return derived(d).select("product_id", "finish", F.array_join("skin_type_compatibility", ",").alias("skin_types"))


@query(
    "derive_skin_types_strict",
    """SELECT product_id, coalesce(list_contains(skin_type_compatibility, 'sensitive'), FALSE)
         OR (EXISTS (SELECT 1 FROM ingredients i WHERE i.product_id = p.product_id)
             AND NOT EXISTS (SELECT 1 FROM ingredients i WHERE i.product_id = p.product_id AND i.is_allergen)) AS sensitive
       FROM products p""",
    "products ingredients",
)
def _(d):
    strict = D.derive_skin_types(d.products, d.ingredients, strict=True)
    return strict.select("product_id", F.array_contains("skin_type_compatibility", "sensitive").alias("sensitive"))


@query(
    "sensitive_semi_join",
    "SELECT product_id, name FROM products p WHERE EXISTS (SELECT 1 FROM ingredients i WHERE i.product_id = p.product_id AND NOT i.is_allergen)",
    "products ingredients",
)
def _(d):
    return d.products.join(D.non_allergen_products(d.ingredients), "product_id", "left_semi").select("product_id", "name")


@query(
    "products_quick_match",
    f"""WITH {DERIVED} SELECT product_id, name, brand, category, current_price, array_to_string(skin_type_compatibility, ', ') AS skin_types,
        array_to_string(undertone_compatibility, ', ') AS undertones FROM derived WHERE is_active""",
    "products ingredients",
)
def _(d):
    return Q.products_quick_match_view(derived(d))


QUICK = "SELECT {0} AS asked, product_id, name, brand, category, current_price AS price FROM (SELECT * FROM derived WHERE is_active AND {1} ORDER BY current_price, product_id LIMIT 10)"


@query(
    "quick_product_match",
    f"WITH {DERIVED} "
    + " UNION ALL ".join(
        [
            QUICK.format("'oily warm face'", "list_contains(skin_type_compatibility, 'oily') AND list_contains(undertone_compatibility, 'warm') AND category = 'face'"),
            QUICK.format("'dry'", "list_contains(skin_type_compatibility, 'dry')"),
            QUICK.format("'anything'", "TRUE"),
        ]
    ),
    "products ingredients",
)
def _(d):
    p = derived(d)
    asked = {"oily warm face": ("Oily", "WARM", "Face"), "dry": ("dry", "", None), "anything": (None, "", "")}
    out = None
    for label, args in asked.items():
        rows = Q.quick_product_match(p, *args).withColumn("asked", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out


WORDS = " UNION ALL ".join(
    f"SELECT '{word}' AS filter_term, '{cat}' AS category" for cat, names in M.CATEGORY_WORDS.items() for word in names
)


@query(
    "category_alias_filter",
    f"""WITH words AS ({WORDS}) SELECT filter_term, w.category, count(*) AS n, count(*) FILTER (WHERE is_active) AS active
        FROM words w JOIN products p ON lower(p.category) = w.category GROUP BY 1, 2""",
    "products",
)
def _(d):
    counts = d.products.groupBy(F.lower("category").alias("category")).agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"))
    return M.category_words(d.spark).join(counts, "category")


LAB = """
  lin AS (SELECT *, CASE WHEN r/255.0 > 0.04045 THEN pow((r/255.0 + 0.055)/1.055, 2.4) ELSE r/255.0/12.92 END AS lr,
      CASE WHEN g/255.0 > 0.04045 THEN pow((g/255.0 + 0.055)/1.055, 2.4) ELSE g/255.0/12.92 END AS lg,
      CASE WHEN b/255.0 > 0.04045 THEN pow((b/255.0 + 0.055)/1.055, 2.4) ELSE b/255.0/12.92 END AS lb FROM mean),
  xyz AS (SELECT *, (lr*0.4124564 + lg*0.3575761 + lb*0.1804375)/0.95047 AS x, lr*0.2126729 + lg*0.7151522 + lb*0.0721750 AS y,
      (lr*0.0193339 + lg*0.1191920 + lb*0.9503041)/1.08883 AS z FROM lin),
  crv AS (SELECT *, CASE WHEN x > 0.008856 THEN pow(x, 1/3.0) ELSE 7.787*x + 16/116.0 END AS fx,
      CASE WHEN y > 0.008856 THEN pow(y, 1/3.0) ELSE 7.787*y + 16/116.0 END AS fy,
      CASE WHEN z > 0.008856 THEN pow(z, 1/3.0) ELSE 7.787*z + 16/116.0 END AS fz FROM xyz),
  lab AS (SELECT *, round(116*fy - 16, 2) AS ll, round(500*(fx - fy), 2) AS la, round(200*(fy - fz), 2) AS lbb FROM crv),
  profile AS (SELECT *, round(degrees(atan2(ll - 50, lbb)), 2) AS ita, '#' || lower(printf('%02x%02x%02x', r, g, b)) AS skin_hex FROM lab)
"""
MEANS = """
  mean AS (SELECT image_id, CAST(floor(avg(r) FILTER (region = 'skin')) AS INT) AS r, CAST(floor(avg(g) FILTER (region = 'skin')) AS INT) AS g,
      CAST(floor(avg(b) FILTER (region = 'skin')) AS INT) AS b, CAST(floor(avg(r) FILTER (region = 'lip')) AS INT) AS lr0,
      CAST(floor(avg(g) FILTER (region = 'lip')) AS INT) AS lg0, CAST(floor(avg(b) FILTER (region = 'lip')) AS INT) AS lb0
      FROM pixels WHERE x >= 0 AND x < w AND y >= 0 AND y < h GROUP BY image_id HAVING avg(r) FILTER (region = 'skin') IS NOT NULL)
"""


@query(
    "skin_profile",
    f"""WITH {MEANS}, {LAB} SELECT image_id, skin_hex, printf('%d,%d,%d', r, g, b) AS skin_rgb, ll AS lab_l, la AS lab_a, lbb AS lab_b,
        CASE WHEN lr0 IS NOT NULL THEN '#' || lower(printf('%02x%02x%02x', lr0, lg0, lb0)) END AS lip_hex, ita AS ita_angle,
        CASE WHEN ita > 55 THEN 1 WHEN ita > 41 THEN 2 WHEN ita > 28 THEN 3 WHEN ita > 10 THEN 4 WHEN ita > -30 THEN 5 ELSE 6 END AS fitzpatrick_type,
        CASE WHEN ita > 55 THEN 1 WHEN ita > 48 THEN 2 WHEN ita > 41 THEN 3 WHEN ita > 34 THEN 4 WHEN ita > 28 THEN 5 WHEN ita > 19 THEN 6
          WHEN ita > 10 THEN 7 WHEN ita > -10 THEN 8 WHEN ita > -30 THEN 9 ELSE 10 END AS monk_shade,
        CASE WHEN la + lbb > 15 THEN 'warm' WHEN la + lbb < 5 THEN 'cool' ELSE 'neutral' END AS undertone,
        CAST(0.9 AS DOUBLE) AS confidence_score FROM profile""",
    "pixels",
)
def _(d):
    p = D.skin_profile(d.pixels)
    return p.select(
        "image_id", "skin_hex", F.array_join(F.col("skin_rgb").cast("array<string>"), ",").alias("skin_rgb"),
        *[F.get("skin_lab", F.lit(i)).alias(n) for i, n in enumerate(("lab_l", "lab_a", "lab_b"))],
        "lip_hex", "ita_angle", "fitzpatrick_type", "monk_shade", "undertone", "confidence_score",
    )


def targets(d):
    return D.skin_profile(d.pixels).select(F.col("image_id").alias("target_id"), F.col("skin_hex").alias("target_hex"))


TARGETS = f"{MEANS}, targets AS (SELECT image_id AS target_id, r, g, b, '#' || lower(printf('%02x%02x%02x', r, g, b)) AS target_hex FROM mean)"
SHADES = """
  shades AS (SELECT p.product_id, p.name, p.brand, p.category, p.current_price AS price, v.variant_id, v.color_hex AS swatch_hex, m.url AS image_url,
      CASE WHEN regexp_matches(substr(color_hex, 2, 2), '^[0-9a-fA-F]{2}$') THEN CAST('0x' || substr(color_hex, 2, 2) AS INT) ELSE 0 END AS sr,
      CASE WHEN regexp_matches(substr(color_hex, 4, 2), '^[0-9a-fA-F]{2}$') THEN CAST('0x' || substr(color_hex, 4, 2) AS INT) ELSE 0 END AS sg,
      CASE WHEN regexp_matches(substr(color_hex, 6, 2), '^[0-9a-fA-F]{2}$') THEN CAST('0x' || substr(color_hex, 6, 2) AS INT) ELSE 0 END AS sb
    FROM products p JOIN variants v USING (product_id) LEFT JOIN media m ON m.product_id = p.product_id AND m.is_primary
    WHERE v.color_hex IS NOT NULL AND length(v.color_hex) = 7)
"""
COLOR_MATCH = f"""
  WITH {TARGETS}, {SHADES}, scored AS (SELECT target_id, s.*, (sr - r)*(sr - r) + (sg - g)*(sg - g) + (sb - b)*(sb - b) AS sq,
      CASE lower(category) WHEN 'face' THEN 1 WHEN 'lips' THEN 2 WHEN 'eyes' THEN 3 WHEN 'skincare' THEN 4 ELSE 5 END AS prio
      FROM targets CROSS JOIN shades s WHERE category IN ('lips', 'face', 'eyes', 'skincare')),
  ranked AS (SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY sq, prio, product_id, variant_id, image_url NULLS LAST) AS rank,
      product_id, name, brand, category, swatch_hex, round(sqrt(sq), 2) AS color_distance, price, image_url FROM scored)
"""


@query("color_match", COLOR_MATCH + "SELECT CAST(rank AS INT) AS rank, * EXCLUDE (rank) FROM ranked WHERE rank <= 10", "pixels products variants media")
def _(d):
    return M.match_products(targets(d), d.products, d.variants, d.media)


@query(
    "match_as_array",
    COLOR_MATCH + """SELECT target_id, string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY rank) AS products FROM ranked WHERE rank <= 5 GROUP BY target_id""",
    "pixels products variants media",
)
def _(d):
    t = targets(d)
    lists = M.as_array(M.match_products(t, d.products, d.variants, d.media, k=5), "target_id", t)
    return lists.select("target_id", F.array_join(F.transform("matches", lambda m: m["product_id"].cast("string")), ",").alias("products"))


@query(
    "color_match_category",
    f"""WITH {TARGETS}, {SHADES}, scored AS (SELECT target_id, s.*, round(sqrt((sr - r)*(sr - r) + (sg - g)*(sg - g) + (sb - b)*(sb - b)), 2) AS color_distance
          FROM targets CROSS JOIN shades s WHERE lower(category) = 'lips' AND swatch_hex NOT LIKE '#GG%')
        SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY color_distance, product_id, variant_id, image_url NULLS LAST) AS INT) AS rank,
          product_id, name, brand, category, swatch_hex, color_distance, price, image_url FROM scored
        QUALIFY rank <= 10""",
    "pixels products variants media",
)
def _(d):
    return M.match_products_in_category(targets(d), d.products, d.variants, d.media, "Lips")


CUST = "customers"
VECS = f"people_vectors {CUST} query_vectors"
BAND = "CASE WHEN s >= 0.95 THEN 'HIGH' WHEN s >= 0.85 THEN 'MEDIUM' WHEN s >= 0.70 THEN 'LOW' ELSE 'NONE' END"
PAIRS = """pairs AS (SELECT q.query_id, e.embedding_id, c.*, list_cosine_similarity(q.embedding, e.embedding) AS s
    FROM query_vectors q CROSS JOIN people_vectors e JOIN customers c USING (customer_id) WHERE e.is_active AND c.is_active)"""


@query(
    "vector_best_match",
    f"""WITH {PAIRS}, best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, customer_id, embedding_id) = 1)
        SELECT query_id, coalesce(s >= 0.85, FALSE) AS found, customer_id, first_name, last_name, round(s, 4) AS similarity_score,
          CASE WHEN s IS NULL THEN 'NONE' ELSE {BAND} END AS confidence_level FROM query_vectors LEFT JOIN best USING (query_id)""",
    VECS,
)
def _(d):
    r = S.best_match(d.query_vectors, d.people_vectors, d.customers, dim=64)
    return r.withColumn("similarity_score", F.round("similarity_score", 4))


@query(
    "vector_topk_cosine",
    f"""WITH {PAIRS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, customer_id, embedding_id) AS INT) AS rank,
          customer_id, email, first_name, last_name, loyalty_tier, round(s, 4) AS similarity_score, {BAND} AS confidence_level
        FROM pairs WHERE s >= 0.7 QUALIFY rank <= 5""",
    VECS,
)
def _(d):
    r = S.topk_cosine(d.query_vectors, d.people_vectors, d.customers, dim=64)
    return r.withColumn("similarity_score", F.round("similarity_score", 4))


L2 = """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 4), customer_id, embedding_id) AS INT) AS rank,
          customer_id, first_name, last_name, email, loyalty_tier, points_balance, round(dist, 4) AS distance,
          CASE WHEN dist < 0.40 THEN 'high' WHEN dist < 0.55 THEN 'medium' ELSE 'none' END AS match_level
        FROM (SELECT q.query_id, e.embedding_id, c.*, list_distance(q.embedding, e.embedding) AS dist
              FROM query_vectors q CROSS JOIN people_vectors e JOIN customers c USING (customer_id) WHERE e.is_primary{0}) QUALIFY rank <= 5"""


@query("vector_topk_l2", L2.format(" AND e.is_active AND list_distance(q.embedding, e.embedding) < 0.55"), VECS)
def _(d):
    return S.topk_l2(d.query_vectors, d.people_vectors, d.customers, dim=64)


@query("vector_topk_l2_compat", L2.format(""), VECS)
def _(d):
    return S.topk_l2(d.query_vectors, d.people_vectors, d.customers, compat=True, dim=64)


@query(
    "similar_entities",
    """WITH src AS (SELECT customer_id AS source_id, embedding FROM people_vectors WHERE is_active AND is_primary
          QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY embedding_id) = 1),
        pairs AS (SELECT source_id, e.embedding_id, c.*, list_cosine_similarity(src.embedding, e.embedding) AS s
          FROM src CROSS JOIN people_vectors e JOIN customers c USING (customer_id) WHERE e.is_active AND c.is_active AND customer_id <> source_id)
        SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY round(s, 6) DESC, customer_id, embedding_id) AS INT) AS rank,
          customer_id, email, first_name, last_name, round(s, 4) AS similarity_score FROM pairs WHERE s >= 0.8 QUALIFY rank <= 10""",
    "people_vectors customers",
)
def _(d):
    sources = d.people_vectors.select(F.col("customer_id").alias("source_id"))
    r = S.similar_entities(sources, d.people_vectors, d.customers, dim=64)
    return r.withColumn("similarity_score", F.round("similarity_score", 4))


@query(
    "register_validate",
    """SELECT n.vec_id, c.customer_id IS NOT NULL AS accepted,
         CASE WHEN c.customer_id IS NULL THEN 'Customer not found or inactive' END AS error,
         CASE WHEN c.customer_id IS NOT NULL THEN TRUE END AS is_active, CASE WHEN c.customer_id IS NOT NULL THEN FALSE END AS is_primary
       FROM embeddings n LEFT JOIN customers c ON c.customer_id = n.vec_id AND c.is_active""",
    "customers",
)
def _(d):
    new = d.embeddings.select("vec_id", F.col("vec_id").alias("customer_id"), "embedding")
    good, bad = E.register_embeddings(new, d.customers, dim=64)
    good = good.select("vec_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("error"), "is_active", "is_primary")
    return good.unionByName(bad.select("vec_id", F.lit(False).alias("accepted"), "error"), allowMissingColumns=True)


@query(
    "deactivate_bulk",
    """WITH keys AS (SELECT DISTINCT label AS customer_id FROM embeddings)
       SELECT k.customer_id, count(e.embedding_id) AS embeddings_deactivated,
         (SELECT count(*) FROM people_vectors p WHERE p.is_active AND p.customer_id NOT IN (SELECT customer_id FROM keys)) AS still_active
       FROM keys k LEFT JOIN people_vectors e ON e.customer_id = k.customer_id GROUP BY k.customer_id""",
    "people_vectors",
)
def _(d):
    keys = d.embeddings.select(F.col("label").cast("long").alias("customer_id"))
    updated, counts = E.deactivate(d.people_vectors, keys, by="customer_id")
    still = updated.agg(F.count_if("is_active").alias("still_active")).scalar()
    return counts.withColumn("still_active", still).withColumn("customer_id", F.col("customer_id").cast("int"))


@query(
    "match_confidence",
    """SELECT event_id, greatest(0, 1 - value / 50.0) AS confidence, greatest(0, 1 - CASE WHEN floor(value) = 0 THEN 0.5 ELSE floor(value) END) AS compat_confidence,
         round(least(1.0, 10 * (user_id % 90 + 1) * 20 / (640.0 * 480.0)), 3) AS quality FROM events""",
)
def _(d):
    right = F.lit(10) + F.col("user_id") % 90 + 1
    return d.events.select(
        "event_id", match_confidence(F.col("value") / 50.0).alias("confidence"),
        match_confidence(F.floor("value"), compat=True).alias("compat_confidence"),
        face_quality(F.lit(5), right, F.lit(25), F.lit(10), F.lit(480), F.lit(640)).alias("quality"),
    )


REFS = """refs AS (SELECT DISTINCT ref FROM (
    SELECT upper(name) AS ref FROM products UNION ALL SELECT p_name AS ref FROM part UNION ALL SELECT split_part(p_brand, '#', 2) || ' ' || CAST(p_partkey AS VARCHAR) FROM part
    UNION ALL SELECT 'no ' || p_name FROM part UNION ALL SELECT substr(p_name, 3, 2) FROM part))"""


@query(
    "name_resolve",
    f"""WITH {REFS}, cand AS (SELECT CAST(product_id AS VARCHAR) AS id, lower(name) AS name FROM products),
        ex AS (SELECT ref, min(id) AS id FROM refs JOIN cand ON name = lower(ref) GROUP BY ref),
        co AS (SELECT ref, min(id) AS id FROM refs JOIN cand ON contains(name, lower(ref)) GROUP BY ref)
        SELECT ref, coalesce(ex.id, co.id) AS id, CASE WHEN ex.id IS NOT NULL THEN 'exact' WHEN co.id IS NOT NULL THEN 'contains' END AS how,
          CASE WHEN ex.id IS NULL AND co.id IS NULL THEN 'Product not found: ' || ref END AS error
        FROM refs LEFT JOIN ex USING (ref) LEFT JOIN co USING (ref)""",
    "products",
)
def _(d):
    p = d.part
    refs = (
        d.products.select(F.upper("name").alias("ref"))
        .unionByName(p.select(F.col("p_name").alias("ref")))
        .unionByName(p.select(F.concat(F.split_part("p_brand", F.lit("#"), F.lit(2)), F.lit(" "), F.col("p_partkey").cast("string")).alias("ref")))
        .unionByName(p.select(F.concat(F.lit("no "), "p_name").alias("ref")))
        .unionByName(p.select(F.substring("p_name", 3, 2).alias("ref")))
    )
    return N.resolve_names(refs, d.products.select(F.col("product_id").cast("string").alias("id"), "name"))


UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)"


@query(
    "uuid_shape",
    f"""SELECT s_suppkey, {UUID} AS id, TRUE AS id_ok, length(s_name) = 36 AS name_ok, FALSE AS cut_ok
        FROM (SELECT s_suppkey, s_name, md5(CAST(s_suppkey AS VARCHAR)) AS m FROM supplier)""",
)
def _(d):
    made = d.supplier.select("s_suppkey", "s_name", uuid_from(F.col("s_suppkey")).alias("id"))
    return made.select(
        "s_suppkey", "id", looks_like_uuid(F.col("id")).alias("id_ok"), looks_like_uuid(F.col("s_name")).alias("name_ok"),
        looks_like_uuid(F.translate("id", "-", "+")).alias("cut_ok"),
    )


@query(
    "session_resolve",
    """WITH refs AS (SELECT CAST(c_custkey AS VARCHAR) AS ref FROM customer UNION SELECT 's' || CAST(o_orderkey AS VARCHAR) FROM orders
         UNION SELECT 'x' || CAST(c_custkey AS VARCHAR) FROM customer),
       newest AS (SELECT CAST(customer_id AS VARCHAR) AS ref, 's' || CAST(session_id AS VARCHAR) AS sid FROM shop_sessions WHERE status = 'active'
         QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, 's' || CAST(session_id AS VARCHAR) DESC) = 1)
       SELECT r.ref, coalesce('s' || CAST(s.session_id AS VARCHAR), n.sid) AS session_id,
         CASE WHEN s.session_id IS NOT NULL THEN 'session' WHEN n.sid IS NOT NULL THEN 'customer' END AS how,
         CASE WHEN s.session_id IS NULL AND n.sid IS NULL THEN 'Cart session not found: ' || r.ref END AS error
       FROM refs r LEFT JOIN shop_sessions s ON r.ref = 's' || CAST(s.session_id AS VARCHAR) LEFT JOIN newest n ON n.ref = r.ref""",
    "shop_sessions",
)
def _(d):
    sessions = d.shop_sessions.withColumn("session_id", F.concat(F.lit("s"), F.col("session_id").cast("string")))
    key = F.col("c_custkey").cast("string")
    refs = (
        d.customer.select(key.alias("ref"))
        .unionByName(sessions.select(F.col("session_id").alias("ref")))
        .unionByName(d.customer.select(F.concat(F.lit("x"), key).alias("ref")))
    )
    return N.resolve_sessions(refs, sessions)


@query(
    "color_channels",
    """SELECT variant_id, CASE WHEN regexp_matches(substr(color_hex, 2, 2), '^[0-9a-fA-F]{2}$') THEN CAST('0x' || substr(color_hex, 2, 2) AS INT) ELSE 128 END AS r
       FROM variants WHERE color_hex IS NOT NULL""",
    "variants",
)
def _(d):
    bare = F.replace("color_hex", F.lit("#"), F.lit(""))
    return d.variants.filter("color_hex IS NOT NULL").select("variant_id", C.hex_channel(C.with_hash(bare), 0, 128).alias("r"))
