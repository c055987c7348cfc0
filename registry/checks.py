"""Data quality, loading, file listings and streams."""

from pyspark.sql import functions as F

from merchlens.operators import quality as Q
from merchlens.session import scratch_path
from merchlens.sources import bookkeeping, catalog
from merchlens.sources.csv import load_csv, with_defaults
from merchlens.sources.files import register_files
from merchlens.streaming import carts, folds, responses, snapshots
from registry.carts import CHECKOUT_SQL, LINES, ORDER_COLUMNS, ORDER_ITEMS_SQL, SESSIONS_SQL
from registry.core import query
from registry.texts import INDEX, PARSED, SKU, TRANSCRIPT_SQL, stream_events, told_turns

ANCHOR = "2002-01-01 00:00:00"


@query(
    "dq_table_metrics",
    f"""SELECT 'row_count' AS metric, '' AS "column", count(*) AS value FROM reviews
        UNION ALL SELECT 'freshness_seconds', 'created_at', CAST(epoch(TIMESTAMP '{ANCHOR}' - max(created_at)) AS BIGINT) FROM reviews
        UNION ALL SELECT 'null_count', 'review_text', count(*) - count(review_text) FROM reviews
        UNION ALL SELECT 'null_count', 'rating', count(*) - count(rating) FROM reviews
        UNION ALL SELECT 'rule_violations', 'helpful above rating', count(*) FILTER (helpful_votes > rating) FROM reviews""",
    "reviews",
)
def _(d):
    rules = {"helpful above rating": F.col("helpful_votes") > F.col("rating")}
    return Q.table_metrics(d.reviews, ["created_at"], ["review_text", "rating"], rules, ANCHOR)


@query("dq_cost_exceeds_price", "SELECT 'cost' AS metric, count(*) FILTER (cost > current_price) AS value FROM products", "products")
def _(d):
    rows = Q.table_metrics(d.products, rules={"cost": Q.cost_exceeds_price()})
    return rows.filter("metric = 'rule_violations'").select(F.col("column").alias("metric"), "value")


@query("dq_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(d):
    return Q.unique_violations(d.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "dq_foreign_key",
    """SELECT 'documents' AS child, CAST(doc_id AS BIGINT) AS key, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL
       UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY ALL
       UNION ALL SELECT 'customer', c_custkey, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY ALL""",
)
def _(d):
    def bad(child, parent, child_key, parent_key, name):
        rows = Q.fk_violations(child, parent, child_key, parent_key)
        return rows.select(F.lit(name).alias("child"), F.col(child_key).alias("key"), "n")

    return (
        bad(d.documents, d.labels, "doc_id", "doc_id", "documents")
        .unionByName(bad(d.lineitem, d.orders, "l_orderkey", "o_orderkey", "lineitem"))
        .unionByName(bad(d.customer, d.orders, "c_custkey", "o_custkey", "customer"))
    )


@query(
    "dq_not_null",
    """SELECT 'description' AS "column", count(*) - count(description) AS violations FROM products UNION ALL SELECT 'finish', count(*) - count(finish) FROM products
       UNION ALL SELECT 'name', count(*) - count(name) FROM products""",
    "products",
)
def _(d):
    return Q.null_violations(d.products, ["description", "finish", "name"])


@query(
    "dq_length",
    """SELECT 'text' AS "column", count(*) FILTER (length(text) > 500) AS violations FROM documents UNION ALL SELECT 'lang', count(*) FILTER (length(lang) > 2) FROM documents""",
)
def _(d):
    return Q.length_violations(d.documents, {"text": 500, "lang": 2})


@query(
    "dq_constraints",
    """SELECT 'products' AS "table", 'primary key' AS rule, 'product_id' AS columns, count(*) - count(DISTINCT product_id) AS violations FROM products
       UNION ALL SELECT 'product_variants', 'primary key', 'variant_id', count(*) - count(DISTINCT variant_id) FROM variants
       UNION ALL SELECT 'product_variants', 'reference', 'product_id', count(DISTINCT product_id) FILTER (product_id NOT IN (SELECT product_id FROM products)) FROM variants
       UNION ALL SELECT 'product_ingredients', 'primary key', 'ingredient_id', count(*) - count(DISTINCT ingredient_id) FROM ingredients
       UNION ALL SELECT 'product_ingredients', 'reference', 'product_id', count(DISTINCT product_id) FILTER (product_id NOT IN (SELECT product_id FROM products)) FROM ingredients
       UNION ALL SELECT 'customers', 'primary key', 'customer_id', count(*) - count(DISTINCT customer_id) FROM customers
       UNION ALL SELECT 'customers', 'unique', 'email', count(*) - count(DISTINCT email) FROM customers
       UNION ALL SELECT 'customer_face_embeddings', 'primary key', 'embedding_id', count(*) - count(DISTINCT embedding_id) FROM people_vectors
       UNION ALL SELECT 'customer_face_embeddings', 'reference', 'customer_id', count(DISTINCT customer_id) FILTER (customer_id NOT IN (SELECT customer_id FROM customers)) FROM people_vectors""",
    "products variants ingredients customers people_vectors",
)
def _(d):
    return catalog.constraint_report(
        {
            "products": d.products, "product_variants": d.variants, "product_ingredients": d.ingredients,
            "customers": d.customers, "customer_face_embeddings": d.people_vectors,
        }
    )


@query(
    "defaults_fill",
    """SELECT p_partkey AS product_id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size % 4 = 0 END, TRUE) AS is_active, FALSE AS is_vegan, FALSE AS is_cruelty_free, FALSE AS is_featured,
       TIMESTAMP '2002-01-01 00:00:00' AS created_at FROM part""",
)
def _(d):
    given = d.part.select(
        F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 4 == 0).alias("is_active")
    )
    columns = ["is_active", "is_vegan", "is_cruelty_free", "is_featured", "created_at"]
    return with_defaults(given, catalog.defaults_for("products", columns), F.lit(ANCHOR).cast("timestamp_ntz"))


@query(
    "load_csv_null_tokens",
    """SELECT c_custkey AS customer_id, c_name || ', "the' || chr(10) || 'second"' AS first_name,
         CASE c_custkey % 4 WHEN 3 THEN c_mktsegment END AS loyalty_tier, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS points_balance,
         CAST(NULL AS VARCHAR) AS phone, CASE WHEN c_acctbal > 0 THEN TRUE ELSE FALSE END AS is_active FROM customer""",
)
def _(d):
    path = scratch_path(d.spark, "csv")
    token = F.element_at(F.array(F.lit(""), F.lit("NULL"), F.lit("null")), (F.col("c_custkey") % 4 + 1).cast("int"))
    raw = d.customer.select(
        F.when(F.col("c_acctbal") > 0, "True").otherwise("False").alias("IS_ACTIVE"),
        F.col("c_custkey").alias("Customer_ID"),
        F.concat("c_name", F.lit(', "the\nsecond"')).alias("first_name"),
        F.when(F.col("c_custkey") % 4 == 3, F.col("c_mktsegment")).otherwise(token).alias("LOYALTY_TIER"),
        F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("points_balance"),
        F.lit("dropped").alias("EXTRA"),
    )
    raw.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    schema = "customer_id long, first_name string, loyalty_tier string, points_balance long, phone string, is_active boolean"
    return load_csv(d.spark, path, schema, multi_line=True)


@query(
    "load_csv_by_header",
    """SELECT n_nationkey AS nation_id, n_name AS name, n_regionkey AS region_id, CAST(NULL AS VARCHAR) AS note FROM nation
       UNION ALL SELECT r_regionkey + 100, r_name, NULL, 'region' FROM region""",
)
def _(d):
    """Two files with columns in another order and of another set, in one folder."""
    path = scratch_path(d.spark, "csv")
    first = d.nation.select(F.col("n_nationkey").alias("NATION_ID"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id"))
    second = d.region.select(F.lit("region").alias("note"), F.col("r_name").alias("Name"), (F.col("r_regionkey") + 100).alias("nation_id"))
    for part in (first, second):
        part.write.mode("append").option("header", True).csv(path)
    return load_csv(d.spark, path, "nation_id long, name string, region_id long, note string")


def in_three_parts(d, df, name, order):
    """Write a table as three folders in the order of a column's tertiles, for a stream to read one by one."""
    path = scratch_path(d.spark, name)
    low, high = df.agg(F.percentile_approx(order, [0.34, 0.67])).first()[0]
    for i, part in enumerate((F.col(order) <= low, (F.col(order) > low) & (F.col(order) <= high), F.col(order) > high)):
        df.filter(part).write.parquet(f"{path}/part={i}")
    return path


def read_parts(d, path, schema):
    return d.spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{path}/*")


def finish(stream):
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query(
    "stream_label_refresh",
    f"""WITH {PARSED} SELECT file_path, {SKU.format('file_path')} AS sku, data->>'$.brand' AS brand, data->>'$.net_weight' AS net_weight, data IS NOT NULL AS readable FROM parsed""",
    "model_output",
)
def _(d):
    """Files of an earlier state, some of them stale or deleted later, then the state of the table; each refresh rebuilds all."""
    path, spark = scratch_path(d.spark, "label-files"), d.spark
    told = d.model_output.select("file_path", "raw_result").withColumn("part", F.pmod(F.xxhash64("file_path"), F.lit(3)))
    stale = told.withColumn("raw_result", F.lit('{"brand":"stale"}'))
    gone = told.withColumn("file_path", F.concat(F.lit("deleted/"), "file_path"))

    def put(rows, part):
        rows.drop("part").write.mode("overwrite").parquet(f"{path}/part={part}")

    def read_files():
        return spark.read.schema("file_path string, raw_result string").parquet(f"{path}/*")

    def refresh():
        clock = spark.readStream.schema("file_path string, raw_result string").option("pathGlobFilter", "*.parquet").parquet(f"{path}/*")
        finish(folds.stream_labels(clock, read_files, table, checkpoint, interval=None))

    table, checkpoint = scratch_path(spark, "labels"), scratch_path(spark, "labels-checkpoint")
    put(told.filter("part = 0"), 0)
    put(stale.filter("part = 1"), 1)
    put(gone, 2)
    refresh()
    put(told.filter("part = 1"), 1)
    put(told.filter("part = 2"), 2)
    refresh()
    labels = snapshots.current(spark, table)
    return labels.select("file_path", "sku", "brand", "net_weight", F.col("raw_json").isNotNull().alias("readable"))


@query("search_index_incremental", f"WITH {INDEX} SELECT term, df, CAST(sum(tf) AS BIGINT) AS cf FROM post JOIN dfs USING (term) GROUP BY ALL")
def _(d):
    path = in_three_parts(d, d.documents, "documents", "doc_id")
    sink, checkpoint = scratch_path(d.spark, "index"), scratch_path(d.spark, "index-checkpoint")
    finish(folds.stream_index(read_parts(d, path, d.documents.schema), "doc_id", "text", sink, checkpoint))
    postings = d.spark.read.parquet(f"{sink}/postings")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def cart_changes(d):
    """The command log folded as a stream of three parts."""
    commands = carts.all_commands(d.commands, d.products)
    path = in_three_parts(d, commands, "commands", "seq")
    sink, checkpoint = scratch_path(d.spark, "carts"), scratch_path(d.spark, "carts-checkpoint")
    finish(carts.stream_carts(read_parts(d, path, commands.schema), sink, checkpoint))
    return carts.changes(d.spark, sink)


@query(
    "stream_cart_fold",
    f"WITH {LINES} SELECT session_id, item_ref, add_seq, product_id, quantity, unit_price_cents, subtotal_cents FROM items",
    "commands products",
)
def _(d):
    lines = carts.open_lines(cart_changes(d))
    return lines.select("session_id", "item_ref", "add_seq", "product_id", "quantity", "unit_price_cents", "subtotal_cents")


@query("stream_cart_sessions", SESSIONS_SQL, "commands products")
def _(d):
    return carts.sessions(cart_changes(d))


@query("stream_cart_checkout", CHECKOUT_SQL, "commands products")
def _(d):
    return carts.orders(cart_changes(d)).select(*ORDER_COLUMNS)


@query("stream_cart_order_items", ORDER_ITEMS_SQL, "commands products")
def _(d):
    return carts.order_items(cart_changes(d)).drop("variant_id")


@query("stream_turns", TRANSCRIPT_SQL)
def _(d):
    """The responses of ``transcript_assemble`` from a stream of their events."""
    place = lambda i: F.split_part("turn_id", F.lit("-"), F.lit(i)).cast("long")
    events = stream_events(d).withColumn("ts", F.timestamp_seconds(86_400 + place(1) * 60 + place(2) * 5 + F.col("seq") / 1000))
    path = in_three_parts(d, events.withColumn("n", F.unix_millis("ts")), "events", "n")
    sink, checkpoint = scratch_path(d.spark, "turns"), scratch_path(d.spark, "turns-checkpoint")
    # Files of one part come in no order of time.
    finish(responses.stream_turns(read_parts(d, path, events.withColumn("n", F.lit(0).cast("long")).schema), sink, checkpoint, late="3650 days"))
    return told_turns(responses.turns_so_far(d.spark, sink))


@query(
    "processing_status",
    """SELECT 'f' || event_id AS file_path, event_id % 7 < 5 OR event_id % 7 = 6 AS processed,
         CASE WHEN event_id % 7 = 5 THEN 'failed in run 3' END AS error,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (CASE WHEN event_id % 7 < 3 THEN 1 WHEN event_id % 7 = 6 THEN 4 WHEN event_id % 7 = 3 THEN 2 ELSE 3 END) AS processed_at
       FROM events""",
)
def _(d):
    """Four runs over what was pending: files fail until their turn comes, one kind of file appears last, one always fails."""
    path, spark = scratch_path(d.spark, "processing"), d.spark
    files = d.events.select(F.concat(F.lit("f"), "event_id").alias("file_path"), (F.col("event_id") % 7).alias("k"))
    for run in (1, 2, 3, 4):
        listed = files.filter((F.col("k") < 6) if run < 4 else (F.col("k") == 6))
        works = (F.col("k") < run + 2) & (F.col("k") != 5) | (F.col("k") == 6)
        results = bookkeeping.pending(listed, bookkeeping.status(spark, path)).select(
            "file_path", works.alias("success"), F.when(~works, F.lit(f"failed in run {run}")).alias("error")
        )
        bookkeeping.record(results, path, run, F.lit(f"2024-01-01 0{run}:00:00"))
        if run == 2:
            bookkeeping.compact(spark, path)
    return bookkeeping.status(spark, path)
