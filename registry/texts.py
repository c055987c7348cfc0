"""Search content, text search, labels, transcripts and loose JSON."""

from pyspark.sql import functions as F

from merchlens.functions.text import base_name, joined_blank, sku_from_path, without_quotes, words
from merchlens.operators import content as T, labels as L, mentions as G, search as S, tool_results as R, transcripts as H
from merchlens.operators.infer import batch_infer, infer_in_batches, infer_totals
from merchlens.operators.spread import top_k
from merchlens.session import scratch_path
from merchlens.sources.files import STAGE_PREFIX, resolve_label_paths, unprocessed_files
from registry.core import query

LIVE = "p.product_id = x.product_id AND p.is_active"
SHARED = "p.brand, p.category, p.subcategory, p.current_price, p.is_vegan, p.is_cruelty_free"


@query(
    "product_search_content",
    f"""SELECT 'product' AS content_type, CAST(p.product_id AS VARCHAR) AS id, p.product_id, p.name AS title, coalesce(description, short_description, '') AS content,
          {SHARED}, color_name, finish, NULL AS source_image_url, NULL AS severity FROM products p WHERE is_active
        UNION ALL SELECT 'label', CAST(label_id AS VARCHAR), p.product_id, p.name || ' - ' || label_type, extracted_text, {SHARED}, NULL, NULL, source_image_url, NULL
          FROM label_texts x JOIN products p ON {LIVE}
        UNION ALL SELECT 'ingredient', ingredient_id, p.product_id, p.name || ' - Ingredient: ' || ingredient_name,
          ingredient_name || coalesce(' (' || ingredient_name_normalized || ')', '') || CASE WHEN is_allergen THEN ' [ALLERGEN: ' || coalesce(allergen_type, 'unknown') || ']' ELSE '' END,
          {SHARED}, NULL, NULL, source_image_url, NULL FROM ingredients x JOIN products p ON {LIVE}
        UNION ALL SELECT 'warning', warning_id, p.product_id, p.name || ' - Warning', warning_text, {SHARED}, NULL, NULL, source_image_url, severity
          FROM warnings x JOIN products p ON {LIVE}""",
    "products label_texts ingredients warnings",
)
def _(d):
    return T.product_search_content(d.products, d.label_texts, d.ingredients, d.warnings)


@query(
    "label_search_content",
    f"""SELECT 'ingredient' AS content_type, ingredient_id AS id, p.product_id, p.name AS product_name,
          p.name || ' (ID:' || p.product_id || ') - Ingredient: ' || ingredient_name || ' | Label: ' || coalesce(source_image_url, 'N/A') AS title,
          p.name || ' ' || p.brand || ' ' || ingredient_name AS content, {SHARED}, is_allergen, allergen_type, coalesce(source_image_url, 'N/A') AS label_image_url, NULL AS severity
        FROM ingredients x JOIN products p ON {LIVE}
        UNION ALL SELECT 'warning', warning_id, p.product_id, p.name,
          p.name || ' (ID:' || p.product_id || ') - Warning: ' || warning_text || ' | Label: ' || coalesce(source_image_url, 'N/A'),
          p.name || ' ' || p.brand || ' ' || warning_text, {SHARED}, FALSE, NULL, coalesce(source_image_url, 'N/A'), severity
        FROM warnings x JOIN products p ON {LIVE}""",
    "products ingredients warnings",
)
def _(d):
    return T.label_search_content(d.products, d.ingredients, d.warnings)


@query(
    "social_search_content",
    """SELECT 'review' AS content_type, review_id AS id, product_id, title, coalesce(review_text, '') AS content, review_url AS url, NULL AS author_handle, NULL AS author_name,
         platform, rating, helpful_votes AS engagement_score, verified_purchase, reviewer_skin_tone AS skin_tone, reviewer_skin_type AS skin_type,
         reviewer_undertone AS undertone, NULL AS sentiment_label, NULL AS is_sponsored, created_at AS posted_at FROM reviews WHERE is_approved
       UNION ALL SELECT 'social_mention', CAST(mention_id AS VARCHAR), product_id, NULL, coalesce(content_text, ''), post_url, author_handle, author_name, platform, NULL,
         likes + comments + shares, NULL, NULL, NULL, NULL, sentiment_label, NULL, posted_at FROM mentions
       UNION ALL SELECT 'influencer', CAST(mention_id AS VARCHAR), product_id, influencer_name || ' on ' || platform, coalesce(content_text, ''), post_url, influencer_handle,
         influencer_name, platform, NULL, likes + comments + views, NULL, influencer_skin_tone, influencer_skin_type, influencer_undertone, NULL, is_sponsored, posted_at
       FROM influencers""",
    "reviews mentions influencers",
)
def _(d):
    return T.social_search_content(d.reviews, d.mentions, d.influencers)


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
INDEX = f"""
  tok AS (SELECT doc_id AS id, {TOKENS.format('text')} AS w FROM documents),
  lens AS (SELECT id, len(w) AS dl FROM tok),
  post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tok) GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)
"""
BM25 = """
  qt AS (SELECT DISTINCT query_id, unnest({0}) AS term FROM queries),
  hits AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (id) CROSS JOIN corpus {1} GROUP BY ALL),
  top AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score FROM hits QUALIFY rank <= 10)
"""
TERMS = TOKENS.format("text")
ASKED = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"


def index(d):
    return S.build_index(d.documents, "doc_id", "text")


def stored_index(d):
    """The index of a folder's documents as a table, as a search service would keep it."""
    return S.save_index(index(d), scratch_path(d.spark, "text-index"))


def asked(d):
    return d.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query("bm25_topk", f"WITH {INDEX}, {ASKED}, {BM25.format(TERMS, '')} SELECT * FROM top")
def _(d):
    return S.search(stored_index(d), asked(d))


@query(
    "bm25_filtered",
    f"WITH {INDEX}, {ASKED}, {BM25.format(TERMS, 'WHERE id IN (SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND toxic = 0)')} SELECT * FROM top",
)
def _(d):
    good = d.labels.filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("id")).distinct()
    return S.search(stored_index(d), asked(d), allowed=good)


@query(
    "search_index_build",
    f"WITH {INDEX} SELECT term, df, CAST(sum(tf) AS BIGINT) AS cf FROM post JOIN dfs USING (term) GROUP BY ALL",
)
def _(d):
    return S.term_stats(index(d))


@query(
    "search_index_append",
    f"WITH {INDEX} SELECT id, dl, count(term) AS distinct_terms, CAST(coalesce(sum(tf), 0) AS BIGINT) AS tokens FROM lens LEFT JOIN post USING (id) GROUP BY ALL",
)
def _(d):
    first = S.build_index(d.documents.filter("lang = 'en'"), "doc_id", "text")
    whole = S.append_index(first, d.documents, "doc_id", "text")
    per_doc = whole.postings.groupBy("id").agg(F.count("*").alias("distinct_terms"), F.sum("tf").alias("tokens"))
    return whole.docs.join(per_doc, "id", "left").select(
        "id", "dl", F.coalesce("distinct_terms", F.lit(0)).alias("distinct_terms"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )


@query(
    "search_exclude_term",
    f"WITH {INDEX} SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT id FROM post WHERE term = 'the')",
)
def _(d):
    return S.exclude_term(d.documents.select("doc_id", "lang", "source"), index(d).postings, "The", key="doc_id")


@query(
    "fallback_search",
    f"""WITH {INDEX}, allq AS (SELECT item_id AS query_id, text FROM benchmark),
        first AS (SELECT source, doc_id AS id FROM documents WHERE lang = 'fr' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10),
        direct AS (SELECT query_id, id FROM allq JOIN first ON source = 'src' || query_id % 40),
        queries AS (SELECT * FROM allq WHERE query_id NOT IN (SELECT query_id FROM direct)), {BM25.format(TERMS, '')}
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INT) AS rank, id, 'filter' AS source FROM direct QUALIFY rank <= 10
        UNION ALL SELECT query_id, rank, id, 'text' FROM top""",
)
def _(d):
    q = asked(d)
    # French documents of a source that the query names; every second query names one that does not exist.
    first = top_k(d.documents.filter("lang = 'fr'").select("source", F.col("doc_id").alias("id")), ["source"], [F.col("id")], 10)
    hits = q.withColumn("source", F.concat(F.lit("src"), F.col("query_id") % 40)).join(first, "source")
    return S.search_with_fallback(hits.select("query_id", "id"), stored_index(d), q)


PARSED = r"""
  cut AS (SELECT file_path, regexp_extract(raw_result, '(?s)\{.*\}') AS j FROM model_output),
  parsed AS (SELECT file_path, CASE WHEN j <> '' AND json_valid(j) THEN CAST(j AS JSON) END AS data FROM cut)
"""
SKU = "split_part(replace(replace(split_part({0}, '/', -1), '.png', ''), '.jpeg', ''), '_', 1)"


def section(name: str) -> str:
    items = f"CAST(json_extract(data, '$.{name}') AS VARCHAR[])"
    return f"array_to_string(list_transform({items}, lambda v: coalesce(v, '')), ' | ')"


@query(
    "label_extract_parse",
    f"""WITH {PARSED} SELECT file_path, {SKU.format('file_path')} AS sku, data->>'$.brand' AS brand, data->>'$.product_name' AS product_name,
        data->>'$.net_weight' AS net_weight, data->>'$.spf' AS spf, {section('warnings')} AS warnings, {section('directions')} AS directions,
        {section('other_information')} AS other_information, {section('inactive_ingredients')} AS inactive_ingredients, data IS NOT NULL AS readable FROM parsed""",
    "model_output",
)
def _(d):
    return L.parse_labels(d.model_output).withColumn("readable", F.col("raw_json").isNotNull()).drop("raw_json")


def _rows(sort, name, section_name):
    return (
        f"SELECT file_path, CAST({sort} + i - 1 AS INT), '{name}' || i, v[i] FROM (SELECT file_path, v, unnest(range(1, len(v) + 1)) AS i FROM "
        f"(SELECT file_path, CAST(json_extract(data, '$.{section_name}') AS VARCHAR[]) AS v FROM parsed)) WHERE v[i] IS NOT NULL"
    )


def _heads():
    out = []
    for sort, name, field in L.FIELD_ROWS:
        value = f"data->>'$.{field}'"
        value = f"coalesce({value}, 'N/A')" if field == "spf" else value
        out.append(f"SELECT file_path, {sort} AS sort, '{name}' AS property, {value} AS value FROM parsed")
    out += [f"SELECT file_path, {s}, '{L.RULE_NAME}', '{L.RULE_VALUE}' FROM parsed" for s in L.RULE_ROWS]
    for sort, base, caption, item, name in L.SECTION_ROWS:
        out.append(f"SELECT file_path, {sort}, '{caption}', '(' || json_array_length(data, '$.{name}') || ' items)' FROM parsed")
        out.append(_rows(base, item, name))
    return " UNION ALL ".join(out)


@query("flatten_label_sections", f"WITH {PARSED} {_heads()}", "model_output")
def _(d):
    return L.flatten_label(L.parse_labels(d.model_output))


@query(
    "label_search_text",
    f"""WITH {PARSED} SELECT file_path, coalesce(data->>'$.brand', '') || ' ' || coalesce(data->>'$.product_name', '') || ' ' || coalesce({section('warnings')}, '')
        || ' ' || coalesce({section('directions')}, '') || ' ' || coalesce({section('other_information')}, '') || ' ' || coalesce({section('inactive_ingredients')}, '')
        AS search_content FROM parsed""",
    "model_output",
)
def _(d):
    return L.label_search_text(L.parse_labels(d.model_output)).select("file_path", "search_content")


@query(
    "sku_from_path",
    f"""SELECT file_path, {SKU.format('file_path')} AS sku, split_part(replace(replace(file_path, '.png', ''), '.jpeg', ''), '_', 1) AS compat_sku,
        split_part(file_path, '/', -1) AS file_name FROM model_output UNION ALL
        SELECT url, {SKU.format('url')}, split_part(replace(replace(url, '.png', ''), '.jpeg', ''), '_', 1), split_part(url, '/', -1) FROM pages""",
    "model_output",
)
def _(d):
    paths = d.model_output.select("file_path").unionByName(d.pages.select(F.col("url").alias("file_path")))
    p = F.col("file_path")
    return paths.select(p, sku_from_path(p).alias("sku"), sku_from_path(p, compat=True).alias("compat_sku"), base_name(p).alias("file_name"))


@query(
    "label_path_resolve",
    f"""WITH asked AS (SELECT '{STAGE_PREFIX}' || url AS path FROM pages UNION SELECT source || '/' || lang FROM documents)
        SELECT path, u.url AS resolved, CASE WHEN u.url IS NULL THEN '[Label image not available - please use LabelSearch to find products with label images]' END AS message
        FROM asked LEFT JOIN (SELECT DISTINCT url FROM pages) u ON u.url = replace(path, '{STAGE_PREFIX}', '')""",
)
def _(d):
    asked_paths = d.pages.select(F.concat(F.lit(STAGE_PREFIX), "url").alias("path")).unionByName(
        d.documents.select(F.concat_ws("/", "source", "lang").alias("path"))
    )
    return resolve_label_paths(asked_paths, d.pages.select(F.col("url").alias("file_path")))


@query(
    "unprocessed_files",
    "SELECT file_path FROM model_output WHERE file_path NOT IN (SELECT file_path FROM model_output WHERE raw_result LIKE 'Result:%')",
    "model_output",
)
def _(d):
    return unprocessed_files(d.model_output, d.model_output.filter("raw_result LIKE 'Result:%'"))


def longest_word(text: str) -> str:
    """Stands in for a model: answers short texts, refuses very long ones."""
    if len(text) > 4000:
        raise ValueError("too long")
    return str(len(text))


@query(
    "batch_infer_status",
    """SELECT doc_id, length(text) <= 4000 AS success, CASE WHEN length(text) <= 4000 THEN CAST(length(text) AS VARCHAR) END AS result,
       CASE WHEN length(text) > 4000 THEN 'too long' END AS error FROM documents""",
)
def _(d):
    return batch_infer(d.documents, "doc_id", "text", longest_word)


def longest_words(texts):
    """All texts of a call, or none: one that is too long fails the call."""
    return [longest_word(text) for text in texts]


@query(
    "batch_infer_bisected",
    """SELECT doc_id, length(text) <= 4000 AS success, CASE WHEN length(text) <= 4000 THEN CAST(length(text) AS VARCHAR) END AS result,
       CASE WHEN length(text) > 4000 THEN 'too long' END AS error FROM documents""",
)
def _(d):
    return infer_in_batches(d.documents, "doc_id", "text", longest_words, 32)


@query(
    "batch_infer_totals",
    """SELECT count(*) FILTER (length(text) <= 4000) AS processed, count(*) FILTER (length(text) > 4000) AS failed,
       count(*) FILTER (length(text) > 4000) = 0 AS success FROM documents""",
)
def _(d):
    return infer_totals(batch_infer(d.documents, "doc_id", "text", longest_word))


def stream_events(d):
    """Every message as the events of one response: pieces of 40 characters, a tool call and ids."""
    turn = F.concat_ws("-", "conv_id", "turn", "role").alias("turn_id")
    size = F.ceil(F.length("text") / 40).cast("int")
    pieces = d.conversations.select(turn, "text", F.posexplode(F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).alias("seq", "n"))
    piece = F.substr("text", (F.col("n") - 1) * 40 + 1, F.lit(40))
    deltas = pieces.select(
        "turn_id", (F.col("seq") + 9_995).cast("long").alias("seq"), F.lit("response.text.delta").alias("event_type"),
        F.when(F.col("n") % 2 == 0, F.to_json(F.struct(piece.alias("text")))).otherwise(F.to_json(F.struct(F.struct(piece.alias("text")).alias("delta")))).alias("payload"),
    )

    def extra(seq, kind, payload):
        return d.conversations.select(turn, F.lit(seq).cast("long").alias("seq"), kind.alias("event_type"), payload.alias("payload"))

    called = F.struct(F.concat(F.lit("u"), F.col("conv_id")).alias("tool_use_id"), F.lit("generic").alias("tool_type"), F.col("role").alias("name"), F.struct(F.col("turn")).alias("input"))
    tool = extra(0, F.lit("response.tool_use"), F.to_json(called))
    answered = F.struct(F.concat(F.lit("u"), F.col("conv_id")).alias("tool_use_id"), F.col("role").alias("name"), F.lit("success").alias("status"), F.col("turn").alias("content"))
    result = extra(20_000, F.lit("response.tool_result"), F.to_json(answered))
    meta = extra(1, F.lit(None).cast("string"), F.to_json(F.struct(F.lit("metadata").alias("type"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("message_id"))))
    broken = extra(2, F.lit("response.text.delta"), F.lit("{not json"))
    failed = extra(3, F.lit("error"), F.to_json(F.struct(F.concat(F.lit("failed "), F.col("conv_id")).alias("message")))).filter("turn_id LIKE '%-3-%'")
    out = deltas
    for more in (tool, result, meta, broken, failed):
        out = out.unionByName(more)
    return out


TRANSCRIPT_SQL = """SELECT concat_ws('-', conv_id, turn, role) AS turn_id, turn <> 3 AS success, CASE WHEN turn <> 3 THEN text END AS text,
         CASE WHEN turn <> 3 THEN 'u' || conv_id || ',generic,' || role || ',{"turn":' || turn || '}' END AS tools,
         CASE WHEN turn <> 3 THEN 'u' || conv_id || ',' || role || ',success,' || turn END AS results, CASE WHEN turn <> 3 THEN CAST(conv_id AS VARCHAR) END AS thread_id,
         CASE WHEN turn <> 3 THEN CAST(turn AS VARCHAR) END AS message_id, CASE WHEN turn = 3 THEN 'failed ' || conv_id END AS error FROM conversations"""


def told_turns(r):
    """Turns with their records as text."""
    told = lambda name, *fields: F.array_join(F.transform(name, lambda t: F.concat_ws(",", *[t[f] for f in fields])), ";").alias(name)
    tools, results = told("tools", "tool_use_id", "type", "name", "input"), told("tool_results", "tool_use_id", "name", "status", "content")
    return r.select("turn_id", "success", "text", tools, results.alias("results"), "thread_id", "message_id", "error")


@query("transcript_assemble", TRANSCRIPT_SQL)
def _(d):
    return told_turns(H.assemble_turns(stream_events(d)))


@query(
    "history_before_turn",
    """WITH cur AS (SELECT conv_id, max(turn) AS current_turn FROM conversations GROUP BY conv_id)
       SELECT conv_id AS session_id, current_turn, turn, role, text FROM conversations JOIN cur USING (conv_id)
       WHERE turn < current_turn AND trim(text) <> ''""",
)
def _(d):
    return H.history(d.conversations.withColumnRenamed("conv_id", "session_id"))


@query(
    "request_messages",
    """WITH cur AS (SELECT conv_id, max(turn) AS current_turn FROM conversations GROUP BY conv_id)
       SELECT conv_id AS session_id, current_turn, turn, role, text FROM conversations JOIN cur USING (conv_id)
       WHERE turn = current_turn OR trim(text) <> ''""",
)
def _(d):
    return H.request_messages(d.conversations.withColumnRenamed("conv_id", "session_id"))


MENTION_TEXT = """
  said AS (SELECT event_id AS turn_id, CAST(props->>'$.k' AS BIGINT) AS k, event_type, user_id,
      md5(CAST(CAST(props->>'$.k' AS BIGINT) AS VARCHAR)) AS m1, md5(CAST(user_id AS VARCHAR)) AS m2 FROM events)
"""
DASHED = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"


def spoken(d):
    """Event rows as assistant turns that name products in different ways, and what the tools returned."""
    from merchlens.functions.text import uuid_from

    k = F.get_json_object("props", "$.k").cast("long")
    base = d.events.select(F.col("event_id").alias("turn_id"), k.alias("k"), "event_type", "user_id").withColumns(
        {"id1": uuid_from(F.col("k")), "id2": uuid_from(F.col("user_id"))}
    )
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("Try **Rose "), "k", F.lit("** (ID: "), F.upper("id1"), F.lit(") - $"), "k", F.lit(".5 and **Item "), "user_id", F.lit("** (id: "), "id2", F.lit(")")))
        .when(F.col("event_type") == "click", F.concat(F.lit("**Velvet Pro Lipstick "), "k", F.lit("** - $"), "k", F.lit(".25 or **Mac Blush** - 9.")))
        .when(F.col("event_type") == "error", F.concat(F.lit("**Clean Beauty "), "k", F.lit("** - a fine one\n- **other**")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("- **Glow "), "k", F.lit("** today\n- **Nothing here**\n- **Ultra Kit**")))
        .otherwise("Nothing to name")
    )
    turns = base.select("turn_id", text.alias("text"), (F.col("k") % 2 == 0).alias("product_tool_used"))
    returned = base.filter("event_type IN ('view', 'purchase')").select(
        "turn_id", F.posexplode(F.sequence(F.lit(0), F.lit(5))).alias("pos", "i"), "k", "id1"
    ).select(
        "turn_id", "pos", F.when(F.col("pos") == 2, F.col("id1")).otherwise("short").alias("product_id"),
        F.concat(F.lit("Tool "), F.col("k") + F.col("pos")).alias("name"), F.lit("House").alias("brand"),
        (F.col("k") + F.col("pos")).cast("double").alias("price"), F.lit("lips").alias("category"),
        F.concat(F.lit("#"), F.lpad((F.col("k") + F.col("pos")).cast("string"), 6, "0")).alias("swatch_hex"),
        (F.col("pos") / 2).alias("color_distance"), F.concat(F.lit("img/"), "k").alias("image_url"),
    )
    return turns, returned


@query(
    "mention_grounding",
    f"""WITH {MENTION_TEXT}
      SELECT turn_id, 0 AS pos, {DASHED.format('m1')} AS product_id, 'Tool ' || (k + 2) AS name, 'House' AS brand, CAST(k + 2 AS DOUBLE) AS price, TRUE AS grounded, 'lips' AS category,
        '#' || lpad(CAST(k + 2 AS VARCHAR), 6, '0') AS swatch_hex, CAST(1 AS DOUBLE) AS color_distance, 'img/' || k AS image_url FROM said WHERE event_type = 'view'
      UNION ALL SELECT turn_id, 1, {DASHED.format('m2')}, CASE WHEN user_id = k THEN 'Tool ' || (k + 2) ELSE 'Item ' || user_id END, CASE WHEN user_id = k THEN 'House' ELSE 'Item' END,
        CASE WHEN user_id = k THEN CAST(k + 2 AS DOUBLE) ELSE 0 END, user_id = k, CASE WHEN user_id = k THEN 'lips' ELSE '' END,
        CASE WHEN user_id = k THEN '#' || lpad(CAST(k + 2 AS VARCHAR), 6, '0') ELSE '#f0f0f0' END, CASE WHEN user_id = k THEN 1 ELSE 5 END, CASE WHEN user_id = k THEN 'img/' || k ELSE '' END
        FROM said WHERE event_type = 'view'
      UNION ALL SELECT turn_id, CAST(i AS INT), CASE WHEN i = 2 THEN {DASHED.format('m1')} ELSE 'short' END, 'Tool ' || (k + i), 'House', CAST(k + i AS DOUBLE), TRUE, 'lips',
        '#' || lpad(CAST(k + i AS VARCHAR), 6, '0'), i / 2.0, 'img/' || k FROM (SELECT *, unnest(range(0, 4)) AS i FROM said WHERE event_type = 'purchase')
      UNION ALL SELECT turn_id, pos, '', name, brand, price, FALSE, 'beauty', '#f0f0f0', 5, '' FROM (
        SELECT turn_id, 0 AS pos, 'Velvet Pro Lipstick ' || k AS name, 'Velvet Pro' AS brand, k + 0.25 AS price FROM said WHERE event_type = 'click' AND k % 2 = 0
        UNION ALL SELECT turn_id, 1, 'Mac Blush', 'Mac', 9.0 FROM said WHERE event_type = 'click' AND k % 2 = 0
        UNION ALL SELECT turn_id, 0, 'Clean Beauty ' || k, 'Clean Beauty', 0.0 FROM said WHERE event_type = 'error' AND k % 2 = 0
        UNION ALL SELECT turn_id, 0, 'Glow ' || k, 'Glow ' || k, 0.0 FROM said WHERE event_type = 'signup' AND k % 2 = 0
        UNION ALL SELECT turn_id, 1, 'Ultra Kit', 'Ultra Kit', 0.0 FROM said WHERE event_type = 'signup' AND k % 2 = 0)""",
)
def _(d):
    return G.ground_mentions(*spoken(d))


ITEM = """'{"name":"' || event_type || '","PRODUCT_ID":"p' || k || '","PRICE":' || k || ',"color_hex":"","COLOR_HEX":"#' || k || '"}'"""
PLAIN = """'{"NAME":"N' || k || '","price":0,"CURRENT_PRICE":' || user_id || ',"brand":"b"}'"""
SHAPES = f"""CASE event_type WHEN 'view' THEN '[' || {ITEM} || ',{{"x":1}},' || {PLAIN} || ']'
    WHEN 'click' THEN '{{"result":' || {{quote}}('[' || {ITEM} || ']') || '}}'
    WHEN 'error' THEN '[{{"json":{{"rows":[' || {PLAIN} || ',' || {ITEM} || ']}},"type":"json"}}]'
    WHEN 'signup' THEN {{quote}}('{{"data":[' || {PLAIN} || ']}}')
    ELSE '{{"rows":"odd","name":"self' || k || '"}}' END"""


@query(
    "normalize_product_json",
    """WITH e AS (SELECT event_id AS key, event_type, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
       item AS (SELECT key, event_type, 'p' || k AS product_id, event_type AS name, '' AS brand, '' AS category, '#' || k AS swatch_hex, CAST(5 AS DOUBLE) AS color_distance, CAST(k AS DOUBLE) AS price, '' AS image_url FROM e),
       plain AS (SELECT key, event_type, '' AS product_id, 'N' || k AS name, 'b' AS brand, '' AS category, '#f0f0f0' AS swatch_hex, CAST(5 AS DOUBLE) AS color_distance, CAST(user_id AS DOUBLE) AS price, '' AS image_url FROM e)
       SELECT * EXCLUDE (event_type) FROM (
         SELECT CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS pos, * FROM item WHERE event_type IN ('view', 'click', 'error')
         UNION ALL SELECT CASE event_type WHEN 'view' THEN 2 ELSE 0 END, * FROM plain WHERE event_type IN ('view', 'error', 'signup')
         UNION ALL SELECT 0, key, event_type, '', 'self' || k, '', '', '#f0f0f0', 5.0, 0.0, '' FROM e WHERE event_type = 'purchase')""",
)
def _(d):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    rows = d.events.select(F.col("event_id").alias("key"), "event_type", "user_id", k)
    text = SHAPES.replace("{quote}", "quoted").replace("quoted('", "concat('\"', replace('").replace("']')", "']', '\"', '\\\\\"'), '\"')").replace("']}')", "']}', '\"', '\\\\\"'), '\"')")
    return R.normalize_products(rows.select("key", F.expr(text).alias("content")))


def tool_turns(d):
    """Each user's events as one turn of tool calls, whose names tell what they return; errors bring a table."""
    k, ident = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    item = F.concat(F.lit('{"name":"N'), ident, F.lit('","price":'), k, F.lit("}"))
    content = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"matches":[{"customer_id":"c'), ident, F.lit('","first_name":"F","match_confidence":0.3},{"customer_id":"d'), ident, F.lit('","first_name":"G","distance":0.'), k, F.lit("}]}")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"total":'), k, F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"columns":["NAME"],"rows":[["T'), ident, F.lit('"]]}')))
        .otherwise(F.concat(F.lit("["), item, F.lit("]")))
    )
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "MatchProducts", "click", "IdentifyPerson", "purchase", "ACP_Update", "signup", "Weather")]), F.col("event_type"))
    return H.assemble_turns(d.events.select(
        F.col("user_id").alias("turn_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", H.TABLE).otherwise(H.RESULT).alias("event_type"),
        F.to_json(F.struct(name.alias("name"), content.alias("content"))).alias("payload"),
    ))


CALLS = """calls AS (SELECT user_id AS turn_id, event_id, event_type, props->>'$.k' AS k,
    CAST(row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) - 1 AS INT) AS call FROM events)"""


@query(
    "tool_products_by_name",
    f"""WITH {CALLS} SELECT turn_id, CASE event_type WHEN 'view' THEN 'tool' ELSE 'table' END AS source, call, 0 AS pos,
         CASE event_type WHEN 'view' THEN 'N' ELSE 'T' END || event_id AS name, CASE event_type WHEN 'view' THEN CAST(k AS DOUBLE) ELSE 0 END AS price
       FROM calls WHERE event_type IN ('view', 'error')""",
)
def _(d):
    return R.products_of_turns(tool_turns(d)).select("turn_id", "source", "call", "pos", "name", "price")


@query(
    "tool_customer_by_name",
    f"""WITH {CALLS} SELECT turn_id, 'd' || event_id AS customer_id, 'G' AS first_name, round(1 - CAST('0.' || k AS DOUBLE), 6) AS confidence
       FROM calls WHERE event_type = 'click' AND 1 - CAST('0.' || k AS DOUBLE) > 0.45
       QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY call DESC) = 1""",
)
def _(d):
    found = R.customer_of_turns(tool_turns(d))
    return found.select("turn_id", "customer_id", "first_name", F.round("confidence", 6).alias("confidence"))


@query(
    "tool_cart_by_name",
    f"""WITH {CALLS} SELECT turn_id, '{{"total":' || k || '}}' AS cart_update FROM calls WHERE event_type = 'purchase'
       QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY call DESC) = 1""",
)
def _(d):
    return R.cart_of_turns(tool_turns(d))


@query(
    "normalize_table_json",
    """WITH e AS (SELECT event_id AS key, event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
       SELECT key, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS pos, 'p' || k AS product_id, 'N' || k AS name, '' AS brand, '' AS category, '#f0f0f0' AS swatch_hex,
         CAST(5 AS DOUBLE) AS color_distance, CAST(CASE event_type WHEN 'purchase' THEN 0 ELSE k END AS DOUBLE) AS price, '' AS image_url
       FROM e WHERE event_type IN ('view', 'click', 'purchase')""",
)
def _(d):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    rows = d.events.select(F.col("event_id").alias("key"), "event_type", k)
    columns = '"columns":[{"name":"PRODUCT_ID"},{"name":"NAME"},"price"]'
    text = f"""CASE event_type WHEN 'view' THEN '{{{columns},"rows":[["p' || k || '","N' || k || '",' || k || ']]}}'
        WHEN 'click' THEN '{{{columns},"data":[["too short"],{{"product_id":"p' || k || '","name":"N' || k || '","PRICE":' || k || '}}]}}'
        WHEN 'error' THEN '{{"columns":["colour"],"rows":[["N"]]}}'
        WHEN 'purchase' THEN '[{{"NAME":"N' || k || '","product_id":"p' || k || '"}}]' ELSE 'oops' END"""
    return R.normalize_tables(rows.select("key", F.expr(text).alias("content")))


@query(
    "pick_confident_match",
    """WITH e AS (SELECT event_id AS key, event_type, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
       SELECT key, CASE WHEN 1 - k / 100.0 > 0.45 THEN 'c' || k ELSE 'd' || user_id END AS customer_id, CASE WHEN 1 - k / 100.0 > 0.45 THEN 'Ann' ELSE 'Bo' END AS first_name,
         '' AS last_name, '' AS email, CASE WHEN 1 - k / 100.0 > 0.45 THEN 'Gold' ELSE 'Member' END AS loyalty_tier, CAST(0 AS DOUBLE) AS points_balance,
         round(CASE WHEN 1 - k / 100.0 > 0.45 THEN 1 - k / 100.0 ELSE 0.5 END, 4) AS confidence
       FROM e WHERE event_type IN ('view', 'click', 'purchase') AND (event_type <> 'purchase' OR 1 - k / 100.0 > 0.45 OR TRUE)""",
)
def _(d):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    rows = d.events.select(F.col("event_id").alias("key"), "event_type", "user_id", k)
    people = (
        """'[{"first_name":"no id"},{"customer_id":"c' || k || '","FIRST_NAME":"Ann","distance":' || (k / 100.0D) || ',"loyalty_tier":"Gold"},"""
        """{"CUSTOMER_ID":"d' || user_id || '","first_name":"Bo"}]'"""
    )
    text = f"""CASE event_type WHEN 'view' THEN {people} WHEN 'click' THEN '{{"success":true,"matches":' || {people} || '}}'
        WHEN 'error' THEN '{{"error":{{}}}}' WHEN 'signup' THEN 'not json' ELSE '[{{"json":{{"data":' || {people} || '}},"type":"json"}}]' END"""
    r = R.pick_match(rows.select("key", F.expr(text).alias("content")))
    return r.withColumn("confidence", F.round("confidence", 4))


@query(
    "masked_profile",
    """SELECT customer_id, first_name, k % 2 = 0 AS verified, CASE WHEN k % 2 = 0 THEN loyalty_tier END AS loyalty_tier, CASE WHEN k % 2 = 0 THEN points_balance END AS points_balance
       FROM (SELECT *, customer_id AS k FROM customers)""",
    "customers",
)
def _(d):
    claims = d.customers.select("customer_id", F.when(F.col("customer_id") % 2 == 0, F.upper("email")).otherwise("nobody@example.com").alias("claimed_email"))
    return H.masked_profile(d.customers, claims)


@query(
    "text_expressions",
    """SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n_words, lang || ' ' || source || ' ' AS joined,
         length(replace(replace(text, chr(34), ''), chr(39), '')) AS bare_length FROM documents""",
)
def _(d):
    return d.documents.select(
        "doc_id", F.size(words(F.col("text"))).alias("n_words"),
        joined_blank(F.col("lang"), F.col("source"), F.lit(None).cast("string")).alias("joined"),
        F.length(without_quotes(F.col("text"))).cast("long").alias("bare_length"),
    )
