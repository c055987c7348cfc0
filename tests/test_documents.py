"""Labels, loose JSON, mentions, transcripts, derived columns, prices."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from merchlens.operators import derive, embeddings as E, labels as L, mentions as G, pricing as P, quick_match as Q, tool_results as R, transcripts as H
from merchlens.operators.ledger import ledger_check
from merchlens.operators.trending import trending
from tests.conftest import answers

FULL = 'Sure!\n{"brand":"Ana","product_name":"Stick","net_weight":"3 g","spf":null,"warnings":["a","b"],"directions":[],"inactive_ingredients":["x",null,"z"]}\nDone'


def test_label_columns(rows):
    raw = rows("file_path string, raw_result string", ("l/S1_a.png", FULL), ("S2_b.jpeg", "{broken"), ("S3.png", None), ("S4.png", FULL + " } trailing"))
    got = {r.sku: r for r in L.parse_labels(raw).collect()}
    assert (got["S1"].brand, got["S1"].spf, got["S1"].warnings, got["S1"].directions, got["S1"].other_information) == ("Ana", None, "a | b", "", None)
    assert got["S1"].inactive_ingredients == "x |  | z"
    assert all(got[s].raw_json is None and got[s].brand is None for s in ("S2", "S3", "S4"))
    text = {r.sku: r.search_content for r in L.label_search_text(L.parse_labels(raw)).collect()}
    assert text["S1"] == "Ana Stick a | b   x |  | z" and text["S2"] == " " * 5


def test_label_report(rows):
    report = L.flatten_label(L.parse_labels(rows("file_path string, raw_result string", ("S1.png", FULL))))
    got = {(r.sort, r.value) for r in report.collect()}
    assert {(1, "Ana"), (4, "N/A"), (6, "(2 items)"), (10, "a"), (11, "b"), (51, "(0 items)"), (81, None), (101, "(3 items)"), (110, "x"), (112, "z")} <= got
    assert not any(s in (60, 90, 111) for s, _ in got)


def test_extract_labels_with_a_model(rows):
    files = rows("file_path string, content binary", ("A_1.png", b"ok"), ("B_1.png", b"no"))
    got = L.extract_labels(files, lambda b: FULL if bytes(b) == b"ok" else 1 / 0)
    assert answers(got, "sku", "brand") == [("A", "Ana"), ("B", None)]


def test_product_json_shapes(rows):
    item = '{"name":"N","PRODUCT_ID":"p","price":0,"CURRENT_PRICE":3}'
    shapes = {
        "list": f'[{item},{{"x":1}},"text"]', "result text": '{"result":"[{\\"NAME\\":\\"N\\"}]"}', "result object": '{"result":"{\\"NAME\\":\\"N\\"}"}',
        "result list": f'{{"result":[{item}]}}', "rows": f'{{"rows":[],"data":[{item}]}}', "self": '{"rows":"x","name":"N"}', "none": '{"name":"N"}',
        "envelope": f'[{{"json":[{item}],"type":"json"}}]', "silent": '[{"json":{"error":{}},"type":"json"}]', "bad": "oops", "quoted": '"[{\\"name\\":\\"N\\"}]"',
    }
    got = R.normalize_products(rows("key string, content string", *shapes.items()))
    assert answers(got, "key", "name") == sorted([(k, "N") for k in shapes if k not in ("none", "silent", "bad")], key=repr)
    first = got.filter("key = 'list'").first()
    assert (first.product_id, first.price, first.swatch_hex, first.color_distance, first.brand) == ("p", 3.0, "#f0f0f0", 5.0, "")


def test_pick_match(rows):
    people = '[{"first_name":"x"},{"customer_id":"a","first_name":"A","distance":0.9},{"CUSTOMER_ID":"b","FIRST_NAME":"B","distance":0}]'
    data = rows("key string, content string", ("plain", people), ("error", '{"error":{}}'), ("matches", f'{{"matches":{people}}}'), ("stated", '[{"customer_id":"c","first_name":"C","match_confidence":0.5}]'), ("low", '[{"customer_id":"c","first_name":"C","match_confidence":0.45}]'))
    assert answers(R.pick_match(data), "key", "customer_id", "confidence") == [("matches", "b", 1.0), ("plain", "b", 1.0), ("stated", "c", 0.5)]
    assert answers(R.pick_match(data, compat=True).filter("key = 'plain'"), "confidence") == [(0.5,)]


def test_mentions(rows):
    a, b = "026912b9-b508-421e-b807-7d265158b96a", "add5e831-d751-4f46-9deb-16125149ddab"
    turns = rows(
        "turn_id long, text string, product_tool_used boolean",
        (1, f"**One Two** (ID: {a.upper()}) - $11.67, **Three** (ID: {b})", True), (2, "no names", True),
        (3, "**Big Foundation X** - $9.5", True), (4, "**Big Foundation X** - $9.5", False), (5, "• **Glow Kit** and - **Short**", True),
    )
    tools = rows("turn_id long, pos int, product_id string, name string, brand string, price double", (1, 0, a, "Full", "F", 1.0), *[(2, i, "x", f"t{i}", "b", 0.0) for i in range(6)])
    assert answers(G.ground_mentions(turns, tools), "turn_id", "pos", "product_id", "name", "brand", "price", "grounded") == sorted(
        [(1, 0, a, "Full", "F", 1.0, True), (1, 1, b, "Three", "Three", 0.0, False), *[(2, i, "x", f"t{i}", "b", 0.0, True) for i in range(4)],
         (3, 0, "", "Big Foundation X", "Big Foundation", 9.5, False), (5, 0, "", "Glow Kit", "Glow Kit", 0.0, False)], key=repr,
    )


def test_assembling_events(rows):
    events = rows(
        "turn_id string, seq long, event_type string, payload string",
        ("a", 2, "response.text.delta", '{"delta":{"text":"lo"}}'), ("a", 1, "response.text.delta", '{"text":"Hel"}'), ("a", 3, None, '{"type":"response.tool_use","name":"T"}'),
        ("a", 4, "metadata", '{"thread_id":1,"message_id":2}'), ("a", 5, "metadata", '{"thread_id":1,"message_id":9}'), ("a", 6, "response.text.delta", "[DONE"),
        ("b", 1, "response.text.delta", '{"text":"x"}'), ("b", 2, "error", '{"message":"first"}'), ("b", 3, "error", "{}"),
    )
    got = {r.turn_id: r for r in H.assemble_turns(events).collect()}
    assert (got["a"].text, [tuple(t) for t in got["a"].tools], got["a"].thread_id, got["a"].message_id, got["a"].success, got["a"].thinking) == ("Hello", [(None, None, "T", None)], "1", "9", True, None)
    assert (got["b"].success, got["b"].text, got["b"].error, got["b"].tools) == (False, None, "first", None)


def test_turns_stay_whole_and_keep_tool_records(rows):
    events = rows(
        "turn_id string, seq long, event_type string, payload string",
        ("a", 9998, "response.text.delta", '{"text":"a"}'), ("a", 9999, "response.text.delta", '{"text":"b"}'),
        ("a", 10000, "response.text.delta", '{"text":"c"}'),
        ("a", 10001, "response.tool_use", '{"tool_use_id":"u1","tool_type":"fn","name":"n","input":{"q":1}}'),
        ("a", 10002, "response.tool_result", '{"tool_use_id":"u1","name":"n","status":"ok","content":[{"x":1}]}'),
        ("a", 10003, "response.table", '{"content":{"rows":2}}'),
    )
    (turn,) = H.assemble_turns(events).collect()
    assert turn.text == "abc"
    assert [tuple(t) for t in turn.tools] == [("u1", "fn", "n", '{"q":1}')]
    assert [tuple(t) for t in turn.tool_results] == [("u1", "n", "ok", '[{"x":1}]')] and turn.tables == ['{"rows":2}']


def test_history(rows):
    turns = rows("session_id long, turn int, role string, text string", (1, 0, "user", "hi"), (1, 1, None, "yo"), (1, 2, "user", "  "), (1, 3, "user", "now"), (2, 0, "user", "alone"))
    assert answers(H.history(turns)) == [(1, 3, 0, "user", "hi"), (1, 3, 1, "user", "yo")]


def test_privacy_gate(rows):
    customers = rows("customer_id long, first_name string, email string, loyalty_tier string, points_balance long", (1, "A", "A@x.io", "Gold", 5))
    claims = rows("customer_id long, claimed_email string", (1, "a@X.io"), (1, "b@x.io"), (1, None))
    assert answers(H.masked_profile(customers, claims)) == [(1, "A", False, None, None), (1, "A", False, None, None), (1, "A", True, "Gold", 5)]


def test_skin_types(rows):
    products = rows("product_id long, finish string, skin_type_compatibility array<string>", (1, "matte", None), (2, "satin", []), (3, "semi-matte", ["dry", "sensitive"]), (4, None, None))
    ingredients = rows("product_id long, is_allergen boolean", (1, True), (1, False), (2, True), (3, False))
    loose = answers(derive.derive_skin_types(products, ingredients), "product_id", "skin_type_compatibility")
    assert loose == [(1, ["oily", "combination", "sensitive"]), (2, ["dry", "combination"]), (3, ["dry", "sensitive"]), (4, ["combination"])]
    strict = answers(derive.derive_skin_types(products, ingredients, strict=True), "product_id", "skin_type_compatibility")
    assert strict[0] == (1, ["oily", "combination"])


def test_skin_profile_ignores_points_outside(rows):
    samples = rows("image_id long, region string, x int, y int, w int, h int, r int, g int, b int", (1, "skin", 0, 0, 5, 5, 200, 150, 120), (1, "skin", 5, 0, 5, 5, 0, 0, 0), (1, "skin", 4, 4, 5, 5, 201, 151, 121), (2, "lip", 0, 0, 5, 5, 9, 9, 9))
    only = derive.skin_profile(samples).collect()
    assert [(r.image_id, r.skin_rgb, r.skin_hex, r.lip_hex, r.confidence_score) for r in only] == [(1, [200, 150, 120], "#c89678", None, 0.9)]
    assert (only[0].undertone, only[0].fitzpatrick_type) == ("warm", 3)


def test_quick_match_arguments(rows):
    p = rows("product_id long, name string, brand string, category string, current_price double, is_active boolean, skin_type_compatibility array<string>, undertone_compatibility array<string>", (1, "a", "b", "Face", 5.0, True, ["oily"], ["warm"]), (2, "a", "b", "face", 3.0, True, None, ["warm"]), (3, "a", "b", "face", 1.0, False, ["oily"], ["warm"]))
    assert answers(Q.quick_product_match(p, "", None, "FACE"), "product_id") == [(1,), (2,)]
    assert answers(Q.quick_product_match(p, "OILY"), "product_id") == [(1,)]
    assert answers(Q.products_quick_match_view(p), "product_id", "skin_types") == [(1, "oily"), (2, None)]


def test_embeddings_lifecycle(rows):
    customers = rows("customer_id long, is_active boolean", (1, True), (2, False))
    new = rows("customer_id long, embedding array<double>", (1, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (1, None))
    good, bad = E.register_embeddings(new, customers, dim=2)
    assert [(r.customer_id, r.is_active, r.is_primary) for r in good.collect()] == [(1, True, False)]
    assert answers(bad, "customer_id", "error") == [(1, "Embedding must have 2 numbers")] * 2 + [(2, "Customer not found or inactive"), (3, "Customer not found or inactive")]
    held = rows("embedding_id long, customer_id long, is_active boolean, is_primary boolean, created_at int", (1, 1, True, True, 1), (2, 1, False, False, 2), (3, 2, True, False, 3), (4, 1, True, False, 4))
    updated, counts = E.deactivate(held, rows("customer_id long", (1,), (9,)), by="customer_id")
    assert answers(counts) == [(1, 3), (9, 0)]
    assert answers(updated.filter("is_active"), "embedding_id") == [(3,)]
    assert answers(E.promote_latest(held).filter("is_primary"), "embedding_id") == [(3,), (4,)]


def test_price_asof(rows):
    d = dt.date
    history = rows("product_id long, price double, effective_date date, end_date date", (1, 5.0, d(2024, 1, 1), d(2024, 2, 1)), (1, 7.0, d(2024, 3, 1), None), (2, 1.0, d(2024, 1, 1), None))
    asked = rows("product_id long, at_date date", (1, d(2023, 12, 31)), (1, d(2024, 1, 1)), (1, d(2024, 2, 1)), (1, d(2024, 3, 5)), (1, d(2024, 3, 5)), (3, d(2024, 1, 1)))
    got = answers(P.price_asof(asked, history), "product_id", F.col("at_date").cast("string"), "price")
    assert got == [(1, "2023-12-31", None), (1, "2024-01-01", 5.0), (1, "2024-02-01", None), (1, "2024-03-05", 7.0), (1, "2024-03-05", 7.0), (3, "2024-01-01", None)]


def test_promotions(rows):
    t = dt.datetime
    promos = rows("promotion_id long, promo_code string, is_active boolean, start_date timestamp_ntz, end_date timestamp_ntz, product_ids array<string>, category_ids array<string>, brand_names array<string>",
        (1, "A", True, t(2024, 1, 1), t(2024, 2, 1), ["1"], ["lips"], None), (2, "B", True, t(2024, 1, 1), t(2024, 1, 2), None, ["lips"], None), (3, "C", True, t(2024, 1, 1), t(2024, 2, 1), None, [], None), (4, "D", False, t(2024, 1, 1), t(2024, 2, 1), ["1"], None, None))
    products = rows("product_id long, category string, brand string", (1, "lips", "X"), (2, "face", "X"))
    assert answers(P.active_promotions(promos, products, "2024-01-02 00:00:00")) == [(1, "A", 1), (3, "C", None)]


def test_promotions_pair_once_without_a_shuffle_of_pairs(rows):
    """Promotions told in several rows and kinds, products in several categories: every pair comes once."""
    t = dt.datetime
    when = (True, t(2024, 1, 1), t(2024, 2, 1))
    promos = rows("promotion_id long, promo_code string, is_active boolean, start_date timestamp_ntz, end_date timestamp_ntz, product_ids array<string>, category_ids array<string>, brand_names array<string>",
        (1, "A", *when, ["1", "1"], ["lips"], ["X"]), (1, "A", *when, None, ["face"], None), (2, "B", *when, None, ["lips", "face", None], None), (None, None, *when, None, None, ["X", "Y"]), (4, "D", *when, ["lips"], None, None))
    products = rows("product_id long, category string, brand string", (1, "lips", "X"), (1, "face", "X"), (2, "face", None), (2, "face", None), (None, "lips", "Y"))
    got = P.active_promotions(promos, products, "2024-01-02 00:00:00")
    pairs = got.collect()
    assert sorted(pairs, key=str) == sorted([(1, "A", 1), (1, "A", 2), (1, "A", None), (2, "B", 1), (2, "B", 2), (2, "B", None), (None, None, 1), (None, None, None)], key=str)
    # The pairs of promotions and products that can meet one way only are not made distinct.
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("Union")
    assert "Aggregate [promotion_id" not in plan[1].split("Join")[0]


def test_shipping(rows):
    options = rows("option_id string, fulfillment_type string, price_cents long, free_threshold_cents long, is_available boolean",
        ("std", "shipping", 500, 5000, True), ("exp", "shipping", 999, 0, True), ("eco", "shipping", 300, None, True), ("off", "shipping", 0, None, False), ("pick", "pickup", 0, 0, True))
    got = P.choose_shipping(rows("session_id long, subtotal_cents long", (1, 4999), (2, 5000)), options)
    assert answers(got) == [(1, "pickup", "pick", 0), (1, "shipping", "eco", 300), (2, "pickup", "pick", 0), (2, "shipping", "std", 0)]


def test_trending_counts_every_window_once(rows):
    t = dt.datetime
    mentions = rows("product_id long, posted_at timestamp_ntz, sentiment_score double", (1, t(2024, 1, 1, 0, 30), 0.5), (1, t(2024, 1, 1, 1, 10), None), (2, t(2024, 1, 1, 1, 59), -0.5))
    got = trending(mentions, hours=2, slide_hours=1, k=1).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.product_id, r.mention_count, r.trend_score) for r in got] == [(23, 1, 1, 0.75), (0, 1, 2, 1.5), (1, 1, 1, 0.5)]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_ledger(rows, chunk):
    ledger = rows("seq long, stock_id long, quantity long, quantity_before long, quantity_after long", (1, 1, 5, 0, 5), (2, 2, 1, 0, 2), (3, 1, -2, 5, 3), (4, 1, 1, 4, 5))
    assert answers(ledger_check(ledger, chunk)) == [(1, 3, 4, 0, 1, 5), (2, 1, 1, 1, 0, 2)]


def test_tools_are_chosen_by_name(spark):
    rows = [
        (1, 1, "response.tool_result", '{"name":"ANALYST","content":[{"name":"A"}]}'),
        (1, 2, "response.tool_result", '{"name":"weather","content":[{"name":"not a product"}]}'),
        (1, 3, "response.tool_result", '{"content":[{"name":"no tool"}]}'),
        (1, 4, "response.table", '{"content":{"columns":["brand","name"],"rows":[["b","B"]]}}'),
        (1, 5, "response.tool_result", '{"name":"Identify","content":{"matches":[{"customer_id":"c","first_name":"F","distance":0.1}]}}'),
        (1, 6, "response.tool_result", '{"name":"get_customer","content":{"matches":[{"customer_id":"d","first_name":"G","match_confidence":0.9}]}}'),
        (1, 7, "response.tool_result", '{"name":"customer","content":{"matches":[{"customer_id":"e","first_name":"H","match_confidence":0.2}]}}'),
        (1, 8, "response.tool_result", '{"name":"add_to_cart","content":{"n":1}}'),
        (1, 9, "response.tool_result", '{"name":"acp_update","content":{"n":2}}'),
        (1, 10, "response.tool_result", '{"name":"cart","content":"not json"}'),
        (2, 1, "response.tool_result", '{"name":"search","content":[{"name":"lost"}]}'),
        (2, 2, "error", '{"message":"broken"}'),
        (3, 1, "response.text.delta", '{"text":"no tools"}'),
    ]
    turns = H.assemble_turns(spark.createDataFrame(rows, "turn_id int, seq int, event_type string, payload string"))
    assert answers(R.products_of_turns(turns).select("turn_id", "source", "call", "pos", "name")) == [(1, "table", 0, 0, "B"), (1, "tool", 0, 0, "A")]
    assert answers(R.customer_of_turns(turns).select("turn_id", "customer_id", "confidence")) == [(1, "d", 0.9)]
    assert answers(R.cart_of_turns(turns)) == [(1, '{"n":2}')]
