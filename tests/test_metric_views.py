import warnings

import pytest
from pyspark.sql import functions as F

from merchlens.plans import dashboards, executive, metric_views as M
from tests.conftest import answers


@pytest.fixture
def products(rows):
    return rows(
        "product_id long, name string, brand string, category string, current_price double, cost double",
        (1, "a", "X", "lips", 10.0, 1.0), (2, "b", "X", "face", 20.0, 30.0), (3, "c", "Y", "face", 30.0, 2.0),
    )


@pytest.fixture
def social(rows, products):
    reviews = rows("review_id long, product_id long, rating long, created_at timestamp_ntz", (1, 1, 5, None), (2, 1, 3, None), (3, 2, 4, None), (4, 99, 1, None))
    mentions = rows("mention_id long, product_id long, likes long, comments long, shares long", (1, 1, 1, 1, 1), (2, 1, 5, None, 5), (3, 3, 2, 2, 2))
    influencers = rows("mention_id long, product_id long", (1, 1), (2, 1), (3, 1))
    trends = rows("trend_id long, product_id long, is_viral boolean", (1, 1, True), (2, 1, True), (3, 2, False))
    return M.social_view(reviews, mentions, influencers, trends, products)


def test_children_do_not_multiply(social):
    got = social.query(["review_count", "mention_count", "influencer_mention_count", "total_engagement", "avg_rating"], ["product.category"])
    assert answers(got) == [("face", 1, 1, None, 6, 4.0), ("lips", 2, 2, 3, 3, 4.0), (None, 1, None, None, None, 1.0)]


def test_slices_add_up_and_distinct_is_recounted(social):
    whole = social.query(["total_engagement", "viral_product_count"]).first()
    assert (whole.total_engagement, whole.viral_product_count) == (9, 1)
    parts = social.query(["total_engagement"], ["product.brand"]).collect()
    assert sum(p.total_engagement or 0 for p in parts) == 9


def test_repeated_ids_count_once(rows, products):
    reviews = rows(
        "review_id long, product_id long, rating long", (1, 1, 5), (1, 1, 5), (2, 1, 3), (3, 2, 1), (3, 3, 1), (4, 1, 2), (4, 2, 2), (None, 3, 4), (5, None, 1),
    )
    none = rows("mention_id long, product_id long, likes long, comments long, shares long, is_viral boolean")
    view = M.social_view(reviews, none, none, none, products)
    assert view.query(["review_count"]).first()[0] == 5
    assert answers(view.query(["review_count"], ["product.category"])) == [("face", 2), ("lips", 3), (None, 1)]
    assert answers(view.query(["review_count"], ["product.name"])) == [("a", 3), ("b", 2), ("c", 1), (None, 1)]
    assert view.query(["review_count"], where={"product.category": lambda c: c == "face"}).first()[0] == 2
    assert answers(view.query(["review_count"], ["product.name"], {"product.name": lambda c: c == "none"})) == []
    blank = M.social_view(reviews.filter("review_id is null"), none, none, none, products)
    assert answers(blank.query(["review_count"], ["product.category"])) == [("face", 0)]


def test_filters_and_limits(social):
    got = social.query(["average stars"], ["product.brand"], {"product.category": lambda c: c == "lips"})
    assert answers(got) == [("X", 4.0)]
    top = social.query(["review_count"], ["product.name"], order=[F.col("review_count").desc(), "name"], limit=1)
    assert answers(top) == [("a", 2)]


def test_unrelated_tables_are_refused(rows, products):
    promos = rows("promotion_id long, is_active boolean", (1, True))
    variants = rows("variant_id long, product_id long", (1, 1))
    prices = rows("history_id long, product_id long", (1, 1))
    view = M.product_view(products, variants, prices, promos)
    with pytest.raises(ValueError, match="cannot be reached"):
        view.query(["active_promos"], ["product.brand"])
    with pytest.raises(ValueError, match="cannot be reached"):
        view.query(["avg_price"], ["variant.variant_id"])
    with pytest.raises(KeyError):
        view.query(["profit"])
    with pytest.raises(KeyError):
        view.query(["product.brand"])


def test_synonym_that_hides_a_column_warns(rows, products):
    view = M.product_view(products, rows("variant_id long, product_id long"), rows("history_id long"), rows("promotion_id long"))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert view.resolve("Cost") == "product.current_price"
    assert any("product.cost" in str(w.message) for w in seen)
    assert view.resolve("Most Expensive") == "max_price"


def test_two_steps_up(rows, products):
    sessions = rows("session_id long, customer_id long, status string, total_cents long", (1, 7, "completed", 100), (2, 7, "active", 300))
    items = rows("session_id long, product_id long, quantity long", (1, 1, 2), (2, 2, 3))
    orders = rows("order_id long, session_id long, total_cents long", (1, 1, 100), (2, 1, 50))
    order_items = rows("order_id long, product_id long", (1, 1))
    view = M.cart_view(sessions, items, orders, order_items, rows("option_id long"), products)
    assert answers(executive.orders_by_customer(view)) == [(7, 2, 1.5)]
    both = view.query(["aov", "total_items", "sales"], ["session.customer_id"])
    assert answers(both) == [(7, 2.0, 5, 1.5)]


def test_compare_periods(rows, products):
    import datetime as dt

    orders = rows(
        "order_id long, session_id long, status string, total_cents long, created_at timestamp_ntz",
        (1, 1, "a", 100, dt.datetime(2024, 3, 31)), (2, 1, "a", 200, dt.datetime(2024, 2, 15)), (3, 1, "b", 400, dt.datetime(2024, 3, 2)), (4, 1, "b", 800, dt.datetime(2020, 1, 1)),
    )
    sessions = rows("session_id long, total_cents long, status string", (1, 1, "x"))
    view = M.cart_view(sessions, rows("session_id long, product_id long"), orders, rows("order_id long"), rows("option_id long"), products)
    got = view.compare("revenue", "order_tbl.created_at", "2024-03-31 00:00:00", ["order_tbl.status"])
    assert answers(got) == [("a", 1.0, 2.0, -1.0, -0.5), ("b", 4.0, None, 4.0, None)]


def test_low_stock_means_two_things(rows, products):
    stock = rows("stock_id long, product_id long, location_id long, quantity_on_hand long, quantity_reserved long, reorder_point long", (1, 1, 1, 10, 0, 10), (2, 1, 1, 9, 0, 10))
    places = rows("location_id long, name string, city string", (1, "n", "c"))
    assert dashboards.inventory(stock).first().low_stock_count == 1
    view = M.inventory_view(places, stock, products)
    assert view.query(["low_stock_count"]).first()[0] == 2


def test_groups_as_fine_as_references_are_spread_by_their_number(rows, products, monkeypatch):
    kind = "stock_id long, product_id long, location_id long, quantity_on_hand long, quantity_reserved long, reorder_point long"
    stock = rows(kind, *[(i, i % 4, i % 3, i + 2, 1, 0) for i in range(24)], (24, 1, None, 5, 1, 0), (25, None, 1, 5, None, 0), (26, 3, 1, 2, 9, 0), (27, 3, 1, 1, 9, 0))
    places = rows("location_id long, name string, city string", (1, "n", "c"), (1, "m", "c"), (2, "n", "d"))
    view = M.inventory_view(places, stock, products)
    monkeypatch.setattr(M, "TASK_ROWS", 4)
    got = executive.stock_by_location(view)
    assert got.rdd.getNumPartitions() == 7
    name = {1: "a", 2: "b", 3: "c"}
    want = []
    for p in range(4):
        for loc in range(3):
            held = sum(i + 1 for i in range(24) if (i % 4, i % 3) == (p, loc)) - (15 if (p, loc) == (3, 1) else 0)
            want.append((p, loc, name.get(p), {1: "c", 2: "d"}.get(loc), held * (2 if loc == 1 else 1)))
    want.append((1, None, "a", None, 4))
    assert answers(got) == sorted([w for w in want if w[4] > 0], key=repr)


def test_top_rated_needs_enough_reviews(rows, products):
    reviews = rows("review_id long, product_id long, rating long", *[(i, 1, 5) for i in range(4)], *[(10 + i, 2, 4) for i in range(5)])
    assert answers(dashboards.top_rated(reviews, products)) == [("b", "X", 4.0, 5)]


def test_revenue_of_no_orders_is_zero(rows):
    got = dashboards.revenue(rows("order_id long, total_cents long")).first()
    assert (got.total_revenue, got.total_orders, got.avg_order_value) == (0.0, 0, None)
