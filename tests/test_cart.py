import random

import pytest
from pyspark.sql import functions as F

from merchlens.operators import cart as C
from tests.conftest import answers

LOG = "seq long, ts timestamp_ntz, session_id long, customer_id long, command string, item_ref long, product_id long, variant_id long, quantity long"


def log_of(rows, *commands):
    """(command, session, item, product, quantity) in order."""
    import datetime

    base = datetime.datetime(2024, 1, 1)
    return rows(
        LOG,
        *[(i, base + datetime.timedelta(minutes=i), s, s + 100, c, item, product, None, q) for i, (c, s, item, product, q) in enumerate(commands)],
    )


@pytest.fixture
def products(rows):
    return rows("product_id long, name string, current_price double", (1, "Lip", 9.99), (2, "Eye", 20.0), (3, "Free", None))


def test_newest_open_line_is_changed(rows, products):
    log = log_of(
        rows,
        ("create", 1, None, None, None), ("add", 1, 7, 1, 1), ("add", 1, 7, 2, 1), ("update", 1, 7, None, 5),
        ("remove", 1, 7, None, None), ("update", 1, 7, None, 3), ("remove", 1, 7, None, None), ("remove", 1, 7, None, None),
        ("add", 1, 7, 2, 4), ("update", 1, 8, None, 1), ("add", 1, 9, 3, 1), ("add", 1, 9, 99, 1),
    )
    assert answers(C.fold_items(log, products), "product_id", "quantity", "unit_price_cents", "subtotal_cents", "add_seq") == [(2, 4, 2000, 8000, 8)]
    assert answers(C.not_found(log, products), "seq", "command") == [(7, "remove"), (9, "update")]
    assert answers(C.rejected_adds(log, products), "seq", "error") == [
        (10, "Product not found with ID: 3"), (11, "Product not found with ID: 99"),
    ]


def test_price_is_taken_when_added_and_repeat_updates_keep_it(rows, products):
    log = log_of(rows, ("add", 1, 1, 1, 2), ("update", 1, 1, None, 3), ("update", 1, 1, None, 7))
    assert answers(C.fold_items(log, products), "quantity", "subtotal_cents") == [(7, 6993)]


def test_empty_cart_stays_visible(rows, products):
    log = log_of(rows, ("create", 1, None, None, None), ("add", 1, 1, 1, 1), ("remove", 1, 1, None, None), ("create", 2, None, None, None))
    items = C.fold_items(log, products)
    sessions = C.fold_sessions(log, items)
    assert answers(sessions, "session_id", "status", "subtotal_cents", "currency") == [(1, "active", 0, "USD"), (2, "active", 0, "USD")]
    assert answers(C.cart_snapshot(sessions, items), "session_id", "item_count", "item_id") == [(1, 0, None), (2, 0, None)]
    assert answers(C.cart_pages(sessions, items), "session_id", "page", F.size("items")) == [(1, 0, 0), (2, 0, 0)]
    assert answers(C.cart_documents(sessions, items), "session_id", F.size("items"), "item_count") == [(1, 0, 0), (2, 0, 0)]


def test_checkout_copies_the_cart_of_that_moment(rows, products):
    log = log_of(
        rows,
        ("checkout", 1, None, None, None), ("add", 1, 1, 1, 1), ("add", 1, 2, 2, 1), ("checkout", 1, None, None, None),
        ("update", 1, 1, None, 3), ("remove", 1, 2, None, None), ("checkout", 1, None, None, None),
    )
    orders, order_items = C.checkout(log, products)
    assert answers(orders, "order_ordinal", "item_count", "total_cents", "total_dollars", "status") == [
        (1, 0, 0, 0.0, "confirmed"), (2, 2, 2999, 29.99, "confirmed"), (3, 1, 2997, 29.97, "confirmed"),
    ]
    assert answers(order_items, "order_ordinal", "product_id", "quantity") == [(2, 1, 1), (2, 2, 1), (3, 1, 3)]
    number = orders.orderBy("order_ordinal").first().order_number
    assert number.startswith("ORD-20240101-") and len(number) == 19
    assert orders.join(order_items, "order_id", "left_semi").count() == 2


def replay(commands):
    """The procedures one by one: open lines and orders."""
    prices, lines, orders = {1: 999, 2: 2000}, [], []
    for seq, (c, s, item, product, q) in enumerate(commands):
        mine = [x for x in lines if x["s"] == s and x["item"] == item]
        if c == "add" and product in prices:
            lines.append({"seq": seq, "s": s, "item": item, "q": q, "price": prices[product]})
        elif c == "update" and mine:
            mine[-1]["q"] = q
        elif c == "remove" and mine:
            lines.remove(mine[-1])
        elif c == "checkout":
            cart = [x for x in lines if x["s"] == s]
            orders.append((s, seq, len(cart), sum(x["q"] * x["price"] for x in cart)))
    return lines, orders


@pytest.mark.parametrize("chunk", [1, 17, 10_000])
def test_fold_equals_replay_with_a_hot_session(rows, products, chunk):
    rng = random.Random(11)
    commands = []
    for _ in range(600):
        session = 1 if rng.random() < 0.5 else rng.randrange(2, 6)
        c = rng.choices(["add", "update", "remove", "checkout", "create"], [5, 4, 4, 1, 1])[0]
        commands.append((c, session, rng.randrange(3), rng.choice([1, 2, 99]) if c == "add" else None, rng.randrange(1, 9)))
    lines, orders = replay(commands)
    log = log_of(rows, *commands)
    items = C.fold_items(log, products, chunk)
    assert answers(items, "add_seq", "session_id", "quantity", "subtotal_cents") == sorted(
        ((x["seq"], x["s"], x["q"], x["q"] * x["price"]) for x in lines), key=repr
    )
    got, _ = C.checkout(log, products, chunk, tile_orders={1: 1, 17: 3}.get(chunk, 1024))
    numbered, count = [], {}
    for s, _, n, cents in orders:
        count[s] = count.get(s, 0) + 1
        numbered.append((s, count[s], n, cents))
    assert answers(got, "session_id", "order_ordinal", "item_count", "total_cents") == sorted(numbered, key=repr)
    totals = {r.session_id: r.subtotal_cents for r in C.cart_totals(items).collect()}
    sessions = C.fold_sessions(log, items).collect()
    assert all(r.total_cents == totals.get(r.session_id, 0) for r in sessions)


def test_documents_split_a_large_cart(rows, products):
    log = log_of(rows, *[("add", 1, i, 1, 1) for i in range(25)], ("add", 2, 1, 2, 1))
    items = C.fold_items(log, products)
    whole = C.cart_documents(C.fold_sessions(log, items), items).filter("session_id = 1").first()
    assert [x.add_seq for x in whole["items"]] == list(range(25)) and whole.item_count == 25
    docs = C.cart_pages(C.fold_sessions(log, items), items, page_rows=10, chunk_rows=7)
    assert answers(docs, "session_id", "page", F.size("items"), "item_count") == [(1, 0, 10, 25), (1, 1, 10, 25), (1, 2, 5, 25), (2, 0, 1, 1)]
    firsts = [x.add_seq for r in docs.filter("session_id = 1").orderBy("page").collect() for x in r["items"]]
    assert firsts == list(range(25))
