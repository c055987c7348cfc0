"""Stateful streams equal their batch forms, over several batches and a restart."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from merchlens.operators.cart import checkout, fold_items, fold_sessions
from merchlens.operators.transcripts import assemble_turns
from merchlens.session import scratch_path
from merchlens.sources import bookkeeping
from merchlens.streaming import carts, folds, responses, snapshots
from tests.conftest import answers

class Handle:
    """Keeps states in memory, and counts what would be round trips."""

    calls = 0

    def getMapState(self, name, key, value):  # noqa: N802
        held = {}

        def call(fn):
            def counted(*args):
                self.calls += 1
                return fn(*args)

            return counted

        made = type("State", (), {})()
        made.containsKey, made.getValue, made.updateValue = call(held.__contains__), call(held.get), call(held.__setitem__)
        return made

    def getValueState(self, name, value):  # noqa: N802
        made, state = self.getMapState(name, None, value), type("State", (), {})()
        state.exists, state.get, state.update = lambda: made.containsKey(0), lambda: made.getValue(0), lambda v: made.updateValue(0, v)
        return state

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1

    deleteTimer = registerTimer  # noqa: N815


def processor(kind, *args):
    made = kind(*args)
    made.init(Handle())
    return made, lambda part: list(made.handleInputRows((0,), iter([part]), None))


LOG = "seq long, ts timestamp_ntz, session_id long, customer_id long, command string, item_ref long, product_id long, variant_id long, quantity long"


def some_log(rows, n=120):
    base, kinds = dt.datetime(2024, 1, 1), ["create", "add", "update", "add", "remove", "update", "checkout", "add", "remove", "remove"]
    product = {"add": lambda i: [1, 2, 99][i % 3]}
    return rows(
        LOG,
        *[
            (i, base + dt.timedelta(minutes=i, microseconds=i), i * 7 % 5, 40 + i % 5, k := kinds[i * 3 % 10 if i % 2 else i % 10], i % 2, product.get(k, lambda _: None)(i),
             7 if i % 4 else None, i % 9)
            for i in range(n)
        ],
    )


def feed(spark, df, part, folder):
    df.filter(F.floor(F.col("seq") / 30) == part).coalesce(1).write.mode("append").parquet(folder)


def run_carts(spark, folder, schema, sink, checkpoint, keep_ms=None):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = carts.stream_carts(source, sink, checkpoint, keep_ms)
    stream.awaitTermination()
    assert stream.exception() is None


def test_carts_equal_the_batch_fold_after_restarts(spark, rows):
    log, products = some_log(rows), rows("product_id long, name string, current_price double", (1, "Lip", 9.99), (2, "Eye", 0.5))
    commands = carts.all_commands(log, products)
    folder, sink, checkpoint = (scratch_path(spark, n) for n in ("commands", "carts", "check"))
    for parts in ((0, 1), (2,), (3,)):
        for part in parts:
            feed(spark, commands, part, folder)
        run_carts(spark, folder, commands.schema, sink, checkpoint)
    run_carts(spark, folder, commands.schema, sink, checkpoint)  # nothing new
    told = carts.changes(spark, sink)
    assert told.select("batch").distinct().count() == 4
    lines = fold_items(log, products)
    assert answers(carts.items(told), *lines.columns) == answers(lines) != []
    heads = fold_sessions(log, lines)
    assert answers(carts.sessions(told), *heads.columns) == answers(heads)
    orders, order_items = checkout(log, products)
    assert answers(carts.orders(told), *orders.columns) == answers(orders) != []
    assert answers(carts.order_items(told), *order_items.columns) == answers(order_items) != []


def test_idle_carts_expire(spark, rows):
    base = dt.datetime(2024, 1, 1)
    log = rows(
        LOG, (0, base, 1, 1, "add", 1, 1, None, 2), (1, base, 2, 1, "add", 1, 1, None, 1), (30, base + dt.timedelta(days=9), 2, 1, "add", 1, 1, None, 5),
        (60, base + dt.timedelta(days=9), None, 1, "add", 1, 1, None, 2), (90, base + dt.timedelta(days=9), 1, 1, "checkout", None, None, None, None),
    )
    commands = carts.all_commands(log, rows("product_id long, name string, current_price double", (1, "Lip", 1.0)))
    for keep_ms, count, open_items in ((None, 1, 2 + 5 + 1), (86_400_000, 0, 1 + 5)):
        folder, sink, checkpoint = (scratch_path(spark, n) for n in ("commands", "carts", "check"))
        for part in (0, 1, 2, 3):
            feed(spark, commands, part, folder)
            run_carts(spark, folder, commands.schema, sink, checkpoint, keep_ms)
        told = carts.changes(spark, sink)
        assert [r.item_count for r in carts.orders(told).collect()] == [count]
        assert sum(r.quantity for r in carts.items(told).collect()) == open_items


EVENTS = "turn_id string, seq long, event_type string, payload string, ts timestamp"


def event(turn, seq, kind, minute, **data):
    return turn, seq, kind, json.dumps(data) if data else "{broken", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_responses_equal_the_batch_fold_and_close(spark, rows):
    text, use, error = "response.text.delta", "response.tool_use", "error"
    batches = [
        [event("a", 2, text, 1, text="two "), event("a", 1, text, 0, text="one "), event("b", 1, text, 1), event("b", 2, None, 1, type="metadata", thread_id=7)],
        [event("a", 3, use, 5, tool_use_id="u", name="n", input={"x": 1}), event("b", 3, text, 4, text="end"), event("c", 1, error, 6, message="no")],
        [event("d", 1, text, 60, text="later")],
        [event("a", 4, text, 61, text="after its end"), event("e", 1, text, 3, text="too late"), event("d", 2, text, 62, text=" on"), event(None, 1, text, 62, text="x")],
        [event("f", 1, text, 300, text="z")],
    ]
    folder, sink, checkpoint = (scratch_path(spark, n) for n in ("events", "turns", "check"))
    for batch in batches:
        rows(EVENTS, *batch).coalesce(1).write.mode("append").parquet(folder)
        stream = responses.stream_turns(spark.readStream.schema(EVENTS).parquet(folder), sink, checkpoint)
        stream.awaitTermination()
        assert stream.exception() is None
    gone = ("after its end", "too late")
    kept = [e for batch in batches for e in batch if not any(g in e[3] for g in gone) and e[0]]
    told = responses.turns_so_far(spark, sink)
    want = assemble_turns(rows(EVENTS, *kept).drop("ts"))
    assert answers(told, *want.columns) == answers(want)
    assert {r.turn_id: r.closed for r in told.collect()} == {"a": True, "b": True, "c": True, "d": True, "f": False}


def test_many_turns_share_a_call_of_the_state():
    turns, told = processor(responses._Turns, 600_000, 3_600_000)
    frames = told(pd.DataFrame([(f"t{i % 500}", i, "error", None, i) for i in range(3000)], columns=["turn_id", "seq", "event_type", "payload", "at_ms"]))
    assert len(frames) == 1 and turns.deadlines.handle.calls < 2 * 500
    turns.deadlines.handle.calls = 0
    frames = told(pd.DataFrame([("t7", 9000, "error", None, 5000)], columns=["turn_id", "seq", "event_type", "payload", "at_ms"]))
    assert frames[0]["seq"].tolist() == [*range(7, 3000, 500), 9000] and turns.deadlines.handle.calls < 10


def test_many_sessions_share_a_call_of_the_state():
    base = {"customer_id": "c", "command": "add", "item_ref": "1", "product_id": "2", "variant_id": None, "product_name": "x", "unit_price_cents": 5, "quantity": 2}
    _, told = processor(carts._Carts, None)
    (out,) = told(pd.DataFrame([{"session_id": f"s{i % 500}", "seq": i, "at": i, **base} for i in range(1500)]))
    assert (out["kind"] == "line").sum() == 1500 and out[out["kind"] == "session"]["subtotal_cents"].tolist() == [30] * 500


def test_turns_beyond_what_is_held_are_told_once(monkeypatch):
    monkeypatch.setattr(responses, "_MOST", 10)
    turns = responses._Turns(600_000, 3_600_000)
    turns.init(Handle())
    columns = ["turn_id", "seq", "event_type", "payload", "at_ms"]
    parts = [pd.DataFrame([(f"t{i % 7}", 50 * k + i, None, "é", i) for i in range(50)], columns=columns) for k in range(3)]
    told = pd.concat(turns.handleInputRows((0,), iter(parts), None))
    assert sorted(told["seq"]) == list(range(150)) and set(told["payload"]) == {"é"}


def test_label_table_shows_changed_and_deleted_files(spark, tmp_path):
    table, checkpoint = scratch_path(spark, "labels"), scratch_path(spark, "check")
    model = lambda b: '{"brand":"' + bytes(b).decode() + '"}'

    def run():
        clock = folds.file_stream(spark, str(tmp_path), "*")
        folds.stream_labels(clock, lambda: folds.file_table(spark, str(tmp_path), "*.png"), table, checkpoint, model, interval=None).awaitTermination()
        return answers(snapshots.current(spark, table), "sku", "brand")

    (tmp_path / "A_1.png").write_bytes(b"one")
    (tmp_path / "B_1.png").write_bytes(b"two")
    assert run() == [("A", "one"), ("B", "two")]
    (tmp_path / "A_1.png").write_bytes(b"new")
    (tmp_path / "B_1.png").unlink()
    (tmp_path / "C_1.png").write_bytes(b"three")
    assert run() == [("A", "new"), ("C", "three")]


def test_versions_appear_whole_and_repeat_without_harm(spark, rows):
    path = scratch_path(spark, "table")
    with pytest.raises(ValueError):
        snapshots.current(spark, path)
    first, second = rows("a long", (1,)), rows("a long", (2,))
    snapshots.publish(first, path, 3)
    snapshots.publish(second, path, 3)  # the batch again: its version stands
    assert answers(snapshots.current(spark, path)) == [(1,)]
    second.write.parquet(f"{path}/v4")  # broken off before its mark
    assert answers(snapshots.current(spark, path)) == [(1,)]
    snapshots.publish(second, path, 4)
    snapshots.publish(first, path, 5)
    assert answers(snapshots.current(spark, path)) == [(1,)] and snapshots.versions(spark, path) == [4, 5]


def test_bookkeeping_keeps_the_last_word(spark, rows):
    path, kind = scratch_path(spark, "runs"), "file_path string, success boolean, error string"
    listed = rows("file_path string", ("a",), ("b",), ("c",))
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00")
    assert bookkeeping.pending(listed, bookkeeping.status(spark, path)).count() == 3
    bookkeeping.record(rows(kind, ("a", True, None), ("b", False, "bad"), ("b", True, None)), path, 1, at(1))
    assert answers(bookkeeping.pending(listed, bookkeeping.status(spark, path))) == [("b",), ("c",)]
    bookkeeping.compact(spark, path)
    bookkeeping.record(rows(kind, ("a", False, "replayed")), path, 1, at(9))  # folded already
    bookkeeping.record(rows(kind, ("b", None, "still bad")), path, 2, at(2))
    bookkeeping.record(rows(kind, ("b", True, None)), path, 2, at(3))  # the run again
    want = [("a", True, None, dt.datetime(2024, 1, 1)), ("b", True, None, dt.datetime(2024, 1, 3))]
    assert answers(bookkeeping.status(spark, path)) == want
    bookkeeping.compact(spark, path)
    bookkeeping.compact(spark, path)
    assert answers(bookkeeping.status(spark, path)) == want
    assert answers(bookkeeping.pending(listed, bookkeeping.status(spark, path))) == [("c",)]
