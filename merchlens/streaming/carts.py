"""Carts as a stream of commands: headers, open lines, totals and orders, the same as the batch fold of the log.

State per session: a header, the stacks of its items' open lines, and the number of orders; the sessions of a bucket are
moved on together. An event-time timer may expire a cart that has been idle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from merchlens.functions.text import cents, dollars, order_number, uuid_from
from merchlens.operators.spread import latest_by
from merchlens.streaming.states import TOLD, Deadlines, bucket_of, rocks_state, triggered, write_batch

#: Open lines are JSON, an item's newest line last: one value goes to the state and back much faster than arrays do.
_CART = "customer_id string, created long, updated long, done boolean, last_seq long, orders long, lines string"
_OUT = (
    "kind string, session_id string, seq long, item_ref string, add_seq long, product_id string, variant_id string, product_name string, "
    "unit_price_cents long, added long, quantity long, removed boolean, ordinal long, customer_id string, status string, "
    "item_count long, subtotal_cents long, created long, updated long"
)
_FIELDS = [c.split()[0] for c in _OUT.split(", ")]
_BLANK = {c.split()[0]: {"string": None, "long": 0, "boolean": False}[c.split()[1]] for c in _OUT.split(", ")}
_NEVER = -(2**62)
Line = list  # add_seq, product_id, variant_id, product_name, price, added, quantity


class _Carts(StatefulProcessor):
    """Moves the sessions of a bucket on by their new commands and tells what changed."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carts = handle.getMapState("carts", "session_id string", _CART)
        self.deadlines = Deadlines(handle) if self.keep_ms is not None else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["session_id", "seq"], kind="stable")
        columns = ("seq", "at", "customer_id", "command", "item_ref", "product_id", "variant_id", "product_name", "unit_price_cents", "quantity")
        commands, told = zip(*[new[c].tolist() for c in ("session_id", *columns)]), []
        if self.deadlines:
            self.deadlines.read()
        for session, own in groupby(commands, key=lambda c: c[0]):
            told += self._moved(session, [c[1:] for c in own])
            if len(told) >= TOLD:
                yield pd.DataFrame(told, columns=_FIELDS)
                told = []
        if self.deadlines:
            self.deadlines.write()
        if told:
            yield pd.DataFrame(told, columns=_FIELDS)

    def _moved(self, session: str, commands: list[tuple]) -> list[dict]:
        customer, created, updated, done, _, orders, open_lines = self._cart(session)
        changed, told = {}, []
        for seq, at, who, command, item, product, variant, name, price, quantity in commands:
            if created is None:
                customer, created = who, at
            created = min(created, at)
            if command != "create":
                updated = max(updated, at)
            stack = open_lines.get(item, [])
            if command == "add" and price >= 0:
                stack = open_lines.setdefault(item, stack)
                stack.append([seq, product, variant, name, price, at, quantity])
                changed[item, seq] = (stack[-1], seq, False)
            elif command == "update" and stack:
                stack[-1][6] = quantity
                changed[item, stack[-1][0]] = (stack[-1], seq, False)
            elif command == "remove" and stack:
                line = stack.pop()
                changed[item, line[0]] = (line, seq, True)
            elif command == "checkout":
                orders, done = orders + 1, True
                sold = [(ref, line) for ref, lines in open_lines.items() for line in lines]
                total = sum(line[4] * line[6] for _, line in sold)
                told.append(self._row("order", session, seq, ordinal=orders, customer_id=who, item_count=len(sold), subtotal_cents=total, created=at))
                told += [self._line("order_item", session, seq, ref, line, ordinal=orders) for ref, line in sold]
        told += [self._line("line", session, seq, item, line, removed=gone) for (item, _), (line, seq, gone) in changed.items()]
        last_seq = commands[-1][0]
        self._keep(session, (customer, created, updated, done, last_seq, orders), open_lines)
        sums = [line[4] * line[6] for lines in open_lines.values() for line in lines]
        told.append(
            self._row(
                "session", session, last_seq, customer_id=customer, status="completed" if done else "active",
                item_count=len(sums), subtotal_cents=sum(sums), created=created, updated=updated,
            )
        )
        if self.deadlines:
            times = [c[1] for c in commands if c[1] == c[1]]  # a NULL time says nothing
            if times:
                self.deadlines.due[session] = [int(max(times)) // 1000 + self.keep_ms]
        return told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = []
        for session in self.deadlines.passed(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()):
            customer, created, updated, _, last_seq, orders, open_lines = self._cart(session)
            told += [self._line("line", session, last_seq, item, line, removed=True) for item, lines in open_lines.items() for line in lines]
            told.append(self._row("session", session, last_seq, customer_id=customer, status="expired", created=created, updated=updated))
            self._keep(session, (None, None, _NEVER, False, 0, orders), {})
            if len(told) >= TOLD:
                yield pd.DataFrame(told, columns=_FIELDS)
                told = []
        self.deadlines.write()
        if told:
            yield pd.DataFrame(told, columns=_FIELDS)

    def _cart(self, session: str) -> tuple:
        """Header, number of orders, and the stacks of open lines by item."""
        if not self.carts.containsKey((session,)):
            return None, None, _NEVER, False, 0, 0, {}
        row, open_lines = self.carts.getValue((session,)), {}
        for item, *line in json.loads(row[6]):
            open_lines.setdefault(item, []).append(line)
        return *row[:6], open_lines

    def _keep(self, session: str, header: tuple, open_lines: dict[str, list[Line]]) -> None:
        customer, created, updated, *others = header
        times = [None if t is None or t != t else int(t) for t in (created, updated)]
        lines = [(item, *line) for item, stack in open_lines.items() for line in stack]
        self.carts.updateValue((session,), (customer, *times, *others, json.dumps(lines, ensure_ascii=False)))

    @staticmethod
    def _row(kind: str, session: str, seq: int, **values) -> dict:
        return {**_BLANK, "kind": kind, "session_id": session, "seq": seq, **values}

    def _line(self, kind: str, session: str, seq: int, item: str, line: Line, **values) -> dict:
        add_seq, product, variant, name, price, added, quantity = line
        return self._row(
            kind, session, seq, item_ref=item, add_seq=add_seq, product_id=product, variant_id=variant, product_name=name,
            unit_price_cents=price, added=added, quantity=quantity, subtotal_cents=price * quantity, **values,
        )

    def close(self) -> None:
        pass


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _timestamp(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def all_commands(log: DataFrame, products: DataFrame) -> DataFrame:
    """Every command of a log, adds with the product's name and price; an unknown product has the price -1."""
    catalog = products.select(
        F.col("product_id").alias("__id"), F.col("name").alias("product_name"), cents(F.col("current_price")).alias("__price")
    )
    joined = log.join(catalog, (F.col("product_id") == F.col("__id")) & (F.col("command") == "add"), "left")
    text = lambda name: F.col(name).cast("string").alias(name)
    return joined.select(
        text("session_id"), F.col("seq").cast("long").alias("seq"), _micros(F.col("ts")).alias("at"), text("customer_id"), "command",
        F.coalesce(F.col("item_ref").cast("string"), F.lit("")).alias("item_ref"), text("product_id"), text("variant_id"), "product_name",
        F.coalesce("__price", F.lit(-1)).cast("long").alias("unit_price_cents"), F.coalesce("quantity", F.lit(0)).cast("long").alias("quantity"),
    )


def stream_carts(
    commands: DataFrame, sink: str, checkpoint: str, keep_ms: int | None = None, late: str = "1 day", interval: str | None = None
) -> StreamingQuery:
    """Fold a stream of ``all_commands`` into changes of sessions, lines, orders and order items under ``sink``.

    Commands of a session come in the order of ``seq`` from batch to batch; inside a batch they are sorted. A NULL
    quantity is 0, rows without a session are left out. With ``keep_ms`` a cart expires once the watermark, ``late``
    behind the newest command, has passed its last command by so much: its lines go, a later command begins a new
    cart, order numbers go on; commands behind the watermark are dropped then. The commands of a batch for
    the sessions of a bucket (one of 1,024), and a session's open lines, are held by one task. The first start fixes the
    checkpoint's state; one of an earlier version, by session, can't be gone on with.
    """
    spark = commands.sparkSession
    named = commands.filter("session_id is not null")
    if keep_ms is not None:
        named = named.withColumn("came", F.timestamp_micros("at")).withWatermark("came", late)
    folded = named.withColumn("bucket", bucket_of("session_id")).groupBy("bucket").transformWithStateInPandas(
        _Carts(keep_ms), _OUT, "Update", "None" if keep_ms is None else "EventTime"
    )
    with rocks_state(spark):
        writer = folded.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: write_batch(batch, sink, batch_id))
        return triggered(writer.option("checkpointLocation", checkpoint), interval).start()


def changes(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(_OUT + ", batch long").parquet(sink)


def _of(told: DataFrame, kind: str, key: str) -> DataFrame:
    """Rows of a kind, ids in the type ``key`` names."""
    ids = [F.col(c).cast(key).alias(c) if c in ("session_id", "item_ref", "product_id", "variant_id", "customer_id") else F.col(c) for c in told.columns]
    return told.filter(F.col("kind") == kind).select(*ids)


def sessions(told: DataFrame, key: str = "long") -> DataFrame:
    """Headers as of the last batch, in the form of ``fold_sessions``."""
    newest = latest_by(_of(told, "session", key), ["session_id"], [F.col("batch")])
    return newest.select(
        "session_id", "customer_id", "status", "subtotal_cents", F.col("subtotal_cents").alias("total_cents"), F.lit("USD").alias("currency"),
        _timestamp(F.col("created")).alias("created_at"), F.when(F.col("updated") != _NEVER, _timestamp(F.col("updated"))).alias("updated_at"),
    )


def open_lines(told: DataFrame, key: str = "long") -> DataFrame:
    """Lines as of the last batch that were not removed."""
    return latest_by(_of(told, "line", key), ["session_id", "item_ref", "add_seq"], [F.col("batch"), F.col("seq")]).filter("NOT removed")


def items(told: DataFrame, key: str = "long") -> DataFrame:
    """``open_lines`` in the form of ``fold_items``."""
    return open_lines(told, key).select(
        uuid_from(F.col("session_id"), F.col("item_ref"), F.col("add_seq")).alias("item_id"), "session_id", "product_id", "variant_id", "quantity",
        "unit_price_cents", "subtotal_cents", "product_name", _timestamp(F.col("added")).alias("added_at"), "add_seq",
    )


def orders(told: DataFrame, key: str = "long") -> DataFrame:
    """Orders, in the form of ``checkout``."""
    made, at = _of(told, "order", key), _timestamp(F.col("created"))
    zero = F.lit(0)
    return made.select(
        uuid_from(F.col("session_id"), F.col("ordinal")).alias("order_id"), order_number(at, F.col("session_id"), F.col("ordinal")).alias("order_number"),
        "session_id", F.col("ordinal").alias("order_ordinal"), "customer_id", F.lit("confirmed").alias("status"), "item_count", "subtotal_cents",
        zero.alias("tax_cents"), zero.alias("shipping_cents"), zero.alias("discount_cents"), F.col("subtotal_cents").alias("total_cents"),
        dollars(F.col("subtotal_cents")).alias("total_dollars"), F.lit("USD").alias("currency"), at.alias("created_at"),
    )


def order_items(told: DataFrame, key: str = "long") -> DataFrame:
    """Order items, in the form of ``checkout``."""
    sold = _of(told, "order_item", key)
    return sold.select(
        uuid_from(F.col("session_id"), F.col("ordinal"), F.col("item_ref"), F.col("add_seq")).alias("order_item_id"),
        uuid_from(F.col("session_id"), F.col("ordinal")).alias("order_id"), "session_id", F.col("ordinal").alias("order_ordinal"), "product_id",
        "variant_id", "quantity", "unit_price_cents", "subtotal_cents", "product_name",
    )
