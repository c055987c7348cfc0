"""Inventory ledger checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchlens.operators.spread import CHUNK_ROWS, following, seq_chunk


def ledger_check(ledger: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per stock: rows, rows where before + quantity is not after, and rows whose after is not the next before.

    ``ledger(seq, stock_id, quantity, quantity_before, quantity_after)`` with ``seq`` unique and increasing.
    """
    linked = following(
        ledger, ["stock_id"], [F.col("seq")], seq_chunk("seq", chunk_rows), {"__next": F.col("quantity_before")}
    )
    return linked.groupBy("stock_id").agg(
        F.count("*").alias("entries"),
        F.sum("quantity").alias("net_quantity"),
        F.count_if(F.col("quantity_before") + F.col("quantity") != F.col("quantity_after")).alias("bad_sums"),
        F.count_if(F.col("__next") != F.col("quantity_after")).alias("broken_links"),
        F.max_by("quantity_after", "seq").alias("closing_quantity"),
    )
