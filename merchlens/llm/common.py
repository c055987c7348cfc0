"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from merchlens.session import settled

#: A word, for Java's regular expressions; in Python, ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def width(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in a total order; no task sees more than one range of the rows."""
    ranges = settled(df.repartitionByRange(width(df), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__range").agg(F.count("*").alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )  # one row for each range
    inside = Window.partitionBy("__range").orderBy(*order)
    return ranges.join(starts, "__range").select(
        *df.columns, (F.col("__start") + F.row_number().over(inside) - 1).cast("long").alias(name)
    )


#: Rows of at most some 60 bytes that may be sent to all executors.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast if it was counted to hold no more than ``rows``; else joined by key.

    ``weight``: what a row counts for, where rows hold arrays.
    """
    held = df.count() if weight is None else df.agg(F.sum(weight + 1)).first()[0] or 0
    return F.broadcast(df) if held <= rows else df


def batch_of(schema: pa.Schema, columns: Sequence[Sequence]) -> pa.RecordBatch:
    """A record batch from Python sequences or arrays in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
