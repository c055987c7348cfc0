"""Continuously refreshed tables: label extraction and search index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from merchlens.operators.labels import extract_labels, parse_labels
from merchlens.operators.search import lengths_of, postings_of
from merchlens.streaming.snapshots import stream_full_refresh
from merchlens.streaming.states import triggered, write_batch


def file_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files under a folder as (file_path, content) rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return read.load(folder).select(F.col("path").alias("file_path"), "content")


def stream_labels(
    clock: DataFrame,
    read_files: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    model_fn: Callable[[object], str] | None = None,
    interval: str | None = "5 minutes",
) -> StreamingQuery:
    """The label table, rebuilt whole from all files whenever ``clock`` ticks, so changed and deleted files show.

    ``read_files()`` gives ``(file_path, content)`` for a model, or ``(file_path, raw_result)`` without one, as they are
    at that time. Read the table with ``snapshots.current``.
    """

    def build() -> DataFrame:
        files = read_files()
        parsed = parse_labels(files) if model_fn is None else extract_labels(files, model_fn)
        return parsed.withColumn("raw_json", F.to_json("raw_json"))

    return stream_full_refresh(clock, build, path, checkpoint, interval)


def file_table(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files under a folder now, as (file_path, content) rows."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return read.load(folder).select(F.col("path").alias("file_path"), "content")


def stream_index(
    docs: DataFrame, id_col: str, text_col: str, sink: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append new documents to the postings and docs tables under ``sink``."""

    def append(batch: DataFrame, batch_id: int) -> None:
        write_batch(postings_of(batch, id_col, text_col), f"{sink}/postings", batch_id)
        write_batch(lengths_of(batch, id_col, text_col), f"{sink}/docs", batch_id)

    writer = docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return triggered(writer, interval).start()
