"""File listings as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from merchlens.functions.text import base_name

# The message for a label that is not there, and the prefix of paths in the stage.
MISSING_LABEL = "[Label image not available - please use LabelSearch to find products with label images]"
STAGE_PREFIX = "@PRODUCTS.PRODUCT_MEDIA/"


def register_files(spark: SparkSession, dirs: Sequence[str], pattern: str | None = None) -> DataFrame:
    """(file_path, length, modified_at) of every file under the folders; contents are not read."""

    def listing(folder: str) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)

    every = reduce(DataFrame.unionByName, [listing(d) for d in dirs])
    return every.select(F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified_at"))


def one_per_name(files: DataFrame) -> DataFrame:
    """Keep one path per file name, the shortest."""
    return files.groupBy(base_name(F.col("file_path")).alias("file_name")).agg(
        F.min_by("file_path", F.struct(F.length("file_path"), F.col("file_path"))).alias("file_path")
    )


def stage_relative(path: Column) -> Column:
    return F.replace(path, F.lit(STAGE_PREFIX), F.lit(""))


def resolve_label_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``paths(path)`` looked up in ``files(file_path)``: the path within the stage, or a message."""
    known = files.select(F.col("file_path").alias("__rel")).distinct().withColumn("__hit", F.lit(True))
    asked = paths.select("path").distinct().withColumn("__rel", stage_relative(F.col("path")))
    return asked.join(known, "__rel", "left").select(
        "path",
        F.when(F.col("__hit"), F.col("__rel")).alias("resolved"),
        F.when(F.col("__hit").isNull(), F.lit(MISSING_LABEL)).alias("message"),
    )


def unprocessed_files(files: DataFrame, done: DataFrame) -> DataFrame:
    return files.select("file_path").join(done.select("file_path"), "file_path", "left_anti")


def file_base64(files: DataFrame) -> DataFrame:
    """``files(file_path, content)`` with the bytes as base64 text, or an error when there are none."""
    empty = F.col("content").isNull() | (F.length("content") == 0)
    return files.select(
        "file_path",
        F.when(~empty, F.base64("content")).alias("image_base64"),
        F.when(empty, F.concat(F.lit("ERROR: no content in "), "file_path")).alias("error"),
    )
