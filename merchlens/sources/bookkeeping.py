"""Which files were processed, when, and what went wrong.

A log of runs over a base: every run writes its own folder of (file_path, processed, error, processed_at), a run that
is repeated overwrites it, and readers take each file's last word. ``compact`` folds the runs into a new base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from merchlens.operators.spread import latest_by
from merchlens.streaming.snapshots import _files, current, publish, versions

STATUS = "file_path string, processed boolean, error string, processed_at timestamp_ntz"


def record(results: DataFrame, path: str, run: int, at: Column) -> None:
    """Log ``results(file_path, success, error)`` as run number ``run``; numbers rise from run to run."""
    spark = results.sparkSession
    done = versions(spark, f"{path}/base")
    if done and run <= done[-1]:
        return  # folded into the base already
    told = results.groupBy("file_path").agg(  # a file told twice in one run has failed if one of them did
        F.bool_and(F.coalesce("success", F.lit(False))).alias("processed"), F.max("error").alias("error")
    )
    told.select("file_path", "processed", "error", at.cast("timestamp_ntz").alias("processed_at")).write.mode("overwrite").parquet(
        f"{path}/log/run={run}"
    )


def _runs(spark: SparkSession, path: str) -> list[int]:
    files, log = _files(spark, f"{path}/log")
    names = [f.getPath().getName() for f in files.listStatus(log)] if files.exists(log) else []
    return sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))


def status(spark: SparkSession, path: str) -> DataFrame:
    """Each file's last word: processed, error, processed_at. Merged from the base and the runs after it."""
    done = versions(spark, f"{path}/base")
    last = done[-1] if done else -1
    merged = spark.createDataFrame([], STATUS).withColumn("run", F.lit(-1))
    if done:
        merged = merged.unionByName(current(spark, f"{path}/base").withColumn("run", F.lit(last)))
    later = [r for r in _runs(spark, path) if r > last]
    if later:
        log = spark.read.schema(STATUS + ", run int").option("basePath", f"{path}/log")
        merged = merged.unionByName(log.parquet(*[f"{path}/log/run={r}" for r in later]))
    return latest_by(merged, ["file_path"], [F.col("run")]).drop("run")


def compact(spark: SparkSession, path: str) -> None:
    """Fold all runs into the base. Readers see either the old base with its runs or the new one."""
    runs = _runs(spark, path)
    if runs:
        publish(status(spark, path), f"{path}/base", runs[-1])
    for run in runs:
        files, folder = _files(spark, f"{path}/log/run={run}")
        files.delete(folder, True)


def pending(files: DataFrame, told: DataFrame) -> DataFrame:
    """Files of a listing that were never processed, or failed when they last were."""
    return files.join(told.filter("processed").select("file_path"), "file_path", "left_anti")
