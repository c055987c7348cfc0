"""Tables that are rebuilt whole and published at once.

A version is a folder; a mark beside it, an empty file, says that it is whole. Readers take the highest marked
version, so they never see one half written. A batch that is run again finds its mark and does nothing, or finds none
and writes its folder anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from merchlens.streaming.states import triggered


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that readers may see, in order; a table keeps only a few."""
    files, marks = _files(spark, f"{path}/published")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(marks)) if files.exists(marks) else []


def publish(df: DataFrame, path: str, version: int, keep: int = 2) -> None:
    """Write ``df`` as a version of the table and make it the current one; older ones beyond ``keep`` go."""
    spark = df.sparkSession
    known = versions(spark, path)
    if version in known:
        return
    df.write.mode("overwrite").parquet(f"{path}/v{version}")
    files, mark = _files(spark, f"{path}/published/{version}")
    files.mkdirs(mark.getParent())
    files.createNewFile(mark)
    for old in sorted([*known, version])[:-keep]:
        for gone in (f"{path}/published/{old}", f"{path}/v{old}"):  # the mark first
            files.delete(_files(spark, gone)[1], True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table's newest whole version."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"no version of {path} was published yet")
    return spark.read.parquet(f"{path}/v{known[-1]}")


def stream_full_refresh(
    clock: DataFrame, build: Callable[[], DataFrame], path: str, checkpoint: str, interval: str | None = "5 minutes", keep: int = 2
) -> StreamingQuery:
    """Rebuild the table from all its sources whenever ``clock`` brings rows, and publish it under the batch's number.

    ``clock`` is any stream: new files, or ``ticks`` for a refresh by time, which also sees files that changed or went.
    ``build`` reads the sources as they are when it is called.
    """
    writer = clock.writeStream.foreachBatch(lambda _, batch_id: publish(build(), path, batch_id, keep))
    return triggered(writer.option("checkpointLocation", checkpoint), interval).start()


def ticks(spark: SparkSession) -> DataFrame:
    """A row a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load()
