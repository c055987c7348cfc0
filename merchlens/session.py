"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, submit with SETTINGS instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("merchlens")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, so that they need no installation."""
    context = spark.sparkContext
    if getattr(context, "_merchlens_shipped", False):
        return
    context._merchlens_shipped = True
    package = os.path.dirname(os.path.abspath(__file__))
    # In the context's own folder on the driver, from which Spark serves the file as long as the context lives.
    archive = os.path.join(os.path.realpath(context._temp_dir or tempfile.mkdtemp()), "merchlens-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    whole = os.path.join(top, name)
                    out.write(whole, os.path.relpath(whole, os.path.dirname(package)))
    context.addPyFile(archive)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the cluster names in spark.checkpoint.dir.

    A folder of our own stands in only where it is unset and the session is local, as in tests. What is written
    there goes when the driver's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = os.path.join(tempfile.gettempdir(), "merchlens-scratch")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written to the shared scratch folder and read back.

    For a result several later steps start from: it is worked out once, outlives lost executors, and the
    next plan starts from its real size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows dealt out over the shuffle partitions, for few rows that each need much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
