"""Loading header-bound CSV files and filling column defaults."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from merchlens.functions.text import uuid_from
from merchlens.session import scratch_path

NULL_TOKENS = ("", "NULL", "null")


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind)
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(text)
    return text if isinstance(kind, T.StringType) else F.trim(text).try_cast(kind)


#: A file is one split, and no split holds two files, so that a task ends after its file's first line.
_WHOLE_FILE = 1 << 40
_LINE = pa.schema([("file", pa.string()), ("header", pa.string())])


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line that is not blank, if the split begins its file; the rest is not read."""
    for batch in batches:
        for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
            if start:
                return
            if line.strip():
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([line.rstrip("\r").removeprefix("\ufeff")])], schema=_LINE)
                return


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the header of every file under a path, as a written table.

    A task opens one file and stops after a few lines, so no file is read through. Files without a line are not told.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(_WHOLE_FILE))
    own.conf.set("spark.sql.files.openCostInBytes", str(2 * _WHOLE_FILE))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    lines = own.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    kept = scratch_path(spark, "csv-headers")
    lines.mapInArrow(_first_line, "file string, header string").repartition("file").write.parquet(kept)
    return spark.read.schema("file string, header string").parquet(kept)


def raw_csv(spark: SparkSession, path: str | list[str], width: int, multi_line: bool = False) -> DataFrame:
    """CSV files with headers as text columns ``c0``, ``c1``, ..."""
    return (
        spark.read.schema(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)]))
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(path)
    )


def _names(header: str) -> list[str]:
    return [name.strip().lower() for name in next(csv.reader([header]))]


def _bound(raw: DataFrame, layouts: Mapping[str, list[str]], schema: T.StructType, nulls: Sequence[str]) -> DataFrame:
    """Each field from the column that has its name in the header of the row's file."""
    out = []
    for field in schema.fields:
        headers_at: dict[int, list[str]] = {}
        for header, names in layouts.items():
            if field.name.lower() in names:
                headers_at.setdefault(names.index(field.name.lower()), []).append(header)
        if len(layouts) == 1:
            texts = [F.col(f"c{i}") for i in headers_at]
        else:
            texts = [F.when(F.col("header").isin(headers), F.col(f"c{i}")) for i, headers in headers_at.items()]
        if not texts:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.coalesce(*texts)
        out.append(_typed(F.when(text.isin(*nulls), None).otherwise(text), field.dataType).alias(field.name))
    return raw.select(*out)


def load_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | Callable[[list[str]], T.StructType],
    nulls: Sequence[str] = NULL_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """Read CSV files with a header into ``schema``, matching columns by name without regard to case.

    A callable makes the schema from the names of all headers. Every file is bound by its own header, its first line that is not blank; of columns that share a name the first
    counts. Missing columns become NULL, extra ones are dropped, null tokens become NULL and values that do not fit
    their type become NULL. Only the headers that differ come to the driver, and rows meet their file's header only
    where there are several. With ``multi_line`` quoted fields may hold line breaks, at the price of one task per file.
    """
    lines = header_lines(spark, path)
    layouts = {row.header: _names(row.header) for row in lines.select("header").distinct().orderBy("header").collect()}
    if callable(schema):
        schema = schema(list(dict.fromkeys(name for names in layouts.values() for name in names)))
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not layouts:
        return spark.createDataFrame([], schema)
    raw = raw_csv(spark, path, max(map(len, layouts.values())), multi_line)
    if len(layouts) > 1:
        raw = raw.withColumn("file", F.col("_metadata.file_path")).join(lines, "file")
    return _bound(raw, layouts, schema, nulls)


def with_defaults(df: DataFrame, defaults: Mapping[str, object], anchor: Column | None = None, seed: Sequence[str] = ()) -> DataFrame:
    """Fill NULLs: ``"uuid"`` gives an id, ``"now"`` the anchor or current time, anything else itself.

    With ``seed`` columns the id is a digest of them and survives a re-run of the task unchanged.
    """
    out = {}
    for name, default in defaults.items():
        if default == "uuid":
            value = uuid_from(F.lit(name), *[F.col(c) for c in seed]) if seed else F.uuid()
        elif default == "now":
            value = anchor if anchor is not None else F.current_timestamp()
        else:
            value = F.lit(default)
        if name in df.columns:
            value = F.coalesce(F.col(name), value.cast(df.schema[name].dataType))
        out[name] = value
    return df.withColumns(out)
