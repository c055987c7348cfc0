"""Running a model over rows, with one status per row and totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def bisected(values: Sequence[object], batch_fn: Callable[[list], Sequence[str]]) -> tuple[list[str | None], list[str | None]]:
    """Results and errors of a batch call; a batch that fails is halved until the values that fail stand alone.

    A batch without a bad value is one call, and each bad value costs about two calls per halving.
    """
    results: list[str | None] = [None] * len(values)
    errors: list[str | None] = [None] * len(values)
    work = [(0, len(values))] if values else []
    while work:
        start, end = work.pop()
        try:
            told = list(batch_fn(list(values[start:end])))
            if len(told) != end - start:
                raise ValueError(f"{len(told)} results for {end - start} values")
            results[start:end] = told
        except Exception as problem:  # a model may fail in any way
            if end - start == 1:
                errors[start] = str(problem) or type(problem).__name__
            else:
                middle = (start + end) // 2
                work += [(middle, end), (start, middle)]
    return results, errors


def batch_infer(
    rows: DataFrame, key: str, content: str, model_fn: Callable[[object], str], missing: str = "No image provided"
) -> DataFrame:
    """Call ``model_fn(content) -> text`` per row; an exception becomes that row's error.

    Output: key, success, result, error. Rows arrive in Arrow batches; nothing is collected.
    """
    return infer_in_batches(rows, key, content, lambda values: [model_fn(v) for v in values], 1, missing)


def infer_in_batches(
    rows: DataFrame, key: str, content: str, batch_fn: Callable[[list], Sequence[str]], size: int = 64, missing: str = "No image provided"
) -> DataFrame:
    """``batch_infer`` with a model that takes up to ``size`` values in a call and gives a result for each.

    Where a call fails, only the rows that make it fail get its error. NULL and empty contents never reach the model.
    """
    kept = rows.select(key, content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = [v is not None and len(v) > 0 for v in batch[content]]
            values = [v for v, ok in zip(batch[content], given) if ok]
            told: list[tuple[str | None, str | None]] = []
            for start in range(0, len(values), size):
                told += zip(*bisected(values[start : start + size], batch_fn))
            answers = iter(told)
            pairs = [next(answers) if ok else (None, missing) for ok in given]
            yield pd.DataFrame(
                {
                    key: batch[key],
                    "success": [error is None for _, error in pairs],
                    "result": pd.Series([result for result, _ in pairs], dtype="object"),
                    "error": pd.Series([error for _, error in pairs], dtype="object"),
                }
            )

    key_type = kept.schema[key].dataType.simpleString()
    return kept.mapInPandas(run, f"{key} {key_type}, success boolean, result string, error string")


def infer_totals(statuses: DataFrame) -> DataFrame:
    return statuses.agg(
        F.count_if("success").alias("processed"),
        F.count_if(~F.col("success")).alias("failed"),
    ).withColumn("success", F.col("failed") == 0)
