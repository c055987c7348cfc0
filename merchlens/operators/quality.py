"""Data-quality metrics and constraint checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F


def _metric_columns(freshness, nulls, rules, anchor) -> list[tuple[str, str, Column]]:
    out = [("row_count", "", F.count("*"))]
    out += [
        ("freshness_seconds", c, F.unix_timestamp(F.lit(anchor).cast("timestamp") if anchor else F.current_timestamp()) - F.unix_timestamp(F.max(c).cast("timestamp")))
        for c in freshness
    ]
    out += [("null_count", c, F.count_if(F.col(c).isNull())) for c in nulls]
    out += [("rule_violations", name, F.count_if(rule)) for name, rule in rules.items()]
    return out


def table_metrics(
    df: DataFrame,
    freshness: Sequence[str] = (),
    nulls: Sequence[str] = (),
    rules: Mapping[str, Column] | None = None,
    anchor: str | None = None,
) -> DataFrame:
    """Row count, freshness, null counts and rule counts as (metric, column, value), in one scan."""
    wanted = _metric_columns(freshness, nulls, rules or {}, anchor)
    wide = df.agg(*[value.cast("long").alias(f"m{i}") for i, (_, _, value) in enumerate(wanted)])
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column"), F.col(f"m{i}").alias("value")) for i, (m, c, _) in enumerate(wanted)]
    )
    return wide.select(F.inline(rows))


def observed(df: DataFrame, name: str, nulls: Sequence[str] = (), rules: Mapping[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """The same counts gathered while ``df`` is written, without a second scan."""
    watch = Observation(name)
    wanted = _metric_columns((), nulls, rules or {}, None)
    return df.observe(watch, *[v.alias(f"{m}:{c}" if c else m) for m, c, v in wanted]), watch


def cost_exceeds_price(cost: str = "cost", price: str = "current_price") -> Column:
    return F.col(cost) > F.col(price)


def unique_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count. Keys with a NULL part are not compared."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return df.filter(whole).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child key values without a parent, with their row count. The child is counted before the join."""
    used = child.filter(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("n"))
    return used.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def _per_column(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    wide = df.agg(*[F.count_if(test).alias(f"c{i}") for i, test in enumerate(tests.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(tests)])
    return wide.select(F.inline(rows))


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _per_column(df, {c: F.col(c).isNull() for c in columns})


def length_violations(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    return _per_column(df, {c: F.length(c) > n for c, n in limits.items()})
