"""Group-wise building blocks that stay spread out when one key holds a large share of the rows.

``latest_by`` uses a partial aggregate instead of a window. ``running`` and ``following`` cut each key
into ordered chunks, solve every chunk on its own, and carry one summary row per chunk across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows a single task may be asked to order within one key.
CHUNK_ROWS = 1 << 16


def seq_chunk(seq: str | Column, size: int = CHUNK_ROWS) -> Column:
    """Chunk number of a unique integer sequence: at most ``size`` rows share one."""
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / size)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], earliest: bool = False) -> DataFrame:
    """The one row per key that comes last in ``order``, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if earliest else F.max_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*").select(*df.columns)


_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, before: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.least(before, local) if kind == "min" else F.greatest(before, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    folds: dict[str, tuple[str, Column]],
    exclude_current: bool = False,
) -> DataFrame:
    """Add running sum/min/max columns ``{name: (kind, value)}`` per key.

    ``chunk`` must never decrease along ``order``. Keys must not be NULL.
    """
    keys = list(keys)
    cut = df.withColumn("__chunk", chunk)
    for name, (_, value) in folds.items():
        cut = cut.withColumn(f"__v_{name}", value)
    per_chunk = cut.groupBy(*keys, "__chunk").agg(
        *[_FOLDS[kind](f"__v_{name}").alias(f"__b_{name}") for name, (kind, _) in folds.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *keys, "__chunk", *[_FOLDS[kind](f"__b_{name}").over(earlier).alias(f"__b_{name}") for name, (kind, _) in folds.items()]
    )
    end = -1 if exclude_current else 0
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = cut.select("*", *[_FOLDS[kind](f"__v_{name}").over(inside).alias(f"__l_{name}") for name, (kind, _) in folds.items()])
    return local.join(carried, [*keys, "__chunk"]).select(
        *df.columns,
        *[_merge(kind, F.col(f"__b_{name}"), F.col(f"__l_{name}")).alias(name) for name, (kind, _) in folds.items()],
    )


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, values: dict[str, Column]
) -> DataFrame:
    """Add, per key, the values of the next row in ``order`` (NULL on the last row)."""
    keys = list(keys)
    packed = df.withColumn("__chunk", chunk).withColumn("__v", F.struct(*[v.alias(n) for n, v in values.items()]))
    firsts = packed.groupBy(*keys, "__chunk").agg(F.min_by("__v", F.struct(*order)).alias("__first"))
    later = Window.partitionBy(*keys).orderBy("__chunk")
    carried = firsts.select(*keys, "__chunk", F.lead("__first").over(later).alias("__n"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    local = packed.withColumn("__l", F.lead("__v").over(inside))
    nxt = local.join(carried, [*keys, "__chunk"]).withColumn("__x", F.coalesce("__l", "__n"))
    return nxt.select(*df.columns, *[F.col(f"__x.{n}").alias(n) for n in values])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark trims each key to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def hot_keys(df: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """(key, salts) of the keys that hold more than 1/``share`` of the rows: fewer than ``share`` rows, so fit to broadcast.

    ``salts`` is how many times that share a key holds.
    """
    total = df.select(F.count(key).alias("n")).scalar()
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    return counts.filter(F.col("__n") * share > total).select(key, F.ceil(F.col("__n") * share / total).cast("int").alias("salts"))


def salted(many: DataFrame, few: DataFrame, key: str, by: Sequence[str], share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``join_salted`` with the place of each row as ``__salt``."""
    hot = F.broadcast(hot_keys(many, key, share))
    salts = F.coalesce("salts", F.lit(1))
    dealt = many.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), salts.cast("long"))).drop("salts")
    places = F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long")))
    return dealt, few.join(hot, key, "left").withColumn("__salt", places).drop("salts")


def join_salted(many: DataFrame, few: DataFrame, key: str, by: Sequence[str], share: int = 1000) -> DataFrame:
    """Inner join on ``key`` where a key may hold a large part of ``many``: its rows are dealt out by a hash of ``by``.

    Rows of ``few`` with such a key are repeated for each place; all other keys stand in one.
    """
    dealt, repeated = salted(many, few, key, by, share)
    return dealt.join(repeated, [key, "__salt"]).drop("__salt")
