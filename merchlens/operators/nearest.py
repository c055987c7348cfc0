"""Exact nearest colours, without pairing every target with every shade.

A target first looks for its ``k`` points in its own cell, the finest of five nested grids that holds so many. Their
``k``th distance bounds its reach, so it meets only the cells of that grid within it, and only points that near are
ranked: a few times ``k`` for each target, however dense the points are.

A target whose own cells are all too empty goes by the widest cells. A bounded table of cell statistics travels to every query, which works out
the closest and farthest any point of a cell can be. A cell is skipped only when none of its points can
be in the answer, so results are complete. What is left is an equi-join on the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from merchlens.operators.spread import top_k
from merchlens.session import settled, spread_rows

ROWS_PER_SPLIT = 8_192
# Covers rounding of the ranked score, so rows tied after rounding are all seen.
SCORE_SLACK, SQUARE_SLACK = 2e-4, 4e-6


def _merged(name: str) -> Column:
    """How a cell's bound becomes its block's bound."""
    fold = F.min if name.endswith("_min") else F.max if name.endswith("_max") else F.first
    return fold(name).alias(name)


def _with_probes(
    queries: DataFrame, cells: DataFrame, near, far, k: int | None, radius: float | None
) -> DataFrame:
    """One row per query and cell that can hold an answer.

    ``near`` and ``far`` give the least and greatest distance from the query row to the points inside some
    bounds. ``cells(block, cell, n, splits, bounds...)`` is limited by construction (cells of the
    colour cube); blocks of cells are tried first, then only the cells of the blocks in reach.
    """
    bounds = [c for c in cells.columns if c not in ("block", "cell", "n", "splits")]
    blocks = cells.groupBy("block").agg(
        *[_merged(c) for c in bounds],
        F.sum("n").alias("n"),
        F.collect_list(F.struct("cell", "n", "splits", *bounds)).alias("cells"),
    )
    table = blocks.agg(F.collect_list(F.struct("n", "cells", *bounds))).scalar()
    looked = spread_rows(queries).withColumn("__blocks", table)
    reach = F.lit(float("inf") if radius is None else radius)

    def slack(distance: Column) -> Column:
        return F.sqrt(distance * distance + SQUARE_SLACK) + SCORE_SLACK

    def with_k(reach: Column, places: str) -> Column:
        """Any place with k points reaches far enough."""
        return reach if k is None else F.least(reach, F.array_min(F.transform(places, lambda c: F.when(c["n"] >= k, far(c)))))

    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.withColumn(name, F.explode(F.array(value)))

    looked = once(looked, "__wide", slack(with_k(reach, "__blocks")))
    close = F.filter("__blocks", lambda c: near(c) <= F.col("__wide"))
    looked = once(looked, "__cells", F.flatten(F.transform(close, lambda c: c["cells"]))).drop("__blocks")
    tight = with_k(F.col("__wide"), "__cells")
    if k is not None:
        # So do the k nearest cells together.
        tight = F.least(tight, F.get(F.sort_array(F.transform("__cells", far)), F.lit(k - 1)))
    looked = once(looked, "__reach", slack(tight))
    return (
        # The outer form: plain explode would test every cell a second time to skip empty lists early.
        looked.withColumn("__probe", F.explode_outer(F.filter("__cells", lambda c: near(c) <= F.col("__reach"))))
        .filter("__probe IS NOT NULL")
        .withColumn("__cell", F.col("__probe.cell"))
        .withColumn("__splits", F.col("__probe.splits"))
        .drop("__cells", "__probe", "__wide")
    )


def _each_split(probes: DataFrame) -> DataFrame:
    return probes.withColumn("__split", F.explode(F.sequence(F.lit(0), F.col("__splits") - 1))).drop("__splits")


def _splits(n: Column) -> Column:
    return F.ceil(n / ROWS_PER_SPLIT).cast("int")


# Edge of a colour cell and of a block of cells.
COLOR_STEP, BLOCK_STEP = 16, 32


def _cell_of(r: Column, g: Column, b: Column, step: int = COLOR_STEP) -> Column:
    return (F.floor(r / step) * 256 + F.floor(g / step) * 16 + F.floor(b / step)).cast("int")


#: Edges of the nested cells, finest first.
STEPS = (1, 2, 4, 8, 16)


def _square(ch: Column | None = None) -> Column:
    """Squared distance of a target from a point, in its own columns or in a struct."""
    diff = [F.col(f"t{c}") - (F.col(c) if ch is None else ch[c]) for c in "rgb"]
    return sum((d * d for d in diff[1:]), diff[0] * diff[0])


def _place(axes: list[Column]) -> Column:
    """A cell's number within its grid."""
    return (axes[0] * 65536 + axes[1] * 256 + axes[2]).cast("int").alias("__place")


def _in_grids(rows: DataFrame, prefix: str) -> DataFrame:
    """Each row once per grid, with its cell there."""
    at = [F.floor(F.col(prefix + ch) / F.col("__step")) for ch in "rgb"]
    return rows.withColumn("__step", F.explode(F.array(*[F.lit(n) for n in STEPS]))).withColumn("__place", _place(at))


def _within_reach(colors: DataFrame, points: DataFrame, k: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of colours and points that can be among the ``k`` nearest, and the colours whose own cells are too empty."""
    cell = ["__step", "__place"]
    rgb = _in_grids(points.select("r", "g", "b"), "")
    full = rgb.groupBy(*cell).agg(F.count("*").alias("__n")).filter(F.col("__n") >= k).select(*cell)
    home = _in_grids(colors, "t").join(full, cell).groupBy("tr", "tg", "tb").agg(F.min_by(F.struct(*cell), "__step").alias("__home"))
    home = settled(home.select("tr", "tg", "tb", "__home.*"), "colour-homes")
    lists = rgb.join(home.select(*cell).distinct(), cell, "left_semi").groupBy(*cell).agg(F.collect_list(F.struct("r", "g", "b")).alias("__own"))
    bound = F.get(F.sort_array(F.transform("__own", _square)), F.lit(k - 1))
    reach = home.join(lists, cell).select("tr", "tg", "tb", "__step", F.sqrt(bound.cast("double")).alias("__reach"))
    probes = reach.withColumn("__reach", F.col("__reach") + slack)
    for ch in "rgb":
        t, step = F.col(f"t{ch}"), F.col("__step")
        low = F.greatest(F.lit(0).cast("long"), F.floor((t - F.col("__reach")) / step))
        high = F.least(F.floor(F.lit(255) / step), F.floor((t + F.col("__reach")) / step))
        probes = probes.withColumn(f"__{ch}", F.explode(F.sequence(low, high)))
    gaps = [
        F.greatest(F.lit(0), F.col(f"__{ch}") * F.col("__step") - F.col(f"t{ch}"), F.col(f"t{ch}") - (F.col(f"__{ch}") + 1) * F.col("__step") + 1)
        for ch in "rgb"
    ]
    near = F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]).cast("double")) <= F.col("__reach")
    probes = probes.filter(near).select("tr", "tg", "tb", "__reach", "__step", _place([F.col(f"__{ch}") for ch in "rgb"]))
    met = probes.join(_in_grids(points, ""), cell).drop(*cell).withColumn("__square", _square())
    met = met.filter(F.sqrt(F.col("__square").cast("double")) <= F.col("__reach")).drop("__reach")
    return met, colors.join(home, ["tr", "tg", "tb"], "left_anti")


def color_nearest(
    targets: DataFrame, points: DataFrame, k: int, point_order: list[str], round_first: bool
) -> DataFrame:
    """The ``k`` nearest points to each target in RGB space.

    Both sides carry ints ``r``/``g``/``b`` (``tr``/``tg``/``tb`` on targets). Ties go by ``point_order``.
    Of the points sharing one exact colour only the first ``k`` in that order can ever be in an answer,
    so a crowded colour is trimmed before the search; a cell then holds at most 4096 x k rows.
    """
    order = [F.col(c).asc_nulls_last() for c in point_order]
    points = settled(top_k(points, ["r", "g", "b"], order, k, "__n").drop("__n"), "colour-points")
    colors = settled(targets.select("tr", "tg", "tb").distinct(), "colours")
    slack = 0.011 if round_first else 1e-6
    met, rest = _within_reach(colors, points, k, slack)
    met = met.unionByName(_by_wide_cells(rest, points, k, point_order, slack))
    scored = met.withColumn("color_distance", F.round(F.sqrt(F.col("__square").cast("double")), 2))
    first = F.col("color_distance") if round_first else F.col("__square")
    best = top_k(scored, ["tr", "tg", "tb"], [first.asc(), *order], k)
    return targets.join(best.drop("__square"), ["tr", "tg", "tb"])


def _by_wide_cells(colors: DataFrame, points: DataFrame, k: int, point_order: list[str], slack: float) -> DataFrame:
    """Pairs of colours and points that can be among the ``k`` nearest, by statistics of the widest cells."""
    kept = points.withColumn("__cell", _cell_of(F.col("r"), F.col("g"), F.col("b")))
    block = _cell_of(*[F.col(c) for c in "rgb"], BLOCK_STEP)
    cells = kept.groupBy(block.alias("block"), F.col("__cell").alias("cell")).agg(
        F.count("*").alias("n"),
        _splits(F.count("*")).alias("splits"),
        *[f(c).alias(f"{c}_{f.__name__}") for c in ("r", "g", "b") for f in (F.min, F.max)],
    )
    def gap(c: Column, ch: str) -> Column:
        t = F.col(f"t{ch}")
        return F.greatest(F.lit(0), c[f"{ch}_min"] - t, t - c[f"{ch}_max"])

    def span(c: Column, ch: str) -> Column:
        t = F.col(f"t{ch}")
        return F.greatest(F.abs(t - c[f"{ch}_min"]), F.abs(t - c[f"{ch}_max"]))

    def length(parts) -> Column:
        return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]).cast("double"))

    probes = _with_probes(
        colors,
        cells,
        near=lambda c: length([gap(c, ch) for ch in "rgb"]) - slack,
        far=lambda c: length([span(c, ch) for ch in "rgb"]),
        k=k,
        radius=None,
    )
    split = kept.join(F.broadcast(cells.select(F.col("cell").alias("__cell"), "splits")), "__cell").withColumn(
        "__split", F.pmod(F.xxhash64(*point_order), F.col("splits")).cast("int")
    )
    pairs = _each_split(probes).join(split.drop("splits"), ["__cell", "__split"]).drop("__cell", "__split").withColumnRenamed("__reach", "__far")
    pairs = pairs.withColumn("__square", _square())
    return pairs.filter(F.sqrt(F.col("__square").cast("double")) <= F.col("__far")).drop("__far")
