"""Exact top-k by inner product: KD-trees per shard, with a kth score that travels from shard to shard.

Equal vectors are one point with its smallest ids, so copies can't fill a node. A coarse tree, fitted on a bounded
sample, deals the points to cells by median splits; a cell is cut by hash into shards of a bounded size where it is
large. Every shard grows a KD-tree with tight boxes. A query first searches its own cell; the kth score found there
goes with it, and only cells whose box can hold a better score are searched too. Inside a tree the node with the
highest bound comes first, and the search ends where the bound falls under the kth score. Queries are dealt in
blocks. The sample decides only how points are dealt, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from merchlens.operators.spread import top_k
from merchlens.session import settled


def scaled(embedding: str | Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component as a double, or NULL for a vector with a NULL or non-finite component."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(e.isNotNull() & ~bad, F.transform(e, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("double")))


class Splits:
    """A coarse KD-tree: (dimension, value, left, right) per inner node, a cell number per leaf."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self.root = self._grow(sample, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        """Index of an inner node, or minus the cell number less one."""
        if cells > 1 and len(points) > 1:
            spread = points.max(0) - points.min(0) if points.shape[1] else np.zeros(1)
            d = int(spread.argmax())
            if spread[d] > 0:
                cut = float(np.median(points[:, d]))
                right = points[:, d] > cut
                if not right.any():
                    right = points[:, d] >= cut
                    cut = float(points[~right, d].max())
                node = len(self.nodes)
                self.nodes.append((d, cut, 0, 0))
                left_id = self._grow(points[~right], cells // 2)
                self.nodes[node] = (d, cut, left_id, self._grow(points[right], cells - cells // 2))
                return node
        self.cells += 1
        return -self.cells

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while (inner := at >= 0).any():
            for node in np.unique(at[inner]):
                d, cut, left, right = self.nodes[node]
                here = at == node
                at[here] = np.where(points[here, d] > cut, right, left)
        return -at - 1


@dataclass
class Tree:
    """A KD-tree over points: rows in leaf order, and per node its box, its rows and its children (-1 at a leaf)."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    span: list[tuple[int, int]]
    child: list[tuple[int, int]]

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int = 256) -> Tree:
        order, low, high, span, child = np.arange(len(points)), [], [], [], []
        work = [(0, len(points), -1, 0)]
        while work:
            start, end, parent, side = work.pop()
            here = points[order[start:end]]
            low.append(here.min(0))
            high.append(here.max(0))
            span.append((start, end))
            child.append((-1, -1))
            me = len(span) - 1
            if parent >= 0:
                child[parent] = (me, child[parent][1]) if side == 0 else (child[parent][0], me)
            width = high[me] - low[me]
            if end - start > leaf and len(width) and width.max() > 0:
                middle = (end - start) // 2
                by = np.argpartition(here[:, int(width.argmax())], middle)
                order[start:end] = order[start:end][by]
                work += [(start, start + middle, me, 0), (start + middle, end, me, 1)]
        return cls(points[order], order, np.array(low), np.array(high), span, child)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that each node's box allows with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, ids: list[np.ndarray], k: int, kth: float) -> list[tuple[int, int]]:
        """(-score, id) of the best k rows at or above the kth score so far, best first, ties to smaller ids."""
        _, found, scores = self.search_all(query[None], bound[None], ids, k, np.array([kth]))
        return [(-int(s), int(i)) for s, i in zip(scores, found)]

    def search_all(
        self, queries: np.ndarray, bounds: np.ndarray, ids: list[np.ndarray], k: int, kth: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, id, score) of what ``search`` finds for each query, in the order of rows.

        Each query goes to its best leaf first. Then the leaves follow by their highest bound, and the queries whose kth
        score a leaf can still reach meet it in one product.
        """
        leaves = [n for n, (left, _) in enumerate(self.child) if left < 0]
        bounds, kth = bounds[:, leaves], kth.astype(float)
        first, highest = bounds.argmax(1), bounds.max(0)
        best = np.full((len(queries), k), -np.inf)
        least = np.array([i[0] for i in ids])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(leaf: int, rows: np.ndarray) -> None:
            start, end = self.span[leaves[leaf]]
            scores = queries[rows] @ self.points[start:end].T
            hit, place = np.nonzero(scores >= kth[rows][:, None])
            if not len(hit):
                return
            found.append((rows[hit], self.order[start + place], scores[hit, place]))
            some = np.unique(hit)
            top = np.concatenate([best[rows[some]], scores[some]], axis=1)
            top.partition(top.shape[1] - k, axis=1)
            best[rows[some]] = top[:, -k:]
            kth[rows[some]] = np.maximum(kth[rows[some]], top[:, -k])
            if sum(len(f[0]) for f in found) > HELD:
                found[:] = [kept()]

        def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The first k points of each query; every point has an id, so the first k ids are theirs."""
            row, point, score = (np.concatenate(c) for c in zip(*found))
            at = np.flatnonzero(score >= kth[row])
            at = at[_firsts(row[at], score[at], least[point[at]], k)]
            return row[at], point[at], score[at]

        for leaf in np.unique(first):
            visit(leaf, np.flatnonzero(first == leaf))
        for leaf in np.argsort(-highest, kind="stable"):
            if highest[leaf] < kth.min():
                break
            rows = np.flatnonzero((bounds[:, leaf] >= kth) & (first != leaf))
            if len(rows):
                visit(leaf, rows)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        row, point, score = kept()
        times = np.array([len(ids[p]) for p in point])
        row, score, names = np.repeat(row, times), np.repeat(score, times), np.concatenate([ids[p] for p in point])
        at = _firsts(row, score, names, k)
        return row[at], names[at], score[at]


#: Hits that a search holds at once; beyond that it keeps the first of each query only.
HELD = 1 << 21


def _firsts(row: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each row by falling score, ties by name."""
    order = np.lexsort((name, -score, row))
    ordered = row[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    place = np.arange(len(ordered)) - np.repeat(begin, np.diff(np.r_[begin, len(ordered)]))
    return order[place < k]


def _searched(queries: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    out = [(np.empty(0, np.int64),) * 3]
    if len(queries) and len(points):
        tree = Tree.grow(np.stack(points["x"].to_list()).astype(float))
        ids = points["ids"].to_list()
        asked = np.stack(queries["x"].to_list()).astype(float)
        names, kths = queries["point"].to_numpy(), queries["kth"].to_numpy()
        for start in range(0, len(asked), 1024):
            part = asked[start : start + 1024]
            row, found, scores = tree.search_all(part, tree.bounds(part), ids, k, kths[start : start + 1024])
            out.append((names[start + row], found, scores.astype(np.int64)))
    return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query", "vec_id", "score"), zip(*out))})


_HITS = "query long, vec_id long, score long"


def _search(queries: DataFrame, points: DataFrame, blocks: int, k: int) -> DataFrame:
    """Best rows of each query in each shard. ``queries(cell, point, x, kth)``, ``points(cell, shard, x, ids)``.

    Points are met once per block of queries and queries once per shard, so no group holds more than a shard and
    a block.
    """
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int"))
    # A row per 16,384 points. The queries' files are many times smaller than their rows, so Spark would send those instead.
    shards = F.broadcast(points.select("cell", "shard").distinct())
    # Fresh names for both sides: they come from the same table.
    left = dealt.join(shards, "cell").select(*[F.col(c).alias(c) for c in ("cell", "shard", "block", "point", "x", "kth")])
    right = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        *[F.col(c).alias(c) for c in ("cell", "shard", "block", "x", "ids")]
    )
    keys = ["cell", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, p: _searched(q, p, k), _HITS)


def _cells(points: DataFrame, trees: dict[int, Splits], starts: dict[int, int]) -> DataFrame:
    """``points`` with a cell number, unique over all vector lengths."""
    schema = f"cell int, {', '.join(f'{n} {t}' for n, t in points.dtypes)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            cell = np.full(len(sizes), 0, np.int32)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                tree = trees.get(int(dim))
                if tree is not None and dim:
                    x = batch.column("x").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                    cell[rows] = starts[int(dim)] + tree.cell(x)
                elif tree is not None:
                    cell[rows] = starts[int(dim)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", *batch.schema.names])

    return points.mapInArrow(run, schema)


def _boxes(points: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Low and high corner of each cell. There are at most ``cells`` cells, and one more for each further length."""
    low = F.transform(F.col("x"), lambda v: v)
    parts = points.select("cell", F.posexplode(low).alias("d", "v")).groupBy("cell", "d").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    rows = parts.orderBy("cell", "d").toArrow().to_pandas()
    return {int(c): (g["a"].to_numpy(), g["b"].to_numpy()) for c, g in rows.groupby("cell", sort=False)}


def top_scores(
    vectors: DataFrame, query: Column, k: int = 20, factor: int = 64, shard: int = 16_384, block: int = 8_192,
    cells: int = 256, sample: int = 32_768, sent: int = 16_384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all other rows.

    ``vectors(vec_id, embedding)``; ``query`` picks the query rows by ``vec_id``. Components are floor(factor * x).
    Ties go to the smaller vec_id. Vectors that are NULL or hold a NULL or non-finite component, and rows without
    an id, take no part. Rows that repeat an id count once, with the smallest vector. Vectors meet only vectors of
    their own length. Scores are exact up to 2**53. An empty table gives no rows; other columns are ignored.
    ``sample`` bounds the vectors the coarse tree is fitted on, ``cells`` its leaves, ``sent`` the rows that go on to other
    cells at a time.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled("embedding", factor).alias("x"))
    one = rows.filter("vec_id is not null and x is not null").groupBy("vec_id").agg(F.min("x").alias("x"))
    one = settled(one, "knn-rows")
    # k others and the query itself: no more ids of one vector can be in an answer.
    firsts = top_k(one, ["x"], [F.col("vec_id")], k + 1).groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = settled(firsts.select(F.get("ids", F.lit(0)).alias("point"), F.size("x").alias("dim"), "x", "ids"), "knn-points")
    total = points.count()
    picked = points.orderBy(F.xxhash64("point"), "point").limit(sample).select("dim", "x").toArrow()
    by_dim: dict[int, list[np.ndarray]] = {}
    for dim, x in zip(picked.column("dim").to_pylist(), picked.column("x").to_pylist()):
        by_dim.setdefault(dim, []).append(np.array(x, float))
    trees, starts, used = {}, {}, 1  # cell 0: lengths that the sample has not met
    for dim, xs in sorted(by_dim.items()):
        share = max(1, min(cells, -(-total // shard)) * len(xs) // max(1, picked.num_rows))
        trees[dim] = Splits(np.stack(xs), share)
        starts[dim], used = used, used + trees[dim].cells
    per_cell = -(-total // max(1, used - 1))
    shards = max(1, -(-per_cell // (2 * shard)))
    celled = settled(
        _cells(points, trees, starts).withColumn("cell", F.when(F.col("cell") == 0, -F.col("dim") - 1).otherwise(F.col("cell")))
        .withColumn("shard", F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int")),
        "knn-cells",
    )
    by_x = celled.select("x", "point").hint("merge")  # Never sent whole: its files are many times smaller than its rows.
    queries = settled(one.filter(query).hint("merge").join(by_x, "x").select("vec_id", "point"), "knn-queries")
    asked = settled(celled.join(queries.select("point").distinct(), "point", "left_semi"), "knn-asked")
    blocks = max(1, -(-asked.count() // block))
    empty = F.lit(float("-inf"))
    near = settled(_search(asked.select("cell", "point", "x", empty.alias("kth")), celled, blocks, k + 1), "knn-near")
    at = top_k(near.withColumnRenamed("query", "point"), ["point"], [F.col("score").desc(), "vec_id"], k + 1).groupBy("point").agg(
        F.when(F.count("*") > k, F.min("score").cast("double")).otherwise(empty).alias("kth")
    )
    boxes = _boxes(celled)
    shared = vectors.sparkSession.sparkContext.broadcast(boxes)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every other cell of the same length whose box can hold the kth score."""
        corner: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for cell, (low, high) in shared.value.items():
            corner.setdefault(len(low), []).append((cell, low, high))
        for batch in batches:
            sizes, kths, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "kth", "cell"))
            for dim in np.unique(sizes):
                known = corner.get(int(dim), [])
                rows = np.flatnonzero(sizes == dim)
                if not known or not dim:
                    continue
                x = batch.column("x").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                names = np.array([c for c, _, _ in known], np.int32)
                bound = np.maximum(x, 0) @ np.stack([h for _, _, h in known]).T + np.minimum(x, 0) @ np.stack([lo for _, lo, _ in known]).T
                q, c = np.nonzero((bound >= kths[rows][:, None]) & (names[None, :] != own[rows][:, None]))
                for start in range(0, len(q), sent):
                    took = batch.take(pa.array(rows[q[start : start + sent]])).select(["point", "x", "kth"])
                    there = pa.array(names[c[start : start + sent]])
                    yield pa.RecordBatch.from_arrays([there, *took.columns], names=["cell", "point", "x", "kth"])

    travelling = asked.select("cell", "point", "dim", "x").join(at, "point", "left").withColumn("kth", F.coalesce("kth", empty))
    onward = travelling.select("cell", "point", "dim", "x", "kth").mapInArrow(reach, "cell int, point long, x array<double>, kth double")
    far = _search(settled(onward, "knn-onward"), celled, blocks, k + 1)
    hits = near.unionByName(far).withColumnRenamed("query", "point")
    best = settled(top_k(hits, ["point"], [F.col("score").desc(), F.col("vec_id")], k + 1).drop("rank"), "knn-best")
    theirs = queries.withColumnRenamed("vec_id", "query_id").join(best, "point").filter("query_id <> vec_id")
    return top_k(theirs, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
