"""Exact vector search: a query set against all points, in blocks, as matrix products.

Measured on 64-number vectors, bounds by pivots or boxes leave 93 to 99.7 % of all pairs, so nothing is pruned here.
Queries are dealt into blocks and points into pieces of a bounded size; every block meets every piece once, on ids
and vectors only, and sends on at most ``k`` rows per query. The work is the product of both sizes; what a task holds
is bounded by BLOCK and PIECE. Products are taken in single precision first; what they cannot rule out, with their
greatest possible error, is scored in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from merchlens.operators.spread import top_k

#: Most queries and points that meet in one task.
BLOCK, PIECE = 65_536, 65_536
#: Tasks that are made where each of them has at least so many pairs.
TASKS, PAIRS = 12, 1 << 27
#: Queries and points whose products are held at once, and pairs that are scored at once.
TILE, RUN, SCORED = 128, 16_384, 32_768

_FOUND = "query_id long, embedding_id long, customer_id long, score double"


def misfit(vector: Column, dim: int) -> Column:
    """Why a vector cannot take part in a search of ``dim`` numbers, or NULL."""
    return F.when(vector.isNull() | (F.size(vector) != dim), f"Embedding must have {dim} numbers").when(
        F.exists(vector, lambda x: x.isNull() | F.isnan(x)), "Embedding has gaps"
    )


def misfits(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """The rows that a search leaves out, each with its ``error``."""
    return rows.withColumn("error", misfit(F.col(vector), dim)).filter("error IS NOT NULL")


def _grid(queries: DataFrame, points: DataFrame) -> tuple[Column, Column]:
    """How many blocks and pieces two tables make; scalar subqueries, worked out in the same plan.

    No more tasks than the sizes and TASKS ask for; their grid is the one that repeats the fewest rows.
    """
    asked, there = (df.agg(F.count("*").cast("double").alias("n")).scalar() for df in (queries, points))
    tasks = F.greatest(asked * there / (BLOCK * PIECE), F.least(F.lit(float(TASKS)), asked * there / PAIRS))
    even = F.coalesce(F.round(F.sqrt(F.try_divide(tasks * asked, there))), F.lit(1.0))
    blocks = F.greatest(F.lit(1.0), F.ceil(asked / BLOCK).cast("double"), F.least(even, asked))
    pieces = F.greatest(F.lit(1.0), F.ceil(there / PIECE).cast("double"), F.ceil(tasks / blocks).cast("double"))
    return blocks.cast("int"), pieces.cast("int")


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


class _Piece:
    """Points by customer and id, met by tiles of queries. Scores are rounded to ``places``, ties go to the first point."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, who: np.ndarray, widest: float, cosine: bool, places: int):
        squares = np.einsum("ij,ij->i", points, points)
        order = np.lexsort((ids, who))
        self.order = order[np.isfinite(squares[order])]
        self.points, self.who, self.cosine, self.step = points, who, cosine, 10.0**-places
        squares = squares[self.order]
        longest = np.sqrt(squares.max()) if len(squares) else 0.0
        kind = np.float32 if max(widest, longest) < 1e15 else np.float64
        self.right = np.empty((points.shape[1] + (not cosine), len(self.order)), kind)
        self.right[: points.shape[1]] = points[self.order].T
        if not cosine:
            self.right[-1] = squares
        # What rounding can add up to in a product, and in the comparison after it.
        self.error = 4.0 * (points.shape[1] + 4) * float(np.finfo(kind).eps) * (widest + longest) ** 2 + 1e-30

    def _exact(self, tile: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for start in range(0, len(row), SCORED):
            q, p = tile[row[start : start + SCORED]], self.points[self.order[at[start : start + SCORED]]]
            out[start : start + SCORED] = np.einsum("ij,ij->i", q, p) if self.cosine else -np.sqrt(((q - p) ** 2).sum(1))
        return out

    def best(self, tile: np.ndarray, k: int, limit: float | None, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, point, score) of the first ``k`` points of each row of ``tile``."""
        length = np.einsum("ij,ij->i", tile, tile)
        left = (tile if self.cosine else np.hstack([2 * tile, np.full((len(tile), 1), -1.0)])).astype(self.right.dtype)

        def least(score: np.ndarray) -> np.ndarray:
            """The product under which no score of at least ``score`` lies."""
            reach = score if self.cosine else np.where(score > 0, np.inf, length - np.minimum(score, 0) ** 2)
            return reach - self.error

        need = np.full(len(tile), -np.inf if limit is None else limit)
        row, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for start in range(0, len(self.order), RUN):
            near = left @ self.right[:, start : start + RUN]
            if not start and limit is None and near.shape[1] > k:
                if own is not None:
                    near[own[:, None] == self.who[self.order[:RUN]][None, :]] = -np.inf
                kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k].astype(float) - self.error
                need = (kth if self.cosine else -np.sqrt(np.maximum(length - kth, 0))) - self.step
            floor = least(need).astype(near.dtype)
            hit, place = np.divmod(np.flatnonzero((near >= floor[:, None]).ravel()), near.shape[1])
            place += start
            if own is not None:
                other = own[hit] != self.who[self.order[place]]
                hit, place = hit[other], place[other]
            if not len(hit):
                continue
            exact = self._exact(tile, hit, place)
            good = (exact > -np.inf) if limit is None else (exact >= limit)
            row, at, score = (np.concatenate(c) for c in ((row, hit[good]), (at, place[good]), (score, exact[good])))
            rounded = np.floor(score / self.step + 0.5)
            order = np.lexsort((at, -rounded, row))
            ordered = row[order]
            begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])[: len(ordered)]
            rank = np.arange(len(ordered)) - np.repeat(begin, np.diff(np.r_[begin, len(ordered)]))
            last = order[rank == k - 1]
            # Later points lose ties, so they must round to more than the last of k.
            need[row[last]] = np.maximum(need[row[last]], (rounded[last] + 0.5) * self.step - 1e-9)
            order = order[rank < k]
            row, at, score = row[order], at[order], score[order]
        return row, self.order[at], score


def _meet(cosine: bool, k: int, limit: float | None, differ: bool, places: int):
    """Best rows of each query of a block among the points of a piece, ranked by rounded score, customer and id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(*[np.empty(0, np.int64)] * 3, np.empty(0))]
        if left.num_rows and right.num_rows:
            q = _matrix(left)
            length = np.sqrt(np.einsum("ij,ij->i", q, q))
            usable = np.flatnonzero(np.isfinite(length))
            ids, who = right.column("embedding_id").to_numpy(), right.column("customer_id").to_numpy()
            names = left.column("query_id").to_numpy()
            own = left.column("own").to_numpy() if differ else None
            piece = _Piece(_matrix(right), ids, who, float(length[usable].max(initial=0.0)), cosine, places)
            for start in range(0, len(usable), TILE):
                some = usable[start : start + TILE]
                row, at, score = piece.best(q[some], k, limit, None if own is None else own[some])
                out.append((names[some[row]], ids[at], who[at], score))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["query_id", "embedding_id", "customer_id", "score"])

    return run


def search(
    queries: DataFrame, points: DataFrame, dim: int, k: int, cosine: bool, limit: float | None = None, differ: bool = False
) -> DataFrame:
    """(query_id, rank, embedding_id, customer_id, score): the ``k`` best points of every query.

    ``queries(query_id, v)``, with ``own`` where ``differ`` asks that a point's customer is another;
    ``points(embedding_id, customer_id, v)``. The score is the inner product, or minus the distance where not
    ``cosine``; only scores of at least ``limit`` count. Ties after rounding (6 places of the product, 4 of the
    distance) go to the smaller customer, then id. Rows that ``misfits`` names take no part.
    """
    places = 6 if cosine else 4
    asked, there = (df.filter(misfit(F.col("v"), dim).isNull()) for df in (queries, points))
    blocks, pieces = _grid(asked, there)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).withColumn("piece", every(pieces))
    right = there.withColumn("piece", F.pmod(F.xxhash64("embedding_id"), pieces).cast("int")).withColumn("block", every(blocks))
    keys = ["block", "piece"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(cosine, k, limit, differ, places), _FOUND)
    rounded = F.round("score", places)
    return top_k(met, ["query_id"], [rounded.desc(), F.col("customer_id").asc(), F.col("embedding_id").asc()], k)
