import numpy as np
from pyspark.sql import functions as F

from merchlens.llm import topk
from tests.conftest import SMALL


def brute(rows, k=20):
    vectors = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        x = [float(np.floor(64 * float(a))) for a in e]
        vectors[i] = min(vectors[i], x) if i in vectors else x
    out = []
    for q, x in vectors.items():
        if q % 20 == 0:
            best = sorted((-int(np.dot(x, y)), j) for j, y in vectors.items() if j != q and len(x) == len(y))[:k]
            out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_small_table_equals_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = topk.top_scores(table, F.col("vec_id") % 20 == 0, shard=128, cells=8, block=16)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(200)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(300, 460)]  # a third of all rows
    rows += [
        (500, None), (501, [1.0, None, 2.0]), (502, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (504, []),
        (505, [1.0]), (520, [2.0, 1.0]), (540, []), (0, [9.0, 9.0, 9.0]), (560, [0.1, 0.2, float("inf")]),
    ]
    df = spark.createDataFrame([(i, e, i, "q") for i, e in rows], "vec_id long, embedding array<double>, point long, x string")
    got = topk.top_scores(df, F.col("vec_id") % 20 == 0, shard=32, cells=8, block=8)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert topk.top_scores(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_prunes_clustered_points():
    rng = np.random.default_rng(3)
    points = np.floor(np.vstack([rng.normal(c, 1, (500, 4)) for c in (-60, -20, 20, 60)]))
    tree = topk.Tree.grow(points, leaf=16)
    seen = []
    ids = [np.array([i]) for i in range(len(points))]
    query = np.array([1.0, 1.0, 1.0, 1.0])
    original = tree.points
    tree.points = type("Seen", (), {"__getitem__": lambda s, at: (seen.append(at), original[at])[1]})()
    best = tree.search(query, tree.bounds(query[None])[0], ids, 5, float("-inf"))
    assert best == sorted((-int(p @ query), i) for i, p in enumerate(points))[:5]
    assert len(seen) < 20  # of at least 125 leaves


def test_queries_are_not_sent_to_all_executors(spark):
    asked = spark.createDataFrame([(0, i, [1.0, 2.0], 0.0) for i in range(3)], "cell int, point long, x array<double>, kth double")
    points = spark.createDataFrame(
        [(0, i % 2, [float(i), 1.0], [i]) for i in range(500)], "cell int, shard int, x array<double>, ids array<long>"
    )
    far = topk._search(asked, points, 2, 3)
    text = far._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in text and "BuildLeft" not in text
    assert sorted({r.vec_id for r in far.collect()}) == [494, 495, 496, 497, 498, 499]


def test_rows_that_go_on_come_in_small_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_scores(df, F.col("vec_id") % 20 == 0, shard=32, cells=16, block=16, sent=7)
    assert sorted(map(tuple, got.collect())) == brute(rows)
