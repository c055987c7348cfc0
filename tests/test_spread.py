import random

import pytest
from pyspark.sql import functions as F

from merchlens.operators.spread import following, hot_keys, join_salted, latest_by, running, seq_chunk, top_k
from tests.conftest import answers


@pytest.fixture(scope="module")
def log():
    """One key holds most rows."""
    rng = random.Random(7)
    return [(seq, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(-5, 6)) for seq in range(400)]


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize("exclude", [False, True])
def test_running_does_not_depend_on_chunks(rows, log, size, exclude):
    df = rows("seq long, key string, v long", *log)
    folds = {"total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}
    got = answers(running(df, ["key"], [F.col("seq")], seq_chunk("seq", size), folds, exclude))
    seen, want = {}, []
    for seq, key, v in log:
        past = seen.setdefault(key, [])
        base = past if exclude else [*past, v]
        want.append((seq, key, v, sum(base), min(base, default=None), max(base, default=None)))
        past.append(v)
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("size", [1, 13, 1000])
def test_following(rows, log, size):
    df = rows("seq long, key string, v long", *log)
    got = answers(following(df, ["key"], [F.col("seq")], seq_chunk("seq", size), {"nxt": F.col("v")}))
    after, want = {}, []
    for seq, key, v in reversed(log):
        want.append((seq, key, v, after.get(key)))
        after[key] = v
    assert got == sorted(want, key=repr)


def test_latest_by(rows):
    df = rows("k string, at int, v string", ("a", 1, "x"), ("a", 2, None), ("b", 5, "z"))
    assert answers(latest_by(df, ["k"], [F.col("at")])) == [("a", 2, None), ("b", 5, "z")]
    assert answers(latest_by(df, ["k"], [F.col("at")], earliest=True)) == [("a", 1, "x"), ("b", 5, "z")]


def test_top_k_is_trimmed_before_the_shuffle(rows):
    df = rows("k string, v int", *[("a", i) for i in range(50)])
    best = top_k(df, ["k"], [F.col("v").desc()], 3)
    assert [r.v for r in best.orderBy("rank").collect()] == [49, 48, 47]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_hot_keys_are_dealt_out(spark, rows):
    """One key holds all but a few rows: its rows meet the other side in many places, and none is lost."""
    many = spark.range(5000).select("id", F.when(F.col("id") < 4900, "hot").when(F.col("id") < 4990, F.col("id").cast("string")).alias("key"))
    few = rows("key string, name string", ("hot", "a"), ("hot", "b"), ("4950", "c"), ("none", "d"), (None, "e"))
    want = answers(many.join(few, "key"), "id", "name")
    assert len(want) == 9801 and answers(join_salted(many, few, "key", ["id"], share=20), "id", "name") == want
    hot = hot_keys(many, "key", share=20).collect()
    assert [(r.key, r.salts) for r in hot] == [("hot", 20)]
    assert answers(join_salted(many.limit(0), few, "key", ["id"])) == [] == answers(join_salted(many, few.limit(0), "key", ["id"]))
