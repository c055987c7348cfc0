import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.llm import lines, neardup
from tests.conftest import SMALL

WORDS = [f"w{i}" for i in range(30)]


def near(a, b):
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    return max(len(a), len(b)) - p - q <= 1


def brute_lines(docs):
    first, out = {}, []
    for doc, text in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        if text is None:
            out.append((doc, None, 0, 0, 0))
            continue
        kept, count, equal, close = [], 0, 0, 0
        for line in text.split("\n"):
            words = tuple(line.encode().split())
            if not words:
                kept.append(line)
                continue
            count += 1
            seen = words in first
            first.setdefault(words, len(first))
            if any(near(words, other) for other, at in first.items() if at < first[words]):
                close += 1
            elif seen:
                equal += 1
            else:
                kept.append(line)
        out.append((doc, "\n".join(kept), count, equal, close))
    return sorted(out, key=repr)


def edited(words, rng):
    words, at = list(words), rng.randrange(len(words))
    kind = rng.random()
    if kind < 0.3:
        del words[at]
    elif kind < 0.6:
        words.insert(at, rng.choice(WORDS))
    elif kind < 0.9:
        words[at] = rng.choice(WORDS)
    return words


def test_lines_equal_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(3, 14))] for _ in range(50)]
    docs = []
    for doc in range(100):
        some = [rng.choice(base) for _ in range(rng.randint(0, 6))]
        docs.append((doc, "\n".join(" ".join(edited(x, rng)) if rng.random() < 0.7 and x else " ".join(x) for x in some)))
    docs += [
        (None, "a b c d e f g h i"), (200, None), (201, ""), (202, "a b c d e f g h\n\n  \n\ta  b c d e\x0bf g h i \r\nend"),
        (203, " \n"), (204, "z " * 20_000 + "\n" + "z " * 20_001), (205, "x" * 100_000),
    ]
    table = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n_lines int, version int")
    assert sorted(map(tuple, lines.dedup_lines(table).collect()), key=repr) == brute_lines(docs)
    kept = lines.dedup_rows(table).columns
    assert kept == [*table.columns, "__n_lines", "__n_equal", "__n_near"]
    assert lines.dedup_lines(table.limit(0)).count() == 0


def test_repeated_rows_come_out_alike(spark):
    text = "one two three four five six seven eight nine"
    rows = [(1, text), (1, text), (1, text + " ten"), (2, text)]
    got = sorted(tuple(r)[:2] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = min([text, text + " ten"], key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    assert got == sorted([(1, t if t == first else "") for t in (text, text, text + " ten")] + [(2, "")])


def test_no_python_in_line_dedup(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("weights", [(1, 1), (3, 2), (0.3, 0.5)])
def test_signatures_estimate_weighted_similarity(weights):
    elements = neardup.mixed(np.arange(1, 601, dtype=np.uint64))
    a = np.where(np.arange(600) < 300, weights[0], 1.0)
    b = np.where(np.arange(600) < 300, weights[1], 1.0)
    a, b = a[:550], b[50:]
    left, right = (elements[:550], a), (elements[50:], b)
    share = (neardup.signature(*left, 2048) == neardup.signature(*right, 2048)).mean()
    assert abs(share - neardup.similarity(left, right)) < 0.04


def test_small_sets_have_full_signatures():
    for n in (1, 2, 7):
        elements = neardup.mixed(np.arange(n, dtype=np.uint64))
        assert (neardup.signature(elements, np.ones(n), 64) != 0).all()


def brute_classes(docs, least=0.8):
    sets = {}
    for doc, text in docs:
        words = (text or "").encode().lower().split()
        runs = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        sets.setdefault(doc, []).append(runs)
    parent = {d: d for d in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and len(x & y) >= least * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, root(d)) for d in ids)


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rng, more = random.Random(2), []
    base = [rng.choice(WORDS) + str(i % 40) for i in range(120)]
    for i in range(60):  # a chain: neighbours are alike, its ends are not
        base = base[2:] + [f"n{i}", f"m{i}"]
        more.append((5000 + i, " ".join(base)))
    more += [(6000, None), (6001, ""), (6002, " \n"), (6003, "short"), (6004, "SHORT"), (6005, "a b"), (6005, "c d"), (6006, "c d"), (6007, "a b"), (None, "a b"), (6008, "v " * 50_000)]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("class_id", F.lit("q"))
    got = neardup.near_duplicates(table)
    want = brute_classes([tuple(r) for r in table.select("doc_id", "text").collect()])
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == want
    assert neardup.near_duplicates(table.limit(0)).count() == 0
    assert neardup.first_rows(table.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    docs += [(d + 7000, t) for d, t in docs[:20]] + docs[:5] * 3 + [(None, t) for _, t in docs[5:10]] * 2
    docs += [(None, f"alone {i} in the world of words {i}") for i in (1, 1, 2)]
    docs += [(8000, None), (8001, ""), (None, None), (None, ""), (8005, "a b"), (8005, "c d"), (8006, "c d"), (8007, "a b"), (8008, "e f"), (8008, "g h")]
    ids = [d for d, _ in docs]
    plain = [(d, t) for d, t in docs if d is not None and ids.count(d) == 1]
    odd = sorted({(d is not None, d, t or "") for d, t in docs if d is None or ids.count(d) > 1}, key=repr)
    keys = plain + [(max(i for i in ids if i is not None) + 1 + n, t) for n, (_, _, t) in enumerate(odd)]
    text = {k: t for k, t in keys}
    want = sorted((text[c] or "") for c in {c for _, c in brute_classes(keys)})
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.create_map(F.lit("q"), F.lit(1)))
    kept = neardup.first_rows(table)
    assert kept.columns == table.columns
    rows = kept.collect()
    have = sorted((r.text or "") for r in rows)
    assert [t for t in have if t] == [t for t in want if t]  # of near copies any text may be the one of the smallest id
    assert have.count("") == want.count("")
    assert {8006, 8007, 8000, 8001} <= {r.doc_id for r in rows} and sum(r.doc_id == 8008 for r in rows) == 2
    assert sum(r.doc_id is None and (r.text or "").startswith("alone") for r in rows) == 2
