import math
import random
import re

import pytest
from pyspark.sql import functions as F

from merchlens.operators import search as S
from tests.conftest import answers


@pytest.fixture(scope="module")
def corpus():
    """'the' is in nearly every document, others are rare."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(200):
        words = ["the"] * rng.randrange(0, 6) + ["of"] * rng.randrange(0, 3) + rng.choices(vocabulary, k=rng.randrange(3, 30))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
    queries = [(0, "the of"), (1, "the w1 w2 w3 of"), (2, "w5"), (3, "unknown"), (4, "The W7, w8; the w9 of the w10 w11")]
    return docs, queries


def brute(docs, queries, k, allowed=None):
    tokens = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    n, avgdl = len(docs), sum(len(t) for t in tokens.values()) / len(docs)
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, text in queries:
        scores = []
        for i, t in tokens.items():
            hit = [w for w in set(re.findall(r"\w+", text.lower())) if w in t]
            if hit and (allowed is None or i in allowed):
                s = sum(
                    math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
                    for w in hit
                )
                scores.append((-round(s, 6), i))
        out += [(q, r + 1, i) for r, (_, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_search_is_exact(rows, corpus, k):
    docs, queries = corpus
    index = S.build_index(rows("id long, text string", *docs), "id", "text")
    asked = rows("query_id long, text string", *queries)
    assert answers(S.search(index, asked, k), "query_id", "rank", "id") == brute(docs, queries, k)


def test_allowed_limits_answers_not_statistics(rows, corpus):
    docs, queries = corpus
    index = S.build_index(rows("id long, text string", *docs), "id", "text")
    some = set(range(0, 200, 3))
    got = S.search(index, rows("query_id long, text string", *queries), 5, rows("id long", *[(i,) for i in some]))
    assert answers(got, "query_id", "rank", "id") == brute(docs, queries, 5, some)


def test_append_skips_known_documents(rows, corpus):
    docs, _ = corpus
    half = S.build_index(rows("id long, text string", *docs[:120]), "id", "text")
    whole = S.append_index(half, rows("id long, text string", *docs), "id", "text")
    straight = S.build_index(rows("id long, text string", *docs), "id", "text")
    assert answers(whole.postings) == answers(straight.postings)
    assert answers(whole.docs) == answers(straight.docs)


def test_exclude_term(rows):
    docs = rows("product_id long, text string", (1, "has Paraben inside"), (1, "nothing"), (2, "free of it"), (3, None))
    index = S.build_index(docs, "product_id", "text")
    kept = S.exclude_term(rows("product_id long", (1,), (2,), (3,)), index.postings, "paraben")
    assert answers(kept) == [(2,), (3,)]


def test_fallback_only_for_unanswered_queries(rows):
    index = S.build_index(rows("id long, text string", (1, "rose oil"), (2, "rose water")), "id", "text")
    got = S.search_with_fallback(rows("query_id long, id long", (10, 2)), index, rows("query_id long, text string", (10, "oil"), (11, "oil")))
    assert answers(got, "query_id", "id", "source") == [(10, 2, "filter"), (11, 1, "text")]


def test_empty_text_has_length_zero(rows):
    index = S.build_index(rows("id long, text string", (1, ""), (2, None), (3, "a b a")), "id", "text")
    assert answers(index.docs) == [(1, 0), (2, 0), (3, 3)]
    assert answers(index.postings, "id", "term", "tf") == [(3, "a", 2), (3, "b", 1)]
    assert S.term_stats(index).agg(F.sum("cf")).first()[0] == 3


def test_postings_leave_the_scan_without_a_shuffle(rows):
    index = S.build_index(rows("id long, text string", (1, "b a b"), (2, None), (3, "a")), "id", "text")
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    assert answers(index.postings) == [(1, "a", 1, 3), (1, "b", 2, 3), (3, "a", 1, 1)]


def test_rows_that_share_an_id_are_one_document_by_length(rows, monkeypatch):
    docs = rows("id long, text string", (1, "a b"), (1, "B a"), (1, "a"), (None, "x y"), (None, "y z"), (2, "a a"))
    want = sorted([(1, "a", 2, 2), (1, "b", 2, 2), (1, "a", 1, 1), (None, "x", 1, 2), (None, "y", 2, 2), (None, "z", 1, 2), (2, "a", 2, 2)], key=repr)
    assert answers(S.postings_of(docs, "id", "text")) == want
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    assert answers(S.postings_of(docs, "id", "text")) == want


@pytest.mark.parametrize("name, value", [("TASK_MEETINGS", 100), ("BROADCAST_ROWS", 0)])
def test_search_is_exact_over_many_tasks_and_without_broadcast(rows, corpus, monkeypatch, name, value):
    monkeypatch.setattr(S, name, value)
    docs, queries = corpus
    index = S.build_index(rows("id long, text string", *docs), "id", "text")
    some = set(range(0, 200, 3))
    got = S.search(index, rows("query_id long, text string", *queries), 5, rows("id long", *[(i,) for i in some]))
    assert answers(got, "query_id", "rank", "id") == brute(docs, queries, 5, some)
