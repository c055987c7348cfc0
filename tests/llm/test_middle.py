import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.llm import middle
from tests.conftest import SMALL


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:p], text[p:q], text[q:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, p, q - p, sha(out), sha(text)


def test_index_is_exact_within_its_error():
    rng = random.Random(1)
    texts = ["", "a", "é", "日本", "a" * 5000, "é" * 5000, ("a" * 700 + "日" * 700) * 9]
    texts += ["".join(rng.choice("ab é日😀") for _ in range(rng.randint(0, 3000))) for _ in range(60)]
    for text in texts:
        data = text.encode()
        places = middle.boundaries(data)
        want = [len(text[:i].encode()) for i in range(len(text) + 1)] if len(text) < 400 else None
        assert want is None or list(places) == want
        for error in (1, 7, 100, 126):
            index = middle.RankIndex.fit(places, error)
            assert [index.place(r) for r in range(0, len(places), 17)] == list(places[::17])
            assert max(abs(index.predicted(r) - places[r]) for r in range(0, len(places), 17)) <= error + 1
            assert np.abs(index.residuals.astype(int)).max() <= error + 1
    assert len(middle.RankIndex.fit(middle.boundaries(b"a" * 200_000)).ranks) == 1
    assert len(middle.RankIndex.fit(middle.boundaries(("a" * 700 + "日" * 700).encode() * 9), 10).ranks) > 9
    with pytest.raises(ValueError):
        middle.RankIndex.fit(np.arange(3), 200)


def test_bytes_that_are_no_utf8_lose_nothing():
    for data in (b"\x80\x80", b"\x80a\xff", b"a\x80\x80"):
        places = middle.boundaries(data)
        assert places[0] == 0 and places[-1] == len(data) and (np.diff(places) > 0).all()


def test_whole_table_equals_brute_force(spark, odd_docs, no_docs):
    more = [(100, "a <P> b"), (101, "<S"), (102, "x<M>"), (103, "<" * 50), (104, "S>" * 40)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("output", F.lit("own")).withColumn("h1", F.lit(1))
    want = [brute(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, middle.digests(docs).collect()), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert middle.digests(no_docs).count() == 0


def test_small_batches_and_texts_come_back(spark):
    docs = spark.createDataFrame([(i, "né日 " * (i % 40)) for i in range(300)], "doc_id long, text string")
    made = middle.fill_in_middle(docs, rate=100, held_bytes=1)
    back = made.withColumn("text", middle.restored(F.col("output"), F.col("form"))).select("doc_id", "text")
    assert sorted(back.collect()) == sorted(docs.collect())
    assert made.filter("form = 'plain' and n > 0").count() == 0
