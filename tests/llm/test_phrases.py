import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from merchlens.llm import phrases
from tests.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, share=50, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        chosen = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        gone = {p for w, c in chosen.items() if len(w) == 3 for p in (w[:2], w[1:]) if p in chosen and 100 * c >= share * chosen[p]}
        ranked = []
        for w, a in chosen.items():
            if w not in gone:
                score, k = min((1000000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
                ranked.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def test_trie_bursts_spills_and_loses_nothing():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3):
        trie, want, got = phrases.HatTrie(size, burst=8), Counter(), Counter()
        for _ in range(30):
            ids = rng.integers(1, 12, (200, size))
            keys = np.zeros(200, np.int64)
            for place in range(size):
                keys = keys << 21 | ids[:, place]
            want.update(keys.tolist())
            trie.add(*np.unique(keys, return_counts=True))
            if trie.entries > 100:
                runs = list(trie.spill(50))
                assert trie.entries <= 50
                for keys_, counts in runs:
                    assert (np.diff(keys_) > 0).all()
                    got.update(dict(zip(keys_.tolist(), counts.tolist())))
        for keys_, counts in trie.spill():
            got.update(dict(zip(keys_.tolist(), counts.tolist())))
        assert trie.entries == 0 and got == want
    deep = phrases.HatTrie(3, burst=4)
    deep.add(np.arange(100) | 1 << 42, np.ones(100, np.int64))
    assert type(deep.root) is type(deep.root[1]) is phrases._Node  # burst down to the last word


def test_whole_table_equals_brute_force_under_any_limits(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").unionByName(odd_docs.select("lang", "text"))
    docs = docs.withColumn("phrase", F.lit("own")).withColumn("f", F.lit(1))
    want = brute([tuple(r)[:2] for r in docs.collect()])
    assert len(want) > 50 and {r[0] for r in want} > {"en", "fr"}
    for limits in ({}, {"held": 300, "burst": 16, "step": 500, "words": 200, "bits": 7}):
        assert sorted(map(tuple, phrases.collocations(docs, **limits).collect())) == want
    assert phrases.collocations(no_docs).count() == 0


def test_pieces_ties_and_chunks(spark):
    rng = random.Random(2)
    vocabulary = ["A", "b", "ß", "Straße", "x\xa0y", "<P>", "İ", "z\x00"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "\t", "  ", ".", "\n", " , ", "\x0b"]) for _ in range(rng.randint(0, 400))) for _ in range(80)]
    rows = [(rng.choice(["en", None, "und"]), t) for t in texts] + [("en", None), ("xx", "")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute(rows)
    assert sorted(map(tuple, phrases.collocations(docs, least=3, top=7, step=50, held=40, burst=4).collect())) == brute(rows, least=3, top=7)
    counter = phrases.Counter(2, None, 1 << 20, 4096, 1 << 19, 1 << 19)
    list(counter.read("en", ("one two three. four five " * 40).encode(), chunk=7))  # stretches of a text join
    counted = {b for batch in counter.finish() for b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())}
    assert counted == {(b"one two", 40), (b"two three", 40), (b"four five", 40), (b"five one", 39)}


def test_counts_beyond_64_bits_stay_exact(spark):
    rows = [(10**13 + 7, 10**13 + 9, 10**13 + 11)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select(F.expr("(cast(1000000 as decimal(38, 0)) * a * a) div (cast(l as decimal(38, 0)) * r)").cast("long")).first()[0]
    a, left, right = rows[0]
    assert got == 1000000 * a * a // (left * right)
