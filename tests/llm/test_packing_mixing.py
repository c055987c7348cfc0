import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from merchlens.llm import mixing, packing
from merchlens.llm.tokens import WordTokenizer
from tests.conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def ids_of(whole, text):
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check_packed(whole, docs, pieces, capacity):
    want = sorted(((d, ids_of(whole, t).tobytes()) for d, t in docs), key=repr)
    got, runs, spent = {}, {}, 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == runs.get(p.sequence_id, 0)
        runs[p.sequence_id] = p.offset + p.length
    assert all(0 < n <= capacity for n in runs.values())
    spent = sum(capacity - n for n in runs.values() if n & (n - 1))
    by_id = {}
    for d, raw in want:
        by_id.setdefault(d, []).append(np.frombuffer(raw, "<u4"))
    for p in pieces:
        fits = [i for i in by_id[p.doc_id] if len(i) == p.doc_tokens]
        assert any(zlib.crc32(i[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for i in fits)
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == {d: sum(map(len, i)) for d, i in by_id.items()}
    return spent


def test_words_give_the_tokenizers_ids(whole):
    words = WordTokenizer(PATH, keep=50)
    texts = [
        "Plain words, twice: plain words.", "Ünï côdé straße ÀÉ ÿ ß", "it's don't I'LL 'tis", "a1b22 3.4%*** ((x))",
        "é ﬁ İstanbul ²³ ½ 東京 🙂", "<|endoftext|> a<|startoftext|>b <| x", "tab\tnew\nline\x0bv\x0cf em nb", "q" * 300, "",
    ]
    for text in texts * 2:
        assert words.ids(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_tokenizer_remembers_a_bounded_number_of_pieces(whole):
    words = WordTokenizer(PATH)
    text = " ".join(f"{a}{b}{c}{d}x,y" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" for d in "abcdefghijklmnopqrst")
    assert len(words.ids(text.encode())) > 160_000
    assert len(words._pieces.young) + len(words._pieces.old) <= 100_000
    assert words.ids(text[:7_000].encode()).tolist() == whole.encode(text[:7_000], add_special_tokens=False).ids


def test_pieces_cover_every_document_once_without_padding(spark, whole):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert check_packed(whole, texts, packing.pack(docs, PATH).collect(), 4096) == 0
    few = packing.pack(docs.repartition(3), PATH, capacity=512, max_open=4).collect()
    assert check_packed(whole, texts, few, 512) == 0


def test_packing_odd_rows(odd_docs, no_docs, whole):
    texts = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert check_packed(whole, texts, packing.pack(odd_docs, PATH).collect(), 4096) == 0
    assert packing.pack(no_docs, PATH).count() == 0


def test_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(300):
        packer = packing.LevelPacker(16)
        packer.counts[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))
        level = packer.level_for(size)

        def cost(at, packer=packer, size=size):
            after = packer.counts[1:17].astype(int).copy()
            if at:
                after[at - 1] -= 1
            after[at + size - 1] += 1
            return int((after[:15] ** 2).sum())

        choices = [0, *[h for h in range(1, 17 - size) if packer.counts[h]]]
        assert cost(level) == min(map(cost, choices))


def brute_targets(sizes, weights, most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s: weight[s] for s in sizes if s not in fixed}
        spare = total - sum(fixed.values())
        share = {s: spare * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in share if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 5 < 3, "hot").when(F.col("doc_id") % 50 == 3, "tiny").when(F.col("doc_id") % 5 == 3, None).otherwise("é"))
    rows = mixing.mix(docs, budgets=(0.5, 1.0)).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes, (1, 2, 3))
    longest = max(r.size for r in rows)
    for source, size in sizes.items():
        mine = [r for r in rows if r.source == source]
        assert {r.source_size for r in mine} == {size}
        assert all(abs(r.target - want[source]) < 1e-6 * want[source] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[source]) <= longest
        assert all(r.taken <= 3 * r.size and r.nested[0] <= r.nested[1] == r.taken for r in mine)
    again = mixing.mix(docs.repartition(7), budgets=(0.5, 1.0))
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in rows)


def test_mix_takes_rows_as_often(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted((r.doc_id, r.copies) for r in mixing.mix(docs).collect() if r.copies)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert sorted(tuple(r) for r in rows.groupBy("doc_id").count().collect()) == want


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.size for r in rows) == sorted(len((t[0] or "").encode().split()) for t in odd_docs.select("text").collect())
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0
    blank = odd_docs.filter("doc_id in (3, 4)")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]
