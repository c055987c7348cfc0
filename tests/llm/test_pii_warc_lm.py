import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from merchlens.llm import lm, pii, warc
from tests.conftest import SMALL

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def brute_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def test_base_spans_equal_the_expressions():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("aZ0123456789.@-+ (%_\n5é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    for long_ in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "@" * 100_000):
        pii.base_spans(long_)  # in linear time


def test_detect_whole_table(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        spans = brute_spans(r.text or "")
        kinds = Counter(k for k, _, _ in spans)
        want.append((r.doc_id, *[kinds[k] for k in range(4)], hashlib.sha256(written(spans).encode()).hexdigest(), written(spans)))
    got = pii.detect(docs.withColumn("spans", F.lit("q"))).collect()
    assert sorted(map(lambda r: tuple(r)[:6], got), key=repr) == sorted((w[:6] for w in want), key=repr)
    assert pii.detect(no_docs).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"filler{i} my card number 4111 1111 1111 1111 end" if i % 2 else f"other{i} my card number 5500-0000-0000-000{4} x" for i in range(20)]
    texts += [f"word{i} my card number {4000000000000000 + 1000003 * i} end" for i in range(12)]  # some fail the check digit
    texts += ["the order code 4000000000000001 is no card", "call my agent 12345678901"]
    # Distinct seeds: a pattern must be taught by several.
    texts += [f"text{i} my card number {n} end" for i, n in enumerate(x for x in range(4000000000000000, 4000000000000200) if luhn(str(x)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.detect(docs).collect()}
    unseen = [i for i in range(20, 32) if not luhn(str(4000000000000000 + 1000003 * (i - 20)))]
    assert unseen
    for i in unseen:
        number = str(4000000000000000 + 1000003 * (i - 20))
        at = texts[i].index(number)
        assert rows[i].n_card == 0 and rows[i].spans == f"card:{at}:{at + 16}"
    assert rows[32].spans == "" and rows[33].spans == ""


def test_discovered_identifiers_teach_further_patterns(spark):
    """Numbers that only a second pattern precedes are reached over those that both do."""
    good = [str(n) for n in range(4000000000000000, 4000000000000500) if luhn(str(n))]
    bad = [str(n) for n in range(4000000000000000, 4000000000000500) if not luhn(str(n))]
    texts = [f"a{i} card number {n} end" for i, n in enumerate(good[:20])]
    texts += [f"b{i} card number {n} end" for i, n in enumerate(bad[:12])]
    texts += [f"c{i} account ref {n} end" for i, n in enumerate(bad[:12])]
    texts += [f"d{i} account ref {n} end" for i, n in enumerate(bad[50:53])]  # not among the seeds' contexts
    texts += [f"e{i} order code {n} end" for i, n in enumerate(bad[60:80])]
    rows = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        at = text.index("4000")
        assert rows[i] == ("" if text[0] == "e" else f"card:{at}:{at + 16}"), text


def test_rounds_go_on_until_nothing_is_added(spark):
    good = [str(n) for n in range(4000000000000000, 4000000000000500) if luhn(str(n))]
    bad = [str(n) for n in range(4000000000000000, 4000000000000500) if not luhn(str(n))]
    texts = [f"a{i} card number {n} end" for i, n in enumerate(good[:10] + bad[:12])]  # more unseen than seeds
    rows = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(rows[i].startswith("card:") for i in range(len(texts)))


def test_candidates_hold_grouped_and_long_identifiers():
    for number in ("4111 1111 1111 1112", "020 7946 0958", "(171) 555-2028", "+1", "555.20.28", "0171 (0) 5552028", "12 34 56 78 90", "7" * 300, "12345"):
        text = f"I said: number {number}, or so. 300 people"
        want = [number] if number != "+1" else []
        assert [text[s:e] for s, e in pii.candidates(text, [])] == [*want, "300"], number
    assert [("2021. 4000 of them"[s:e]) for s, e in pii.candidates("2021. 4000 of them", [])] == ["2021", "4000"]
    assert pii.candidates("number 4111 1111 1111 1111 x", pii.base_spans("number 4111 1111 1111 1111 x")) == []
    for long_ in ("1 " * 150_000, "1234 " * 100_000, "(" * 300_000, "1(" * 150_000, "1 .-" * 100_000, "123456789 " * 50_000):
        pii.candidates(long_, [])  # in linear time


def test_grouped_identifiers_are_found_after_taught_contexts(spark):
    texts = [f"a{i} call her under +44 20 7946 {1000 + i} end" for i in range(40)]
    texts += [f"b{i} call her under {n} end" for i, n in enumerate(("020 7946 0958", "(171) 555-2028", "555.20.28", "0171 5552028"))]
    rows = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        start = text.index("under ") + 6
        assert rows[i] == f"phone:{start}:{len(text) - 4}", text


def brute_archive(rows):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        of = first.get(raw)
        again = of is not None and of != page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", of if again else None))
    return sorted(out, key=repr)


def test_archives_round_trip(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab\r\né<>日") for _ in range(rng.choice([0, 3, 50, 150, 900]))) for _ in range(30)]
    base += ["x\r\n\r\n\r\ny" * 40, "\r\n", "\r\n\r\n", "z" * 300 + "\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9, "é" * 200_000]
    rows = [(i, f"http://h/{i}\r\n x é", rng.choice(base)) for i in range(200)]
    rows += [(300 + i, "", html) for i, html in enumerate(base)]
    rows += [(None, None, None), (None, None, base[-1]), (400, None, None), (5, "again", base[3])]
    rows += [(1000 + i, "hot", "h" * 120) for i in range(100)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    for size in (64, 1 << 20):
        assert sorted(map(tuple, warc.archived(pages, size).collect()), key=repr) == brute_archive(rows)
    assert warc.archived(pages.limit(0)).count() == 0


def test_archives_that_end_in_line_breaks(spark):
    """An archive's last payload may end in any part of the separator."""
    for end in ("\r\n", "\r\n\r\n\r\n", "\r", "\r\n\r", "x\r\n"):
        for size in (3, 1 << 20):
            pages = spark.createDataFrame([(1, "u", "a\r\n\r\nb" + end)], "page_id long, url string, html string").coalesce(1)
            assert [tuple(r) for r in warc.archived(pages, size).collect()] == brute_archive([(1, "u", "a\r\n\r\nb" + end)])


def test_payload_of_many_segments_stays_in_one_archive(spark):
    html = "0123456789" * 6_000
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [tuple(r) for r in warc.archived(pages, 1).collect()] == brute_archive([(1, "u", html)])


def test_chunks_carry_running_digests(spark):
    html = "0123456789" * 100
    chunks = warc.chunked(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), 256).collect()
    assert [c.chunk_no for c in chunks] == [0, 1, 2, 3]
    for c in chunks:
        assert c.digest == hashlib.sha256(html.encode()[: 256 * (c.chunk_no + 1)]).hexdigest()
    assert b"".join(c.chunk for c in chunks) == html.encode() and [c.last for c in chunks] == [False] * 3 + [True]


def test_language_model(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    docs = docs.withColumn("words", F.lit("q")).withColumn("row", F.lit(0))
    rows = lm.score_texts(docs, table_words=5_000).collect()
    counts, tokens = Counter(), lambda t: [*(t or "").encode().lower().split(), b" "]
    texts = [tuple(r)[:2] for r in docs.collect()]
    for doc, text in texts:
        if zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 != 2:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (
            (d, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 3))
            for d, t in texts
        ),
        key=repr,
    )
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in rows), key=repr) == want
    assert {r.train_tokens for r in rows} == {total}
    held = [r for r in rows if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better on texts it hasn't seen


def test_repeated_triples_are_one_row():
    rng = np.random.default_rng(3)
    triples = rng.integers(0, 6, (2_000, 3))
    rows, times = lm.distinct_triples(triples)
    assert Counter(map(tuple, triples.tolist())) == dict(zip(map(tuple, rows.tolist()), times.tolist()))
    assert [len(part) for part in lm.distinct_triples(triples[:0])] == [0, 0]


def test_ends_are_counted_beyond_the_table(spark):
    """Few texts with more frequent words than the table holds: a text's end is counted all the same."""
    rng = random.Random(1)
    texts = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(200))) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    small, large = ({r.doc_id: r for r in lm.score_texts(docs, table_words=n).collect()} for n in (20, 200_000))
    for i in small:
        assert small[i].n_known == large[i].n_known == 201
        assert abs(small[i].base_score - large[i].base_score) < 1e-6 and abs(small[i].score - large[i].score) < 1e-4


def test_scores_are_probabilities():
    rng = np.random.default_rng(6)
    words = [f"w{i}".encode() for i in range(1_500)]
    numbering = lm.Numbering(words)
    unigram = numbering.unigram(list(range(2_000, 500, -1)), 300, 2_000_000)
    model = lm.LogBilinear.start(unigram)
    lm.learn(model, rng.integers(0, numbering.size, (20_000, 3)), np.ones(20_000), unigram, rng)
    assert len(model.bounds) > 10
    scorer = lm.Scorer(model, numbering, {}, 1, 1, 1.0)
    for a, b in ((0, 0), (0, 700), (1_400, 3)):
        parts = scorer.model_parts([np.array([a, b, t]) for t in range(numbering.size)])
        assert abs((10.0**parts).sum() - 1) < 1e-3


def test_language_model_without_texts(spark, no_docs):
    assert lm.score_texts(no_docs).count() == 0
    alone = spark.createDataFrame([(d, "a b") for d in range(100) if lm.held_out(d)][:2], "doc_id long, text string")
    rows = lm.score_texts(alone).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0)] * 2
    assert all(r.base_score == 0.0 for r in rows)  # log10(1 / 1)
