from collections import Counter

import random
import time
import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.llm import quality, urls
from tests.conftest import SMALL

SPACES = " \t\n\x0b\f\r"


def brute_counts(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in SPACES:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, inside = Counter(runs), set()
    for i, run in enumerate(runs):
        if times[run] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if any(c not in SPACES for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def failed(c):
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def test_counts_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = ["", " ", "a", "a b c d e a b c d e", "a " * 40, "é ü\n é ü\né ü\n\n", "\x0bx\x1cy\x85z\u2003w"]
    for _ in range(200):
        texts.append("".join(rng.choice(list("ab \n#|é"), rng.integers(0, 80))))
    texts.append(" ".join(f"w{i}" for i in range(6000)) + " w1 w2 w3 w4 w5 w6")  # more words than 12 bits tell apart
    for text in texts:
        assert quality.counts(text.encode())[:5] == brute_counts(text), text[:50]


def test_judge_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_counts(texts[r.doc_id])
        assert tuple(r)[1:6] == want and r.base_failed == failed(want)
        assert not (r.kept and r.base_failed)
    kept = quality.kept_rows(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_held_out_labels(spark):
    """Grown from half of the labels, the forest tells the others apart."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "q"), (1, 0, "q"), (None, 1, "q"), (5, None, "q")], "doc_id long, quality int, kept string")
    rows = quality.judge(odd_docs, labels).collect()
    texts = [r.text for r in odd_docs.collect()]
    assert sorted(tuple(r)[1:6] for r in rows) == sorted(map(brute_counts, texts))
    assert all(r.kept != r.base_failed for r in rows)  # labels of one kind reject nothing
    assert quality.judge(no_docs, labels).count() == 0
    assert quality.judge(odd_docs, labels.limit(0)).count() == len(texts)
    assert quality.kept_rows(odd_docs, labels).count() == sum(not failed(brute_counts(t)) for t in texts)


def brute_url(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))] if tail.startswith("/") else ""
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else "allow"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(list(urls.RULES), "verdict string, rule string")


def test_urls_equal_brute_force(spark, rules):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    odd = [
        None, "", "net/", "http://NET/", "http://net", "http://net?x/", "ftp://a.NET/en", "http://example.net/en/1#x",
        "http://xexample.net/en/", "http://example.com/de/?q", "x://a.example.com/de", "http://.net/", "http://a..net/",
        "http://org/fr/", "http://example.org/fr//", "http://É.org/fr/é?é", "http://h/" + "a" * 100_000, "http://a/b://net/",
        "http://" + "a." * 5_000 + "net/", "http://net/", "http://net/", "://net/",
    ]
    extra = spark.createDataFrame([(10_000 + i, u, "<p>") for i, u in enumerate(odd)], "page_id long, url string, html string")
    extra = extra.unionByName(extra.filter("page_id = 10003"))
    rows = pages.select("page_id", "url", "html").unionByName(extra).withColumn("host", F.lit("q")).withColumn("rule", F.lit("q"))
    got = sorted(map(tuple, urls.filter_urls(rows, rules).collect()), key=repr)
    want = sorted(((r.page_id, *brute_url(r.url, urls.RULES)) for r in rows.collect()), key=repr)
    assert got == want
    assert urls.filter_urls(rows.limit(0), rules).count() == 0
    none = urls.filter_urls(rows, rules.limit(0)).collect()
    assert len(none) == len(want) and {(r.rule, r.verdict) for r in none} == {(None, "allow")}


def test_many_rules_join_without_python(spark):
    many = [("block", f"h{i}.example/p{i % 7}/") for i in range(300)] + [("allow", "example/"), ("block", None), ("allow", "noslash")]
    rules = spark.createDataFrame(many, "verdict string, rule string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.example/p{i % 5}/x") for i in range(400)], "page_id long, url string")
    judged = urls.filter_urls(pages, rules)
    usable = [(v, r) for v, r in many if r and "/" in r]
    assert sorted(map(tuple, judged.collect())) == sorted((r.page_id, *brute_url(r.url, usable)) for r in pages.collect())
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_rules_of_mixed_lengths(spark):
    rng = random.Random(3)
    hosts = ["net", "b.net", "a.b.net", ".net", "a..net", "com", "x.com", "é.com"]
    pieces = ["", "a", "ab", "abc", "é", "aé", "b.c", "abcdefgh" * 4]

    def path():
        return "/".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))

    many = sorted({("block" if rng.random() < 0.5 else "allow", f"{rng.choice(hosts)}/{path()}") for _ in range(400)})
    many = [(v, r) for v, r in many if v == "block" or ("block", r) not in many]
    many.sort(key=lambda m: (-m[1].index("/"), m[1]))  # of equal lengths the longer host comes first
    addresses = [f"http://{rng.choice(['', 'w.', 'a.', 'a.b.', '.'])}{rng.choice(hosts)}/{path()}{rng.choice(['', 'a', '/', '?a/b'])}" for _ in range(1500)]
    pages = spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string")
    got = urls.filter_urls(pages, spark.createDataFrame(many, "verdict string, rule string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, *brute_url(u, many)) for i, u in enumerate(addresses))
    assert sum(r.rule is not None and not r.rule.endswith("/") for r in got) > 100


def test_ten_thousand_rules_plan_quickly(spark):
    many = [("block", f"{'s.' * (i % 5)}h{i}.net/{'d/' * (i % 7)}{'x' * (i % 90)}") for i in range(10_000)]
    rules = spark.createDataFrame(many, "verdict string, rule string")
    pages = spark.createDataFrame([(i, f"http://w.{r}yy?q") for i, (_, r) in enumerate(many[:200])], "page_id long, url string")
    begun = time.monotonic()
    judged = urls.filter_urls(pages, rules)
    judged._jdf.queryExecution().executedPlan()
    assert time.monotonic() - begun < 15  # the work of one pass over the rules is in it
    assert [r.rule for r in judged.orderBy("page_id").collect()] == [r for _, r in many[:200]]
