"""The pipeline against a plain walk through the same stages."""

import corpus_pipeline
from pyspark.sql import functions as F

from merchlens.llm import mixing, quality
from tests.conftest import SMALL
from tests.llm.test_lines_neardup import brute_classes, brute_lines


def test_every_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    read = spark.read.parquet
    docs, columns = read(f"{SMALL}/documents.parquet"), None
    columns = docs.columns
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, states[-1], SMALL).write.parquet(str(tmp_path / name))
        states.append(read(str(tmp_path / name)))
    start, good, cut, first, mixed, packed = states
    assert all(s.columns == columns for s in states[:-1])
    judged = quality.judge(start, read(f"{SMALL}/labels.parquet"))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in judged.filter("kept").collect())
    texts = [(d, t, n, e + c) for d, t, n, e, c in brute_lines([(r.doc_id, r.text) for r in good.collect()])]
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == sorted((d, t) for d, t, n, gone in texts if not n or gone < n)
    assert cut.filter(F.col("n_chars") != F.length("text")).count() == good.filter(F.col("n_chars") != F.length("text")).count()
    classes = brute_classes([(r.doc_id, r.text) for r in cut.collect()])
    assert sorted(r.doc_id for r in first.collect()) == sorted({c for _, c in classes})
    copies = {r.doc_id: r.copies for r in mixing.mix(first).collect()}
    assert sorted(tuple(r) for r in mixed.groupBy("doc_id").count().collect()) == sorted((d, n) for d, n in copies.items() if n)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {d for d, n in copies.items() if n}
    ran = corpus_pipeline.run(spark, SMALL)
    whole = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.filter("start = 0 and length = doc_tokens").collect())
    total = lambda df: df.agg(F.sum("length")).first()[0]
    assert total(ran) == total(packed) and ran.columns == packed.columns and whole(ran)


def test_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        docs.collect()
