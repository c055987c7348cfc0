"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read as the next one's input.

All but the last return the columns of documents. Stages decide on whole rows: rows that repeat in id and text fare
alike, NULL ids and texts are ordinary values, and an empty table goes through all stages as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from merchlens.llm import lines, mixing, neardup, packing, quality
from merchlens.session import settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; NULL and empty texts go."""
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; one that loses all its lines goes.

    ``n_chars`` follows a text that was cut. Texts without lines of words stay as they are.
    """
    rows = lines.dedup_rows(docs)
    cut = F.col("__n_equal") + F.col("__n_near")
    kept = rows.filter((F.col("__n_lines") == 0) | (cut < F.col("__n_lines")))
    n_chars = F.when(cut > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return kept.select(*[n_chars if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document, that with the smallest id; rows without an id come last."""
    return neardup.first_rows(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing_sources", mixing_sources),
    ("packed", packed),
]

#: Forests, signatures and packing can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
