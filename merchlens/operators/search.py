"""Text search: a postings table, exact BM25 top-k, exclusion and fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from merchlens.functions.text import words
from merchlens.operators.spread import join_salted, top_k
from merchlens.session import settled

K1, B = 1.2, 0.75
SCORE_PLACES = 6
#: Rows of an id, or of a query's word, that may be sent to all executors.
BROADCAST_ROWS = 1_000_000
#: Meetings of a posting and a query that one task sums.
TASK_MEETINGS = 1 << 21


@dataclass(frozen=True)
class TextIndex:
    """``postings(id, term, tf, dl)`` and ``docs(id, dl)``; both may simply be appended to."""

    postings: DataFrame
    docs: DataFrame


def _counted(docs: DataFrame) -> DataFrame:
    """The words of each row of ``docs(id, text)`` with their counts: runs of equal words in the row's sorted words."""
    sort = docs.select("id", F.sort_array(words(F.col("text"))).alias("w"))
    first = lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1))
    starts = F.when(F.size("w") > 0, F.filter(F.sequence(F.lit(0), F.size("w") - 1), first)).alias("at")
    runs = sort.select("id", "w", starts).select("id", "w", F.size("w").alias("n"), "at")
    run = lambda start, j: F.struct(
        F.get("w", start).alias("term"), (F.coalesce(F.get("at", j + 1), F.col("n")) - start).cast("long").alias("tf")
    )
    # The outer form: plain inline would run the tokeniser a second time to skip empty texts early.
    terms = runs.select("id", F.col("n").cast("long").alias("dl"), F.inline_outer(F.transform("at", run)))
    return terms.filter("term IS NOT NULL").select("id", "term", "tf", "dl")


def postings_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document and word, with the document's length beside it.

    Words are counted inside their row, so postings leave the scan as they are; only rows that share their id (or
    have none) are grouped, those of equal length as one document.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    repeated = texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("again"))
    held = repeated.count()
    if not held:
        return _counted(texts)
    repeated = F.broadcast(repeated) if held <= BROADCAST_ROWS else repeated
    same = F.col("id").eqNullSafe(F.col("again"))
    several = _counted(texts.join(repeated, same, "left_semi")).groupBy("id", "term", "dl").agg(F.sum("tf").alias("tf"))
    return _counted(texts.join(repeated, same, "left_anti")).unionByName(several)


def lengths_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.size(words(F.col(text_col))), F.lit(0)).cast("long").alias("dl"))


def save_index(index: TextIndex, path: str) -> TextIndex:
    """Write the index; answers then start from the stored postings instead of the texts."""
    index.postings.write.parquet(f"{path}/postings")
    index.docs.write.parquet(f"{path}/docs")
    return load_index(index.postings.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"))


def build_index(docs: DataFrame, id_col: str, text_col: str) -> TextIndex:
    return TextIndex(postings_of(docs, id_col, text_col), lengths_of(docs, id_col, text_col))


def append_index(index: TextIndex, docs: DataFrame, id_col: str, text_col: str) -> TextIndex:
    """Add documents whose id is not indexed yet."""
    new = docs.join(index.docs.select(F.col("id").alias(id_col)), id_col, "left_anti")
    return TextIndex(
        index.postings.unionByName(postings_of(new, id_col, text_col)),
        index.docs.unionByName(lengths_of(new, id_col, text_col)),
    )


def term_stats(index: TextIndex) -> DataFrame:
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _corpus(index: TextIndex) -> DataFrame:
    return index.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def search(index: TextIndex, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """Exact BM25 top ``k`` per ``queries(query_id, text)`` as (query_id, rank, id, score).

    ``allowed(id)`` restricts the answers, not the statistics. The postings of the words asked for are dealt by
    document, over as many tasks as their meetings with queries need, so a document's sums need no further shuffle.
    Words that queries ask for are sent to all tasks where they were counted to be few; else they are joined by word,
    a common word's postings in several places.
    """
    corpus = _corpus(index)
    n, avgdl = corpus.select("n").scalar(), corpus.select("avgdl").scalar()
    wanted = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    # The only scan of the index; three steps start from it.
    found = settled(index.postings.join(wanted.select("term").distinct(), "term", "left_semi"), "asked-postings")
    weights = found.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", _idf(F.col("df"), n))
    asking = settled(wanted.join(weights, "term"), "asking")
    held, meetings = asking.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    postings = found
    if held <= BROADCAST_ROWS:
        width = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        postings = found.repartition(max(width, -(-meetings // TASK_MEETINGS)), "id")
    if allowed is not None:
        postings = postings.join(allowed.select("id"), "id", "left_semi")
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    gains, asking = postings.select("id", "term", gain.alias("gain")), asking.drop("df")
    met = gains.join(F.broadcast(asking), "term") if held <= BROADCAST_ROWS else join_salted(gains, asking, "term", ["id"])
    scores = met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("idf") * F.col("gain")), SCORE_PLACES).alias("score"))
    return top_k(scores, ["query_id"], [F.col("score").desc(), F.col("id")], k).select("query_id", "rank", "id", "score")


def exclude_term(products: DataFrame, postings: DataFrame, term: str, key: str = "product_id") -> DataFrame:
    """Products none of whose documents (``postings(id = key)``) holds the term."""
    having = postings.filter(F.col("term") == term.lower()).select(F.col("id").alias(key)).distinct()
    return products.join(having, key, "left_anti")


def search_with_fallback(
    structured: DataFrame, index: TextIndex, queries: DataFrame, k: int = 10
) -> DataFrame:
    """Structured hits ``(query_id, id)`` first; text search only for queries without any.

    Output: query_id, rank, id, source.
    """
    direct = top_k(structured.select("query_id", "id").distinct(), ["query_id"], [F.col("id")], k)
    unanswered = queries.join(structured.select("query_id").distinct(), "query_id", "left_anti")
    text = search(index, unanswered, k)
    return direct.select("query_id", "rank", "id", F.lit("filter").alias("source")).unionByName(
        text.select("query_id", "rank", "id", F.lit("text").alias("source"))
    )
