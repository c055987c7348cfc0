"""Line dedup across documents by deletion neighbourhoods of words. Only DataFrame functions.

Lines are equal if their words are. Two lines of at least ``near_words`` words are near if one word put in, taken
out or replaced turns one into the other; that is, if they give the same text when at most one word is deleted
at the same place. A line goes if an equal or a near one stands earlier in the corpus, by (doc_id, line number).

Work is bounded in three steps, none of which pairs rows:

1. Equal lines are found by two 64-bit hashes; only those and positions are shuffled.
2. One edit leaves the first or the second half of a line as it was. Distinct lines that share no half-line
   hash with another distinct line have no near one and leave here, before any variants are made.
3. Every line that is left gives its variants: for each word the line without it, and for each gap the line as it
   is, as hashes of the words before (counted from the start) and behind (counted from the end), with the place.
   Lines that share such a key are near, whichever they are, so one minimum per key tells for each line the
   earliest near one. The edit distance to it is then verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from merchlens.llm.common import ranked, small
from merchlens.session import settled

#: Hash seeds of the two halves of a line's identity.
_SEEDS = (0, 1)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with a hash of the text, which tells rows with one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("version", F.xxhash64("text"))


def _words(line: Column) -> Column:
    """A line's words with one space between two; empty for a line without words."""
    odd = F.contains(line, F.lit("  "))
    for mark in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(mark))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def lines_of(texts: DataFrame) -> DataFrame:
    """(at, words) of every line with a word of ``keyed`` documents; a NULL text has none."""
    lines = texts.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    at = F.struct("doc_id", "version", "line_no").alias("at")
    return lines.select(at, _words(F.col("line")).alias("words")).filter("words <> ''")


def _identity(words: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), words).alias(f"id{seed}") for seed in _SEEDS]


def _half_keys(near_words: int) -> Column:
    """Hashes of a line's first and last words, as many as one edit may leave whole; empty for shorter lines.

    A line of n words meets lines of n - 1, n and n + 1 words, so two sizes are given where they differ.
    """
    n = F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1
    small_, large = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")

    def halves(size: Column) -> list[Column]:
        return [
            F.xxhash64(F.lit(side), size, F.call_function("substring_index", "words", F.lit(" "), size * sign))
            for side, sign in (("a", 1), ("z", -1))
        ]

    none = F.array().cast("array<bigint>")
    both = F.when(small_ == large, F.array(*halves(large))).otherwise(F.array(*halves(large), *halves(small_)))
    return F.when(n >= near_words, both).otherwise(none)


def _first(texts: DataFrame, near_words: int) -> DataFrame:
    """One row per distinct line: identity, earliest place, number of occurrences, half-line hashes."""
    rows = lines_of(texts).select(*_identity(F.col("words")), "at", _half_keys(near_words).alias("halves"))
    return rows.groupBy("id0", "id1").agg(
        F.min("at").alias("at"), F.count("*").alias("times"), F.first("halves").alias("halves")
    )


def _suspects(distinct: DataFrame) -> DataFrame:
    """``distinct`` lines that share a half-line hash with another one; by the first hash, which suffices here."""
    halves = distinct.select("id0", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("id0").alias("least"), F.max("id0").alias("most")).filter("least < most")
    shared = small(settled(shared.select("half"), "line-halves"))
    ids = small(settled(halves.join(shared, "half", "left_semi").select("id0").distinct(), "line-ids"))
    return distinct.join(ids, "id0", "left_semi").select("id0", "id1", "at")


def _variants(suspects: DataFrame) -> DataFrame:
    """(no, place, rest) for ``suspects(no, words)``: each line less one word, and as it is, at every place.

    ``rest`` joins hashes of each word with its place from the start or the end, as an exclusive or over
    the words before, and over the words behind. Running over places keeps a long line linear.
    """
    words = suspects.select("no", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
    upto = Window.partitionBy("no").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("no")
    hashed = words.select(
        "no", "n", "p", F.xxhash64(F.lit(2), "p", "word").alias("f"), F.xxhash64(F.lit(3), F.col("n") - F.col("p"), "word").alias("b")
    )
    run = hashed.select(
        "no", "n", "p", "f", "b", F.bit_xor("f").over(upto).alias("start"), F.bit_xor("b").over(upto).alias("spent"),
        F.bit_xor("b").over(whole).alias("all"),
    )
    before = F.col("start").bitwiseXOR(F.col("f"))
    behind = F.col("all").bitwiseXOR(F.col("spent"))
    made = F.array_compact(
        F.array(
            F.struct(F.col("p").alias("place"), before.bitwiseXOR(behind).alias("rest")),
            F.struct(F.col("p").alias("place"), before.bitwiseXOR(behind).bitwiseXOR(F.col("b")).alias("rest")),
            F.when(F.col("p") == F.col("n") - 1, F.struct((F.col("p") + 1).alias("place"), F.col("start").alias("rest"))),
        )
    )
    return run.select("no", F.explode(made).alias("v")).select("no", "v.place", "v.rest")


def _within_one(a: Column, b: Column) -> Column:
    """Whether one word put in, taken out or replaced turns word list ``a`` into ``b``."""
    n, m = F.size(a), F.size(b)
    longest = F.greatest(n, m)
    differs = F.filter(F.sequence(F.lit(0), F.least(n, m)), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    first = F.coalesce(F.get(differs, F.lit(0)), longest)
    rest = lambda x, skip: F.slice(x, first + 1 + skip, longest)
    one, none = F.lit(1), F.lit(0)
    return (
        F.when(n == m, rest(a, one) == rest(b, one))
        .when(n == m + 1, rest(a, one) == rest(b, none))
        .when(m == n + 1, rest(a, none) == rest(b, one))
        .otherwise(F.lit(False))
    )


def near_lines(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id0, id1) of the distinct lines that have an earlier near one."""
    suspects = settled(_suspects(distinct), "line-suspects")
    found = lines_of(texts).select(F.col("at").alias("here"), "words").join(
        small(suspects), F.col("here").eqNullSafe(F.col("at"))
    )
    # A row for each repeated document, so one is taken; numbers go by place.
    firsts = found.groupBy("id0", "id1", "at").agg(F.split(F.first("words"), " ").alias("words"))
    firsts = settled(ranked(firsts, [F.col("at")], "no"), "line-texts")
    variants = settled(_variants(firsts), "line-variants")
    # Lines less a word are near each other and near the line that is whole there. Whole lines alike are one line.
    least = variants.groupBy("place", "rest").agg(F.min("no").alias("earliest"), F.max("no").alias("latest"))
    least = settled(least.filter("earliest < latest").drop("latest"), "line-least")
    hits = variants.join(small(least), ["place", "rest"]).filter("earliest < no")
    pairs = small(settled(hits.groupBy("no").agg(F.min("earliest").alias("earliest")), "line-pairs"))
    mine = firsts.select("no", "id0", "id1", F.col("words").alias("a"))
    theirs = firsts.select(F.col("no").alias("earliest"), F.col("words").alias("b"))
    checked = mine.join(pairs, "no").join(theirs, "earliest")
    return checked.filter(_within_one(F.col("a"), F.col("b"))).select("id0", "id1")


def removed_lines(texts: DataFrame, near_words: int) -> DataFrame:
    """(at, near) of the lines of ``keyed`` documents that an earlier line makes needless."""
    distinct = settled(_first(texts, near_words), "line-first")
    near = small(settled(near_lines(texts, distinct), "line-near")).withColumn("near", F.lit(True))
    told = distinct.select("id0", "id1", F.col("at").alias("first"), "times").join(near, ["id0", "id1"], "left")
    told = settled(told.filter((F.col("times") > 1) | F.col("near")).drop("times"), "line-told")
    here = lines_of(texts).select("at", *_identity(F.col("words")))
    return here.join(small(told), ["id0", "id1"]).filter((F.col("at") > F.col("first")) | F.col("near")).select(
        "at", F.coalesce("near", F.lit(False)).alias("near")
    )


def dedup_lines(docs: DataFrame, near_words: int = 8) -> DataFrame:
    """(doc_id, text, n_lines, n_equal, n_near) per row of ``docs(doc_id, text)``, needless lines gone.

    ``n_lines`` counts lines with a word, ``n_equal`` those that went for an earlier equal line, ``n_near`` those
    whose line is near an earlier one. Lines without a word stay, and so does every line that stands first. Rows
    that repeat in id and text stand at the same places and come out alike; rows with one id and other texts are
    ordered by a hash of the text. A NULL id comes before all others; a NULL text stays NULL. An empty table
    gives no rows, other columns are ignored.
    """
    rows = dedup_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), near_words)
    return rows.select("doc_id", "text", *[F.col(f"__{c}").alias(c) for c in ("n_lines", "n_equal", "n_near")])


def dedup_rows(docs: DataFrame, near_words: int = 8) -> DataFrame:
    """``docs`` with the text of ``dedup_lines``, and its counts as columns with two underscores before their names."""
    texts = keyed(docs)
    gone = removed_lines(texts, near_words).select("at.*", "near").groupBy("doc_id", "version").agg(
        F.collect_set("line_no").alias("gone"),  # at most one document's lines
        F.collect_set(F.when(F.col("near"), F.col("line_no"))).alias("near"),
    )
    gone = settled(gone, "line-gone")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("__gone", i))
    text = F.when(F.size("__gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    n_lines = F.size(F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    counted = {
        "__n_lines": F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long"),
        "__n_equal": count("__gone") - count("__near"), "__n_near": count("__near"),
    }
    theirs = small(gone.select(
        F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("gone").alias("__gone"), F.col("near").alias("__near")
    ), weight=F.size("__gone"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__version"))
    joined = docs.join(theirs, same, "left")
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *[c.alias(n) for n, c in counted.items()])
