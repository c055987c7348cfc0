"""Mixing sources to target weights by hash thresholds.

A document's hash gives it a fixed place between 0 and 2**48. A source takes each of its documents a whole number
of times, and once more those whose hash lies under a threshold. The threshold is found from histograms: words
are summed by source and the top 12 bits of the hash, the bucket in which the budget falls is the only one
looked into again, by the next 12 bits, and so on. Nothing is sorted by hash, and a histogram holds at most
4096 rows per source and budget. Thresholds of smaller budgets are never above those of larger ones, so smaller
mixes are part of larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from merchlens.llm.common import WORD, ranked, small
from merchlens.session import settled

BITS, ROUNDS = 12, 4
_ALL = BITS * ROUNDS


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, place): words of each text and its place in hash order; a NULL text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _place(seed).alias("place")
    )


def _place(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))), 64 - _ALL)


def weights_in_turn(totals: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``totals(source, source_size)`` with weights dealt in turn by the source's code points, NULL last."""
    n = len(weights)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % n + 1).cast("int"))
    return ranked(totals, [F.col("source").isNull(), F.col("source")], "__rank").select(
        "source", "source_size", turn.alias("weight")
    )


def targets(weighted: DataFrame, budget: float = 1.0, most: float = 3.0) -> DataFrame:
    """``weighted(source, source_size, weight)`` with ``target``: ``budget`` of all words shared by weight, at
    most ``most`` times a source's size, what is over shared anew among the others until no source is above.

    Only sums over the sources come to the driver. No words at all give targets of 0.
    """
    cap = F.col("source_size") * F.lit(float(most))
    first = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    whole, level = float(first[0] or 0) * min(budget, most), None
    spare, rest = whole, float(first[1] or 0)
    while rest > 0 and spare / rest != level:
        level = spare / rest
        above = cap < F.col("weight") * F.lit(level)
        row = weighted.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        spare, rest = whole - float(row[0] or 0), float(row[1] or 0)
    return weighted.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0)))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, budget, copies, below) for ``wanted(source, budget, source_size, target)``.

    ``below`` is the place under which a source's documents are taken once more than ``copies`` times.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = settled(
        wanted.withColumn("copies", copies).select(
            F.col("source").alias("__source"), "budget", "copies",
            (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"),
            F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("inside"),
        ),
        "mix-state",
    )
    for step in range(ROUNDS):
        shift = _ALL - BITS * (step + 1)
        cell = F.shiftright("place", shift)
        same = F.col("source").eqNullSafe(F.col("__source"))
        if step == 0:
            sums = sizes.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
            rows = sums.join(state, same)
        else:
            looked = state.select("__source", "prefix").distinct()
            inside = sizes.join(looked, same & (F.shiftright("place", shift + BITS) == F.col("prefix")), "left_semi")
            sums = inside.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
            rows = sums.join(state, same & (F.shiftright("cell", BITS) == F.col("prefix")))
        upto = Window.partitionBy("__source", "budget").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("reached", F.col("before") + F.sum("words").over(upto))
        # The first bucket that goes beyond what is still wanted; the last one where rounding lets none.
        chosen = rows.groupBy("__source", "budget").agg(
            F.coalesce(
                F.min(F.when(F.col("reached") > F.col("rest"), F.struct("cell", "reached", "words"))),
                F.max(F.struct("cell", "reached", "words")),
            ).alias("hit"),
            F.first("copies").alias("copies"), F.first("rest").alias("rest"),
        )
        state = settled(
            chosen.select(
                "__source", "budget", "copies", "rest", F.col("hit.cell").alias("prefix"),
                (F.col("hit.reached") - F.col("hit.words")).alias("before"), F.col("hit.words").alias("inside"),
            ),
            "mix-state",
        )
    nearer = (F.col("rest") > 0) & ((F.col("rest") - F.col("before")) * 2 >= F.col("inside"))
    return state.select(
        F.col("__source").alias("source"), "budget", "copies", (F.col("prefix") + nearer.cast("long")).alias("below")
    )


def plans(sizes: DataFrame, weights: Sequence[float], budgets: Sequence[float], most: float) -> DataFrame:
    """(__source, plan): per source an entry (budget, copies, below, source_size, target) for each rising budget."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = settled(weights_in_turn(totals, weights), "mix-weights")
    wanted = None
    for i, budget in enumerate(sorted(budgets)):
        part = targets(weighted, budget, most).withColumn("budget", F.lit(i))
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = settled(wanted, "mix-targets")
    found = thresholds(sizes, wanted).join(
        wanted.select(F.col("source").alias("__s"), F.col("budget").alias("__b"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("__s")) & (F.col("budget") == F.col("__b")),
    )
    entry = F.struct("budget", "copies", "below", "source_size", "target")
    plan = found.groupBy(F.col("source").alias("__source")).agg(F.array_sort(F.collect_list(entry)).alias("plan"))
    return settled(plan, "mix-plan")  # a row for each source


def _copies(entry: Column, place: Column) -> Column:
    return entry["copies"] + (place < entry["below"]).cast("long")


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), budgets: Sequence[float] = (1.0,), most: float = 3.0, seed: int = 0
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, nested) for every row of ``docs(doc_id, text, source)``.

    ``copies`` is how often the mix of the largest budget takes the row, ``taken`` the words so taken, ``nested``
    the words taken under each budget in rising order. Targets and columns without index are the largest
    budget's. A NULL source is a source of its own, after all others. Rows that repeat in id and text share a
    place and are taken alike; NULL ids differ by their text. Sources without words and empty tables take
    nothing. Other columns are ignored. No document is taken more than ``most`` times, rounded up.
    """
    sizes = settled(sized(docs, seed), "mix-sizes")
    last = F.element_at("plan", -1)
    place = F.col("place")
    by_source = small(plans(sizes, weights, budgets, most))
    return sizes.join(by_source, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "size", last["source_size"].alias("source_size"), last["target"].alias("target"),
        _copies(last, place).alias("copies"), (_copies(last, place) * F.col("size")).alias("taken"),
        F.transform("plan", lambda e: _copies(e, place) * F.col("size")).alias("nested"),
    )


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), budget: float = 1.0, most: float = 3.0, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, each as often as it is taken, with their own columns."""
    sizes = settled(sized(docs, seed), "mix-sizes")
    by_source = small(plans(sizes, weights, (budget,), most)).withColumnRenamed("plan", "__plan")
    copies = _copies(F.element_at("__plan", -1), _place(seed)).cast("int")
    rows = docs.join(by_source, F.col("source").eqNullSafe(F.col("__source")))
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), copies)).alias("__time")).select(*docs.columns)
