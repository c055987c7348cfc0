"""Finding rows by id, exact name or part of a name, and carts by session or customer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from merchlens.functions.text import looks_like_uuid
from merchlens.session import settled

#: Lengths of the pieces a name is looked up by. A longer reference goes by its rarest piece of the greatest length it has.
GRAMS = (3, 6, 12)
#: Names of one scope that its references meet one by one; scopes with more go by pieces.
DIRECT = 64


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters; empty when the text is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    pieces = F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _all_short(text: Column) -> Column:
    """Every piece of a name shorter than the first of GRAMS, and the empty piece, which every name holds."""
    return F.concat(F.array(F.lit("")), *[_grams(text, n) for n in range(1, GRAMS[0])])


def _by_pieces(asked: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """(low, scope, part): the best name that holds each ``asked(__low, scope)``, by an index of name pieces.

    Pieces and names travel as 64-bit hashes. The name itself is tested at the end, so equal hashes cost rows only.
    No table here is broadcast: each grows with the references or the names.
    """

    def keyed(df: DataFrame, pieces: Column, *rest: str) -> DataFrame:
        return df.select(*scope, *rest, F.explode(F.transform(pieces, lambda g: F.xxhash64(g))).alias("__gram"))

    length = F.length("__low")
    short = asked.filter(length < GRAMS[0])
    named = names.withColumn("__key", F.xxhash64("__low"))
    # A reference shorter than any piece: names are reduced to the best one of each piece before they meet.
    of_short = names.select(*scope, "__id", "__first", F.explode(_all_short(F.col("__low"))).alias("__low"))
    best = of_short.groupBy("__low", *scope).agg(F.min_by("__id", "__first").alias("__part"))
    few = short.hint("shuffle_hash").join(best, ["__low", *scope]).select("__low", *scope, "__part")
    found = [few]
    for at, size in enumerate(GRAMS):
        here = asked.filter(length >= size)
        if at + 1 < len(GRAMS):
            here = here.filter(length < GRAMS[at + 1])
        here = here.withColumn("__ref", F.xxhash64("__low"))
        pieces = keyed(here, _grams(F.col("__low"), size), "__ref")
        wanted = pieces.select(*scope, "__gram").distinct()
        index = keyed(named, _grams(F.col("__low"), size), "__key").join(wanted.hint("shuffle_hash"), ["__gram", *scope], "left_semi")
        counts = index.groupBy("__gram", *scope).agg(F.count("*").alias("__n"))
        # A piece that no name has makes a match impossible; the inner join then drops the reference.
        rarest = (
            pieces.hint("merge").join(counts.hint("merge"), ["__gram", *scope], "left")
            .groupBy("__ref", *scope)
            .agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), F.col("__gram"))).alias("__gram"))
        )
        met = rarest.hint("merge").join(index.hint("merge"), ["__gram", *scope]).select("__ref", "__key", *scope)
        full = met.hint("merge").join(here.hint("merge"), ["__ref", *scope]).hint("merge").join(
            named.withColumnRenamed("__low", "__name").hint("merge"), ["__key", *scope]
        )
        found.append(
            full.filter(F.contains("__name", "__low")).groupBy("__low", *scope).agg(F.min_by("__id", "__first").alias("__part"))
        )
    return reduce(DataFrame.unionByName, found)


def _within_scopes(asked: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """The same, where a scope has few names: its references meet all of them."""
    met = asked.hint("merge").join(names.withColumnRenamed("__low", "__name").hint("merge"), scope)
    return met.filter(F.contains(F.coalesce("__name", F.lit("")), "__low")).groupBy("__low", *scope).agg(F.min_by("__id", "__first").alias("__part"))


def resolve_names(
    refs: DataFrame,
    candidates: DataFrame,
    scope: Sequence[str] = (),
    order: Sequence[Column] | None = None,
    what: str = "Product",
) -> DataFrame:
    """Resolve ``refs(ref[, scope...])`` against ``candidates(id, name[, scope...])``.

    A UUID-shaped reference is an id; otherwise the exact name wins over a name that contains the
    reference, both ignoring case. ``order`` picks among several (default: smallest id). Rows without a
    match keep an ``error``. The contains step looks up one rare piece of the reference in an index of
    name pieces, so no reference meets every name; only in a scope of few names does it meet those.
    """
    scope = list(scope)
    order = list(order) if order else [F.col("id")]
    pick = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("id").alias("tie"))
    asked = refs.select("ref", *scope).distinct().withColumn("__low", F.lower("ref"))
    is_id = looks_like_uuid(F.col("ref"))

    by_id = candidates.select(F.col("id").cast("string").alias("ref"), *scope).distinct().withColumn("__by_id", F.lit(True))
    names = candidates.withColumn("__low", F.lower("name")).groupBy("__low", *scope).agg(
        F.min_by(F.col("id").cast("string"), pick).alias("__id"), F.min(pick).alias("__first")
    )
    names = settled(names, "names")
    ids = [x for x in by_id.columns if x != "__by_id"]
    staged = (
        asked.hint("merge").join(by_id.hint("merge"), ids, "left").hint("merge")
        .join(names.select("__low", *scope, F.col("__id").alias("__exact")).hint("merge"), ["__low", *scope], "left")
    )
    staged = settled(staged, "staged-names")
    open_refs = staged.filter(~is_id & F.col("__exact").isNull()).select("__low", *scope).distinct()
    open_refs = settled(open_refs, "open-names")
    if scope:
        sizes = names.groupBy(*scope).agg(F.count("*").alias("__n"))
        large = settled(sizes.filter(F.col("__n") > DIRECT).select(*scope), "large-scopes")
        part = _within_scopes(open_refs, names.join(large.hint("merge"), scope, "left_anti"), scope).unionByName(
            _by_pieces(open_refs.join(large.hint("merge"), scope, "left_semi"), names.join(large.hint("merge"), scope, "left_semi"), scope)
        )
    else:
        part = _by_pieces(open_refs, names, scope)
    found = staged.hint("merge").join(part.hint("merge"), ["__low", *scope], "left")
    how = (
        F.when(is_id & F.col("__by_id"), "id")
        .when(is_id, None)
        .when(F.col("__exact").isNotNull(), "exact")
        .when(F.col("__part").isNotNull(), "contains")
    )
    resolved = F.when(how == "id", F.col("ref")).when(how == "exact", F.col("__exact")).when(how == "contains", F.col("__part"))
    missing = F.when(is_id, F.concat(F.lit(f"{what} not found with ID: "), "ref")).otherwise(
        F.concat(F.lit(f"{what} not found: "), F.coalesce("ref", F.lit("")))
    )
    answer = found.select("ref", *scope, resolved.alias("id"), how.alias("how"), F.when(how.isNull(), missing).alias("error"))
    return answer


def resolve_sessions(refs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each ``refs(ref)`` as a session id, else as a customer's newest active session."""
    asked = refs.select("ref").distinct()
    by_id = sessions.select(F.col("session_id").cast("string").alias("ref")).distinct().withColumn("__direct", F.col("ref"))
    newest = (
        sessions.filter("status = 'active'")
        .groupBy(F.col("customer_id").cast("string").alias("ref"))
        .agg(F.max_by(F.col("session_id").cast("string"), F.struct("created_at", "session_id")).alias("__newest"))
    )
    hit = asked.join(by_id, "ref", "left").join(newest, "ref", "left")
    session = F.coalesce("__direct", "__newest")
    return hit.select(
        "ref",
        session.alias("session_id"),
        F.when(F.col("__direct").isNotNull(), "session").when(F.col("__newest").isNotNull(), "customer").alias("how"),
        F.when(session.isNull(), F.concat(F.lit("Cart session not found: "), "ref")).alias("error"),
    )
