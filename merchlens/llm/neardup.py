"""Near-duplicate documents by DartMinHash signatures, banded joins and exact checks.

A document is a weighted set of hashed five-word runs. Darts are thrown by hashing into the region under its weights: an
element's weight axis is cut into bands (0 to 1, 1 to 2, 2 to 4, ...), each band has its own Poisson process of
arrivals, the same for every document, and a dart counts if its height lies under the element's weight. Only
arrivals up to a horizon that gives about k ln k + 2k darts in all are thrown, so a large document costs little
more than one hash per element. Every dart falls on one of k coordinates, and the earliest per coordinate is the
signature. Where a coordinate stays empty, the horizon is doubled.

Documents of one set of runs form one class from the start. Representatives that share a band of the signature
are compared with the smallest id of the band, exactly, and linked at the wanted similarity. Bands whose members
are then still in several classes are cut into blocks of a bounded size; every two blocks meet in one task, which
compares members of different classes, the likeliest pairs first, and sends on one link for each two classes that it
joins. A pair is compared exactly where its signatures agree nearly as often as the wanted similarity asks. Classes
are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from merchlens.llm.common import batch_of, ranked, small
from merchlens.session import settled

#: Odd 64-bit constants of the mixing function below (fixed values).
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for every 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words, repeats included; a shorter text is one run of all its words.

    Words are hashed by their own bytes, so equal runs give equal hashes on every machine.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n, place = len(words) - size + 1, np.uint64(size)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            place = place * _MIX[2] + _MIX[0]
            out += hashed[k : n + k] * (place | np.uint64(1))
    return mixed(out)


def throw(elements: np.ndarray, weights: np.ndarray, horizon: float) -> tuple[np.ndarray, np.ndarray]:
    """(arrival time, hash) of all darts under the weights that arrive before the horizon."""
    times, darts = [], []
    low, high, band = 0.0, 1.0, 0
    while len(elements):
        seeds = mixed(elements ^ mixed(np.full(1, band + 1, np.uint64)))
        # Arrivals of one element follow from its hash and their number alone; how many are made at once is free.
        step = max(1, int(1.2 * horizon * (high - low)) + (2 if len(elements) < 2_000 else 0))
        alive, at, nth = np.arange(len(elements)), np.zeros(len(elements)), 1
        while len(alive):
            with np.errstate(over="ignore"):
                h = mixed(seeds[alive, None] + np.arange(nth, nth + step, dtype=np.uint64) * _MIX[2])
            # Gaps of a Poisson process whose rate is the band's height.
            arrival = at[:, None] + np.cumsum(-np.log(_unit(h)) / (high - low), axis=1)
            height = low + (high - low) * _unit(mixed(h ^ _MIX[0]))
            under = (arrival < horizon) & (height <= weights[alive, None])
            times.append(arrival[under])
            darts.append(h[under])
            at = arrival[:, -1]
            alive, at, nth = alive[at < horizon], at[at < horizon], nth + step
        more = weights > high
        elements, weights = elements[more], weights[more]
        low, high, band = high, high * 2, band + 1
    return (np.concatenate(times), np.concatenate(darts)) if times else (np.zeros(0), np.zeros(0, np.uint64))


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates, for a non-empty set of distinct elements."""
    wanted, total = k * np.log(k) + 2 * k, float(weights.sum())
    # The horizon is a power of two, as the doubling below.
    horizon = 2.0 ** np.ceil(np.log2(wanted / total))
    while True:
        times, darts = throw(elements, weights, horizon)
        place = (mixed(darts) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-times)
        out, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[place[order]] = darts[order]  # the earliest is written last
        hit[place] = True
        if hit.all():
            return out
        horizon *= 2


def weighted(runs: np.ndarray, count: bool) -> tuple[np.ndarray, np.ndarray]:
    elements, times = np.unique(runs, return_counts=True)
    return elements, times.astype(float) if count else np.ones(len(elements))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum() if len(both) else 0.0
    return float(shared / (a[1].sum() + b[1].sum() - shared))


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()), ("same0", pa.int64()), ("same1", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()),
    ]
)
#: Members of a band that meet in one task, from either side.
BLOCK = 1024
#: Standard deviations under the wanted similarity at which agreeing signatures still call for an exact comparison.
_SLACK = 5.0


def signed(docs: DataFrame, bands: int, rows: int, size: int, count: bool) -> DataFrame:
    """(doc_id, same0, same1, bands, sketch) of every text with a word.

    Two hashes of its weighted set, a hash for each band, and a byte for each coordinate of the signature.
    """
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = shingles(text.as_py(), size)
                if not len(runs):
                    continue
                elements, weights = weighted(runs, count)
                with np.errstate(over="ignore"):
                    whole = mixed(elements + weights.astype(np.uint64) * _MIX[0])
                    same0, same1 = np.bitwise_xor.reduce(whole), mixed(whole ^ _MIX[1]).sum()
                    sig = signature(elements, weights, k)
                    sketch = (sig >> np.uint64(56)).astype(np.uint8).tobytes()
                    sig = sig.reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        key = mixed(key * _MIX[2] + sig[:, r])
                out.append((doc, int(same0.view(np.int64)), int(same1.view(np.int64)), key.view(np.int64), sketch))
            if out:
                yield batch_of(_SIGNED, list(zip(*out)))

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select("doc_id", text).mapInArrow(
        run, "doc_id long, same0 long, same1 long, bands array<long>, sketch binary"
    )


def checked(pairs: DataFrame, texts: DataFrame, least: float, size: int, count: bool) -> DataFrame:
    """The ``pairs(a, b)`` of ids of which any two texts are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, theirs = None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                b = b.as_py()
                if b != last:  # many pairs in a row have the same second text
                    last, theirs = b, weighted(shingles(b, size), count)
                keep.append(similarity(weighted(shingles(a.as_py(), size), count), theirs) >= least)
            if keep:
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    left = texts.select(F.col("doc_id").alias("a"), text.alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), text.alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, class_id) for every id in ``links(a, b)``: the smallest id that it is linked to over any number of links.

    Every turn takes the smallest class among a row's neighbours and then that class's own class, as sums per key;
    each turn is written, so a lost executor costs one turn at most.
    """
    edges = settled(
        links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.*").distinct(),
        "near-edges",
    )
    state = settled(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("class_id")), "near-classes")
    while True:
        around = edges.join(state, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "class_id")
        least = around.unionByName(state).groupBy("id").agg(F.min("class_id").alias("new"))
        jump = state.select(F.col("id").alias("new"), F.col("class_id").alias("further"))
        step = settled(
            least.join(jump, "new").join(state, "id").select(
                "id", F.least("new", "further").alias("class_id"), (F.least("new", "further") != F.col("class_id")).alias("moved")
            ),
            "near-classes",
        )
        state = step.select("id", "class_id")
        if not step.filter("moved").take(1):
            return state


def near_duplicates(
    docs: DataFrame, least: float = 0.8, bands: int = 32, rows: int = 4, size: int = 5, count: bool = False
) -> DataFrame:
    """(doc_id, class_id, copies, links) for every distinct id of ``docs(doc_id, text)``.

    Documents whose sets of ``size``-word runs are at least ``least`` similar, directly or over others, share a
    class, named by its smallest id. ``copies``: other rows with the same set of runs; ``links``: checked links
    of the document's representative to others. ``count`` weighs a run by its occurrences, else each counts once.
    Words are lower-cased; a text of fewer words is one run. NULL, empty and blank texts are like nothing, not even
    each other; rows with a NULL id are left out; rows that repeat an id with the same text count once, with other
    texts the id joins the classes of all of them. An empty table gives no rows, other columns are ignored.
    At similarity 0.8 the chance to miss a pair is (1 - 0.8**rows)**bands, 5 in 10**8 as set.
    """
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = settled(signed(texts, bands, rows, size, count), "near-signed")
    same = ["same0", "same1"]
    groups = settled(
        prints.groupBy(*same).agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("size")
        ),
        "near-groups",
    )
    member = prints.select("doc_id", *same).join(groups.select(*same, "rep", "size"), same).select("doc_id", "rep", "size").distinct()
    copies = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    banded = groups.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    shared = small(settled(shared.drop("most"), "near-bands"))
    buckets = settled(banded.join(shared, "band"), "near-buckets")
    stars = settled(buckets.filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct(), "near-stars")
    involved = small(settled(stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-involved"))
    known = texts.join(involved, "doc_id", "left_semi").withColumn("version", F.xxhash64("text")).dropDuplicates(["doc_id", "version"])
    known = settled(known.drop("version"), "near-texts")
    links = settled(checked(stars, known, least, size, count), "near-links")
    more = settled(_across(buckets, links, groups.select("rep", "bands", "sketch"), known, least, size, count), "near-more")
    links = settled(links.unionByName(more), "near-links")
    found = components(links.unionByName(copies))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    told = member.join(degree, F.col("rep") == F.col("node"), "left").groupBy("doc_id").agg(
        F.max(F.col("size") - 1).alias("copies"), F.coalesce(F.max("links"), F.lit(0)).alias("links")
    )
    ids = texts.select("doc_id").distinct()
    zero = F.lit(0).cast("long")
    return ids.join(told, "doc_id", "left").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", zero).alias("copies"), F.coalesce("links", zero).alias("links")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``__key`` of its own for every row that stays; of rows with one id and text one stays.

    The key is the id where one row has it. Rows without an id, and rows that share theirs, are numbered beyond all
    ids in the order of id and digest of the text; they alone are grouped and sorted.
    """
    number = F.col("doc_id").cast("long")
    shared = docs.filter("doc_id is not null").groupBy(number.alias("__id")).agg(F.count("*").alias("__n")).filter("__n > 1")
    shared = small(settled(shared.select("__id"), "near-shared"))
    known = docs.filter("doc_id is not null")
    plain = known.join(shared, number == F.col("__id"), "left_anti").withColumn("__key", number)
    odd = known.join(shared, number == F.col("__id"), "left_semi").unionByName(docs.filter("doc_id is null"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("__digest")
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = odd.groupBy(number.alias("__id"), digest).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    placed = ranked(one, [F.col("__id").asc_nulls_first(), F.col("__digest").asc()], "__place")
    ids = docs.agg(F.max(number).alias("high"), F.min(number).alias("low"))
    high, low = (F.coalesce(ids.select(c).scalar(), F.lit(0)) for c in ("high", "low"))
    beyond = F.when(high < 1 << 62, high + 1 + F.col("__place")).otherwise(low - 1 - F.col("__place"))
    return plain.unionByName(placed.select("__row.*", beyond.alias("__key")))


def first_rows(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, with its own columns: that with the smallest id.

    Every row is a document: of rows with one id and text one stays, rows that share an id with other texts are judged
    apart, and rows without an id take part too. In a class those stay only where all members are such rows.
    """
    rows = keyed(docs)
    texts = rows.select(F.col("__key").alias("doc_id"), "text")
    others = near_duplicates(texts, **how).filter("doc_id <> class_id").select(F.col("doc_id").alias("__id"))
    return rows.join(small(settled(others, "near-others")), F.col("__key") == F.col("__id"), "left_anti").select(*docs.columns)


def _joined(left: list, right: list | None, least: float, size: int, count: bool) -> list[tuple[int, int]]:
    """Links (a, b) that join classes among the rows of two blocks of a band, or within one block.

    A row is (doc_id, class_id, place of the band, band hashes, sketch, text).
    """
    other = left if right is None else right
    sketch_l, sketch_r = (np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1) for rows in (left, other))
    class_l, class_r = (np.array([r[1] for r in rows]) for rows in (left, other))
    bands_l, bands_r = (np.array([r[3] for r in rows]) for rows in (left, other))
    k, band = sketch_l.shape[1], left[0][2]
    floor = least - _SLACK * (least * (1 - least) / k) ** 0.5
    at_l, at_r, agree = [], [], []
    for i in range(len(left)):
        start = i + 1 if right is None else 0
        same = (sketch_r[start:] == sketch_l[i]).mean(1)
        j = np.flatnonzero((same >= floor) & (class_r[start:] != class_l[i])) + start
        # Two rows that share an earlier band meet there.
        j = j[~(bands_r[j, :band] == bands_l[i, :band]).any(1)] if band else j
        at_l.append(np.full(len(j), i))
        at_r.append(j)
        agree.append(same[j - start])
    at_l, at_r, agree = np.concatenate(at_l), np.concatenate(at_r), np.concatenate(agree)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    sets: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def runs(row: tuple) -> tuple[np.ndarray, np.ndarray]:
        if row[5] not in sets:
            sets[row[5]] = weighted(shingles(row[5], size), count)
        return sets[row[5]]

    links = []
    for n in np.argsort(-agree, kind="stable"):
        one, two = left[at_l[n]], other[at_r[n]]
        a, b = root(one[1]), root(two[1])
        if a != b and similarity(runs(one), runs(two)) >= least:
            parent[max(a, b)] = min(a, b)
            links.append((one[0], two[0]))
    return links


def _across(
    buckets: DataFrame, links: DataFrame, signatures: DataFrame, known: DataFrame, least: float, size: int, count: bool
) -> DataFrame:
    """Links (a, b) between members of one band that the links to its smallest member leave apart.

    A band whose members all have one label, however large, takes no part. Labels are the smallest ids two steps
    away; two labels of one class only cost comparisons.
    """
    first = links.groupBy("a").agg(F.min("b").alias("b"))
    further = first.select(F.col("a").alias("b"), F.col("b").alias("c"))
    label = settled(first.join(further, "b", "left").select(F.col("a").alias("id"), F.coalesce("c", "b").alias("class_id")), "near-labels")
    placed = buckets.select("band", "rep").join(label, F.col("rep") == F.col("id"), "left").select(
        "band", "rep", F.coalesce("class_id", "rep").alias("class_id")
    )
    open_ = placed.groupBy("band").agg(F.min("class_id").alias("c0"), F.max("class_id").alias("c1"), F.count("*").alias("n"))
    open_ = settled(open_.filter("c0 < c1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "near-open")
    texts = known.select(F.col("doc_id").alias("rep"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # An id with several texts has several sets in a band, and meets the others with each of its texts.
    held = placed.join(open_, "band")
    rows = held.join(signatures, "rep").filter(F.array_contains("bands", F.col("band"))).join(texts, "rep")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # A row stands in one pair of blocks for each block; the smaller number is the left one.
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["band", "low", "high"]
    met = met.select(
        "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).alias("right"),
        F.col("rep").alias("doc_id"), "class_id", (F.array_position("bands", F.col("band")) - 1).cast("int").alias("place"),
        "bands", "sketch", "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, left, right, out = None, [], [], []

        def close() -> None:
            if left and (right or key[1] == key[2]):
                out.extend(_joined(left, right or None, least, size, count))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[:3] != key:
                    close()
                    key, left, right = row[:3], [], []
                (right if row[3] else left).append(row[4:])
            if out:
                yield batch_of(schema, list(zip(*out)))
                out = []
        close()
        if out:
            yield batch_of(schema, list(zip(*out)))

    dealt = met.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")
