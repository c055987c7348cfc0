"""Quality rules: counts of every text, two fixed limits, and an isolation forest over the counts.

The counts are taken once, text by text, and written. The forest is grown in numpy from a bounded sample of the
counted rows: every tree splits its own sub-sample at random values of random features, so odd rows are cut off
after few splits. The sample's limit is a parameter. The threshold on the anomaly score is set on labelled rows:
the one that rejects most bad rows while it keeps at least ``keep`` of the good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from merchlens.llm.common import batch_of, small
from merchlens.session import settled

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Counts beside the fixed ones that the forest sees.
MORE = ("n_upper", "n_marks", "n_signs", "n_lines")
_SYMBOLS, _MARKS = b"#*$%&|<>", b"!?"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_WINDOW = 5
_SPACES = b" \t\n\r\x0b\x0c"
_TRAIL = bytes(range(128, 192))


def repeated_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words that lie in a run of ``window`` words found at least twice in the list, the first one included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    # Words' numbers side by side in 64 bits tell runs apart exactly; where they don't fit, runs are numbered
    # by joining two numbered runs at a time: 1 + 1, 2 + 2, then 4 + 1 words.
    if len(numbers) <= 1 << 62 // window:
        run = np.zeros(n - window + 1, np.int64)
        for k in range(window):
            run = (run << 62 // window) | ids[k : n - window + 1 + k]
    else:
        run, have = ids, 1
        for add in (1, 2, 1):
            tail, size = (run if add == have else ids), n - have - add + 1
            run = np.unique(run[:size] * (n + 1) + tail[have : have + size], return_inverse=True)[1]
            have += add
    order = np.argsort(run, kind="stable")
    same = run[order[1:]] == run[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(run), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    inside = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    inside[starts] += 1  # every start occurs once
    inside[starts + window] -= 1
    return int((np.cumsum(inside[:n]) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """COUNTS, then MORE, of one UTF-8 text."""
    words = text.split()
    solid = text.translate(None, _SPACES)
    chars = len(solid.translate(None, _TRAIL))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    without = lambda drop: len(solid) - len(solid.translate(None, drop))
    return (
        len(words), chars, without(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        without(_UPPER), without(_MARKS), len(words) - len(text.translate(None, _SIGNS).split()), len(lines),
    )


_STATS = ", ".join(f"{c} long" for c in ("doc_id", "version", *COUNTS, *MORE))
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "version", *COUNTS, *MORE)])


def statistics(docs: DataFrame) -> DataFrame:
    """The counts of every text of ``docs(doc_id, text)``, and its hash; a NULL text has none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t.as_py()) for t in batch.column(2)]
            if rows:
                yield batch_of(_ARROW, [batch.column(0), batch.column(1), *zip(*rows)])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    version = F.xxhash64("text").alias("version")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), version, text).mapInArrow(run, _STATS)


def features(rows: np.ndarray) -> np.ndarray:
    """Ratios the trees split, from an array of COUNTS and MORE columns."""
    x = rows.astype(float)
    # Thirty words are added below the line, so that one odd word in a short text is no anomaly.
    words, chars = x[:, 0] + 30, x[:, 1] + 150
    return np.column_stack([x[:, 2] / words, x[:, 4] / (4 * words), x[:, 5] / chars, x[:, 6] / words, x[:, 7] / words])


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe))


@dataclass
class Forest:
    """Trees as arrays: the feature of each node (-1 at a leaf), its cut, its left child (right is next), its depth."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the power of minus the mean path length over the usual one."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            inner = self.feature[at] >= 0
            while inner.any():
                who = every[inner]
                node = at[who]
                at[who] = self.left[node] + (x[who, self.feature[node]] >= self.cut[node])
                inner = self.feature[at] >= 0
            total += self.path[at]
        return 2.0 ** -(total / len(self.roots) / self.scale)


def grow(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """An isolation forest over the rows of ``x``."""
    rng = np.random.default_rng(seed)
    feature, cut, left, path, roots = [], [], [], [], []

    def node() -> int:
        for column in (feature, cut, left, path):
            column.append(0)
        return len(feature) - 1

    size = min(sample, len(x))
    most = int(np.ceil(np.log2(max(size, 2))))
    for _ in range(trees):
        roots.append(node())
        work = [(roots[-1], rng.choice(len(x), size, replace=False), 0)]
        while work:
            at, rows, depth = work.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= most or len(rows) <= 1 or not len(open_):
                feature[at], path[at] = -1, depth + float(_mean_path(len(rows)))
                continue
            f = int(rng.choice(open_))
            value = rng.uniform(low[f], high[f])
            goes = x[rows, f] >= value
            if goes.all() or not goes.any():
                value = high[f]
                goes = x[rows, f] >= value
            first, second = node(), node()
            feature[at], cut[at], left[at] = f, value, first
            work += [(first, rows[~goes], depth + 1), (second, rows[goes], depth + 1)]
    arrays = [np.array(a) for a in (feature, cut, left, path, roots)]
    return Forest(*arrays, scale=float(_mean_path(size)) or 1.0)


def calibrate(scores: np.ndarray, good: np.ndarray, keep: float = 0.997) -> float:
    """The score above which a row goes: as low as leaves at least ``keep`` of the good rows at or under it."""
    kept = np.sort(scores[good])
    if not len(kept) or good.all():
        return 1.0
    limit = kept[min(len(kept) - 1, int(np.ceil(keep * len(kept))) - 1)]
    # The middle of the gap to the next bad score above, so that rows just over the last good one stay.
    above = scores[~good & (scores > limit)]
    return float((limit + above.min()) / 2) if len(above) else 1.0


def fit(stats: DataFrame, labels: DataFrame, most_rows: int, keep: float) -> tuple[Forest | None, float]:
    """Forest and threshold from at most ``most_rows`` labelled rows, the first in the order of their hashed ids.

    Rows labelled both ways count as bad. Without good and bad rows nothing is rejected.
    """
    hashed = F.xxhash64(F.lit(11), F.col("doc_id"))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    )
    picked = known.orderBy(hashed, "doc_id").limit(most_rows)
    one = stats.dropDuplicates(["doc_id"])
    rows = picked.join(one, "doc_id").select("doc_id", "quality", *COUNTS, *MORE).toArrow()
    if rows.num_rows == 0:
        return None, 1.0
    table = np.column_stack([rows.column(c).to_numpy() for c in rows.column_names])
    table = table[np.argsort(table[:, 0], kind="stable")]
    x, good = features(table[:, 2:]), table[:, 1] > 0
    if good.all() or not good.any():
        return None, 1.0
    forest = grow(x)
    return forest, calibrate(forest.score(x), good, keep)


def _judged(
    docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, keep: float = 0.997, least_words: int = 10, most_repeated: int = 20
) -> DataFrame:
    """``judge`` with each text's hash."""
    stats = settled(statistics(docs), "quality-counts")
    forest, limit = fit(stats, labels.select("doc_id", "quality"), most_rows, keep)
    shared = docs.sparkSession.sparkContext.broadcast((forest, limit))  # 100 trees of at most 511 nodes
    schema = pa.schema([*_ARROW, ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, _ = shared.value
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
            score = trees.score(features(rows)) if trees and len(rows) else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], schema=schema)

    scored = stats.mapInArrow(run, _STATS + ", score double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return scored.select(
        "doc_id", "version", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") <= limit)).alias("kept"), "score"
    )


def judge(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Counts and verdicts of every row of ``docs(doc_id, text)``: COUNTS, ``base_failed``, ``kept``, ``score``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` percent of the words in
    repeated runs of five. ``kept``: not so, and not above the forest's threshold. ``labels(doc_id, quality)``
    gives at most ``most_rows`` rows to grow the forest from; without good and bad rows among them only the two
    limits judge. NULL and empty texts have no words and fail. Repeated rows and NULL ids are judged like any
    other row; empty tables give no rows; other columns are ignored.
    """
    return _judged(docs, labels, **limits).drop("version")


def kept_rows(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns."""
    bad = _judged(docs, labels, **limits).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__version"))
    return docs.join(small(settled(bad, "quality-rejected")), same, "left_anti")
