"""Fill-in-middle: texts cut into prefix, middle and suffix, with a learned index from code points to bytes.

A text is UTF-8 bytes; a cut is a number of code points. The places where code points begin are learned as a
piecewise-linear function of their rank: segments grow as long as one line keeps every place within a bounded error,
and what the line is off by is stored as one signed byte for each place. A cut is looked up by its segment, predicted
by the line and corrected by the stored residual, so it is exact. Segments are fitted with numpy over whole
stretches; most texts need a handful. Rows stream through one map, nothing is shuffled and one text at a time is held.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from merchlens.llm.common import batch_of

#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The largest error of a segment's line; residuals, rounding included, fit into a signed byte.
MOST_ERROR = 126


def boundaries(text: bytes) -> np.ndarray:
    """Byte offsets at which code points begin, and the end; n + 1 offsets for n code points.

    Bytes that are no UTF-8 are counted with the code point before them; at the start they make one of their own.
    """
    data = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if len(data) and (not len(starts) or starts[0]):
        starts = np.concatenate(([0], starts))
    return np.append(starts, len(data))


@dataclass
class RankIndex:
    """Segments as their first rank, the offset there and the slope, and a residual for every rank."""

    ranks: list[int]
    offsets: list[int]
    slopes: list[float]
    residuals: np.ndarray

    @classmethod
    def fit(cls, places: np.ndarray, error: int = 100) -> RankIndex:
        """An index of a rising sequence of ``places``; ``error`` bounds how far a line may be off."""
        if not 1 <= error <= MOST_ERROR:
            raise ValueError(f"an error from 1 to {MOST_ERROR} is asked for")
        places = np.asarray(places, np.int64)
        ranks, offsets, slopes = [], [], []
        residuals = np.empty(len(places), np.int8)
        start = 0
        while start < len(places):
            end, slope = _reach(places, start, error)
            line = _line(int(places[start]), slope, np.arange(end - start))
            residuals[start:end] = places[start:end] - line
            ranks.append(start)
            offsets.append(int(places[start]))
            slopes.append(slope)
            start = end
        return cls(ranks, offsets, slopes, residuals)

    def predicted(self, rank: int) -> int:
        """What the segment's line says, at most the fitted error from the place."""
        k = bisect_right(self.ranks, rank) - 1
        return int(_line(self.offsets[k], self.slopes[k], np.array([rank - self.ranks[k]]))[0])

    def place(self, rank: int) -> int:
        """The exact place of a rank."""
        return self.predicted(rank) + int(self.residuals[rank])


def _line(offset: int, slope: float, steps: np.ndarray) -> np.ndarray:
    return offset + np.rint(slope * steps).astype(np.int64)


def _reach(places: np.ndarray, start: int, error: int) -> tuple[int, float]:
    """Where the segment from ``start`` ends, and its slope: the cone of slopes narrows place by place until it is empty."""
    low, high, at, step = -np.inf, np.inf, start + 1, 256
    while at < len(places):
        stop = min(at + step, len(places))
        run = np.arange(at - start, stop - start)
        rise = places[at:stop] - places[start]
        lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
        highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
        empty = lows > highs
        if empty.any():
            first = int(empty.argmax())
            if first:
                low, high = float(lows[first - 1]), float(highs[first - 1])
            at += first
            break
        low, high, at, step = float(lows[-1]), float(highs[-1]), stop, 2 * step
    return at, 0.0 if at == start + 1 else (low + high) / 2


_CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, segments long, output binary"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
     ("middle_chars", pa.int64()), ("segments", pa.int64()), ("output", pa.binary())]
)
_P, _S, _M = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of ``seed:doc_id``; a NULL id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, error: int = 100, held_bytes: int = 1 << 24
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, segments, output) for every row of ``docs(doc_id, text)``.

    A text of ``n`` code points is cut at two ranks drawn from its id. ``form`` is ``psm`` (prefix, suffix, middle),
    in ``spm`` of 100 cases ``spm`` (suffix, prefix, middle), and ``plain``, the text itself, in 100 - ``rate`` of 100
    and for texts that are empty or hold a sentinel. ``segments`` is the size of the text's index (NULL if plain).
    A NULL text is empty, a NULL id counts as empty, rows that repeat come out alike, an empty table gives no rows,
    other columns are ignored. ``held_bytes`` of output are gathered at most, besides one text, before they leave.
    """
    h1, h2, h3, h4 = drawn(F.col("doc_id").cast("long"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), form.alias("form"), h1.alias("h1"), h2.alias("h2"), text.cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            ids, forms, first, second = (batch.column(i).to_pylist() for i in range(4))
            for doc, kind, a, b, value in zip(ids, forms, first, second, batch.column(4)):
                whole = value.as_py()
                places = boundaries(whole)
                n = len(places) - 1
                if kind == "plain":
                    out.append((doc, n, kind, None, None, None, whole))
                else:
                    index = RankIndex.fit(places, error)
                    p, q = sorted((a % (n + 1), b % (n + 1)))
                    i, j = index.place(p), index.place(q)
                    prefix, middle, suffix = whole[:i], whole[i:j], whole[j:]
                    parts = (_P, prefix, _S, suffix, _M, middle) if kind == "psm" else (_S, suffix, _P, prefix, _M, middle)
                    out.append((doc, n, kind, p, q - p, len(index.ranks), b"".join(parts)))
                held += len(whole)
                if held >= held_bytes:
                    yield batch_of(_ARROW, list(zip(*out)))
                    out, held = [], 0
            if out:
                yield batch_of(_ARROW, list(zip(*out)))
                out, held = [], 0

    return rows.mapInArrow(run, _CUT).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made an output from. Sentinels stand only where it put them."""

    def after(part: Column, whole: Column) -> Column:
        return F.substr(whole, F.length(part) + 4)

    head = F.substr(output, F.lit(4))
    first = F.when(form == "psm", F.substring_index(head, SUFFIX, 1)).otherwise(F.substring_index(head, PREFIX, 1))
    tail = after(first, head)
    second = F.substring_index(tail, MIDDLE, 1)
    middle = after(second, tail)
    return (
        F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
    )


def digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with lower-case hex SHA-256 of the output and of the text rebuilt from it, in place of the texts."""
    made = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
