"""Packing documents into windows of a fixed number of tokens by the sum-of-squares rule.

Every scan partition packs its own documents as they stream by, so nothing is shuffled. A document's whole
windows leave at once; the rest of it, a piece of fewer tokens than a window, goes to the fill level that leaves
the smallest sum of squared counts of partly filled windows. The counts stand in an array by fill level. Cutting
is free, so what is still open at the end (or beyond ``max_open`` windows, which bounds the memory) is cut anew
into whole windows, and the last tokens into windows of falling powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from merchlens.llm.common import batch_of
from merchlens.llm.tokens import shared_tokenizer

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

#: A part of a document: its id, the place of its first token, its ids, the document's length.
Piece = tuple[int | None, int, np.ndarray, int]


class LevelPacker:
    """Windows of one partition. ``put`` and ``finish`` yield windows, as lists of pieces, once they are closed."""

    def __init__(self, capacity: int, max_open: int = 1024) -> None:
        self.capacity, self.max_open, self.opened = capacity, max_open, 0
        self.counts = np.zeros(capacity + 1, np.int64)  # partly filled windows at each fill level
        self.windows: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """The fill level whose choice gives the least sum of squares; the fullest of equals; 0 opens a window."""
        n, cap = self.counts, self.capacity
        best, level = 2 * n[size] + 1, 0
        if cap - size > 1:
            change = np.where(n[1 : cap - size] > 0, 2 * (n[size + 1 : cap] - n[1 : cap - size]) + 2, np.iinfo(np.int64).max)
            at = len(change) - 1 - int(change[::-1].argmin())
            if change[at] <= best:
                best, level = change[at], at + 1
        if n[cap - size] and 1 - 2 * n[cap - size] <= best:
            level = cap - size
        return level

    def put(self, doc, ids: np.ndarray) -> Iterator[list[Piece]]:
        cap, size = self.capacity, len(ids)
        whole = size // cap * cap
        for start in range(0, whole, cap):
            yield [(doc, start, ids[start : start + cap], size)]
        if size > whole:
            yield from self._place((doc, whole, ids[whole:].copy(), size))

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece[2])
        level = self.level_for(size)
        window = self.windows[level].pop() if level else []
        if level:
            self.counts[level] -= 1
            self.opened -= 1
        window.append(piece)
        if level + size == self.capacity:
            yield window
            return
        self.windows.setdefault(level + size, []).append(window)
        self.counts[level + size] += 1
        self.opened += 1
        if self.opened > self.max_open:
            yield from self._recut(last=False)

    def _recut(self, last: bool) -> Iterator[list[Piece]]:
        """Open windows cut anew into whole ones; the rest stays open, or at the ``last`` leaves in powers of two."""
        pieces = [p for level in sorted(self.windows) for w in self.windows[level] for p in w]
        self.windows, self.opened = {}, 0
        self.counts[:] = 0
        left = sum(len(p[2]) for p in pieces)
        room, window = self._next_room(left, last), []
        for doc, start, ids, total in pieces:
            while len(ids):
                part = ids[:room]
                window.append((doc, start, part, total))
                start, ids, room, left = start + len(part), ids[len(part) :], room - len(part), left - len(part)
                if not room:
                    yield window
                    room, window = self._next_room(left, last), []
        if window:
            level = sum(len(p[2]) for p in window)
            self.windows[level], self.opened = [window], 1
            self.counts[level] = 1

    def _next_room(self, left: int, last: bool) -> int:
        if not last or left >= self.capacity:
            return self.capacity
        return 1 << max(left.bit_length() - 1, 0)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._recut(last=True)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, max_open: int = 1024, rows: int = 8192
) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``; each token id of a document lies in exactly one piece.

    A document's ids are its text's, then ``end_id``; a NULL or empty text is the end id alone. Repeated rows and
    NULL ids are packed like any other row; an empty table gives no rows; other columns are ignored. Sequence
    ids are the partition's number times 2**40 plus a count, so they repeat when the same files are read again.
    A text of any length is cut into windows as it is; one document at a time is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = shared_tokenizer(tokenizer), LevelPacker(capacity, max_open)
        sequence, out = TaskContext.get().partitionId() << 40, []

        def told(windows: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
                    offset += len(ids)
                sequence += 1

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                told(packer.put(doc, np.append(words.ids(text.as_py()), np.uint32(end_id)).astype("<u4")))
                if len(out) >= rows:
                    yield batch_of(_ARROW, list(zip(*out)))
                    out = []
        told(packer.finish())
        if out:
            yield batch_of(_ARROW, list(zip(*out)))

    texts = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts).mapInArrow(run, PIECES)
