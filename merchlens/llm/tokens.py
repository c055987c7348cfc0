"""Token ids of whole texts, one white-space word at a time.

The pre-tokenizer never joins characters across white space, so the ids of a text are those of its words in
order. Words repeat, so every Python worker keeps a bounded table of words already cut, over all its tasks. A word made of plain
Latin letters, digits and signs is cut here into the tokenizer's own pieces and each piece goes straight to the
tokenizer's model; any other word goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

#: Words that the rules below cut as the tokenizer does: no apostrophes, no letters outside Latin-1.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 up."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in kept)
    return {b: 256 + i for i, b in enumerate(others)}


class Memory:
    """A table that keeps at most twice ``size`` entries: when the young half is full it becomes the old half.

    What is still in use moves back to the young half, so words that come often are never forgotten.
    """

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def recall(self, key):
        """The value if it is in the old half, now young again; else None."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordTokenizer:
    """Ids of texts as little-endian 32-bit arrays; at most twice ``keep`` words and twice ``pieces`` parts of words are remembered."""

    def __init__(self, path: str, keep: int = 300_000, pieces: int = 50_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._letters = _byte_letters()
        self._words, self._pieces = Memory(keep), Memory(min(keep, pieces))

    def _piece(self, piece: str) -> bytes:
        found = self._pieces.young.get(piece)
        if found is None:
            found = self._pieces.recall(piece)
            if found is None:
                spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
                found = _packed([t.id for t in self._model.tokenize(spelled)])
                self._pieces.put(piece, found)
        return found

    def _word(self, raw: bytes) -> bytes:
        found = self._words.recall(raw)
        if found is not None:
            return found
        if raw.isalpha() and len(raw) <= 64:  # ASCII letters are one piece
            found = self._piece(raw.decode().lower())
            self._words.put(raw, found)
            return found
        word = raw.decode("utf-8", "replace")
        if len(word) >= 100 or not _PLAIN.fullmatch(word) or "<|" in word:
            found = _packed(self._whole.encode(word, add_special_tokens=False).ids)
        else:
            pieces = _PIECES.findall(word.lower())
            found = self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))
        if len(raw) <= 64:
            self._words.put(raw, found)
        return found

    def ids(self, text: bytes) -> np.ndarray:
        words = text.split()
        out = list(map(self._words.young.get, words))
        if None in out:
            word = self._word
            out = [word(w) if found is None else found for w, found in zip(words, out)]
        return np.frombuffer(b"".join(out), "<u4")


@lru_cache(maxsize=2)
def shared_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, with the words it has met in earlier tasks."""
    return WordTokenizer(path)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)
