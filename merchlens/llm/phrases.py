"""Collocations: phrases counted in burstable hash containers under a shallow trie of word ids.

Phrases of one word, then two, then three are counted in a pass each. A task gives its words ids and keeps a trie
by a phrase's first ids. A leaf is a container, a hash table of what is left of the phrase; one that grows beyond
``burst`` entries bursts into a node with a container for each next id. When a task holds more than ``held`` entries,
its largest subtrees leave whole, as sorted runs. Runs are dealt by prefix and merged there by sums. A phrase can't be
more frequent than its parts, so a pass counts only phrases whose parts were frequent in the pass before. What was
frequent stands in a bitmap of a fixed size: a false hit costs a row, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from merchlens.operators.spread import top_k
from merchlens.session import settled

#: Where pieces end; no byte of UTF-8.
_END = b"\xff"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_STOPS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_UPPER + b"\t" + _STOPS, _UPPER.lower() + b" " + _END * len(_STOPS))
#: Bits of a word id; three ids make one 64-bit key, so phrases have at most three words.
_BITS = 21
_ID = (1 << _BITS) - 1
LONGEST = 63 // _BITS
#: Suffix buckets of a prefix, so that a hot prefix is merged in several places.
_BUCKETS = 16
#: Spark's xxhash64 starts from this seed.
_SEED = 42


class _Node(dict):
    """An inner node: word id to node or container. A container is a plain dict: rest of the key to count."""


class HatTrie:
    """Counts of phrases of ``size`` word ids, packed into integers."""

    def __init__(self, size: int, burst: int = 4096) -> None:
        self.size, self.burst, self.entries = size, burst, 0
        self.root: dict = {}
        self.sizes: dict[int, int] = {}  # entries below each child of a root that has burst

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct sorted ``keys`` with their counts."""
        if len(keys):
            self.root = self._put(self.root, 0, keys.tolist(), counts.tolist())

    def _put(self, node: dict, depth: int, keys: list[int], counts: list[int]) -> dict:
        if type(node) is _Node:
            shift = _BITS * (self.size - 1 - depth)
            low, start, n = (1 << shift) - 1, 0, len(keys)
            while start < n:
                top = keys[start] >> shift
                limit, end = (top + 1) << shift, start + 1
                while end < n and keys[end] < limit:
                    end += 1
                before = self.entries
                node[top] = self._put(node.get(top) or {}, depth + 1, [k & low for k in keys[start:end]], counts[start:end])
                if not depth:
                    self.sizes[top] = self.sizes.get(top, 0) + self.entries - before
                start = end
            return node
        before, get = len(node), node.get
        for key, count in zip(keys, counts):
            node[key] = get(key, 0) + count
        self.entries += len(node) - before
        return self._burst(node, depth) if len(node) > self.burst and depth < self.size - 1 else node

    def _burst(self, container: dict, depth: int) -> _Node:
        shift = _BITS * (self.size - 1 - depth)
        low, node = (1 << shift) - 1, _Node()
        for key, count in container.items():
            node.setdefault(key >> shift, {})[key & low] = count
        if not depth:
            self.sizes = {top: len(child) for top, child in node.items()}
        if depth + 1 < self.size - 1:
            for top, child in node.items():
                if len(child) > self.burst:
                    node[top] = self._burst(child, depth + 1)
        return node

    def spill(self, left: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole subtrees as sorted runs of keys and counts, largest first, until at most ``left`` entries stay."""
        if type(self.root) is not _Node:
            if self.entries > left:
                run, self.root, self.entries = self._run([(0, self.root, 0)]), {}, 0
                yield run
            return
        shift, chosen, gathered = _BITS * (self.size - 1), [], 0
        for top in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= left:
                break
            n = self.sizes.pop(top)
            chosen.append((top << shift, self.root.pop(top), 1))
            self.entries -= n
            gathered += n
            if gathered >= 1 << 16:
                yield self._run(chosen)
                chosen, gathered = [], 0
        if chosen:
            yield self._run(chosen)
        if not self.root:
            self.root = {}

    def _run(self, subtrees: list[tuple[int, dict, int]]) -> tuple[np.ndarray, np.ndarray]:
        keys: list[int] = []
        counts: list[int] = []
        while subtrees:
            prefix, node, depth = subtrees.pop()
            if type(node) is _Node:
                shift = _BITS * (self.size - 1 - depth)
                subtrees += [(prefix | top << shift, child, depth + 1) for top, child in node.items()]
            else:
                keys += [prefix | k for k in node]
                counts += node.values()
        order = np.argsort(packed := np.array(keys, np.int64))
        return packed[order], np.array(counts, np.int64)[order]


class _Ids(dict):
    """Word to id, in order of first sight; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = new = len(self)
        return new


def _turned(hashes: np.ndarray, place: int) -> np.ndarray:
    by = _BITS * place
    return hashes if not by else (hashes << np.uint64(by)) | (hashes >> np.uint64(64 - by))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _SEED)


class Guard:
    """Tells phrases of ``bitmap``; two bits each."""

    def __init__(self, bitmap: np.ndarray) -> None:
        self.bitmap, self.last = bitmap, np.uint64(64 * len(bitmap) - 1)

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        told = np.ones(len(hashes), bool)
        for spot in (hashes & self.last, (hashes >> np.uint64(32)) & self.last):
            told &= (self.bitmap[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return told


_RUN_SQL = "lang string, part int, phrase binary, f long"
_RUN = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64())])


class Counter:
    """What one task counts: a trie for each language over common word ids."""

    def __init__(self, size: int, guard: Guard | None, held: int, burst: int, step: int, words: int) -> None:
        self.size, self.guard, self.held, self.burst, self.step, self.most_words = size, guard, held, burst, step, words
        self.tries: dict[str, HatTrie] = {}
        self.totals: dict[str, int] = {}
        self.pending: dict[str, list[list[int]]] = {}
        self.waiting = 0
        self._forget()

    def _forget(self) -> None:
        self.ids = _Ids({_END: 0})
        self.hashes = np.zeros(1, np.uint64)
        self.spelled: pa.Array | None = None

    def read(self, lang: str, text: bytes, chunk: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        """Take in a text, a bounded stretch at a time."""
        plain = text.translate(_PLAIN).replace(_END, b" \xff ")
        start = 0
        while start < len(plain):
            end = len(plain) if len(plain) - start <= chunk else plain.find(b" ", start + chunk)
            end = len(plain) if end < 0 else end
            found = list(map(self.ids.__getitem__, plain[start:end].split()))
            start = end
            self.pending.setdefault(lang, []).append(found if start < len(plain) else found + [0])
            self.waiting += len(found)
            if self.waiting >= self.step:
                yield from self.settle()

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Count what was read; spill where too much is held."""
        new = list(self.ids)[len(self.hashes) :]
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(_hash, new), np.uint64, len(new))])
        kept = {}
        for lang, parts in self.pending.items():
            ids = np.concatenate([np.array(p, np.int64) for p in parts])
            self._count(lang, ids)
            kept[lang] = [ids[len(ids) - self.size + 1 :].tolist()]  # the start of phrases that go on
        self.pending, self.waiting = kept, 0
        full = len(self.ids) >= self.most_words
        if full or sum(t.entries for t in self.tries.values()) > self.held:
            for lang, trie in self.tries.items():
                yield from self._told(lang, trie, 0 if full else trie.entries // 2)
        if full:
            spelled = list(self.ids)
            self._forget()
            self.pending = {lang: [[self.ids[spelled[i]] for i in parts[0]]] for lang, parts in kept.items()}

    def _count(self, lang: str, ids: np.ndarray) -> None:
        size, n = self.size, len(ids) - self.size + 1
        if size == 1:
            self.totals[lang] = self.totals.get(lang, 0) + int(np.count_nonzero(ids))
        if n <= 0:
            return
        valid, keys = np.ones(n, bool), np.zeros(n, np.int64)
        for place in range(size):
            part = ids[place : place + n]
            valid &= part > 0
            keys = (keys << _BITS) | part
        if self.guard is not None:
            hashes = np.full(n + 1, _hash(lang.encode()), np.uint64)
            for place in range(size - 1):
                hashes ^= _turned(self.hashes[ids[place : place + n + 1]], place)
            known = self.guard.knows(hashes)
            valid &= known[:-1] & known[1:]
        trie = self.tries.setdefault(lang, HatTrie(size, self.burst))
        trie.add(*np.unique(keys[valid], return_counts=True))

    def _told(self, lang: str, trie: HatTrie, left: int) -> Iterator[pa.RecordBatch]:
        if self.spelled is None or len(self.spelled) < len(self.ids):
            self.spelled = pa.array(list(self.ids), pa.binary())
        for keys, counts in trie.spill(left):
            ids = [(keys >> _BITS * (self.size - 1 - place)) & _ID for place in range(self.size)]
            words = [self.spelled.take(pa.array(i)) for i in ids]
            phrase = words[0] if self.size == 1 else pc.binary_join_element_wise(*words, b" ")
            part = self.hashes[ids[0]]
            for place in range(1, self.size - 1):
                part = part ^ _turned(self.hashes[ids[place]], place)
            if self.size > 1:
                part = part * np.uint64(_BUCKETS) + self.hashes[ids[-1]] % np.uint64(_BUCKETS)
            spot = pa.array((part & np.uint64(0x7FFFFFFF)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), spot, phrase, pa.array(counts)], schema=_RUN)

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self.settle()
        for lang, trie in self.tries.items():
            yield from self._told(lang, trie, 0)
        if self.totals:
            langs = list(self.totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array([0] * len(langs), pa.int32()), pa.array([b""] * len(langs), pa.binary()),
                 pa.array([self.totals[lang] for lang in langs], pa.int64())], schema=_RUN,
            )


def runs(docs: DataFrame, size: int, bitmap=None, held: int = 1 << 20, burst: int = 4096, step: int = 1 << 19, words: int = 1 << 19) -> DataFrame:
    """(lang, part, phrase, f) runs of phrases of ``size`` words in ``docs(lang, text)``; a phrase may stand in several.

    ``bitmap`` is a broadcast of ``frequent_bits``. An empty phrase tells how many words a task met of a language.
    Held in a task: ``held`` entries and what ``step`` words add, ``words`` ids likewise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard = None if bitmap is None else Guard(np.frombuffer(bitmap.value, np.uint64))
        counter = Counter(size, guard, held, burst, step, words)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from counter.read(lang, text.as_py())
        yield from counter.finish()

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    return texts.mapInArrow(run, _RUN_SQL)


def merged(found: DataFrame) -> DataFrame:
    """(lang, phrase, f) sums of runs, one shuffle by language and prefix."""
    dealt = found.repartition("lang", "part").groupBy("lang", "part", "phrase").agg(F.sum("f").alias("f"))
    return dealt.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def _phrase_hash(size: int) -> Column:
    words, hashed = F.split("phrase", " "), F.xxhash64("lang")
    for place in range(size):
        word, by = F.xxhash64(F.get(words, F.lit(place))), _BITS * place
        hashed = hashed.bitwiseXOR(word if not by else F.shiftleft(word, by).bitwiseOR(F.shiftrightunsigned(word, 64 - by)))
    return hashed


def frequent_bits(phrases: DataFrame, size: int, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with two bits set for each of ``phrases(lang, phrase)``; all that comes to the driver."""
    spots = phrases.select(_phrase_hash(size).alias("h")).select(
        F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("h")
    ).select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("spot"))
    bit = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    slots = spots.groupBy(F.shiftright("spot", 6).alias("slot")).agg(F.bit_or(bit).alias("set")).toArrow()
    bitmap = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    bitmap[slots.column("slot").to_numpy()] = slots.column("set").to_numpy()
    return bitmap.view(np.uint64)


def frequent_phrases(docs: DataFrame, least: int = 10, bits: int = 26, **limits: int) -> tuple[DataFrame, list[DataFrame]]:
    """Word totals (lang, n), and for each number of words up to three (lang, phrase, f) with ``f >= least``."""
    levels, totals, bitmap = [], None, None
    for size in range(1, LONGEST + 1):
        counted = merged(runs(docs, size, bitmap, **limits))
        level = settled(counted.filter((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases-{size}")
        if size == 1:
            totals = level.filter("phrase = ''").select("lang", F.col("f").alias("n"))
        level = level.filter((F.col("phrase") != "") & (F.col("f") >= least))
        levels.append(level)
        if size < LONGEST:
            bitmap = docs.sparkSession.sparkContext.broadcast(frequent_bits(level, size, bits).tobytes())
    return totals, levels


def _counted(cuts: DataFrame, part: str, counts: DataFrame, name: str, salts: int = 1) -> DataFrame:
    """``cuts`` with the count of their ``part``. ``salts`` deal the uses of one part over so many places."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts).cast("long"))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("__salt")
    theirs = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name), places)
    return cuts.withColumn("__salt", salt).join(theirs, ["lang", part, "__salt"]).drop("__salt")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, bits: int = 26, **limits: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its worst cut, ``n`` all words of the language; ``score``
    is floor(10**6 * a * a / (l * r)), exact for counts up to 10**16. A pair goes that stands in a phrase of three, of
    ``least`` occurrences, at least ``share`` % as often. Order: score and a falling, phrase by its bytes. A NULL lang
    is ``und``, a NULL text is empty; words are what stands between spaces and tabs inside pieces, whatever their
    length; rows that repeat count again; an empty table gives no rows; other columns are ignored.
    """
    totals, (words, pairs, threes) = frequent_phrases(docs, least, bits, **limits)
    w = [F.get(F.split("phrase", " "), F.lit(i)) for i in range(LONGEST)]
    joined = lambda *parts: F.concat_ws(" ", *parts)
    cuts_2 = pairs.select("lang", "phrase", F.col("f").alias("a"), F.lit(1).alias("k"), w[0].alias("left"), w[1].alias("right"))
    in_threes = threes.select("lang", F.explode(F.array(joined(w[0], w[1]), joined(w[1], w[2]))).alias("phrase"), "f")
    longer = in_threes.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept_2 = cuts_2.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    ).drop("longer")
    three = threes.select("lang", "phrase", F.col("f").alias("a"), *[w[i].alias(f"w{i}") for i in range(LONGEST)])
    first = three.select("lang", "phrase", "a", F.lit(1).alias("k"), F.col("w0").alias("left"), joined("w1", "w2").alias("right"))
    second = three.select("lang", "phrase", "a", F.lit(2).alias("k"), joined("w0", "w1").alias("left"), F.col("w2").alias("right"))
    scored = (
        _counted(_counted(kept_2, "left", words, "l", _BUCKETS), "right", words, "r", _BUCKETS)
        .unionByName(_counted(_counted(first, "left", words, "l", _BUCKETS), "right", pairs, "r"))
        .unionByName(_counted(_counted(second, "left", pairs, "l"), "right", words, "r", _BUCKETS))
        .withColumn("score", F.expr("(cast(1000000 as decimal(38, 0)) * a * a) div (cast(l as decimal(38, 0)) * r)").cast("long"))
    )
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    ranked = top_k(
        worst.select("lang", "phrase", "a", "cut.*"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top
    )
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
