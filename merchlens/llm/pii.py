"""Personal data by fixed rules, and by contexts that the rules' finds teach.

One pass over the texts finds the base spans and every other token or run of digit groups that looks like an identifier, each
with the lexical patterns of the words before it. The base finds are seeds. Spark then scores the graph of patterns and
instances in turns, until nothing is added: a pattern is as trustworthy for a kind as the share of its distinct
instances that are of that kind, once enough of them are seeds or trusted themselves, an instance as the chance that
not all its patterns are wrong. Tokens that follow trusted patterns become spans of that kind. Only sums per pattern
and per instance are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from merchlens.llm.common import batch_of
from merchlens.session import settled

KINDS = ("email", "ip", "card", "phone")
_RUN_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Groups of digits joined by spaces, dots, dashes and brackets, from a place where a word can begin; a full stop ends it.
_GROUPS = re.compile(
    r"(?<![^\s\[{<\"'(:;,])\(?\+?[0-9]{1,8}+(?![0-9])(?:(?:(?!\.\s)[\x20().-])++[0-9]{1,8}+(?![0-9]))+(?!\w|@|[:/][0-9])"
)
_ANY = re.compile(r"[0-9@]")
_LOOKS = re.compile(r"[0-9]{3}|@")
_SPACE = re.compile(r"\s")
#: Characters of context looked at before a span, so that a long word can't make a pattern long.
_CONTEXT = 80
_EDGE = ".,;:!?()[]{}<>\"'"


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email rule, from one @ to the next, in linear time."""
    found, past, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > past and _RUN_BEFORE.match(text[start - 1]):
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                past = domain.end()
        at = text.find("@", max(at + 1, past))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    """Every four numbers in turn of a chain of numbers joined by dots, where none is above 255."""
    found = []
    for chain in _CHAIN.finditer(text):
        if "." in chain[0]:
            parts = list(_DIGITS.finditer(text, *chain.span()))
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                if all(len(p := m[0].lstrip("0")) <= 3 and int(p or 0) <= 255 for m in four):
                    found.append((four[0].start(), four[3].end()))
    return found


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index in KINDS, start, end) by kind, then start; code points, end exclusive."""
    if not _ANY.search(text):
        return []
    return [(k, *span) for k, find in enumerate((emails, ips, cards, phones)) for span in find(text)]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places that look like identifiers and touch no base span.

    Runs of digit groups, of 7 to 19 digits in all as cards and phones have, and outside of those the tokens with
    three digits in a row or an @, as long as they are, without marks at their edges.
    """
    busy = sorted((s, e) for _, s, e in taken)
    runs = _free([m.span() for m in _GROUPS.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 19], busy)
    tokens, at = [], 0
    while m := _LOOKS.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        at = end
        token = text[start:end]
        start += len(token) - len(token.lstrip(_EDGE))
        end -= len(token) - len(token.rstrip(_EDGE))
        if start < end:
            tokens.append((start, end))
    return sorted(runs + _free(tokens, sorted(busy + runs)))


def _free(places: list[tuple[int, int]], busy: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of disjoint places that touch no busy one; both sorted."""
    found, k = [], 0
    for start, end in places:
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        if k == len(busy) or busy[k][0] >= end:
            found.append((start, end))
    return found


def _surface(text: str) -> str:
    """A place's text, lower-cased; the digest of a long one."""
    low = text.lower()
    return low if len(low) <= 200 else hashlib.sha256(low.encode()).hexdigest()


def patterns(text: str, start: int) -> list[str]:
    """The last word and the last two words before a place, lower-cased, digits as 0; none at a text's start."""
    words = _DIGITS.sub("0", text[max(0, start - _CONTEXT) : start].lower()).split()[-2:]
    return ["one " + words[-1], "two " + " ".join(words)] if len(words) == 2 else [f"one {w}" for w in words]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))])
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])
_FOUND_SQL = (
    "row long, doc_id long, spans array<struct<kind int, start long, end long, surface string, patterns array<string>>>"
)


def found(docs: DataFrame) -> DataFrame:
    """(row, doc_id, spans) of every text: base spans with their kind, candidates with kind -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                base = base_spans(text)
                more = [(-1, s, e) for s, e in candidates(text, base)] if base or _ANY.search(text) else []
                spans = [
                    {"kind": k, "start": s, "end": e, "surface": _surface(text[s:e]), "patterns": patterns(text, s)}
                    for k, s, e in base + more
                ]
                out.append((row, doc, spans))
                row += 1
            if out:
                yield batch_of(_FOUND, list(zip(*out)))

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).mapInArrow(run, _FOUND_SQL)


def trusted(spans: DataFrame, least: int = 5, trust: float = 0.8, change: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Patterns and instances to trust, as (pattern, kind) and (surface, kind), from ``spans(kind, surface, patterns)``.

    A pattern counts each distinct surface once and needs ``least`` surfaces that are seeds of its kind or trusted
    instances; a surface found as several kinds counts for each of them. Scores only grow from round to round; the
    rounds go on until no pattern's strength, new ones included, has grown by ``change``.
    """
    edges = settled(
        spans.select("kind", "surface", F.explode("patterns").alias("pattern")).filter("pattern is not null").distinct(), "pii-edges"
    )
    # A pattern with fewer surfaces can't get the support it needs.
    sizes = edges.groupBy("pattern").agg(F.count_distinct("surface").alias("size")).filter(F.col("size") >= least)
    live = settled(edges.join(sizes, "pattern"), "pii-live")
    seeds = live.filter("kind >= 0").select("pattern", "size", "surface", "kind", F.lit(1.0).alias("score"))
    unseen = live.filter("kind < 0").drop("kind")
    scores, strong = live.sparkSession.createDataFrame([], "surface string, kind int, score double"), None
    while True:
        learned = unseen.join(scores, "surface").select("pattern", "size", "surface", "kind", "score")
        # A surface that is a seed in one place and unseen in another counts once.
        known = seeds.unionByName(learned).groupBy("pattern", "size", "surface", "kind").agg(F.max("score").alias("score"))
        sums = known.groupBy("pattern", "size", "kind").agg(
            F.sum("score").alias("score"), F.count_if(F.col("score") >= trust).alias("support")
        )
        before, strong = strong, settled(
            sums.filter(F.col("support") >= least).select("pattern", "kind", (F.col("score") / (F.col("size") + 1)).alias("strength")).filter(
                F.col("strength") >= trust / 2
            ),
            "pii-patterns",
        )
        misses = F.exp(F.sum(F.log(F.lit(1.0) - F.col("strength"))))
        scores = settled(
            unseen.join(strong, "pattern").groupBy("surface", "kind").agg((F.lit(1.0) - misses).alias("score")).filter(
                F.col("score") >= trust / 2
            ),
            "pii-instances",
        )
        if before is None:
            grown = strong
        else:
            was = before.withColumnRenamed("strength", "was")
            grown = strong.join(was, ["pattern", "kind"], "left").filter(F.col("strength") - F.coalesce("was", F.lit(0.0)) >= change)
        if grown.isEmpty():
            break
    return strong.filter(F.col("strength") >= trust).select("pattern", "kind"), scores.filter(F.col("score") >= trust).select("surface", "kind")


def _written(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined; empty without spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def detect(docs: DataFrame, least: int = 5, trust: float = 0.8) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs(doc_id, text)``.

    The counts and the digest are the base spans'; ``spans`` has those and the ones that contexts add. A new span
    takes the kind that comes first in KINDS of those its patterns are trusted for. A NULL text is empty. Repeated
    rows and NULL ids are searched like any other row, an empty table gives no rows, other columns are ignored.
    """
    rows = settled(found(docs), "pii-found")
    every = rows.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    good, instances = trusted(every.drop("row"), least, trust)
    unseen = every.filter("kind < 0").select("row", "start", "end", "surface", F.explode("patterns").alias("pattern"))
    added = (
        unseen.join(good, "pattern").join(instances, ["surface", "kind"])
        .groupBy("row", "start", "end").agg(F.min("kind").alias("kind"))
        .groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))  # one text's spans
    )
    base = F.filter("spans", lambda s: s["kind"] >= 0)
    plain = F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = rows.join(added, "row", "left")
    whole = F.when(F.col("added").isNull(), plain).otherwise(F.concat(plain, "added"))
    return joined.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_written(plain).cast("binary"), 256).alias("base_sha256"), _written(whole).alias("spans"),
    )
