"""Secrets by fixed rules, and multipart credentials linked over intervals. Only DataFrame functions.

One pass over the texts finds, for every kind, matches as lengths of the text between them and of themselves;
running sums of those are places. Base kinds are reported as they are. Weak candidates (named identifiers, named or
random-looking secrets, endpoints) are reported only where complementary parts stand in the same scope, a stretch
without blank lines, and in reach. That is an interval join: places are dealt to bins as wide as the reach, every bin
is summed up by the first and last place of each part, and a candidate meets the summaries of its own and the two
neighbouring bins. So neither a long document nor one with many parts is held in one place, and no pairs are made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from merchlens.session import settled

_NAMED = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Finder:
    """A pattern of a kind. The place is the whole match, or its first group, which ends it."""

    kind: str
    role: str
    pattern: str
    group: bool = False
    least: int = 0  # characters in the first group
    needs: tuple[str, ...] = ()  # what a match must hold


#: Base kinds, in the order of reports.
BASE = (
    Finder("assign", "secret", r"(?i)(?:password|passwd|secret|token|api_?key)" + _NAMED + r"([A-Za-z0-9+/_.=-]+)", least=6),
    Finder("access", "identifier", r"AKIA[A-Z0-9]{16,}"),
    Finder("hex", "secret", r"[0-9a-f]{24,}"),
)
#: Weak kinds; every pattern runs in linear time.
WEAK = (
    Finder(
        "identifier", "identifier",
        r"(?i)(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|key_?id|tenant_?id|project_?id)" + _NAMED + r"([A-Za-z0-9_.@+-]{3,})",
        group=True,
    ),
    Finder(
        "secret", "secret",
        r"(?i)(?:pass|pwd|passphrase|credentials?|private_?key|access_?key|auth|signature)" + _NAMED + r"([A-Za-z0-9+/_.=!@$%^&*-]{4,})",
        group=True,
    ),
    Finder("secret", "secret", r"[A-Za-z0-9+/_=-]{20,}", needs=("[0-9]", "[a-z]", "[A-Z]")),
    Finder("endpoint", "endpoint", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+"),
    Finder(
        "endpoint", "endpoint",
        r"(?i)(?:host(?:_?name)?|server|endpoint|bucket|database|dsn)" + _NAMED + r"([A-Za-z0-9_.:/@-]{3,})", group=True,
    ),
)
FINDERS = (*BASE, *WEAK)
#: Where a scope ends.
_BLANK = Finder("", "", r"\n[\x20\x09\x0D]*\n")
_BLANK_NO = len(FINDERS)
#: Kinds in the order of reports.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")


def _matches(text: Column, no: int, finder: Finder) -> Column:
    """(no, at): for each match the characters before it, its own, those of its place, and whether it counts."""
    pattern = F.lit(finder.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    named = F.regexp_extract_all(text, pattern, F.lit(1)) if finder.group or finder.least else whole
    gaps = F.slice(F.split(text, finder.pattern, -1), F.lit(1), F.size(whole))

    def one(parts: Column) -> Column:
        good = F.length(parts["named"]) >= finder.least
        for need in finder.needs:
            good = good & parts["whole"].rlike(need)
        place = parts["named"] if finder.group else parts["whole"]
        return F.struct(
            F.length(parts["gap"]).alias("gap"), F.length(parts["whole"]).alias("size"), F.length(place).alias("place"), good.alias("good")
        )

    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), named.alias("named"))
    return F.struct(F.lit(no).alias("no"), F.transform(zipped, one).alias("at"))


def matched(docs: DataFrame) -> DataFrame:
    """(row, doc_id, marks) of ``docs(doc_id, text)``; weak kinds only in texts with an identifier and a secret.

    A row's number holds as long as the table that it was written to.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    has = lambda role: reduce(
        Column.__or__, [F.col("text").rlike(f.pattern) for f in FINDERS if f.role == role]
    )
    told = rows.withColumn("whole", has("identifier") & has("secret"))
    found = [F.when(F.col("text").rlike(f.pattern), _matches(F.col("text"), no, f)) for no, f in enumerate(BASE)]
    weak = [
        F.when(F.col("whole") & F.col("text").rlike(f.pattern), _matches(F.col("text"), no, f))
        for no, f in [*enumerate(WEAK, len(BASE)), (_BLANK_NO, _BLANK)]
    ]
    return told.select("row", "doc_id", "whole", F.array_compact(F.array(*found, *weak)).alias("marks"))


def places(marks: DataFrame) -> DataFrame:
    """(row, whole, no, start, end) of the matches that count, from running sums per row and pattern."""
    each = marks.select("row", "whole", F.explode("marks").alias("m")).select("row", "whole", "m.no", F.posexplode("m.at").alias("i", "at"))
    upto = Window.partitionBy("row", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("end", F.sum((F.col("at.gap") + F.col("at.size")).cast("long")).over(upto))
    return ends.filter("at.good").select("row", "whole", "no", (F.col("end") - F.col("at.place")).alias("start"), "end")


def _numbers(test) -> list[int]:
    return [no for no, f in enumerate(FINDERS) if test(f)]


def linked(spans: DataFrame, reach: int) -> DataFrame:
    """(row, no, start, end) of the weak ``places`` that complementary parts stand by, at most ``reach`` from start to start.

    An identifier needs a secret and a secret an identifier, which are of a base kind or have an endpoint beside
    them; an endpoint needs both. Weak parts that begin inside an earlier one are no parts, and those that touch a base
    span are parts but not reported.
    """
    weak, base = F.col("no").between(len(BASE), _BLANK_NO - 1), F.col("no") < len(BASE)
    rising = Window.partitionBy("row").orderBy("start", "no")
    before, falling = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("no"))
    marked = (
        spans.filter("whole")
        .withColumn("scope", F.count_if(F.col("no") == _BLANK_NO).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("weak_end", F.coalesce(F.max(F.when(weak, F.col("end"))).over(before), F.lit(-1)))
        .withColumn("base_end", F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1)))
        .withColumn("base_start", F.min(F.when(base, F.col("start"))).over(falling.rowsBetween(Window.unboundedPreceding, -1)))
    )
    parts = settled(
        marked.filter(base | (weak & (F.col("weak_end") <= F.col("start")))).select(
            "row", "scope", "no", "start", "end", F.floor(F.col("start") / reach).alias("bin"),
            (weak & (F.col("base_end") <= F.col("start")) & (F.col("base_start").isNull() | (F.col("base_start") >= F.col("end")))).alias("open"),
        ),
        "secret-parts",
    )
    groups = {
        "identifier": _numbers(lambda f: f.role == "identifier"), "secret": _numbers(lambda f: f.role == "secret"),
        "endpoint": _numbers(lambda f: f.role == "endpoint"), "sure_identifier": _numbers(lambda f: f in BASE and f.role == "identifier"),
        "sure_secret": _numbers(lambda f: f in BASE and f.role == "secret"),
    }
    here = {name: F.when(F.col("no").isin(numbers), F.col("start")) for name, numbers in groups.items()}
    bins = parts.groupBy("row", "scope", F.col("bin").alias("met")).agg(
        *[F.min(place).alias(f"{name}_first") for name, place in here.items()], *[F.max(place).alias(f"{name}_last") for name, place in here.items()]
    )
    around = F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("met")
    asking = parts.filter("open").select("row", "scope", "no", "start", "end", "bin", around)

    def near(name: str) -> Column:
        first, last = F.col(f"{name}_first"), F.col(f"{name}_last")
        told = F.when(F.col("met") < F.col("bin"), last >= F.col("start") - reach).when(
            F.col("met") > F.col("bin"), first <= F.col("start") + reach
        ).otherwise(first.isNotNull())
        return F.bool_or(F.coalesce(told, F.lit(False))).alias(name)

    sums = asking.join(bins, ["row", "scope", "met"]).groupBy("row", "no", "start", "end").agg(*[near(name) for name in groups])
    role = lambda name: F.col("no").isin(groups[name])
    good = (
        (role("identifier") & F.col("secret") & (F.col("sure_secret") | F.col("endpoint")))
        | (role("secret") & F.col("identifier") & (F.col("sure_identifier") | F.col("endpoint")))
        | (role("endpoint") & F.col("identifier") & F.col("secret"))
    )
    return sums.filter(good).select("row", "no", "start", "end")


def scan(docs: DataFrame, reach: int = 400) -> DataFrame:
    """(doc_id, spans) for every row of ``docs(doc_id, text)``: (start, order, kind, end) in code points, sorted.

    ``order`` is the kind's place in KINDS. A NULL text is empty. Rows that repeat and NULL ids are searched like any
    other, an empty table gives no rows, other columns are ignored. Places of one text are gathered in its row.
    """
    rows = settled(matched(docs), "secret-rows")
    spans = settled(places(rows), "secret-places")
    told = spans.filter(F.col("no") < len(BASE)).select("row", "no", "start", "end").unionByName(linked(spans, reach))
    order = F.element_at(F.array(*[F.lit(KINDS.index(f.kind)) for f in FINDERS]), F.col("no") + 1)
    kind = F.element_at(F.array(*[F.lit(f.kind) for f in FINDERS]), F.col("no") + 1)
    span = F.struct("start", order.alias("order"), kind.alias("kind"), "end")
    per_row = told.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return rows.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, reach: int = 400) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked): counts and digest of the base spans, all spans written."""
    found = scan(docs, reach)
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of = lambda kind: count(lambda s: s["kind"] == kind).alias(f"n_{kind}")
    return found.select(
        "doc_id", *[of(f.kind) for f in BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        count(lambda s: s["order"] >= len(BASE)).alias("n_linked"),
    )
