"""URL filters: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

Only DataFrame functions. Every distinct URL is expanded into its host's endings by labels and its path's beginnings
by segments; a beginning ends behind a slash or, for rules that end inside a segment, as many characters behind it as
some rule does. Expressions meet rules by the first 32 bits of their SHA-256 and are kept where all 256 bits agree.
What the driver learns of the rules is four numbers' worth: most labels, most segments, longest path and the
distinct lengths behind the last slash; the plan is the same for any number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A rule's host and path cannot be longer; this bounds what a URL is expanded into, and the lengths in the driver.
MOST_HOST, MOST_PATH = 255, 2048
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where it is NULL or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 4)


def prepared(rules: DataFrame) -> DataFrame:
    """``rules(verdict, rule)`` like ``block, example.com/de/`` with lengths, digests and numbers of labels and segments.

    The host is what stands before the first slash. Rules that are NULL or without a slash, or longer than the
    limits, fit nothing. Of two verdicts on one rule, block wins.
    """
    host = F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER)
    path = F.expr("substr(rule, instr(rule, '/'))")
    whole = rules.filter(F.col("verdict").isin("allow", "block") & F.contains("rule", F.lit("/"))).select(
        "verdict", F.col("rule").alias("rule"), host.alias("host"), path.alias("path")
    )
    sizes = whole.withColumn("host_len", F.length("host")).withColumn("path_len", F.length("path"))
    usable = sizes.filter(F.col("host_len").between(1, MOST_HOST) & (F.col("path_len") <= MOST_PATH))
    digest = _digest(F.col("host"), F.col("path"))
    parts = F.split("path", "/")
    return usable.groupBy(
        "rule", "host_len", "path_len", digest.alias("digest"), F.size(F.split("host", "[.]")).alias("labels"),
        (F.size(parts) - 1).alias("segments"), F.length(F.element_at(parts, -1)).alias("rest_len"),
    ).agg(F.max("verdict").alias("verdict"))


def _endings(host: Column, most: int) -> Column:
    """The endings of a host that begin at a label, of at most so many labels."""
    n = F.least(F.size(F.split(host, "[.]")), F.lit(most))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.call_function("substring_index", host, F.lit("."), -k))


def _beginnings(path: Column, most: int, longest: int, rests: list[int]) -> Column:
    """The beginnings of a path up to a slash, and from there ``rests`` characters inside the segment that follows."""
    path = F.left(path, F.lit(longest))
    n = F.least(F.size(F.split(path, "/")) - 1, F.lit(most))

    def of(k: Column) -> Column:
        before = F.length(F.call_function("substring_index", path, F.lit("/"), k)) + 1
        segment = F.length(F.call_function("substring_index", F.substr(path, before + 1), F.lit("/"), F.lit(1)))
        fitting = F.filter(F.array(*map(F.lit, rests)), lambda rest: rest <= segment)
        return F.transform(fitting, lambda rest: F.left(path, before + rest))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), of))).otherwise(F.array().cast("array<string>"))


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, verdict) for distinct ``urls(url)``: the longest rule that fits, else allow.

    Of rules of equal length the one with the longer host wins, then the first by code points.
    """
    known = prepared(rules)
    most = known.agg(F.max("labels"), F.max("segments"), F.max("path_len"), F.array_sort(F.collect_set("rest_len"))).first()
    host, path = host_and_path(F.col("url"))
    cut = urls.select("url", host.alias("host"), path.alias("path"))
    if most[0] is None:
        best = urls.sparkSession.createDataFrame([], "url string, rule string, verdict string")
    else:
        hosts, paths = _endings(F.col("host"), most[0]), _beginnings(F.col("path"), *most[1:])  # lengths: at most 2,048
        parts = cut.select("url", hosts.alias("hosts"), F.explode(paths).alias("beginning"))
        expanded = parts.select("url", "beginning", F.explode("hosts").alias("ending"))
        expanded = expanded.select("url", _digest(F.col("ending"), F.col("beginning")).alias("digest"))
        expanded = expanded.withColumn("short", _short(F.col("digest")))
        against = known.withColumn("short", _short(F.col("digest"))).withColumnRenamed("digest", "full")
        met = expanded.join(against, "short").filter(F.col("digest") == F.col("full"))
        falling = F.struct(-(F.col("host_len") + F.col("path_len")), -F.col("host_len"), F.col("rule"))
        best = met.groupBy("url").agg(F.min_by(F.struct("rule", "verdict"), falling).alias("said"))
        best = best.select("url", "said.rule", "said.verdict")
    return cut.join(best, "url", "left").select(
        "url", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages(page_id, url)``.

    A rule fits its host and all subdomains where the URL's path starts with the rule's. A NULL URL, or one
    without ``://``, has an empty host and path, which no rule fits. URLs that repeat are judged once and joined
    back, so a hot URL or host meets the rules once; rows that repeat are all returned. An empty table gives no
    rows, no rules allow everything, other columns are ignored.
    """
    picked = pages.select("page_id", "url")
    verdicts = judged(picked.filter("url is not null").select("url").distinct(), rules)
    back = picked.join(verdicts, "url", "left")
    return back.select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


#: The rules of the query, as its contract fixes them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
