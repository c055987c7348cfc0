"""Assistant event streams and chat histories as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from merchlens.functions.json_text import json_string, strict_variant

# Event types of a response stream.
TEXT, THINKING, TOOL, RESULT, TABLE, META, ERROR = (
    "response.text.delta", "response.thinking.delta", "response.tool_use", "response.tool_result", "response.table",
    "metadata", "error",
)


def _ordered(value: Column, when: Column) -> Column:
    pairs = F.collect_list(F.when(when, F.struct("seq", value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def assemble_turns(events: DataFrame) -> DataFrame:
    """One response per turn out of ``events(turn_id, seq, event_type, payload)``.

    Text and thinking pieces are joined in order; tools (id, type, name, input), their results (id, name, status,
    content) and tables are listed in order, JSON as text; the last ids and the first error win; a failed turn
    keeps only its error. Unreadable payloads are skipped. A row holds one response, whatever its length.
    """
    data = F.col("__d")
    read = (
        events.withColumn("__d", strict_variant(F.col("payload")))
        .filter("__d IS NOT NULL")
        .withColumn("__type", F.coalesce("event_type", json_string(data, "$.type")))
    )
    kind = F.col("__type")
    own = json_string(data, "$.text")
    delta = F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.coalesce(json_string(data, "$.delta.text"), F.lit("")))

    def record(**paths: str) -> Column:
        return F.struct(*[json_string(data, path).alias(name) for name, path in paths.items()])

    facts = read.select(
        "turn_id", "seq", "__type", delta.alias("__text"), F.coalesce(own, F.lit("")).alias("__thinking"),
        record(tool_use_id="$.tool_use_id", type="$.tool_type", name="$.name", input="$.input").alias("__tool"),
        record(tool_use_id="$.tool_use_id", name="$.name", status="$.status", content="$.content").alias("__result"),
        json_string(data, "$.content").alias("__content"),
        json_string(data, "$.thread_id").alias("__thread"), json_string(data, "$.message_id").alias("__message"),
        F.coalesce(json_string(data, "$.message"), F.lit("Unknown error")).alias("__error"),
    )
    turns = facts.groupBy("turn_id").agg(
        F.max_by(F.struct("__thread", "__message"), F.when(kind == META, F.col("seq"))).alias("ids"),
        F.min_by("__error", F.when(kind == ERROR, F.col("seq"))).alias("error"),
        F.array_join(_ordered(F.col("__text"), kind == TEXT), "").alias("text"),
        F.array_join(_ordered(F.col("__thinking"), kind == THINKING), "").alias("thinking"),
        _ordered(F.col("__tool"), kind == TOOL).alias("tools"),
        _ordered(F.col("__result"), kind == RESULT).alias("tool_results"),
        _ordered(F.col("__content"), kind == TABLE).alias("tables"),
    )
    ok = F.col("error").isNull()
    return turns.select(
        "turn_id", ok.alias("success"), F.when(ok, F.col("text")).alias("text"),
        F.when(ok & (F.col("thinking") != ""), F.col("thinking")).alias("thinking"),
        F.when(ok, F.col("tools")).alias("tools"), F.when(ok, F.col("tool_results")).alias("tool_results"),
        F.when(ok, F.col("tables")).alias("tables"), F.when(ok, F.col("ids.__thread")).alias("thread_id"),
        F.when(ok, F.col("ids.__message")).alias("message_id"), "error",
    )


def current_turns(turns: DataFrame) -> DataFrame:
    """Each session's newest turn."""
    return turns.groupBy("session_id").agg(F.max("turn").alias("current_turn"))


def history(turns: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The non-blank messages before each session's current turn, one row per message in turn order."""
    asked = current_turns(turns) if current is None else current
    spoken = turns.filter(F.trim("text") != "").select("session_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), "text")
    return spoken.join(asked, "session_id").filter("turn < current_turn").select(
        "session_id", "current_turn", "turn", "role", "text"
    )


def request_messages(turns: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """What is sent for each session's current turn: its history and the current message, in turn order."""
    asked = current_turns(turns) if current is None else current
    now = turns.join(asked, "session_id").filter("turn = current_turn")
    return history(turns, asked).unionByName(now.select("session_id", "current_turn", "turn", "role", "text"))


def masked_profile(customers: DataFrame, claims: DataFrame, fields=("loyalty_tier", "points_balance")) -> DataFrame:
    """Account fields of ``claims(customer_id, claimed_email)`` shown only when the e-mail matches, ignoring case."""
    seen = claims.join(customers.select("customer_id", "first_name", "email", *fields), "customer_id")
    same = F.coalesce(F.lower("email") == F.lower("claimed_email"), F.lit(False))
    return seen.select(
        "customer_id", "first_name", same.alias("verified"), *[F.when(same, F.col(f)).alias(f) for f in fields]
    )
