"""Products people talk about most in a moving time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchlens.operators.spread import top_k


def trending(mentions: DataFrame, hours: int = 24, slide_hours: int = 1, k: int = 10) -> DataFrame:
    """Top ``k`` products per window of ``hours``, a new window every ``slide_hours``.

    The trend score is our own: mentions per hour x (1 + mean sentiment). Mentions are first counted per
    slide step, so a mention is not copied into every window it belongs to.
    """
    step = slide_hours * 3600
    at = F.unix_timestamp(F.col("posted_at").cast("timestamp"))
    steps = (
        mentions.withColumn("__step", F.floor(at / step))
        .groupBy("product_id", "__step")
        .agg(F.count("*").alias("n"), F.sum("sentiment_score").alias("s"), F.count("sentiment_score").alias("sn"))
    )
    spans = hours // slide_hours
    windows = steps.withColumn("__w", F.explode(F.sequence(F.col("__step") - (spans - 1), F.col("__step"))))
    scored = windows.groupBy("__w", "product_id").agg(
        F.sum("n").alias("mention_count"), (F.sum("s") / F.sum("sn")).alias("sentiment_average")
    ).select(
        F.timestamp_seconds(F.col("__w") * step).cast("timestamp_ntz").alias("window_start"),
        F.timestamp_seconds((F.col("__w") + spans) * step).cast("timestamp_ntz").alias("window_end"),
        "product_id",
        "mention_count",
        F.round(F.col("mention_count") / hours, 4).alias("mention_velocity"),
        F.round("sentiment_average", 4).alias("sentiment_average"),
        F.round(F.col("mention_count") / hours * (1 + F.coalesce("sentiment_average", F.lit(0.0))), 4).alias("trend_score"),
    )
    order = [F.col("trend_score").desc(), F.col("mention_count").desc(), F.col("product_id").asc()]
    return top_k(scored, ["window_start", "window_end"], order, k, "trend_rank")
