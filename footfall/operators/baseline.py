"""Baseline venue scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalar import ratio
from footfall.operators.scale import portable_hash, scalar, scalar_quantiles


def rating(inter: DataFrame) -> DataFrame:
    rated = inter.where(F.col("stars").isNotNull())
    return rated.groupBy("business_id").agg(F.avg("stars").alias("rating_mean"), F.count("stars").alias("rating_count"))


def popularity(inter: DataFrame) -> DataFrame:
    return inter.groupBy("business_id").agg(F.count(F.lit(1)).alias("popularity_visits"))


def inverse_user_frequency(inter: DataFrame) -> DataFrame:
    """Each visit counts 1 / log(1 + venues of its user); summed per (user, venue) before the join."""
    pairs = inter.where(F.col("user_id").isNotNull()).groupBy("user_id", "business_id").agg(F.count(F.lit(1)).alias("n"))
    venues = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("venues"))
    return (
        pairs.join(venues, "user_id")
        .groupBy("business_id")
        .agg(F.sum(F.col("n") / F.log1p("venues")).alias("iuf"))
    )


def random_score(venues: DataFrame, seed: int = 42) -> DataFrame:
    """A fixed pseudo-random score in [0, 1) per venue."""
    key = F.col("business_id").cast("string")
    return venues.select("business_id").distinct().withColumn(
        "score", portable_hash(F.lit(str(seed)), key) / F.lit(4294967296.0)
    )


def merge_baselines(ratings: DataFrame, visits: DataFrame, revisits: DataFrame) -> DataFrame:
    """Outer merge; a missing rating is the median rating, missing counts and rates are 0."""
    merged = ratings.join(visits, "business_id", "outer").join(
        revisits.select("business_id", "revisit_rate", "unique_users", "repeat_users"), "business_id", "outer"
    )
    (median,) = scalar_quantiles(ratings, "rating_mean", 0.5)
    return merged.withColumns(
        {
            "rating_mean": F.coalesce("rating_mean", median),
            "popularity_visits": F.coalesce("popularity_visits", F.lit(0)),
            "revisit_rate": F.coalesce("revisit_rate", F.lit(0.0)),
        }
    )


def merge_ranking(baselines: DataFrame, scores: DataFrame) -> DataFrame:
    """Add ranking scores; a venue without score gets 0 and the last rank (number of rows)."""
    merged = baselines.join(scores.select("business_id", "score", "rank"), "business_id", "outer")
    rows = scalar(merged.select("business_id").agg(F.count(F.lit(1)).alias("n")))
    return merged.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn(
        "rank", F.coalesce("rank", rows).cast("bigint")
    )


def share_of_total(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    return df.withColumn(name, ratio(column, scalar(df.agg(F.sum(column).alias("t")))))
