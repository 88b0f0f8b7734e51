"""Interaction log: building it, splitting it in time, and turning it into weighted edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalar import age_days, decay, tokens
from footfall.operators.scale import attach, spread_join


def explode_checkins(checkins: DataFrame, date_col: str = "date") -> DataFrame:
    """One row per timestamp of a comma-separated check-in list; unreadable stamps become NULL."""
    out = checkins.withColumn("ts_text", F.explode(tokens(date_col))).drop(date_col)
    return out.withColumn("ts", F.try_to_timestamp("ts_text")).drop("ts_text")


def union_events(*sources: DataFrame) -> DataFrame:
    """Stack event sources by column name; columns a source lacks are NULL."""
    first, *rest = sources
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def user_linked(df: DataFrame) -> DataFrame:
    return df.where(F.col("user_id").isNotNull())


def temporal_split(df: DataFrame, *cutoffs, ts: str = "ts") -> list[DataFrame]:
    """Parts before, between and from the cutoffs on, as plain range filters the scan can use."""
    bounds = [F.lit(c).cast("timestamp") for c in cutoffs]
    parts = [df.where(F.col(ts) < bounds[0])]
    parts += [df.where((F.col(ts) >= lo) & (F.col(ts) < hi)) for lo, hi in zip(bounds, bounds[1:])]
    return parts + [df.where(F.col(ts) >= bounds[-1])]


def edges(
    inter: DataFrame,
    mode: str = "count",
    as_of: Column | None = None,
    lam: float = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weighted user-venue edges.

    ``count``: visits per pair. ``decay``: each visit fades with its age. ``credibility``: faded visits
    (age in whole days) times log visits of the user over log visits of the busiest user.
    """
    linked = user_linked(inter)
    keys = [*by, "user_id", "business_id"]
    if mode == "count":
        return linked.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if as_of is None:
        raise ValueError(f"mode {mode!r} needs as_of")
    faded = linked.groupBy(*keys).agg(
        F.sum(decay(age_days("ts", as_of, whole=mode == "credibility"), lam)).alias("weight"),
        F.count(F.lit(1)).alias("n"),
    )
    if mode == "decay":
        return faded.drop("n")
    # The factor is the same for all rows of a user, so it is applied once per pair, after the sum.
    per_user = faded.groupBy(*by, "user_id").agg(F.sum("n").alias("n_user"))
    top = per_user.groupBy(*by).agg(F.max("n_user").alias("n_top")) if by else per_user.agg(F.max("n_user").alias("n_top"))
    trust = attach(per_user, top, list(by)).select(
        *by, "user_id", (F.log1p("n_user") / F.log1p("n_top")).alias("trust")
    )
    return faded.join(trust, [*by, "user_id"]).select(*keys, (F.col("weight") * F.col("trust")).alias("weight"))


def graph_stats(edge: DataFrame) -> DataFrame:
    """One row: node and edge counts, total weight, degree statistics and density."""
    from footfall.operators.scale import quantiles

    sides = []
    for side, key in (("user", "user_id"), ("venue", "business_id")):
        deg = edge.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("degree"))
        stats = deg.agg(
            F.count(F.lit(1)).alias(f"{side}s"),
            F.avg("degree").alias(f"{side}_degree_mean"),
            F.max("degree").alias(f"{side}_degree_max"),
            F.min("degree").alias(f"{side}_degree_min"),
        )
        med = quantiles(deg, ["degree"], {"p50": 0.5}).withColumnRenamed("degree_p50", f"{side}_degree_median")
        sides.append(attach(stats, med, []))
    total = edge.agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("total_weight"))
    out = attach(attach(total, sides[0], []), sides[1], [])
    return out.withColumn("density", F.col("edges") / (F.col("users").cast("double") * F.col("venues")))


def restrict_to_venues(inter: DataFrame, venues: DataFrame) -> DataFrame:
    return spread_join(inter, venues.select("business_id").distinct(), ["business_id"], "left_semi")


def overlap_users(train: DataFrame, test: DataFrame) -> DataFrame:
    """Users seen on both sides of a split."""
    return (
        user_linked(train).select("user_id").distinct().join(user_linked(test).select("user_id").distinct(), "user_id", "left_semi")
    )


def month_series(df: DataFrame, ts: str = "ts") -> DataFrame:
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(F.date_trunc("month", ts).cast("date").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def hour_distribution(df: DataFrame, hour: Column) -> DataFrame:
    """Events per hour with the peak hour (earliest on ties) on every row."""
    per = df.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    # Twenty-four rows at most.
    peak = per.agg(F.min_by("hour", F.struct(-F.col("n"), F.col("hour"))).alias("peak_hour"))
    return attach(per, peak, [])
