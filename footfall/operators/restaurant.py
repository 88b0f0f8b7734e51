"""Restaurant profiles: users, venues and busyness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalar import contains_any, haversine_km, ratio, tokens
from footfall.operators.clean import NIGHTLIFE_WORDS
from footfall.operators.features import burstiness, entropy_of, gini, pair_counts, rows, venue_weekly
from footfall.operators.scale import quantiles


def spatial_range(reviews: DataFrame, businesses: DataFrame, q: float = 0.9) -> DataFrame:
    """90 % quantile of the distances of a user's places to their middle, over all distinct places: linear in the places, where
    distances between all of them would grow with their square."""
    places = pair_counts(reviews).select("user_id", "business_id").join(
        businesses.where(F.col("latitude").isNotNull()).select("business_id", "latitude", "longitude"), "business_id"
    )
    middle = places.groupBy("user_id").agg(F.avg("latitude").alias("_lat"), F.avg("longitude").alias("_lon"))
    far = places.join(middle, "user_id").select("user_id", haversine_km("latitude", "longitude", "_lat", "_lon").alias("km"))
    return quantiles(far, ["km"], {"q": q}, ["user_id"]).select("user_id", F.col("km_q").alias("spatial_range_km"))


def restaurant_user_features(reviews: DataFrame, businesses: DataFrame, min_reviews: int = 3) -> DataFrame:
    """Volume, entropy, ratings of visited venues, category entropy, nightlife and easy-parking shares, centroid,
    spatial range and burstiness of users with enough reviews. ``businesses`` needs stars, categories, position and
    parking_lot / parking_garage."""
    linked = reviews.where(F.col("user_id").isNotNull())
    easy = F.coalesce("parking_lot", F.lit(False)) | F.coalesce("parking_garage", F.lit(False))
    info = businesses.select(
        "business_id", "stars", "categories", "latitude", "longitude",
        contains_any("categories", NIGHTLIFE_WORDS).alias("night"), easy.alias("easy"), F.lit(1).alias("known"),
    )
    visits = pair_counts(linked).join(info, "business_id", "left")
    n, s = F.col("n"), F.col("stars")
    rated = F.sum(F.when(s.isNotNull(), n))
    mean = ratio(F.sum(n * s), rated)
    var = ratio(F.sum(n * s * s), rated) - mean * mean
    base = visits.groupBy("user_id").agg(
        F.sum("n").alias("total_visits"),
        rows().alias("unique_venues"),
        entropy_of("n").alias("venue_entropy"),
        F.coalesce(mean, F.lit(3.0)).alias("avg_visited_rating"),
        F.when(rated > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("rating_std"),
        ratio(F.sum(F.when(F.col("night"), n).otherwise(0)), F.sum(n)).alias("nightlife_affinity"),
        ratio(F.sum(F.when(F.col("easy"), n).otherwise(0)), F.sum(n)).alias("parking_sensitivity"),
        F.coalesce(F.avg("latitude"), F.lit(0.0)).alias("centroid_lat"),
        F.coalesce(F.avg("longitude"), F.lit(0.0)).alias("centroid_lon"),
    ).where(F.col("total_visits") >= min_reviews)
    kinds = (
        visits.select("user_id", "n", F.explode(tokens("categories")).alias("kind"))
        .groupBy("user_id", "kind")
        .agg(F.sum("n").alias("n"))
        .groupBy("user_id")
        .agg(entropy_of("n").alias("category_entropy"))
    )
    return (
        base.join(kinds, "user_id", "left")
        .join(spatial_range(linked, businesses), "user_id", "left")
        .join(burstiness(linked, kind="positive"), "user_id", "left")
        .withColumn("revisit_ratio", ratio(F.col("total_visits") - F.col("unique_venues"), "total_visits"))
        .fillna({"category_entropy": 0.0, "spatial_range_km": 0.0, "burstiness": 0.0})
    )


def restaurant_venue_features(inter: DataFrame, businesses: DataFrame) -> DataFrame:
    """All events, reviewers, repeat share, Gini, mean rating, consistency, weekly cv over all weeks, first categories."""
    known = inter.where(F.col("user_id").isNotNull())
    pairs = pair_counts(known)
    users = pairs.groupBy("business_id").agg(
        rows().alias("unique_visitors"), ratio(F.count_if(F.col("n") > 1), rows()).alias("repeat_user_rate")
    )
    ratings = known.groupBy("business_id").agg(
        F.avg("stars").alias("_mean"),
        F.when(F.count("stars") > 1, 1 / (F.stddev_pop("stars") + 0.1)).otherwise(F.lit(1.0)).alias("_steady"),
    )
    events = inter.groupBy("business_id").agg(rows().alias("popularity"))
    return (
        businesses.select("business_id", "stars", "categories")
        .join(events, "business_id", "left")
        .join(users, "business_id", "left")
        .join(gini(pairs, ["business_id"], "n", "_gini"), "business_id", "left")
        .join(ratings, "business_id", "left")
        .join(venue_weekly(known, empty_weeks=True), "business_id", "left")
        .select(
            "business_id",
            F.coalesce("popularity", F.lit(0)).alias("popularity"),
            F.coalesce("unique_visitors", F.lit(0)).alias("unique_visitors"),
            F.coalesce("repeat_user_rate", F.lit(0.0)).alias("repeat_user_rate"),
            F.coalesce("_gini", F.lit(0.0)).alias("gini_user_concentration"),
            F.coalesce("_mean", "stars", F.lit(3.0)).alias("avg_rating"),
            F.coalesce("_steady", F.lit(1.0)).alias("rating_consistency"),
            F.coalesce("stability_cv", F.lit(1.0)).alias("stability_cv"),
            F.concat_ws(", ", F.slice(tokens("categories"), 1, 3)).alias("cuisine_categories"),
        )
    )


def hour_cells(events: DataFrame, ts: Column, key: str = "business_id") -> DataFrame:
    """Events per weekday and hour, with their share (0-100) of the busiest cell."""
    cells = events.where(ts.isNotNull()).groupBy(key, F.weekday(ts).alias("dow"), F.hour(ts).alias("hour")).agg(rows().alias("n"))
    # At most 168 cells per venue.
    top = F.max("n").over(Window.partitionBy(key))
    return cells.withColumn("busyness", F.col("n") / top.cast("double") * 100)


def busyness(events: DataFrame, ts: Column, cells: str = "observed", key: str = "business_id", venues: DataFrame | None = None) -> DataFrame:
    """Peak, mean and peak hour of a venue's week.

    ``observed``: rounded shares averaged over the cells with events. ``all``: averaged over all 168 cells.
    With ``venues``, those without events get 0, 0 and noon.
    """
    grid = hour_cells(events, ts, key)
    share = F.bround("busyness", 0) if cells == "observed" else F.col("busyness")
    grid = grid.withColumn("share", share)
    # Counts instead of shares: a sum of shares differs in its last bit by their order, which moves ties of the rounding.
    mean = F.avg("share") if cells == "observed" else F.sum("n") * 100 / (F.max("n") * 168)
    first = F.struct(-F.col("share"), F.col("dow"), F.col("hour"))
    out = grid.groupBy(key).agg(
        F.max("share").alias("peak_busyness"), F.round(mean, 1).alias("avg_busyness"), F.min_by("hour", first).alias("peak_hour")
    )
    if venues is None:
        return out
    return venues.select(key).join(out, key, "left").fillna({"peak_busyness": 0.0, "avg_busyness": 0.0, "peak_hour": 12})
