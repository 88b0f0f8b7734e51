"""Behavioural features of users and venues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalar import age_days, decay, ratio, seconds_between
from footfall.operators.scale import attach, top_k

def rows() -> Column:
    return F.count(F.lit(1))


def gap_moments(df: DataFrame, key: str, ts: str = "ts", positive_only: bool = False) -> DataFrame:
    """Per key: number, mean, population and sample deviation of the gaps between visits, in days.

    Gaps are taken inside calendar months and across their seams and pooled afterwards, so one key with a
    large share of all rows is sorted in many pieces.
    """
    stamped = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, F.unix_micros(ts).alias("t"), F.trunc(ts, "month").alias("month")
    )
    day = F.lit(86_400_000_000.0)
    inside = Window.partitionBy(key, "month").orderBy("t")
    gap = (F.col("t") - F.lag("t").over(inside)) / day
    stamped = stamped.withColumn("gap", gap)
    counted = F.when(F.col("gap") > 0, F.col("gap")) if positive_only else F.col("gap")
    months = stamped.withColumn("gap", counted).groupBy(key, "month").agg(
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.count("gap").alias("n"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("m"),
        F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("v"),
    )
    seam = (F.col("first") - F.lag("last").over(Window.partitionBy(key).orderBy("month"))) / day
    months = months.withColumn("seam", F.when(seam > 0, seam) if positive_only else seam)
    has_seam = F.col("seam").isNotNull().cast("int")
    seam0 = F.coalesce("seam", F.lit(0.0))
    whole = Window.partitionBy(key)
    mean = F.sum(F.col("n") * F.col("m") + seam0).over(whole) / F.nullif(
        F.sum(F.col("n") + has_seam).over(whole).cast("double"), F.lit(0.0)
    )
    pooled = months.withColumn("mean", mean).groupBy(key).agg(
        F.sum(F.col("n") + has_seam).alias("n_gaps"),
        F.max("mean").alias("gap_mean"),
        F.sum(
            F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))
            + has_seam * (seam0 - F.col("mean")) * (seam0 - F.col("mean"))
        ).alias("_m2"),
    )
    return pooled.select(
        key,
        "n_gaps",
        "gap_mean",
        F.when(F.col("n_gaps") > 0, F.sqrt(F.col("_m2") / F.col("n_gaps"))).alias("gap_std_pop"),
        F.when(F.col("n_gaps") > 1, F.sqrt(F.col("_m2") / (F.col("n_gaps") - 1))).alias("gap_std"),
    )


def balance_burstiness(sigma: Column, mu: Column) -> Column:
    """(sigma - mu) / (sigma + mu); 0 when both are 0."""
    return F.when(sigma + mu == 0, F.lit(0.0)).otherwise(F.try_divide(sigma - mu, sigma + mu))


def burstiness(inter: DataFrame, key: str = "user_id", kind: str = "balance") -> DataFrame:
    """Irregularity of visits.

    ``balance``: in [-1, 1] from all gaps, NULL below two gaps. ``cv``: sample deviation over mean.
    ``positive``: balance over positive gaps only, 0 when fewer than three visits or two such gaps.
    """
    if kind == "positive":
        g = gap_moments(inter, key, positive_only=True)
        visits = inter.where(F.col(key).isNotNull()).groupBy(key).agg(rows().alias("n"))
        value = F.when(
            (F.col("n") >= 3) & (F.col("n_gaps") >= 2), balance_burstiness(F.col("gap_std_pop"), F.col("gap_mean"))
        ).otherwise(F.lit(0.0))
        return visits.join(g, key, "left").select(key, value.alias("burstiness"))
    g = gap_moments(inter, key)
    if kind == "cv":
        value = F.when(F.col("gap_mean") > 0, ratio("gap_std", "gap_mean"))
    else:
        value = F.when(F.col("n_gaps") >= 2, balance_burstiness(F.col("gap_std_pop"), F.col("gap_mean")))
    return g.select(key, value.alias("burstiness"))


def entropy(df: DataFrame, keys: Sequence[str], category: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy (bits) of the category shares per key: log2(N) - sum(n log2 n) / N, one pass."""
    counts = df.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(rows().alias("n"))
    return counts.groupBy(*keys).agg(entropy_of("n").alias(name))


def entropy_of(n: str) -> Column:
    x = F.col(n)
    h = F.log2(F.sum(x)) - F.sum(x * F.log2(x)) / F.sum(x)
    # Rounding error can leave a tiny negative for a single category.
    return F.greatest(h, F.lit(0.0))


def gini(df: DataFrame, keys: Sequence[str], value: str, name: str = "gini") -> DataFrame:
    """Gini coefficient of ``value`` per key, from the histogram of equal values instead of sorted rows."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(rows().alias("c"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c, x = F.col("c").cast("double"), F.col(value).cast("double")
    start = F.coalesce(F.sum("c").over(before), F.lit(0))
    ranked = hist.withColumn("rank_sum", c * (2 * start + c + 1) / 2)
    n, total = F.sum(c), F.sum(c * x)
    return ranked.groupBy(*keys).agg(
        F.when(total == 0, F.lit(0.0))
        .otherwise(F.try_divide(2 * F.sum(x * F.col("rank_sum")), n * total) - (n + 1) / n)
        .alias(name)
    )


def pair_counts(inter: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Visits per (user, venue), users known."""
    return inter.where(F.col("user_id").isNotNull()).groupBy(*by, "user_id", "business_id").agg(rows().alias("n"))


# ---------------------------------------------------------------- users


def user_basics(inter: DataFrame) -> DataFrame:
    """Visits, distinct venues, revisit ratio, mean gap, most common hour (earliest on ties), Mon-Fri share."""
    linked = inter.where(F.col("user_id").isNotNull())
    # One row per (user, venue) and per (user, hour) come out of one partial aggregation each.
    pairs = pair_counts(inter).groupBy("user_id").agg(F.sum("n").alias("total_visits"), rows().alias("unique_venues"))
    span = linked.groupBy("user_id").agg(
        F.count("ts").alias("dated"),
        seconds_between(F.max("ts"), F.min("ts")).alias("span_s"),
        F.count_if(F.weekday("ts") < 5).alias("weekdays"),
    )
    hours = linked.groupBy("user_id", F.hour("ts").alias("hour")).agg(rows().alias("n"))
    mode = hours.where(F.col("hour").isNotNull()).groupBy("user_id").agg(
        F.min_by("hour", F.struct(-F.col("n"), F.col("hour"))).alias("time_of_day_mode")
    )
    return (
        pairs.join(span, "user_id")
        .join(mode, "user_id", "left")
        .select(
            "user_id",
            "total_visits",
            "unique_venues",
            ratio(F.col("total_visits") - F.col("unique_venues"), "total_visits").alias("revisit_ratio"),
            # Gaps between sorted visits add up to the span.
            ratio(F.col("span_s") / F.lit(86400.0), F.col("dated") - 1).alias("avg_time_gap_days"),
            "time_of_day_mode",
            ratio("weekdays", "dated").alias("weekday_ratio"),
        )
    )


def user_concentration(inter: DataFrame) -> DataFrame:
    """Share of the top venue and of the top three venues, and visits to the top venue."""
    pairs = pair_counts(inter)
    totals = pairs.groupBy("user_id").agg(F.sum("n").alias("total"), F.max("n").alias("max_visits_single_venue"))
    top3 = top_k(pairs, 3, [F.col("n").desc(), F.col("business_id")], ["user_id"]).groupBy("user_id").agg(
        F.sum("n").alias("top3")
    )
    return totals.join(top3, "user_id").select(
        "user_id",
        ratio("max_visits_single_venue", "total").alias("top1_venue_share"),
        ratio("top3", "total").alias("top3_venue_share"),
        "max_visits_single_venue",
    )


def user_activity(inter: DataFrame, window_months: int = 216) -> DataFrame:
    """Active span, visits per active day (NULL for a single visit), months active and their share of the window."""
    linked = inter.where(F.col("user_id").isNotNull())
    days = seconds_between(F.max("ts"), F.min("ts")) / F.lit(86400.0)
    months = linked.groupBy("user_id", F.trunc("ts", "month").alias("m")).agg(
        rows().alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    span = seconds_between(F.max("hi"), F.min("lo")) / F.lit(86400.0)
    per = months.groupBy("user_id").agg(
        F.sum("n").alias("n"), span.alias("active_span_days"), F.count("m").alias("months_active")
    )
    rate = F.when(F.col("n") < 2, F.lit(None).cast("double")).when(
        F.col("active_span_days") > 0, ratio("n", "active_span_days")
    ).otherwise(F.lit(0.0))
    return per.select(
        "user_id",
        "active_span_days",
        rate.alias("visits_per_active_day"),
        "months_active",
        (F.col("months_active") / F.lit(float(window_months))).alias("repeat_month_ratio"),
    )


def user_features(inter: DataFrame) -> DataFrame:
    """The ranking feature set of users: volume, revisits, concentration, burstiness, span, entropy."""
    per = pair_counts(inter).groupBy("user_id").agg(
        F.sum("n").alias("total_visits"),
        rows().alias("unique_venues"),
        F.max("n").alias("max_visits_single_venue"),
        entropy_of("n").alias("venue_entropy"),
    )
    span = inter.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        (seconds_between(F.max("ts"), F.min("ts")) / F.lit(86400.0)).alias("active_span_days")
    )
    burst = burstiness(inter)
    return (
        per.join(span, "user_id")
        .join(burst, "user_id", "left")
        .select(
            "user_id",
            "total_visits",
            "unique_venues",
            ratio(F.col("total_visits") - F.col("unique_venues"), "total_visits").alias("revisit_ratio"),
            ratio("max_visits_single_venue", "total_visits").alias("top1_venue_share"),
            "max_visits_single_venue",
            F.col("burstiness").alias("burstiness_index"),
            "active_span_days",
            "venue_entropy",
            ratio("unique_venues", "total_visits").alias("unique_venue_ratio"),
        )
    )


# ---------------------------------------------------------------- venues


def venue_basics(inter: DataFrame) -> DataFrame:
    """All events, distinct known users, users with more than one visit, and their share."""
    pairs = inter.groupBy("business_id", "user_id").agg(rows().alias("n"))
    known = F.col("user_id").isNotNull()
    per = pairs.groupBy("business_id").agg(
        F.sum("n").alias("total_visits"),
        F.count_if(known).alias("unique_users"),
        F.count_if(known & (F.col("n") > 1)).alias("repeat_users"),
    )
    return per.withColumn("revisit_rate", ratio("repeat_users", "unique_users", 0.0))


def period_counts(inter: DataFrame, unit: str, key: str = "business_id", ts: str = "ts") -> DataFrame:
    return inter.where(F.col(ts).isNotNull()).groupBy(key, F.date_trunc(unit, ts).alias("period")).agg(rows().alias("n"))


def venue_stability(inter: DataFrame, min_rows: int = 10) -> DataFrame:
    """1 / (1 + cv) of monthly counts; NULL with at most ``min_rows`` dated events or a single month."""
    months = period_counts(inter, "month")
    per = months.groupBy("business_id").agg(
        F.sum("n").alias("rows"), rows().alias("months"), ratio(F.stddev_samp("n"), F.avg("n")).alias("cv")
    )
    stable = F.when((F.col("rows") > min_rows) & (F.col("months") > 1), 1 / (1 + F.col("cv")))
    venues = inter.select("business_id").distinct()
    return venues.join(per, "business_id", "left").select("business_id", stable.alias("temporal_stability"))


def venue_weekly(inter: DataFrame, empty_weeks: bool = False, min_rows: int = 7) -> DataFrame:
    """Mean, deviation and cv of weekly counts.

    ``empty_weeks`` counts the weeks without events between the first and last one too: their zeros only
    change the number of terms, so nothing is materialised for them.
    """
    weeks = period_counts(inter, "week")
    n = F.col("n").cast("double")
    per = weeks.groupBy("business_id").agg(
        F.sum("n").alias("rows"),
        rows().alias("k"),
        F.sum(n * n).alias("sq"),
        F.min("period").alias("lo"),
        F.max("period").alias("hi"),
        F.stddev_samp("n").alias("sd"),
    )
    if empty_weeks:
        per = per.withColumn("k", (F.datediff("hi", "lo") / 7 + 1).cast("bigint"))
        mean = F.col("rows") / F.col("k").cast("double")
        var = ratio(F.col("sq") - F.col("rows") * mean, F.col("k") - 1)
        cv = F.when(F.col("k") > 1, F.sqrt(F.greatest(var, F.lit(0.0))) / mean).otherwise(F.lit(1.0))
        return per.select("business_id", cv.alias("stability_cv"))
    mean = F.col("rows") / F.col("k").cast("double")
    enough = F.col("rows") >= min_rows
    return per.select(
        "business_id",
        F.when(enough, mean).otherwise(F.col("rows").cast("double")).alias("weekly_visit_mean"),
        F.when(enough, F.col("sd")).otherwise(F.lit(0.0)).alias("weekly_visit_std"),
        F.when(enough, F.col("sd") / mean).otherwise(F.lit(0.0)).alias("stability_cv"),
    )


def venue_seasonal_variance(inter: DataFrame, min_rows: int = 4) -> DataFrame:
    """Sample variance of quarterly counts; 0 with few events or a single quarter."""
    per = period_counts(inter, "quarter").groupBy("business_id").agg(
        F.sum("n").alias("rows"), rows().alias("k"), F.var_samp("n").alias("v")
    )
    ok = (F.col("rows") >= min_rows) & (F.col("k") >= 2)
    return per.select("business_id", F.when(ok, F.col("v")).otherwise(F.lit(0.0)).alias("seasonal_variance"))


def venue_loyalty(inter: DataFrame) -> DataFrame:
    """Distinct users, Gini of their visits, repeat users (2+), their share and mean visits, top user's share."""
    pairs = inter.groupBy("business_id", "user_id").agg(rows().alias("n"))
    known = F.col("user_id").isNotNull()
    repeat = known & (F.col("n") >= 2)
    per = pairs.groupBy("business_id").agg(
        F.sum("n").alias("popularity_visits"),
        F.count_if(known).alias("unique_users"),
        F.count_if(repeat).alias("repeat_user_count"),
        F.coalesce(F.avg(F.when(repeat, F.col("n"))), F.lit(0.0)).alias("avg_user_repeat_visits"),
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("top_user"),
    )
    g = gini(pairs.where(known), ["business_id"], "n", "gini_user_contribution")
    return per.join(g, "business_id", "left").select(
        "business_id",
        "popularity_visits",
        "unique_users",
        F.coalesce("gini_user_contribution", F.lit(0.0)).alias("gini_user_contribution"),
        "repeat_user_count",
        ratio("repeat_user_count", "unique_users", 0.0).alias("repeat_user_rate"),
        "avg_user_repeat_visits",
        ratio("top_user", "popularity_visits").alias("top_user_share"),
    )


def venue_features(inter: DataFrame) -> DataFrame:
    """The ranking feature set of venues: loyalty, weekly stability, seasonal variance."""
    return (
        venue_loyalty(inter)
        .drop("top_user_share")
        .join(venue_weekly(inter), "business_id", "left")
        .join(venue_seasonal_variance(inter), "business_id", "left")
    )


# ---------------------------------------------------------------- hotels


def hotel_venue_features(reviews: DataFrame, businesses: DataFrame, as_of: Column, min_reviews: int = 5) -> DataFrame:
    """Weekday share (Mon-Thu), seasonal and annual cv, repeat guests, Gini, recency-weighted velocity and
    the spread of the guests' most visited states."""
    linked = reviews.where(F.col("user_id").isNotNull() & F.col("business_id").isNotNull())
    base = linked.groupBy("business_id").agg(
        rows().alias("n_reviews"),
        F.avg((F.weekday("ts") < 4).cast("double")).alias("business_leisure_ratio"),
        F.sum(decay(age_days("ts", as_of, whole=True))).alias("review_velocity"),
    ).where(F.col("n_reviews") >= min_reviews)

    def cv_of(part: Column, name: str) -> DataFrame:
        counts = linked.groupBy("business_id", part.alias("p")).agg(rows().alias("n"))
        return counts.groupBy("business_id").agg(
            F.coalesce(ratio(F.stddev_samp("n"), F.avg("n")), F.lit(0.0)).alias(name)
        )

    pairs = pair_counts(linked)
    guests = pairs.groupBy("business_id").agg(
        rows().alias("n_unique_users"), ratio(F.count_if(F.col("n") >= 2), rows()).alias("multi_stay_rate")
    )
    home = user_home(linked, businesses, "state")
    spread = entropy(
        pairs.join(home, "user_id", "left").withColumn("home", F.coalesce("home", F.lit("unknown"))),
        ["business_id"],
        "home",
        "geographic_diversity",
    )
    return (
        base.join(guests, "business_id")
        .join(cv_of(F.month("ts"), "seasonal_cv"), "business_id")
        .join(cv_of(F.year("ts"), "venue_stability_cv"), "business_id")
        .join(gini(pairs, ["business_id"], "n", "traveler_concentration"), "business_id")
        .join(spread, "business_id")
        .withColumn("revisit_rate", F.col("multi_stay_rate"))
    )


def user_home(reviews: DataFrame, businesses: DataFrame, column: str) -> DataFrame:
    """The most visited value of a venue attribute per user, first in order on ties."""
    per = (
        # Counted per venue first: a hot venue then brings one row per user.
        pair_counts(reviews.where(F.col("user_id").isNotNull()))
        .join(businesses.select("business_id", column), "business_id")
        .where(F.col(column).isNotNull())
        .groupBy("user_id", column)
        .agg(F.sum("n").alias("n"))
    )
    return per.groupBy("user_id").agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("home"))


def hotel_user_features(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """Counts, mean rating given, yearly frequency, states and cities with their entropy, traveller flags."""
    linked = reviews.where(F.col("user_id").isNotNull())
    base = linked.groupBy("user_id").agg(
        rows().alias("total_hotel_reviews"),
        F.avg("stars").alias("avg_rating_given"),
        F.avg((F.weekday("ts") < 4).cast("double")).alias("weekday_fraction"),
        (F.floor(seconds_between(F.max("ts"), F.min("ts")) / F.lit(86400.0)) / F.lit(365.0) + 1.0).alias("years"),
    )
    pairs = pair_counts(linked)
    hotels = pairs.groupBy("user_id").agg(rows().alias("n_unique_hotels"))
    placed = pairs.join(businesses.select("business_id", "state", "city"), "business_id", "left")

    def spread(column: str, n_name: str, h_name: str) -> DataFrame:
        per = placed.where(F.col(column).isNotNull()).groupBy("user_id", column).agg(F.sum("n").alias("n"))
        return per.groupBy("user_id").agg(rows().alias(n_name), entropy_of("n").alias(h_name))

    out = (
        base.join(hotels, "user_id")
        .join(spread("state", "n_states_visited", "hotel_state_diversity"), "user_id", "left")
        .join(spread("city", "n_cities_visited", "hotel_city_diversity"), "user_id", "left")
        .fillna({"n_states_visited": 1, "n_cities_visited": 1, "hotel_state_diversity": 0.0, "hotel_city_diversity": 0.0})
    )
    warrior = (F.col("total_hotel_reviews") >= 10) & (F.col("n_states_visited") >= 3)
    return (
        out.withColumn("hotel_frequency", F.col("total_hotel_reviews") / F.col("years"))
        .withColumn("is_road_warrior", warrior.cast("int"))
        .withColumn("is_leisure_traveler", (F.col("weekday_fraction") < 0.5).cast("int"))
        .drop("years")
    )


def loyalty_profile(reviews: DataFrame) -> DataFrame:
    """One row: pairs, and the share of (user, venue) pairs with at least two and three reviews."""
    return pair_counts(reviews).agg(
        rows().alias("pairs"),
        ratio(F.count_if(F.col("n") >= 2), rows()).alias("share_2plus"),
        ratio(F.count_if(F.col("n") >= 3), rows()).alias("share_3plus"),
    )


def calendar_profile(reviews: DataFrame) -> DataFrame:
    """Events per weekday (Mon=0) and per month of the year, long form."""
    both = F.array(
        F.struct(F.lit("weekday").alias("part"), F.weekday("ts").alias("slot")),
        F.struct(F.lit("month").alias("part"), F.month("ts").alias("slot")),
    )
    return reviews.select(F.explode(both).alias("x")).groupBy("x.part", "x.slot").agg(rows().alias("n"))


def season_profile(reviews: DataFrame) -> DataFrame:
    """One row: share on weekdays, variation of the months (sample deviation over mean of the months that occur), and mean and number
    below 0.3 of the venues' variation from year to year. Venues of one year have none."""
    days = reviews.agg(ratio(F.count_if(F.weekday("ts") < 5), rows()).alias("weekday_share"))
    months = reviews.groupBy(F.month("ts").alias("month")).agg(rows().alias("n")).agg(ratio(F.stddev_samp("n"), F.avg("n")).alias("month_cv"))
    yearly = reviews.groupBy("business_id", F.year("ts").alias("year")).agg(rows().alias("n"))
    venues = yearly.groupBy("business_id").agg(ratio(F.stddev_samp("n"), F.avg("n")).alias("cv")).where(F.col("cv").isNotNull())
    steady = venues.agg(F.avg("cv").alias("venue_cv_mean"), F.count_if(F.col("cv") < 0.3).alias("steady_venues"))
    return attach(attach(days, months, []), steady, [])
