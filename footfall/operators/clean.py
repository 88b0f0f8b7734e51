"""Filters, labels, tags and normalisation of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalar import clip, or_default, ratio, tokens
from footfall.operators.scale import attach, lookup_join, quantiles, scalar, scalar_quantiles, spread_join
from footfall.session import settle

# Category words that put a venue into a domain.
COFFEE_WORDS = ("coffee", "café", "cafe", "coffeehouse", "espresso", "coffee & tea", "coffee roasteries")
HOTEL_WORDS = ("hotels", "hotel", "hostel", "motel", "bed & breakfast", "bed and breakfast", "resort", "lodge", "inn")
RESTAURANT_TOKENS = ("Restaurants", "Food")
NIGHTLIFE_WORDS = ("Bars", "Nightlife", "Lounges", "Pubs")


def category_match(col: str | Column, words: Sequence[str], mode: str = "substring") -> Column:
    """True when a category word occurs: anywhere (ignoring case) or as a whole comma-separated token."""
    c = F.col(col) if isinstance(col, str) else col
    if mode == "token":
        return F.arrays_overlap(tokens(c), F.array(*[F.lit(w) for w in words]))
    text = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w.lower())) for w in words])


def filter_categories(df: DataFrame, words: Sequence[str], mode: str = "substring", col: str = "categories") -> DataFrame:
    return df.where(category_match(col, words, mode))


def select_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def coalesce_columns(df: DataFrame, names: Sequence[str], default=0.0, dtype: str = "double") -> Column:
    """First known value among those of the named columns that exist, as a number; unreadable text counts as missing."""
    found = [F.col(n).cast("string").try_cast(dtype) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default).cast(dtype))


def coerce_double(col: str) -> Column:
    return F.col(col).cast("string").try_cast("double")


def coerce_ts(col: str) -> Column:
    return F.try_to_timestamp(F.col(col).cast("string"))


def hotel_subcategory(col: str = "categories") -> Column:
    """Accommodation kind, first match wins."""
    text = F.lower(F.coalesce(F.col(col), F.lit("")))
    # Words per kind in order of precedence.
    kinds = (
        ("Hostel", ("hostel",)),
        ("B&B", ("bed & breakfast", "bed and breakfast")),
        ("Resort", ("resort",)),
        ("Motel", ("motel",)),
        ("Lodge", ("lodge",)),
        ("Inn", ("inn",)),
    )
    label = F
    for name, words in kinds:
        label = label.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), F.lit(name))
    return label.otherwise(F.lit("Hotel"))


# States and provinces by code and name.
US_STATES = (
    ("AL", "Alabama"),
    ("AK", "Alaska"),
    ("AZ", "Arizona"),
    ("AR", "Arkansas"),
    ("CA", "California"),
    ("CO", "Colorado"),
    ("CT", "Connecticut"),
    ("DE", "Delaware"),
    ("FL", "Florida"),
    ("GA", "Georgia"),
    ("HI", "Hawaii"),
    ("ID", "Idaho"),
    ("IL", "Illinois"),
    ("IN", "Indiana"),
    ("IA", "Iowa"),
    ("KS", "Kansas"),
    ("KY", "Kentucky"),
    ("LA", "Louisiana"),
    ("ME", "Maine"),
    ("MD", "Maryland"),
    ("MA", "Massachusetts"),
    ("MI", "Michigan"),
    ("MN", "Minnesota"),
    ("MS", "Mississippi"),
    ("MO", "Missouri"),
    ("MT", "Montana"),
    ("NE", "Nebraska"),
    ("NV", "Nevada"),
    ("NH", "New Hampshire"),
    ("NJ", "New Jersey"),
    ("NM", "New Mexico"),
    ("NY", "New York"),
    ("NC", "North Carolina"),
    ("ND", "North Dakota"),
    ("OH", "Ohio"),
    ("OK", "Oklahoma"),
    ("OR", "Oregon"),
    ("PA", "Pennsylvania"),
    ("RI", "Rhode Island"),
    ("SC", "South Carolina"),
    ("SD", "South Dakota"),
    ("TN", "Tennessee"),
    ("TX", "Texas"),
    ("UT", "Utah"),
    ("VT", "Vermont"),
    ("VA", "Virginia"),
    ("WA", "Washington"),
    ("WV", "West Virginia"),
    ("WI", "Wisconsin"),
    ("WY", "Wyoming"),
)
CA_PROVINCES = (
    ("AB", "Alberta"),
    ("BC", "British Columbia"),
    ("MB", "Manitoba"),
    ("NB", "New Brunswick"),
    ("NL", "Newfoundland and Labrador"),
    ("NS", "Nova Scotia"),
    ("NT", "Northwest Territories"),
    ("NU", "Nunavut"),
    ("ON", "Ontario"),
    ("PE", "Prince Edward Island"),
    ("QC", "Quebec"),
    ("SK", "Saskatchewan"),
    ("YT", "Yukon"),
)


def infer_country(state: str | Column) -> Column:
    s = F.trim(F.col(state) if isinstance(state, str) else state)
    return (
        F.when(s.isin(*[x for place in US_STATES for x in place]), F.lit("United States"))
        .when(s.isin(*[x for place in CA_PROVINCES for x in place]), F.lit("Canada"))
        .otherwise(F.lit("Unknown"))
    )


def place_display(city: str, state: str, country: Column) -> Column:
    """City, state, country; the state is left out when missing."""
    st = F.when(F.col(state) != "", F.col(state))
    return F.concat_ws(", ", F.coalesce(city, F.lit("Unknown")), st, country)


def fill_median(df: DataFrame, col: str) -> DataFrame:
    (median,) = scalar_quantiles(df, col, 0.5)
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), median))


def winsorize(df: DataFrame, columns: Sequence[str], hi: float = 0.99, lo: float | None = None, floor: float | None = 0.0) -> DataFrame:
    """Cut columns at a quantile (and at a lower one or a constant floor)."""
    probs = {"hi": hi, **({} if lo is None else {"lo": lo})}
    row = settle(quantiles(df, columns, probs))
    out = {}
    for c in columns:
        v = F.least(F.col(c).cast("double"), scalar(row.select(f"{c}_hi")))
        if lo is not None:
            v = F.greatest(v, scalar(row.select(f"{c}_lo")))
        elif floor is not None:
            v = F.greatest(v, F.lit(floor))
        out[c] = F.when(F.col(c).isNotNull(), v)
    return df.withColumns(out)


def minmax(df: DataFrame, col: str, by: Sequence[str] = (), on_flat: str = "zeros", name: str | None = None) -> DataFrame:
    """Scale to [0, 1], whole or per group. A flat column becomes ``zeros``, ``ones``, or with ``unit`` keeps its
    distance from the minimum."""
    by = list(by)
    bounds = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")) if by else df.agg(
        F.min(col).alias("_lo"), F.max(col).alias("_hi")
    )
    v, lo, hi = F.col(col).cast("double"), F.col("_lo"), F.col("_hi")
    flat = {"zeros": F.lit(0.0), "ones": F.lit(1.0), "unit": v - lo}[on_flat]
    scaled = F.when(hi - lo > 1e-12, (v - lo) / (hi - lo)).otherwise(flat)
    return attach(df, bounds, by).withColumn(name or col, F.when(F.col(col).isNotNull(), scaled)).drop("_lo", "_hi")


# ---------------------------------------------------------------- tags


def venue_explanations(df: DataFrame, slots: int = 5) -> DataFrame:
    """Up to five plain-language reasons per venue, padded with empty text."""
    repeat = F.coalesce("repeat_user_rate", F.lit(0.0))
    stars = F.coalesce("rating_mean", F.lit(0.0))
    # Without the last bits, so that a measure that is level with its threshold isn't below it by the order of a sum.
    firm = lambda c: F.round(c, 12)
    regulars = (stars >= 4.0) & (repeat > 0.10)
    # The texts and their thresholds, in order of precedence.
    rules = [
        (repeat > 0.10, F.concat(F.lit("Many people come back repeatedly ("), F.format_string("%.0f", F.bround(repeat * 100, 0)), F.lit("% return rate)"))),
        (firm("stability_cv") < 0.5, F.lit("Visit activity is steady over time")),
        (firm(F.coalesce("gini_user_contribution", F.lit(0.0))) < 0.7, F.lit("Loyalty is broad across many users (not dominated by super-users)")),
        (regulars, F.lit("Highly rated AND consistently chosen by regulars")),
        ((stars < 4.0) & (repeat > 0.15), F.lit("Not the highest rated, but consistently chosen by regulars")),
        (firm("seasonal_variance") < 50, F.lit("Popular year-round, not just seasonal")),
        (F.coalesce("top_user_share", F.lit(0.0)) < 0.05, F.lit("No single user dominates visits (healthy diverse patronage)")),
        ((stars >= 4.5) & ~regulars, F.concat(F.lit("Excellent customer ratings ("), F.format_number(stars, 1), F.lit("★)"))),
    ]
    said = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in rules]), lambda x: x.isNotNull())
    padded = F.concat(said, F.array_repeat(F.lit(""), slots))
    return df.select("business_id", *[padded[i].alias(f"explain_{i + 1}") for i in range(slots)])


# Labels and thresholds.
def classify_profile() -> Column:
    """Visitor mix of a coffee venue; unknown measures count as 0."""
    r, g, cv, n = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("repeat_user_rate", "gini_user_contribution", "stability_cv", "popularity_visits"))
    return (
        F.when((r >= 0.45) & (g >= 0.50), F.lit("Loyal Regular Base"))
        .when((cv > 0) & (cv < 0.60) & (r >= 0.25), F.lit("Steady Habit Traffic"))
        .when((r < 0.20) & (g < 0.35), F.lit("Explorer-Friendly Mix"))
        .when((n >= 500) & (r < 0.25), F.lit("High-Volume Casual Traffic"))
        .otherwise(F.lit("Balanced Visitor Mix"))
    )


# Labels and thresholds.
def classify_hotel_profile() -> Column:
    share, season = or_default("business_leisure_ratio", 0.5), or_default("seasonal_cv", 0.5)
    back = or_default("multi_stay_rate", 0.0)
    return (
        F.when(back > 0.05, F.lit("Road Warrior Favourite"))
        .when(share > 0.65, F.lit("Business Hub"))
        .when(season > 0.5, F.lit("Seasonal Resort"))
        .when(share < 0.45, F.lit("Leisure Destination"))
        .otherwise(F.lit("Hidden Gem"))
    )


# Labels and thresholds.
def behavioral_tag(domain: str) -> Column:
    """One line on a venue's visitors; a missing or zero measure takes its default."""
    if domain == "coffee":
        back, steady = or_default("revisit_rate", 0.0), or_default("temporal_stability", 0.5)
        return (
            F.when(back > 0.20, F.lit("High Retention — regulars keep coming back"))
            .when(back > 0.05, F.lit("Steady — loyal customer base"))
            .when(steady > 0.7, F.lit("Consistent Traffic — reliable footfall all week"))
            .otherwise(F.lit("Broad Appeal — popular with explorers"))
        )
    if domain == "restaurant":
        back, transit, busy = (or_default(c, 0.0) for c in ("repeat_user_rate", "transit_access_score", "peak_busyness"))
        return (
            F.when(back > 0.15, F.lit("Local Favourite — high repeat visitor rate"))
            .when(transit > 0.8, F.lit("Transit Accessible — easy to reach without a car"))
            .when(busy > 0.7, F.lit("Lively & Buzzy — expect queues at peak times"))
            .otherwise(F.lit("Hidden Gem — underrated by stars, strong loyalists"))
        )
    share, spread, back = or_default("business_leisure_ratio", 0.5), or_default("geographic_diversity", 0.0), or_default("multi_stay_rate", 0.0)
    return (
        F.when(share > 0.75, F.lit("Business Hub — weekday-dominant, professional guests"))
        .when(share < 0.25, F.lit("Leisure Escape — weekend & holiday crowd"))
        .when(spread > 0.5, F.lit("Destination Hotel — draws visitors from many states"))
        .when(back > 0.05, F.lit("Guest Favourite — unusually high return-guest rate"))
        .otherwise(F.lit("Reliable Stay — consistent quality across traveler types"))
    )


# Labels and thresholds.
def confidence_tier(combined: str = "combined_similarity", shared: str = "n_shared") -> Column:
    c, n = F.col(combined), F.col(shared)
    return (
        F.when((c >= 0.5) & (n >= 5), F.lit("high"))
        .when((c >= 0.3) & (n >= 3), F.lit("medium"))
        .when((c >= 0.15) & (n >= 2), F.lit("low"))
        .otherwise(F.lit("noise"))
    )


TIERS = ("low", "medium", "high")


def min_tier(df: DataFrame, tier: str, col: str = "confidence_tier") -> DataFrame:
    return df.where(F.col(col).isin(*TIERS[TIERS.index(tier):]))


def tertile_badge(df: DataFrame, col: str, name: str = "badge") -> DataFrame:
    """One to three stars by the 33 % and 66 % quantiles of all values (missing = 0); zeros get none."""
    filled = df.withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(0.0)))
    lo, hi = scalar_quantiles(filled, col, 0.33, 0.66)
    v = F.col(col)
    return filled.withColumn(
        name, F.when(v <= 0, F.lit("")).when(v < lo, F.lit("★")).when(v < hi, F.lit("★★")).otherwise(F.lit("★★★"))
    )


def parking_score(df: DataFrame) -> DataFrame:
    """1 with a lot or garage, 0 with street parking among many venues (above the 75 % density), else 0.5."""
    (dense,) = scalar_quantiles(df, "walking_density", 0.75)
    score = (
        F.when(F.col("parking_lot").isNull(), F.lit(0.5))
        .when(F.col("parking_lot") | F.coalesce("parking_garage", F.lit(False)), F.lit(1.0))
        .when(F.coalesce("parking_valet", F.lit(False)), F.lit(0.5))
        .when(F.coalesce("parking_street", F.lit(False)) & (F.col("walking_density") > dense), F.lit(0.0))
        .otherwise(F.lit(0.5))
    )
    return df.withColumn("parking_score", score)


# ---------------------------------------------------------------- cities


def filter_city(df: DataFrame, city: str, col: str = "city") -> DataFrame:
    """Rows of the city by equal name (ignoring case), or by part of the name when no row is equal."""
    want = city.strip()
    if not want:
        return df
    name = F.lower(F.coalesce(F.col(col), F.lit("")))
    exact = scalar(df.agg(F.coalesce(F.bool_or(name == want.lower()), F.lit(False)).alias("e")))
    return df.where((name == want.lower()) | (~exact & F.contains(name, F.lit(want.lower()))))


def pool_members(df: DataFrame) -> DataFrame:
    """Rows (level, pool, business_id): every row of ``df`` is in the pool of its city, of its state and in the one of all."""
    pools = F.array(
        F.struct(F.lit("city").alias("level"), F.col("city").alias("pool")),
        F.struct(F.lit("state").alias("level"), F.col("state").alias("pool")),
        F.struct(F.lit("all").alias("level"), F.lit("all").alias("pool")),
    )
    return df.select(F.explode(pools).alias("p"), "business_id").select("p.level", "p.pool", "business_id").where(F.col("pool").isNotNull())


def city_pool(df: DataFrame, requests: DataFrame, min_n: int = 12) -> DataFrame:
    """Per request (request_id, city, state) the pool it draws from: its city's if that has ``min_n`` rows, else its state's, else all; with
    the pool's size. Its rows are those of :func:`pool_members` with that level and pool; they aren't listed per request.
    """
    # At most one row per city and state.
    sizes = pool_members(df).groupBy("level", "pool").agg(F.count(F.lit(1)).alias("n"))
    size = lambda level, key: sizes.where(F.col("level") == level).select(F.col("pool").alias(key), F.col("n").alias(f"n_{level}"))
    total = F.coalesce(scalar(df.agg(F.count(F.lit(1)).alias("n"))), F.lit(0))
    met = lookup_join(lookup_join(requests, size("city", "city"), ["city"], "left"), size("state", "state"), ["state"], "left")
    by_city, by_state = F.col("n_city") >= min_n, F.col("n_state") >= min_n
    pick = lambda city, state, rest: F.when(by_city, city).when(by_state, state).otherwise(rest)
    return met.select(
        "request_id", pick(F.lit("city"), F.lit("state"), F.lit("all")).alias("level"),
        pick(F.col("city"), F.col("state"), F.lit("all")).alias("pool"), pick(F.col("n_city"), F.col("n_state"), total).alias("n_pool"),
    )


def pool_rows(df: DataFrame, requests: DataFrame, min_n: int = 12) -> DataFrame:
    """Rows (request_id, level, business_id): every row of the pool that :func:`city_pool` gives a request."""
    pools = city_pool(df, requests, min_n).select("request_id", "level", "pool")
    return spread_join(pools, pool_members(df), ["level", "pool"], both=True).select("request_id", "level", "business_id")


def canonical_case(df: DataFrame, col: str) -> DataFrame:
    """Most frequent spelling per lower-cased name (first in order on ties)."""
    spelled = df.where(F.col(col).isNotNull()).groupBy(F.trim(col).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return spelled.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"), F.sum("n").alias("n")
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Rows and missing values per column from one pass, long form."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("nulls")) for i, c in enumerate(df.columns)])
    return counts.select("rows", F.explode(pairs).alias("x")).select("x.column", "rows", "x.nulls")


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Rows per value with their share, the ``n`` most frequent ones or all."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = scalar(counts.agg(F.sum("n").alias("t")))
    out = counts.withColumn("share", ratio("n", total))
    return out if n is None else out.orderBy(F.col("n").desc(), F.col(col)).limit(n)
