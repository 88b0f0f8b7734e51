"""Filters, tags, normalisation, scalar functions and distance joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.catalog.behaviour import as_of
from footfall.catalog.registry import query, view
from footfall.functions import scalar as sc
from footfall.operators import baseline as bl
from footfall.operators import clean as cl
from footfall.operators import events as ev
from footfall.operators import features as ft
from footfall.operators import geo
from footfall.operators.scale import attach, spread_join


@query(
    "coffee_venues", "P1",
    """SELECT business_id, categories FROM businesses WHERE contains(lower(coalesce(categories, '')), 'coffee') OR contains(lower(coalesce(categories, '')), 'cafe')
 OR contains(lower(coalesce(categories, '')), 'espresso') OR contains(lower(coalesce(categories, '')), 'café')""",
)
def _(v):
    return cl.filter_categories(v.businesses, cl.COFFEE_WORDS).select("business_id", "categories")


@query(
    "hotel_venues", "P1 P3 P5",
    """SELECT business_id, CASE WHEN contains(c, 'hostel') THEN 'Hostel' WHEN contains(c, 'bed & breakfast') OR contains(c, 'bed and breakfast') THEN 'B&B' WHEN contains(c, 'resort') THEN 'Resort'
 WHEN contains(c, 'motel') THEN 'Motel' WHEN contains(c, 'lodge') THEN 'Lodge' WHEN contains(c, 'inn') THEN 'Inn' ELSE 'Hotel' END AS subcategory
FROM (SELECT *, lower(coalesce(categories, '')) AS c FROM businesses) WHERE review_count >= 50 AND regexp_matches(c, 'hotel|hostel|motel|bed & breakfast|bed and breakfast|resort|lodge|inn')""",
)
def _(v):
    kept = cl.filter_categories(v.businesses, cl.HOTEL_WORDS).where(F.col("review_count") >= 50)
    return kept.select("business_id", cl.hotel_subcategory().alias("subcategory"))


@query(
    "restaurant_venues", "P2",
    "SELECT business_id FROM businesses WHERE list_has_any(list_transform(string_split(coalesce(categories, ''), ','), lambda x: trim(x)), ['Restaurants', 'Food'])",
)
def _(v):
    return cl.filter_categories(v.businesses, cl.RESTAURANT_TOKENS, "token").select("business_id")


@query(
    "country_display", "P6 F14",
    """SELECT business_id, 'Unknown' AS country, city || ', ' || state || ', Unknown' AS place FROM businesses WHERE state NOT IN ('GA')
UNION ALL SELECT c_custkey + 1000000, CASE (c_custkey % 4) WHEN 0 THEN 'United States' WHEN 1 THEN 'Canada' WHEN 2 THEN 'Unknown' ELSE 'United States' END,
 c_name || CASE (c_custkey % 4) WHEN 0 THEN ', PA, United States' WHEN 1 THEN ', Ontario, Canada' WHEN 2 THEN ', Unknown' ELSE ', New York, United States' END FROM customer""",
)
def _(v):
    codes = F.element_at(F.array(F.lit("PA"), F.lit("Ontario"), F.lit(None), F.lit("New York")), (F.col("c_custkey") % 4 + 1).cast("int"))
    people = v.raw("customer").select((F.col("c_custkey") + 1_000_000).alias("business_id"), F.col("c_name").alias("city"), codes.alias("state"))
    both = ev.union_events(v.businesses.select("business_id", "city", "state"), people)
    country = cl.infer_country("state")
    return both.select("business_id", country.alias("country"), cl.place_display("city", "state", country).alias("place"))


@query(
    "coerced_values", "P8 P9",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number,
 coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE), CAST(user_id AS DOUBLE), 0.0) AS first_known,
 CASE WHEN event_type = 'click' THEN NULL ELSE date_trunc('second', ts) END AS stamp FROM events""",
)
def _(v):
    dirty = v.events.select(
        "event_id", "user_id",
        F.when(F.col("event_type") == "error", F.lit("bad")).otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") == "click", F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time"),
    )
    return dirty.select(
        "event_id", cl.coerce_double("value").alias("number"),
        cl.coalesce_columns(dirty, ["absent", "value", "user_id"]).alias("first_known"), cl.coerce_ts("time").alias("stamp"),
    )


@query(
    "median_filled", "P10 M12",
    "SELECT business_id, ts, coalesce(stars, (SELECT median(stars) FROM interactions)) AS stars FROM interactions",
)
def _(v):
    return cl.fill_median(v.interactions, "stars").select("business_id", "ts", "stars")


@query(
    "winsorized_prices", "P11",
    """SELECT l_orderkey, l_linenumber, l_partkey, LEAST(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem)) AS price FROM lineitem""", rnd="price", digits=4,
)
def _(v):
    line = v.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))
    return cl.winsorize(line, ["price"])


@query(
    "minmax_by_segment", "P12",
    """SELECT c_custkey, (c_acctbal - min(c_acctbal) OVER (PARTITION BY c_mktsegment)) / (max(c_acctbal) OVER (PARTITION BY c_mktsegment) - min(c_acctbal) OVER (PARTITION BY c_mktsegment)) AS grouped,
 (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS overall FROM customer""", rnd="grouped overall",
)
def _(v):
    c = v.raw("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = cl.minmax(cl.minmax(c, "c_acctbal", name="overall"), "c_acctbal", ["c_mktsegment"], name="grouped")
    return out.select("c_custkey", "grouped", "overall")


@query(
    "normalized_prices", "P13",
    "SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS share FROM orders", rnd="share", digits=9,
)
def _(v):
    from footfall.operators.graph import normalize_sum

    o = v.raw("orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("share"))
    return normalize_sum(o, "share", ["o_orderpriority"]).select("o_orderkey", "share")


def rated_venues(v):
    return (
        ft.venue_loyalty(v.interactions)
        .join(ft.venue_weekly(v.interactions), "business_id")
        .join(ft.venue_seasonal_variance(v.interactions), "business_id")
        .join(bl.rating(v.interactions), "business_id", "left")
    )


view(
    "rated_venues",
    """SELECT l.*, w.weekly_visit_mean, w.weekly_visit_std, w.stability_cv, s.seasonal_variance, r.rating_mean FROM venue_loyalty l JOIN venue_weekly w ON l.business_id = w.business_id
 JOIN venue_seasonal s ON l.business_id = s.business_id LEFT JOIN rating_base r ON l.business_id = r.business_id""",
)


@query(
    "venue_explanations", "P14",
    """WITH r AS (SELECT *, coalesce(repeat_user_rate, 0) AS rr, coalesce(rating_mean, 0) AS st FROM rated_venues),
e AS (SELECT business_id, list_concat(list_filter([
 CASE WHEN rr > 0.10 THEN 'Many people come back repeatedly (' || format('{:.0f}', rr * 100) || '% return rate)' END,
 CASE WHEN round(stability_cv, 12) < 0.5 THEN 'Visit activity is steady over time' END,
 CASE WHEN round(gini_user_contribution, 12) < 0.7 THEN 'Loyalty is broad across many users (not dominated by super-users)' END,
 CASE WHEN st >= 4.0 AND rr > 0.10 THEN 'Highly rated AND consistently chosen by regulars' WHEN st < 4.0 AND rr > 0.15 THEN 'Not the highest rated, but consistently chosen by regulars' END,
 CASE WHEN round(seasonal_variance, 12) < 50 THEN 'Popular year-round, not just seasonal' END,
 CASE WHEN top_user_share < 0.05 THEN 'No single user dominates visits (healthy diverse patronage)' END,
 CASE WHEN st >= 4.5 AND NOT (rr > 0.10) THEN 'Excellent customer ratings (' || format('{:.1f}', st) || '★)' END], lambda x: x IS NOT NULL), ['', '', '', '', '']) AS x FROM r)
SELECT business_id, x[1] AS explain_1, x[2] AS explain_2, x[3] AS explain_3, x[4] AS explain_4, x[5] AS explain_5 FROM e""",
)
def _(v):
    return cl.venue_explanations(rated_venues(v))


@query(
    "venue_profiles", "P15",
    """SELECT business_id, CASE WHEN repeat_user_rate >= 0.45 AND gini_user_contribution >= 0.50 THEN 'Loyal Regular Base' WHEN stability_cv > 0 AND stability_cv < 0.60 AND repeat_user_rate >= 0.25 THEN 'Steady Habit Traffic'
 WHEN repeat_user_rate < 0.20 AND gini_user_contribution < 0.35 THEN 'Explorer-Friendly Mix' WHEN popularity_visits >= 500 AND repeat_user_rate < 0.25 THEN 'High-Volume Casual Traffic' ELSE 'Balanced Visitor Mix' END AS profile
FROM rated_venues""",
)
def _(v):
    return rated_venues(v).select("business_id", cl.classify_profile().alias("profile"))


HOTEL_PROFILE = """CASE WHEN multi_stay_rate > 0.05 THEN 'Road Warrior Favourite' WHEN coalesce(nullif(business_leisure_ratio, 0), 0.5) > 0.65 THEN 'Business Hub'
 WHEN coalesce(nullif(seasonal_cv, 0), 0.5) > 0.5 THEN 'Seasonal Resort' WHEN coalesce(nullif(business_leisure_ratio, 0), 0.5) < 0.45 THEN 'Leisure Destination' ELSE 'Hidden Gem' END"""


@query("hotel_profiles", "P16", f"SELECT business_id, {HOTEL_PROFILE} AS profile FROM hotel_venues")
def _(v):
    return ft.hotel_venue_features(v.reviews, v.businesses, as_of()).select("business_id", cl.classify_hotel_profile().alias("profile"))


@query(
    "behaviour_tags", "P17",
    """SELECT h.business_id, CASE WHEN l.repeat_user_rate > 0.20 THEN 'High Retention — regulars keep coming back' WHEN l.repeat_user_rate > 0.05 THEN 'Steady — loyal customer base'
 WHEN 0.5 > 0.7 THEN 'Consistent Traffic — reliable footfall all week' ELSE 'Broad Appeal — popular with explorers' END AS coffee,
 CASE WHEN l.repeat_user_rate > 0.15 THEN 'Local Favourite — high repeat visitor rate' ELSE 'Hidden Gem — underrated by stars, strong loyalists' END AS restaurant,
 CASE WHEN coalesce(nullif(business_leisure_ratio, 0), 0.5) > 0.75 THEN 'Business Hub — weekday-dominant, professional guests' WHEN coalesce(nullif(business_leisure_ratio, 0), 0.5) < 0.25 THEN 'Leisure Escape — weekend & holiday crowd'
 WHEN geographic_diversity > 0.5 THEN 'Destination Hotel — draws visitors from many states' WHEN multi_stay_rate > 0.05 THEN 'Guest Favourite — unusually high return-guest rate'
 ELSE 'Reliable Stay — consistent quality across traveler types' END AS hotel FROM hotel_venues h JOIN venue_loyalty l ON h.business_id = l.business_id""",
)
def _(v):
    hotel = ft.hotel_venue_features(v.reviews, v.businesses, as_of()).drop("revisit_rate")
    venues = ft.venue_loyalty(v.interactions).select("business_id", "repeat_user_rate", F.col("repeat_user_rate").alias("revisit_rate"))
    none = F.lit(None).cast("double")
    joined = hotel.join(venues, "business_id").withColumns(
        {"temporal_stability": none, "transit_access_score": none, "peak_busyness": F.lit(0.0)}
    )
    return joined.select("business_id", *[cl.behavioral_tag(d).alias(d) for d in ("coffee", "restaurant", "hotel")])


@query(
    "tertile_badges", "P20",
    """WITH q AS (SELECT quantile_cont(review_count, 0.33) AS lo, quantile_cont(review_count, 0.66) AS hi FROM businesses)
SELECT business_id, CASE WHEN review_count <= 0 THEN '' WHEN review_count < lo THEN '★' WHEN review_count < hi THEN '★★' ELSE '★★★' END AS badge FROM businesses, q""",
)
def _(v):
    return cl.tertile_badge(v.businesses, "review_count").select("business_id", "badge")


@query(
    "city_filter", "P23",
    "SELECT business_id, city FROM businesses WHERE lower(city) = 'nation_1' UNION ALL SELECT business_id, city FROM businesses WHERE contains(lower(city), 'tion_2')",
)
def _(v):
    return cl.filter_city(v.businesses, "nation_1").select("business_id", "city").unionByName(
        cl.filter_city(v.businesses, "tion_2").select("business_id", "city")
    )


@query(
    "city_pool", "P24",
    """WITH c AS (SELECT city, count(*) AS n FROM businesses GROUP BY 1), s AS (SELECT state, count(*) AS n FROM businesses GROUP BY 1),
r AS (SELECT n_nationkey AS request_id, n_name AS city, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT r.*, CASE WHEN c.n >= 5 THEN 'city' WHEN s.n >= 5 THEN 'state' ELSE 'all' END AS level FROM r LEFT JOIN c ON r.city = c.city LEFT JOIN s ON r.state = s.state)
SELECT l.request_id, l.level, b.business_id FROM l JOIN businesses b ON (l.level = 'city' AND l.city = b.city) OR (l.level = 'state' AND l.state = b.state) OR l.level = 'all'""",
)
def _(v):
    """Venues of each nation's request: those of its city, its state or all."""
    requests = v.raw("nation").join(v.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("request_id"), F.col("n_name").alias("city"), F.col("r_name").alias("state")
    )
    return cl.pool_rows(v.businesses, requests, 5)


@query(
    "city_pool_members", "P24",
    "SELECT 'city' AS level, city AS pool, business_id FROM businesses UNION ALL SELECT 'state', state, business_id FROM businesses UNION ALL SELECT 'all', 'all', business_id FROM businesses",
)
def _(v):
    return cl.pool_members(v.businesses)


@query(
    "canonical_spelling", "P25",
    """WITH s AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS name, count(*) AS n FROM orders GROUP BY 1)
SELECT key, name, n FROM (SELECT lower(name) AS key, name, CAST(sum(n) OVER (PARTITION BY lower(name)) AS BIGINT) AS n, row_number() OVER (PARTITION BY lower(name) ORDER BY n DESC, name) AS i FROM s) WHERE i = 1""",
)
def _(v):
    mixed = v.raw("orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("city")
    )
    return cl.canonical_case(mixed, "city")


@query(
    "label_weights", "P28 J18",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1.5 WHEN 'MACHINERY' THEN 0.8 ELSE 1.0 END AS weight FROM customer",
    rnd="weight",
)
def _(v):
    from footfall.operators.segments import label_weight

    return v.raw("customer").select("c_custkey", label_weight("c_mktsegment", {"BUILDING": 1.5, "MACHINERY": 0.8}).alias("weight"))


@query(
    "null_profile", "S9 A36",
    """SELECT 'user_id' AS "column", count(*) AS "rows", count(*) FILTER (WHERE user_id IS NULL) AS nulls FROM interactions UNION ALL SELECT 'business_id', count(*), count(*) FILTER (WHERE business_id IS NULL) FROM interactions
UNION ALL SELECT 'ts', count(*), count(*) FILTER (WHERE ts IS NULL) FROM interactions UNION ALL SELECT 'interaction_type', count(*), count(*) FILTER (WHERE interaction_type IS NULL) FROM interactions
UNION ALL SELECT 'stars', count(*), count(*) FILTER (WHERE stars IS NULL) FROM interactions""",
)
def _(v):
    return cl.null_profile(v.interactions)


@query("value_counts", "A36", "SELECT interaction_type, count(*) AS n, count(*) / CAST((SELECT count(*) FROM interactions) AS DOUBLE) AS share FROM interactions GROUP BY 1", rnd="share")
def _(v):
    return cl.value_counts(v.interactions, "interaction_type")


@query("projected_scan", "S4", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def _(v):
    return v.raw("lineitem").where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_extendedprice")


@query("scoped_interactions", "J1 J2",
    """SELECT i.user_id, i.business_id, i.ts, b.city FROM interactions i JOIN businesses b ON i.business_id = b.business_id WHERE contains(lower(coalesce(b.categories, '')), 'hotel')""")
def _(v):
    scope = v.businesses.where(F.contains(F.lower(F.coalesce("categories", F.lit(""))), F.lit("hotel")))
    kept = ev.restrict_to_venues(v.interactions, scope)
    return spread_join(kept, v.businesses.select("business_id", "city"), ["business_id"], "left").select("user_id", "business_id", "ts", "city")


@query("users_without_history", "J5", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM reviews WHERE ts < TIMESTAMP '1995-07-01')")
def _(v):
    return v.raw("customer").select(F.col("c_custkey").alias("user_id")).join(ev.temporal_split(v.reviews, "1995-07-01")[0].select("user_id").distinct(), "user_id", "left_anti")


@query("overlap_users", "J6 U4", "SELECT user_id FROM both_users")
def _(v):
    return ev.overlap_users(*ev.temporal_split(v.interactions, "1999-01-01"))


@query(
    "stacked_sources", "U1",
    "SELECT user_id, business_id, ts, stars, NULL::INT AS tz_offset_min FROM reviews UNION ALL SELECT b_user_id, business_id, utc_ts, NULL, tz_offset_min FROM checkins_b",
)
def _(v):
    second = v.checkins_b.select(F.col("b_user_id").alias("user_id"), "business_id", F.col("utc_ts").alias("ts"), "tz_offset_min")
    return ev.union_events(v.reviews.select("user_id", "business_id", "ts", "stars"), second)


@query(
    "checkin_lists", "F5",
    """SELECT business_id, ts FROM (SELECT l_suppkey AS business_id, CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem UNION ALL SELECT l_suppkey, CAST(l_shipdate AS TIMESTAMP) + INTERVAL 1 DAY FROM lineitem)""",
)
def _(v):
    """Comma-separated time lists (with blanks and empty parts) split into one row each."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    t = F.col("l_shipdate").cast("timestamp")
    lists = v.raw("lineitem").select(
        F.col("l_suppkey").alias("business_id"),
        F.concat(F.date_format(t, fmt), F.lit(" , ,"), F.date_format(t + F.make_dt_interval(days=F.lit(1)), fmt), F.lit(",")).alias("date"),
    )
    return ev.explode_checkins(lists)


@query(
    "scalar_scores", "F8 F9 F10 F11 F12 F13 F19",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_discount * 100 AS d, 1 + l_quantity % 5 AS r, CASE WHEN l_returnflag = 'A' THEN 'Critic' ELSE 'Casual' END AS tag FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, exp(-q / 30.0) AS near_exp, 1 - q / 75.0 AS near_linear, 1 / (1 + exp(q - GREATEST(d, 2.0) / 2)) AS decay,
 GREATEST(0.0, 1 - (q / 30.0 * 60 + 5) * 1.5 / 100) AS ride, q / 30.0 * 60 + 2 AS minutes,
 GREATEST(0.0, LEAST(1.0, CASE WHEN q * 2 <= 60 THEN 1.0 ELSE GREATEST(0.75, 1 - (q * 2 - 60) / 200.0) END * (1 - LEAST(1.0, abs(r - d) / 5.0)))) AS context,
 CASE WHEN tag = 'Critic' AND d > r THEN GREATEST(0.0, 1 - 0.2 * ((d - r) / 2)) ELSE 1.0 END AS critic, ln(1 + q) AS logq, log2(1 + q) AS log2q, sqrt(q) AS rootq FROM x""",
    rnd="near_exp near_linear decay ride minutes context critic logq log2q rootq",
)
def _(v):
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    r = 1 + q % 5
    tag = F.when(F.col("l_returnflag") == "A", F.lit("Critic")).otherwise(F.lit("Casual"))
    return v.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        sc.proximity_exp(q).alias("near_exp"), sc.proximity_linear(q, 75.0).alias("near_linear"), sc.distance_decay(q, d).alias("decay"),
        sc.ride_cost_factor(q).alias("ride"), sc.drive_minutes(q).alias("minutes"), sc.context_score(q * 2, r, d).alias("context"),
        sc.critic_penalty(tag, d, r).alias("critic"), F.log1p(q).alias("logq"), F.log2(1 + q).alias("log2q"), F.sqrt(q).alias("rootq"),
    )


@query(
    "short_labels", "F14 F20",
    """SELECT p_partkey, CASE WHEN length(t) > 12 THEN substr(t, 1, 12) || '...' ELSE t END || ' (' || p_brand || ')' AS label, trim(string_split(t, ',')[1]) AS head FROM (SELECT *, p_name || ', ' || p_type AS t FROM part)""",
)
def _(v):
    t = F.concat("p_name", F.lit(", "), F.col("p_type"))
    return v.raw("part").select("p_partkey", sc.short_label(t, "p_brand", 12).alias("label"), sc.city_token(t).alias("head"))


@query(
    "calendar_parts", "F3 P7",
    """SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(month(ts) AS INT) AS month, CAST(year(ts) AS INT) AS year,
 CAST(date_trunc('week', ts) AS DATE) AS week, CAST(date_trunc('quarter', ts) AS DATE) AS quarter, isodow(ts) >= 6 AS is_weekend FROM events""",
)
def _(v):
    return v.events.select(
        "event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), F.month("ts").alias("month"), F.year("ts").alias("year"),
        F.trunc("ts", "week").alias("week"), F.trunc("ts", "quarter").alias("quarter"), (F.weekday("ts") >= 5).alias("is_weekend"),
    )


HAV = """2 * {r} * asin(sqrt(LEAST(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"""


def hav(a, c, b, d, r="6371000.0"):
    return HAV.format(a=a, b=b, c=c, d=d, r=r)


@query("distances_to_centre", "F1", f"SELECT poi_id, {hav('39.95', '-75.16', 'lat', 'lon')} AS metres FROM pois", rnd="metres", digits=4)
def _(v):
    return v.pois.select("poi_id", sc.haversine_m(F.lit(39.95), F.lit(-75.16), "lat", "lon").alias("metres"))


@query(
    "unit_sphere_points", "F2",
    "SELECT poi_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z, 2 * sin(800.0 / (2 * 6371000.0)) AS reach FROM pois",
    rnd="x y z reach", digits=9,
)
def _(v):
    p = sc.unit_xyz("lat", "lon")
    return v.pois.select("poi_id", p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), sc.chord(F.lit(800.0)).alias("reach"))


NEAR = """SELECT business_id, poi_id, dist_m FROM (SELECT b.business_id, p.poi_id, {d} AS dist_m FROM businesses b JOIN pois p
 ON p.lat BETWEEN b.latitude - {t} AND b.latitude + {t} AND p.lon BETWEEN b.longitude - {t} * 2 AND b.longitude + {t} * 2) WHERE dist_m <= {m}"""
view("near_75", NEAR.format(d=hav("b.latitude", "b.longitude", "p.lat", "p.lon"), t=0.001, m=75.0))
view("near_800", NEAR.format(d=hav("b.latitude", "b.longitude", "p.lat", "p.lon"), t=0.01, m=800.0))


@query("radius_pairs", "J8", "SELECT * FROM near_75", rnd="dist_m", digits=4)
def _(v):
    out = geo.radius_join(v.businesses, v.pois, 75.0, ("latitude", "longitude"), ("lat", "lon"))
    return out.select("business_id", "poi_id", "dist_m")


@query(
    "nearest_poi", "J9",
    """SELECT business_id, poi_id, dist_m FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY round(dist_m, 6), poi_id) AS i FROM near_75 WHERE dist_m <= 50) WHERE i = 1""", rnd="dist_m", digits=4,
)
def _(v):
    return geo.nearest_join(v.businesses, v.pois, 50.0, "business_id", "poi_id", ("latitude", "longitude"), ("lat", "lon"))


view(
    "density",
    f"""SELECT a.business_id, CAST(count(b.business_id) AS INT) AS walking_density FROM businesses a LEFT JOIN businesses b ON a.business_id <> b.business_id AND b.latitude BETWEEN a.latitude - 0.01 AND a.latitude + 0.01
 AND {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 800.0 GROUP BY a.business_id""",
)


@query("walking_density", "J10", "SELECT * FROM density")
def _(v):
    return geo.radius_count(v.businesses, 800.0, "business_id", ("latitude", "longitude"))


view(
    "transit",
    """SELECT b.business_id, coalesce(n, 0) AS stops_800m, round(coalesce(s, 0.0), 1) AS departures_day_800m, round(coalesce(m, 9999.0), 1) AS nearest_stop_m FROM businesses b LEFT JOIN
 (SELECT business_id, count(*) AS n, sum((poi_id % 7 + 21) / 7.0) AS s, min(dist_m) AS m FROM near_800 GROUP BY 1) x ON b.business_id = x.business_id""",
)
view(
    "transit_scores",
    """SELECT *, round(LEAST(departures_day_800m, (SELECT quantile_cont(departures_day_800m, 0.99) FROM transit)) / (SELECT quantile_cont(departures_day_800m, 0.99) FROM transit), 4) AS transit_access_score FROM transit""",
)


def stops(v):
    counts = {f"departure_count_dow{i}": F.lit(float(i - 1)) for i in range(2, 8)}
    return v.pois.select(F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"), (F.col("poi_id") % 7).cast("double").alias("departure_count_dow1")).withColumns(counts)


@query("transit_access", "J11", "SELECT * FROM transit_scores", rnd="transit_access_score", digits=3)
def _(v):
    return geo.transit_access(v.businesses, stops(v))


@query(
    "parking_scores", "P22",
    """WITH d AS (SELECT *, business_id % 6 AS k FROM density), q AS (SELECT quantile_cont(walking_density, 0.75) AS t FROM density)
SELECT business_id, walking_density, CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 WHEN 4 THEN (CASE WHEN walking_density > t THEN 0.0 ELSE 0.5 END) ELSE 0.5 END AS parking_score FROM d, q""", rnd="parking_score",
)
def _(v):
    k = F.col("business_id") % 6
    dense = geo.radius_count(v.businesses, 800.0, "business_id", ("latitude", "longitude"))
    flags = dense.withColumns({
        "parking_lot": F.when(k != 0, k == 1), "parking_garage": k == 2, "parking_valet": k == 3, "parking_street": k == 4,
    })
    return cl.parking_score(flags).select("business_id", "walking_density", "parking_score")


@query("city_overview", "A49",
    f"""WITH h AS (SELECT b.city, b.stars, {HOTEL_PROFILE} AS profile FROM hotel_venues v JOIN businesses b ON v.business_id = b.business_id)
SELECT city, count(*) AS venues, avg(stars) AS avg_stars, count(*) FILTER (WHERE profile = 'Business Hub') AS business_hubs, count(*) FILTER (WHERE profile = 'Seasonal Resort') AS seasonal_resorts FROM h GROUP BY city""",
    rnd="avg_stars")
def _(v):
    from footfall.operators.recommend import place_overview

    hotels = ft.hotel_venue_features(v.reviews, v.businesses, as_of()).join(v.businesses.select("business_id", "city", "stars"), "business_id")
    return place_overview(hotels.withColumn("profile", cl.classify_hotel_profile()))
