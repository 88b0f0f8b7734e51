"""Edges, behavioural features and table statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.catalog.registry import query, view
from footfall.operators import events as ev
from footfall.operators import features as ft

def as_of():
    return F.lit("2002-01-01").cast("timestamp")

view("pairs", "SELECT user_id, business_id, count(*) AS n FROM interactions WHERE user_id IS NOT NULL GROUP BY user_id, business_id")
view("edges", "SELECT user_id, business_id, CAST(n AS DOUBLE) AS weight FROM pairs")
view(
    "gaps",
    """SELECT user_id, business_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 86400000000.0 AS gap
 FROM reviews""",
)
view(
    "user_gaps",
    """SELECT user_id, count(gap) AS n_gaps, avg(gap) AS mu, stddev_pop(gap) AS sp, stddev_samp(gap) AS ss FROM gaps GROUP BY user_id""",
)
view(
    "user_features",
    """SELECT p.user_id, p.total_visits, p.unique_venues, (p.total_visits - p.unique_venues) / CAST(p.total_visits AS DOUBLE) AS revisit_ratio,
 p.m / CAST(p.total_visits AS DOUBLE) AS top1_venue_share, p.m AS max_visits_single_venue,
 CASE WHEN g.n_gaps < 2 THEN NULL WHEN g.sp + g.mu = 0 THEN 0.0 ELSE (g.sp - g.mu) / (g.sp + g.mu) END AS burstiness_index,
 s.days AS active_span_days, p.h AS venue_entropy, p.unique_venues / CAST(p.total_visits AS DOUBLE) AS unique_venue_ratio
 FROM (SELECT user_id, CAST(sum(n) AS BIGINT) AS total_visits, count(*) AS unique_venues, max(n) AS m, -sum(n / t * log2(n / t)) AS h
   FROM (SELECT user_id, n, CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS t FROM pairs) GROUP BY user_id) p
 JOIN user_gaps g ON p.user_id = g.user_id
 JOIN (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS days FROM reviews GROUP BY user_id) s ON p.user_id = s.user_id""",
)
view(
    "venue_gini",
    """SELECT business_id, 2 * sum(i * n) / CAST(max(k) * sum(n) AS DOUBLE) - (max(k) + 1) / CAST(max(k) AS DOUBLE) AS gini FROM
 (SELECT business_id, n, row_number() OVER (PARTITION BY business_id ORDER BY n) AS i, count(*) OVER (PARTITION BY business_id) AS k FROM pairs)
 GROUP BY business_id""",
)
view(
    "venue_loyalty",
    """SELECT b.business_id, b.total AS popularity_visits, coalesce(u.users, 0) AS unique_users, coalesce(g.gini, 0.0) AS gini_user_contribution,
 coalesce(u.rep, 0) AS repeat_user_count, coalesce(u.rep / CAST(u.users AS DOUBLE), 0.0) AS repeat_user_rate,
 coalesce(u.mean_rep, 0.0) AS avg_user_repeat_visits, coalesce(u.m, 0) / CAST(b.total AS DOUBLE) AS top_user_share
 FROM (SELECT business_id, count(*) AS total FROM interactions GROUP BY business_id) b
 LEFT JOIN (SELECT business_id, count(*) AS users, count(*) FILTER (WHERE n >= 2) AS rep, avg(n) FILTER (WHERE n >= 2) AS mean_rep, max(n) AS m
   FROM pairs GROUP BY business_id) u ON b.business_id = u.business_id
 LEFT JOIN venue_gini g ON b.business_id = g.business_id""",
)
view(
    "venue_weekly",
    """SELECT business_id, CASE WHEN r >= 7 THEN m ELSE r END AS weekly_visit_mean, CASE WHEN r >= 7 THEN s ELSE 0.0 END AS weekly_visit_std,
 CASE WHEN r >= 7 THEN s / m ELSE 0.0 END AS stability_cv
 FROM (SELECT business_id, CAST(sum(n) AS BIGINT) AS r, avg(n) AS m, stddev_samp(n) AS s FROM
  (SELECT business_id, date_trunc('week', ts) AS w, count(*) AS n FROM interactions GROUP BY 1, 2) GROUP BY business_id)""",
)
view(
    "venue_seasonal",
    """SELECT business_id, CASE WHEN sum(n) >= 4 AND count(*) >= 2 THEN var_samp(n) ELSE 0.0 END AS seasonal_variance FROM
 (SELECT business_id, date_trunc('quarter', ts) AS q, count(*) AS n FROM interactions GROUP BY 1, 2) GROUP BY business_id""",
)
view(
    "venue_features",
    """SELECT l.* EXCLUDE (top_user_share), w.weekly_visit_mean, w.weekly_visit_std, w.stability_cv, s.seasonal_variance
 FROM venue_loyalty l JOIN venue_weekly w ON l.business_id = w.business_id JOIN venue_seasonal s ON l.business_id = s.business_id""",
)


@query("edges_by_count", "A1 P7", "SELECT * FROM edges")
def _(v):
    return ev.edges(v.interactions)


@query(
    "edges_by_decay", "A2 F7",
    """SELECT user_id, business_id, sum(exp(-0.5 * (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(ts)) / 86400000000.0 / 365.0)) AS weight
 FROM reviews GROUP BY user_id, business_id""", rnd="weight",
)
def _(v):
    return ev.edges(v.interactions, "decay", as_of())


view(
    "credibility_edges",
    """SELECT r.user_id, r.business_id, sum(exp(-0.5 * floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(ts)) / 86400000000.0) / 365.0) * c.trust) AS weight
 FROM reviews r JOIN (SELECT user_id, ln(1 + count(*)) / ln(1 + max(count(*)) OVER ()) AS trust FROM reviews GROUP BY user_id) c ON r.user_id = c.user_id
 GROUP BY r.user_id, r.business_id""",
)


@query("edges_by_credibility", "A3", "SELECT * FROM credibility_edges", rnd="weight")
def _(v):
    return ev.edges(v.interactions, "credibility", as_of())


@query(
    "graph_statistics", "A4",
    """WITH u AS (SELECT user_id, count(*) AS d FROM edges GROUP BY user_id), w AS (SELECT business_id, count(*) AS d FROM edges GROUP BY business_id)
SELECT (SELECT count(*) FROM edges) AS edges, (SELECT sum(weight) FROM edges) AS total_weight,
 (SELECT count(*) FROM u) AS users, (SELECT avg(d) FROM u) AS user_degree_mean, (SELECT CAST(max(d) AS DOUBLE) FROM u) AS user_degree_max,
 (SELECT CAST(min(d) AS DOUBLE) FROM u) AS user_degree_min, (SELECT median(d) FROM u) AS user_degree_median,
 (SELECT count(*) FROM w) AS venues, (SELECT avg(d) FROM w) AS venue_degree_mean, (SELECT CAST(max(d) AS DOUBLE) FROM w) AS venue_degree_max,
 (SELECT CAST(min(d) AS DOUBLE) FROM w) AS venue_degree_min, (SELECT median(d) FROM w) AS venue_degree_median,
 (SELECT count(*) FROM edges) / CAST((SELECT count(*) FROM u) * (SELECT count(*) FROM w) AS DOUBLE) AS density""",
    rnd="user_degree_mean venue_degree_mean density",
)
def _(v):
    return ev.graph_stats(ev.edges(v.interactions))


@query(
    "user_basics", "A5 W1 F3",
    """WITH h AS (SELECT user_id, hour(ts) AS hr, count(*) AS n FROM reviews GROUP BY 1, 2),
m AS (SELECT user_id, CAST(arg_min(hr, (100000000 - n) * 100 + hr) AS INT) AS time_of_day_mode FROM h GROUP BY user_id)
SELECT r.user_id, count(*) AS total_visits, count(DISTINCT business_id) AS unique_venues,
 (count(*) - count(DISTINCT business_id)) / CAST(count(*) AS DOUBLE) AS revisit_ratio, any_value(g.mu) AS avg_time_gap_days,
 any_value(m.time_of_day_mode) AS time_of_day_mode, avg(CASE WHEN isodow(ts) <= 5 THEN 1.0 ELSE 0.0 END) AS weekday_ratio
FROM reviews r JOIN m ON r.user_id = m.user_id JOIN user_gaps g ON r.user_id = g.user_id GROUP BY r.user_id""",
    rnd="revisit_ratio avg_time_gap_days weekday_ratio",
)
def _(v):
    return ft.user_basics(v.interactions)


@query(
    "visit_gaps", "W1 A9 A10",
    """SELECT user_id, n_gaps, mu AS gap_mean, sp AS gap_std_pop, ss AS gap_std FROM user_gaps""",
    rnd="gap_mean gap_std_pop gap_std", digits=5,
)
def _(v):
    return ft.gap_moments(v.interactions, "user_id")


@query(
    "user_concentration", "A8",
    """SELECT user_id, max(n) / CAST(sum(n) AS DOUBLE) AS top1_venue_share, sum(CASE WHEN i <= 3 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS top3_venue_share,
 max(n) AS max_visits_single_venue FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, business_id) AS i FROM pairs) GROUP BY user_id""",
    rnd="top1_venue_share top3_venue_share",
)
def _(v):
    return ft.user_concentration(v.interactions)


@query(
    "user_gap_cv", "A9", "SELECT user_id, CASE WHEN mu > 0 THEN ss / mu END AS burstiness FROM user_gaps", rnd="burstiness"
)
def _(v):
    return ft.burstiness(v.interactions, kind="cv")


@query(
    "user_burstiness", "A10",
    "SELECT user_id, CASE WHEN n_gaps < 2 THEN NULL WHEN sp + mu = 0 THEN 0.0 ELSE (sp - mu) / (sp + mu) END AS burstiness FROM user_gaps",
    rnd="burstiness",
)
def _(v):
    return ft.burstiness(v.interactions)


@query(
    "user_burstiness_positive_gaps", "A11",
    """SELECT user_id, CASE WHEN count(*) >= 3 AND count(gap) FILTER (WHERE gap > 0) >= 2 THEN
 (stddev_pop(gap) FILTER (WHERE gap > 0) - avg(gap) FILTER (WHERE gap > 0)) / (stddev_pop(gap) FILTER (WHERE gap > 0) + avg(gap) FILTER (WHERE gap > 0))
 ELSE 0.0 END AS burstiness FROM gaps GROUP BY user_id""", rnd="burstiness",
)
def _(v):
    return ft.burstiness(v.interactions, kind="positive")


@query(
    "user_activity", "A9 A12",
    """SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS active_span_days,
 CASE WHEN count(*) < 2 THEN NULL WHEN max(ts) > min(ts) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) ELSE 0.0 END AS visits_per_active_day,
 count(DISTINCT date_trunc('month', ts)) AS months_active, count(DISTINCT date_trunc('month', ts)) / 216.0 AS repeat_month_ratio
FROM reviews GROUP BY user_id""", rnd="active_span_days visits_per_active_day repeat_month_ratio",
)
def _(v):
    return ft.user_activity(v.interactions)


@query(
    "user_venue_entropy", "A13",
    "SELECT user_id, -sum(n / t * log2(n / t)) AS venue_entropy FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS t FROM pairs) GROUP BY user_id",
    rnd="venue_entropy",
)
def _(v):
    return ft.entropy(v.interactions.where(F.col("user_id").isNotNull()), ["user_id"], "business_id", "venue_entropy")


@query(
    "user_features", "A8 A10 A13 A14", "SELECT * FROM user_features",
    rnd="revisit_ratio top1_venue_share burstiness_index active_span_days venue_entropy unique_venue_ratio",
)
def _(v):
    return ft.user_features(v.interactions)


@query(
    "venue_basics", "A6",
    """SELECT business_id, popularity_visits AS total_visits, unique_users, repeat_user_count AS repeat_users, repeat_user_rate AS revisit_rate FROM venue_loyalty""",
    rnd="revisit_rate",
)
def _(v):
    return ft.venue_basics(v.interactions)


@query(
    "venue_monthly_stability", "A7",
    """SELECT business_id, CASE WHEN sum(n) > 10 AND count(*) > 1 THEN 1 / (1 + stddev_samp(n) / avg(n)) END AS temporal_stability FROM
 (SELECT business_id, date_trunc('month', ts) AS m, count(*) AS n FROM interactions GROUP BY 1, 2) GROUP BY business_id""",
    rnd="temporal_stability",
)
def _(v):
    return ft.venue_stability(v.interactions)


@query("venue_gini", "A15 W6", "SELECT * FROM venue_gini", rnd="gini")
def _(v):
    return ft.gini(ft.pair_counts(v.interactions), ["business_id"], "n")


@query(
    "venue_loyalty", "A15 A16 A20", "SELECT * FROM venue_loyalty",
    rnd="gini_user_contribution repeat_user_rate avg_user_repeat_visits top_user_share",
)
def _(v):
    return ft.venue_loyalty(v.interactions)


@query("venue_weekly", "A17", "SELECT * FROM venue_weekly", rnd="weekly_visit_mean weekly_visit_std stability_cv")
def _(v):
    return ft.venue_weekly(v.interactions)


@query(
    "venue_weekly_all_weeks", "A18",
    """WITH w AS (SELECT business_id, CAST(date_trunc('week', ts) AS DATE) AS w, count(*) AS n FROM interactions GROUP BY 1, 2),
b AS (SELECT business_id, min(w) AS lo, max(w) AS hi FROM w GROUP BY 1),
g AS (SELECT business_id, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS w FROM b)
SELECT g.business_id, CASE WHEN count(*) > 1 THEN stddev_samp(coalesce(w.n, 0)) / avg(coalesce(w.n, 0)) ELSE 1.0 END AS stability_cv
FROM g LEFT JOIN w ON g.business_id = w.business_id AND g.w = w.w GROUP BY g.business_id""", rnd="stability_cv",
)
def _(v):
    return ft.venue_weekly(v.interactions, empty_weeks=True)


@query("venue_seasonal_variance", "A19", "SELECT * FROM venue_seasonal", rnd="seasonal_variance")
def _(v):
    return ft.venue_seasonal_variance(v.interactions)


@query(
    "venue_features", "A15 A17 A19 A20", "SELECT * FROM venue_features",
    rnd="gini_user_contribution repeat_user_rate avg_user_repeat_visits weekly_visit_mean weekly_visit_std stability_cv seasonal_variance",
)
def _(v):
    return ft.venue_features(v.interactions)


view(
    "user_homes",
    """SELECT user_id, arg_min(state, lpad(CAST(1000000000 - n AS VARCHAR), 10, '0') || state) AS home FROM
 (SELECT user_id, state, count(*) AS n FROM reviews r JOIN businesses b ON r.business_id = b.business_id GROUP BY 1, 2) GROUP BY user_id""",
)
view(
    "hotel_venues",
    """SELECT a.*, s.seasonal_cv, y.venue_stability_cv, g.gini AS traveler_concentration, d.geographic_diversity, a.multi_stay_rate AS revisit_rate FROM
 (SELECT b.*, u.n_unique_users, u.multi_stay_rate FROM
  (SELECT business_id, count(*) AS n_reviews, avg(CASE WHEN isodow(ts) <= 4 THEN 1.0 ELSE 0.0 END) AS business_leisure_ratio,
    sum(exp(-0.5 * floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(ts)) / 86400000000.0) / 365.0)) AS review_velocity
   FROM reviews GROUP BY business_id HAVING count(*) >= 5) b
  JOIN (SELECT business_id, count(*) AS n_unique_users, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS multi_stay_rate FROM pairs GROUP BY business_id) u
  ON b.business_id = u.business_id) a
 JOIN (SELECT business_id, coalesce(stddev_samp(n) / avg(n), 0.0) AS seasonal_cv FROM (SELECT business_id, month(ts) AS p, count(*) AS n FROM reviews GROUP BY 1, 2) GROUP BY 1) s
  ON a.business_id = s.business_id
 JOIN (SELECT business_id, coalesce(stddev_samp(n) / avg(n), 0.0) AS venue_stability_cv FROM (SELECT business_id, year(ts) AS p, count(*) AS n FROM reviews GROUP BY 1, 2) GROUP BY 1) y
  ON a.business_id = y.business_id
 JOIN venue_gini g ON a.business_id = g.business_id
 JOIN (SELECT business_id, -sum(n / t * log2(n / t)) + 0.0 AS geographic_diversity FROM
   (SELECT business_id, home, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY business_id) AS DOUBLE) AS t
    FROM pairs p JOIN user_homes h ON p.user_id = h.user_id GROUP BY 1, 2) GROUP BY business_id) d ON a.business_id = d.business_id""",
)
HOTEL_DOUBLES = (
    "business_leisure_ratio review_velocity multi_stay_rate seasonal_cv venue_stability_cv traveler_concentration geographic_diversity revisit_rate"
)


@query("hotel_venue_features", "A21 A22", "SELECT * FROM hotel_venues", rnd=HOTEL_DOUBLES)
def _(v):
    return ft.hotel_venue_features(v.reviews, v.businesses, as_of())


@query("user_home_state", "A22", "SELECT * FROM user_homes")
def _(v):
    return ft.user_home(v.reviews, v.businesses, "state")


view(
    "hotel_users",
    """WITH placed AS (SELECT r.*, b.state, b.city FROM reviews r JOIN businesses b ON r.business_id = b.business_id),
 st AS (SELECT user_id, count(*) AS k, -sum(n / t * log2(n / t)) + 0.0 AS h FROM (SELECT user_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS t FROM placed GROUP BY user_id, state) GROUP BY user_id),
 ci AS (SELECT user_id, count(*) AS k, -sum(n / t * log2(n / t)) + 0.0 AS h FROM (SELECT user_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS t FROM placed GROUP BY user_id, city) GROUP BY user_id)
 SELECT b.user_id, b.total_hotel_reviews, b.avg_rating_given, b.weekday_fraction, b.n_unique_hotels, st.k AS n_states_visited, st.h AS hotel_state_diversity,
 ci.k AS n_cities_visited, ci.h AS hotel_city_diversity, b.total_hotel_reviews / b.years AS hotel_frequency,
 CASE WHEN b.total_hotel_reviews >= 10 AND st.k >= 3 THEN 1 ELSE 0 END AS is_road_warrior, CASE WHEN b.weekday_fraction < 0.5 THEN 1 ELSE 0 END AS is_leisure_traveler
 FROM (SELECT user_id, count(*) AS total_hotel_reviews, avg(stars) AS avg_rating_given, avg(CASE WHEN isodow(ts) <= 4 THEN 1.0 ELSE 0.0 END) AS weekday_fraction,
  count(DISTINCT business_id) AS n_unique_hotels, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) / 365.0 + 1.0 AS years FROM reviews GROUP BY user_id) b
 JOIN st ON b.user_id = st.user_id JOIN ci ON b.user_id = ci.user_id""",
)


@query(
    "hotel_user_features", "A23", "SELECT * FROM hotel_users",
    rnd="avg_rating_given weekday_fraction hotel_state_diversity hotel_city_diversity hotel_frequency",
)
def _(v):
    return ft.hotel_user_features(v.reviews, v.businesses)


@query(
    "loyalty_profile", "A37",
    """SELECT count(*) AS pairs, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS share_2plus, avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END) AS share_3plus FROM pairs""",
    rnd="share_2plus share_3plus",
)
def _(v):
    return ft.loyalty_profile(v.reviews)


@query(
    "calendar_profile", "A37",
    """SELECT 'weekday' AS part, CAST(isodow(ts) - 1 AS INT) AS slot, count(*) AS n FROM reviews GROUP BY 2
UNION ALL SELECT 'month', CAST(month(ts) AS INT), count(*) FROM reviews GROUP BY 2""",
)
def _(v):
    return ft.calendar_profile(v.reviews)


@query(
    "season_profile", "A37",
    """SELECT (SELECT avg(CASE WHEN isodow(ts) < 6 THEN 1.0 ELSE 0.0 END) FROM reviews) AS weekday_share, (SELECT stddev_samp(n) / avg(n) FROM (SELECT count(*) AS n FROM reviews GROUP BY month(ts))) AS month_cv,
 avg(cv) AS venue_cv_mean, count(*) FILTER (cv < 0.3) AS steady_venues FROM (SELECT stddev_samp(n) / avg(n) AS cv FROM (SELECT business_id, count(*) AS n FROM reviews GROUP BY business_id, year(ts)) GROUP BY business_id HAVING count(*) > 1)""",
    rnd="weekday_share month_cv venue_cv_mean",
)
def _(v):
    return ft.season_profile(v.reviews)


@query(
    "events_per_month", "A45", "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM interactions GROUP BY 1"
)
def _(v):
    return ev.month_series(v.interactions)


@query(
    "hour_distribution", "A46",
    """WITH h AS (SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY 1)
SELECT hour, n, (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS peak_hour FROM h""",
)
def _(v):
    return ev.hour_distribution(v.events, F.hour("ts"))
