"""Restaurant profiles, busyness, multi-objective recommendation, serving and candidate sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from footfall.catalog.cleaning import hav, stops
from footfall.catalog.ranking import METRICS, as_of, behavioural, ideal_case, train_test
from footfall.catalog.registry import query, view
from footfall.functions import scalar as sc
from footfall.operators import baseline as bl
from footfall.operators import evaluate as evl
from footfall.operators import features as ft
from footfall.operators import geo
from footfall.operators import recommend as rec
from footfall.operators import restaurant as rs
from footfall.operators import segments as sg

view(
    "diners",
    "SELECT *, business_id % 3 = 0 AS parking_lot, business_id % 5 = 0 AS parking_garage FROM businesses",
)


def diners(v):
    return v.businesses.withColumns({"parking_lot": F.col("business_id") % 3 == 0, "parking_garage": F.col("business_id") % 5 == 0})


view(
    "ranges",
    f"""WITH p AS (SELECT p.user_id, b.latitude, b.longitude FROM pairs p JOIN businesses b ON p.business_id = b.business_id WHERE b.latitude IS NOT NULL),
 m AS (SELECT user_id, avg(latitude) AS lat, avg(longitude) AS lon FROM p GROUP BY user_id)
 SELECT p.user_id, quantile_cont({hav('p.latitude', 'p.longitude', 'm.lat', 'm.lon', '6371.0')}, 0.9) AS spatial_range_km FROM p JOIN m ON p.user_id = m.user_id GROUP BY p.user_id""",
)


@query("spatial_ranges", "A25", "SELECT * FROM ranges", rnd="spatial_range_km", digits=4)
def _(v):
    return rs.spatial_range(v.reviews, v.businesses)


view(
    "diner_profiles",
    """WITH x AS (SELECT p.user_id, p.n, b.* FROM pairs p JOIN diners b ON p.business_id = b.business_id),
 k AS (SELECT user_id, trim(kind) AS kind, sum(n) AS n FROM (SELECT user_id, n, unnest(string_split(categories, ',')) AS kind FROM x WHERE categories IS NOT NULL) GROUP BY 1, 2),
 e AS (SELECT user_id, -sum(n / t * log2(n / t)) + 0.0 AS category_entropy FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS t FROM k) GROUP BY 1),
 b AS (SELECT user_id, CASE WHEN count(*) >= 3 AND count(gap) FILTER (WHERE gap > 0) >= 2 THEN (stddev_pop(gap) FILTER (WHERE gap > 0) - avg(gap) FILTER (WHERE gap > 0)) / (stddev_pop(gap) FILTER (WHERE gap > 0) + avg(gap) FILTER (WHERE gap > 0)) ELSE 0.0 END AS burstiness FROM gaps GROUP BY 1)
 SELECT x.user_id, CAST(sum(x.n) AS BIGINT) AS total_visits, count(*) AS unique_venues, any_value(f.venue_entropy) AS venue_entropy, sum(x.n * x.stars) / CAST(sum(x.n) AS DOUBLE) AS avg_visited_rating,
 sqrt(GREATEST(sum(x.n * x.stars * x.stars) / sum(x.n) - pow(sum(x.n * x.stars) / sum(x.n), 2), 0.0)) AS rating_std,
 sum(CASE WHEN contains(coalesce(x.categories, ''), 'Bars') THEN x.n ELSE 0 END) / CAST(sum(x.n) AS DOUBLE) AS nightlife_affinity,
 sum(CASE WHEN x.parking_lot OR x.parking_garage THEN x.n ELSE 0 END) / CAST(sum(x.n) AS DOUBLE) AS parking_sensitivity, avg(x.latitude) AS centroid_lat, avg(x.longitude) AS centroid_lon,
 coalesce(any_value(e.category_entropy), 0.0) AS category_entropy, any_value(r.spatial_range_km) AS spatial_range_km, any_value(b.burstiness) AS burstiness, any_value(f.revisit_ratio) AS revisit_ratio
 FROM x JOIN user_features f ON x.user_id = f.user_id LEFT JOIN e ON x.user_id = e.user_id JOIN ranges r ON x.user_id = r.user_id JOIN b ON x.user_id = b.user_id GROUP BY x.user_id HAVING sum(x.n) >= 3""",
)
PROFILE = "venue_entropy avg_visited_rating rating_std nightlife_affinity parking_sensitivity centroid_lat centroid_lon category_entropy spatial_range_km burstiness revisit_ratio"


@query("diner_profiles", "A24 A11 A25", "SELECT * FROM diner_profiles", rnd=PROFILE, digits=4)
def _(v):
    return rs.restaurant_user_features(v.reviews, diners(v))


view(
    "tagged_diners",
    """SELECT *, CASE WHEN avg_visited_rating >= m + 0.3 THEN 'Critic' WHEN avg_visited_rating <= m - 0.3 THEN 'Casual' ELSE 'Moderate' END AS critic_tag,
 CASE WHEN spatial_range_km >= hi THEN 'Preference-First' WHEN spatial_range_km <= lo THEN 'Distance-First' ELSE 'Balanced' END AS spatial_tag,
 CASE WHEN nightlife_affinity > 0.3 THEN 'Nightlife / Ride-Share Candidate' ELSE 'Explorer' END AS archetype
 FROM diner_profiles, (SELECT median(avg_visited_rating) AS m, quantile_cont(spatial_range_km, 0.3) AS lo, quantile_cont(spatial_range_km, 0.7) AS hi FROM diner_profiles)""",
)


def tagged(v):
    users = sg.spatial_tag(sg.critic_tag(rs.restaurant_user_features(v.reviews, diners(v))))
    night = F.col("nightlife_affinity") > 0.3
    return users.withColumn("archetype", F.when(night, F.lit(rec.RIDE_SHARE)).otherwise(F.lit("Explorer")))


@query("diner_tags", "P21", "SELECT user_id, critic_tag, spatial_tag FROM tagged_diners")
def _(v):
    return tagged(v).select("user_id", "critic_tag", "spatial_tag")


@query("diner_archetypes", "M9 M10 P21")
def _(v):
    """Four clusters of diners named by the column their mean leads in."""
    cols = ["venue_entropy", "revisit_ratio", "total_visits", "spatial_range_km", "parking_sensitivity", "nightlife_affinity"]
    out, _ = sg.cluster(rs.restaurant_user_features(v.reviews, diners(v)), cols, 4, restarts=2)
    return sg.name_segments_by_peak(out, sg.RESTAURANT_PEAKS).select("user_id", "cluster", "segment")


view(
    "diner_venues",
    """WITH w AS (SELECT business_id, CAST(date_trunc('week', ts) AS DATE) AS w, count(*) AS n FROM reviews GROUP BY 1, 2), b AS (SELECT business_id, min(w) AS lo, max(w) AS hi FROM w GROUP BY 1),
 g AS (SELECT business_id, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS w FROM b),
 s AS (SELECT g.business_id, CASE WHEN count(*) > 1 THEN stddev_samp(coalesce(w.n, 0)) / avg(coalesce(w.n, 0)) ELSE 1.0 END AS stability_cv FROM g LEFT JOIN w ON g.business_id = w.business_id AND g.w = w.w GROUP BY 1)
 SELECT b.business_id, l.popularity_visits AS popularity, l.unique_users AS unique_visitors, l.repeat_user_rate, l.gini_user_contribution AS gini_user_concentration, r.m AS avg_rating, r.c AS rating_consistency, s.stability_cv,
 array_to_string(list_slice(list_filter(list_transform(string_split(coalesce(b.categories, ''), ','), lambda x: trim(x)), lambda x: x <> ''), 1, 3), ', ') AS cuisine_categories
 FROM businesses b JOIN venue_loyalty l ON b.business_id = l.business_id JOIN (SELECT business_id, avg(stars) AS m, 1 / (stddev_pop(stars) + 0.1) AS c FROM reviews GROUP BY 1) r ON b.business_id = r.business_id JOIN s ON b.business_id = s.business_id""",
)


@query("diner_venues", "A26", "SELECT * FROM diner_venues", rnd="repeat_user_rate gini_user_concentration avg_rating rating_consistency stability_cv")
def _(v):
    return rs.restaurant_venue_features(v.interactions, v.businesses)


view(
    "event_cells",
    "SELECT user_id AS business_id, CAST(isodow(ts) - 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3",
)


@query(
    "busyness_observed_cells", "A27 W7",
    """WITH s AS (SELECT *, round_even(n / CAST(max(n) OVER (PARTITION BY business_id) AS DOUBLE) * 100, 0) AS share FROM event_cells)
SELECT business_id, max(share) AS peak_busyness, round(avg(share), 1) AS avg_busyness, (SELECT hour FROM s x WHERE x.business_id = s.business_id ORDER BY share DESC, dow, hour LIMIT 1) AS peak_hour FROM s GROUP BY business_id""",
    rnd="avg_busyness", digits=1,
)
def _(v):
    return rs.busyness(v.events.withColumnRenamed("user_id", "business_id"), F.col("ts"), "observed")


@query(
    "busyness_all_cells", "A28 F4",
    """WITH s AS (SELECT *, n / CAST(max(n) OVER (PARTITION BY business_id) AS DOUBLE) * 100 AS share FROM (SELECT business_id, CAST(isodow(t) - 1 AS INT) AS dow, CAST(hour(t) AS INT) AS hour, count(*) AS n
 FROM (SELECT business_id, utc_ts + INTERVAL '1' MINUTE * tz_offset_min AS t FROM checkins_b) GROUP BY 1, 2, 3))
SELECT business_id, max(share) AS peak_busyness, sum(share) / 168 AS avg_busyness, (SELECT hour FROM s x WHERE x.business_id = s.business_id ORDER BY share DESC, dow, hour LIMIT 1) AS peak_hour FROM s GROUP BY business_id""",
    rnd="avg_busyness", digits=1,
)
def _(v):
    """Check-ins arrive with text times, are moved to local time and counted per hour of the week."""
    text = F.date_format("utc_ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    raw = v.checkins_b.select("business_id", text.alias("utc_text"), "tz_offset_min")
    return rs.busyness(raw, sc.parse_utc("utc_text", "tz_offset_min"), "all")


view("popular_venues", "SELECT v.*, b.latitude, b.longitude, t.transit_access_score, CASE b.business_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS parking_score, CAST(b.business_id % 101 AS DOUBLE) AS peak_busyness FROM diner_venues v JOIN businesses b ON v.business_id = b.business_id JOIN transit_scores t ON v.business_id = t.business_id")


def popular(v):
    k = F.col("business_id") % 3
    return (
        rs.restaurant_venue_features(v.interactions, v.businesses)
        .join(v.businesses.select("business_id", "latitude", "longitude"), "business_id")
        .join(geo.transit_access(v.businesses, stops(v)).select("business_id", "transit_access_score"), "business_id")
        .withColumns({
            "parking_score": F.when(k == 0, F.lit(1.0)).when(k == 1, F.lit(0.5)).otherwise(F.lit(0.0)),
            "peak_busyness": (F.col("business_id") % 101).cast("double"),
        })
    )


DIST = hav("u.centroid_lat", "u.centroid_lon", "v.latitude", "v.longitude", "6371.0")
view(
    "objective_rows",
    f"""SELECT user_id, business_id, avg_rating, LEAST(1.0, ln(1 + popularity / 1000.0 * (1 + repeat_user_rate)) / 2) AS base,
 LEAST(1.0, ln(1 + popularity / 1000.0 * (1 + repeat_user_rate)) / 2) * CASE WHEN critic_tag = 'Critic' AND avg_visited_rating > avg_rating THEN GREATEST(0.0, 1 - 0.2 * ((avg_visited_rating - avg_rating) / 2)) ELSE 1.0 END AS u_beh,
 LEAST(1.0, near * CASE WHEN rides THEN GREATEST(0.0, 1 - (d / 30.0 * 60 + 5) * 1.5 / 100) ELSE 1.0 END * 0.55 + CASE WHEN rides THEN 1.0 WHEN parking_sensitivity > 0.5 THEN pow(parking_score, 1.5) ELSE parking_score END * 0.30 + transit_access_score * 0.15) AS c_mob,
 GREATEST(0.0, LEAST(1.0, CASE WHEN peak_busyness <= 60 THEN 1.0 ELSE GREATEST(0.75, 1 - (peak_busyness - 60) / 200.0) END * (1 - LEAST(1.0, abs(avg_rating - avg_visited_rating) / 5.0)))) AS r_ctx
 FROM (SELECT *, 1 - 1 / (1 + exp(GREATEST(2.0, spatial_range_km) / 2 - d)) AS near FROM (SELECT u.user_id, u.critic_tag, u.avg_visited_rating, u.spatial_range_km, u.parking_sensitivity, v.*, {DIST} AS d,
  u.archetype = 'Nightlife / Ride-Share Candidate' AND contains(v.cuisine_categories, 'Bars') AS rides FROM tagged_diners u CROSS JOIN popular_venues v) WHERE d <= 10.0)""",
)


@query(
    "candidate_objectives", "R1 R2 R3 J14 F9 F10 F11 F12", "SELECT user_id, business_id, u_beh, c_mob, r_ctx FROM objective_rows", rnd="u_beh c_mob r_ctx", digits=5
)
def _(v):
    return rec.objectives(tagged(v), popular(v)).select("user_id", "business_id", "u_beh", "c_mob", "r_ctx")


def _weights_sql() -> str:
    cols = ("u_beh", "c_mob", "r_ctx")
    s = ", ".join(f"sum({c} + 1e-6) OVER (PARTITION BY user_id) AS s_{c}" for c in cols)
    h = ", ".join(f"1 + sum(({c} + 1e-6) / s_{c} * ln(({c} + 1e-6) / s_{c} + 1e-12)) / ln(count(*)) AS d_{c}" for c in cols)
    raw = {c: f"0.35 * d_{c} / (d_u_beh + d_c_mob + d_r_ctx) + 0.65 * {p}" for c, p in zip(cols, (0.55, 0.45, 0.0))}
    total = " + ".join(f"({r})" for r in raw.values())
    return f"""WITH s AS (SELECT user_id, {', '.join(cols)}, {s} FROM objective_rows), d AS (SELECT user_id, {h} FROM s GROUP BY user_id)
SELECT user_id, {', '.join(f'({r}) / ({total}) AS w_{c}' for c, r in raw.items())} FROM d"""


view("objective_weights", _weights_sql())


@query("objective_weights", "R4 R5", "SELECT * FROM objective_weights", rnd="w_u_beh w_c_mob w_r_ctx")
def _(v):
    out = rec.blend_weights(rec.entropy_weights(rec.objectives(tagged(v), popular(v))))
    return out.groupBy("user_id").agg(*[F.max(c).alias(c) for c in ("w_u_beh", "w_c_mob", "w_r_ctx")])


view(
    "scored_candidates",
    """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, business_id) AS rank FROM (SELECT o.user_id, o.business_id, round(w_u_beh * u_beh + w_c_mob * c_mob + w_r_ctx * r_ctx, 9) AS score
 FROM objective_rows o JOIN objective_weights w ON o.user_id = w.user_id)""",
)


@query("scored_candidates", "R6 W4", "SELECT user_id, business_id, rank, score FROM scored_candidates WHERE rank <= 10", rnd="score")
def _(v):
    return rec.score_candidates(tagged(v), popular(v), keep=10).select("user_id", "business_id", "rank", "score")


@query("mean_objective_weights", "A48", "SELECT avg(w_u_beh) AS w_u_beh, avg(w_c_mob) AS w_c_mob, avg(w_r_ctx) AS w_r_ctx FROM objective_weights", rnd="w_u_beh w_c_mob w_r_ctx")
def _(v):
    return rec.mean_weights(rec.score_candidates(tagged(v), popular(v), keep=5))


LIKE = f"""0.7 * (len(list_intersect(x.kinds, pick.kinds)) / CAST(greatest(len(list_distinct(list_concat(x.kinds, pick.kinds))), 1) AS DOUBLE)) + 0.3 * greatest(0.0, 1 - {hav('x.lat', 'x.lon', 'pick.lat', 'pick.lon', '6371.0')} / 5.0)"""


@query(
    "diverse_recommendations", "R7 U7",
    f"""WITH RECURSIVE c AS (SELECT user_id, list(struct_pack(id := s.business_id, score := score, kinds := string_split(coalesce(cuisine_categories, ''), ', '), lat := latitude, lon := longitude) ORDER BY rank) AS items
 FROM scored_candidates s JOIN popular_venues v ON s.business_id = v.business_id WHERE rank <= 100 GROUP BY user_id),
r AS (SELECT user_id, items, CAST([] AS BIGINT[]) AS chosen, list_transform(items, lambda x: CAST(0 AS DOUBLE)) AS likes FROM c
 UNION ALL SELECT user_id, items, list_append(chosen, nxt), list_transform(items, lambda x, i: greatest(likes[i], {LIKE})) FROM
 (SELECT *, items[nxt] AS pick FROM (SELECT *, list_position(gain, list_max(gain)) AS nxt FROM (SELECT *, list_transform(items, lambda x, i: CASE WHEN NOT list_contains(chosen, i) THEN round(CASE WHEN len(chosen) = 0 THEN x.score ELSE 0.7 * x.score - (1 - 0.7) * likes[i] END, 9) END) AS gain
  FROM r WHERE len(chosen) < least(20, len(items))))))
SELECT user_id, items[chosen[n]].id AS business_id, CAST(n AS BIGINT) AS rank FROM (SELECT user_id, items, chosen, unnest(range(1, len(chosen) + 1)) AS n FROM r WHERE len(chosen) = least(20, len(items)))""",
)
def _(v):
    """Twenty recommendations per user, re-ranked for diversity."""
    best = rec.score_candidates(tagged(v), popular(v)).select("user_id", "business_id", "rank", "score", "latitude", "longitude", "categories")
    return rec.diversify(best).select("user_id", "business_id", F.col("rank").cast("bigint").alias("rank"))


@query("category_jaccard", "U7",
    """WITH b AS (SELECT business_id, city, list_filter(list_transform(string_split(coalesce(categories, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS t FROM businesses)
SELECT a.business_id, b.business_id AS other_id, CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) END AS jaccard
FROM b a JOIN b ON b.business_id = a.business_id + 1""", rnd="jaccard")
def _(v):
    b = v.businesses.select("business_id", sc.tokens("categories").alias("t"))
    other = b.select((F.col("business_id") - 1).alias("business_id"), F.col("business_id").alias("other_id"), F.col("t").alias("o"))
    return b.join(other, "business_id").select("business_id", "other_id", sc.token_jaccard(F.col("t"), F.col("o")).alias("jaccard"))


def _ablation_sql() -> str:
    kinds = {
        "Full Model": "0.55 * u_beh + 0.45 * c_mob + 0.0 * r_ctx",
        "No Mobility (C_mob)": "0.55 * u_beh + 0.45 * 1.0 + 0.0 * r_ctx",
        "No Context (R_ctx)": "0.55 * u_beh + 0.45 * c_mob + 0.0 * 1.0",
        "No Critic Penalty": "0.55 * base + 0.45 * c_mob + 0.0 * r_ctx",
        "Popularity": "base",
        "Rating": "avg_rating",
        "Random": "CAST('0x' || substr(md5('42:' || CAST(user_id AS VARCHAR) || ':' || CAST(business_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0",
    }
    rows = " UNION ALL ".join(f"SELECT '{k}' AS method, user_id, business_id, round({e}, 9) AS score FROM objective_rows" for k, e in kinds.items())
    cols = []
    for k in evl.KS:
        found = f"sum(CASE WHEN position <= {k} THEN rel ELSE 0 END)"
        dcg = f"sum(CASE WHEN position <= {k} THEN rel / log2(position + 1) ELSE 0.0 END)"
        cols += [f"coalesce({dcg} / nullif({ideal_case(found, k)}, 0), 0.0) AS ndcg_{k}", f"CASE WHEN {found} > 0 THEN 1.0 ELSE 0.0 END AS hit_{k}"]
    return f"""WITH r AS (SELECT a.method, a.user_id, a.business_id, row_number() OVER (PARTITION BY a.method, a.user_id ORDER BY a.score DESC, a.business_id) AS position, CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS rel
 FROM ({rows}) a LEFT JOIN test_pairs t ON a.user_id = t.user_id AND a.business_id = t.business_id),
u AS (SELECT method, user_id, {', '.join(cols)} FROM r GROUP BY method, user_id HAVING sum(rel) > 0)
SELECT method, {', '.join(f'avg({c}) AS {c}' for c in METRICS)}, count(*) AS n_users FROM u GROUP BY method"""


@query("ablation_metrics", "R10 J14", _ablation_sql(), rnd=" ".join(METRICS))
def _(v):
    """Every scoring variant against the visits after the split."""
    return rec.ablate(tagged(v), popular(v), evl.split_pairs(*train_test(v))[1])


# ---------------------------------------------------------------- serving

view(
    "serving",
    """SELECT b.business_id, b.city, b.name, b.stars, b.review_count, b.latitude, b.longitude, round(r.score * 100, 9) AS birank_score, m.rating_mean, l.popularity_visits, l.unique_users, l.repeat_user_rate AS revisit_rate
 FROM businesses b LEFT JOIN ranked_venues r ON b.business_id = r.business_id LEFT JOIN rating_base m ON b.business_id = m.business_id LEFT JOIN venue_loyalty l ON b.business_id = l.business_id""",
)


def serving(v):
    scores = behavioural(v).venues.select("business_id", F.round(F.col("score") * 100, 9).alias("birank_score"))
    loyal = ft.venue_loyalty(v.interactions).select("business_id", "popularity_visits", "unique_users", F.col("repeat_user_rate").alias("revisit_rate"))
    base = v.businesses.select("business_id", "city", "name", "stars", "review_count", "latitude", "longitude")
    return rec.serving_table(base, scores, bl.rating(v.interactions).select("business_id", "rating_mean"), loyal)


@query("serving_table", "R12 P9 J2", "SELECT * FROM serving", rnd="birank_score rating_mean revisit_rate latitude longitude", digits=5)
def _(v):
    return serving(v)


def _mm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () - min({c}) OVER () > 1e-12 THEN ({c} - min({c}) OVER ()) / CAST(max({c}) OVER () - min({c}) OVER () AS DOUBLE) ELSE 0.0 END"


view(
    "composite",
    "SELECT business_id, round(" + " + ".join(f"{w} * ({_mm(c)})" for w, c in zip((0.35, 0.20, 0.0, 0.45), rec.MODE_COLUMNS)) + ", 9) AS score FROM serving",
)


@query("composite_scores", "R8", "SELECT * FROM composite", rnd="score")
def _(v):
    return rec.composite_score(serving(v), "Regular / routine visits").select("business_id", F.round("score", 9).alias("score"))


@query(
    "ranking_modes", "R9",
    """SELECT 'rating' AS mode, business_id, coalesce(rating_mean, 0.0) AS score FROM serving UNION ALL SELECT 'popularity', business_id, CAST(popularity_visits AS DOUBLE) FROM serving
UNION ALL SELECT 'revisit', business_id, revisit_rate FROM serving UNION ALL SELECT 'graph', s.business_id, coalesce(g.score, s.birank_score, 0.0) FROM serving s LEFT JOIN (SELECT business_id, max(score) AS score FROM segment_scores WHERE segment = 'Loyalists' GROUP BY 1) g ON s.business_id = g.business_id""",
    rnd="score",
)
def _(v):
    from footfall.catalog.ranking import segment_edges
    from footfall.operators import graph as gr

    table = serving(v)
    segment = gr.degree_score(segment_edges(v), ["segment"]).where("segment = 'Loyalists'")
    out = None
    for mode in ("rating", "popularity", "revisit", "graph"):
        part = rec.rank_mode(table, mode, segment if mode == "graph" else None).select(F.lit(mode).alias("mode"), "business_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


view(
    "requests",
    "SELECT c_custkey AS request_id, n_name AS city, 39.9 + (c_custkey % 100) * 0.001::DOUBLE AS ref_lat, -75.2 + (c_custkey % 89) * 0.001::DOUBLE AS ref_lon, 1.0 + c_custkey % 5 AS radius_km, 3 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey",
)


def requests(v):
    c = v.raw("customer").join(F.broadcast(v.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("request_id"), F.col("n_name").alias("city"),
        (F.lit(39.9) + F.col("c_custkey") % 100 * F.lit(0.001)).alias("ref_lat"), (F.lit(-75.2) + F.col("c_custkey") % 89 * F.lit(0.001)).alias("ref_lon"),
        (1.0 + F.col("c_custkey") % 5).alias("radius_km"), F.lit(3).alias("k"),
    )


@query(
    "serve_requests", "T9 F1",
    f"""WITH m AS (SELECT r.*, v.business_id, v.stars AS score, {hav('r.ref_lat', 'r.ref_lon', 'v.latitude', 'v.longitude', '6371.0')} AS distance_km FROM requests r JOIN businesses v ON r.city = v.city),
n AS (SELECT *, distance_km <= radius_km AS near, bool_or(distance_km <= radius_km) OVER (PARTITION BY request_id) AS found FROM m),
p AS (SELECT request_id, business_id, distance_km, score, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN found THEN -score ELSE distance_km END, business_id) AS place, NOT found AS fallback FROM n WHERE near OR NOT found)
SELECT * FROM p WHERE place <= 3""", rnd="distance_km score", digits=4,
)
def _(v):
    """Three best-rated venues near each customer's reference point, or the nearest of the city."""
    return rec.serve(v.businesses.withColumn("score", F.col("stars")), requests(v))


@query(
    "archetype_city_top", "T10",
    """WITH r AS (SELECT request_id, city, CASE request_id % 3 WHEN 0 THEN 'Loyalist' WHEN 1 THEN 'Casual Weekender' ELSE 'Unheard Of' END AS archetype FROM requests),
m AS (SELECT r.request_id, s.business_id, CASE archetype WHEN 'Loyalist' THEN s.revisit_rate WHEN 'Casual Weekender' THEN s.unique_users ELSE s.stars END AS signal FROM r JOIN
 (SELECT b.business_id, b.city, b.stars, round(l.repeat_user_rate, 9) AS revisit_rate, l.unique_users FROM businesses b LEFT JOIN venue_loyalty l ON b.business_id = l.business_id) s ON r.city = s.city)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY signal DESC, business_id) AS place FROM m) WHERE place <= 3""", rnd="signal",
)
def _(v):
    loyal = ft.venue_loyalty(v.interactions).select("business_id", F.round("repeat_user_rate", 9).alias("revisit_rate"), "unique_users")
    venues = v.businesses.select("business_id", "city", "stars").join(loyal, "business_id", "left")
    kind = F.element_at(F.array(F.lit("Loyalist"), F.lit("Casual Weekender"), F.lit("Unheard Of")), (F.col("request_id") % 3 + 1).cast("int"))
    return rec.city_top(venues, requests(v).select("request_id", "city", kind.alias("archetype")))


@query(
    "city_top_categories", "A49 W4",
    "SELECT * FROM (SELECT city, coalesce(categories, 'none') AS categories, count(*) AS n, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, coalesce(categories, 'none')) AS place FROM businesses GROUP BY 1, 2) WHERE place <= 2",
)
def _(v):
    return rec.top_labels(v.businesses.withColumn("categories", F.coalesce("categories", F.lit("none"))), "categories", 2)


# ---------------------------------------------------------------- samples and candidate sets


def md5_sql(key: str, seed: str = "42") -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


@query("uniform_sample", "T4", f"SELECT c_custkey, c_name FROM customer ORDER BY {md5_sql('c_custkey')}, c_custkey LIMIT 50")
def _(v):
    return rec.sample_hash(v.raw("customer").select("c_custkey", "c_name"), 50, "c_custkey")


@query(
    "stratified_sample", "T5",
    f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {md5_sql('o_orderkey')}, o_orderkey) AS i FROM orders) WHERE i <= 20",
)
def _(v):
    return rec.sample_hash(v.raw("orders").select("o_orderkey", "o_orderpriority"), 20, "o_orderkey", by=["o_orderpriority"])


view(
    "city_items",
    """SELECT state AS city, business_id, CAST(row_number() OVER (PARTITION BY state ORDER BY review_count DESC, business_id) AS INT) AS model_rank, CAST(row_number() OVER (PARTITION BY state ORDER BY stars DESC, business_id) AS INT) AS stars_rank, stars FROM businesses""",
)


def city_items(v):
    def place(c):
        return F.row_number().over(Window.partitionBy("state").orderBy(F.col(c).desc(), F.col("business_id")))

    return v.businesses.select(F.col("state").alias("city"), "business_id", place("review_count").alias("model_rank"), place("stars").alias("stars_rank"), "stars")


SHOW = f"CAST(row_number() OVER (PARTITION BY city ORDER BY {md5_sql('business_id', '42-show')}, business_id) AS INT) AS display_rank"


@query(
    "discriminating_sets", "T6",
    f"""WITH x AS (SELECT city, business_id, CASE WHEN model_rank <= 5 AND stars_rank <= 5 THEN NULL WHEN model_rank <= 5 THEN 'model' WHEN stars_rank <= 5 THEN 'stars' ELSE 'fill' END AS side FROM city_items),
p AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY CASE WHEN side = 'fill' THEN 1 ELSE 0 END, {md5_sql('business_id')}, business_id) AS i FROM x WHERE side IS NOT NULL)
SELECT city, business_id, side, {SHOW} FROM p WHERE i <= 10""",
)
def _(v):
    return rec.discriminating_set(city_items(v), ["city"])


@query(
    "contrast_sets", "T7",
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY stars DESC, business_id) AS a, row_number() OVER (PARTITION BY city ORDER BY stars, business_id) AS b FROM city_items)
SELECT city, business_id, stars AS signal, {SHOW} FROM h WHERE a <= 5 OR b <= 5""", rnd="signal",
)
def _(v):
    return rec.contrast_set(city_items(v), ["city"], "stars")


@query(
    "decoy_sets", "T8",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY city, model_rank > 5 ORDER BY {md5_sql('business_id')}, business_id) AS i FROM city_items)
SELECT city, business_id, {SHOW} FROM r WHERE model_rank <= 5 OR i <= 5""",
)
def _(v):
    return rec.decoy_set(city_items(v), ["city"])
