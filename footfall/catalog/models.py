"""Collaborative filtering, blends and learnt segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.catalog.behaviour import as_of
from footfall.catalog.ranking import METRICS, ideal_case, method_scores, train_test
from footfall.catalog.registry import query, view
from footfall.operators import cf
from footfall.operators import evaluate as evl
from footfall.operators import events as ev
from footfall.operators import features as ft
from footfall.operators import segments as sg

view("train_edges", "SELECT user_id, business_id, CAST(count(*) AS DOUBLE) AS weight FROM train WHERE user_id IS NOT NULL GROUP BY 1, 2")
view(
    "cosines",
    """WITH u AS (SELECT user_id, business_id, weight / sqrt(sum(weight * weight) OVER (PARTITION BY business_id)) AS w FROM train_edges)
 SELECT a.business_id AS i, b.business_id AS j, sum(a.w * b.w) AS similarity FROM u a JOIN u b ON a.user_id = b.user_id AND a.business_id <> b.business_id GROUP BY 1, 2""",
)
view(
    "knn_personal",
    """SELECT c.user_id, c.business_id, sum(CASE WHEN e.business_id = c.business_id THEN 1.0 ELSE coalesce(s.similarity, 0.0) END) AS score
 FROM train_pairs c JOIN train_edges e ON c.user_id = e.user_id LEFT JOIN cosines s ON s.i = e.business_id AND s.j = c.business_id GROUP BY 1, 2""",
)


def train_edges(v):
    return ev.edges(train_test(v)[0])


@query(
    "item_knn", "V6",
    """SELECT business_id, coalesce(s, 0.0) / LEAST(30, (SELECT count(DISTINCT business_id) FROM train_edges)) AS score FROM (SELECT DISTINCT business_id FROM train_edges) v LEFT JOIN
 (SELECT i, sum(similarity) AS s FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j) AS r FROM cosines) WHERE r <= 30 GROUP BY i) k ON v.business_id = k.i""",
    rnd="score",
)
def _(v):
    return cf.item_knn(train_edges(v))


@query("item_knn_personal", "V7", "SELECT * FROM knn_personal", rnd="score")
def _(v):
    train, test = train_test(v)
    return cf.item_knn_personal(ev.edges(train), evl.split_pairs(train, test)[0])


view(
    "global_blend",
    """SELECT business_id, 0.7 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.3 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS score FROM
 (SELECT business_id, max(CASE WHEN method = 'iuf' THEN score END) AS a, max(CASE WHEN method = 'random' THEN score END) AS b FROM method_scores WHERE method IN ('iuf', 'random') GROUP BY 1)""",
)


@query("global_blend", "M5", "SELECT * FROM global_blend", rnd="score")
def _(v):
    s = method_scores(train_test(v)[0])
    return cf.blend(s.where("method = 'iuf'"), s.where("method = 'random'"), 0.7)


view(
    "blend_parts",
    """SELECT k.user_id, k.business_id, (s.score - x.lo) / (x.hi - x.lo) AS g,
 CASE WHEN max(k.score) OVER w - min(k.score) OVER w > 1e-12 THEN (k.score - min(k.score) OVER w) / (max(k.score) OVER w - min(k.score) OVER w) ELSE 0.0 END AS m
 FROM knn_personal k JOIN method_scores s ON s.method = 'iuf' AND s.business_id = k.business_id CROSS JOIN (SELECT min(score) AS lo, max(score) AS hi FROM method_scores WHERE method = 'iuf') x
 WINDOW w AS (PARTITION BY k.user_id)""",
)


def parts(v):
    train, test = train_test(v)
    tr, te = evl.split_pairs(train, test)
    personal = cf.item_knn_personal(ev.edges(train), tr)
    return cf.blend_parts(method_scores(train).where("method = 'iuf'"), personal, tr), tr, te


@query("personal_blend", "M6", "SELECT user_id, business_id, 0.7 * g + 0.3 * m AS score FROM blend_parts", rnd="score")
def _(v):
    p, _, _ = parts(v)
    return p.select("user_id", "business_id", (0.7 * F.col("g") + 0.3 * F.col("m")).alias("score"))


@query(
    "top_blend", "M7",
    """WITH p AS (SELECT *, (score - min(score) OVER w) / CASE WHEN max(score) OVER w - min(score) OVER w > 1e-12 THEN max(score) OVER w - min(score) OVER w ELSE 1.0 END AS p,
 row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, business_id) AS r FROM knn_personal WINDOW w AS (PARTITION BY user_id))
SELECT p.user_id, p.business_id, 0.5 * p.p + 0.5 * (s.score - x.lo) / (x.hi - x.lo) AS score FROM p JOIN method_scores s ON s.method = 'iuf' AND s.business_id = p.business_id
 CROSS JOIN (SELECT min(score) AS lo, max(score) AS hi FROM method_scores WHERE method = 'iuf') x WHERE r <= 5""", rnd="score", digits=5,
)
def _(v):
    train, test = train_test(v)
    personal = cf.item_knn_personal(ev.edges(train), evl.split_pairs(train, test)[0]).withColumn("score", F.round("score", 9))
    return cf.blend_top(personal, method_scores(train).where("method = 'iuf'"), 5)


LAMS = [round(0.1 * i, 1) for i in range(11)]


def _tune_sql() -> str:
    cols = []
    for k in evl.KS:
        found = f"sum(CASE WHEN position <= {k} THEN rel ELSE 0 END)"
        dcg = f"sum(CASE WHEN position <= {k} THEN rel / log2(position + 1) ELSE 0.0 END)"
        cols += [f"coalesce({dcg} / nullif({ideal_case('max(n_relevant)', k)}, 0), 0.0) AS ndcg_{k}", f"CASE WHEN {found} > 0 THEN 1.0 ELSE 0.0 END AS hit_{k}"]
    return f"""WITH g AS (SELECT l.lam, p.user_id, p.business_id, round(l.lam * g + (1 - l.lam) * m, 9) AS score FROM blend_parts p, (SELECT CAST(unnest([{', '.join(map(str, LAMS))}]) AS DOUBLE) AS lam) l),
r AS (SELECT g.lam, g.user_id, row_number() OVER (PARTITION BY g.lam, g.user_id ORDER BY score DESC, g.business_id) AS position, CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS rel,
 count(*) OVER (PARTITION BY g.lam, g.user_id) AS n, sum(CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY g.lam, g.user_id) AS n_relevant
 FROM g LEFT JOIN test_pairs t ON g.user_id = t.user_id AND g.business_id = t.business_id),
u AS (SELECT lam, user_id, {', '.join(cols)} FROM r WHERE n >= 2 GROUP BY 1, 2),
m AS (SELECT lam, {', '.join(f'avg({c}) AS {c}' for c in METRICS)}, count(*) AS n_users FROM u GROUP BY lam)
SELECT *, lam = (SELECT lam FROM m ORDER BY round(ndcg_10, 9) DESC, lam LIMIT 1) AS is_best FROM m"""


@query("blend_weight_grid", "M8", _tune_sql(), rnd=" ".join(METRICS))
def _(v):
    p, tr, te = parts(v)
    return cf.tune_blend(p, tr, te, LAMS)


@query("als_scores", "M1 M3")
def _(v):
    """Venue scores of the average user in an implicit factor model."""
    uf, vf = cf.als_factors(train_edges(v), rank=16, iterations=5)
    return cf.global_scores(uf, vf, 16)


@query("bpr_scores", "M2 M3")
def _(v):
    uf, vf = cf.bpr_factors(train_edges(v), rank=8, epochs=3)
    return cf.global_scores(uf, vf, 8)


# ---------------------------------------------------------------- segments

FEATURES = ["total_visits", "unique_venues", "revisit_ratio", "active_span_days", "venue_entropy"]


def _summary_sql() -> str:
    stats = ", ".join(
        f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max, quantile_cont({c}, 0.25) AS {c}_p25, median({c}) AS {c}_p50, quantile_cont({c}, 0.75) AS {c}_p75"
        for c in FEATURES
    )
    return f"""SELECT g.segment, count(*) AS "rows", {stats}, count(*) / CAST((SELECT count(*) FROM user_features) AS DOUBLE) AS share FROM user_features f JOIN user_groups g ON f.user_id = g.user_id GROUP BY g.segment"""


_STATS = " ".join(f"{c}_{s}" for c in FEATURES for s in ("mean", "std", "p25", "p50", "p75"))


@query("segment_summary", "A33 A36", _summary_sql(), rnd=_STATS + " share revisit_ratio_min revisit_ratio_max active_span_days_min active_span_days_max venue_entropy_min venue_entropy_max")
def _(v):
    f = ft.user_features(v.interactions)
    return sg.segment_summary(f.join(sg.assign_user_groups(f), "user_id"), FEATURES)


@query(
    "segment_patterns", "A34",
    """SELECT g.segment, sum(c.visits) / CAST(sum(c.venues) AS DOUBLE) AS avg_visits_per_venue, avg(c.venues) AS avg_venues_per_user, avg(k.ss * 86400) AS temporal_regularity,
 count(*) AS total_users, CAST(sum(c.visits) AS BIGINT) AS total_interactions FROM (SELECT user_id, count(*) AS venues, sum(n) AS visits FROM pairs GROUP BY 1) c
 JOIN user_groups g ON c.user_id = g.user_id LEFT JOIN user_gaps k ON c.user_id = k.user_id GROUP BY g.segment""",
    rnd="avg_visits_per_venue avg_venues_per_user temporal_regularity", digits=3,
)
def _(v):
    return sg.segment_patterns(v.interactions, sg.assign_user_groups(ft.user_features(v.interactions)))


@query(
    "dominant_segments", "A35",
    """WITH c AS (SELECT p.business_id, g.segment, sum(p.n) AS n FROM pairs p LEFT JOIN train_groups g ON p.user_id = g.user_id GROUP BY 1, 2),
t AS (SELECT business_id, CAST(sum(n) AS BIGINT) AS total_interactions FROM c GROUP BY 1 HAVING sum(n) >= 10),
d AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY n DESC, segment) AS i FROM c WHERE segment IS NOT NULL)
SELECT t.business_id, d.segment AS dominant_segment, coalesce(d.n / CAST(t.total_interactions AS DOUBLE), 0.0) AS dominant_share, t.total_interactions FROM t LEFT JOIN d ON t.business_id = d.business_id AND d.i = 1""",
    rnd="dominant_share",
)
def _(v):
    from footfall.catalog.ranking import train_groups

    return sg.dominant_segment(v.interactions, train_groups(v))


@query(
    "venue_kinds", "A35",
    "SELECT business_id, repeat_user_rate, CASE WHEN repeat_user_rate > 0.3 THEN 'repeat' WHEN repeat_user_rate < 0.1 THEN 'exploratory' END AS kind FROM venue_loyalty", rnd="repeat_user_rate",
)
def _(v):
    return sg.venue_kinds(ft.venue_loyalty(v.interactions), "repeat_user_rate").select("business_id", "repeat_user_rate", "kind")


COFFEE = ["total_visits", "unique_venues", "revisit_ratio", "avg_time_gap_days", "time_of_day_mode", "weekday_ratio"]


@query("user_clusters", "M9 M10 P7")
def _(v):
    """Users in four clusters of complete behaviour rows, with a described name."""
    users = ft.user_basics(v.interactions).dropna(subset=COFFEE)
    out, _ = sg.cluster(users, COFFEE, 4, restarts=2)
    return sg.name_coffee_clusters(out).select("user_id", "cluster", "segment")


@query("cluster_elbow", "M9")
def _(v):
    return sg.elbow(ft.user_basics(v.interactions).dropna(subset=COFFEE), COFFEE, range(2, 6))


@query("hotel_guest_clusters", "M9 M10 M12 P11")
def _(v):
    """Hotel guests: missing values by the median, counts cut at the 99 % quantile, four named clusters."""
    from footfall.operators.clean import winsorize
    from footfall.session import settle

    cols = ["total_hotel_reviews", "n_unique_hotels", "weekday_fraction", "hotel_frequency", "n_states_visited", "n_cities_visited", "hotel_city_diversity"]
    # Medians, quantiles and scales each read the users: their features are made once.
    users = sg.impute_median(settle(ft.hotel_user_features(v.reviews, v.businesses).select("user_id", *cols)), cols)
    out, _ = sg.cluster(winsorize(users, cols), cols, 4, restarts=2)
    return sg.name_hotel_clusters(out).select("user_id", "cluster", "segment")


@query("user_components", "M11")
def _(v):
    return sg.pca(ft.user_basics(v.interactions).dropna(subset=COFFEE).select("user_id", *COFFEE), COFFEE)[0].select("user_id", "pc1", "pc2")


@query("cross_domain_accuracy", "M13")
def _(v):
    """How well behaviour in one domain tells the user's market segment, against chance."""
    data = ft.user_features(v.interactions).join(
        v.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")), "user_id"
    )
    return sg.cross_validated_accuracy(data, ["total_visits", "revisit_ratio", "venue_entropy"], "segment", "user_id")


@query("transfer_priors", "M14 J5 P28")
def _(v):
    """Weights of hotel users by segment, and of users known only before by the predicted segment."""
    train, test = train_test(v)
    known = ft.user_features(test)
    known = known.join(sg.assign_user_groups(known), "user_id")
    return sg.transfer_priors(known, ft.user_features(train), ["revisit_ratio", "venue_entropy"], {"Loyalists": 1.5, "Weekday Regulars": 1.1})
