"""Linkage between platforms, text similarity, social signals and social priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.catalog.cleaning import hav
from footfall.catalog.ranking import behavioural, train_test, unrolled
from footfall.catalog.registry import query, view
from footfall.operators import events as ev
from footfall.operators import features as ft
from footfall.operators import graph as gr
from footfall.operators import linkage as lk
from footfall.operators import recommend as rec
from footfall.operators import text as tx
from footfall.session import settle


@query("undirected_friends", "U3", "SELECT * FROM social_edges")
def _(v):
    return lk.undirected(v.friendships)


@query("friend_endpoints", "U2", "SELECT user_a AS user_id FROM social_edges UNION SELECT user_b FROM social_edges")
def _(v):
    return lk.endpoints(lk.undirected(v.friendships))


# Linked users: customers with a positive balance, confidence by its size.
view("bridge", "SELECT c_custkey AS user_id, c_custkey + 1000000 AS b_user_id, LEAST(1.0, c_acctbal / 10000.0) AS confidence FROM customer WHERE c_acctbal > 0")
view("b_ways", "SELECT u + 1000000 AS u, w + 1000000 AS w FROM both_ways")
view("b_direct", "SELECT u, w FROM b_ways WHERE u IN (SELECT b_user_id FROM bridge)")
view("b_touching", "SELECT u, w FROM b_direct UNION SELECT w, u FROM b_direct")
view("b_far", "SELECT DISTINCT d.u, t.w FROM b_direct d JOIN b_touching t ON d.w = t.u WHERE d.u <> t.w AND NOT EXISTS (SELECT 1 FROM b_direct x WHERE x.u = d.u AND x.w = t.w)")


def bridge(v):
    c = v.raw("customer").where(F.col("c_acctbal") > 0)
    return c.select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") + 1_000_000).alias("b_user_id"),
        F.least(F.lit(1.0), F.col("c_acctbal") / 10000.0).alias("confidence"),
    )


def b_edges(v):
    e = lk.undirected(v.friendships)
    return e.select((F.col("user_a") + 1_000_000).alias("user_a"), (F.col("user_b") + 1_000_000).alias("user_b"))


@query("linked_user_friends", "J15", "SELECT u, w FROM b_direct")
def _(v):
    return lk.neighbors(b_edges(v), bridge(v), "b_user_id")


@query("friends_of_friends", "J16 U5", "SELECT u, w FROM b_far")
def _(v):
    return lk.friends_of_friends(b_edges(v), bridge(v), "b_user_id")


@query(
    "friends_of_friends_whole_graph", "J16",
    """SELECT DISTINCT d.u, t.w FROM b_direct d JOIN b_ways t ON d.w = t.u WHERE d.u <> t.w AND NOT EXISTS (SELECT 1 FROM b_direct x WHERE x.u = d.u AND x.w = t.w)""",
)
def _(v):
    return lk.friends_of_friends(b_edges(v), bridge(v), "b_user_id", scope="full")


@query("friend_counts", "A44", "SELECT u AS b_user_id, count(*) AS friend_count FROM b_direct GROUP BY u")
def _(v):
    return lk.friend_counts(b_edges(v), bridge(v), "b_user_id")


@query(
    "friend_visits", "J17",
    "SELECT e.u AS user_id, p.business_id, count(*) AS friend_visits FROM both_ways e JOIN pairs p ON e.w = p.user_id GROUP BY 1, 2",
)
def _(v):
    return lk.friend_visits(lk.undirected(v.friendships), v.interactions)


view("b_visits", "SELECT b_user_id AS w, business_id, count(*) AS n FROM checkins_b GROUP BY 1, 2")
view(
    "social_signals",
    """SELECT coalesce(a.business_id, f.business_id) AS business_id, coalesce(a.c, 0.0) AS friend_checkin_count, coalesce(f.c, 0.0) AS fof_checkin_count,
 coalesce(a.k, 0) AS social_unique_visitors, ln(1 + coalesce(a.k, 0)) AS social_diversity_index, coalesce(a.m, 0.0) AS mean_bridge_confidence
 FROM (SELECT business_id, sum(n * confidence) AS c, count(DISTINCT d.w) AS k, avg(confidence) AS m FROM b_direct d JOIN bridge b ON d.u = b.b_user_id JOIN b_visits x ON d.w = x.w GROUP BY 1) a
 FULL JOIN (SELECT business_id, 0.3 * sum(n * confidence) AS c FROM b_far d JOIN bridge b ON d.u = b.b_user_id JOIN b_visits x ON d.w = x.w GROUP BY 1) f ON a.business_id = f.business_id""",
)


def signals(v):
    return lk.social_venue_signals(bridge(v), b_edges(v), v.checkins_b)


@query(
    "social_venue_signals", "A43", "SELECT * FROM social_signals",
    rnd="friend_checkin_count fof_checkin_count social_diversity_index mean_bridge_confidence", digits=5,
)
def _(v):
    return signals(v)


def base_priors(v):
    e = ev.edges(v.interactions)
    return gr.behavioural_priors(e, ft.user_features(v.interactions), ft.venue_features(v.interactions))


BOOST = "SELECT business_id, {raw} / max({raw}) OVER () * mean_bridge_confidence AS boost FROM social_signals"
FRIEND = "ln(1 + friend_checkin_count)"
FOF = "0.3 * ln(1 + fof_checkin_count)"
view(
    "social_priors",
    "SELECT p.business_id, "
    + ", ".join(
        f"GREATEST(0.8 * p.prior + 0.2 * coalesce({t}.boost, 0.0), 1e-10) AS {n}"
        for t, n in (("a", "friend"), ("b", "friend_and_fof"), ("c", "fof"), ("d", "volume"))
    )
    + ", GREATEST((GREATEST(0.8 * p.prior + 0.2 * coalesce(b.boost, 0.0), 1e-10) + GREATEST(0.8 * p.prior + 0.2 * coalesce(d.boost, 0.0), 1e-10)) / 2, 1e-10) AS whole"
    + f""" FROM venue_prior p LEFT JOIN ({BOOST.format(raw=FRIEND)}) a ON p.business_id = a.business_id LEFT JOIN ({BOOST.format(raw=f'({FRIEND} + {FOF})')}) b ON p.business_id = b.business_id
 LEFT JOIN ({BOOST.format(raw=f'({FOF})')}) c ON p.business_id = c.business_id
 LEFT JOIN (SELECT business_id, ln(1 + n) / max(ln(1 + n)) OVER () AS boost FROM (SELECT business_id, count(*) AS n FROM checkins_b GROUP BY 1)) d ON p.business_id = d.business_id""",
)


@query("social_priors", "G6 G8", "SELECT * FROM social_priors", rnd="friend friend_and_fof fof volume whole")
def _(v):
    # One row per venue each; five variants read them.
    base, sig = settle(base_priors(v)[1]), settle(signals(v))
    out = None
    for name, df in (
        ("friend", gr.social_prior(base, sig, 0.2, "friend")), ("friend_and_fof", gr.social_prior(base, sig, 0.2, "both")),
        ("fof", gr.social_prior(base, sig, 0.2, "fof")), ("volume", gr.volume_prior(base, v.checkins_b, 0.2)),
        ("whole", gr.full_prior(base, sig, v.checkins_b, 0.2)),
    ):
        named = df.withColumnRenamed("prior", name)
        out = named if out is None else out.join(named, "business_id")
    return out


@query(
    "selective_social_prior", "G7",
    f"""WITH s AS (SELECT business_id, {FRIEND} / max({FRIEND}) OVER () * mean_bridge_confidence AS boost FROM social_signals WHERE mean_bridge_confidence >= 0.45)
SELECT p.business_id, GREATEST(CASE WHEN s.boost IS NULL THEN p.prior ELSE 0.85 * p.prior + 0.15 * s.boost END, 1e-10) AS prior FROM venue_prior p LEFT JOIN s ON p.business_id = s.business_id""",
    rnd="prior",
)
def _(v):
    return gr.selective_social_prior(base_priors(v)[1], signals(v), min_confidence=0.45)


@query(
    "centrality_prior", "G9",
    """SELECT p.user_id, GREATEST(p.prior * (1 + LEAST(1.0, ln(1 + coalesce(f.c, 0)) / ln(501))), 1e-10) AS prior FROM user_prior p
 LEFT JOIN (SELECT u - 1000000 AS user_id, count(*) AS c FROM b_direct GROUP BY 1) f ON p.user_id = f.user_id""", rnd="prior",
)
def _(v):
    counts = lk.friend_counts(b_edges(v), bridge(v), "b_user_id").withColumn("user_id", F.col("b_user_id") - 1_000_000)
    return gr.centrality_prior(base_priors(v)[0], counts)


@query(
    "cross_domain_prior", "G10",
    """SELECT user_id, prior * CASE WHEN c_acctbal > 5000 THEN 1.5 ELSE 1.0 END AS prior FROM hotel_user_prior LEFT JOIN customer ON user_id = c_custkey""", rnd="prior",
)
def _(v):
    from footfall.catalog.behaviour import as_of

    weights = v.raw("customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("user_id"), F.lit(1.5).alias("weight"))
    users = ft.hotel_user_features(v.reviews, v.businesses)
    return gr.hotel_priors(users, ft.hotel_venue_features(v.reviews, v.businesses, as_of()), cross_domain=weights)[0]


GAMMAS = (0.0, 0.1, 0.2, 0.3)
for _g in GAMMAS:
    view(
        f"gamma_prior_{int(_g * 10)}",
        f"SELECT p.business_id, GREATEST({1 - _g} * p.prior + {_g} * coalesce(a.boost, 0.0), 1e-10) AS prior FROM venue_prior p LEFT JOIN ({BOOST.format(raw=FRIEND)}) a ON p.business_id = a.business_id",
    )


@query(
    "social_weight_grid", "G6 G12",
    " UNION ALL ".join(
        f"SELECT CAST({g} AS DOUBLE) AS gamma, business_id, 100 * score AS score FROM ({unrolled('edges', 'user_prior', f'gamma_prior_{int(g * 10)}', 2, 'venue')})" for g in GAMMAS
    ),
    rnd="score",
)
def _(v):
    """Two ranking steps for four weights of the social prior, in one job."""
    p0, base = base_priors(v)
    # One row per venue each; four weights read them.
    base, sig = settle(base), settle(signals(v))
    grid = None
    for i, g in enumerate(GAMMAS):
        cell = gr.social_prior(base, sig, g, "friend").withColumn("cell", F.lit(i))
        grid = cell if grid is None else grid.unionByName(cell)
    out = gr.birank(ev.edges(v.interactions), p0, grid, max_iter=2, tol=None, cells=[(0.85, 0.85)] * len(GAMMAS)).venues
    gamma = F.element_at(F.array(*[F.lit(g) for g in GAMMAS]), F.col("cell") + 1)
    return out.select(gamma.alias("gamma"), "business_id", (100 * F.col("score")).alias("score"))


# ---------------------------------------------------------------- text

WORDS = "regexp_extract_all(lower(text), '[a-zA-Z&]+')"
view("doc_terms", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY 1, 2")


def weights_sql(counts: str, key: str, n: str, min_df: int) -> str:
    return f"""SELECT {key}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {key})) AS weight FROM (SELECT c.{key}, c.term, c.tf, k.idf FROM {counts} c JOIN
 (SELECT term, ln((1.0 + {n}) / (1 + count(*))) + 1 AS idf FROM {counts} GROUP BY term HAVING count(*) >= {min_df}) k ON c.term = k.term)"""


@query("document_tfidf", "V1", weights_sql("doc_terms", "doc_id", "(SELECT count(*) FROM documents)", 2), rnd="weight")
def _(v):
    return tx.tfidf(v.raw("documents").select("doc_id", "text"), "doc_id", "text")


GRAMS = """SELECT p_partkey, substr(w, CAST(i AS INT), CAST(n AS INT)) AS term FROM (SELECT p_partkey, ' ' || unnest(string_split(lower(p_name), ' ')) || ' ' AS w FROM part),
 (VALUES (2), (3), (4)) t(n), range(1, 200) r(i) WHERE i + n - 1 <= length(w)"""
view("name_grams", f"SELECT p_partkey, term, count(*) AS tf FROM ({GRAMS}) GROUP BY 1, 2")


@query("name_ngram_tfidf", "V2", weights_sql("name_grams", "p_partkey", "(SELECT count(*) FROM part)", 1), rnd="weight")
def _(v):
    return tx.tfidf(v.raw("part").select("p_partkey", "p_name"), "p_partkey", "p_name", "char", min_df=1, max_features=None)


view("cat_counts_a", "SELECT 'a' || business_id AS doc, term, count(*) AS tf FROM (SELECT business_id, unnest(regexp_extract_all(lower(coalesce(categories, '')), '[a-zA-Z&]+')) AS term FROM businesses) GROUP BY 1, 2")
view("cat_counts_b", "SELECT 'b' || category AS doc, term, count(*) AS tf FROM (SELECT category, unnest(regexp_extract_all(lower(category), '[a-zA-Z&]+')) AS term FROM (SELECT DISTINCT category FROM pois)) GROUP BY 1, 2")
view("cat_counts", "SELECT * FROM cat_counts_a UNION ALL SELECT * FROM cat_counts_b")
view("cat_weights", weights_sql("cat_counts", "doc", "(SELECT (SELECT count(*) FROM businesses) + (SELECT count(DISTINCT category) FROM pois))", 2))
view(
    "near_sims",
    """SELECT n.business_id, n.poi_id, n.dist_m, coalesce(s.sim, 0.0) AS category_sim FROM near_75 n LEFT JOIN (SELECT n.business_id, n.poi_id, sum(a.weight * b.weight) AS sim FROM near_75 n JOIN pois p ON n.poi_id = p.poi_id
 JOIN cat_weights a ON a.doc = 'a' || n.business_id JOIN cat_weights b ON b.doc = 'b' || p.category AND a.term = b.term GROUP BY 1, 2) s ON n.business_id = s.business_id AND n.poi_id = s.poi_id""",
)


def sides(v):
    a = v.businesses.select("business_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("categories").alias("text"))
    return a, v.pois.select("poi_id", "lat", "lon", F.col("category").alias("text"))


@query(
    "category_similarity", "V3 J8",
    "SELECT business_id, poi_id, category_sim FROM near_sims", rnd="category_sim",
)
def _(v):
    from footfall.operators.geo import radius_join
    from footfall.operators.scale import scalar

    a, b = sides(v)
    a = a.withColumn("text", F.coalesce("text", F.lit("")))
    pairs = radius_join(a.select("business_id", "lat", "lon"), b.select("poi_id", "lat", "lon", "text"), 75.0).select("business_id", "poi_id", "text")
    kinds = b.select("text").distinct()
    ca, cb = tx.term_counts(a, "business_id", "text"), tx.term_counts(kinds, "text", "text")
    both = ca.select(F.concat(F.lit("a"), F.col("business_id").cast("string")).alias("doc"), "term", "tf").unionByName(
        cb.select(F.concat(F.lit("b"), F.col("text")).alias("doc"), "term", "tf")
    )
    n = scalar(a.agg(F.count(F.lit(1)).alias("n"))) + scalar(kinds.agg(F.count(F.lit(1)).alias("n")))
    idf = tx.fit_idf(both, n)
    out = tx.cosine_pairs(pairs, tx.transform_tfidf(ca, idf, "business_id"), tx.transform_tfidf(cb, idf, "text"), "business_id", "text", "category_sim")
    return out.select("business_id", "poi_id", "category_sim")


view(
    "venue_linkage",
    """WITH s AS (SELECT *, round(0.6 * exp(-dist_m / 30.0) + 0.4 * category_sim, 9) AS confidence FROM near_sims),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY confidence DESC, poi_id) AS i FROM s) WHERE i = 1 AND confidence >= 0.3 AND category_sim >= 0.1),
 c AS (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY confidence DESC, business_id) AS j FROM b)
 SELECT business_id, poi_id, dist_m, category_sim, confidence FROM c WHERE j = 1""",
)


@query("venue_linkage", "V4 W5 F8", "SELECT * FROM venue_linkage", rnd="dist_m category_sim confidence", digits=4)
def _(v):
    return lk.link_venues(*sides(v), min_confidence=0.3)


@query(
    "linked_checkins", "J7",
    """SELECT c.b_user_id, c.poi_id, l.business_id, utc_ts + INTERVAL '1' MINUTE * tz_offset_min AS local_ts, CAST(hour(utc_ts + INTERVAL '1' MINUTE * tz_offset_min) AS INT) AS hour,
 CAST(isodow(utc_ts + INTERVAL '1' MINUTE * tz_offset_min) - 1 AS INT) AS weekday, isodow(utc_ts + INTERVAL '1' MINUTE * tz_offset_min) >= 6 AS is_weekend FROM checkins_b c JOIN venue_linkage l ON c.poi_id = l.poi_id""",
)
def _(v):
    links = lk.link_venues(*sides(v), min_confidence=0.3)
    out = lk.link_checkins(v.checkins_b.drop("business_id"), links)
    return out.select("b_user_id", "poi_id", "business_id", "local_ts", "hour", "weekday", "is_weekend")


view("places_a", "SELECT DISTINCT user_id, place_id FROM visits_a")
view("places_b", "SELECT DISTINCT user_id, place_id FROM visits_b")
view("user_pairs", "SELECT a.user_id AS a_user, b.user_id AS b_user, count(*) AS n_shared FROM places_a a JOIN places_b b ON a.place_id = b.place_id GROUP BY 1, 2 HAVING count(*) >= 2")


@query("candidate_user_pairs", "J12", "SELECT * FROM user_pairs")
def _(v):
    return lk.candidate_user_pairs(v.visits_a, v.visits_b)


view(
    "timed_pairs",
    """SELECT p.a_user, p.b_user, p.n_shared, coalesce(h.k, 0) / CAST(p.n_shared AS DOUBLE) AS temporal_score FROM user_pairs p LEFT JOIN
 (SELECT a.user_id AS a_user, b.user_id AS b_user, count(DISTINCT a.place_id) AS k FROM visits_a a JOIN visits_b b ON a.place_id = b.place_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 72 * 3600000000 GROUP BY 1, 2) h
 ON p.a_user = h.a_user AND p.b_user = h.b_user""",
)


@query("temporal_overlap", "J13", "SELECT * FROM timed_pairs", rnd="temporal_score")
def _(v):
    return lk.temporal_overlap(v.visits_a, v.visits_b)


view(
    "scored_pairs",
    """SELECT *, CASE WHEN combined_similarity >= 0.5 AND n_shared >= 5 THEN 'high' WHEN combined_similarity >= 0.3 AND n_shared >= 3 THEN 'medium' WHEN combined_similarity >= 0.15 AND n_shared >= 2 THEN 'low' ELSE 'noise' END AS confidence_tier
 FROM (SELECT t.*, a.n_a, b.n_b, n_shared / CAST(n_a + n_b - n_shared AS DOUBLE) AS jaccard, round(0.6 * (n_shared / CAST(n_a + n_b - n_shared AS DOUBLE)) + 0.4 * temporal_score, 9) AS combined_similarity
 FROM timed_pairs t JOIN (SELECT user_id, count(*) AS n_a FROM places_a GROUP BY 1) a ON t.a_user = a.user_id JOIN (SELECT user_id, count(*) AS n_b FROM places_b GROUP BY 1) b ON t.b_user = b.user_id)""",
)


@query(
    "linkable_user_pairs", "J12 U6",
    "SELECT a_user, b_user, n_shared, n_a, n_b, CAST(round(temporal_score * n_shared) AS BIGINT) AS n_met FROM scored_pairs WHERE temporal_score > 0 OR 0.6 * jaccard >= 0.15 - 1e-9",
)
def _(v):
    """Pairs that can be linked, against all pairs."""
    return lk.linkable_pairs(v.visits_a, v.visits_b).select("a_user", "b_user", "n_shared", "n_a", "n_b", "n_met")


@query("user_pair_scores", "U6 P19", "SELECT a_user, b_user, n_shared, temporal_score, n_a, n_b, jaccard, combined_similarity, confidence_tier FROM scored_pairs", rnd="temporal_score jaccard combined_similarity")
def _(v):
    return lk.score_user_pairs(v.visits_a, v.visits_b)


view(
    "user_links",
    """SELECT * EXCLUDE (i, j) FROM (SELECT *, row_number() OVER (PARTITION BY b_user ORDER BY combined_similarity DESC, a_user) AS j FROM
 (SELECT *, row_number() OVER (PARTITION BY a_user ORDER BY combined_similarity DESC, b_user) AS i FROM (SELECT a_user, b_user, n_shared, temporal_score, n_a, n_b, jaccard, combined_similarity, confidence_tier FROM scored_pairs)
 WHERE combined_similarity >= 0.15 AND confidence_tier <> 'noise') WHERE i = 1) WHERE j = 1""",
)


@query("user_links", "V8 W5 P19", "SELECT * FROM user_links", rnd="temporal_score jaccard combined_similarity")
def _(v):
    return lk.link_users(v.visits_a, v.visits_b)


@query("confident_user_links", "P27", "SELECT a_user, b_user, confidence_tier FROM user_links WHERE confidence_tier IN ('medium', 'high')")
def _(v):
    from footfall.operators.clean import min_tier

    return min_tier(lk.link_users(v.visits_a, v.visits_b), "medium").select("a_user", "b_user", "confidence_tier")


@query(
    "enriched_ranking", "R11",
    """SELECT v.business_id, v.score * 100 AS score, s.friend_checkin_count, s.mean_bridge_confidence, l.business_id IS NOT NULL AS is_linked, 0.2::DOUBLE AS parameter FROM ranked_venues v
 LEFT JOIN social_signals s ON v.business_id = s.business_id LEFT JOIN venue_linkage l ON v.business_id = l.business_id""",
    rnd="score friend_checkin_count mean_bridge_confidence", digits=5,
)
def _(v):
    scores = behavioural(v).venues.withColumn("score", F.col("score") * 100)
    sig = signals(v).select("business_id", "friend_checkin_count", "mean_bridge_confidence")
    return rec.enrich(scores, sig, lk.link_venues(*sides(v), min_confidence=0.3), 0.2)


@query(
    "linked_share_of_top", "R11",
    """SELECT avg(CASE WHEN l.business_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS linked_share, count(*) AS n FROM (SELECT business_id FROM ranked_venues ORDER BY score DESC, business_id LIMIT 50) t
 LEFT JOIN venue_linkage l ON t.business_id = l.business_id""", rnd="linked_share",
)
def _(v):
    scores = behavioural(v).venues
    empty = scores.select("business_id").withColumn("friend_checkin_count", F.lit(0.0))
    return rec.linked_share(rec.enrich(scores, empty, lk.link_venues(*sides(v), min_confidence=0.3), 0.2))


def grams_sql(table: str, key: str, sizes: str) -> str:
    return f"""SELECT {key}, substr(w, CAST(i AS INT), CAST(n AS INT)) AS term FROM (SELECT {key}, ' ' || unnest(list_filter(string_split(lower({key}), ' '), lambda x: x <> '')) || ' ' AS w FROM {table}),
 (VALUES {sizes}) t(n), range(1, 200) r(i) WHERE i + n - 1 <= length(w)"""


view("name_list", "SELECT DISTINCT p_name AS name FROM part")
view(
    "name_asked",
    """SELECT query_id, CASE WHEN query = 'smll ring' THEN 'red widget' ELSE query END AS query FROM (SELECT p_partkey AS query_id,
 CASE WHEN p_partkey % 10 = 3 THEN lower(substr(p_name, 2, 2)) ELSE lower(substr(p_name, 1, 2) || substr(p_name, 4, 100)) END AS query FROM part)""",
)
view("query_list", "SELECT DISTINCT query FROM name_asked")
view("list_counts", f"SELECT name, term, count(*) AS tf FROM ({grams_sql('name_list', 'name', '(2), (3), (4)')}) GROUP BY 1, 2")
view("list_idf", "SELECT term, ln((1.0 + (SELECT count(*) FROM name_list)) / (1 + count(*))) + 1 AS idf FROM list_counts GROUP BY term")
view("list_weights", "SELECT name, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY name)) AS weight FROM list_counts JOIN list_idf USING (term)")
view("asked_counts", f"SELECT query, term, count(*) AS tf FROM ({grams_sql('query_list', 'query', '(2), (3), (4)')}) GROUP BY 1, 2")
view("asked_weights", "SELECT query, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query)) AS weight FROM asked_counts JOIN list_idf USING (term)")


@query("name_search", "V5 F15 F16",
    f"""WITH near AS (SELECT query, name, sum(a.weight * b.weight) + 0.25 AS score FROM asked_weights a JOIN list_weights b USING (term) GROUP BY 1, 2 HAVING sum(a.weight * b.weight) > 0.03),
told AS (SELECT query, name, CASE WHEN query = lower(name) THEN 2.0 WHEN contains(lower(name), query) THEN 1.2 ELSE 1 - levenshtein(query, lower(name)) / CAST(GREATEST(length(query), length(name)) AS DOUBLE) END AS score FROM query_list CROSS JOIN name_list),
best AS (SELECT query, name, round(max(score), 9) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM told WHERE score >= 0.45) GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS place FROM best)
SELECT query_id, name, score, place FROM name_asked JOIN placed USING (query) WHERE place <= 5""", rnd="score")
def _(v):
    """Part names with a letter missing or two letters of them only, searched among all part names; one text is an alias."""
    p = v.raw("part")
    names = p.select(F.col("p_name").alias("name")).distinct()
    asked = p.select(F.col("p_partkey").alias("query_id"), F.expr("CASE WHEN p_partkey % 10 = 3 THEN substring(p_name, 2, 2) ELSE concat(substring(p_name, 1, 2), substring(p_name, 4, 100)) END").alias("query"))
    return tx.search(asked, names, {"Smll ring": "red widget"}, 5)
