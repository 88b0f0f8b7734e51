"""Graph ranking, baselines and offline evaluation."""

from __future__ import annotations


from pyspark.sql import functions as F

from footfall.catalog.registry import query, view
from footfall.operators import baseline as bl
from footfall.operators import evaluate as evl
from footfall.operators import events as ev
from footfall.operators import features as ft
from footfall.operators import graph as gr
from footfall.operators import segments as sg
from footfall.operators import stats as st
from footfall.operators.scale import number_rows, quantiles, top_k

SPLIT = "1999-01-01"


def unrolled(edges: str, p0: str | None, q0: str | None, steps: int, out: str, alpha=0.85, beta=0.85, jacobi=False, by="") -> str:
    """The ranking steps as one SQL text; ``out`` is 'user' or 'venue'."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    using = f"{by}, " if by else ""

    def start(name, key, prior):
        nodes = f"SELECT DISTINCT {b}{key} FROM {edges}"
        pr = "1.0" if prior is None else "coalesce(r.prior, 1.0)"
        join = "" if prior is None else f" LEFT JOIN {prior} r ON n.{key} = r.{key}"
        cols = f"n.{by}, " if by else ""
        return f"{name} AS MATERIALIZED (SELECT {cols}n.{key}, {pr} / sum({pr}) OVER ({part}) AS s FROM ({nodes}) n{join})"

    parts = [
        f"""e AS MATERIALIZED (SELECT {b}user_id, business_id, weight / sum(weight) OVER (PARTITION BY {b}user_id) AS wu,
 weight / sum(weight) OVER (PARTITION BY {b}business_id) AS wv FROM {edges})""",
        start("p0", "user_id", p0),
        start("q0", "business_id", q0),
    ]
    for i in range(1, steps + 1):
        src = f"p{i - 1}" if jacobi else f"p{i}"
        for new, key, weight, old, other, damp, base in (
            (f"p{i}", "user_id", "wu", f"q{i - 1}", "business_id", alpha, "p0"),
            (f"q{i}", "business_id", "wv", src, "user_id", beta, "q0"),
        ):
            cols = f"e.{by}, " if by else ""
            parts.append(
                f"""{new} AS MATERIALIZED (SELECT {b}{key}, s / sum(s) OVER ({part}) AS s FROM (SELECT {cols}e.{key},
 CAST({damp} AS DOUBLE) * sum(e.{weight} * o.s) + (1 - CAST({damp} AS DOUBLE)) * any_value(z.s) AS s
 FROM e JOIN {old} o USING ({using}{other}) JOIN {base} z USING ({using}{key}) GROUP BY {cols}e.{key}))"""
            )
    last, key = (f"p{steps}", "user_id") if out == "user" else (f"q{steps}", "business_id")
    return "WITH " + ",\n".join(parts) + f"\nSELECT {b}{key}, s AS score FROM {last}"


view("user_prior", "SELECT user_id, GREATEST(ln(1 + total_visits) * (1 - coalesce(burstiness_index, 0.0)), 1e-10) AS prior FROM user_features")
view(
    "venue_prior",
    """SELECT e.business_id, GREATEST(coalesce(repeat_user_rate, 0.0) / (1 + coalesce(stability_cv, 1.0)), 1e-10) AS prior
 FROM (SELECT DISTINCT business_id FROM edges) e LEFT JOIN venue_features v ON e.business_id = v.business_id""",
)
view("ranked_venues", unrolled("edges", "user_prior", "venue_prior", 5, "venue"))
view("ranked_users", unrolled("edges", "user_prior", "venue_prior", 5, "user"))


def behavioural(v, steps=5):
    e = ev.edges(v.interactions)
    p0, q0 = gr.behavioural_priors(e, ft.user_features(v.interactions), ft.venue_features(v.interactions))
    return gr.birank(e, p0, q0, max_iter=steps, tol=None)


@query(
    "venue_ranking", "G1 G2 G4 T1 T2 W3",
    """SELECT business_id, score * (SELECT count(*) FROM ranked_venues) AS score, row_number() OVER (ORDER BY score DESC, business_id) AS place
FROM ranked_venues ORDER BY score DESC, business_id LIMIT 20""", rnd="score",
)
def _(v):
    """Top 20 venues after five ranking steps with behavioural priors, scores scaled to mean 1."""
    ranked = behavioural(v).venues
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    head = top_k(ranked, 20, [F.col("score").desc(), F.col("business_id")], rank="place")
    return head.withColumn("score", F.col("score") * n)


@query("user_ranking", "G2", "SELECT user_id, score * (SELECT count(*) FROM ranked_users) AS score FROM ranked_users", rnd="score")
def _(v):
    ranked = behavioural(v).users
    return ranked.withColumn("score", F.col("score") * ranked.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("user_prior", "G4 J18", "SELECT * FROM user_prior", rnd="prior")
def _(v):
    e = ev.edges(v.interactions)
    return gr.behavioural_priors(e, ft.user_features(v.interactions), ft.venue_features(v.interactions))[0]


@query("venue_prior", "G4", "SELECT * FROM venue_prior", rnd="prior", digits=9)
def _(v):
    e = ev.edges(v.interactions)
    return gr.behavioural_priors(e, ft.user_features(v.interactions), ft.venue_features(v.interactions))[1]


@query(
    "normalized_edges", "G1",
    """SELECT user_id, business_id, weight / sum(weight) OVER (PARTITION BY user_id) AS w_user,
 weight / sum(weight) OVER (PARTITION BY business_id) AS w_venue FROM edges""", rnd="w_user w_venue", digits=9,
)
def _(v):
    return gr.normalize_edges(ev.edges(v.interactions))


view(
    "hotel_user_prior", "SELECT user_id, GREATEST(0.6 * hotel_frequency + 0.4 * hotel_city_diversity, 0.01) AS prior FROM hotel_users"
)
view(
    "hotel_venue_prior",
    """SELECT business_id, GREATEST(0.4 * review_velocity + 0.3 * geographic_diversity + 10.0 * multi_stay_rate + 0.1 * (1 - seasonal_cv), 0.01) AS prior
 FROM hotel_venues""",
)
view("hotel_ranked", unrolled("credibility_edges", "hotel_user_prior", "hotel_venue_prior", 5, "venue", jacobi=True))


def as_of():
    return F.lit("2002-01-01").cast("timestamp")


@query("hotel_priors", "G5", "SELECT * FROM hotel_venue_prior", rnd="prior")
def _(v):
    return gr.hotel_priors(ft.hotel_user_features(v.reviews, v.businesses), ft.hotel_venue_features(v.reviews, v.businesses, as_of()))[1]


@query("hotel_user_prior", "G5", "SELECT * FROM hotel_user_prior", rnd="prior")
def _(v):
    return gr.hotel_priors(ft.hotel_user_features(v.reviews, v.businesses), ft.hotel_venue_features(v.reviews, v.businesses, as_of()))[0]


@query(
    "hotel_ranking", "G3 G5 A3",
    "SELECT business_id, score * (SELECT count(*) FROM hotel_ranked) AS score FROM hotel_ranked", rnd="score",
)
def _(v):
    e = ev.edges(v.reviews, "credibility", as_of())
    p0, q0 = gr.hotel_priors(
        ft.hotel_user_features(v.reviews, v.businesses), ft.hotel_venue_features(v.reviews, v.businesses, as_of())
    )
    out = gr.birank(e, p0, q0, max_iter=5, tol=None, update="jacobi", norm="linf").venues
    return out.withColumn("score", F.col("score") * out.agg(F.count(F.lit(1)).alias("n")).scalar())


GRID = [(a, b) for a in (0.5, 0.7, 0.85) for b in (0.5, 0.7, 0.85)]


@query(
    "ranking_sensitivity", "G12",
    "SELECT g.alpha, g.beta, g.business_id, g.score * (SELECT count(DISTINCT business_id) FROM edges) AS score FROM ("
    + " UNION ALL ".join(
        f"SELECT CAST({a} AS DOUBLE) AS alpha, CAST({b} AS DOUBLE) AS beta, business_id, score FROM ({unrolled('edges', 'user_prior', 'venue_prior', 2, 'venue', a, b)})"
        for a, b in GRID
    )
    + ") g",
    rnd="score",
)
def _(v):
    """Two steps for a 3 x 3 grid of damping factors, all cells in one job."""
    e = ev.edges(v.interactions)
    p0, q0 = gr.behavioural_priors(e, ft.user_features(v.interactions), ft.venue_features(v.interactions))
    out = gr.birank(e, p0, q0, max_iter=2, tol=None, cells=GRID).venues
    n = e.agg(F.count_distinct("business_id").alias("n")).scalar()
    alpha = F.element_at(F.array(*[F.lit(a) for a, _ in GRID]), F.col("cell") + 1)
    beta = F.element_at(F.array(*[F.lit(b) for _, b in GRID]), F.col("cell") + 1)
    return out.select(alpha.alias("alpha"), beta.alias("beta"), "business_id", (F.col("score") * n).alias("score"))


view(
    "user_groups",
    """SELECT user_id, CASE WHEN total_visits >= 4 AND revisit_ratio < 0.25 THEN 'Weekday Regulars' WHEN total_visits <= 2 AND revisit_ratio < 0.25 THEN 'Infrequent Visitors'
 WHEN revisit_ratio >= 0.25 THEN 'Loyalists' ELSE 'Casual Weekenders' END AS segment FROM user_features""",
)
view("segment_edges", "SELECT g.segment, e.user_id, e.business_id, e.weight FROM edges e JOIN user_groups g ON e.user_id = g.user_id")


def segment_edges(v):
    groups = sg.assign_user_groups(ft.user_features(v.interactions))
    return ev.edges(v.interactions).join(groups, "user_id").select("segment", "user_id", "business_id", "weight")


@query("user_groups", "P18", "SELECT * FROM user_groups")
def _(v):
    return sg.assign_user_groups(ft.user_features(v.interactions))


view(
    "segment_scores",
    """SELECT segment, business_id, s / sum(s) OVER (PARTITION BY segment) AS score FROM (
 SELECT e.segment, business_id, sum(1.0 / d) AS s FROM segment_edges e JOIN (SELECT segment, user_id, count(*) AS d FROM segment_edges GROUP BY 1, 2) k
 ON e.segment = k.segment AND e.user_id = k.user_id GROUP BY 1, 2)""",
)


@query("segment_degree_scores", "A32 P13 G11", "SELECT * FROM segment_scores", rnd="score")
def _(v):
    return gr.degree_score(segment_edges(v), ["segment"])


@query("segment_ranking", "G11", unrolled("segment_edges", None, None, 3, "venue", by="segment"), rnd="score", digits=9)
def _(v):
    return gr.birank(segment_edges(v), max_iter=3, tol=None, by=["segment"]).venues


view(
    "segment_ranks", "SELECT segment, business_id, row_number() OVER (PARTITION BY segment ORDER BY round(score, 9) DESC, business_id) AS rank FROM segment_scores"
)
view("global_ranks", "SELECT business_id, row_number() OVER (ORDER BY round(score, 9) DESC, business_id) AS rank FROM ranked_venues")


def ranked(df, by=()):
    rounded = df.withColumn("score", F.round("score", 9))
    return number_rows(rounded, [F.col("score").desc(), F.col("business_id")], by, "rank")


@query(
    "segment_rank_deltas", "W10 J3",
    """SELECT g.business_id, s.segment, g.rank AS global_rank, r.rank AS segment_rank, r.rank - g.rank AS delta, r.rank IS NOT NULL AS is_ranked
FROM global_ranks g CROSS JOIN (SELECT DISTINCT segment FROM segment_ranks) s LEFT JOIN segment_ranks r ON r.segment = s.segment AND r.business_id = g.business_id""",
)
def _(v):
    return sg.rank_deltas(ranked(behavioural(v).venues), ranked(gr.degree_score(segment_edges(v), ["segment"]), ["segment"]))


@query(
    "most_promoted_venues", "T12",
    """SELECT segment, business_id, delta, place FROM (SELECT r.segment, r.business_id, r.rank - g.rank AS delta,
 row_number() OVER (PARTITION BY r.segment ORDER BY r.rank - g.rank, r.business_id) AS place FROM segment_ranks r JOIN global_ranks g ON r.business_id = g.business_id)
WHERE place <= 5""",
)
def _(v):
    deltas = sg.rank_deltas(ranked(behavioural(v).venues), ranked(gr.degree_score(segment_edges(v), ["segment"]), ["segment"]))
    return sg.most_promoted(deltas, 5).select("segment", "business_id", "delta", "place")


@query(
    "segment_specific_venues", "A42",
    """WITH a AS (SELECT business_id, sum(rank) AS s, count(*) AS k FROM segment_ranks GROUP BY 1),
d AS (SELECT r.segment, r.business_id, r.rank, (a.s - r.rank) / CAST(a.k - 1 AS DOUBLE) - r.rank AS rank_diff FROM segment_ranks r JOIN a ON r.business_id = a.business_id WHERE r.rank <= 20 AND a.k > 1)
SELECT segment, business_id, rank, rank_diff, place FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY rank_diff DESC, business_id) AS place FROM d) WHERE place <= 3""",
    rnd="rank_diff",
)
def _(v):
    return sg.segment_specific(ranked(gr.degree_score(segment_edges(v), ["segment"]), ["segment"]), 20, 3)


@query(
    "segment_digest", "A47",
    """SELECT r.segment, avg(f.repeat_user_rate) AS revisit_rate, avg(f.unique_users) AS unique_users, avg(g.rank) AS global_rank FROM segment_ranks r
 JOIN venue_features f ON r.business_id = f.business_id JOIN global_ranks g ON r.business_id = g.business_id WHERE r.rank <= 10 GROUP BY r.segment""",
    rnd="revisit_rate unique_users global_rank",
)
def _(v):
    return sg.segment_digest(
        ranked(gr.degree_score(segment_edges(v), ["segment"]), ["segment"]),
        ranked(behavioural(v).venues),
        ft.venue_features(v.interactions).withColumnRenamed("repeat_user_rate", "revisit_rate"),
    )


# ---------------------------------------------------------------- baselines

view("train", f"SELECT * FROM interactions WHERE ts < TIMESTAMP '{SPLIT}'")
view("test", f"SELECT * FROM interactions WHERE ts >= TIMESTAMP '{SPLIT}'")
view("both_users", "SELECT DISTINCT user_id FROM train WHERE user_id IS NOT NULL AND user_id IN (SELECT user_id FROM test WHERE user_id IS NOT NULL)")
view("train_pairs", "SELECT DISTINCT user_id, business_id FROM train WHERE user_id IN (SELECT user_id FROM both_users)")
view("test_pairs", "SELECT DISTINCT user_id, business_id FROM test WHERE user_id IN (SELECT user_id FROM both_users)")
view("rating_base", "SELECT business_id, avg(stars) AS rating_mean, count(stars) AS rating_count FROM interactions WHERE stars IS NOT NULL GROUP BY 1")
view(
    "iuf_scores",
    """SELECT t.business_id, sum(1 / ln(1 + k)) AS iuf FROM {src} t JOIN (SELECT user_id, count(DISTINCT business_id) AS k FROM {src} WHERE user_id IS NOT NULL GROUP BY 1) u
 ON t.user_id = u.user_id GROUP BY 1""".format(src="interactions"),
)
view(
    "method_scores",
    """SELECT 'popularity' AS method, business_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 2
 UNION ALL SELECT 'rating', business_id, round(avg(stars), 9) FROM train WHERE stars IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'iuf', t.business_id, round(sum(1 / ln(1 + k)), 9) FROM train t JOIN (SELECT user_id, count(DISTINCT business_id) AS k FROM train WHERE user_id IS NOT NULL GROUP BY 1) u
   ON t.user_id = u.user_id GROUP BY 2
 UNION ALL SELECT 'random', business_id, CAST('0x' || substr(md5('42:' || CAST(business_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 FROM (SELECT DISTINCT business_id FROM train)""",
)
view(
    "method_lists",
    """SELECT m.method, p.user_id, p.business_id, row_number() OVER (PARTITION BY m.method, p.user_id ORDER BY coalesce(s.score, 0.0) DESC, p.business_id) AS position,
 CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS rel, count(*) OVER (PARTITION BY m.method, p.user_id) AS n_candidates,
 sum(CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY m.method, p.user_id) AS n_relevant
 FROM train_pairs p CROSS JOIN (SELECT DISTINCT method FROM method_scores) m LEFT JOIN method_scores s ON s.method = m.method AND s.business_id = p.business_id
 LEFT JOIN test_pairs t ON p.user_id = t.user_id AND p.business_id = t.business_id""",
)


def ideal_case(goal: str, k: int) -> str:
    """The ideal DCG of ``goal`` items as CASE arms."""
    import math

    total, arms = 0.0, ["WHEN 0 THEN 0.0"]
    for i in range(1, k + 1):
        total += 1 / math.log2(i + 1)
        arms.append(f"WHEN {i} THEN {total!r}")
    return f"CASE LEAST({goal}, {k}) {' '.join(arms)} END"


def metric_sql(ideal: str) -> str:
    cols = []
    for k in evl.KS:
        found = f"sum(CASE WHEN position <= {k} THEN rel ELSE 0 END)"
        goal = found if ideal == "slice" else "max(n_relevant)"
        dcg = f"sum(CASE WHEN position <= {k} THEN rel / log2(position + 1) ELSE 0.0 END)"
        cols.append(f"coalesce({dcg} / nullif({ideal_case(goal, k)}, 0), 0.0) AS ndcg_{k}")
        cols.append(f"CASE WHEN {found} > 0 THEN 1.0 ELSE 0.0 END AS hit_{k}")
    return f"SELECT method, user_id, {', '.join(cols)} FROM method_lists WHERE n_candidates >= 2 GROUP BY method, user_id"


view("user_scores", metric_sql("candidates"))
view("user_scores_slice", metric_sql("slice"))
METRICS = [f"{m}_{k}" for k in evl.KS for m in ("ndcg", "hit")]
MEANS = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
view("method_means", f"SELECT method, {MEANS}, count(*) AS n_users FROM user_scores GROUP BY method")


def train_test(v):
    return ev.temporal_split(v.interactions, SPLIT)


def method_scores(train):
    parts = {
        "popularity": bl.popularity(train).select("business_id", F.col("popularity_visits").cast("double").alias("score")),
        "rating": bl.rating(train).select("business_id", F.round("rating_mean", 9).alias("score")),
        "iuf": bl.inverse_user_frequency(train).select("business_id", F.round("iuf", 9).alias("score")),
        "random": bl.random_score(train),
    }
    out = None
    for name, df in parts.items():
        labelled = df.select(F.lit(name).alias("method"), "business_id", "score")
        out = labelled if out is None else out.unionByName(labelled)
    return out


def lists(v):
    train, test = train_test(v)
    tr, te = evl.split_pairs(train, test)
    return evl.rerank(tr, te, method_scores(train), ["method"])


def user_scores(v, ideal="candidates"):
    return evl.user_metrics(lists(v), ["method"], ideal=ideal)


@query("rating_baseline", "A29", "SELECT * FROM rating_base", rnd="rating_mean")
def _(v):
    return bl.rating(v.interactions)


@query("popularity_baseline", "A30", "SELECT business_id, count(*) AS popularity_visits FROM interactions GROUP BY 1")
def _(v):
    return bl.popularity(v.interactions)


@query("inverse_user_frequency", "A31", "SELECT * FROM iuf_scores", rnd="iuf")
def _(v):
    return bl.inverse_user_frequency(v.interactions)


@query(
    "random_baseline", "E30",
    "SELECT business_id, CAST('0x' || substr(md5('42:' || CAST(business_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS score FROM (SELECT DISTINCT business_id FROM interactions)",
    rnd="score", digits=9,
)
def _(v):
    return bl.random_score(v.interactions)


view(
    "venue_comparison",
    """SELECT b.business_id, coalesce(r.rating_mean, (SELECT median(rating_mean) FROM rating_base)) AS rating_mean, r.rating_count, b.total_visits AS popularity_visits,
 b.revisit_rate, b.unique_users, b.repeat_users, coalesce(s.score, 0.0) AS score, coalesce(s.rank, count(*) OVER ()) AS rank
 FROM (SELECT business_id, popularity_visits AS total_visits, unique_users, repeat_user_count AS repeat_users, repeat_user_rate AS revisit_rate FROM venue_loyalty) b
 LEFT JOIN rating_base r ON b.business_id = r.business_id
 LEFT JOIN (SELECT v.business_id, v.score, g.rank FROM ranked_venues v JOIN global_ranks g ON v.business_id = g.business_id) s ON b.business_id = s.business_id""",
)


def comparison(v):
    base = bl.merge_baselines(bl.rating(v.interactions), bl.popularity(v.interactions), ft.venue_basics(v.interactions))
    return bl.merge_ranking(base, ranked(behavioural(v).venues))


@query("merged_baselines", "J3 P10", "SELECT * FROM venue_comparison", rnd="rating_mean revisit_rate score")
def _(v):
    return comparison(v)


@query(
    "venue_competition_ranks", "W2",
    """SELECT business_id, rank() OVER (ORDER BY popularity_visits DESC) AS popularity_rank, rank() OVER (ORDER BY round(revisit_rate, 9) DESC) AS revisit_rank FROM venue_comparison""",
)
def _(v):
    base = ft.venue_basics(v.interactions).withColumn("revisit_rate", F.round("revisit_rate", 9))
    out = st.competition_rank(base, "total_visits", name="popularity_rank")
    return st.competition_rank(out, "revisit_rate", name="revisit_rank").select("business_id", "popularity_rank", "revisit_rank")


SPEARMAN = """SELECT corr(rx, ry) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
 rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ({src}))"""


@query(
    "baseline_correlation", "E14 W9",
    SPEARMAN.format(src="SELECT round(rating_mean, 9) AS x, popularity_visits AS y FROM venue_comparison"), rnd="rho",
)
def _(v):
    base = bl.rating(v.interactions).join(bl.popularity(v.interactions), "business_id")
    return st.spearman(base.withColumn("rating_mean", F.round("rating_mean", 9)), "rating_mean", "popularity_visits")


@query(
    "topk_overlap", "T3",
    """WITH a AS (SELECT business_id, row_number() OVER (ORDER BY score DESC, business_id) AS r FROM method_scores WHERE method = 'popularity'),
b AS (SELECT business_id, row_number() OVER (ORDER BY score DESC, business_id) AS r FROM method_scores WHERE method = 'iuf')
SELECT count(*) FILTER (WHERE a.r <= 10 AND b.r <= 10) / 10.0 AS overlap_10, count(*) FILTER (WHERE a.r <= 20 AND b.r <= 20) / 20.0 AS overlap_20,
 count(*) FILTER (WHERE a.r <= 50 AND b.r <= 50) / 50.0 AS overlap_50 FROM a JOIN b ON a.business_id = b.business_id""",
    rnd="overlap_10 overlap_20 overlap_50",
)
def _(v):
    s = method_scores(train_test(v)[0])
    return evl.topk_overlap(s.where(F.col("method") == "popularity"), s.where(F.col("method") == "iuf"))


# ---------------------------------------------------------------- evaluation


@query(
    "temporal_split_sizes", "P26 J6",
    f"""SELECT (SELECT count(*) FROM interactions WHERE ts < TIMESTAMP '1998-01-01') AS train, (SELECT count(*) FROM interactions WHERE ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '{SPLIT}') AS tune,
 (SELECT count(*) FROM test) AS test, (SELECT count(*) FROM both_users) AS overlap""",
)
def _(v):
    from footfall.operators.scale import attach

    a, b, c = ev.temporal_split(v.interactions, "1998-01-01", SPLIT)
    train, test = train_test(v)
    sizes = [x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "train"), (b, "tune"), (c, "test"))]
    overlap = ev.overlap_users(train, test).agg(F.count(F.lit(1)).alias("overlap"))
    return attach(attach(attach(sizes[0], sizes[1], []), sizes[2], []), overlap, [])


@query(
    "rerank_lists", "E1 J4",
    "SELECT method, user_id, business_id, CAST(position AS INT) AS position, CAST(rel AS INT) AS rel, n_candidates, CAST(n_relevant AS BIGINT) AS n_relevant FROM method_lists WHERE n_candidates >= 2",
)
def _(v):
    return lists(v)


@query("user_metrics", "E1 E3 E6", "SELECT * FROM user_scores", rnd=" ".join(METRICS))
def _(v):
    return user_scores(v)


@query("user_metrics_slice_ideal", "E2", "SELECT * FROM user_scores_slice", rnd=" ".join(METRICS))
def _(v):
    return user_scores(v, "slice")


@query("method_metrics", "E3 E6 E26", "SELECT * FROM method_means", rnd=" ".join(METRICS))
def _(v):
    return evl.mean_metrics(user_scores(v), ["method"])


def global_sql(ideal: str) -> str:
    cols = []
    for k in evl.KS:
        found = f"count(*) FILTER (WHERE position <= {k})"
        goal = found if ideal == "slice" else "max(n_actual)"
        dcg = f"sum(CASE WHEN position <= {k} THEN 1.0 / log2(position + 1) ELSE 0.0 END)"
        cols.append(f"coalesce({dcg} / nullif({ideal_case(goal, k)}, 0), 0.0) AS ndcg_{k}")
        cols.append(f"CASE WHEN {found} > 0 THEN 1.0 ELSE 0.0 END AS hit_{k}")
    sums = ", ".join(f"sum({m}) / (SELECT count(DISTINCT user_id) FROM test_pairs) AS {m}" for m in METRICS)
    return f"""WITH h AS (SELECT method, business_id, row_number() OVER (PARTITION BY method ORDER BY score DESC, business_id) AS position FROM method_scores),
a AS (SELECT user_id, count(*) AS n_actual FROM test_pairs GROUP BY 1),
m AS (SELECT h.method, t.user_id, h.position, a.n_actual FROM test_pairs t JOIN h ON t.business_id = h.business_id AND h.position <= 20 JOIN a ON t.user_id = a.user_id),
u AS (SELECT method, user_id, {', '.join(cols)} FROM m GROUP BY method, user_id)
SELECT method, {sums}, (SELECT count(DISTINCT user_id) FROM test_pairs) AS n_users FROM u GROUP BY method"""


@query("global_list_metrics", "E7", global_sql("slice"), rnd=" ".join(METRICS))
def _(v):
    train, test = train_test(v)
    return evl.eval_global(method_scores(train), evl.split_pairs(train, test)[1], ["method"])


@query("global_list_metrics_actual_ideal", "E4", global_sql("actual"), rnd=" ".join(METRICS))
def _(v):
    train, test = train_test(v)
    return evl.eval_global(method_scores(train), evl.split_pairs(train, test)[1], ["method"], ideal="actual")


@query(
    "venue_level_agreement", "E8 W9",
    """WITH c AS (SELECT s.business_id, s.score AS x, count(*) AS y FROM method_scores s JOIN test_pairs t ON s.business_id = t.business_id WHERE method = 'popularity' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY x DESC, business_id) AS rx, row_number() OVER (ORDER BY y DESC, business_id) AS ry FROM c)
SELECT s.rho, s.n, count(*) FILTER (WHERE rx <= 10 AND ry <= 10) / 10.0 AS overlap_10, count(*) FILTER (WHERE rx <= 20 AND ry <= 20) / 20.0 AS overlap_20,
 count(*) FILTER (WHERE rx <= 50 AND ry <= 50) / 50.0 AS overlap_50 FROM r CROSS JOIN (""" + SPEARMAN.format(src="SELECT x, y FROM c") + ") s GROUP BY s.rho, s.n",
    rnd="rho overlap_10 overlap_20 overlap_50",
)
def _(v):
    train, test = train_test(v)
    scores = method_scores(train).where(F.col("method") == "popularity")
    return evl.eval_venue(scores, evl.split_pairs(train, test)[1])


@query(
    "linked_venue_metrics", "E9",
    f"""WITH k AS (SELECT business_id FROM businesses WHERE categories IS NOT NULL), tr AS (SELECT * FROM train_pairs WHERE business_id IN (SELECT business_id FROM k)),
te AS (SELECT * FROM test_pairs WHERE business_id IN (SELECT business_id FROM k) AND user_id IN (SELECT user_id FROM tr)),
l AS (SELECT p.user_id, row_number() OVER (PARTITION BY p.user_id ORDER BY s.score DESC, p.business_id) AS position, CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS rel,
 count(*) OVER (PARTITION BY p.user_id) AS c FROM tr p JOIN method_scores s ON s.business_id = p.business_id AND s.method = 'popularity' LEFT JOIN te t ON t.user_id = p.user_id AND t.business_id = p.business_id
 WHERE p.user_id IN (SELECT user_id FROM te)),
u AS (SELECT user_id, coalesce(sum(CASE WHEN position <= 10 THEN rel / log2(position + 1) ELSE 0.0 END) / nullif({ideal_case('sum(CASE WHEN position <= 10 THEN rel ELSE 0 END)', 10)}, 0), 0.0) AS ndcg_10,
 max(CASE WHEN position <= 10 THEN rel ELSE 0 END) AS hit_10 FROM l WHERE c >= 2 GROUP BY user_id)
SELECT avg(ndcg_10) AS ndcg_10, avg(hit_10) AS hit_10, count(*) AS n_users FROM u""",
    rnd="ndcg_10 hit_10",
)
def _(v):
    train, test = train_test(v)
    tr, te = evl.split_pairs(train, test)
    scores = method_scores(train).where(F.col("method") == "popularity").select("business_id", "score")
    return evl.eval_subset(tr, te, scores, v.businesses.where(F.col("categories").isNotNull()))


view("train_groups", "SELECT user_id, CASE WHEN c <= 2 THEN 'few' ELSE 'many' END AS segment FROM (SELECT user_id, count(*) AS c FROM train WHERE user_id IS NOT NULL GROUP BY 1) WHERE c < 30")


def train_groups(v):
    n = train_test(v)[0].where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    return n.where("c < 30").select("user_id", F.when(F.col("c") <= 2, F.lit("few")).otherwise(F.lit("many")).alias("segment"))


@query(
    "segment_metrics", "E10",
    """SELECT s.method, coalesce(g.segment, 'Unknown') AS segment, avg(ndcg_10) AS mean, stddev_pop(ndcg_10) AS std, count(*) AS n_users
FROM user_scores s LEFT JOIN train_groups g ON s.user_id = g.user_id GROUP BY 1, 2""", rnd="mean std",
)
def _(v):
    return evl.eval_by_segment(user_scores(v), train_groups(v), ["method"])


@query(
    "strongest_segments", "E27",
    """WITH m AS (SELECT s.method, coalesce(g.segment, 'Unknown') AS segment, round(avg(ndcg_10), 9) AS mean FROM user_scores s LEFT JOIN train_groups g ON s.user_id = g.user_id GROUP BY 1, 2)
SELECT method, (SELECT segment FROM m x WHERE x.method = m.method ORDER BY mean DESC, segment LIMIT 1) AS strongest,
 (SELECT segment FROM m x WHERE x.method = m.method ORDER BY mean, segment LIMIT 1) AS weakest FROM m GROUP BY method""",
)
def _(v):
    per = evl.eval_by_segment(user_scores(v), train_groups(v), ["method"])
    return evl.strongest_weakest(per.withColumn("mean", F.round("mean", 9)))


def _poly_sql(coefficients, x: str) -> str:
    out = repr(coefficients[0]) + "e0"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}e0)"
    return out


MIDDLE = f"{_poly_sql(st.NORMAL_A, '((u - 0.5e0) * (u - 0.5e0))')} * (u - 0.5e0) / {_poly_sql([*st.NORMAL_B, 1.0], '((u - 0.5e0) * (u - 0.5e0))')}"
TAIL = f"{_poly_sql(st.NORMAL_C, 't')} / {_poly_sql([*st.NORMAL_D, 1.0], 't')}"
QUANTILE = f"CASE WHEN u < {st.NORMAL_TAIL}e0 THEN {TAIL} WHEN u > 1 - {st.NORMAL_TAIL}e0 THEN -({TAIL}) ELSE {MIDDLE} END"
# Cumulative probabilities of the Poisson distribution for small means, added up in order.
view(
    "poisson_steps",
    f"""SELECT c, list(total ORDER BY k) AS steps FROM (SELECT c, k, sum(exp(-c + k * ln(c) - lgamma(k + 1))) OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING) AS total
 FROM (SELECT CAST(unnest(range(1, {st.SMALL_COUNT})) AS DOUBLE) AS c), (SELECT CAST(unnest(range(0, 200)) AS DOUBLE) AS k)) GROUP BY c""",
)


def boot_sql(src: str, by: str, value: str, n: int) -> str:
    b = f"{by}, " if by else ""
    return f"""SELECT {b}b AS replicate, sum(w * k) / sum(w) / 1e9 AS mean FROM (SELECT {b}b, k, CASE WHEN c < {st.SMALL_COUNT} THEN len(list_filter(steps, lambda s: s <= u)) ELSE CAST(greatest(floor(c + sqrt(c) * z + (z * z - 1) / 6 + 0.5e0), 0) AS BIGINT) END AS w
 FROM (SELECT *, {QUANTILE} AS z FROM (SELECT *, sqrt(-2 * ln(least(u, 1 - u))) AS t FROM (SELECT h.*, p.steps, b, (CAST('0x' || substr(md5('42:' || CAST(b AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0 AS u
 FROM (SELECT {b}CAST(round(CAST({value} AS DOUBLE) * 1e9) AS BIGINT) AS k, count(*) AS c FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL) h LEFT JOIN poisson_steps p ON h.c = p.c CROSS JOIN (SELECT unnest(range({n})) AS b))))) GROUP BY {b}b"""


RESAMPLES = 1000


@query(
    "bootstrap_intervals", "E11",
    f"""SELECT m.method, m.mean, m.n, c.ci_lo, c.ci_hi FROM (SELECT method, avg(ndcg_10) AS mean, count(*) AS n FROM user_scores GROUP BY 1) m
JOIN (SELECT method, quantile_cont(mean, 0.025) AS ci_lo, quantile_cont(mean, 0.975) AS ci_hi FROM ({boot_sql('user_scores', 'method', 'ndcg_10', RESAMPLES)}) GROUP BY method) c ON m.method = c.method""",
    rnd="mean ci_lo ci_hi",
)
def _(v):
    return st.bootstrap_ci(user_scores(v), "ndcg_10", ["method"], RESAMPLES)


@query(
    "stratified_bootstrap_interval", "E12",
    f"""WITH r AS (SELECT b AS replicate, avg(m) AS mean FROM (SELECT domain, replicate AS b, mean AS m FROM ({boot_sql('ballots', 'domain', 'ndcg', RESAMPLES)})) GROUP BY b)
SELECT (SELECT avg(m) FROM (SELECT avg(ndcg) AS m FROM ballots GROUP BY domain)) AS mean, quantile_cont(mean, 0.025) AS ci_lo, quantile_cont(mean, 0.975) AS ci_hi FROM r""",
    rnd="mean ci_lo ci_hi",
)
def _(v):
    return st.bootstrap_ci_stratified(v.ballots, "ndcg", "domain", RESAMPLES)


WINNER = """SELECT metric, max(CASE WHEN place = 1 THEN method END) AS winner, max(CASE WHEN place = 1 THEN value END) AS winner_value,
 max(CASE WHEN place = 2 THEN method END) AS runner_up, max(CASE WHEN place = 2 THEN value END) AS runner_up_value,
 max(CASE WHEN place = 1 THEN value END) - max(CASE WHEN place = 2 THEN value END) AS margin
 FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, method) AS place FROM long_metrics) GROUP BY metric"""
view("long_metrics", " UNION ALL ".join(f"SELECT method, '{m}' AS metric, round({m}, 9) AS value FROM method_means" for m in METRICS))
view("metric_winners", WINNER)


def method_means(v):
    means = evl.mean_metrics(user_scores(v), ["method"])
    return means.withColumns({m: F.round(m, 9) for m in METRICS})


@query("metric_winners", "E27", "SELECT * FROM metric_winners", rnd="winner_value runner_up_value margin")
def _(v):
    return evl.winners(method_means(v), METRICS)


@query(
    "lift_over_random", "E27",
    """SELECT l.method, l.metric, l.value, 100 * (l.value - r.value) / r.value AS lift_pct, (SELECT count(*) FROM metric_winners w WHERE w.winner = l.method) AS wins
FROM long_metrics l JOIN long_metrics r ON l.metric = r.metric AND r.method = 'random'""", rnd="value lift_pct", digits=5,
)
def _(v):
    return evl.lift_over(method_means(v), METRICS, "random")


@query(
    "metric_k_trend", "E28",
    " UNION ALL ".join(f"SELECT method, CAST({k} AS INT) AS k, ndcg_{k} AS value FROM method_means" for k in evl.KS), rnd="value",
)
def _(v):
    return evl.k_trend(method_means(v))


@query(
    "ablation_deltas", "E31",
    """SELECT *, ndcg_10 - (SELECT ndcg_10 FROM method_means WHERE method = 'popularity') AS ndcg_10_delta, hit_10 - (SELECT hit_10 FROM method_means WHERE method = 'popularity') AS hit_10_delta,
 method = (SELECT method FROM method_means ORDER BY round(ndcg_10, 9) DESC, method LIMIT 1) AS is_best FROM method_means""",
    rnd=" ".join(METRICS) + " ndcg_10_delta hit_10_delta",
)
def _(v):
    return evl.ablation_deltas(method_means(v), "popularity", ["ndcg_10", "hit_10"])


@query(
    "method_comparison", "E26",
    f"""SELECT m.*, c.ci_lo, c.ci_hi, m.ndcg_10 - (SELECT ndcg_10 FROM method_means WHERE method = 'popularity') AS delta FROM method_means m
JOIN (SELECT method, quantile_cont(mean, 0.025) AS ci_lo, quantile_cont(mean, 0.975) AS ci_hi FROM ({boot_sql('user_scores', 'method', 'ndcg_10', RESAMPLES)}) GROUP BY method) c ON m.method = c.method""",
    rnd=" ".join(METRICS) + " ci_lo ci_hi delta",
)
def _(v):
    """The method table without the p-values, which SQL can't state."""
    return evl.method_table(user_scores(v), "popularity", RESAMPLES).drop("p_vs_best", "delta_pct")


@query("method_table", "E13 E26")
def _(v):
    """Metrics, interval, p against the best and difference to the popularity order for every method."""
    return evl.method_table(user_scores(v), "popularity", RESAMPLES)


@query(
    "score_quantiles", "A33",
    """SELECT method, quantile_cont(ndcg_10, 0.25) AS ndcg_10_p25, quantile_cont(ndcg_10, 0.5) AS ndcg_10_p50, quantile_cont(ndcg_10, 0.75) AS ndcg_10_p75 FROM user_scores GROUP BY method""",
    rnd="ndcg_10_p25 ndcg_10_p50 ndcg_10_p75",
)
def _(v):
    return quantiles(user_scores(v), ["ndcg_10"], {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["method"])
