"""Recorded ballots: list metrics, grouping sets, tests, agreement and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from footfall.catalog.ranking import SPEARMAN
from footfall.catalog.registry import query, view
from footfall.functions import scalar as sc
from footfall.operators import evaluate as evl
from footfall.operators import stats as st

# A ballot per order: its lines in line order, ranked by price for reference and by quantity as stars.
view(
    "ballot_items",
    """SELECT l_orderkey AS list_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS ref_rank, l_quantity AS stars FROM lineitem""",
)


def ballot_items(v):
    w = Window.partitionBy("l_orderkey")
    keys = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    item = F.row_number().over(w.orderBy(*keys))
    return v.raw("lineitem").select(
        F.col("l_orderkey").alias("list_id"), item.alias("item"), item.alias("position"),
        F.row_number().over(w.orderBy(F.col("l_extendedprice").desc(), *keys)).alias("ref_rank"), F.col("l_quantity").alias("stars"),
    )


def _ballot_sql(src: str) -> str:
    hits = ", ".join(f"max(CASE WHEN position <= {h} AND ref_rank <= 3 THEN 1 ELSE 0 END) AS hit_at_{h}" for h in (1, 3, 5, 10))
    return f"""SELECT list_id, sum(CASE WHEN position <= 10 THEN 1 / log2(ref_rank + 1) / log2(position + 1) ELSE 0.0 END) / sum(CASE WHEN ref_rank <= 10 THEN 1 / log2(ref_rank + 1) / log2(ref_rank + 1) ELSE 0.0 END) AS ndcg, {hits} FROM {src} GROUP BY list_id"""


@query("ballot_metrics", "E5 E6", _ballot_sql("ballot_items"), rnd="ndcg")
def _(v):
    return evl.ballot_metrics(ballot_items(v), "list_id")


@query(
    "star_order_metrics", "E33",
    _ballot_sql("(SELECT list_id, ref_rank, row_number() OVER (PARTITION BY list_id ORDER BY stars DESC, item) AS position FROM ballot_items)"), rnd="ndcg",
)
def _(v):
    return evl.star_comparator(ballot_items(v), "list_id", "stars", "ref_rank", "item")


@query(
    "ballot_kendall", "E15",
    """SELECT l.list_id, k.tau AS kendall_tau FROM (SELECT DISTINCT list_id FROM ballot_items) l LEFT JOIN (SELECT a.list_id, sum(sign((a.position - b.position) * (a.ref_rank - b.ref_rank))) / CAST(count(*) AS DOUBLE) AS tau
 FROM ballot_items a JOIN ballot_items b ON a.list_id = b.list_id AND a.position < b.position GROUP BY 1) k ON l.list_id = k.list_id""",
    rnd="kendall_tau",
)
def _(v):
    return evl.kendall_tau(ballot_items(v), "list_id")


@query(
    "head_to_head", "T11",
    """SELECT list_id, CAST((SELECT 1) AS INT) * CAST(arg_min(item, ref_rank) AS INT) AS model_pick, CAST(arg_min(item, -stars * 1000 + item) AS INT) AS star_pick FROM ballot_items GROUP BY list_id""",
)
def _(v):
    items = ballot_items(v).withColumn("star_rank", -F.col("stars"))
    return evl.contenders(items, "list_id", "item", "ref_rank", "star_rank")


@query(
    "parsed_ballots", "F17",
    """WITH b AS (SELECT o_orderkey, list_distinct([CAST(o_custkey % 7 AS INT), CAST(o_orderkey % 5 AS INT), CAST(o_custkey % 7 AS INT), CAST(o_orderkey % 3 AS INT)]) AS unordered FROM orders),
p AS (SELECT o_orderkey, i, v, min(i) OVER (PARTITION BY o_orderkey, v) AS first FROM (SELECT o_orderkey, unnest([1, 2, 3]) AS i, unnest([CAST(o_custkey % 7 AS INT), CAST(o_orderkey % 5 AS INT), CAST(o_orderkey % 3 AS INT)]) AS v FROM orders)),
g AS (SELECT o_orderkey, i, v FROM p WHERE i = first AND v BETWEEN 1 AND 4 UNION ALL SELECT o.o_orderkey, 10 + n.n, n.n FROM orders o, (VALUES (1), (2), (3), (4)) n(n) WHERE n.n NOT IN (o_custkey % 7, o_orderkey % 5, o_orderkey % 3))
SELECT o_orderkey, string_agg(CAST(v - 1 AS VARCHAR), ',' ORDER BY i) AS picks FROM g GROUP BY o_orderkey""",
)
def _(v):
    """Ballot texts with repeats, words and out-of-range picks, completed to a full order of four."""
    a, b, c = (F.col("o_custkey") % 7).cast("string"), (F.col("o_orderkey") % 5).cast("string"), (F.col("o_orderkey") % 3).cast("string")
    text = F.concat(F.lit("["), a, F.lit(","), b, F.lit(","), a, F.lit(',"x",99,'), c, F.lit("]"))
    picks = sc.parse_ballot(text, F.lit(4))
    return v.raw("orders").select("o_orderkey", F.concat_ws(",", F.transform(picks, lambda x: x.cast("string"))).alias("picks"))


@query(
    "study_metrics", "A39",
    """SELECT domain, archetype, avg(ndcg) AS ndcg, avg(stars_ndcg) AS stars_ndcg, avg(pairwise_win) AS pairwise_win, count(*) AS n,
 CASE WHEN grouping(domain) = 0 AND grouping(archetype) = 0 THEN 'domain+archetype' WHEN grouping(domain) = 0 THEN 'domain' ELSE 'overall' END AS level
FROM ballots GROUP BY GROUPING SETS ((domain, archetype), (domain), ())""", rnd="ndcg stars_ndcg pairwise_win",
)
def _(v):
    return evl.metrics_by_sets(v.ballots, [["domain", "archetype"], ["domain"], []], ["ndcg", "stars_ndcg", "pairwise_win"])


@query(
    "demographic_metrics", "A40",
    """SELECT age, occupation, domain, avg(ndcg) AS ndcg, count(*) AS n, CASE WHEN grouping(age) = 0 AND grouping(occupation) = 0 THEN 'age+occupation' WHEN grouping(age) = 0 THEN 'age' WHEN grouping(occupation) = 0 THEN 'occupation'
 WHEN grouping(domain) = 0 THEN 'domain' ELSE 'overall' END AS level FROM (SELECT *, person_id % 4 AS age, person_id % 3 AS occupation FROM ballots) GROUP BY GROUPING SETS ((age), (occupation), (domain), (age, occupation), ())""",
    rnd="ndcg",
)
def _(v):
    b = v.ballots.withColumns({"age": F.col("person_id") % 4, "occupation": F.col("person_id") % 3})
    return evl.metrics_by_sets(b, [["age"], ["occupation"], ["domain"], ["age", "occupation"], []], ["ndcg"])


@query(
    "age_occupation_matrix", "A41",
    """SELECT person_id % 4 AS age, avg(CASE WHEN archetype = 'F' THEN ndcg END) AS "F", avg(CASE WHEN archetype = 'O' THEN ndcg END) AS "O", avg(CASE WHEN archetype = 'P' THEN ndcg END) AS "P" FROM ballots GROUP BY 1""",
    rnd="F O P",
)
def _(v):
    b = v.ballots.withColumn("age", F.col("person_id") % 4)
    return b.groupBy("age").pivot("archetype", ["F", "O", "P"]).agg(F.avg("ndcg"))


@query(
    "label_crosstab", "A38",
    """SELECT CASE WHEN grouping(domain) = 1 THEN 'All' ELSE domain END AS domain, CASE WHEN grouping(archetype) = 1 THEN 'All' ELSE archetype END AS archetype, count(*) AS n FROM ballots GROUP BY CUBE (domain, archetype)""",
)
def _(v):
    return st.crosstab(v.ballots, "domain", "archetype")


@query(
    "label_independence", "E20",
    """WITH c AS (SELECT domain, archetype, count(*) AS o FROM ballots GROUP BY 1, 2), e AS (SELECT c.o, r.s * k.s / CAST(t.s AS DOUBLE) AS e FROM c JOIN (SELECT domain, sum(o) AS s FROM c GROUP BY 1) r ON c.domain = r.domain
 JOIN (SELECT archetype, sum(o) AS s FROM c GROUP BY 1) k ON c.archetype = k.archetype CROSS JOIN (SELECT sum(o) AS s FROM c) t)
SELECT sum((o - e) * (o - e) / e) AS chi2, (SELECT (count(DISTINCT domain) - 1) * (count(DISTINCT archetype) - 1) FROM c) AS dof FROM e""", rnd="chi2",
)
def _(v):
    return st.chi_squared(v.ballots, "domain", "archetype").select("chi2", "dof")


@query(
    "effect_sizes", "E16 E17 E19",
    """WITH r AS (SELECT domain, is_a, rank() OVER (PARTITION BY domain ORDER BY v) + (count(*) OVER (PARTITION BY domain, v) - 1) / 2.0 AS r FROM (SELECT domain, 1 AS is_a, ndcg AS v FROM ballots UNION ALL SELECT domain, 0, stars_ndcg FROM ballots)),
u AS (SELECT domain, 2 * (sum(CASE WHEN is_a = 1 THEN r END) - sum(is_a) * (sum(is_a) + 1) / 2.0) / (CAST(sum(is_a) AS DOUBLE) * (count(*) - sum(is_a))) - 1 AS rank_biserial FROM r GROUP BY domain)
SELECT b.domain, (avg(ndcg) - avg(stars_ndcg)) / sqrt((var_samp(ndcg) + var_samp(stars_ndcg)) / 2) AS cohen_d, any_value(u.rank_biserial) AS rank_biserial, count(*) AS n, (1.959963984540054 + 0.8416212335729143) / sqrt(count(*)) AS mde
FROM ballots b JOIN u ON b.domain = u.domain GROUP BY b.domain""", rnd="cohen_d rank_biserial mde",
)
def _(v):
    b = v.ballots
    return st.cohen_d(b, "ndcg", "stars_ndcg", ["domain"]).join(st.rank_biserial(b, "ndcg", "stars_ndcg", ["domain"]), "domain").join(
        st.minimum_detectable_effect(b, ["domain"]), "domain"
    )


@query(
    "signed_rank_sums", "E13 W9",
    """WITH d AS (SELECT domain, archetype, round(ndcg - stars_ndcg, 12) AS d FROM ballots), r AS (SELECT domain, archetype, d, rank() OVER (PARTITION BY domain, archetype ORDER BY abs(d)) + (count(*) OVER (PARTITION BY domain, archetype, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)
SELECT p.domain, p.archetype, p.n_pairs, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r JOIN (SELECT domain, archetype, count(*) AS n_pairs FROM d GROUP BY 1, 2) p ON r.domain = p.domain AND r.archetype = p.archetype GROUP BY 1, 2, 3""",
    rnd="w_plus w_minus",
)
def _(v):
    return st.wilcoxon(v.ballots, "ndcg", "stars_ndcg", ["domain", "archetype"]).drop("z", "p")


@query("signed_rank_tests", "E13")
def _(v):
    return st.wilcoxon(v.ballots, "ndcg", "stars_ndcg", ["domain", "archetype"], zeros="split")


@query(
    "adjusted_p_values", "E18 W8",
    """WITH p AS (SELECT p_partkey, (p_partkey * 37 % 1000) / 1000.0 + 0.001 AS p FROM part), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_partkey) AS raw FROM p)
SELECT p_partkey, p, LEAST(1.0, min(raw) OVER (ORDER BY p DESC, p_partkey DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM r""", rnd="p p_adjusted",
)
def _(v):
    df = v.raw("part").select("p_partkey", (F.col("p_partkey") * 37 % 1000 / F.lit(1000.0) + 0.001).alias("p"))
    return st.benjamini_hochberg(df, "p", "p_partkey")


@query(
    "average_ranks", "W9",
    "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000)) + (count(*) OVER (PARTITION BY o_orderstatus, floor(o_totalprice / 1000)) - 1) / 2.0 AS rank FROM orders", rnd="rank",
)
def _(v):
    o = v.raw("orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("k"))
    return st.avg_rank(o, "k", ["o_orderstatus"]).select("o_orderkey", "rank")


@query(
    "sequential_ranks", "W3",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS overall FROM orders",
)
def _(v):
    from footfall.operators.scale import number_rows

    o = v.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return number_rows(number_rows(o, order, ["o_orderstatus"], "place"), order, name="overall").select("o_orderkey", "place", "overall")


@query("kappa", "E21",
    """SELECT domain, count(*) AS n, (avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))) / (1 - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))) AS kappa
FROM (SELECT domain, pairwise_win AS a, CAST(persona_id % 2 AS INT) AS b FROM ballots) GROUP BY domain""", rnd="kappa")
def _(v):
    b = v.ballots.withColumn("other", (F.col("persona_id") % 2).cast("int"))
    return st.cohen_kappa(b, "pairwise_win", "other", ["domain"])


@query(
    "run_agreement", "E22",
    f"""WITH l AS (SELECT domain, archetype, persona_id, ndcg, pairwise_win AS c FROM ballots), r AS (SELECT domain, archetype, persona_id, stars_ndcg AS ndcg, CAST(persona_id % 2 AS INT) AS c FROM ballots),
s AS (SELECT l.domain, l.archetype, l.ndcg AS x, r.ndcg AS y, l.c AS a, r.c AS b FROM l JOIN r ON l.domain = r.domain AND l.archetype = r.archetype AND l.persona_id = r.persona_id),
k AS (SELECT domain, archetype, count(*) AS n_shared, avg(x) AS mean_a, avg(y) AS mean_b, (avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))) / (1 - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))) AS kappa FROM s GROUP BY 1, 2),
q AS (SELECT domain, archetype, corr(rx, ry) AS rho FROM (SELECT domain, archetype, rank() OVER (PARTITION BY domain, archetype ORDER BY x) + (count(*) OVER (PARTITION BY domain, archetype, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY domain, archetype ORDER BY y) + (count(*) OVER (PARTITION BY domain, archetype, y) - 1) / 2.0 AS ry FROM s) GROUP BY 1, 2)
SELECT k.domain, k.archetype, k.mean_a, k.mean_b, k.n_shared, k.kappa, q.rho, k.mean_b - k.mean_a AS delta, k.kappa > 0.4 AND abs(k.mean_b - k.mean_a) < 0.02 AS agrees FROM k JOIN q ON k.domain = q.domain AND k.archetype = q.archetype""",
    rnd="mean_a mean_b kappa rho delta",
)
def _(v):
    left = v.ballots.select("domain", "archetype", "persona_id", "ndcg", F.col("pairwise_win").alias("c"))
    right = v.ballots.select("domain", "archetype", "persona_id", F.col("stars_ndcg").alias("ndcg"), (F.col("persona_id") % 2).cast("int").alias("c"))
    return st.agreement(left, right, "persona_id", ["domain", "archetype"], "ndcg", "c")


@query(
    "revisit_calibration", "E23 E14",
    """SELECT domain, corr(rx, ry) AS spearman_r, count(*) AS n, corr(x, y) AS pearson_r FROM (SELECT domain, x, y, rank() OVER (PARTITION BY domain ORDER BY x) + (count(*) OVER (PARTITION BY domain, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY domain ORDER BY y) + (count(*) OVER (PARTITION BY domain, y) - 1) / 2.0 AS ry FROM (SELECT domain, revisit_score / 10 AS x, model_revisit_signal AS y FROM ballots)) GROUP BY domain""",
    rnd="spearman_r pearson_r",
)
def _(v):
    return st.calibration(v.ballots, ["domain"])


@query(
    "cross_domain_consistency", "E24",
    """SELECT corr(x, y) AS cross_domain_corr, count(*) AS n_shared FROM (SELECT person_id, avg(CASE WHEN domain = '1-URGENT' THEN ndcg END) AS x, avg(CASE WHEN domain = '2-HIGH' THEN ndcg END) AS y FROM ballots GROUP BY 1) WHERE x IS NOT NULL AND y IS NOT NULL""",
    rnd="cross_domain_corr",
)
def _(v):
    return st.cross_domain(v.ballots, "person_id", "domain", "ndcg", "1-URGENT", "2-HIGH")


@query(
    "loyalty_premium", "E24",
    "SELECT domain, avg(CASE WHEN archetype = 'F' THEN ndcg END) AS loyal_mean, avg(CASE WHEN archetype <> 'F' THEN ndcg END) AS other_mean, avg(CASE WHEN archetype = 'F' THEN ndcg END) - avg(CASE WHEN archetype <> 'F' THEN ndcg END) AS premium FROM ballots GROUP BY 1",
    rnd="loyal_mean other_mean premium",
)
def _(v):
    return st.premium(v.ballots, "domain", "archetype", "ndcg", "F")


@query(
    "repeat_plan", "E25",
    "SELECT domain, archetype, count(*) AS n, stddev_samp(ndcg) AS std, CAST(GREATEST(1, ceil(pow(1.96 * stddev_samp(ndcg) / 0.005, 2))) AS BIGINT) AS repeats FROM ballots GROUP BY 1, 2", rnd="std",
)
def _(v):
    return st.variance_plan(v.ballots, "ndcg", ["domain", "archetype"])


@query(
    "calibration_line", "E32",
    "SELECT domain, regr_slope(revisit_score, model_revisit_signal) AS slope, regr_intercept(revisit_score, model_revisit_signal) AS intercept FROM ballots GROUP BY 1", rnd="slope intercept",
)
def _(v):
    return st.linear_fit(v.ballots, "model_revisit_signal", "revisit_score", ["domain"])


@query(
    "correlation_grid", "E14",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, rho, n FROM ({SPEARMAN.format(src=f'SELECT {a} AS x, {b} AS y FROM ballots')})" for a in ("ndcg", "stars_ndcg") for b in ("revisit_score", "model_revisit_signal")
    ),
    rnd="rho",
)
def _(v):
    return st.correlation_grid(v.ballots, "persona_id", ["ndcg", "stars_ndcg"], ["revisit_score", "model_revisit_signal"]).drop("p")


@query(
    "notable_correlations", "E14",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, rho, n FROM ({SPEARMAN.format(src=f'SELECT {a} AS x, {b} AS y FROM ballots')})" for a in ("ndcg", "stars_ndcg") for b in ("revisit_score", "model_revisit_signal", "ndcg")
    ) + ") WHERE n > 50 AND abs(rho) > 0.05",
    rnd="rho",
)
def _(v):
    """Correlations of enough pairs that are large enough to speak of."""
    grid = st.correlation_grid(v.ballots, "persona_id", ["ndcg", "stars_ndcg"], ["revisit_score", "model_revisit_signal", "ndcg"])
    return st.notable_correlations(grid).drop("p")


# The words expected of each part type for its name, its brand and its own label.
ANSWER_WORDS = {
    "ECONOMY": (("red", "blue"), ("1",), ("o",)), "STANDARD": (("ring",), ("2", "3"), ("x",)), "MEDIUM": (("small", "bolt"), ("4",), ("m",)),
    "PROMO": (("widget",), ("5", "6"), ("p",)), "LARGE": (("large", "red"), ("7",), ("z",)),
}


def _named_sql() -> str:
    def one(words, column):
        return "CAST(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + " AS INT)"

    cases = " ".join(f"WHEN '{k}' THEN " + " + ".join(one(w, c) for w, c in zip(per, ("p_name", "p_brand", "p_type"))) for k, per in ANSWER_WORDS.items())
    return f"SELECT p_type, CASE WHEN CASE p_type {cases} ELSE 0 END >= 2 THEN 1 ELSE 0 END AS authentic FROM part"


view("marked_answers", _named_sql())


def part_answers(v):
    return v.raw("part").select("p_type", "p_name", "p_brand", F.col("p_type").alias("answer")), ANSWER_WORDS, "p_type", ["p_name", "p_brand", "answer"]


@query(
    "answer_authenticity", "E34 F18",
    "SELECT p_type, avg(authentic) AS share, CAST(sum(authentic) AS BIGINT) AS n_authentic, count(*) AS n FROM marked_answers GROUP BY 1", rnd="share",
)
def _(v):
    return evl.authenticity(*part_answers(v))


# Fixed value: what chi-squared with five degrees of freedom exceeds with a chance of 5 %; the six part types have as many.
CHI2_5 = 11.070497693516351


@query(
    "manipulation_verdict", "E34 E20",
    f"""WITH c AS (SELECT p_type, authentic, count(*) AS o FROM marked_answers GROUP BY 1, 2), m AS (SELECT *, CAST(o AS DOUBLE) * o / (sum(o) OVER (PARTITION BY p_type) * CAST(sum(o) OVER (PARTITION BY authentic) AS DOUBLE)) AS s FROM c),
 x AS (SELECT CAST(sum(o) AS DOUBLE) * (sum(s) - 1) AS chi2, (count(DISTINCT p_type) - 1) * (count(DISTINCT authentic) - 1) AS dof FROM m) SELECT chi2, dof, dof = 5 AND chi2 > {CHI2_5} AS told_apart FROM x""",
    rnd="chi2", digits=5,
)
def _(v):
    """Whether the part types differ in how often the expected words are named."""
    return evl.manipulation_verdict(*part_answers(v)).drop("p")


@query(
    "table_summary", "A36",
    """SELECT count(*) AS "rows", avg(o_totalprice) AS o_totalprice_mean, stddev_samp(o_totalprice) AS o_totalprice_std, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, quantile_cont(o_totalprice, 0.25) AS o_totalprice_p25,
 median(o_totalprice) AS o_totalprice_p50, quantile_cont(o_totalprice, 0.75) AS o_totalprice_p75 FROM orders""",
    rnd="o_totalprice_mean o_totalprice_std o_totalprice_p25 o_totalprice_p50 o_totalprice_p75", digits=4,
)
def _(v):
    return st.summary(v.raw("orders"), ["o_totalprice"])
