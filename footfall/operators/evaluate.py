"""Offline evaluation of rankings: lists, NDCG, hits, venue-level agreement and method tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalar import ratio
from footfall.operators.events import overlap_users
from footfall.operators.scale import attach, lookup_join, scalar, top_k
from footfall.operators.stats import bootstrap_ci, chi_squared, rows, spearman, wilcoxon
from footfall.session import settle

KS = (5, 10, 20)


def visited_pairs(inter: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Distinct (user, venue) of known users, optionally of the given users only."""
    pairs = inter.where(F.col("user_id").isNotNull()).select("user_id", "business_id").distinct()
    return pairs if users is None else pairs.join(users.select("user_id"), "user_id", "left_semi")


def split_pairs(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test pairs of the users seen on both sides."""
    users = overlap_users(train, test)
    return visited_pairs(train, users), visited_pairs(test, users)


def rerank(
    train_pairs: DataFrame, test_pairs: DataFrame, scores: DataFrame, by: Sequence[str] = (), min_candidates: int = 2
) -> DataFrame:
    """Each user's known venues in score order (missing score 0, ties by venue), marked when visited later.

    ``scores`` is (by..., business_id, score), or has user_id too for personal scores. Columns: by, user_id,
    business_id, position, rel, n_candidates, n_relevant.
    """
    by = list(by)
    seen = test_pairs.withColumn("rel", F.lit(1))
    marked = train_pairs.join(seen, ["user_id", "business_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    if by:
        # A handful of method labels, read from the scores and attached to every candidate as one array.
        labels = scores.select(F.struct(*by).alias("m")).distinct().agg(F.collect_set("m").alias("ms"))
        marked = marked.withColumn("m", F.explode(scalar(labels))).select("*", *[F.col("m")[c].alias(c) for c in by]).drop("m")
    on = [*by, *[c for c in ("user_id", "business_id") if c in scores.columns]]
    scored = lookup_join(marked, scores.select(*on, "score"), on, "left") if "user_id" not in on else marked.join(
        scores.select(*on, "score"), on, "left"
    )
    scored = scored.withColumn("score", F.coalesce("score", F.lit(0.0)))
    # A user's list holds distinct venues, so its length is bounded by the number of venues.
    per = Window.partitionBy("user_id", *by)
    order = per.orderBy(F.col("score").desc(), F.col("business_id"))
    return scored.select(
        *by,
        "user_id",
        "business_id",
        F.row_number().over(order).alias("position"),
        "rel",
        F.count(F.lit(1)).over(per).alias("n_candidates"),
        F.sum("rel").over(per).alias("n_relevant"),
    ).where(F.col("n_candidates") >= min_candidates)


def _discount(position: Column) -> Column:
    return F.lit(1.0) / F.log2(position + 1)


def ideal_dcg(hits: Column, k: int) -> Column:
    """DCG of ``hits`` relevant items on the first places, from the table of partial sums up to k."""
    import math

    sums = [0.0]
    for i in range(1, k + 1):
        sums.append(sums[-1] + 1 / math.log2(i + 1))
    return F.element_at(F.array(*[F.lit(s) for s in sums]), F.least(hits, F.lit(k)).cast("int") + 1)


def user_metrics(lists: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = KS, ideal: str = "candidates") -> DataFrame:
    """NDCG@k and Hit@k per list for every k in one aggregation.

    ``slice``: the ideal re-sorts the first k places. ``candidates``: it uses all relevant candidates.
    """
    aggs = []
    for k in ks:
        top = F.col("position") <= k
        dcg = F.sum(F.when(top & (F.col("rel") == 1), _discount(F.col("position"))).otherwise(F.lit(0.0)))
        found = F.sum(F.when(top, F.col("rel")).otherwise(0))
        goal = found if ideal == "slice" else F.max("n_relevant")
        aggs.append(ratio(dcg, ideal_dcg(goal, k), 0.0).alias(f"ndcg_{k}"))
        aggs.append((found > 0).cast("double").alias(f"hit_{k}"))
    return lists.groupBy(*by, "user_id").agg(*aggs)


def mean_metrics(per_user: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = KS) -> DataFrame:
    cols = [c for k in ks for c in (f"ndcg_{k}", f"hit_{k}")]
    return per_user.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols], rows().alias("n_users"))


def eval_global(scores: DataFrame, test_pairs: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = KS, ideal: str = "slice") -> DataFrame:
    """One list for all users. ``actual`` takes the ideal from min(k, venues the user went to)."""
    by = list(by)
    order = [F.col("score").desc(), F.col("business_id")]
    # At most max(ks) rows per method.
    head = F.broadcast(top_k(scores, max(ks), order, by, "position").select(*by, "business_id", "position"))
    users = test_pairs.groupBy("user_id").agg(rows().alias("n_actual"))
    met = test_pairs.join(head, "business_id").join(users, "user_id")
    aggs = []
    for k in ks:
        top = F.col("position") <= k
        found = F.count_if(top)
        dcg = F.sum(F.when(top, _discount(F.col("position"))).otherwise(F.lit(0.0)))
        goal = found if ideal == "slice" else F.max("n_actual")
        aggs += [ratio(dcg, ideal_dcg(goal, k), 0.0).alias(f"ndcg_{k}"), (found > 0).cast("double").alias(f"hit_{k}")]
    per = met.groupBy(*by, "user_id").agg(*aggs)
    n = scalar(users.agg(rows().alias("n")))
    # Users who went to none of the listed venues add zeros.
    means = [ratio(F.sum(c), n, 0.0).alias(c) for k in ks for c in (f"ndcg_{k}", f"hit_{k}")]
    return per.groupBy(*by).agg(*means).withColumn("n_users", n)


def topk_overlap(a: DataFrame, b: DataFrame, ks: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """Share of common venues in the two top-k lists, per k."""
    k_max = max(ks)
    # Two lists of at most max(ks) rows.
    left, right = (
        top_k(x, k_max, [F.col("score").desc(), F.col("business_id")], rank=r).select("business_id", r)
        for x, r in ((a, "ra"), (b, "rb"))
    )
    both = left.join(F.broadcast(right), "business_id")
    wide = both.agg(*[(F.count_if((F.col("ra") <= k) & (F.col("rb") <= k)) / F.lit(float(k))).alias(f"overlap_{k}") for k in ks])
    return wide


def eval_venue(scores: DataFrame, test_pairs: DataFrame, ks: Sequence[int] = (10, 20, 50), min_common: int = 10, p_value: bool = False) -> DataFrame:
    """Scores against future distinct visitors: Spearman rho and the overlap of both top-k lists."""
    visitors = test_pairs.groupBy("business_id").agg(rows().alias("visitors"))
    common = scores.select("business_id", "score").join(visitors, "business_id")
    rho = spearman(common, "score", "visitors", p_value=p_value)
    rho = rho.withColumn("rho", F.when(F.col("n") >= min_common, F.col("rho")))
    overlap = topk_overlap(common, common.select("business_id", F.col("visitors").alias("score")), ks)
    overlap = attach(overlap, common.agg(rows().alias("_n")), [])
    overlap = overlap.select(*[F.when(F.col("_n") >= k, F.col(f"overlap_{k}")).alias(f"overlap_{k}") for k in ks])
    return attach(rho, overlap, [])


def eval_by_segment(per_user: DataFrame, segments: DataFrame, by: Sequence[str] = (), metric: str = "ndcg_10") -> DataFrame:
    """Mean, population deviation and users per segment; users without segment are 'Unknown'."""
    joined = per_user.join(segments.select("user_id", "segment"), "user_id", "left")
    return joined.groupBy(*by, F.coalesce("segment", F.lit("Unknown")).alias("segment")).agg(
        F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), rows().alias("n_users")
    )


def eval_subset(train_pairs: DataFrame, test_pairs: DataFrame, scores: DataFrame, venues: DataFrame, k: int = 10) -> DataFrame:
    """Metrics when both sides keep only the given venues (slice ideal)."""
    keep = venues.select("business_id").distinct()
    tr, te = (p.join(keep, "business_id", "left_semi") for p in (train_pairs, test_pairs))
    lists = rerank(tr, te.join(tr.select("user_id").distinct(), "user_id", "left_semi"), scores)
    with_future = te.select("user_id").distinct()
    per = user_metrics(lists.join(with_future, "user_id", "left_semi"), ks=(k,), ideal="slice")
    return mean_metrics(per, ks=(k,))


# ---------------------------------------------------------------- ballots


def ballot_metrics(items: DataFrame, list_key: str, position: str = "position", ref_rank: str = "ref_rank", k: int = 10) -> DataFrame:
    """Per list: graded NDCG with relevance 1 / log2(rank + 1), hits of the reference top 3 in the first 1, 3, 5, 10."""
    rel = F.lit(1.0) / F.log2(F.col(ref_rank) + 1)
    dcg = F.sum(F.when(F.col(position) <= k, rel / F.log2(F.col(position) + 1)).otherwise(F.lit(0.0)))
    best = F.sum(F.when(F.col(ref_rank) <= k, rel / F.log2(F.col(ref_rank) + 1)).otherwise(F.lit(0.0)))
    hits = [
        F.max(((F.col(position) <= h) & (F.col(ref_rank) <= 3)).cast("int")).alias(f"hit_at_{h}") for h in (1, 3, 5, 10)
    ]
    return items.groupBy(list_key).agg(ratio(dcg, best, 0.0).alias("ndcg"), *hits)


def kendall_tau(items: DataFrame, list_key: str, position: str = "position", ref_rank: str = "ref_rank") -> DataFrame:
    """Tau-b per ballot. A ballot is one person's short list, so it is compared inside its own array."""
    arr = F.sort_array(F.collect_list(F.struct(F.col(position).cast("double").alias("p"), F.col(ref_rank).cast("double").alias("r"))))
    lists = items.groupBy(list_key).agg(arr.alias("a"))

    def over_pairs(term):
        """Sum of ``term`` over all pairs of places of the list."""
        def row(x, i):
            rest = F.slice("a", i + 2, F.size("a"))
            return F.aggregate(rest, F.lit(0.0), lambda acc, y: acc + term(x, y))

        return F.aggregate(F.transform("a", row), F.lit(0.0), lambda acc, v: acc + v)

    sign = over_pairs(lambda x, y: F.signum((x["p"] - y["p"]) * (x["r"] - y["r"])))
    moved_p = over_pairs(lambda x, y: (x["p"] != y["p"]).cast("double"))
    moved_r = over_pairs(lambda x, y: (x["r"] != y["r"]).cast("double"))
    out = lists.select(list_key, sign.alias("s"), moved_p.alias("np"), moved_r.alias("nr"))
    return out.select(list_key, F.try_divide("s", F.sqrt(F.col("np") * F.col("nr"))).alias("kendall_tau"))


def star_comparator(items: DataFrame, list_key: str, stars: str, ref_rank: str, item: str) -> DataFrame:
    """The same ballot metrics for the order by stars (ties by item)."""
    order = Window.partitionBy(list_key).orderBy(F.col(stars).desc(), F.col(item))
    placed = items.withColumn("position", F.row_number().over(order))
    return ballot_metrics(placed, list_key, "position", ref_rank)


def contenders(items: DataFrame, list_key: str, item: str, model_rank: str, star_rank: str) -> DataFrame:
    """Head to head per list: the best item by model rank and the best by star rank."""
    return items.groupBy(list_key).agg(
        F.min_by(item, F.struct(F.col(model_rank), F.col(item))).alias("model_pick"),
        F.min_by(item, F.struct(F.col(star_rank), F.col(item))).alias("star_pick"),
    )


def metrics_by_sets(ballots: DataFrame, sets: Sequence[Sequence[str]], measures: Sequence[str]) -> DataFrame:
    """Mean of each measure and row count per grouping set; a column outside the set is NULL and ``level`` names it."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    grouped = ballots.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    out = grouped.agg(*[F.avg(m).alias(m) for m in measures], rows().alias("n"), F.grouping_id(*cols).alias("_g"))
    level = F.lit("overall")
    for s in sets:
        if s:
            mask = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s)
            level = F.when(F.col("_g") == mask, F.lit("+".join(s))).otherwise(level)
    return out.withColumn("level", level).drop("_g")


def mark_authentic(
    answers: DataFrame, signals: dict[str, Sequence[Sequence[str]]], segment: str, columns: Sequence[str], need: int = 2
) -> DataFrame:
    """Add ``authentic`` (0/1): the answers name, for at least ``need`` questions, one of the words expected from
    the segment there (``signals``: segment -> one word list per question). Unknown segments have no words."""

    def named(i, column):
        lists = [(k, per[i]) for k, per in signals.items() if i < len(per)]
        table = F.create_map(*[x for k, ws in lists for x in (F.lit(k), F.array(*[F.lit(w.lower()) for w in ws]))])
        words = F.coalesce(F.try_element_at(table, F.col(segment)), F.array().cast("array<string>"))
        said = F.lower(F.coalesce(F.col(column), F.lit("")))
        return F.exists(words, lambda w: F.contains(said, w)).cast("int")

    hits = sum((named(i, c) for i, c in enumerate(columns)), F.lit(0))
    return answers.withColumn("authentic", (hits >= need).cast("int"))


def authenticity(
    answers: DataFrame, signals: dict[str, Sequence[Sequence[str]]], segment: str, columns: Sequence[str], need: int = 2
) -> DataFrame:
    """Share per segment of authentic rows (see :func:`mark_authentic`)."""
    marked = mark_authentic(answers, signals, segment, columns, need)
    return marked.groupBy(segment).agg(
        F.avg("authentic").alias("share"), F.sum("authentic").alias("n_authentic"), rows().alias("n")
    )


def manipulation_verdict(
    answers: DataFrame, signals: dict[str, Sequence[Sequence[str]]], segment: str, columns: Sequence[str], need: int = 2, level: float = 0.05
) -> DataFrame:
    """One row: chi-squared of authenticity against segments, dof, p, and ``told_apart``: the segments' shares differ at ``level``.

    With one segment, or when all or no rows are authentic, there is nothing to test: chi2 is null and the verdict false.
    """
    marked = mark_authentic(answers, signals, segment, columns, need)
    tested = chi_squared(marked, segment, "authentic")
    return tested.withColumn("told_apart", F.coalesce((F.col("dof") > 0) & (F.col("p") < level), F.lit(False)))


# ---------------------------------------------------------------- method tables


def method_table(per_user: DataFrame, reference: str, replicates: int = 1000, metric: str = "ndcg_10", ks: Sequence[int] = KS) -> DataFrame:
    """One row per method: metrics, interval, p against the best method, difference to a reference method.

    Users are aligned by id: every method is compared on the users it shares with the best one. ``per_user`` is made once and read by
    each part, as are the means, one row per method.
    """
    per_user = settle(per_user.select("method", "user_id", *dict.fromkeys([c for k in ks for c in (f"ndcg_{k}", f"hit_{k}")] + [metric])))
    means = settle(mean_metrics(per_user, ["method"], ks))
    best = means.agg(F.min_by("method", F.struct(-F.col(metric), F.col("method"))).alias("best"))
    ci = bootstrap_ci(per_user, metric, ["method"], replicates).select("method", "ci_lo", "ci_hi")
    top = per_user.where(F.col("method") == scalar(best)).select("user_id", F.col(metric).alias("_top"))
    paired = per_user.select("method", "user_id", metric).join(top, "user_id")
    p = wilcoxon(paired, "_top", metric, ["method"]).select("method", F.col("p").alias("p_vs_best"))
    base = scalar(means.where(F.col("method") == reference).agg(F.first(metric).alias("m")))
    out = means.join(ci, "method").join(p, "method")
    return out.withColumn("delta", F.col(metric) - base).withColumn("delta_pct", 100 * ratio(F.col(metric) - base, base))


def long_metrics(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return table.select("method", F.explode(pairs).alias("x")).select("method", "x.metric", "x.value")


def winners(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Winner, runner-up and margin per metric."""
    two = top_k(long_metrics(table, metrics), 2, [F.col("value").desc(), F.col("method")], ["metric"], "place")
    first, second = F.col("place") == 1, F.col("place") == 2
    out = two.groupBy("metric").agg(
        F.max(F.when(first, F.col("method"))).alias("winner"),
        F.max(F.when(first, F.col("value"))).alias("winner_value"),
        F.max(F.when(second, F.col("method"))).alias("runner_up"),
        F.max(F.when(second, F.col("value"))).alias("runner_up_value"),
    )
    return out.withColumn("margin", F.col("winner_value") - F.col("runner_up_value"))


def lift_over(table: DataFrame, metrics: Sequence[str], base: str) -> DataFrame:
    """Percent lift of every method over a base method, with the metrics each method wins."""
    long = long_metrics(table, metrics)
    ref = long.where(F.col("method") == base).select("metric", F.col("value").alias("_b"))
    won = winners(table, metrics).groupBy(F.col("winner").alias("method")).agg(rows().alias("wins"))
    lifts = long.join(F.broadcast(ref), "metric").withColumn("lift_pct", 100 * ratio(F.col("value") - F.col("_b"), "_b")).drop("_b")
    return lifts.join(won, "method", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def k_trend(table: DataFrame, prefix: str = "ndcg", ks: Sequence[int] = KS) -> DataFrame:
    """Rows (method, k, value)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"{prefix}_{k}").alias("value")) for k in ks])
    return table.select("method", F.explode(pairs).alias("x")).select("method", "x.k", "x.value")


def ablation_deltas(table: DataFrame, base: str, metrics: Sequence[str]) -> DataFrame:
    """Difference of each variant to the base variant, with the best variant by the first metric marked."""
    ref = table.where(F.col("method") == base)
    out = table
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.col(m) - scalar(ref.agg(F.first(m).alias("m"))))
    best = table.agg(F.min_by("method", F.struct(-F.col(metrics[0]), F.col("method"))).alias("b"))
    return out.withColumn("is_best", F.col("method") == scalar(best))


def strongest_weakest(by_segment: DataFrame, method: str = "method") -> DataFrame:
    """Per method: the segments with the highest and the lowest mean."""
    return by_segment.groupBy(method).agg(
        F.min_by("segment", F.struct(-F.col("mean"), F.col("segment"))).alias("strongest"),
        F.min_by("segment", F.struct(F.col("mean"), F.col("segment"))).alias("weakest"),
    )
