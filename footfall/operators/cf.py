"""Collaborative filtering: item similarities, factor models, closed-form item weights and score blends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalar import ratio
from footfall.operators.clean import minmax
from footfall.operators.scale import hot_keys, lookup_join, number_rows, portable_hash, scalar, small_enough, spread_join, top_k
from footfall.session import settle


def rows() -> Column:
    return F.count(F.lit(1))


# ---------------------------------------------------------------- item similarity


def baskets(edges: DataFrame, *columns: str) -> DataFrame:
    """(user_id, items): the distinct items of a user in one row, so at most as many as there are items."""
    items = F.collect_list(F.struct(F.col("business_id").alias("i"), *columns))
    return edges.groupBy("user_id").agg(F.filter(items, lambda x: x["i"].isNotNull()).alias("items"))


def item_cosines(edges: DataFrame) -> DataFrame:
    """(i, j, similarity) in both directions for items with common users.

    A user's items travel as one list to each of them, and pairs are made and added up where ``j`` lies, so that none is shuffled. The
    lists of a hot ``j`` are cut by ``i`` into pieces that lie apart.
    """
    return item_vectors(edges).select(F.col("business_id").alias("j"), F.explode(F.arrays_zip("ids", "values")).alias("x")).select(
        F.col("x.ids").alias("i"), "j", F.col("x.values").alias("similarity")
    )


def item_vectors(edges: DataFrame) -> DataFrame:
    """(business_id, ids, values): the similarities of an item to the others, ids ascending; a hot item has several rows, each other item in one."""
    norms = edges.groupBy("business_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    norms = norms.withColumn("norm", F.when(F.col("norm") == 0, F.lit(1.0)).otherwise(F.col("norm")))
    hot = F.broadcast(hot_keys(edges, ["business_id"]))
    sent = baskets(edges, "weight").select("items", F.explode("items").alias("own")).select(F.col("own.i").alias("business_id"), F.col("own.weight").alias("w"), "items")
    pieces = F.coalesce("pieces", F.lit(1))
    sent = sent.join(hot, "business_id", "left").withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    part = F.filter("items", lambda x: (x["i"] != F.col("business_id")) & (F.pmod(F.xxhash64(x["i"]), F.col("pieces")) == F.col("piece")))
    # Weights travel as they are, mostly small whole numbers; norms divide the sums.
    dealt = sent.select("business_id", "piece", "w", part.alias("items")).repartition("business_id", "piece")
    met = dealt.select("business_id", "piece", "w", F.explode("items").alias("x"))
    sums = met.groupBy("business_id", "piece", F.col("x.i").alias("i")).agg(F.sum(F.col("w") * F.col("x.weight")).alias("s"))
    scaled = lookup_join(lookup_join(sums, norms.select(F.col("business_id").alias("i"), F.col("norm").alias("norm_i")), ["i"]), norms, ["business_id"])
    rows_ = scaled.groupBy("business_id", "piece").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("s") / (F.col("norm") * F.col("norm_i"))).alias("v")))).alias("x"))
    return rows_.select("business_id", F.col("x.i").alias("ids"), F.col("x.v").alias("values"))


def item_knn(edges: DataFrame, k: int = 30) -> DataFrame:
    """Venue score: mean of its k largest similarities; missing ones are 0, and with at most k venues all count."""
    best = top_k(item_cosines(edges), k, [F.col("similarity").desc(), F.col("j")], ["i"])
    sums = best.groupBy(F.col("i").alias("business_id")).agg(F.sum("similarity").alias("s"))
    venues = edges.select("business_id").distinct()
    n = scalar(venues.agg(rows().alias("n")))
    return venues.join(sums, "business_id", "left").select(
        "business_id", (F.coalesce("s", F.lit(0.0)) / F.least(n, F.lit(k))).alias("score")
    )


def item_knn_personal(edges: DataFrame, candidates: DataFrame, cosines: DataFrame | None = None) -> DataFrame:
    """(user, venue, score): summed similarity of a candidate to the user's venues, itself included with 1. Candidates are distinct pairs.

    The user's venues travel as one list to each candidate, where its similarities lie in one vector; only lists and vectors are
    shuffled, not their products. The users of a hot candidate are cut into pieces, each with a copy of the vector.
    """
    if cosines is None:
        vectors = item_vectors(edges)
    else:
        vectors = cosines.groupBy(F.col("j").alias("business_id")).agg(F.sort_array(F.collect_list(F.struct("i", F.col("similarity").alias("v")))).alias("x"))
        vectors = vectors.select("business_id", F.col("x.i").alias("ids"), F.col("x.v").alias("values"))
    wanted = candidates.select("user_id", "business_id")
    asked = spread_join(wanted, baskets(edges).select("user_id", F.col("items.i").alias("ids")), ["user_id"])
    hot = F.broadcast(hot_keys(wanted, ["business_id"]))
    pieces = F.coalesce("pieces", F.lit(1))
    asked = asked.join(hot, "business_id", "left").select(
        "business_id", F.pmod(F.xxhash64("user_id"), pieces).cast("int").alias("piece"), F.lit(1).alias("side"), "user_id", "ids", F.lit(None).cast("array<double>").alias("values")
    )
    held = vectors.join(hot, "business_id", "left").select(
        "business_id", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.lit(0).alias("side"), F.lit(None).cast(asked.schema["user_id"].dataType).alias("user_id"), "ids", "values"
    )
    met = held.unionByName(asked).repartition("business_id", "piece").sortWithinPartitions("business_id", "piece", "side")
    def fit(batches):
        """Scores of the rows of side 1, given the vector parts of side 0 before them; rows come by venue, piece and side."""
        import numpy as np
        import pyarrow as pa

        at, ids, values = None, None, None
        for batch in batches:
            venue, piece, side, users, lists, sims = batch.columns
            keys = list(zip(venue.to_pylist(), piece.to_pylist(), side.to_pylist()))
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]) if keys else ():
                if keys[a][:2] != at:
                    at, ids, values = keys[a][:2], np.array([]), np.array([])
                flat = lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                if keys[a][2] == 0:
                    both = np.concatenate([values, sims.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)])
                    flat = np.concatenate([ids, flat]) if len(ids) else flat
                    order = np.argsort(flat, kind="stable")
                    ids, values = flat[order], both[order]
                    continue
                found = np.zeros(len(flat))
                if len(ids):
                    place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
                    found = np.where(ids[place] == flat, values[place], 0.0)
                found[flat == at[0]] = 1.0
                sizes = lists.slice(a, b - a).value_lengths().to_numpy()
                scores = np.bincount(np.repeat(np.arange(b - a), sizes), weights=found, minlength=b - a)
                out.append(pa.RecordBatch.from_arrays([users.slice(a, b - a), venue.slice(a, b - a), pa.array(scores)], names=["user_id", "business_id", "score"]))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    types = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    return met.mapInArrow(fit, f"user_id {types['user_id']}, business_id {types['business_id']}, score double")


# ---------------------------------------------------------------- factor models


def _dense_ids(edges: DataFrame, column: str, name: str) -> DataFrame:
    return number_rows(edges.select(column).distinct(), [F.col(column)], name=name).withColumn(name, F.col(name).cast("int"))


def als_factors(edges: DataFrame, rank: int = 64, iterations: int = 30, reg: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Implicit-feedback factors of users and venues: (user_id, factors), (business_id, factors)."""
    from pyspark.ml.recommendation import ALS

    users, venues = settle(_dense_ids(edges, "user_id", "u")), settle(_dense_ids(edges, "business_id", "v"))
    data = lookup_join(lookup_join(edges, users, ["user_id"]), venues, ["business_id"]).select("u", "v", F.col("weight").cast("float").alias("r"))
    model = ALS(
        rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=True, userCol="u", itemCol="v", ratingCol="r", seed=seed,
        checkpointInterval=5,
    ).fit(settle(data))
    uf = model.userFactors.join(users, F.col("id") == F.col("u")).select("user_id", F.col("features").cast("array<double>").alias("factors"))
    vf = model.itemFactors.join(venues, F.col("id") == F.col("v")).select("business_id", F.col("features").cast("array<double>").alias("factors"))
    return uf, vf


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def pair_scores(pairs: DataFrame, user_factors: DataFrame, venue_factors: DataFrame) -> DataFrame:
    """Factor product per (user, venue); 0 when either is unknown to the model."""
    u = user_factors.select("user_id", F.col("factors").alias("_u"))
    v = venue_factors.select("business_id", F.col("factors").alias("_v"))
    out = lookup_join(pairs.join(u, "user_id", "left"), v, ["business_id"], "left")
    return out.select("user_id", "business_id", F.coalesce(dot(F.col("_u"), F.col("_v")), F.lit(0.0)).alias("score"))


def global_scores(user_factors: DataFrame, venue_factors: DataFrame, rank: int) -> DataFrame:
    """Venue score for the average user."""
    mean = user_factors.agg(F.array(*[F.avg(F.col("factors")[i]) for i in range(rank)]).alias("m"))
    return venue_factors.withColumn("_m", scalar(mean)).select("business_id", dot(F.col("factors"), F.col("_m")).alias("score"))


# Rank by which the venues that may travel are counted.
FULL_RANK = 64


def bpr_factors(
    edges: DataFrame, rank: int = 64, epochs: int = 30, rate: float = 0.05, reg: float = 0.01, seed: int = 42, max_broadcast: int = 200_000
) -> tuple[DataFrame, DataFrame]:
    """Pairwise-ranking factors. Every epoch draws, by hash, one venue the user has not been to for each known pair,
    and moves all factors along the summed gradients of that epoch. Gradients are added up before they travel.

    Venues travel to every task while their factors are as many numbers as ``max_broadcast`` venues of ``FULL_RANK`` have; then a user's venues
    are one list, met by the user's factors, and no pair is shuffled."""
    pos = settle(edges.select("user_id", "business_id").distinct())
    items = settle(number_rows(pos.select("business_id").distinct(), [F.col("business_id")], name="pos"))
    n_items = scalar(items.agg(rows().alias("n")))
    light = small_enough(items, max_broadcast * FULL_RANK // rank)
    # At most all venues.
    lists = settle(pos.groupBy("user_id").agg(F.collect_list("business_id").alias("items"))) if light else None

    def start(df, key):
        def draw(i):
            h = portable_hash(F.lit(f"{seed}-{key}-{i}"), F.col(key).cast("string"))
            return (h / F.lit(4294967296.0) - 0.5) / rank

        return settle(df.select(key).distinct().select(key, F.array(*[draw(i) for i in range(rank)]).alias("f")))

    uf, vf = start(pos, "user_id"), start(pos, "business_id")

    def meet(df, factors, name, column):
        table = factors.select(F.col("business_id").alias(column), F.col("f").alias(name))
        return df.join(F.broadcast(table), column) if light else spread_join(df, table, [column])

    def total(col):
        return F.array(*[F.sum(F.col(col)[i]) for i in range(rank)])

    for epoch in range(epochs):
        pick = F.pmod(portable_hash(F.lit(f"{seed}-e{epoch}"), F.col("user_id").cast("string"), F.col("i").cast("string")), n_items) + 1
        other, fu = items.select("pos", F.col("business_id").alias("j")), uf.withColumnRenamed("f", "fu")
        if light:
            drawn = lists.join(fu, "user_id").select("*", F.explode("items").alias("i")).withColumn("pos", pick).join(F.broadcast(other), "pos")
            triples = drawn.where(~F.array_contains("items", F.col("j"))).select("user_id", "i", "j", "fu")
        else:
            drawn = pos.select("user_id", F.col("business_id").alias("i")).withColumn("pos", pick).join(other, "pos")
            seen = pos.select("user_id", F.col("business_id").alias("j"))
            triples = drawn.join(seen, ["user_id", "j"], "left_anti").select("user_id", "i", "j").join(fu, "user_id")
        full = meet(meet(triples, vf, "fi", "i"), vf, "fj", "j")
        lead = F.zip_with("fi", "fj", lambda x, y: x - y)
        full = full.withColumn("lead", lead)
        s = 1 / (1 + F.exp(F.least(dot(F.col("fu"), F.col("lead")), F.lit(700.0))))
        full = full.withColumn("s", s)
        grads = full.select(
            "user_id", "i", "j",
            F.transform("lead", lambda x: x * F.col("s")).alias("gu"),
            F.transform("fu", lambda x: x * F.col("s")).alias("gi"),
        )
        gu = grads.groupBy("user_id").agg(total("gu").alias("g"))
        sides = F.array(
            F.struct(F.col("i").alias("business_id"), F.col("gi").alias("g")),
            F.struct(F.col("j").alias("business_id"), F.transform("gi", lambda x: -x).alias("g")),
        )
        gv = grads.select(F.explode(sides).alias("x")).select("x.business_id", "x.g").groupBy("business_id").agg(total("g").alias("g"))

        def move(factors, g, key):
            step = F.zip_with("f", F.coalesce("g", F.transform("f", lambda x: x * 0.0)), lambda f, d: f + rate * (d - reg * f))
            return settle(factors.join(g, key, "left").select(key, step.alias("f")))

        uf, vf = move(uf, gu, "user_id"), move(vf, gv, "business_id")
    return uf.withColumnRenamed("f", "factors"), vf.withColumnRenamed("f", "factors")


# ---------------------------------------------------------------- blends


def unit_of(col: str, per) -> Column:
    """``col`` scaled to [0, 1] over a bounded window; a flat one keeps its distance from the minimum."""
    v, lo, hi = F.col(col).cast("double"), F.min(col).over(per), F.max(col).over(per)
    return F.when(F.col(col).isNotNull(), F.when(hi - lo > 1e-12, (v - lo) / (hi - lo)).otherwise(v - lo))


def blend(a: DataFrame, b: DataFrame, lam: float) -> DataFrame:
    """lam x a + (1 - lam) x b per venue, both scaled to [0, 1] over all venues (missing = 0)."""
    both = a.select("business_id", F.col("score").alias("a")).join(b.select("business_id", F.col("score").alias("b")), "business_id", "outer")
    both = both.fillna({"a": 0.0, "b": 0.0})
    for c in ("a", "b"):
        both = minmax(both, c, (), "unit")
    return both.select("business_id", (lam * F.col("a") + (1 - lam) * F.col("b")).alias("score"))


def blend_parts(venue_scores: DataFrame, personal: DataFrame, candidates: DataFrame) -> DataFrame:
    """(user, venue, g, m): venue score scaled over all venues, personal score scaled over the user's candidates;
    0.5 for users without personal scores, the distance from the minimum when flat."""
    whole = minmax(venue_scores.select("business_id", F.col("score").alias("g")), "g", (), "unit")
    low = venue_scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    # A venue without score counts as 0 before scaling.
    missing = scalar(low.select(((0 - F.col("lo")) / span).alias("z")))
    joined = lookup_join(candidates.select("user_id", "business_id"), whole, ["business_id"], "left").join(
        personal.select("user_id", "business_id", F.col("score").alias("m")), ["user_id", "business_id"], "left"
    )
    # A user's candidates are distinct venues, so the group is bounded; one shuffle serves all of its statistics.
    per = Window.partitionBy("user_id")
    filled = joined.withColumn("m", F.when(F.count("m").over(per) > 0, F.coalesce("m", F.lit(0.0))))
    scaled = filled.withColumn("m", unit_of("m", per))
    return scaled.select("user_id", "business_id", F.coalesce("g", missing).alias("g"), F.coalesce("m", F.lit(0.5)).alias("m"))


def blend_personal(venue_scores: DataFrame, personal: DataFrame, candidates: DataFrame, lam: float) -> DataFrame:
    parts = blend_parts(venue_scores, personal, candidates)
    return parts.select("user_id", "business_id", (lam * F.col("g") + (1 - lam) * F.col("m")).alias("score"))


def blend_top(personal: DataFrame, venue_scores: DataFrame, k: int = 50, lam: float = 0.5) -> DataFrame:
    """The user's k best personal scores (scaled over all of the user's) blended with scaled venue scores."""
    scaled = personal.withColumn("p", unit_of("score", Window.partitionBy("user_id")))
    head = top_k(scaled, k, [F.col("score").desc(), F.col("business_id")], ["user_id"])
    whole = minmax(venue_scores.select("business_id", F.col("score").alias("g")), "g", (), "unit")
    return lookup_join(head, whole, ["business_id"], "left").select(
        "user_id", "business_id", (lam * F.col("p") + (1 - lam) * F.coalesce("g", F.lit(0.0))).alias("score")
    )


def weight_metrics(parts: DataFrame, train_pairs: DataFrame, test_pairs: DataFrame, lams: Sequence[float], decimals: int = 9) -> DataFrame:
    """(lam, user_id, metrics): every user's list under every blend weight.

    A user's distinct venues are one bounded row, ordered anew per weight as rows stream by: the grid is neither shuffled nor sorted as a table.
    """
    from footfall.operators.evaluate import KS, ideal_dcg

    known = train_pairs.select("user_id", "business_id").join(parts.select("user_id", "business_id", "g", "m"), ["user_id", "business_id"], "left")
    marked = known.join(test_pairs.withColumn("rel", F.lit(1)), ["user_id", "business_id"], "left")
    items = F.collect_list(F.struct("business_id", "g", "m", F.coalesce("rel", F.lit(0)).alias("rel")))
    lists = marked.groupBy("user_id").agg(items.alias("items")).where(F.size("items") >= 2).withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in lams])))

    def placed(x):
        score = F.coalesce(F.round(F.col("lam") * x["g"] + (1 - F.col("lam")) * x["m"], decimals), F.lit(0.0))
        return F.struct((-score).alias("down"), x["business_id"].alias("business_id"), x["rel"].alias("rel"))

    head = F.slice(F.sort_array(F.transform("items", placed)), 1, max(KS))
    gains = F.transform(head, lambda x, i: x["rel"] / F.log2(i + 2))
    relevant = F.aggregate("items", F.lit(0), lambda acc, x: acc + x["rel"])
    per_user = lists.select("lam", "user_id", gains.alias("gains"), relevant.alias("n_relevant"))
    dcg = lambda k: F.aggregate(F.slice("gains", 1, k), F.lit(0.0), lambda acc, x: acc + x)
    metrics = [c for k in KS for c in (ratio(dcg(k), ideal_dcg(F.col("n_relevant"), k), 0.0).alias(f"ndcg_{k}"), (dcg(k) > 0).cast("double").alias(f"hit_{k}"))]
    return per_user.select("lam", "user_id", *metrics)


def tune_blend(parts: DataFrame, train_pairs: DataFrame, test_pairs: DataFrame, lams: Sequence[float], metric: str = "ndcg_10", decimals: int = 9) -> DataFrame:
    """Metrics per blend weight, all weights in one job, with the best one marked (smallest weight on ties)."""
    from footfall.operators.evaluate import mean_metrics

    means = settle(mean_metrics(weight_metrics(parts, train_pairs, test_pairs, lams, decimals), ["lam"]))
    best = means.agg(F.min_by("lam", F.struct(-F.round(metric, decimals), F.col("lam"))).alias("b"))
    return means.withColumn("is_best", F.col("lam") == scalar(best))
