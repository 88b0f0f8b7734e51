"""Multi-objective recommendation, serving queries and candidate sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalar import (
    EARTH_RADIUS_M,
    contains_any,
    context_score,
    critic_penalty,
    distance_decay,
    haversine_m,
    ratio,
    ride_cost_factor,
)
from footfall.operators.clean import NIGHTLIFE_WORDS, minmax
from footfall.operators.geo import count_looks, radius_join
from footfall.operators.pyramid import Pyramid, members
from footfall.operators.scale import attach, portable_hash, scalar, small_enough, spread_join, top_k
from footfall.session import settle

# Prior weights of the three objectives and the share given to the entropy weights.
PRIOR_WEIGHTS = (0.55, 0.45, 0.00)
ADAPTIVE_SHARE = 0.35
OBJECTIVES = ("u_beh", "c_mob", "r_ctx")
RIDE_SHARE = "Nightlife / Ride-Share Candidate"
VENUE_FIELDS = (
    "business_id", "latitude", "longitude", "popularity", "repeat_user_rate", "avg_rating", "parking_score",
    "transit_access_score", "peak_busyness", "cuisine_categories",
)


def base_utility(popularity: Column, repeat: Column) -> Column:
    load = popularity.cast("double") / 1000.0 * (1 + F.coalesce(repeat, F.lit(0.0)))
    return F.least(F.lit(1.0), F.log1p(load) / 2)


def mobility(dist: Column, range_km: Column, parking: Column, transit: Column, sensitivity: Column, archetype: Column, night: Column) -> Column:
    """Reachability: 0.55 distance, 0.30 parking, 0.15 transit. Parking-sensitive users mind poor parking more;
    ride-share users at night spots pay for the ride instead of parking."""
    near = distance_decay(dist, range_km)
    rides = (archetype == RIDE_SHARE) & night
    spot = F.when(rides, F.lit(1.0)).when(sensitivity > 0.5, F.pow(parking, F.lit(1.5))).otherwise(parking)
    reach = F.when(rides, near * ride_cost_factor(dist)).otherwise(near)
    return F.least(F.lit(1.0), reach * 0.55 + spot * 0.30 + transit * 0.15)


# How far from the middle of a user's places candidates may lie. A stated feature of the model: nothing is cut by number.
CANDIDATE_KM = 10.0
# Up to so many venues go to every task, and a task compares so many pairs of users and venues.
SMALL_VENUES, TASK_PAIRS = 500_000, 4_000_000


def candidate_venues(venues: DataFrame) -> DataFrame:
    """What the objectives need of a venue, gaps filled."""
    return venues.select(
        "business_id", "latitude", "longitude", F.col("latitude").alias("venue_lat"), F.col("longitude").alias("venue_lon"), F.col("popularity"),
        F.coalesce("repeat_user_rate", F.lit(0.0)).alias("repeat_user_rate"),
        F.coalesce("avg_rating", F.lit(3.0)).alias("avg_rating"),
        F.coalesce("parking_score", F.lit(0.5)).alias("parking_score"),
        F.coalesce("transit_access_score", F.lit(0.0)).alias("transit_access_score"),
        F.coalesce(F.col("peak_busyness").cast("double"), F.lit(0.0)).alias("peak_busyness"),
        F.coalesce("cuisine_categories", F.lit("")).alias("cuisine_categories"),
        contains_any("cuisine_categories", NIGHTLIFE_WORDS).alias("night"),
    )


def objectives(users: DataFrame, venues: DataFrame, radius_km: float = CANDIDATE_KM, keep: Sequence[str] = ()) -> DataFrame:
    """One row per user and venue within ``radius_km`` of the user's middle with the three objectives. Users meet venues by
    grid cell, so the rows follow the local density, not users times venues. Venues counted as few travel to the users, which are dealt by
    user_id in tasks of bounded work, so that nothing per user shuffles the candidates. ``keep`` names further columns of users to pass on.

    ``users`` needs user_id, centroid_lat/lon, avg_visited_rating, spatial_range_km, parking_sensitivity, archetype,
    critic_tag.
    """
    cols = ["user_id", "centroid_lat", "centroid_lon", "avg_visited_rating", "critic_tag", "archetype", "parking_sensitivity", "spatial_range_km"]
    people, places = settle(users.select(*cols, *keep)), settle(candidate_venues(venues))
    metres, at, pos = radius_km * 1000.0, ("centroid_lat", "centroid_lon"), ("latitude", "longitude")
    small = small_enough(places, SMALL_VENUES)
    if small:
        tasks = -(-count_looks(people, places, metres, at, pos) // TASK_PAIRS)
        people = people.repartition(max(int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks), "user_id")
    met = radius_join(people, places, metres, at, pos, small)
    met = met.withColumn("dist_km", F.col("dist_m") / 1000.0)
    met = met.withColumn("base", base_utility(F.col("popularity"), F.col("repeat_user_rate")))
    reach = mobility(
        F.col("dist_km"), F.col("spatial_range_km"), F.col("parking_score"), F.col("transit_access_score"),
        F.col("parking_sensitivity"), F.col("archetype"), F.col("night"),
    )
    return met.select(
        "user_id", "business_id", F.col("venue_lat").alias("latitude"), F.col("venue_lon").alias("longitude"), F.col("cuisine_categories").alias("categories"), "avg_rating", "base",
        (F.col("base") * critic_penalty("critic_tag", "avg_visited_rating", "avg_rating")).alias("u_beh"),
        reach.alias("c_mob"),
        context_score("peak_busyness", "avg_rating", "avg_visited_rating").alias("r_ctx"), *keep,
    )


def entropy_weights(scored: DataFrame, columns: Sequence[str] = OBJECTIVES, by: Sequence[str] = ("user_id",), shift: float = 1e-6) -> DataFrame:
    """Entropy weight of each objective over a user's candidates: even columns say little, uneven ones much."""
    from pyspark.sql import Window

    per = Window.partitionBy(*by)
    out = scored.withColumns({f"_s_{c}": F.sum(F.col(c) + shift).over(per) for c in columns} | {"_n": F.count(F.lit(1)).over(per)})

    def term(c):
        p = (F.col(c) + shift) / F.when(F.col(f"_s_{c}") == 0, F.lit(1e-12)).otherwise(F.col(f"_s_{c}"))
        return p * F.log(p + 1e-12)

    spread = {f"_d_{c}": F.when(F.col("_n") > 1, 1 + F.try_divide(F.sum(term(c)).over(per), F.log("_n"))) for c in columns}
    out = out.withColumns(spread)
    total = reduce(lambda a, b: a + b, [F.col(f"_d_{c}") for c in columns])
    even = F.lit(1.0 / len(columns))
    out = out.withColumns({f"w_{c}": F.coalesce(F.try_divide(F.col(f"_d_{c}"), F.nullif(total, F.lit(0.0))), even) for c in columns})
    return out.drop("_n", *[f"_s_{c}" for c in columns], *[f"_d_{c}" for c in columns])


def blend_weights(df: DataFrame, columns: Sequence[str] = OBJECTIVES, prior: Sequence[float] = PRIOR_WEIGHTS, share: float = ADAPTIVE_SHARE) -> DataFrame:
    """Mix of entropy and prior weights, scaled to sum 1 (the prior when the mix adds up to nothing)."""
    mixed = {c: share * F.col(f"w_{c}") + (1 - share) * p for c, p in zip(columns, prior)}
    total = reduce(lambda a, b: a + b, mixed.values())
    return df.withColumns({f"w_{c}": F.when(total > 0, mixed[c] / total).otherwise(F.lit(p)) for c, p in zip(columns, prior)})


def weighted_top(df: DataFrame, k: int = 100, columns: Sequence[str] = OBJECTIVES, decimals: int = 9) -> DataFrame:
    """Each user's ``k`` best candidates by weighted score with their rank. Rounding keeps equal scores tied."""
    score = reduce(lambda a, b: a + b, [F.col(f"w_{c}") * F.col(c) for c in columns])
    scored = df.withColumn("score", F.round(score, decimals))
    return top_k(scored, k, [F.col("score").desc(), F.col("business_id")], ["user_id"], "rank")


def score_candidates(users: DataFrame, venues: DataFrame, radius_km: float = CANDIDATE_KM, keep: int = 100) -> DataFrame:
    """Objectives, entropy weights, blend and the best ``keep`` candidates per user."""
    return weighted_top(blend_weights(entropy_weights(objectives(users, venues, radius_km))), keep)


# Shares of common categories and of nearness in the likeness of two venues, and where nearness ends.
CATEGORY_SHARE, NEAR_SHARE, NEAR_KM = 0.7, 0.3, 5.0


# Users whose lists are re-ranked at once.
FOLD_USERS = 512


def likeness(common, km):
    """Likeness of venues from the Jaccard of their categories and their distance; an unknown distance adds nothing."""
    import numpy as np

    return CATEGORY_SHARE * common + NEAR_SHARE * np.where(np.isnan(km), 0.0, np.maximum(0.0, 1 - km / NEAR_KM))


def _diverse_order(sizes, score, lat, lon, kinds, k: int, lam: float, decimals: int):
    """Of lists that lie one after another, the places chosen one by one: list, and place among all items, in the order of choice."""
    import numpy as np

    n, ends = len(sizes), np.cumsum(sizes)
    starts, whose = ends - sizes, np.repeat(np.arange(n), sizes)
    at = np.full((n, int(sizes.max(initial=0))), -1)
    at[whose, np.arange(len(whose)) - starts[whose]] = np.arange(len(whose))
    filled = at >= 0
    # The distinct words of an item side by side; each text is split once.
    texts, text_of = np.unique(kinds, return_inverse=True)
    vocabulary: dict[str, int] = {}
    split = [list({vocabulary.setdefault(w, len(vocabulary)) for w in t.split(", ")}) for t in texts.tolist()]
    text_sizes = np.array([len(s) for s in split], np.int64)
    words_of = text_sizes[text_of]
    flat, text_starts = np.array([w for s in split for w in s], np.int64), np.cumsum(text_sizes) - text_sizes
    first = np.cumsum(words_of) - words_of
    word = flat[np.repeat(text_starts[text_of] - first, words_of) + np.arange(words_of.sum())]
    owner = np.repeat(whose, words_of)
    marked = np.zeros((n, len(vocabulary)), bool)
    la = np.radians(lat)
    cos = np.cos(la)
    like, left = np.zeros(len(whose)), np.ones(len(whose), bool)
    lists, picks = [], []
    for step in range(min(k, at.shape[1])):
        value = score if step == 0 else lam * score - (1 - lam) * like
        # Half away from zero, as Spark rounds.
        gain = np.where(left, np.copysign(np.floor(np.abs(value) * 10.0**decimals + 0.5), value), -np.inf)
        live = np.flatnonzero(sizes > step)
        grid = np.where(filled[live], gain[at[live]], -np.inf)
        pick = at[live, grid.argmax(axis=1)]
        lists.append(live)
        picks.append(pick)
        left[pick] = False
        chosen = np.zeros(n, np.int64)
        chosen[live] = pick
        other = chosen[whose]
        taken = np.zeros(len(whose), bool)
        taken[pick] = True
        now = np.repeat(taken, words_of)
        marked[owner[now], word[now]] = True
        both = np.add.reduceat(marked[owner, word].astype(np.int64), first)
        marked[owner[now], word[now]] = False
        common = both / (words_of + words_of[other] - both)
        h = np.sin((la[other] - la) / 2) ** 2 + cos * cos[other] * np.sin(np.radians(lon[other] - lon) / 2) ** 2
        km = 2 * EARTH_RADIUS_M / 1000 * np.arcsin(np.sqrt(np.minimum(1.0, h)))
        like = np.maximum(like, likeness(common, km))
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.repeat(np.arange(1, len(lists) + 1), [len(x) for x in lists])
    user, pick = np.concatenate(lists), np.concatenate(picks)
    by = np.lexsort((place, user))
    return user[by], pick[by], place[by]


def diversify(df: DataFrame, k: int = 20, lam: float = 0.7, decimals: int = 9) -> DataFrame:
    """Re-rank each user's kept candidates (a bounded handful, from :func:`weighted_top`) for diversity.

    The greedy choice is a fold over the user's list: of those left, the one with the best balance of score and likeness to what is chosen
    comes next, the better ranked one on ties; each one's likeness to the chosen set is kept as a running maximum. A step is
    taken for the lists of many users at once. Lists are made where the candidates lie if those are dealt by user_id.
    """
    columns = ["rank", *[c for c in df.columns if c not in ("user_id", "rank")]]
    # At most the kept candidates of a user, a number fixed by the caller.
    lists = df.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, FOLD_USERS):
                users, items = batch.column(0).slice(i, FOLD_USERS), batch.column(1).slice(i, FOLD_USERS)
                flat = items.flatten()
                fields = dict(zip(columns, flat.flatten()))
                score, lat, lon = (fields[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("score", "latitude", "longitude"))
                kinds = np.array(fields["categories"].fill_null("").to_pylist(), object)
                user, pick, place = _diverse_order(items.value_lengths().to_numpy(), score, lat, lon, kinds, k, lam, decimals)
                out = {c: a.take(pa.array(pick)) for c, a in fields.items()} | {"user_id": users.take(pa.array(user))}
                out["rank"] = pa.array(place).cast(fields["rank"].type)
                yield pa.RecordBatch.from_arrays([out[c] for c in types], names=list(types))

    return lists.mapInArrow(fold, ", ".join(f"`{c}` {x}" for c, x in types.items()))


def mean_weights(recommended: DataFrame, columns: Sequence[str] = OBJECTIVES) -> DataFrame:
    return recommended.agg(*[F.avg(f"w_{c}").alias(f"w_{c}") for c in columns])


# Objective weights used for every ablation variant.
ABLATION_WEIGHTS = (0.55, 0.45, 0.00)
ABLATIONS = ("Full Model", "No Mobility (C_mob)", "No Context (R_ctx)", "No Critic Penalty", "Popularity", "Rating", "Random")


def _first_places(lists: DataFrame, kinds: Sequence[str], n: int, decimals: int) -> DataFrame:
    """(method, user_id, position, rel, n_relevant): the first ``n`` of each user's ``items`` by each variant's score s0, s1, ..., ties by venue.

    Scores are rounded so that equal sums in another order stay ties, half away from zero as Spark does; a missing score comes last.
    """

    def order(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        for batch in batches:
            for i in range(0, batch.num_rows, FOLD_USERS):
                users, items = batch.column(0).slice(i, FOLD_USERS), batch.column(1).slice(i, FOLD_USERS)
                sizes = items.value_lengths().to_numpy()
                venue, rel, *scores = items.flatten().flatten()
                # By user and venue first, so that a stable sort by score leaves ties in the order of venues.
                whose = np.repeat(np.arange(len(sizes)), sizes)
                table = pa.table({"u": whose, "v": venue})
                base = pa.compute.sort_indices(table, [("u", "ascending"), ("v", "ascending")]).to_numpy()
                rel = rel.to_numpy(zero_copy_only=False)
                relevant = np.bincount(whose, weights=rel, minlength=len(sizes)).astype(np.int64)
                place = np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                head = place < n
                for kind, score in zip(kinds, scores):
                    value = score.to_numpy(zero_copy_only=False)[base]
                    value = np.copysign(np.floor(np.abs(value) * 10.0**decimals + 0.5), value)
                    by = base[np.lexsort((-value, whose))][head]
                    user = whose[head]
                    columns = [pa.array([kind] * len(by)), users.take(pa.array(user)), pa.array(place[head] + 1), pa.array(rel[by].astype(np.int32)), pa.array(relevant[user])]
                    yield pa.RecordBatch.from_arrays(columns, names=["method", "user_id", "position", "rel", "n_relevant"])

    return lists.mapInArrow(order, f"method string, user_id {lists.schema['user_id'].dataType.simpleString()}, position bigint, rel int, n_relevant bigint")


def ablate(users: DataFrame, venues: DataFrame, test_pairs: DataFrame, kinds: Sequence[str] = ABLATIONS, radius_km: float = CANDIDATE_KM, ks: Sequence[int] = (5, 10, 20), weights: Sequence[float] = ABLATION_WEIGHTS, seed: int = 42) -> DataFrame:
    """NDCG and hits of each scoring variant against future visits, over users with a future venue among the
    candidates. Each user brings the future venues, so candidates are marked where they are made; each variant only re-orders them."""
    from footfall.operators.evaluate import mean_metrics, user_metrics

    wb, wm, wc = weights
    # A user's future venues are at most all venues.
    future = test_pairs.select("user_id", "business_id").distinct().groupBy("user_id").agg(F.collect_list("business_id").alias("future"))
    scored = objectives(users.join(future, "user_id"), venues, radius_km, keep=["future"])
    rel = F.array_contains("future", F.col("business_id")).cast("int")

    def variant(kind):
        mob = F.lit(1.0) if kind == "No Mobility (C_mob)" else F.col("c_mob")
        ctx = F.lit(1.0) if kind == "No Context (R_ctx)" else F.col("r_ctx")
        beh = F.col("base") if kind == "No Critic Penalty" else F.col("u_beh")
        fixed = {
            "Popularity": F.col("base"),
            "Rating": F.col("avg_rating").cast("double"),
            "Random": portable_hash(F.lit(str(seed)), F.col("user_id").cast("string"), F.col("business_id").cast("string")) / F.lit(4294967296.0),
        }
        return fixed.get(kind, wb * beh + wm * mob + wc * ctx)

    # Candidates of a user, at most the venues near them, become one list where they lie; each variant orders the lists of many users at once.
    item = F.struct("business_id", rel.alias("rel"), *[variant(kind).alias(f"s{i}") for i, kind in enumerate(kinds)])
    lists = scored.groupBy("user_id").agg(F.collect_list(item).alias("items")).where(F.exists("items", lambda x: x["rel"] == 1))
    marked = _first_places(lists, list(kinds), max(ks), decimals=9)
    return mean_metrics(user_metrics(marked, ["method"], ks, ideal="slice"), ["method"], ks)


# ---------------------------------------------------------------- serving

# Weights of graph score, rating, popularity and revisits per visit mode.
MODE_WEIGHTS = {
    "Regular / routine visits": (0.35, 0.20, 0.00, 0.45),
    "Explorer / try new places": (0.25, 0.30, 0.45, 0.00),
    "Morning quick stop": (0.20, 0.45, 0.00, 0.35),
    "Weekend casual": (0.10, 0.25, 0.50, 0.15),
}
DEFAULT_MODE = (0.35, 0.25, 0.20, 0.20)
MODE_COLUMNS = ("birank_score", "rating_mean", "popularity_visits", "revisit_rate")


def composite_score(df: DataFrame, mode: str, by: Sequence[str] = (), name: str = "score") -> DataFrame:
    """Weighted sum of the four min-max scaled measures (missing = 0)."""
    weights = MODE_WEIGHTS.get(mode, DEFAULT_MODE)
    out = df.withColumns({f"_m{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(MODE_COLUMNS)})
    for i in range(4):
        out = minmax(out, f"_m{i}", by, "zeros")
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"_m{i}") for i, w in enumerate(weights)])
    return out.withColumn(name, total).drop(*[f"_m{i}" for i in range(4)])


def rank_mode(df: DataFrame, mode: str, segment_scores: DataFrame | None = None, behaviour: str = "") -> DataFrame:
    """Score by ranking mode: graph (segment score where known, else the global or composite one), rating,
    popularity or revisit."""
    plain = {"rating": "rating_mean", "popularity": "popularity_visits", "revisit": "revisit_rate"}
    if mode in plain:
        return df.withColumn("score", F.coalesce(F.col(plain[mode]).cast("double"), F.lit(0.0)))
    if segment_scores is None:
        return composite_score(df, behaviour)
    best = segment_scores.groupBy("business_id").agg(F.max("score").alias("_seg"))
    return df.join(best, "business_id", "left").withColumn("score", F.coalesce("_seg", "birank_score", F.lit(0.0))).drop("_seg")


def serve(venues: DataFrame, requests: DataFrame, score: str = "score") -> DataFrame:
    """Top k per request among its city's venues within the radius; the nearest k of the city when none is near.

    ``requests``: request_id, city, ref_lat, ref_lon, radius_km, k. Equal requests are answered once. Of cells wholly within the radius only
    their best venues are seen, of the city's others none; the nearest ones are found from cell to cell (:mod:`pyramid`).
    """
    pos = ("latitude", "longitude")
    asked = requests.select(
        "request_id", "city", F.col("ref_lat").alias("q_lat"), F.col("ref_lon").alias("q_lon"), (F.col("radius_km") * 1000.0).alias("radius_m"), "k"
    )
    same = ["city", "q_lat", "q_lon", "radius_m", "k"]
    # A question is named by what it asks; the hash only deals rows, the columns travel with it.
    queries = settle(asked.select(*same).distinct().withColumn("q", F.struct(*same)))
    most = queries.agg(F.max("k")).first()[0]
    held = venues.select("city", *pos, "business_id", F.col(score).alias("_score"))
    if most is None:
        most = 0
    by_score, by_id = [F.desc_nulls_last("_score"), F.asc("business_id")], [F.asc("business_id")]
    tree = Pyramid(held, ["city"], pos)
    keep = ["business_id", "_score"]
    found = settle(tree.within(queries))
    on = ["city", "level", "cell"]
    inside = tree.meet_best(found.where("inside").select("q", "q_lat", "q_lon", "k", *on), tree.best(held, pos, by_score, most, keep), most)
    inside = inside.withColumn("dist_m", haversine_m("q_lat", "q_lon", "lat", "lon"))
    rim = tree.at_rim(found.where("not inside")).where(F.col("dist_m") <= F.col("radius_m"))
    rim = members(tree, rim.select("q", "k", "city", "lat", "lon", "dist_m"), held, pos, by_score, most, keep)
    columns = ["q", "k", "business_id", "_score", "dist_m"]
    near = settle(_first(inside.select(columns).unionByName(rim.select(columns)), by_score))
    lonely = queries.join(near.select("q").distinct(), "q", "left_anti")
    far = tree.at_rim(tree.around(lonely))
    # Places by distance, as many as can hold k venues; then their venues.
    far = _first(far.select("q", "k", "city", "lat", "lon", "dist_m"), [F.asc("dist_m"), F.asc("lat"), F.asc("lon")], ties=True).drop("place")
    far = _first(members(tree, far, held, pos, by_id, most, keep).select(columns), [F.asc("dist_m"), *by_id])
    answers = near.withColumn("fallback", F.lit(False)).unionByName(far.withColumn("fallback", F.lit(True)))
    met = spread_join(asked.withColumn("q", F.struct(*same)).select("request_id", "q"), answers.drop("k"), ["q"])
    return met.select("request_id", "business_id", (F.col("dist_m") / 1000.0).alias("distance_km"), F.col("_score").alias(score), "place", "fallback")


def _first(rows: DataFrame, order: Sequence[Column], ties: bool = False) -> DataFrame:
    """The first ``k`` rows of each question; with ``ties`` all that are level with the k-th."""
    from pyspark.sql import Window

    by = Window.partitionBy("q").orderBy(*order)
    place = (F.rank() if ties else F.row_number()).over(by)
    return rows.withColumn("place", place.cast("bigint")).where(F.col("place") <= F.col("k"))


# The measure each kind of visitor looks for.
ARCHETYPE_COLUMN = {
    "Loyalist": "revisit_rate",
    "Weekday Regular": "temporal_stability",
    "Casual Weekender": "unique_users",
    "Infrequent Visitor": "stars",
    "Explorer": "popularity",
    "Mixed / Average": "avg_rating",
    "Nightlife Seeker": "peak_busyness",
    "One-Time Tourist (Business)": "business_leisure_ratio",
    "Leisure Traveler": "geographic_diversity",
    "One-Time Tourist": "stars",
    "Budget Explorer": "review_count",
}


def city_top(venues: DataFrame, requests: DataFrame, n: int = 3) -> DataFrame:
    """Per request (request_id, city, archetype): the city's best venues by the measure of the archetype (stars by default).

    Ranks per (city, measure) are made once; a request picks up the first ``n`` of its list.
    """
    measures = sorted({c for c in [*ARCHETYPE_COLUMN.values(), "stars"] if c in venues.columns})
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("signal")) for c in measures])
    every = venues.select("city", "business_id", F.explode(pairs).alias("m")).select("city", "business_id", "m.measure", "m.signal")
    lists = top_k(every, n, [F.col("signal").desc(), F.col("business_id")], ["city", "measure"], "place")
    wanted = F.lit("stars")
    for label, column in ARCHETYPE_COLUMN.items():
        if column in venues.columns:
            wanted = F.when(F.col("archetype") == label, F.lit(column)).otherwise(wanted)
    met = spread_join(requests.select("request_id", "city", wanted.alias("measure")), lists, ["city", "measure"])
    return met.select("request_id", "business_id", "signal", "place")


def place_overview(venues: DataFrame) -> DataFrame:
    """Venues, mean rating and two profile counts per city."""
    return venues.groupBy("city").agg(
        F.count(F.lit(1)).alias("venues"), F.avg("stars").alias("avg_stars"),
        F.count_if(F.col("profile") == "Business Hub").alias("business_hubs"),
        F.count_if(F.col("profile") == "Seasonal Resort").alias("seasonal_resorts"),
    )


def top_labels(venues: DataFrame, label: str, k: int = 5, by: str = "city") -> DataFrame:
    counts = venues.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, k, [F.col("n").desc(), F.col(label)], [by], "place")


def enrich(scores: DataFrame, social: DataFrame, linkage: DataFrame, parameter: float) -> DataFrame:
    """Ranking with social columns, a linked flag and the chosen parameter."""
    linked = linkage.select("business_id").distinct().withColumn("_l", F.lit(True))
    return (
        scores.join(social, "business_id", "left")
        .join(linked, "business_id", "left")
        .withColumn("is_linked", F.coalesce("_l", F.lit(False)))
        .withColumn("parameter", F.lit(float(parameter)))
        .drop("_l")
    )


def linked_share(enriched: DataFrame, k: int = 50) -> DataFrame:
    head = top_k(enriched, k, [F.col("score").desc(), F.col("business_id")])
    return head.agg(ratio(F.count_if("is_linked"), F.count(F.lit(1))).alias("linked_share"), F.count(F.lit(1)).alias("n"))


def serving_table(base: DataFrame, *parts: DataFrame, key: str = "business_id") -> DataFrame:
    """All per-venue tables in one; a column that is already there gets a numbered suffix."""
    out = base
    for i, part in enumerate(parts, 1):
        renamed = part.select(key, *[F.col(c).alias(c if c not in out.columns else f"{c}_{i}") for c in part.columns if c != key])
        out = out.join(renamed, key, "left")
    return out


# ---------------------------------------------------------------- samples and candidate sets


def sample_hash(df: DataFrame, n: int, key: str, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """A fixed sample of ``n`` rows, whole or per stratum, in the order of a hash of the key."""
    h = portable_hash(F.lit(str(seed)), F.col(key).cast("string"))
    return top_k(df.withColumn("_h", h), n, [F.col("_h"), F.col(key)], by).drop("_h")


def _shuffled(df: DataFrame, by: Sequence[str], key: str, seed: int) -> DataFrame:
    """Display order by hash, over sets of a handful of rows."""
    from pyspark.sql import Window

    h = portable_hash(F.lit(f"{seed}-show"), F.col(key).cast("string"))
    return df.withColumn("display_rank", F.row_number().over(Window.partitionBy(*by).orderBy(h, F.col(key))))


def discriminating_set(df: DataFrame, by: Sequence[str], n: int = 10, half: int = 5, key: str = "business_id", seed: int = 42) -> DataFrame:
    """Items on exactly one of the two top-5 lists (model, stars), filled up from the rest by hash, shuffled."""
    by = list(by)
    model = top_k(df, half, [F.col("model_rank"), F.col(key)], by).select(*by, key, F.lit(1).alias("_m"))
    stars = top_k(df, half, [F.col("stars_rank"), F.col(key)], by).select(*by, key, F.lit(1).alias("_s"))
    tops = model.join(stars, [*by, key], "outer")
    split = tops.where(F.col("_m").isNull() | F.col("_s").isNull())
    chosen = split.select(*by, key, F.when(F.col("_m") == 1, F.lit("model")).otherwise(F.lit("stars")).alias("side"))
    rest = df.join(tops, [*by, key], "left_anti").select(*by, key)
    fill = sample_hash(rest, n, key, seed, by).withColumn("side", F.lit("fill"))
    h = portable_hash(F.lit(str(seed)), F.col(key).cast("string"))
    both = chosen.unionByName(fill).withColumn("_h", h).withColumn("_late", (F.col("side") == "fill").cast("int"))
    picked = top_k(both, n, [F.col("_late"), F.col("_h"), F.col(key)], by).drop("_h", "_late")
    return _shuffled(picked, by, key, seed)


def contrast_set(df: DataFrame, by: Sequence[str], signal: str, n: int = 10, key: str = "business_id", seed: int = 42) -> DataFrame:
    """The n/2 highest and n/2 lowest items of a signal (missing = 0), each once, shuffled."""
    by = list(by)
    v = df.select(*by, key, F.coalesce(F.col(signal).cast("double"), F.lit(0.0)).alias("signal"))
    high = top_k(v, n // 2, [F.col("signal").desc(), F.col(key)], by)
    low = top_k(v, n // 2, [F.col("signal").asc(), F.col(key)], by)
    return _shuffled(high.union(low).distinct(), by, key, seed)


def decoy_set(df: DataFrame, by: Sequence[str], n: int = 10, top: int = 5, key: str = "business_id", seed: int = 42) -> DataFrame:
    """The best ``top`` by model rank and random others."""
    by = list(by)
    head = top_k(df, top, [F.col("model_rank"), F.col(key)], by).select(*by, key)
    rest = df.select(*by, key).join(head, [*by, key], "left_anti")
    return _shuffled(head.unionByName(sample_hash(rest, n - top, key, seed, by)), by, key, seed)
