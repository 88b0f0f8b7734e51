"""Linking venues and users of two platforms, and what linked friends tell about venues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalar import proximity_exp, proximity_linear, ratio, shift_minutes
from footfall.operators.clean import confidence_tier
from footfall.operators.geo import radius_join
from footfall.operators.scale import MIN_CHUNK, best_row, hot_keys, lookup_join, number_rows, scalar, small_enough, spread_join
from footfall.operators.text import cosine_pairs, fit_idf, term_counts, transform_tfidf
from footfall.session import settle


def rows() -> Column:
    return F.count(F.lit(1))


# ---------------------------------------------------------------- venues


def link_checkins(checkins: DataFrame, linkage: DataFrame, venue_col: str = "poi_id") -> DataFrame:
    """Check-ins at linked venues with their local time, hour, weekday and weekend flag."""
    joined = lookup_join(checkins, linkage.select(venue_col, "business_id"), [venue_col])
    local = joined.withColumn("local_ts", shift_minutes("utc_ts", "tz_offset_min"))
    return local.withColumns(
        {"hour": F.hour("local_ts"), "weekday": F.weekday("local_ts"), "is_weekend": F.weekday("local_ts") >= 5}
    )


def one_to_one(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Best row per left key, then best of those per right key: two passes in sequence, not an optimal matching."""
    order = [-F.col(score), F.col(left), F.col(right)]
    return best_row(best_row(pairs, [left], order), [right], order)


def link_venues(
    a: DataFrame,
    b: DataFrame,
    radius_m: float = 75.0,
    proximity: str = "exp",
    min_confidence: float = 0.5,
    min_similarity: float = 0.1,
    analyzer: str = "word",
    decimals: int = 9,
) -> DataFrame:
    """One-to-one links between venues ``a`` (business_id, lat, lon, text) and ``b`` (poi_id, lat, lon, text).

    Confidence is 0.6 proximity + 0.4 cosine of the category texts; the best partner of each ``a`` counts if it
    is good enough. Text vectors are fitted on all texts of ``a`` and the distinct ones of ``b``.
    """
    near = settle(
        radius_join(a.select("business_id", "lat", "lon"), b.where(F.col("text").isNotNull()).select("poi_id", "lat", "lon"), radius_m)
        .select("business_id", "poi_id", "dist_m")
    )
    text_a = a.select("business_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = b.where(F.col("text").isNotNull()).select("text").distinct()
    counts_a = term_counts(text_a, "business_id", "text", analyzer)
    counts_b = term_counts(kinds, "text", "text", analyzer)
    n_docs = scalar(text_a.agg(rows().alias("n"))) + scalar(kinds.agg(rows().alias("n")))
    both = counts_a.select(F.concat(F.lit("a"), F.col("business_id").cast("string")).alias("doc"), "term", "tf").unionByName(
        counts_b.select(F.concat(F.lit("b"), F.col("text")).alias("doc"), "term", "tf")
    )
    idf = settle(fit_idf(both, n_docs))
    vec_a = transform_tfidf(counts_a, idf, "business_id")
    vec_b = transform_tfidf(counts_b, idf, "text")
    pairs = near.join(b.select("poi_id", "text"), "poi_id")
    scored = cosine_pairs(pairs, vec_a, vec_b, "business_id", "text", "category_sim")
    close = proximity_exp("dist_m") if proximity == "exp" else proximity_linear("dist_m", radius_m)
    scored = scored.withColumn("confidence", F.round(0.6 * close + 0.4 * F.col("category_sim"), decimals)).select(
        "business_id", "poi_id", "dist_m", "category_sim", "confidence"
    )
    best = best_row(scored, ["business_id"], [-F.col("confidence"), F.col("poi_id")])
    good = best.where((F.col("confidence") >= min_confidence) & (F.col("category_sim") >= min_similarity))
    return one_to_one(good, "poi_id", "business_id", "confidence")


# ---------------------------------------------------------------- users


# A place with more visitors is crowded: it may be a user's tail, and its visitors travel in several lists.
CROWD = 1_000
# Users with more places meet the visitors of these in several tasks.
MANY_PLACES = 50_000
# Meetings of (a_user, b_user) that one task counts.
TASK_MEETINGS = 2_000_000


def _tails(places: DataFrame, crowded: DataFrame, keep_back: int) -> DataFrame:
    """(user_id, place_id): each user's ``keep_back`` most visited places as far as they are crowded."""
    w = Window.partitionBy("user_id").orderBy(F.col("weight").desc(), F.col("place_id"))
    at = lookup_join(places, crowded, ["place_id"])
    return at.withColumn("i", F.row_number().over(w)).where(F.col("i") <= keep_back).select("user_id", "place_id")


def _marked(places: DataFrame, tails: DataFrame) -> DataFrame:
    """Add ``tail``, whether the place is one of the user's tails, and ``tails``, their number."""
    back = tails.groupBy("user_id").agg(rows().cast("int").alias("tails"))
    out = lookup_join(places, tails.withColumn("tail", F.lit(True)), ["user_id", "place_id"], "left")
    return lookup_join(out, back, ["user_id"], "left").na.fill(False, ["tail"]).na.fill(0, ["tails"])


def _met_at(a: DataFrame, b: DataFrame, crowded: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a_user, a_tails, b_user, b_tails, n): users of the two sides with the number of places where both were.

    A place's visitors travel as lists to the users of the other side, so a meeting costs one id in a shuffle and its rows are made and
    counted in the task that holds the user. Crowded places have lists of bounded length, users with very many places several tasks.
    """
    pieces = F.ceil(F.coalesce("weight", F.lit(0)) / F.lit(CROWD)).cast("int")
    held = lookup_join(b, crowded, ["place_id"], "left").withColumn("piece", F.pmod(F.xxhash64("user_id"), F.greatest(pieces, F.lit(1))))
    lists = settle(held.groupBy("place_id", "piece", F.col("tails").alias("b_tails")).agg(F.collect_list("user_id").alias("visitors")).drop("piece"))
    many = sizes.where(F.col("size") > MANY_PLACES).select("user_id", F.ceil(F.col("size") / F.lit(MANY_PLACES)).cast("int").alias("slices"))
    ours = lookup_join(a, many, ["user_id"], "left").select(
        F.col("user_id").alias("a_user"), "place_id", F.col("tails").alias("a_tails"), F.coalesce("slices", F.lit(1)).alias("slices")
    )
    loads = lists.groupBy("place_id").agg(F.sum(F.size("visitors")).alias("k")).join(a.groupBy("place_id").agg(rows().alias("n")), "place_id")
    meetings_ = loads.agg(F.sum(F.col("k") * F.col("n")).alias("m")).first()["m"] or 0
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-meetings_ // TASK_MEETINGS))
    met = spread_join(ours, lists, ["place_id"], both=True).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    mine = F.filter("visitors", lambda u: F.pmod(F.xxhash64(u), F.col("slices")) == F.col("slice"))
    met = met.withColumn("visitors", F.when(F.col("slices") == 1, F.col("visitors")).otherwise(mine)).where(F.size("visitors") > 0)
    # Rows of one user and slice lie in one task, so the counts need no further shuffle.
    met = met.select("a_user", "slice", "a_tails", "b_tails", "visitors").repartition(tasks, "a_user", "slice")
    met = met.select("a_user", "slice", "a_tails", "b_tails", F.explode("visitors").alias("b_user"))
    return met.groupBy("a_user", "slice", "a_tails", "b_user", "b_tails").agg(rows().alias("n")).drop("slice")


def visited(visits: DataFrame) -> DataFrame:
    """(user_id, place_id, n): the distinct places of each user with the visits there."""
    known = visits.where(F.col("user_id").isNotNull() & F.col("place_id").isNotNull())
    return settle(known.groupBy("user_id", "place_id").agg(rows().alias("n")))


def _common_places(pa: DataFrame, pb: DataFrame, min_shared: int) -> DataFrame:
    """:func:`candidate_user_pairs` from the places :func:`visited` by the two sides."""
    pa, pb = pa.drop("n"), pb.drop("n")
    weights = pa.unionByName(pb).groupBy("place_id").agg(rows().alias("weight"))
    crowded = settle(weights.where(F.col("weight") > CROWD))
    ta, tb = (settle(_tails(p, crowded, min_shared - 1)) for p in (pa, pb))
    heads_a, heads_b = (_marked(p, t).where("not tail") for p, t in ((pa, ta), (pb, tb)))
    sizes = settle(pa.groupBy("user_id").agg(rows().alias("size")).where(F.col("size") > MANY_PLACES))
    met = _met_at(heads_a, heads_b, crowded, sizes)
    found = settle(met.where(F.col("n") + F.col("a_tails") + F.col("b_tails") >= min_shared))
    done = (F.col("a_tails") == 0) & (F.col("b_tails") == 0)
    cols = ["a_user", "b_user", "n"]
    open_ = found.where(~done).select(*cols)
    ua, ub = F.col("user_id").alias("a_user"), F.col("user_id").alias("b_user")
    one = F.lit(1).cast("bigint").alias("n")
    pairs = open_.select("a_user", "b_user")
    at_a = spread_join(spread_join(pairs, ta.select(ua, "place_id"), ["a_user"]), pb.select(ub, "place_id"), ["b_user", "place_id"])
    at_b = spread_join(spread_join(pairs, tb.select(ub, "place_id"), ["b_user"]), heads_a.select(ua, "place_id"), ["a_user", "place_id"])
    looked = open_.unionByName(at_a.select("a_user", "b_user", one)).unionByName(at_b.select("a_user", "b_user", one))
    enough = looked.groupBy("a_user", "b_user").agg(F.sum("n").alias("n")).where(F.col("n") >= min_shared)
    return found.where(done).select(*cols).unionByName(enough).withColumnRenamed("n", "n_shared")


def candidate_user_pairs(a: DataFrame, b: DataFrame, min_shared: int = 2) -> DataFrame:
    """(a_user, b_user, n_shared) for every pair of users with at least ``min_shared`` common places.

    Two sets with t common places share one outside each set's t - 1 most frequent places. So crowded places among these, the tails, which
    would pair everybody with everybody, are looked up for pairs that met elsewhere only. Nothing is left out.
    """
    return _common_places(visited(a), visited(b), min_shared)


# Weights of common places and of common times in the similarity of two users.
PLACE_WEIGHT, TIME_WEIGHT = 0.6, 0.4


def place_sets(visits: DataFrame, weights: DataFrame) -> DataFrame:
    """(user_id, place_id, pos, size): the distinct places of each user, rarest first. Order and size are found without one big task per user."""
    places = visits.where(F.col("user_id").isNotNull() & F.col("place_id").isNotNull()).select("user_id", "place_id").distinct()
    weighed = lookup_join(places, weights, ["place_id"])
    placed = number_rows(weighed, [F.col("weight").asc(), F.col("place_id").asc()], ["user_id"], "pos")
    sizes = places.groupBy("user_id").agg(rows().alias("size"))
    return settle(lookup_join(placed, sizes, ["user_id"]).select("user_id", "place_id", "pos", "size"))


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    weights = settle(a.where(F.col("user_id").isNotNull()).select("place_id").unionByName(b.where(F.col("user_id").isNotNull()).select("place_id")).groupBy("place_id").agg(rows().alias("weight")))
    return place_sets(a, weights), place_sets(b, weights)


def alike_by_places(sa: DataFrame, sb: DataFrame, jaccard: float, min_shared: int) -> DataFrame:
    """(a_user, b_user): every pair that can have this Jaccard index of its :func:`place_sets` and ``min_shared`` common places.

    A set of n places needs ceil(jaccard n) in common, ``min_shared`` at least, so only its first n - need + 1 places meet, without the most
    visited ones. Sizes must fit. Places beyond the prefix that ends first are at most need - 1 more, so the matches counted in
    the prefixes must already make up the rest of what two sets of these sizes need.
    """
    shared = F.lit(min_shared)

    def head(s: DataFrame, u: str) -> DataFrame:
        need = F.greatest(F.ceil(F.lit(jaccard) * F.col("size") - 1e-9), shared)
        return s.where(F.col("pos") <= F.col("size") - need + 1).select(
            F.col("user_id").alias(f"{u}_user"), "place_id", F.col("size").alias(f"{u}_size"), need.alias(f"{u}_need")
        )

    met = spread_join(head(sa, "a"), head(sb, "b"), ["place_id"], both=True)
    fits = (F.col("a_size") >= jaccard * F.col("b_size") - 1e-9) & (F.col("b_size") >= jaccard * F.col("a_size") - 1e-9)
    counted = met.where(fits).groupBy("a_user", "b_user", "a_size", "b_size", "a_need", "b_need").agg(rows().alias("n"))
    needed = F.greatest(F.ceil(F.lit(jaccard / (1 + jaccard)) * (F.col("a_size") + F.col("b_size")) - 1e-9), shared)
    return counted.where(F.col("n") + F.greatest("a_need", "b_need") - 1 >= needed).select("a_user", "b_user")


def meetings(a: DataFrame, b: DataFrame, hours: float = 72.0, busy: DataFrame | None = None) -> DataFrame:
    """(a_user, b_user, place_id): places where some visit of one user lies within ``hours`` of a visit of the other.

    Users meet by place and by slots of eight windows; the visits are compared where they meet. Visits to ``busy`` places, by default those
    with more than MIN_CHUNK on a side, meet by window-long buckets instead, so a place of a third of all users pairs those of the same days only.
    """
    span = max(int(hours * 3_600_000_000), 1)

    def timed(visits: DataFrame, user: str) -> DataFrame:
        known = visits.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull() & F.col("place_id").isNotNull())
        return known.select(F.col("user_id").alias(user), "place_id", F.unix_micros("ts").alias(f"{user}_t"))

    va, vb = timed(a, "a_user"), timed(b, "b_user")
    if busy is None:
        busy = settle(_busy(va).unionByName(_busy(vb)).distinct())
    crowd = not small_enough(busy, 0)
    ours, theirs = (lookup_join(v, busy, ["place_id"], "left_anti") if crowd else v for v in (va, vb))
    slot = lambda t: F.floor(t / F.lit(8 * span))
    looks = ours.withColumn("slot", F.explode(F.array_distinct(F.array(slot(F.col("a_user_t") - span), slot(F.col("a_user_t") + span)))))
    met = looks.join(theirs.withColumn("slot", slot(F.col("b_user_t"))), ["place_id", "slot"])
    out = met.where(F.abs(F.col("a_user_t") - F.col("b_user_t")) <= span).select("a_user", "b_user", "place_id").distinct()
    if not crowd:
        return out
    return out.unionByName(_crowded_meetings(*(lookup_join(v, busy, ["place_id"], "left_semi") for v in (va, vb)), span))


def _busy(visits: DataFrame) -> DataFrame:
    return visits.groupBy("place_id").agg(rows().alias("n")).where(F.col("n") > MIN_CHUNK).select("place_id")


def _crowded_meetings(a: DataFrame, b: DataFrame, span: int) -> DataFrame:
    """Visits are reduced to the first and last of each window-long bucket: visits in one bucket are always close, and
    neighbouring buckets are close exactly when the last of one and the first of the other are. Users meet by (place, bucket).
    """

    def buckets(visits: DataFrame, user: str) -> DataFrame:
        t = F.col(f"{user}_t")
        return settle(visits.groupBy(user, "place_id", F.floor(t / F.lit(span)).alias("bucket")).agg(F.min(t).alias(f"{user}_lo"), F.max(t).alias(f"{user}_hi")))

    looks = buckets(a, "a_user").withColumn("shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    looks = looks.withColumn("bucket", F.col("bucket") + F.col("shift"))
    met = spread_join(looks, buckets(b, "b_user"), ["place_id", "bucket"], both=True)
    near = (
        F.when(F.col("shift") == 0, F.lit(True))
        .when(F.col("shift") == 1, F.col("b_user_lo") - F.col("a_user_hi") <= span)
        .otherwise(F.col("a_user_lo") - F.col("b_user_hi") <= span)
    )
    return met.where(near).select("a_user", "b_user", "place_id").distinct()


def _timed(a: DataFrame, b: DataFrame, pa: DataFrame, pb: DataFrame, min_shared: int, hours: float) -> DataFrame:
    busy = settle(
        pa.unionByName(pb.select("user_id", "place_id", "n")).groupBy("place_id").agg(F.sum("n").alias("n")).where(F.col("n") > MIN_CHUNK).select("place_id")
    )
    met = meetings(a, b, hours, busy).groupBy("a_user", "b_user").agg(rows().alias("n_met"))
    return _common_places(pa, pb, min_shared).join(met, ["a_user", "b_user"], "left").na.fill(0, ["n_met"])


def temporal_overlap(a: DataFrame, b: DataFrame, min_shared: int = 2, hours: float = 72.0) -> DataFrame:
    """Share of the common places where two users met, for every pair with ``min_shared`` common places."""
    pairs = _timed(a, b, visited(a), visited(b), min_shared, hours)
    return pairs.select("a_user", "b_user", "n_shared", ratio("n_met", "n_shared").alias("temporal_score"))


def _sized_pairs(a: DataFrame, b: DataFrame, min_shared: int, hours: float) -> DataFrame:
    """(a_user, b_user, n_shared, n_met, n_a, n_b): every pair of users with ``min_shared`` common places, at how many of these they met,
    and the numbers of places of each."""
    pa, pb = visited(a), visited(b)
    pairs = _timed(a, b, pa, pb, min_shared, hours)
    for places, user, name in ((pa, "a_user", "n_a"), (pb, "b_user", "n_b")):
        pairs = lookup_join(pairs, settle(places.groupBy(F.col("user_id").alias(user)).agg(rows().alias(name))), [user])
    return pairs


def linkable_pairs(a: DataFrame, b: DataFrame, min_shared: int = 2, hours: float = 72.0, min_combined: float = 0.15) -> DataFrame:
    """Every pair of users with ``min_shared`` common places that can reach the combined similarity: by its places alone, or because it
    met somewhere. a_user, b_user, n_shared, n_a, n_b, n_met."""
    found = _sized_pairs(a, b, min_shared, hours)
    enough = PLACE_WEIGHT * ratio("n_shared", F.col("n_a") + F.col("n_b") - F.col("n_shared")) >= min_combined - 1e-9
    return found.where((F.col("n_met") > 0) | enough)


def score_user_pairs(a: DataFrame, b: DataFrame, min_shared: int = 2, hours: float = 72.0, decimals: int = 9) -> DataFrame:
    """Jaccard of places, temporal overlap, their blend 0.6 / 0.4 and the confidence tier of every pair with ``min_shared`` common places."""
    out = _sized_pairs(a, b, min_shared, hours).withColumns({
        "temporal_score": ratio("n_met", "n_shared"),
        "jaccard": ratio("n_shared", F.col("n_a") + F.col("n_b") - F.col("n_shared")),
    })
    out = out.withColumn("combined_similarity", F.round(PLACE_WEIGHT * F.col("jaccard") + TIME_WEIGHT * F.col("temporal_score"), decimals))
    out = out.withColumn("confidence_tier", confidence_tier())
    return out.select("a_user", "b_user", "n_shared", "temporal_score", "n_a", "n_b", "jaccard", "combined_similarity", "confidence_tier")


def link_users(a: DataFrame, b: DataFrame, min_shared: int = 2, hours: float = 72.0, min_combined: float = 0.15) -> DataFrame:
    """One-to-one user links above the threshold, best score first."""
    good = score_user_pairs(a, b, min_shared, hours).where((F.col("combined_similarity") >= min_combined) & (F.col("confidence_tier") != "noise"))
    return one_to_one(good, "a_user", "b_user", "combined_similarity")


# ---------------------------------------------------------------- friends


def undirected(friendships: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct friendships with the smaller id first, without self loops."""
    pairs = friendships.where(F.col(a) != F.col(b))
    return pairs.select(F.least(a, b).alias("user_a"), F.greatest(a, b).alias("user_b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each friendship once per direction as (u, w)."""
    return edges.select(F.explode(F.array(
        F.struct(F.col("user_a").alias("u"), F.col("user_b").alias("w")),
        F.struct(F.col("user_b").alias("u"), F.col("user_a").alias("w")),
    )).alias("e")).select("e.u", "e.w")


def endpoints(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("u").alias("user_id")).distinct()


def neighbors(edges: DataFrame, nodes: DataFrame, key: str = "user_id") -> DataFrame:
    """(u, w): friends of the given users."""
    return spread_join(both_ways(edges), nodes.select(F.col(key).alias("u")).distinct(), ["u"], "left_semi")


def friend_counts(edges: DataFrame, nodes: DataFrame, key: str = "user_id") -> DataFrame:
    return neighbors(edges, nodes, key).groupBy(F.col("u").alias(key)).agg(rows().alias("friend_count"))


# Entries of one list that travels; longer ones are cut.
LIST = 4096


def _listed(df: DataFrame, by: str, *values: str) -> DataFrame:
    """(by, values): the values of a key as one array each, in order of the first, of some ``LIST`` entries at most; a hot key has several rows."""
    hot = F.broadcast(hot_keys(df, [by], LIST))
    piece = F.pmod(F.xxhash64(*values), F.coalesce("pieces", F.lit(1))).alias("piece")
    packed = df.join(hot, by, "left").select(by, piece, F.struct(*values).alias("x"))
    packed = packed.groupBy(by, "piece").agg(F.sort_array(F.collect_list("x")).alias("x"))
    # Plain arrays take a third of the room of an array of structs.
    return packed.select(by, *[F.col("x")[c].alias(c) for c in values])


# Pairs that one task makes and counts, some 100 bytes each.
MEETINGS = 2_000_000


def _dealt(met: DataFrame, left: DataFrame, right: DataFrame, on: str, to: str) -> DataFrame:
    """``met``, lists of ``right`` per row of ``left``, in partitions by ``to``: as many as keep the pairs of one task few, however
    little room lists take in a shuffle."""
    count = lambda df, name: df.groupBy(on).agg(rows().alias(name))
    pairs = count(left, "n").join(count(right, "m"), on).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    least = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(max(least, -(-int(pairs) // MEETINGS)), to)


def friends_of_friends(edges: DataFrame, nodes: DataFrame, key: str = "user_id", scope: str = "linked", carry: str | None = None) -> DataFrame:
    """(u, w): two steps away, neither the user nor a friend; with ``carry`` that column of ``nodes`` too, one value per node.

    ``linked`` sees only friendships touching one of the users; ``full`` sees all. The users who know a person travel as lists to that
    person's friends; pairs are made, told apart and rid of friends where ``w`` lies, so no pair is shuffled.
    """
    sym = both_ways(edges)
    ids = nodes.select(F.col(key).alias("u"), (F.col(carry) if carry else F.lit(None).cast("double")).alias("carried")).dropDuplicates(["u"])
    direct = sym.join(ids, "u").select("u", "carried", F.col("w").alias("mid"))
    second = sym.select(F.col("u").alias("mid"), "w")
    if scope == "linked":
        ends = F.array(F.struct(F.col("u").alias("mid"), F.col("mid").alias("w")), F.struct(F.col("mid").alias("mid"), F.col("u").alias("w")))
        second = direct.select(F.explode(ends).alias("e")).select("e.mid", "e.w").distinct()
    kept = ["u", "carried"] if carry else ["u"]
    lists = _listed(direct, "mid", *kept)
    far = spread_join(second, lists, ["mid"]).select("w", F.lit(False).alias("friend"), *kept)
    near = lists.select(F.col("mid").alias("w"), F.lit(True).alias("friend"), *kept)
    met = _dealt(far.unionByName(near), second, direct, "mid", "w").select("w", "friend", F.explode(F.arrays_zip(*kept)).alias("x")).where(F.col("x.u") != F.col("w"))
    more = [F.max("x.carried").alias(carry)] if carry else []
    return met.groupBy(F.col("x.u").alias("u"), "w").agg(F.max("friend").alias("friend"), *more).where(~F.col("friend")).drop("friend")


def friend_visits(edges: DataFrame, visits: DataFrame) -> DataFrame:
    """(user, venue): number of friends who visited the venue. A friend's venues travel as lists and are counted where the user lies."""
    seen = visits.where(F.col("user_id").isNotNull()).select(F.col("user_id").alias("w"), "business_id").distinct()
    ways = both_ways(edges)
    met = spread_join(ways, _listed(seen, "w", "business_id"), ["w"]).select(F.col("u").alias("user_id"), "business_id")
    shown = _dealt(met, ways, seen, "w", "user_id").select("user_id", F.explode("business_id").alias("business_id"))
    return shown.groupBy("user_id", "business_id").agg(rows().alias("friend_visits"))


def social_venue_signals(
    bridge: DataFrame, edges: DataFrame, checkins: DataFrame, fof_weight: float = 0.3, scope: str = "linked"
) -> DataFrame:
    """Per venue: visits of linked users' friends and friends of friends weighted by link confidence, distinct
    visiting friends with their log, and the mean confidence.

    ``bridge``: b_user_id, confidence; ``checkins``: b_user_id, business_id. Confidence is summed per friend before
    it meets the visits, so a friend's venues are read once, however many linked users know them.
    """
    visits = checkins.groupBy(F.col("b_user_id").alias("w"), "business_id").agg(rows().alias("n"))
    conf = bridge.select(F.col("b_user_id").alias("u"), "confidence")
    nodes = bridge.select("b_user_id")

    def reach(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("w").agg(F.sum("confidence").alias("conf"), rows().alias("k"))

    near = reach(neighbors(edges, nodes, "b_user_id").join(conf, "u")).join(visits, "w").groupBy("business_id").agg(
        F.sum(F.col("n") * F.col("conf")).alias("friend_checkin_count"),
        rows().alias("social_unique_visitors"),
        ratio(F.sum("conf"), F.sum("k")).alias("mean_bridge_confidence"),
    )
    far = reach(friends_of_friends(edges, bridge, "b_user_id", scope, "confidence")).join(visits, "w").groupBy("business_id").agg(
        (F.sum(F.col("n") * F.col("conf")) * fof_weight).alias("fof_checkin_count")
    )
    return near.join(far, "business_id", "outer").select(
        "business_id",
        F.coalesce("friend_checkin_count", F.lit(0.0)).alias("friend_checkin_count"),
        F.coalesce("fof_checkin_count", F.lit(0.0)).alias("fof_checkin_count"),
        F.coalesce("social_unique_visitors", F.lit(0)).alias("social_unique_visitors"),
        F.log1p(F.coalesce("social_unique_visitors", F.lit(0))).alias("social_diversity_index"),
        F.coalesce("mean_bridge_confidence", F.lit(0.0)).alias("mean_bridge_confidence"),
    )
