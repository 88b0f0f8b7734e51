"""Iterative ranking of a weighted user-venue graph, its priors, and per-segment variants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalar import ratio
from footfall.operators.scale import MIN_CHUNK, attach, lookup_join, small_enough
from footfall.session import settle

PRIOR_FLOOR = 1e-10


@dataclass
class Ranking:
    """Scores of both sides and one log row ``(iteration, change of users, change of venues)`` per step."""

    users: DataFrame
    venues: DataFrame
    log: list[tuple[int, float, float]] = field(default_factory=list)


def normalize_sum(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Scale ``col`` to sum 1, over the whole table or within ``by``."""
    by = list(by)
    total = df.groupBy(*by).agg(F.sum(col).alias("_total")) if by else df.agg(F.sum(col).alias("_total"))
    return attach(df, total, by).withColumn(col, ratio(col, "_total", 0.0)).drop("_total")


def normalize_edges(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges with ``w_user`` (weight over the user's total) and ``w_venue`` (over the venue's total)."""
    by = list(by)
    out = edges
    for key, name in (("user_id", "w_user"), ("business_id", "w_venue")):
        total = edges.groupBy(*by, key).agg(F.sum("weight").alias("_t"))
        total = total.withColumn("_t", F.when(F.col("_t") == 0, F.lit(1.0)).otherwise(F.col("_t")))
        out = lookup_join(out, total, [*by, key]).withColumn(name, F.col("weight") / F.col("_t")).drop("_t")
    return out.select(*by, "user_id", "business_id", "w_user", "w_venue")


def birank(
    edges: DataFrame,
    p0: DataFrame | None = None,
    q0: DataFrame | None = None,
    alpha: float = 0.85,
    beta: float = 0.85,
    max_iter: int = 200,
    tol: float | None = 1e-8,
    update: str = "gs",
    norm: str = "l1",
    by: Sequence[str] = (),
    cells: Sequence[tuple[float, float]] | None = None,
    assign_last: bool = True,
    max_broadcast: int = 2_000_000,
    chunk: int = MIN_CHUNK,
) -> Ranking:
    """Mutual ranking of users and venues.

    ``gs`` uses the new user scores for the venue step, ``jacobi`` the previous ones. Priors are frames
    ``(node id, prior)``, optionally per ``by`` group and per ``cell``; a node without prior gets 1. ``cells``
    runs several (alpha, beta) settings at once: only the score vectors multiply, never the edges.
    ``tol=None`` runs exactly ``max_iter`` steps.

    The edges are normalised and written once. A step joins one vector and aggregates, so only partial sums
    are shuffled; a vector travels as a broadcast only after its rows were counted, and beyond that the edges
    of hot nodes are spread over several tasks.
    """
    by = list(by)
    many = cells is not None
    settings = list(cells) if many else [(alpha, beta)]
    keys = [*by, "cell"]

    # A user's edges, at most one per venue, lie together, so that a task adds them up before anything is shuffled.
    edge = settle(normalize_edges(edges, by).repartition(*by, "user_id"))
    sides = {
        "user": _Side(edge, "user_id", "w_venue", by, p0, settings, chunk),
        "venue": _Side(edge, "business_id", "w_user", by, q0, settings, chunk),
    }
    user, venue = sides["user"], sides["venue"]
    light = {name: small_enough(side.start, max_broadcast) for name, side in sides.items()}
    if not all(light.values()):
        for name, side in sides.items():
            if not light[name]:
                edge = side.assign_pieces(edge)
        edge = settle(edge)

    a = F.element_at(F.array(*[F.lit(float(x)) for x, _ in settings]), F.col("cell") + 1)
    b = F.element_at(F.array(*[F.lit(float(x)) for _, x in settings]), F.col("cell") + 1)

    def advance(target: _Side, source: _Side, vector: DataFrame, old: DataFrame, weight: str, damp: Column, flat: bool):
        """damp x (weighted mean of the source scores) + (1 - damp) x prior, scaled to sum 1."""
        # The scores will add up to damp x (source scores . source reach) + (1 - damp), known before the join.
        total = vector.groupBy(*keys).agg(F.sum(F.col("score") * F.col("reach")).alias("_mass"))
        # The scores of all settings are one row per node, so an edge meets them once.
        each = range(len(settings))
        incoming = vector.select(*by, source.key, F.col("score").alias("s0")) if not many else vector.groupBy(*by, source.key).agg(
            *[F.max(F.when(F.col("cell") == c, F.col("score"))).alias(f"s{c}") for c in each]
        )
        if flat:
            met = edge.join(F.broadcast(incoming), [*by, source.key])
        else:
            met = edge.join(source.explode_pieces(incoming), [*by, source.key, source.piece])
        sums = met.groupBy(*by, target.key).agg(*[F.sum(F.col(weight) * F.col(f"s{c}")).alias(f"f{c}") for c in each])
        flow = sums.select(*by, target.key, F.posexplode(F.array(*[F.col(f"f{c}") for c in each])).alias("cell", "_flow"))
        # One row per group and setting; groups are counted with the vectors, so AQE may broadcast it.
        moved = old.join(flow, [*keys, target.key], "left").join(total, keys)
        raw = damp * F.coalesce("_flow", F.lit(0.0)) + (1 - damp) * F.col("prior")
        return settle(
            moved.select(
                *keys,
                target.key,
                "prior",
                "reach",
                (raw / (damp * F.col("_mass") + (1 - damp))).alias("score"),
                F.col("score").alias("before"),
            )
        )

    p, q = user.start, venue.start
    log: list[tuple[int, float, float]] = []
    for step in range(1, max_iter + 1):
        p_new = advance(user, venue, q, p, "w_user", a, light["venue"])
        from_users = p_new if update == "gs" else p
        q_new = advance(venue, user, from_users, q, "w_venue", b, light["user"])
        if tol is not None:
            dp, dq = _change(p_new, keys, norm), _change(q_new, keys, norm)
            log.append((step, dp, dq))
            done = (dp < tol and dq < tol) if norm == "l1" else dp + dq < tol
            if done and not assign_last:
                break
            p, q = p_new, q_new
            if done:
                break
        else:
            p, q = p_new, q_new
    label = [*by, *(["cell"] if many else [])]
    return Ranking(p.select(*label, "user_id", "score"), q.select(*label, "business_id", "score"), log)


def _change(vector: DataFrame, keys: Sequence[str], norm: str) -> float:
    diff = F.abs(F.col("score") - F.col("before"))
    per = vector.groupBy(*keys).agg((F.sum(diff) if norm == "l1" else F.max(diff)).alias("d"))
    return float(per.agg(F.max("d")).first()[0] or 0.0)


class _Side:
    """One side of the graph: start vector with priors, and the pieces of its hot nodes."""

    def __init__(self, edge, key, reach_weight, by, prior, settings, chunk):
        self.key, self.by, self.piece = key, list(by), f"{key}_piece"
        # reach: what one unit of this node's score adds to the other side in total.
        nodes = (
            edge.groupBy(*self.by, key)
            .agg(F.sum(reach_weight).alias("reach"), F.count(F.lit(1)).alias("degree"))
            .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))))
        )
        if prior is None:
            nodes = nodes.withColumn("prior", F.lit(1.0))
        else:
            on = [c for c in [*self.by, "cell", key] if c in prior.columns]
            nodes = nodes.join(prior.select(*on, "prior"), on, "left").withColumn(
                "prior", F.coalesce("prior", F.lit(1.0))
            )
        vec = normalize_sum(nodes, "prior", [*self.by, "cell"])
        self.chunk = chunk
        self.degrees = nodes.where(F.col("cell") == 0).select(
            *self.by, key, F.ceil(F.col("degree") / F.lit(chunk)).cast("int").alias("pieces")
        )
        self.start = settle(vec.select(*self.by, "cell", key, "prior", F.col("prior").alias("score"), "reach"))

    def assign_pieces(self, edge: DataFrame) -> DataFrame:
        other = "business_id" if self.key == "user_id" else "user_id"
        self.degrees = settle(self.degrees)
        hot = self.degrees.where(F.col("pieces") > 1)
        marked = lookup_join(edge, hot, [*self.by, self.key], "left")
        return marked.withColumn(
            self.piece, F.pmod(F.xxhash64(other), F.coalesce("pieces", F.lit(1))).cast("int")
        ).drop("pieces")

    def explode_pieces(self, vector: DataFrame) -> DataFrame:
        return (
            vector.join(self.degrees, [*self.by, self.key])
            .withColumn(self.piece, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .drop("pieces")
        )


# ---------------------------------------------------------------- priors


def behavioural_priors(edges: DataFrame, users: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users: log visits x (1 - burstiness). Venues: repeat share / (1 + weekly cv). Unknown values are neutral."""
    u = edges.select("user_id").distinct().join(users.select("user_id", "total_visits", "burstiness_index"), "user_id", "left")
    w = (
        edges.select("business_id")
        .distinct()
        .join(venues.select("business_id", "repeat_user_rate", "stability_cv"), "business_id", "left")
    )
    p = F.log1p(F.coalesce("total_visits", F.lit(1))) * (1 - F.coalesce("burstiness_index", F.lit(0.0)))
    q = F.coalesce("repeat_user_rate", F.lit(0.0)) / (1 + F.coalesce("stability_cv", F.lit(1.0)))
    floor = F.lit(PRIOR_FLOOR)
    return u.select("user_id", F.greatest(p, floor).alias("prior")), w.select(
        "business_id", F.greatest(q, floor).alias("prior")
    )


def hotel_priors(
    users: DataFrame, venues: DataFrame, cross_domain: DataFrame | None = None, social: DataFrame | None = None,
    gamma: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """Hotel priors for nodes with features (others default to 1 in the ranking).

    ``social`` (business_id, signal) is blended in with weight ``gamma``; ``cross_domain`` (user_id, weight)
    multiplies the user prior.
    """
    q = (
        0.4 * F.coalesce("review_velocity", F.lit(0.0))
        + 0.3 * F.coalesce("geographic_diversity", F.lit(0.0))
        + 0.2 * 50 * F.coalesce("multi_stay_rate", F.lit(0.0))
        + 0.1 * (1 - F.coalesce("seasonal_cv", F.lit(0.5)))
    )
    if social is not None:
        venues = venues.join(social.select("business_id", "signal"), "business_id", "left")
        q = (1 - gamma) * q + gamma * F.coalesce("signal", F.lit(0.0))
    p = 0.6 * F.coalesce("hotel_frequency", F.lit(1.0)) + 0.4 * F.coalesce("hotel_city_diversity", F.lit(0.0))
    p = F.greatest(p, F.lit(0.01))
    if cross_domain is not None:
        users = users.join(cross_domain.select("user_id", F.col("weight").alias("_w")), "user_id", "left")
        p = p * F.coalesce("_w", F.lit(1.0))
    return users.select("user_id", p.alias("prior")), venues.select(
        "business_id", F.greatest(q, F.lit(0.01)).alias("prior")
    )


def _boost(signals: DataFrame, raw: Column, confidence: str | None) -> DataFrame:
    scored = signals.withColumn("_raw", raw)
    top = scored.agg(F.max("_raw").alias("_top"))
    value = F.col("_raw") / F.greatest(F.col("_top"), F.lit(1e-10))
    if confidence:
        value = value * F.col(confidence)
    return attach(scored, top, []).select("business_id", value.alias("boost"))


def _blend(base: DataFrame, boost: DataFrame, gamma: float, only_present: bool) -> DataFrame:
    joined = base.join(boost, "business_id", "left")
    mixed = (1 - gamma) * F.col("prior") + gamma * F.coalesce("boost", F.lit(0.0))
    if only_present:
        mixed = F.when(F.col("boost").isNull(), F.col("prior")).otherwise(mixed)
    return joined.select("business_id", F.greatest(mixed, F.lit(PRIOR_FLOOR)).alias("prior"))


def social_prior(base: DataFrame, signals: DataFrame, gamma: float = 0.2, use: str = "friend") -> DataFrame:
    """Venue prior blended with the friends' visits (``friend``), with friends of friends (``both``) or those alone
    (``fof``), each as log count over its maximum times the mean link confidence."""
    friend, fof = F.log1p("friend_checkin_count"), 0.3 * F.log1p("fof_checkin_count")
    raw = {"friend": friend, "both": friend + fof, "fof": fof}[use]
    return _blend(base, _boost(signals, raw, "mean_bridge_confidence"), gamma, only_present=False)


def selective_social_prior(base: DataFrame, signals: DataFrame, gamma: float = 0.15, min_confidence: float = 0.3) -> DataFrame:
    """As :func:`social_prior`, but only venues with confident signals change."""
    trusted = signals.where(F.col("mean_bridge_confidence") >= min_confidence)
    boost = _boost(trusted, F.log1p("friend_checkin_count"), "mean_bridge_confidence")
    return _blend(base, boost, gamma, only_present=True)


def volume_prior(base: DataFrame, linked_checkins: DataFrame, gamma: float = 0.2) -> DataFrame:
    """Venue prior blended with the log number of second-platform check-ins over its maximum."""
    counts = linked_checkins.groupBy("business_id").agg(F.count(F.lit(1)).alias("n"))
    return _blend(base, _boost(counts, F.log1p("n"), None), gamma, only_present=False)


def full_prior(base: DataFrame, signals: DataFrame, linked_checkins: DataFrame, gamma: float = 0.2) -> DataFrame:
    """Mean of the social prior (friends and their friends) and the volume prior."""
    s = social_prior(base, signals, gamma, "both").withColumnRenamed("prior", "s")
    v = volume_prior(base, linked_checkins, gamma).withColumnRenamed("prior", "v")
    return s.join(v, "business_id").select(
        "business_id", F.greatest((F.col("s") + F.col("v")) / 2, F.lit(PRIOR_FLOOR)).alias("prior")
    )


def centrality_prior(base: DataFrame, friend_counts: DataFrame, cap: int = 500) -> DataFrame:
    """User prior times 1 + min(1, log friends / log cap); users without link keep their prior."""
    times = 1 + F.least(F.lit(1.0), F.log1p(F.coalesce("friend_count", F.lit(0))) / F.log1p(F.lit(cap)))
    return base.join(friend_counts.select("user_id", "friend_count"), "user_id", "left").select(
        "user_id", F.greatest(F.col("prior") * times, F.lit(PRIOR_FLOOR)).alias("prior")
    )


# ---------------------------------------------------------------- one-step scores


def degree_score(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Venues scored by the sum of 1 / degree of their users, scaled to sum 1 (per segment)."""
    by = list(by)
    deg = edges.groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("degree"))
    raw = (
        edges.select(*by, "user_id", "business_id")
        .join(deg, [*by, "user_id"])
        .groupBy(*by, "business_id")
        .agg(F.sum(F.lit(1.0) / F.col("degree")).alias("score"))
    )
    return normalize_sum(raw, "score", by)
