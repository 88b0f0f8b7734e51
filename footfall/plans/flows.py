"""Composed flows: from an interaction log to a ranking, its evaluation and robustness over split dates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators import baseline as bl
from footfall.operators import cf, evaluate as evl, events as ev, features as ft, graph as gr
from footfall.operators.scale import scalar
from footfall.session import settle


def rank_venues(inter: DataFrame, decay_until=None, social: DataFrame | None = None, **options) -> gr.Ranking:
    """Bipartite ranking with behavioural priors from the given interactions only; optionally with faded edges and a
    selective social prior."""
    edges = ev.edges(inter) if decay_until is None else ev.edges(inter, "decay", F.lit(decay_until).cast("timestamp"))
    p0, q0 = gr.behavioural_priors(edges, ft.user_features(inter), ft.venue_features(inter))
    if social is not None:
        q0 = gr.selective_social_prior(q0, social)
    return gr.birank(edges, p0, q0, **options)


def method_rankings(train: DataFrame, split_date: str, social: DataFrame | None = None, **options) -> DataFrame:
    """(method, business_id, score) of the graph variants and the baselines, from training data only."""
    parts = {
        "graph": rank_venues(train, **options).venues,
        "graph_decay": rank_venues(train, split_date, **options).venues,
        "rating": bl.rating(train).select("business_id", F.col("rating_mean").alias("score")),
        "popularity": bl.popularity(train).select("business_id", F.col("popularity_visits").cast("double").alias("score")),
        "iuf": bl.inverse_user_frequency(train).select("business_id", F.col("iuf").alias("score")),
        "random": bl.random_score(train),
        "item_knn": cf.item_knn(ev.edges(train)),
    }
    if social is not None:
        parts["graph_social"] = rank_venues(train, None, social, **options).venues
        parts["graph_combined"] = rank_venues(train, split_date, social, **options).venues
    out = None
    for name, df in parts.items():
        labelled = df.select(F.lit(name).alias("method"), "business_id", "score")
        out = labelled if out is None else out.unionByName(labelled)
    return out


def run_split(inter: DataFrame, split_date: str, social: DataFrame | None = None, reference: str = "popularity", replicates: int = 1000, **options) -> DataFrame:
    """Method table of one split. ``n_overlap`` counts the users on both sides: callers decide how few are too few."""
    train, test = ev.temporal_split(inter, split_date)
    overlap = scalar(ev.overlap_users(train, test).agg(F.count(F.lit(1)).alias("n")))
    tr, te = evl.split_pairs(train, test)
    scores = settle(method_rankings(train, split_date, social, **options))
    per_user = settle(evl.user_metrics(evl.rerank(tr, te, scores, ["method"]), ["method"]))
    return evl.method_table(per_user, reference, replicates).withColumns({"split_date": F.lit(split_date), "n_overlap": overlap})


def run_splits(inter: DataFrame, dates: Sequence[str], **options) -> DataFrame:
    """The method tables of several split dates in one frame."""
    return reduce(DataFrame.unionByName, [run_split(inter, d, **options) for d in dates])
