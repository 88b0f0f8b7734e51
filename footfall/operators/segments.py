"""User segments: rules, clustering, naming, summaries and segment-specific rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalar import ratio
from footfall.operators.features import gap_moments, pair_counts, rows
from footfall.operators.scale import attach, scalar, scalar_quantiles, top_k
from footfall.operators.stats import summary


def assign_user_groups(users: DataFrame) -> DataFrame:
    """Rule-based segment per user; the last matching rule wins, so the arms run from last to first."""
    revisits, visits = F.col("revisit_ratio"), F.col("total_visits")
    label = (
        F.when((visits >= 4) & (revisits < 0.25), F.lit("Weekday Regulars"))
        .when((visits <= 2) & (revisits < 0.25), F.lit("Infrequent Visitors"))
        .when(revisits >= 0.25, F.lit("Loyalists"))
        .otherwise(F.lit("Casual Weekenders"))
    )
    return users.select("user_id", label.alias("segment"))


def segment_summary(df: DataFrame, columns: Sequence[str], segment: str = "segment") -> DataFrame:
    """Per segment: size, share of all users, and the statistics of each feature."""
    out = summary(df, columns, [segment])
    return out.withColumn("share", ratio("rows", scalar(df.agg(rows().alias("n")))))


def segment_patterns(inter: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment: visits per (user, venue), venues per user, mean deviation of visit gaps (seconds), users, events."""
    pairs = pair_counts(inter)
    users = pairs.groupBy("user_id").agg(rows().alias("venues"), F.sum("n").alias("visits"))
    gaps = gap_moments(inter, "user_id").select("user_id", (F.col("gap_std") * 86400.0).alias("gap_std_s"))
    per = users.join(gaps, "user_id", "left").join(segments.select("user_id", "segment"), "user_id")
    return per.groupBy("segment").agg(
        ratio(F.sum("visits"), F.sum("venues")).alias("avg_visits_per_venue"),
        F.avg("venues").alias("avg_venues_per_user"),
        F.avg("gap_std_s").alias("temporal_regularity"),
        rows().alias("total_users"),
        F.sum("visits").alias("total_interactions"),
    )


def dominant_segment(inter: DataFrame, segments: DataFrame, min_events: int = 10) -> DataFrame:
    """Most frequent segment per venue and its share of all known-user events (unsegmented ones included)."""
    events = inter.where(F.col("user_id").isNotNull()).groupBy("business_id", "user_id").agg(rows().alias("n"))
    per = (
        events.join(segments.select("user_id", "segment"), "user_id", "left")
        .groupBy("business_id", "segment")
        .agg(F.sum("n").alias("n"))
    )
    known = F.col("segment").isNotNull()
    top = F.struct(F.when(known, -F.col("n")).otherwise(F.lit(0)), F.col("segment"))
    out = per.groupBy("business_id").agg(
        F.sum("n").alias("total_interactions"),
        F.min_by(F.when(known, F.col("segment")), top).alias("dominant_segment"),
        F.max(F.when(known, F.col("n"))).alias("_n"),
    )
    return out.where(F.col("total_interactions") >= min_events).select(
        "business_id", "dominant_segment", ratio("_n", "total_interactions", 0.0).alias("dominant_share"), "total_interactions"
    )


def venue_kinds(venues: DataFrame, rate: str = "revisit_rate") -> DataFrame:
    """Repeat venues above 0.3, exploratory ones below 0.1."""
    return venues.withColumn(
        "kind", F.when(F.col(rate) > 0.3, F.lit("repeat")).when(F.col(rate) < 0.1, F.lit("exploratory"))
    )


def rank_deltas(global_ranks: DataFrame, segment_ranks: DataFrame) -> DataFrame:
    """Rank in every segment minus global rank; both stay NULL where the segment doesn't rank the venue (``is_ranked`` false)."""
    labels = segment_ranks.select("segment").distinct().agg(F.collect_set("segment").alias("s"))
    # Segments are a handful of labels; each venue meets each label once.
    every = global_ranks.select("business_id", F.col("rank").alias("global_rank")).withColumn("segment", F.explode(scalar(labels)))
    ranks = segment_ranks.select("segment", "business_id", F.col("rank").alias("segment_rank"))
    out = every.join(ranks, ["segment", "business_id"], "outer")
    return out.withColumns({"delta": F.col("segment_rank") - F.col("global_rank"), "is_ranked": F.col("segment_rank").isNotNull()})


def most_promoted(deltas: DataFrame, n: int = 5) -> DataFrame:
    ranked = deltas.where("is_ranked")
    return top_k(ranked, n, [F.col("delta").asc(), F.col("business_id")], ["segment"], "place")


def segment_specific(ranks: DataFrame, k: int = 20, n: int = 3) -> DataFrame:
    """Venues in a segment's top ``k`` whose mean rank elsewhere is worst, ``n`` per segment."""
    total = ranks.groupBy("business_id").agg(F.sum("rank").alias("_s"), rows().alias("_k"))
    head = ranks.where(F.col("rank") <= k).select("segment", "business_id", "rank").join(total, "business_id").where(F.col("_k") > 1)
    elsewhere = (F.col("_s") - F.col("rank")) / (F.col("_k") - 1).cast("double")
    diff = head.withColumn("rank_diff", elsewhere - F.col("rank")).select("segment", "business_id", "rank", "rank_diff")
    return top_k(diff, n, [F.col("rank_diff").desc(), F.col("business_id")], ["segment"], "place")


def segment_digest(segment_ranks: DataFrame, global_ranks: DataFrame, venues: DataFrame, k: int = 10) -> DataFrame:
    """Mean revisit rate, users and global rank of each segment's top venues."""
    head = segment_ranks.where(F.col("rank") <= k).select("segment", "business_id")
    joined = head.join(global_ranks.select("business_id", F.col("rank").alias("global_rank")), "business_id", "left").join(
        venues.select("business_id", "revisit_rate", "unique_users"), "business_id", "left"
    )
    return joined.groupBy("segment").agg(
        F.avg("revisit_rate").alias("revisit_rate"), F.avg("unique_users").alias("unique_users"), F.avg("global_rank").alias("global_rank")
    )


# ---------------------------------------------------------------- learnt segments


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the exact column median."""
    from footfall.operators.scale import quantiles
    from footfall.session import settle

    med = settle(quantiles(df, columns, {"p50": 0.5}))
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), scalar(med.select(f"{c}_p50"))) for c in columns})


def standardize(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Columns scaled to mean 0 and population deviation 1 (flat columns become 0), packed in one vector."""
    from pyspark.ml.feature import VectorAssembler

    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("x"))
    packed = scalar(stats)
    scaled = df.withColumns(
        {f"_z_{c}": F.coalesce(ratio(F.col(c).cast("double") - packed[c]["m"], packed[c]["s"]), F.lit(0.0)) for c in columns}
    )
    names = [f"_z_{c}" for c in columns]
    return VectorAssembler(inputCols=names, outputCol=out).transform(scaled).drop(*names)


def cluster(df: DataFrame, columns: Sequence[str], k: int = 4, restarts: int = 10, seed: int = 42):
    """k-means on standardised columns, best of several starts. Returns (rows with ``cluster``, inertia)."""
    from pyspark.ml.clustering import KMeans

    from footfall.session import settle

    vectors = settle(standardize(df, columns))
    best = None
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, maxIter=100, tol=1e-6).fit(vectors)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    out = best.transform(vectors).withColumnRenamed("prediction", "cluster").drop("features")
    return out, best.summary.trainingCost


def elbow(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 11), restarts: int = 1, seed: int = 42) -> DataFrame:
    """Inertia for each number of clusters."""
    from pyspark.ml.clustering import KMeans

    from footfall.session import settle

    vectors = settle(standardize(df, columns))
    found = []
    for k in ks:
        costs = [KMeans(k=k, seed=seed + i, maxIter=100).fit(vectors).summary.trainingCost for i in range(restarts)]
        found.append((int(k), float(min(costs))))
    # One row per k.
    return df.sparkSession.createDataFrame(found, "k int, inertia double")


def pca(df: DataFrame, columns: Sequence[str], n: int = 2):
    """First components of the standardised columns; returns (rows with pc1.., explained shares)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    vectors = standardize(df, columns)
    model = PCA(k=n, inputCol="features", outputCol="pc").fit(vectors)
    out = model.transform(vectors).withColumn("pc", vector_to_array("pc"))
    return out.select(*df.columns, *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(n)]), list(model.explainedVariance)


# Labels and thresholds.
def name_coffee_clusters(clustered: DataFrame) -> DataFrame:
    """Describe each cluster by its mean revisit ratio, number of venues and gap between visits."""
    means = clustered.groupBy("cluster").agg(
        F.avg("revisit_ratio").alias("r"), F.avg("unique_venues").alias("u"), F.avg("avg_time_gap_days").alias("g")
    )
    name = (
        F.when((F.col("r") > 0.3) & (F.col("u") < 3), F.lit("High-persistence, low-exploration (Loyalist)"))
        .when((F.col("r") < 0.15) & (F.col("u") > 5), F.lit("Low-persistence, high-exploration (Explorer)"))
        .when(F.col("g") < 30, F.lit("Frequent, regular visitor (Routine)"))
        .otherwise(F.lit("Moderate engagement (Casual)"))
    )
    # One row per cluster.
    return clustered.join(F.broadcast(means.select("cluster", name.alias("segment"))), "cluster")


# Labels and thresholds.
def name_hotel_clusters(clustered: DataFrame) -> DataFrame:
    """Name the guest clusters by their means; a repeated name is told apart by its weekday share."""
    cols = ("hotel_frequency", "n_states_visited", "weekday_fraction", "hotel_city_diversity", "total_hotel_reviews")
    means = clustered.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols])
    name = (
        F.when((F.col("hotel_frequency") > 1.5) & (F.col("n_states_visited") > 3) & (F.col("weekday_fraction") > 0.6), F.lit("Road Warriors"))
        .when((F.col("weekday_fraction") < 0.55) & (F.col("hotel_frequency") < 2.0), F.lit("Leisure Travelers"))
        .when((F.col("hotel_city_diversity") > 1.0) & (F.col("total_hotel_reviews") > 3), F.lit("Budget Explorers"))
        .otherwise(F.lit("One-Time Tourists"))
    )
    typical = means.agg(F.avg("weekday_fraction").alias("m")).scalar()
    named = means.select("cluster", name.alias("segment"), (F.col("weekday_fraction") > typical).alias("_work"))
    again = F.row_number().over(Window.partitionBy("segment").orderBy("cluster")) > 1
    suffix = F.when(again, F.when(F.col("_work"), F.lit(" (Business)")).otherwise(F.lit(" (Leisure)"))).otherwise(F.lit(""))
    named = named.withColumn("segment", F.concat("segment", suffix)).drop("_work")
    # One row per cluster.
    return clustered.join(F.broadcast(named), "cluster")


def name_segments_by_peak(clustered: DataFrame, peaks: Sequence[tuple[str, str]], other: str = "Mixed / Average") -> DataFrame:
    """Give each label to the cluster with the highest mean of its column, earlier labels first; the rest is ``other``."""
    means = clustered.groupBy("cluster").agg(*[F.avg(c).alias(c) for c, _ in peaks])
    firsts = means.agg(*[F.min_by("cluster", F.struct(-F.col(c), F.col("cluster"))).alias(f"w{i}") for i, (c, _) in enumerate(peaks)])
    row = scalar(firsts.select(F.struct("*").alias("s")))
    label = F
    for i, (_, text) in enumerate(peaks):
        label = label.when(F.col("cluster") == row[f"w{i}"], F.lit(text))
    return clustered.withColumn("segment", label.otherwise(F.lit(other)))


# Labels of the peaks by column, in order of precedence.
# Labels and thresholds.
RESTAURANT_PEAKS = (
    ("venue_entropy", "Explorer"),
    ("revisit_ratio", "Loyalist"),
    ("parking_sensitivity", "Convenience-Seeker"),
    ("nightlife_affinity", "Nightlife / Ride-Share Candidate"),
)


def critic_tag(df: DataFrame, col: str = "avg_visited_rating", band: float = 0.3) -> DataFrame:
    """Critic, Casual or Moderate by the distance of a user's mean rating from the median."""
    (median,) = scalar_quantiles(df, col, 0.5)
    tag = F.when(F.col(col) >= median + band, F.lit("Critic")).when(F.col(col) <= median - band, F.lit("Casual"))
    return df.withColumn("critic_tag", tag.otherwise(F.lit("Moderate")))


def spatial_tag(df: DataFrame, col: str = "spatial_range_km") -> DataFrame:
    lo, hi = scalar_quantiles(df, col, 0.30, 0.70)
    tag = F.when(F.col(col) >= hi, F.lit("Preference-First")).when(F.col(col) <= lo, F.lit("Distance-First"))
    return df.withColumn("spatial_tag", tag.otherwise(F.lit("Balanced")))


# ---------------------------------------------------------------- transfer between domains


def _balanced(df: DataFrame, label: str) -> DataFrame:
    """Class weight: rows over (classes x rows of the class)."""
    per = df.groupBy(label).agg(rows().alias("_c"))
    total = per.agg(F.sum("_c").alias("_t"), rows().alias("_k"))
    return attach(df.join(F.broadcast(per), label), total, []).withColumn("_w", F.col("_t") / (F.col("_k") * F.col("_c"))).drop("_c", "_t", "_k")


def _classifier(columns: Sequence[str], label: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler

    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=list(columns), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
            LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", regParam=1e-4, maxIter=200),
        ]
    )


def cross_validated_accuracy(df: DataFrame, columns: Sequence[str], label: str, key: str, folds: int = 5) -> DataFrame:
    """Accuracy of a balanced multinomial model per fold, with chance = 1 / classes. Folds deal out each class in turn, in hash order;
    class weights come from the training folds alone."""
    from footfall.operators.scale import number_rows, portable_hash
    from footfall.session import settle

    clean = df.select(key, label, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    order = [portable_hash(F.lit("fold"), F.col(key).cast("string")), F.col(key)]
    data = settle(number_rows(clean, order, [label], "_n").withColumn("_fold", F.pmod(F.col("_n") - 1, F.lit(folds)).cast("int")).drop("_n"))
    classes = data.select(label).distinct().count()
    out = []
    for i in range(folds):
        model = _classifier(columns, label).fit(_balanced(data.where(F.col("_fold") != i), label))
        scored = model.transform(data.where(F.col("_fold") == i))
        acc = scored.agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0]
        out.append((i, None if acc is None else float(acc), 1.0 / classes))
    return df.sparkSession.createDataFrame(out, "fold int, accuracy double, chance double")


def transfer_priors(known: DataFrame, others: DataFrame, columns: Sequence[str], weights: dict[str, float], label: str = "segment") -> DataFrame:
    """Weight per user: by known segment, and by predicted segment for users known only elsewhere."""
    from pyspark.ml.feature import IndexToString

    clean = known.select("user_id", label, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    model = _classifier(columns, label).fit(_balanced(clean, label))
    fresh = others.join(known.select("user_id"), "user_id", "left_anti").select(
        "user_id", *[F.col(c).cast("double").alias(c) for c in columns]
    )
    # The indexer only labels training rows, so prediction runs the stages after it.
    scored = fresh.dropna()
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    named = IndexToString(inputCol="prediction", outputCol="_name", labels=model.stages[0].labels).transform(scored)
    both = known.select("user_id", F.col(label).alias(label), F.lit("known").alias("origin")).unionByName(
        named.select("user_id", F.col("_name").alias(label), F.lit("predicted").alias("origin"))
    )
    return both.withColumn("weight", label_weight(label, weights))


def label_weight(col: str, weights: dict[str, float], default: float = 1.0) -> Column:
    table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    return F.coalesce(F.try_element_at(table, F.col(col)), F.lit(default))
