"""Rank statistics, tests and intervals, all grouped and all free of one-task sorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalar import ratio
from footfall.functions.tails import p_of_chi2, p_of_correlation, p_of_normal
from footfall.operators.scale import (
    attach,
    lookup_join,
    number_rows,
    portable_hash,
    quantiles,
    running_total,
    value_ranks,
)


def rows() -> Column:
    return F.count(F.lit(1))


def guarded_corr(x: str, y: str, weight: Column | None = None) -> Column:
    """Pearson correlation aggregate; NULL below three pairs or without variance."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    a, b = F.col(x), F.col(y)
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    cov = F.sum(w * a * b) - sa * sb / n
    va, vb = F.sum(w * a * a) - sa * sa / n, F.sum(w * b * b) - sb * sb / n
    # Sums of equal numbers can leave a variance of rounding error instead of zero.
    flat = (va <= F.sum(w * a * a) * 1e-13) | (vb <= F.sum(w * b * b) * 1e-13)
    value = F.try_divide(cov, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))))
    return F.when((n >= 3) & ~flat, value)


def avg_rank(df: DataFrame, col: str, by: Sequence[str] = (), ascending: bool = True, name: str = "rank") -> DataFrame:
    """Rank with ties sharing their mean; missing values get no rank."""
    table = value_ranks(df, col, by, ascending).select(*by, col, F.col("rank_avg").alias(name))
    return lookup_join(df, table, [*by, col], "left")


def competition_rank(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rank from the highest value, ties share the best place."""
    table = value_ranks(df, col, by, ascending=False).select(*by, col, F.col("rank_min").alias(name))
    return lookup_join(df, table, [*by, col], "left")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), p_value: bool = False) -> DataFrame:
    """Rank correlation per group: rho, n and optionally p."""
    by = list(by)
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(rows().alias("c"))
    )
    weighted = pairs
    for col, rank in (("_x", "rx"), ("_y", "ry")):
        hist = pairs.groupBy(*by, col).agg(F.sum("c").alias("n"))
        upto = running_total(hist, [F.col(col).asc()], ["n"], by)
        table = upto.select(*by, col, (F.col("n_upto") - (F.col("n") - 1) / F.lit(2.0)).alias(rank))
        weighted = lookup_join(weighted, table, [*by, col])
    # Mean ranks are (n + 1) / 2, so centring first keeps the sums small.
    n = pairs.groupBy(*by).agg(F.sum("c").alias("n")) if by else pairs.agg(F.sum("c").alias("n"))
    centred = attach(weighted, n, by)
    mid = (F.col("n") + 1) / F.lit(2.0)
    dx, dy, c = F.col("rx") - mid, F.col("ry") - mid, F.col("c")
    den = F.sqrt(F.sum(c * dx * dx) * F.sum(c * dy * dy))
    rho = F.when((F.sum(c) >= 3) & (den > 0), F.try_divide(F.sum(c * dx * dy), den))
    out = centred.groupBy(*by).agg(rho.alias("rho"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    return out.withColumn("p", p_of_correlation("rho", "n")) if p_value else out


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = (), p_value: bool = False) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*by).agg(guarded_corr(x, y).alias("r"), rows().alias("n"))
    return out.withColumn("p", p_of_correlation("r", "n")) if p_value else out


def correlation_grid(df: DataFrame, key: str, xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """Spearman correlation of every x with every y over rows where both are known, one ranking pass for all."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("vx"), F.col(b).cast("double").alias("vy")
            )
            for a in xs
            for b in ys
        ]
    )
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    return spearman(long, "vx", "vy", by=["x", "y"], p_value=True)


def notable_correlations(grid: DataFrame, least_n: int = 50, least: float = 0.05) -> DataFrame:
    """Rows of a :func:`correlation_grid` with more than ``least_n`` pairs and a correlation beyond ``least``."""
    return grid.where((F.col("n") > least_n) & (F.abs("rho") > least))


def pearson_grid(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """Pearson r of every x with every y from a single aggregation over the rows where both are known."""
    aggs = []
    for a in xs:
        for b in ys:
            ok = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggs.append(F.count_if(ok).alias(f"n|{a}|{b}"))
            aggs.append(F.when(F.count_if(ok) >= 3, F.corr(a, b)).alias(f"r|{a}|{b}"))
    wide = df.agg(*aggs)
    return wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`r|{a}|{b}`").alias("r"), F.col(f"`n|{a}|{b}`").alias("n")
                    )
                    for a in xs
                    for b in ys
                ]
            )
        ).alias("s")
    ).select("s.*")


# ---------------------------------------------------------------- resampling


# Values are told apart to so many decimals; counts below SMALL_COUNT are drawn exactly.
VALUE_DECIMALS = 9
SMALL_COUNT = 64
# Coefficients of the rational approximation of the inverse normal distribution (relative error below 1.2e-9).
NORMAL_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
NORMAL_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
NORMAL_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
NORMAL_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
NORMAL_TAIL = 0.02425


def poisson_steps(mean: int) -> list[float]:
    """Cumulative Poisson probabilities up to where nothing is left of a 32-bit number."""
    import math

    p, total, out, k = math.exp(-mean), 0.0, [], 0
    while 1 - total > 2.0**-34 or k <= mean:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return out


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(u: Column) -> Column:
    """Inverse of the normal distribution by a rational approximation in the middle and in both tails."""
    q = u - 0.5
    middle = _poly(NORMAL_A, q * q) * q / _poly([*NORMAL_B, 1.0], q * q)
    t = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    tail = _poly(NORMAL_C, t) / _poly([*NORMAL_D, 1.0], t)
    return F.when(u < NORMAL_TAIL, tail).when(u > 1 - NORMAL_TAIL, -tail).otherwise(middle)


def bootstrap_means(df: DataFrame, value: str, by: Sequence[str] = (), replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of each resample, drawn per distinct value: of ``c`` rows with a value a resample takes Poisson(c), as if each of them
    were taken Poisson(1) times. The work follows the number of distinct values (to nine decimals), not of rows.

    Counts up to SMALL_COUNT are drawn by their exact distribution, larger ones by the expansion around the normal.
    """
    by = list(by)
    key = F.round(F.col(value).cast("double") * 10.0**VALUE_DECIMALS).cast("bigint")
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, key.alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    # SMALL_COUNT rows, made here.
    steps = df.sparkSession.createDataFrame([(c, poisson_steps(c)) for c in range(1, SMALL_COUNT)], "_c bigint, _steps array<double>")
    draws = hist.join(F.broadcast(steps), "_c", "left").repartition("_k").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = (portable_hash(F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_k").cast("string")) + 0.5) / F.lit(4294967296.0)
    draws = draws.withColumn("_u", u)
    z, c = normal_quantile(F.col("_u")), F.col("_c").cast("double")
    many = F.greatest(F.floor(c + F.sqrt(c) * z + (z * z - 1) / 6 + 0.5), F.lit(0).cast("bigint"))
    draws = draws.withColumn("_w", F.when(F.col("_c") < SMALL_COUNT, F.size(F.filter("_steps", lambda s: s <= F.col("_u"))).cast("bigint")).otherwise(many))
    return draws.groupBy(*by, "replicate").agg((ratio(F.sum(F.col("_w") * F.col("_k")), F.sum("_w")) / 10.0**VALUE_DECIMALS).alias("mean"))


def _interval(means: DataFrame, by: Sequence[str], confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    # At most `replicates` values per group, a number fixed by the caller.
    return means.groupBy(*by).agg(
        F.percentile("mean", F.lit(tail)).alias("ci_lo"), F.percentile("mean", F.lit(1 - tail)).alias("ci_hi")
    )


def bootstrap_ci(df: DataFrame, value: str, by: Sequence[str] = (), replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean per group, with the mean itself."""
    by = list(by)
    ci = _interval(bootstrap_means(df, value, by, replicates, seed), by, confidence)
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return mean.join(ci, by) if by else attach(mean, ci, [])


def bootstrap_ci_stratified(df: DataFrame, value: str, stratum: str, replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval of the mean of stratum means, resampled inside each stratum."""
    means = bootstrap_means(df, value, [stratum], replicates, seed)
    per = means.groupBy("replicate").agg(F.avg("mean").alias("mean"))
    point = df.groupBy(stratum).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))
    return attach(point, _interval(per, [], confidence), [])


# ---------------------------------------------------------------- tests


def wilcoxon(df: DataFrame, a: str, b: str, by: Sequence[str] = (), zeros: str = "drop", decimals: int = 12) -> DataFrame:
    """Signed-rank test of a - b: w_plus, w_minus, n, z and p (normal, tie-corrected, two-sided).

    ``drop`` leaves zero differences out; ``split`` ranks them and halves their ranks, and answers p = 1 below
    ten pairs. All-zero differences give p = 1.
    """
    by = list(by)
    d = F.round(F.col(a).cast("double") - F.col(b).cast("double"), decimals)
    diffs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, d.alias("d"))
    hist = diffs.groupBy(*by, F.abs("d").alias("size")).agg(
        F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") < 0).alias("neg"), rows().alias("c")
    )
    pairs = diffs.groupBy(*by).agg(rows().alias("n_pairs"))
    ranked = hist if zeros == "split" else hist.where(F.col("size") > 0)
    upto = running_total(ranked, [F.col("size").asc()], ["c"], by)
    rank = F.col("c_upto") - (F.col("c") - 1) / F.lit(2.0)
    null = F.when(F.col("size") == 0, F.col("c") * rank).otherwise(F.lit(0.0)) / 2
    c = F.col("c").cast("double")
    sums = upto.groupBy(*by).agg(
        F.sum(F.col("pos") * rank + null).alias("w_plus"),
        F.sum(F.col("neg") * rank + null).alias("w_minus"),
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("size") > 0, F.col("c")).otherwise(0)).alias("n_moved"),
        F.sum(c * c * c - c).alias("ties"),
    )
    out = pairs.join(sums, by, "left") if by else attach(pairs, sums, [])
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(F.when(var > 0, var)))
    out = out.withColumn("z", z)
    trivial = F.coalesce("n_moved", F.lit(0)) == 0
    if zeros == "split":
        trivial = trivial | (F.col("n_pairs") < 10)
    p = F.when(trivial, F.lit(1.0)).otherwise(p_of_normal("z"))
    return out.select(*by, "n_pairs", "w_plus", "w_minus", "z", p.alias("p"))


def cohen_d(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean difference over the root of the mean of the two sample variances."""
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    value = F.when(F.coalesce(pooled, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.try_divide(F.avg(a) - F.avg(b), pooled))
    return df.groupBy(*by).agg(value.alias("cohen_d"))


def rank_biserial(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(pairs a > b minus pairs a < b) / all pairs, from rank sums instead of all pairs."""
    by = list(by)
    both = F.array(F.struct(F.lit(1).alias("is_a"), F.col(a).cast("double").alias("v")), F.struct(F.lit(0).alias("is_a"), F.col(b).cast("double").alias("v")))
    long = df.select(*by, F.explode(both).alias("x")).select(*by, "x.is_a", "x.v").where(F.col("v").isNotNull())
    hist = long.groupBy(*by, "v").agg(F.sum("is_a").alias("na"), rows().alias("c"))
    upto = running_total(hist, [F.col("v").asc()], ["c"], by)
    rank = F.col("c_upto") - (F.col("c") - 1) / F.lit(2.0)
    sums = upto.groupBy(*by).agg(
        F.sum(F.col("na") * rank).alias("ra"), F.sum("na").cast("double").alias("n1"), F.sum("c").cast("double").alias("n")
    )
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    u = F.col("ra") - n1 * (n1 + 1) / 2
    return sums.select(*by, (2 * F.try_divide(u, n1 * n2) - 1).alias("rank_biserial"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, name: str = "p_adjusted") -> DataFrame:
    """Step-up adjusted p-values: the running minimum, from the largest p down, of p x m / rank.

    Rows are numbered in range partitions; the minimum of later partitions is one row each.
    """
    known = df.where(F.col(p).isNotNull())
    placed = number_rows(known, [F.col(p).asc(), F.col(key).asc()], name="_rank")
    m = known.agg(rows().alias("_m"))
    raw = attach(placed, m, []).withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    # Blocks of consecutive ranks: the minimum within a block, then over the blocks after it.
    block = F.floor((F.col("_rank") - 1) / F.lit(100_000))
    raw = raw.withColumn("_block", block)
    after = Window.partitionBy("_block").orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    mins = raw.groupBy("_block").agg(F.min("_raw").alias("_low"))
    later = mins.select("_block", F.min("_low").over(Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    out = raw.withColumn("_here", F.min("_raw").over(after)).join(later, "_block")
    return out.withColumn(name, F.least(F.lit(1.0), F.col("_here"), F.col("_later"))).drop(
        "_rank", "_m", "_raw", "_block", "_here", "_later"
    )


# Normal quantiles for a two-sided 5 % test and 80 % power.
Z_975 = 1.959963984540054
Z_80 = 0.8416212335729143


def minimum_detectable_effect(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n = F.sqrt(rows().cast("double"))
    return df.groupBy(*by).agg(rows().alias("n"), ratio(F.lit(Z_975 + Z_80), n).alias("mde"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per (a, b) with both margins and the total; margins carry 'All'."""
    cube = df.cube(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(rows().alias("n"), F.grouping_id().alias("_g"))
    return cube.select(
        F.when(F.col("_g").bitwiseAND(2) == 2, F.lit("All")).otherwise(F.col("_a").cast("string")).alias(a),
        F.when(F.col("_g").bitwiseAND(1) == 1, F.lit("All")).otherwise(F.col("_b").cast("string")).alias(b),
        "n",
    )


def chi_squared(df: DataFrame, a: str, b: str, p_value: bool = True) -> DataFrame:
    """Independence test of two labels: statistic, degrees of freedom, p. Empty cells count through the margins."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(rows().cast("double").alias("o"))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    rb = cells.groupBy(b).agg(F.sum("o").alias("rb"))
    total = cells.agg(F.sum("o").alias("t"))
    # sum((o - e)^2 / e) over all cells equals t x (sum(o^2 / (ra x rb)) - 1), so unseen cells need no rows.
    joined = cells.join(ra, a).join(rb, b)
    stat = attach(joined.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s")), total, [])
    size = attach(ra.agg(rows().alias("ka")), rb.agg(rows().alias("kb")), [])
    out = attach(stat, size, []).select(
        (F.col("t") * (F.col("s") - 1)).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof")
    )
    return out.withColumn("p", p_of_chi2("chi2", "dof")) if p_value else out


def cohen_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement of two binary choices beyond chance; NULL when chance agreement is complete."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    po = F.avg((x == y).cast("double"))
    pe = F.avg(x) * F.avg(y) + (1 - F.avg(x)) * (1 - F.avg(y))
    return both.groupBy(*by).agg(rows().alias("n"), F.try_divide(po - pe, F.when(pe < 1, 1 - pe)).alias("kappa"))


def agreement(left: DataFrame, right: DataFrame, key: str, by: Sequence[str], score: str, choice: str) -> DataFrame:
    """Two runs per group: mean scores and their difference, kappa and rank correlation on shared keys, verdict."""
    by = list(by)
    means_l = left.groupBy(*by).agg(F.avg(score).alias("mean_a"))
    means_r = right.groupBy(*by).agg(F.avg(score).alias("mean_b"))
    shared = left.select(*by, key, F.col(score).alias("s_a"), F.col(choice).alias("c_a")).join(
        right.select(*by, key, F.col(score).alias("s_b"), F.col(choice).alias("c_b")), [*by, key]
    )
    kappa = cohen_kappa(shared, "c_a", "c_b", by).withColumnRenamed("n", "n_shared")
    rho = spearman(shared, "s_a", "s_b", by).select(*by, "rho")
    out = means_l.join(means_r, by, "outer").join(kappa, by, "left").join(rho, by, "left")
    delta = F.col("mean_b") - F.col("mean_a")
    return out.withColumn("delta", delta).withColumn(
        "agrees", F.coalesce((F.col("kappa") > 0.4) & (F.abs("delta") < 0.02), F.lit(False))
    )


def calibration(ballots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlations of the stated revisit score (0-10, scaled to 0-1) with the model's signal, per group."""
    df = ballots.where(F.col("revisit_score").isNotNull() & F.col("model_revisit_signal").isNotNull()).withColumn(
        "_said", F.col("revisit_score") / 10
    )
    rho = spearman(df, "_said", "model_revisit_signal", by).withColumnRenamed("rho", "spearman_r")
    r = pearson(df, "_said", "model_revisit_signal", by).select(*by, F.col("r").alias("pearson_r"))
    return rho.join(r, list(by))


def variance_plan(df: DataFrame, value: str, by: Sequence[str], half_width: float = 0.005) -> DataFrame:
    """Deviation per group and the repeats needed for a 95 % interval of the given half width (1 at least)."""
    sd = F.stddev_samp(value)
    need = F.greatest(F.lit(1), F.ceil(F.pow(1.96 * F.coalesce(sd, F.lit(0.0)) / half_width, F.lit(2.0)))).cast("bigint")
    return df.groupBy(*by).agg(rows().alias("n"), sd.alias("std"), need.alias("repeats"))


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares line per group; NULL when x does not vary."""
    varies = F.max(x) > F.min(x)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by).agg(
        F.when(varies, F.regr_slope(y, x)).alias("slope"), F.when(varies, F.regr_intercept(y, x)).alias("intercept")
    )


def cross_domain(df: DataFrame, key: str, domain: str, value: str, first: str, second: str) -> DataFrame:
    """Correlation between two domains of the mean value per shared key."""
    wide = (
        df.where(F.col(domain).isin(first, second))
        .groupBy(key)
        .agg(
            F.avg(F.when(F.col(domain) == first, F.col(value))).alias("x"),
            F.avg(F.when(F.col(domain) == second, F.col(value))).alias("y"),
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    return pearson(wide, "x", "y").select(F.col("r").alias("cross_domain_corr"), F.col("n").alias("n_shared"))


def premium(df: DataFrame, domain: str, label: str, value: str, loyal: str) -> DataFrame:
    """Per domain: mean value of the loyal label, of the rest, and the difference."""
    is_loyal = F.col(label) == loyal
    out = df.groupBy(domain).agg(
        F.avg(F.when(is_loyal, F.col(value))).alias("loyal_mean"), F.avg(F.when(~is_loyal, F.col(value))).alias("other_mean")
    )
    return out.withColumn("premium", F.col("loyal_mean") - F.col("other_mean"))


def summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), probs: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quantiles of each column, wide."""
    probs = probs or {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    by = list(by)
    aggs = [rows().alias("rows")]
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")
        ]
    base = df.groupBy(*by).agg(*aggs)
    q = quantiles(df, columns, probs, by)
    return base.join(q, by) if by else attach(base, q, [])
