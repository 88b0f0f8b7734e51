"""Building blocks that keep skewed and global operators distributed.

Nothing here assumes that a key fits into one task: joins split hot keys, global and per-group order
is taken from range partitions, and quantiles are read from running totals of a value histogram.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.session import settle

# A join key is hot when it holds more than 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 10_000
MIN_CHUNK = 50_000


def scalar(df: DataFrame) -> Column:
    """The only value of a one-row, one-column frame as a column (an uncorrelated scalar subquery)."""
    return df.scalar()


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-group statistics to every row; a one-row frame without ``by`` is added by scalar subquery."""
    if by:
        return df.join(stats, list(by), "left")
    packed = scalar(stats.select(F.struct(*stats.columns).alias("s")))
    return df.select("*", *[packed[c].alias(c) for c in stats.columns])


def hot_keys(df: DataFrame, on: Sequence[str], min_chunk: int = MIN_CHUNK) -> DataFrame:
    """Keys above the chunk size with the number of pieces to split them into: at most HOT_SHARE rows."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    share = F.ceil(scalar(counts.agg(F.sum("n").alias("t"))) / F.lit(HOT_SHARE))
    chunk = F.greatest(share, F.lit(min_chunk))
    return counts.where(F.col("n") > chunk).select(*on, F.ceil(F.col("n") / chunk).cast("int").alias("pieces"))


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", min_chunk: int = MIN_CHUNK, both: bool = False
) -> DataFrame:
    """Equi join whose hot keys on the left are cut into pieces, with the right rows copied per piece.

    With ``both`` (inner joins) keys that are hot on the right are cut too: a key's rows meet in a grid of left and right
    pieces. Every (left, right) match still meets exactly once, so the result equals the plain join. Left rows with a NULL
    key match nothing; they are spread over many pieces.
    """
    if both and how != "inner":
        raise ValueError("only an inner join can cut the right side")
    on = list(on)
    one = F.lit(1)

    def of_row(df: DataFrame, pieces: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce(F.col(pieces), one)).cast("int")

    def copies(pieces: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(pieces), one) - 1))

    hot = hot_keys(left, on, min_chunk)
    if both:
        hot = hot.join(hot_keys(right, on, min_chunk).withColumnRenamed("pieces", "pieces_r"), on, "outer")
    else:
        hot = hot.withColumn("pieces_r", F.lit(1))
    # Only hot keys travel here, at most HOT_SHARE of either side, so the broadcast is bounded by construction.
    hot = F.broadcast(hot)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    lhs = left.join(hot, on, "left")
    spread = F.when(missing, F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(HOT_SHARE)).cast("int")).otherwise(of_row(left, "pieces"))
    lhs = lhs.withColumn("piece", spread)
    rhs = right.join(hot, on, "left").withColumn("piece", copies("pieces"))
    if both:
        lhs = lhs.withColumn("piece_r", copies("pieces_r"))
        rhs = rhs.withColumn("piece_r", of_row(right, "pieces_r"))
        return lhs.drop("pieces", "pieces_r").join(rhs.drop("pieces", "pieces_r"), [*on, "piece", "piece_r"], how).drop("piece", "piece_r")
    return lhs.drop("pieces", "pieces_r").join(rhs.drop("pieces", "pieces_r"), [*on, "piece"], how).drop("piece")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` is proven to hold at most ``max_rows`` rows (reads no further than needed)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Hint a broadcast only after counting; larger sides stay a shuffle join."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def lookup_join(left: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = 1_000_000) -> DataFrame:
    """Join a table with one row per key: broadcast when counted small, split hot keys otherwise."""
    if small_enough(table, max_rows):
        return left.join(F.broadcast(table), list(on), how)
    return spread_join(left, table, on, how)


def _range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in range partitions, frozen, with partition number and position inside the partition."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    frozen = settle(placed.withColumn("_pos", F.monotonically_increasing_id()))
    # The id holds the partition number above bit 33 and the row's position below it.
    return frozen.withColumn("_part", F.shiftright("_pos", 33)).withColumn(
        "_pos", F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    )


def number_rows(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "row_number"
) -> DataFrame:
    """Exact 1-based row numbers in ``order`` (a total order), whole or within ``by``, without one big task.

    Rows are range-partitioned by (by, order); a row's number is its place in its partition plus the rows
    of its group in earlier partitions. Only one row per (group, partition) is added up.
    """
    by = list(by)
    placed = _range_sorted(df, [*[F.col(c).asc() for c in by], *order])
    span = placed.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    from pyspark.sql import Window

    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = span.select(
        *by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_add")
    )
    return (
        placed.join(offsets, [*by, "_part"])
        .withColumn(name, (F.col("_pos") + F.col("_add")).cast("bigint"))
        .drop("_pos", "_part", "_add")
    )


def running_total(
    hist: DataFrame,
    order: Sequence[Column],
    measures: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``<m>_upto`` (inclusive running sum in ``order``) for each measure, distributed like number_rows."""
    from pyspark.sql import Window

    by = list(by)
    placed = _range_sorted(hist, [*[F.col(c).asc() for c in by], *order])
    sums = placed.groupBy(*by, "_part").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_part", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    inside = (
        Window.partitionBy(*by, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = placed.select("*", *[F.sum(m).over(inside).alias(f"_l_{m}") for m in measures])
    return (
        local.join(offsets, [*by, "_part"])
        .select(
            *hist.columns,
            *[(F.col(f"_l_{m}") + F.col(f"_o_{m}")).alias(f"{m}_upto") for m in measures],
        )
    )


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), ascending: bool = True) -> DataFrame:
    """One row per distinct (by, value): number of rows, rank_min, rank_avg, rank_max and rank_dense order.

    Ties share a row, so a value held by a third of all rows costs one row here.
    """
    by = list(by)
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    order = F.col(value).asc() if ascending else F.col(value).desc()
    upto = running_total(hist, [order], ["n"], by)
    return upto.select(
        *by,
        value,
        "n",
        (F.col("n_upto") - F.col("n") + 1).cast("bigint").alias("rank_min"),
        (F.col("n_upto") - (F.col("n") - 1) / F.lit(2.0)).alias("rank_avg"),
        F.col("n_upto").cast("bigint").alias("rank_max"),
    )


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per group, columns ``<column>_<label>``.

    All columns share one histogram pass. The order statistics are picked from running totals, so no task
    ever holds the values of a group.
    """
    by = list(by)
    long = df.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("val")) for c in columns])
        ).alias("cv"),
    ).select(*by, "cv.col", "cv.val")
    hist = (
        long.where(F.col("val").isNotNull() & ~F.isnan("val"))
        .groupBy(*by, "col", "val")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = running_total(hist, [F.col("val").asc()], ["n"], [*by, "col"])
    totals = hist.groupBy(*by, "col").agg(F.sum("n").alias("total"))
    ranked = upto.join(totals, [*by, "col"])
    aggs = []
    for label, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        start = F.col("n_upto") - F.col("n")
        for end, place in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (start <= place) & (place < F.col("n_upto"))
            aggs.append(F.max(F.when(here, F.col("val"))).alias(f"{label}_{end}"))
    picked = ranked.groupBy(*by, "col", "total").agg(*aggs)
    for label, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = F.col(f"{label}_lo"), F.col(f"{label}_hi")
        picked = picked.withColumn(label, lo + (hi - lo) * (pos - F.floor(pos)))
    wide = picked.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("col") == c, F.col(label))).alias(f"{c}_{label}")
            for c in columns
            for label in probs
        ]
    )
    return wide


def scalar_quantiles(df: DataFrame, column: str, *probs: float) -> list[Column]:
    """Whole-table quantiles of one column as scalar columns."""
    labels = {f"q{i}": p for i, p in enumerate(probs)}
    row = settle(quantiles(df, [column], labels))
    return [scalar(row.select(f"{column}_{label}")) for label in labels]


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = (), rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group in ``order``; Spark limits each group before the shuffle."""
    from pyspark.sql import Window

    if not by:
        head = df.orderBy(*order).limit(k)
        if rank is None:
            return head
        # At most k rows are left, so one partition numbers them.
        return head.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return out.drop(name) if rank is None else out.withColumn(name, F.col(name).cast("bigint"))


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group, the first in ``order``, by partial aggregation instead of sorting the group."""
    others = [c for c in df.columns if c not in by]
    return (
        df.groupBy(*by)
        .agg(F.min_by(F.struct(*others), F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])).alias("b"))
        .select(*by, *[F.col("b")[c].alias(c) for c in others])
    )


def portable_hash(*parts: Column | str) -> Column:
    """32-bit hash of the parts as BIGINT, equal to the first eight hex digits of md5 in any engine."""
    text = F.concat_ws(":", *[p if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
