"""Exact top-k by inner product with MaxScore over shards.

A component is a term, a shard's values of it are its postings, kept as one row per component. With a query's weight and the
shard's largest and smallest value each term has a score bound. Terms with small bounds, which together can't reach the k-th
best score known, are non-essential: the postings of the others are traversed for all vectors, for a block of queries at once. The
non-essential terms are looked up, some at a time, only for pairs that can still get among the best. Shards are merged at the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.shared import settled

# Vectors and queries that meet in one task at most, and how many of them are multiplied at once.
SHARD = 1 << 17
QUERIES = 1 << 17
VECTORS_AT_ONCE, QUERIES_AT_ONCE = 4096, 256
LEAST_SHARD = 4096
# Non-essential terms hold this share of the threshold; up to 1 is right, a smaller share means fewer look-ups.
SHARE = 0.5
PROBED_AT_ONCE = 4
NONE = np.iinfo(np.int64).min
LARGEST = np.iinfo(np.int64).max
FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint"


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column side by side, shorter ones filled with 0."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat, stops = column.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(column.offsets))
    flat = np.maximum(flat, -LARGEST)
    out = np.zeros((len(stops), int(stops.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < stops[:, None]] = flat
    return out


class Shard:
    """Postings of the vectors of one task: ``values`` (components x vectors), vec_ids (None last) and rows."""

    def __init__(self, rows: np.ndarray, ids: list[int | None], values: np.ndarray):
        # By vec_id, so that of equal scores the first place wins.
        order = np.lexsort((rows, [i or 0 for i in ids], [i is None for i in ids]))
        self.rows, self.ids, self.values = rows[order], [ids[i] for i in order], np.ascontiguousarray(values[order].T)


class Search:
    """The ``k`` best of each query: ``places`` in ``shard`` and ``scores``, filled up with -1; ``looked`` counts pairs looked up."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, shard: Shard, k: int):
        terms = max(queries.shape[1], len(shard.values))
        wide = lambda x: np.pad(x, ((0, 0), (0, terms - x.shape[1])))
        self.k, self.shard, self.looked = k, shard, 0
        queries, values = wide(queries), wide(shard.values.T).T
        self.places = np.full((len(queries), k), -1)
        self.scores = np.full((len(queries), k), NONE)
        self.floor = floor.copy()
        # Whole numbers are exact in the smallest kind whose range holds every sum; beyond 63 bits they are Python's.
        most = [int(a) * int(b) for a, b in zip(np.abs(queries).max(0, initial=0), np.abs(values).max(1, initial=0))]
        kind = next(t for t, end in ((np.float32, 1 << 24), (np.float64, 1 << 53), (object, None)) if end is None or sum(most) < end)
        queries, values = queries.astype(kind), values.astype(kind)
        for i in range(0, len(self.shard.rows), VECTORS_AT_ONCE):
            here = slice(i, min(i + VECTORS_AT_ONCE, len(self.shard.rows)))
            for j in range(0, len(queries), QUERIES_AT_ONCE):
                self._block(slice(j, min(j + QUERIES_AT_ONCE, len(queries))), here, queries, values, own)

    def _block(self, asked: slice, here: slice, queries: np.ndarray, values: np.ndarray, own: np.ndarray) -> None:
        q, x, floor = queries[asked], values[:, here], self.floor[asked]
        bound = np.maximum(q * x.max(1), q * x.min(1))
        # Terms by bound; what isn't positive is essential, so that partial sums of bounds only grow.
        order = np.argsort(np.where(bound > 0, bound, np.inf), axis=1, kind="stable")
        ranked = np.take_along_axis(bound, order, 1)
        upto = np.cumsum(np.maximum(ranked, 0), axis=1)
        spare = (ranked > 0) & (upto < (floor * SHARE)[:, None])
        essential = np.ones(q.shape, bool)
        np.put_along_axis(essential, order, ~spare, 1)
        sums = np.where(essential, q, 0) @ x
        rest = np.where(spare, ranked, 0).sum(1)
        b, c = np.nonzero(self.shard.rows[None, here] == own[asked, None])
        unknown = floor == NONE
        if unknown.any():
            full = sums[unknown].astype(np.float64)
            back = np.cumsum(unknown) - 1
            mine = unknown[b]
            full[back[b[mine]], c[mine]] = -np.inf
            if full.shape[1] > self.k:
                # The k-th best of this block is a first threshold; doubles may round it, so it is lowered by that.
                kth = np.partition(full, -self.k, axis=1)[:, -self.k]
                low = np.where(np.isfinite(kth), np.floor(kth - np.abs(kth) * 2.0**-50) - 1, -np.inf)
                fits = low > -(2.0**62)
                floor = floor.copy()
                floor[np.flatnonzero(unknown)[fits]] = low[fits].astype(np.int64)
        alive = sums + rest[:, None] >= floor[:, None]
        alive[b, c] = False
        b, c = np.nonzero(alive)
        score, left = sums[b, c], rest[b]
        # Look the non-essential terms up, largest bounds first, while the pair can reach the threshold.
        count = spare.sum(1)
        for step in range(0, int(count.max(initial=0)), PROBED_AT_ONCE):
            for s in range(step, step + PROBED_AT_ONCE):
                at = count[b] - 1 - s
                t = order[b, np.maximum(at, 0)]
                on = at >= 0
                score = score + np.where(on, q[b, t] * x[t, c], 0)
                left = left - np.where(on, bound[b, t], 0)
            self.looked += len(b)
            on = score + left >= floor[b]
            b, c, score, left = b[on], c[on], score[on], left[on]
        if len(b):
            self._merge(b + asked.start, c + here.start, score)

    def _merge(self, b: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        if score.dtype == object:
            score = np.clip(score, NONE + 1, LARGEST)
        some = np.unique(b)
        held = self.places[some] >= 0
        b = np.concatenate([np.repeat(some, held.sum(1)), b])
        place = np.concatenate([self.places[some][held], place])
        score = np.concatenate([self.scores[some][held], score.astype(np.int64)])
        order = np.lexsort((place, ~score, b))
        b, place, score = b[order], place[order], score[order]
        nth = np.arange(len(b)) - np.searchsorted(b, b)
        on = nth < self.k
        b, place, score, nth = b[on], place[on], score[on], nth[on]
        self.places[some], self.scores[some] = -1, NONE
        self.places[b, nth], self.scores[b, nth] = place, score
        full = some[self.places[some, -1] >= 0]
        self.floor[full] = np.maximum(self.floor[full], self.scores[full, -1])


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and ``e``, the components as floor(256 x); vectors that are null or hold a null, NaN or infinite component are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256.0).cast("bigint")).alias("e"))


def _met(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best rows of every (shard, group of queries): shards (g, h, row, vec_id, e), queries (g, h, query, query_id, floor, e)."""

    def search(vectors, asked):
        import pyarrow as pa

        if not vectors.num_rows or not asked.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in FOUND.split(", ")})
        shard = Shard(vectors["row"].to_numpy(), vectors["vec_id"].to_pylist(), matrix(vectors["e"]))
        own = asked["query"].to_numpy()
        found = Search(matrix(asked["e"]), own, asked["floor"].to_numpy(), shard, k)
        b, n = np.nonzero(found.places >= 0)
        at = found.places[b, n]
        ids = asked["query_id"].to_numpy()
        columns = {"query": own[b], "query_id": ids[b], "row": shard.rows[at], "vec_id": pa.array([shard.ids[i] for i in at.tolist()], pa.int64()), "score": found.scores[b, n]}
        return pa.table(columns)

    return shards.groupBy("g", "h").cogroup(queries.groupBy("g", "h")).applyInArrow(search, FOUND)


def top_k(vectors: DataFrame, is_query, k: int = 5, shard: int = SHARD, queries: int = QUERIES, least: int = LEAST_SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, e: whole numbers) with ``is_query`` the ``k`` other rows of
    largest inner product, ties to the smaller vec_id (a missing one last).

    Each row is a query or candidate by itself: a repeated row finds its twin. Components that a shorter vector lacks count as 0. Sums beyond the
    range of longs are held at its ends. Fewer than ``k`` other rows, empty vectors, empty tables and other columns are fine.
    Vectors and queries are dealt evenly by row number, not by value, so copies don't meet in one shard. First the queries meet one
    shard, whose k-th score is their threshold in all others.
    """
    spark = vectors.sparkSession
    rows = settled(vectors.select("vec_id", "e", F.coalesce(is_query, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row")))
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).first()
    if not count["q"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    groups = max(-(-count["n"] // shard), min(2 * spark.sparkContext.defaultParallelism, -(-count["n"] // least)))
    blocks = -(-count["q"] // queries)
    deal = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n))
    numbers = lambda n, first=0: F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(n - 1).cast("bigint")))
    dealt = rows.select("row", "vec_id", "e", deal(1, groups).alias("g"), numbers(blocks).alias("h"))
    asked = rows.where("asked").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "e", deal(2, blocks).alias("h"))
    found = settled(_met(dealt.where("g = 0"), asked.select("*", F.lit(0).cast("bigint").alias("g"), F.lit(NONE).alias("floor")), k))
    if groups > 1:
        floor = found.groupBy("query").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("query", "low")
        asked = settled(asked.join(floor, "query", "left").select("query", "query_id", "e", "h", F.coalesce("low", F.lit(NONE)).alias("floor")))
        found = found.unionByName(_met(dealt.where("g > 0"), asked.select("*", numbers(groups, 1).alias("g")), k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
