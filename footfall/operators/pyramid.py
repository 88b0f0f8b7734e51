"""Points in a pyramid of cells: counts and best points within a radius, and nearest points, without pairing everything near.

Points of a group (a city, a grid cell) lie in 4 x 4 cells of the group's own box, these in 4 x 4 smaller ones, and so on. A node knows
how many points it has, a middle and a reach around it. A query starts at its group's root. Nodes wholly outside its radius are
left, nodes wholly inside count as they are, and only those at the rim are opened; the last ones are compared point by point. For the
nearest points, nodes are opened as long as they can hold one of them. Points of one place are one entry, equal queries one query.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalar import EARTH_RADIUS_M, haversine_m
from footfall.operators.scale import lookup_join, spread_join, top_k
from footfall.session import settle

# Nodes of at most so many places are not divided further; the deepest nodes aren't either.
LEAF = 64
DEPTH = 7
# Bits of a coordinate per level.
BITS = 2
# Distances from middles are rounded outwards by this many metres, far above the error of the formula.
SLACK = 0.01
# Nodes, places and their best points are broadcast up to this many rows of some 100 bytes each.
SMALL_ROWS = 200_000


def _cells(df: DataFrame, by: Sequence[str], depth: int) -> DataFrame:
    """Add _x and _y, the place in the finest grid over the box of the row's group."""
    box = df.groupBy(*by).agg(F.min("lat").alias("_a"), F.max("lat").alias("_b"), F.min("lon").alias("_c"), F.max("lon").alias("_d"))
    boxed = lookup_join(df, box, by)

    def at(v: str, lo: str, hi: str) -> Column:
        share = F.coalesce(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
        return F.least(F.floor(share * 2 ** (BITS * depth)), F.lit(2 ** (BITS * depth) - 1)).cast("bigint")

    return boxed.withColumns({"_x": at("lon", "_c", "_d"), "_y": at("lat", "_a", "_b")}).drop("_a", "_b", "_c", "_d")


def _cell(x: Column, y: Column) -> Column:
    return F.shiftleft(x, 32).bitwiseOR(y)


class Pyramid:
    """``nodes``: by, level, cell, parent, n (points), sums, m (places), mid_lat, mid_lon, reach, leaf. ``places``: by, lat, lon, n, sums, level, cell
    (of the place's leaf). Points without position or group are left out.
    """

    def __init__(self, points: DataFrame, by: Sequence[str], pos: Sequence[str], sums: Sequence[str] = (), depth: int = DEPTH, leaf: int = LEAF):
        self.by, self.depth, self.sums = list(by), depth, list(sums)
        known = points.select(*by, F.col(pos[0]).cast("double").alias("lat"), F.col(pos[1]).cast("double").alias("lon"), *sums)
        known = known.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, "lat", "lon"]]))
        places = known.groupBy(*by, "lat", "lon").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
        places = settle(_cells(places, by, depth))
        spans = [F.min("lat").alias("_a"), F.max("lat").alias("_b"), F.min("lon").alias("_c"), F.max("lon").alias("_d")]
        totals = [F.sum(c).alias(c) for c in ["n", *sums]]

        def steps(deepest: int) -> Column:
            """The cell of a place on every level down to ``deepest``, the level of _x and _y."""
            cells = []
            for v in range(deepest + 1):
                x, y = (F.shiftright(c, BITS * (deepest - v)) for c in ("_x", "_y"))
                cells.append(F.struct(F.lit(v).alias("level"), _cell(x, y).alias("cell"), _cell(F.shiftright(x, BITS), F.shiftright(y, BITS)).alias("parent")))
            return F.explode(F.array(*cells)).alias("_s")

        # Summed before the shuffle, so the upper cells of a large group are as many rows as tasks.
        rows = places.select("*", steps(depth)).select("*", "_s.*").groupBy(*by, "level", "cell", "parent").agg(*totals, F.count(F.lit(1)).alias("m"), *spans)
        # A way from the middle along a meridian and a parallel reaches everything.
        widest = F.when((F.col("_a") <= 0) & (F.col("_b") >= 0), F.lit(0.0)).otherwise(F.least(F.abs("_a"), F.abs("_b")))
        reach = F.lit(EARTH_RADIUS_M) * (F.radians(F.col("_b") - F.col("_a")) / 2 + F.radians(F.col("_d") - F.col("_c")) / 2 * F.cos(F.radians(widest))) + SLACK
        leafy = (F.col("m") <= leaf) | (F.col("level") == depth)
        # Nodes below a leaf are never asked for. A parent's places are those of its children, at most 16 rows.
        siblings = Window.partitionBy(*by, "level", "parent")
        rows = rows.withColumn("_up", F.sum("m").over(siblings)).where((F.col("level") == 0) | (F.col("_up") > leaf))
        columns = [*by, "level", "cell", "parent", "n", *sums, "m", ((F.col("_a") + F.col("_b")) / 2).alias("mid_lat"), ((F.col("_c") + F.col("_d")) / 2).alias("mid_lon"), reach.alias("reach"), leafy.alias("leaf")]
        self.nodes = settle(rows.select(*columns))
        size = self.nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("level"), F.lit(0)).alias("deepest"), F.coalesce(F.sum(F.when(F.col("level") == 0, F.col("m"))), F.lit(0)).alias("places")).first()
        self.size, self.deepest, self.small_places = size["n"], size["deepest"], size["places"] <= SMALL_ROWS
        depth = self.deepest
        places = places.withColumns({c: F.shiftright(c, BITS * (self.depth - depth)) for c in ("_x", "_y")})
        homes = self.nodes.where("leaf").select(*by, "level", "cell")
        spread = places.select(*by, "lat", "lon", "n", *sums, steps(depth)).select(*by, "lat", "lon", "n", *sums, "_s.level", "_s.cell")
        self.places = settle(self._meet(spread, homes, [*by, "level", "cell"], "inner", self.size))

    def _meet(self, left: DataFrame, right: DataFrame, on: Sequence[str], how: str, rows: int) -> DataFrame:
        """Join with a side of at most ``rows`` rows, which decide whether it is broadcast."""
        return left.join(F.broadcast(right), list(on), how) if rows <= SMALL_ROWS else spread_join(left, right, on, how)

    def _start(self, queries: DataFrame) -> DataFrame:
        """Queries (q, q_lat, q_lon, by and more) at the roots of their groups."""
        roots = self.nodes.where("level = 0").drop("parent", "level", "m")
        return self._meet(queries.where(F.col("q_lat").isNotNull() & F.col("q_lon").isNotNull()), roots, self.by, "inner", self.size).withColumn("level", F.lit(0))

    def _open(self, rows: DataFrame, level: int) -> DataFrame:
        """Rows marked ``_opened`` become those of their node's children, others stay."""
        held = ["cell", "n", *self.sums, "mid_lat", "mid_lon", "reach", "leaf"]
        below = self.nodes.where(F.col("level") == level + 1).select(*self.by, F.col("parent").alias("_up"), *[F.col(c).alias(f"__{c}") for c in held])
        met = self._meet(rows.withColumn("_up", F.when(F.col("_opened"), F.col("cell"))), below, [*self.by, "_up"], "left", self.size)
        fresh = {c: F.when(F.col("_opened"), F.col(f"__{c}")).otherwise(F.col(c)) for c in held}
        fresh["level"] = F.when(F.col("_opened"), F.lit(level + 1)).otherwise(F.col("level"))
        return met.withColumns(fresh).drop("_up", *[f"__{c}" for c in held])

    def within(self, queries: DataFrame) -> DataFrame:
        """Nodes that make up the surroundings of each query: ``inside`` ones lie within its ``radius_m``, the others are leaves at the rim."""
        rows = self._start(queries).withColumns({"inside": F.lit(False), "_opened": F.lit(True)})
        for level in range(self.deepest + 1):
            d = haversine_m("q_lat", "q_lon", "mid_lat", "mid_lon")
            # What was judged on the way up stays as it is.
            rows = rows.withColumn("_d", d).where(~F.col("_opened") | (F.col("_d") - F.col("reach") <= F.col("radius_m")))
            rows = rows.withColumn("inside", F.col("inside") | (F.col("_opened") & (F.col("_d") + F.col("reach") <= F.col("radius_m"))))
            rows = rows.withColumn("_opened", F.col("_opened") & ~F.col("inside") & ~F.col("leaf")).drop("_d")
            if level < self.deepest:
                rows = self._open(rows, level)
        return rows.drop("_opened")

    def around(self, queries: DataFrame) -> DataFrame:
        """Leaves that can hold one of the ``k`` nearest points of each query."""
        rows = self._start(queries).withColumn("_opened", F.lit(True))
        near = Window.partitionBy("q").orderBy("_far", *self.by, "level", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy("q")
        for level in range(self.deepest + 1):
            d = haversine_m("q_lat", "q_lon", "mid_lat", "mid_lon")
            rows = rows.withColumns({"_near": d - F.col("reach"), "_far": d + F.col("reach")})
            # k points lie within the stop distance, so nodes beyond it hold none of the nearest.
            rows = rows.withColumn("_upto", F.sum("n").over(near))
            rows = rows.withColumn("_stop", F.min(F.when(F.col("_upto") >= F.col("k"), F.col("_far"))).over(whole))
            rows = rows.where(F.col("_stop").isNull() | (F.col("_near") <= F.col("_stop"))).drop("_near", "_far", "_upto", "_stop")
            rows = rows.withColumn("_opened", ~F.col("leaf"))
            if level < self.deepest:
                rows = self._open(rows, level)
        return rows.drop("_opened")

    def at_rim(self, rows: DataFrame) -> DataFrame:
        """Places of the leaves among ``rows`` with their distance ``dist_m``; n and sums are those of the place."""
        held = self.places.select(*self.by, "level", "cell", "lat", "lon", *[F.col(c).alias(f"__{c}") for c in ["n", *self.sums]])
        on = [*self.by, "level", "cell"]
        met = rows.join(F.broadcast(held), on) if self.small_places else spread_join(settle(rows), held, on)
        met = met.withColumns({c: F.col(f"__{c}") for c in ["n", *self.sums]}).drop(*[f"__{c}" for c in ["n", *self.sums]])
        return met.withColumn("dist_m", haversine_m("q_lat", "q_lon", "lat", "lon"))

    def best(self, points: DataFrame, pos: Sequence[str], order: Sequence[Column], k: int, keep: Sequence[str]) -> DataFrame:
        """The first ``k`` points in ``order`` of every node: by, level, cell, lat, lon and ``keep``. Built from the leaves upwards, so a node
        sees ``k`` rows of each child."""
        rows = points.select(*self.by, F.col(pos[0]).cast("double").alias("lat"), F.col(pos[1]).cast("double").alias("lon"), *keep)
        rows = top_k(rows, k, order, [*self.by, "lat", "lon"])
        homes = self.places.select(*self.by, "lat", "lon", "level", "cell")
        on = [*self.by, "lat", "lon"]
        rows = rows.join(F.broadcast(homes), on) if self.small_places else spread_join(rows, homes, on)
        ups = self.nodes.select(*self.by, "level", "cell", "parent")
        out = above = None
        for level in range(self.deepest, -1, -1):
            here = rows.where(F.col("level") == level).select(*self.by, "level", "cell", "lat", "lon", *keep)
            here = top_k(here if above is None else here.unionByName(above), k, order, [*self.by, "level", "cell"])
            here = settle(here) if self.deepest > 1 else here
            out = here if out is None else out.unionByName(here)
            if level:
                up = here.join(ups.where(F.col("level") == level), [*self.by, "level", "cell"])
                above = up.select(*self.by, F.lit(level - 1).alias("level"), F.col("parent").alias("cell"), "lat", "lon", *keep)
        return out

    def meet_best(self, rows: DataFrame, best: DataFrame, k: int) -> DataFrame:
        """Nodes among ``rows`` with their best points, rows of :meth:`best` for ``k``."""
        return self._meet(rows, best, [*self.by, "level", "cell"], "inner", self.size * max(1, k))


def members(pyramid: Pyramid, found: DataFrame, points: DataFrame, pos: Sequence[str], order: Sequence[Column], k: int, keep: Sequence[str]) -> DataFrame:
    """Points at the found places (rows of :meth:`Pyramid.at_rim`): of each place the first ``k`` in ``order``."""
    rows = points.select(*pyramid.by, F.col(pos[0]).cast("double").alias("lat"), F.col(pos[1]).cast("double").alias("lon"), *keep)
    on = [*pyramid.by, "lat", "lon"]
    first = top_k(rows, k, order, on)
    return found.join(F.broadcast(first), on) if pyramid.small_places and k <= 8 else spread_join(found, first, on)
