"""Distance joins by grid cells: an equi join on cell keys, then the exact distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalar import EARTH_RADIUS_M, haversine_m
from footfall.operators.pyramid import Pyramid
from footfall.operators.scale import scalar, scalar_quantiles, spread_join
from footfall.session import settle


def _band(lat: Column, step: float) -> Column:
    return F.floor(lat / F.lit(step)).cast("bigint")


def _cell_lon(lon: Column, band: Column, step: float, metres: float) -> Column:
    """Longitude cell inside a latitude band; cells widen towards the poles so that each is at least ``metres`` wide."""
    import math

    # The narrowest place of a band is its edge farther from the equator.
    edge = F.least(F.greatest(F.abs(band), F.abs(band + 1)).cast("double") * F.lit(step), F.lit(89.9))
    width = F.lit(math.degrees(metres / EARTH_RADIUS_M) * 1.001) / F.cos(F.radians(edge))
    cells = F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("bigint")
    place = F.floor((F.pmod(lon + 180.0, F.lit(360.0))) / F.lit(360.0) * cells).cast("bigint")
    return F.struct(place.alias("c"), cells.alias("n"))


def _step(metres: float) -> float:
    import math

    return math.degrees(metres / EARTH_RADIUS_M) * 1.001


def in_cells(points: DataFrame, metres: float, pos: tuple[str, str]) -> DataFrame:
    """Add _band and _cell, the grid cell of each point; points without position are left out."""
    lat, lon = (F.col(c) for c in pos)
    band = _band(lat, _step(metres))
    return points.where(lat.isNotNull() & lon.isNotNull()).withColumns({"_band": band, "_cell": _cell_lon(lon, band, _step(metres), metres)["c"]})


def looking(points: DataFrame, metres: float, pos: tuple[str, str]) -> DataFrame:
    """Each point once for every grid cell that its surroundings touch. Longitude cells wrap at the date line."""
    lat, lon = (F.col(c) for c in pos)
    step = _step(metres)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    looks = points.where(lat.isNotNull() & lon.isNotNull()).withColumn("_band", F.explode(F.transform(near, lambda i: _band(lat, step) + i)))
    looks = looks.withColumn("_s", _cell_lon(lon, F.col("_band"), step, metres))
    around = F.array_distinct(F.transform(near, lambda i: F.pmod(F.col("_s")["c"] + i, F.col("_s")["n"])))
    return looks.withColumn("_cell", F.explode(around)).drop("_s")


def radius_join(left: DataFrame, right: DataFrame, metres: float, left_pos=("lat", "lon"), right_pos=("lat", "lon"), small: bool = False) -> DataFrame:
    """All (left, right) pairs at most ``metres`` apart, with ``dist_m``. Column names of the sides must differ
    apart from the positions, which are dropped on the right.

    Each right point lies in one cell; each left point looks into the cells around it. Crowded cells are split by :func:`spread_join`.
    A right side that the caller counted as ``small`` goes to every task instead, and the left rows stay where they are.
    """
    rest = [F.col(c) for c in right.columns if c not in right_pos]
    cells = in_cells(right, metres, right_pos).select("_band", "_cell", F.col(right_pos[0]).alias("_rlat"), F.col(right_pos[1]).alias("_rlon"), *rest)
    looks = looking(left, metres, left_pos)
    met = looks.join(F.broadcast(cells), ["_band", "_cell"]) if small else spread_join(looks, cells, ["_band", "_cell"], both=True)
    dist = haversine_m(F.col(left_pos[0]), F.col(left_pos[1]), F.col("_rlat"), F.col("_rlon"))
    return met.withColumn("dist_m", dist).where(F.col("dist_m") <= metres).drop("_band", "_cell", "_rlat", "_rlon")


# Places of a leaf where surroundings are added up: small ones keep the rim thin.
RIM_LEAF = 4


class Surroundings:
    """What lies within ``metres`` of the distinct positions of ``left``: totals and the nearest distance, by a pyramid per grid cell.

    No pair of points is built but at the rim: cells wholly within the radius add their totals.
    """

    def __init__(self, left: DataFrame, points: DataFrame, metres: float, left_pos: tuple[str, str], pos: tuple[str, str], sums: tuple[str, ...] = ()):
        self.metres, self.sums = metres, list(sums)
        self.tree = Pyramid(in_cells(points, metres, pos), ["_band", "_cell"], pos, sums, depth=5, leaf=RIM_LEAF)
        spots = left.select(F.col(left_pos[0]).alias("q_lat"), F.col(left_pos[1]).alias("q_lon")).distinct()
        asked = spots.withColumns({"q": F.struct("q_lat", "q_lon"), "radius_m": F.lit(float(metres)), "k": F.lit(1)})
        self.asked = settle(looking(asked, metres, ("q_lat", "q_lon")))

    def totals(self) -> DataFrame:
        """q (q_lat, q_lon), n and the sums over the points within the radius; nothing for a position without any."""
        found = settle(self.tree.within(self.asked))
        held = ["q", "n", *self.sums]
        rim = self.tree.at_rim(found.where("not inside")).where(F.col("dist_m") <= self.metres)
        both = found.where("inside").select(*held).unionByName(rim.select(*held))
        return both.groupBy("q").agg(*[F.sum(c).alias(c) for c in held[1:]])

    def nearest(self) -> DataFrame:
        """q and the distance ``nearest_m`` of the nearest point within the radius."""
        found = self.tree.at_rim(self.tree.around(self.asked)).where(F.col("dist_m") <= self.metres)
        return found.groupBy("q").agg(F.min("dist_m").alias("nearest_m"))


def count_looks(left: DataFrame, right: DataFrame, metres: float, left_pos=("lat", "lon"), right_pos=("lat", "lon")) -> int:
    """Pairs that :func:`radius_join` compares."""
    looks = looking(left.select(*left_pos), metres, left_pos).groupBy("_band", "_cell").agg(F.count(F.lit(1)).alias("n"))
    held = in_cells(right.select(*right_pos), metres, right_pos).groupBy("_band", "_cell").agg(F.count(F.lit(1)).alias("k"))
    return looks.join(held, ["_band", "_cell"]).agg(F.sum(F.col("n") * F.col("k"))).first()[0] or 0


def nearest_join(left: DataFrame, right: DataFrame, metres: float, left_key: str, right_key: str, left_pos=("lat", "lon"), right_pos=("lat", "lon")) -> DataFrame:
    """The nearest right point within ``metres`` per left point, smallest key on ties."""
    near = radius_join(left.select(left_key, *left_pos), right.select(right_key, *right_pos), metres, left_pos, right_pos)
    best = F.struct(F.col("dist_m"), F.col(right_key))
    return near.groupBy(left_key).agg(F.min(best).alias("b")).select(left_key, F.col(f"b.{right_key}"), F.col("b.dist_m"))


def radius_count(df: DataFrame, metres: float, key: str, pos=("lat", "lon"), name: str = "walking_density") -> DataFrame:
    """Number of other points within ``metres`` of each point, 0 when alone or without position. Each row is a point; keys are distinct."""
    totals = Surroundings(df, df, metres, pos, pos).totals().select("q.*", "n")
    met = spread_join(df.select(key, F.col(pos[0]).alias("q_lat"), F.col(pos[1]).alias("q_lon")), totals, ["q_lat", "q_lon"], "left")
    return met.select(key, F.coalesce(F.col("n") - 1, F.lit(0)).cast("int").alias(name))


def transit_access(venues: DataFrame, stops: DataFrame, metres: float = 800.0, departures: tuple[str, ...] | None = None) -> DataFrame:
    """Stops within reach, their mean daily departures, the nearest one, and a score cut at the 99 % quantile. Stops are added up by cells."""
    columns = departures or tuple(f"departure_count_dow{i}" for i in range(1, 8))
    daily = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)) / len(columns)
    around = Surroundings(
        venues, stops.select("stop_lat", "stop_lon", daily.alias("daily")), metres, ("latitude", "longitude"), ("stop_lat", "stop_lon"), ("daily",)
    )
    per = around.totals().join(around.nearest(), "q").select("q.*", "n", "daily", "nearest_m")
    met = venues.select("business_id", F.col("latitude").alias("q_lat"), F.col("longitude").alias("q_lon"))
    out = spread_join(met, per, ["q_lat", "q_lon"], "left").select(
        "business_id",
        F.coalesce("n", F.lit(0)).alias("stops_800m"),
        F.round(F.coalesce("daily", F.lit(0.0)), 1).alias("departures_day_800m"),
        F.round(F.coalesce("nearest_m", F.lit(9999.0)), 1).alias("nearest_stop_m"),
    )
    (q99,) = scalar_quantiles(out, "departures_day_800m", 0.99)
    # A zero quantile is replaced by 1.
    top = F.coalesce(F.nullif(q99, F.lit(0.0)), F.lit(1.0))
    return out.withColumn("transit_access_score", F.round(F.least("departures_day_800m", top) / top, 4))
