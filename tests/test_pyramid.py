"""Counts, best and nearest points by pyramids of cells against plain comparisons."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from footfall.operators import clean, geo, recommend
from footfall.operators.pyramid import Pyramid


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def crowd(rng, n, lat=40.0, lon=-75.0, width=0.3):
    """Points, half of them in a dense middle, some at one place."""
    rows = [(lat + rng.uniform(-width, width), lon + rng.uniform(-width, width)) for _ in range(n // 2)]
    rows += [(lat + rng.gauss(0, width / 60), lon + rng.gauss(0, width / 60)) for _ in range(n - n // 2 - n // 8)]
    return rows + [(lat, lon)] * (n // 8)


@pytest.fixture(scope="module")
def towns():
    rng = random.Random(1)
    venues = []
    for city, (lat, lon, n) in {"big": (40.0, -75.0, 1500), "small": (51.0, 0.0, 40), "edge": (-1.0, 179.6, 300), "one": (10.0, 10.0, 1), None: (40.0, -75.0, 5)}.items():
        venues += [(city, round(a, 6), round(b, 6)) for a, b in crowd(rng, n, lat, lon)] if n > 8 else [(city, lat + 0.01 * i, lon) for i in range(n)]
    rows = [(i, c, a, b, float(rng.randrange(12))) for i, (c, a, b) in enumerate(venues)]
    return rows + [(9001, "big", None, -75.0, 3.0)]


def test_serving_against_plain_search(spark, towns):
    rng = random.Random(2)
    where = {"big": (40.0, -75.0), "small": (51.0, 0.0), "edge": (-1.0, 179.6), "one": (10.0, 10.0), "nowhere": (0.0, 0.0)}
    asked = []
    for i in range(150):
        city = rng.choice([*where])
        a, b = where[city]
        near = rng.random() < 0.7
        asked.append((i, city, a + rng.uniform(-0.2, 0.2) * (1 if near else 20), b + rng.uniform(-0.2, 0.2) * (1 if near else 8), rng.choice([0.001, 0.4, 3.0, 15.0, 60.0]), rng.choice([1, 3, 10])))
    asked += [(200 + i, "big", 40.0, -75.0, r, k) for i, (r, k) in enumerate([(0.0, 5), (0.5, 7), (0.5, 7), (500.0, 3)])] + [(300, None, 40.0, -75.0, 5.0, 3)]
    venues = spark.createDataFrame(towns, "business_id bigint, city string, latitude double, longitude double, score double")
    requests = spark.createDataFrame(asked, "request_id bigint, city string, ref_lat double, ref_lon double, radius_km double, k int")
    got = {(r["request_id"], r["place"]): (r["business_id"], r["fallback"], round(r["distance_km"], 3)) for r in recommend.serve(venues, requests).collect()}
    want = {}
    for q, city, a, b, radius, k in asked:
        held = [(km(a, b, c, d), -s, i) for i, t, c, d, s in towns if city is not None and t == city and c is not None]
        near = sorted((s, i, x) for x, s, i in held if x <= radius)
        rows = [(i, False, x) for _, i, x in near[:k]] if near else [(i, True, x) for x, _, i in sorted((round(x, 9), s * 0, i) for x, s, i in held)[:k]]
        want.update({(q, p + 1): (i, f, round(x, 3)) for p, (i, f, x) in enumerate(rows)})
    assert got == want


def test_pyramid_is_deep_and_whole(spark, towns):
    points = spark.createDataFrame([(c, a, b, s) for _, c, a, b, s in towns], "city string, lat double, lon double, s double")
    tree = Pyramid(points, ["city"], ("lat", "lon"), ["s"], leaf=4)
    assert tree.deepest >= 2
    roots = {r["city"]: (r["n"], r["s"]) for r in tree.nodes.where("level = 0").collect()}
    assert roots["big"] == (1500, sum(s for _, c, a, _, s in towns if c == "big" and a is not None))
    leaves = tree.nodes.where("leaf").groupBy("city").agg(F.sum("n").alias("n"))
    assert {r["city"]: r["n"] for r in leaves.collect()} == {c: n for c, (n, _) in roots.items()}
    assert tree.places.agg(F.sum("n")).first()[0] == tree.nodes.where("level = 0").agg(F.sum("n")).first()[0]


def test_radius_counts(spark):
    rng = random.Random(3)
    rows = crowd(rng, 900, 40.0, -75.0, 0.02) + crowd(rng, 200, 0.0, 179.999, 0.004) + [(89.99, 10.0), (89.99, -170.0), (-45.0, 3.0)]
    rows = [(i, a, b if b <= 180 else b - 360) for i, (a, b) in enumerate(rows)] + [(5000, None, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lon double")
    got = {r["id"]: r["walking_density"] for r in geo.radius_count(df, 800.0, "id").collect()}
    want = {i: 0 if a is None else sum(km(a, b, c, d) <= 0.8 for j, c, d in rows if j != i and c is not None) for i, a, b in rows}
    assert got == want


def test_stops_around_venues(spark):
    rng = random.Random(4)
    spots = [(i, a, b) for i, (a, b) in enumerate(crowd(rng, 60, 40.0, -75.0, 0.02))] + [(100, 45.0, 5.0)]
    halts = [(a, b, float(rng.randrange(50))) for a, b in crowd(rng, 500, 40.0, -75.0, 0.02)]
    near = geo.Surroundings(spark.createDataFrame(spots, "id int, la double, lo double"), spark.createDataFrame(halts, "lat double, lon double, w double"), 800.0, ("la", "lo"), ("lat", "lon"), ("w",))
    totals = {tuple(r["q"]): (r["n"], r["w"]) for r in near.totals().collect()}
    nearest = {tuple(r["q"]): round(r["nearest_m"], 4) for r in near.nearest().collect()}
    for _, a, b in spots:
        held = [(1000 * km(a, b, c, d), w) for c, d, w in halts if km(a, b, c, d) <= 0.8]
        assert totals.get((a, b)) == ((len(held), sum(w for _, w in held)) if held else None)
        assert nearest.get((a, b)) == (round(min(held)[0], 4) if held else None)


def test_rows_do_not_grow_with_the_square(spark):
    """Ten times the points in the same area: pairs within the radius grow a hundredfold, rows of the pyramid far less."""
    seen, pairs = [], []
    for n in (400, 4000):
        rng = random.Random(5)
        rows = [(i, 40.0 + rng.uniform(-0.008, 0.008), -75.0 + rng.uniform(-0.01, 0.01)) for i in range(n)]
        df = spark.createDataFrame(rows, "id bigint, lat double, lon double")
        near = geo.Surroundings(df, df, 800.0, ("lat", "lon"), ("lat", "lon"))
        found = near.tree.within(near.asked)
        rim = near.tree.at_rim(found.where("not inside"))
        seen.append(found.where("inside").count() + rim.count())
        pairs.append(near.totals().agg(F.sum("n")).first()[0])
    assert pairs[1] > 80 * pairs[0] and seen[1] < 45 * seen[0] and seen[1] < 0.4 * pairs[1]


def test_city_lists_and_pools(spark):
    venues = [(i, "x" if i % 3 else "y", "s" if i < 20 else "t", float(i % 5), i % 7 / 7, i % 4) for i in range(30)] + [(99, "lone", "u", 5.0, None, 1)]
    df = spark.createDataFrame(venues, "business_id bigint, city string, state string, stars double, revisit_rate double, unique_users bigint")
    asked = spark.createDataFrame([(1, "x", "Loyalist"), (2, "x", "Casual Weekender"), (3, "y", "?"), (4, "lone", None), (5, "none", "?")], "request_id int, city string, archetype string")
    got = Counter((r["request_id"], r["place"], r["business_id"]) for r in recommend.city_top(df, asked).collect())
    want = Counter()
    for q, city, column in ((1, "x", 4), (2, "x", 5), (3, "y", 3), (4, "lone", 3)):
        order = sorted((-(v[column] or 0.0), v[0]) for v in venues if v[1] == city)
        want.update((q, p + 1, i) for p, (_, i) in enumerate(order[:3]))
    assert got == want
    pools = {r["request_id"]: (r["level"], r["pool"], r["n_pool"]) for r in clean.city_pool(df, spark.createDataFrame([(1, "x", "s"), (2, "lone", "s"), (3, "lone", "u"), (4, None, None)], "request_id int, city string, state string"), 12).collect()}
    assert pools == {1: ("city", "x", 20), 2: ("state", "s", 20), 3: ("all", "all", 31), 4: ("all", "all", 31)}
    assert clean.pool_members(df).where("level = 'all'").count() == 31
