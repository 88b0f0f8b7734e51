"""Hand-computed answers on small frames."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.functions import scalar as sc
from footfall.functions import tails
from footfall.operators import cf, clean, evaluate, events, features, geo, graph, linkage, recommend, restaurant, scale, stats, text
from footfall.sources import readers, schemas, sinks


def rows(df, key=0):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def visits(spark):
    t = datetime(2020, 1, 1, 10)
    data = [("one", "a", t)]
    data += [("weekly", "a", t + timedelta(days=7 * i)) for i in range(12)]
    data += [("explorer", v, t + timedelta(days=d)) for v, d in zip("abcd", (0, 1, 5, 40))]
    data += [(None, "a", t)]
    return spark.createDataFrame(data, "user_id string, business_id string, ts timestamp").cache()


def test_user_features(visits):
    got = rows(features.user_features(visits))
    assert got["weekly"]["burstiness_index"] == pytest.approx(-1.0, abs=1e-6)
    assert got["explorer"]["venue_entropy"] == pytest.approx(2.0)
    assert got["one"]["burstiness_index"] is None and got["one"]["venue_entropy"] == 0
    assert got["weekly"]["revisit_ratio"] == pytest.approx(11 / 12)


def test_gaps_pool_over_months(visits):
    got = rows(features.gap_moments(visits, "user_id"))
    gaps = np.array([1.0, 4.0, 35.0])
    assert got["explorer"]["gap_mean"] == pytest.approx(gaps.mean())
    assert got["explorer"]["gap_std_pop"] == pytest.approx(gaps.std())
    assert got["explorer"]["gap_std"] == pytest.approx(gaps.std(ddof=1))


def test_gini(spark):
    df = spark.createDataFrame([("x", 1)] * 4 + [("y", 1), ("y", 3)], "k string, n int")
    got = rows(features.gini(df, ["k"], "n"))
    assert got["x"]["gini"] == pytest.approx(0.0) and got["y"]["gini"] == pytest.approx(0.25)


def test_spread_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("l"))
    right = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("r"))
    plain = left.join(right, "k").agg(F.count("*"), F.sum(F.hash("l", "r").cast("bigint"))).first()
    split = scale.spread_join(left, right, ["k"], min_chunk=100).agg(F.count("*"), F.sum(F.hash("l", "r").cast("bigint"))).first()
    assert tuple(plain) == tuple(split)


@pytest.mark.parametrize("how,both", [("inner", True), ("inner", False), ("left", False)])
def test_spread_join_splits_hot_and_missing_keys(spark, how, both):
    """A third of the rows of either side on one key and a third without key: same rows as the plain join, no large partition."""
    key = lambda n: F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % n)
    left = spark.range(9000).select(key(500).alias("k"), F.col("id").alias("l"))
    right = spark.range(600).select(key(400).alias("k"), F.col("id").alias("r"))
    got = scale.spread_join(left, right, ["k"], how, min_chunk=50, both=both)
    sums = (F.count("*"), F.count("k"), F.sum(F.hash("l", "r").cast("bigint")))
    assert got.agg(*sums).first() == left.join(right, ["k"], how).agg(*sums).first()
    if how == "left":
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            sizes = [r[1] for r in got.where("k is null").groupBy(F.spark_partition_id()).count().collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert max(sizes) < 3000 * 0.5


def test_numbers_and_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(i, "g" if i % 3 else "h", float(x)) for i, x in enumerate(values)], "id int, g string, v double")
    numbered = scale.number_rows(df, [F.col("v"), F.col("id")], ["g"], "n").toPandas()
    for _, part in numbered.groupby("g"):
        assert sorted(part["n"]) == list(range(1, len(part) + 1))
        assert part.sort_values("n")["v"].is_monotonic_increasing
    q = scale.quantiles(df, ["v"], {"a": 0.33, "b": 0.9}).first()
    assert q["v_a"] == pytest.approx(np.quantile(values, 0.33)) and q["v_b"] == pytest.approx(np.quantile(values, 0.9))


def _dense_birank(w, p0, q0, steps, jacobi):
    p0, q0 = p0 / p0.sum(), q0 / q0.sum()
    su, sv = w / w.sum(1, keepdims=True), w / w.sum(0, keepdims=True)
    p, q = p0, q0
    for _ in range(steps):
        pn = 0.85 * su @ q + 0.15 * p0
        pn = pn / pn.sum()
        qn = 0.85 * sv.T @ (p if jacobi else pn) + 0.15 * q0
        p, q = pn, qn / qn.sum()
    return p, q


@pytest.mark.parametrize("update,max_broadcast", [("gs", 1000), ("jacobi", 1000), ("gs", 1)])
def test_birank_against_dense_loop(spark, update, max_broadcast):
    w = np.array([[2.0, 1.0, 0.0], [0.0, 3.0, 1.0], [1.0, 0.0, 4.0], [1.0, 1.0, 1.0]])
    cells = [(u, v, float(w[u, v])) for u in range(4) for v in range(3) if w[u, v]]
    e = spark.createDataFrame(cells, "user_id int, business_id int, weight double")
    p0 = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "user_id int, prior double")
    q0 = spark.createDataFrame([(i, float(3 - i)) for i in range(3)], "business_id int, prior double")
    r = graph.birank(e, p0, q0, max_iter=3, tol=None, update=update, max_broadcast=max_broadcast, chunk=2)
    p, q = _dense_birank(w, np.arange(1.0, 5), np.array([3.0, 2, 1]), 3, update == "jacobi")
    assert [r_["score"] for r_ in r.venues.orderBy("business_id").collect()] == pytest.approx(list(q))
    assert [r_["score"] for r_ in r.users.orderBy("user_id").collect()] == pytest.approx(list(p))


def test_birank_stops_and_logs(spark):
    e = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 1.0)], "user_id int, business_id int, weight double")
    r = graph.birank(e, max_iter=5, tol=1e-2)
    assert r.log[-1][1] < 1e-2 and [x[0] for x in r.log] == list(range(1, len(r.log) + 1))


def test_radius_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a = [(i, float(40 + x), float(179.99 + y if i % 2 else -75 + y)) for i, (x, y) in enumerate(rng.uniform(-0.02, 0.02, (100, 2)))]
    a = [(i, x, y - 360 if y > 180 else y) for i, x, y in a]
    left = spark.createDataFrame(a, "l int, lat double, lon double")
    right = spark.createDataFrame(a, "r int, lat double, lon double")
    got = {(x["l"], x["r"]) for x in geo.radius_join(left, right, 800.0).collect()}
    la, lo = np.radians([x[1] for x in a]), np.radians([x[2] for x in a])
    h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la[:, None]) * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    d = 2 * 6371000 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
    assert got == {(i, j) for i in range(100) for j in range(100) if d[i, j] <= 800}


def test_shared_places_and_time_window(spark):
    t = datetime(2020, 1, 1)
    a = [("u", p, t) for p in "xyz"] + [("w", "x", t), ("w", "q", t)]
    b = [("m", "x", t + timedelta(hours=71)), ("m", "y", t + timedelta(hours=73)), ("m", "z", t + timedelta(hours=72)), ("n", "x", t)]
    schema = "user_id string, place_id string, ts timestamp"
    fa, fb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert {tuple(r) for r in linkage.candidate_user_pairs(fa, fb, 2).collect()} == {("u", "m", 3)}
    got = linkage.linkable_pairs(fa, fb, 2, 72).collect()
    assert [(r["a_user"], r["b_user"], r["n_shared"], r["n_met"]) for r in got] == [("u", "m", 3, 2)]


def test_user_links_with_a_place_of_a_third_of_the_users(spark):
    """Prefixes and meetings lose no pair, and a place that very many visit pairs none of them by itself."""
    rng, t = np.random.default_rng(8), datetime(2020, 1, 1)
    rows_a, rows_b = [], []
    for side, out in ((0, rows_a), (1, rows_b)):
        for u in range(240):
            places = set(rng.choice(300, rng.integers(1, 14), replace=False).tolist())
            if u % 12 == 0:
                places = set(np.random.default_rng(u).choice(300, 9, replace=False).tolist()[: 9 - 2 * side])
            out += [(u, p, t + timedelta(hours=int(rng.integers(0, 40_000)))) for p in places]
            if u % 3 == 0:
                out += [(u, 999, t + timedelta(hours=int(rng.integers(0, 40_000)))) for _ in range(2)]
    fa, fb = (spark.createDataFrame(x, "user_id int, place_id int, ts timestamp") for x in (rows_a, rows_b))
    want = {}
    sets = [{u: {p for v, p, _ in x if v == u} for u in range(240)} for x in (rows_a, rows_b)]
    times = [{}, {}]
    for x, held in zip((rows_a, rows_b), times):
        for u, p, ts in x:
            held.setdefault((u, p), []).append(ts)
    for u in range(240):
        for w in range(240):
            both = sets[0][u] & sets[1][w]
            if len(both) < 2:
                continue
            hits = sum(any(abs(a - b) <= timedelta(hours=72) for a in times[0][u, p] for b in times[1][w, p]) for p in both)
            if hits or 4 * len(both) >= len(sets[0][u] | sets[1][w]):
                want[u, w] = (len(both), hits)
    got = {(r["a_user"], r["b_user"]): (r["n_shared"], r["n_met"]) for r in linkage.linkable_pairs(fa, fb, 2, 72).collect()}
    assert got == want and len(want) > 10
    found = {tuple(r) for r in linkage.alike_by_places(*linkage._sides(fa, fb), 0.25, 2).collect()}
    # Those that meet at the crowded place only aren't paired.
    assert all((sets[0][u] & sets[1][w]) - {999} for u, w in found)
    assert len(found) < 0.5 * sum(bool(sets[0][u] & sets[1][w]) for u in range(240) for w in range(240))


def test_user_pairs_through_lists_equal_brute_force(spark, monkeypatch):
    """Every pair counts, also one that never met in time or shares little; crowded places, users with many places and busy places lose none."""
    rng, t = np.random.default_rng(5), datetime(2020, 1, 1)
    sides = []
    for side in range(2):
        held = [(u, int(p), t + timedelta(hours=int(h))) for u in range(60) for p, h in zip(rng.choice(90, 9), rng.integers(0, 4_000, 9))]
        held += [(u, 900 + k, t + timedelta(hours=int(rng.integers(0, 4_000)))) for u in range(0, 60, 3) for k in range(2)]
        sides.append(held + [(77, p, t + timedelta(hours=p)) for p in range(0, 90, 1 + side)])
    fa, fb = (spark.createDataFrame(x, "user_id int, place_id int, ts timestamp") for x in sides)
    sets = [{u: {p for v, p, _ in x if v == u} for u in {v for v, _, _ in x}} for x in sides]
    want = {}
    for u, x in sets[0].items():
        for w, y in sets[1].items():
            if len(x & y) >= 2:
                times = [{p: [s for v, q, s in side if (v, q) == (who, p)] for p in x & y} for side, who in ((sides[0], u), (sides[1], w))]
                hits = sum(any(abs(m - n) <= timedelta(hours=72) for m in times[0][p] for n in times[1][p]) for p in x & y)
                want[u, w] = (len(x & y), hits / len(x & y), len(x), len(y))
    # None crowded, then the common ones, then all.
    for crowd, many, busy in ((1_000, 50_000, 50_000), (15, 20, 15), (2, 3, 1)):
        monkeypatch.setattr(linkage, "CROWD", crowd)
        monkeypatch.setattr(linkage, "MANY_PLACES", many)
        monkeypatch.setattr(linkage, "MIN_CHUNK", busy)
        assert {(r[0], r[1]): r[2] for r in linkage.candidate_user_pairs(fa, fb, 2).collect()} == {k: x[0] for k, x in want.items()}
        got = linkage.score_user_pairs(fa, fb).collect()
        assert {(r["a_user"], r["b_user"]): (r["n_shared"], r["temporal_score"], r["n_a"], r["n_b"]) for r in got} == want and len(got) == len(want)
        assert {(r[0], r[1]): r[3] for r in linkage.temporal_overlap(fa, fb).collect()} == {k: x[1] for k, x in want.items()}
    assert any(x[1] == 0 for x in want.values()) and any(x[1] > 0 for x in want.values())


def test_friend_paths(spark):
    raw = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 4)], "a int, b int")
    edges = linkage.undirected(raw)
    assert edges.count() == 3
    nodes = spark.createDataFrame([(1,)], "user_id int")
    assert [tuple(r) for r in linkage.friends_of_friends(edges, nodes, scope="full").collect()] == [(1, 3)]


def test_ndcg_variants(spark):
    lists = spark.createDataFrame(
        [("u", i, 1 if i in (1, 3, 12) else 0, 12, 3) for i in range(1, 13)],
        "user_id string, position int, rel int, n_candidates int, n_relevant int",
    )
    dcg = 1 + 1 / math.log2(4)
    two, three = 1 + 1 / math.log2(3), 1 + 1 / math.log2(3) + 0.5
    assert evaluate.user_metrics(lists, ideal="slice").first()["ndcg_5"] == pytest.approx(dcg / two)
    assert evaluate.user_metrics(lists).first()["ndcg_5"] == pytest.approx(dcg / three)


def test_wilcoxon_and_effects(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (1.0, 2.0)], "a double, b double")
    w = stats.wilcoxon(df, "a", "b").first()
    assert (w["w_plus"], w["w_minus"]) == (4.5, 1.5)
    same = spark.createDataFrame([(1.0, 1.0)] * 3, "a double, b double")
    assert stats.wilcoxon(same, "a", "b").first()["p"] == 1.0
    assert stats.rank_biserial(df, "a", "b").first()[0] == pytest.approx(0.3125)


def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.t_two_sided(2.0, 1e9) == pytest.approx(0.0455, abs=1e-4)
    assert tails.chi2_p(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_p(30.0, 10) == pytest.approx(0.000857, abs=1e-5)


def test_diversity_order(spark):
    rows_ = [("u", i, i + 1, s, 0.0, 0.0, c) for i, (s, c) in enumerate([(0.9, "a"), (0.89, "a"), (0.7, "b")])]
    df = spark.createDataFrame(rows_, "user_id string, business_id int, rank bigint, score double, latitude double, longitude double, categories string")
    got = [r["business_id"] for r in recommend.diversify(df, 2).orderBy("rank").collect()]
    assert got == [0, 2]


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("[3,1,1,\"x\",99]", "{'garage': False, 'lot': True}", "Tue Apr 03 18:00:09 +0000 2012", "a, ,b,")], "b string, p string, t string, c string"
    )
    r = df.select(
        sc.parse_ballot("b", F.lit(4)).alias("b"), sc.parking_flags("p").alias("p"), sc.parse_utc("t", F.lit(-60)).alias("t"), sc.tokens("c").alias("c")
    ).first()
    assert r["b"] == [2, 0, 1, 3] and r["p"]["parking_lot"] and not r["p"]["parking_garage"]
    assert r["t"] == datetime(2012, 4, 3, 17, 0, 9) and r["c"] == ["a", "b"]


def test_readers_skip_bad_rows(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"business_id": "x", "date": "2020-01-01 10:00:00, 2020-01-02 11:00:00"}\nnot json\n')
    got = events.explode_checkins(readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), schemas.CHECKINS))
    assert got.count() == 2
    (tmp_path / "p.tsv").write_text("v1\t40.0\t-75.0\tcafe\tUS\nv2\tbad\t-75.0\tcafe\tUS\n")
    assert [r["venue_id"] for r in readers.read_pois(spark, str(tmp_path / "p.tsv")).collect()] == ["v1"]
    assert readers.read_optional(spark, [str(tmp_path / "none")], "a int").count() == 0
    sinks.write_parquet(got, str(tmp_path / "out"))
    report = sinks.health_report(spark, {"out": str(tmp_path / "out"), "gone": str(tmp_path / "gone")}).collect()
    assert {r["name"]: r["present"] for r in report} == {"out": True, "gone": False}


def test_minmax_flat(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r[0] for r in clean.minmax(df, "x").collect()] == [0.0, 0.0]
    assert [r[0] for r in clean.minmax(df, "x", on_flat="ones").collect()] == [1.0, 1.0]


def test_name_scores_lose_no_pair(spark):
    from footfall.operators import text

    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdé "), rng.integers(1, 9)))
    names = sorted({word() for _ in range(150)} | {"goats", "abc", "Old Town", ""})
    asked = sorted({word() for _ in range(60)} | {"at", "axc", "d t", "OLD TOWN", ""})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = following(row, i, x, b)
        return row[-1]

    def following(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    want = {}
    for q in asked:
        for n in names:
            a, b = q.lower(), n.lower()
            if not a or not b:
                continue
            score = 2.0 if a == b else 1.2 if a in b else 1 - distance(a, b) / max(len(a), len(b))
            if score >= 0.45:
                want[q, n] = round(score, 9)
    got = text.name_scores(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {(r["query"], r["name"]): round(r["score"], 9) for r in got.collect()} == want
    assert want["at", "goats"] == 1.2 and ("axc", "abc") in want


def test_csv_both_ways_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", datetime(2020, 1, 2)), (2, None, datetime(2021, 3, 4)), (3, 'say "x"', None)], "k int, t string, ts timestamp")
    sinks.write_csv(df, str(tmp_path / "csv"))
    schema = "k int, t string, ts timestamp"
    back = readers.read_csv(spark, str(tmp_path / "csv"), schema, escape='"', quote='"')
    assert {r["k"]: r["ts"] for r in back.collect()} == {1: datetime(2020, 1, 2), 2: datetime(2021, 3, 4), 3: None}
    assert {r["k"]: r["t"] for r in back.collect()}[1] == "a,b"
    assert readers.read_csv(spark, str(tmp_path / "csv"), schema, ["ts", "k"]).columns == ["ts", "k"]
    (tmp_path / "bad.csv").write_text("k,t,ts\n1,x,2020-01-02\nnone,y,2020-01-02\n3,z,2020-01-03\n")
    assert sorted(r["k"] for r in readers.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()) == [1, 3]
    name = f"kept_{tmp_path.name.replace('-', '_')}"
    try:
        sinks.save_table(df, name, ["k"], 3)
        assert spark.table(name).count() == 3
        assert any(r["col_name"] == "Num Buckets" and r["data_type"] == "3" for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect())
        sinks.save_table(df.where("k < 3"), name)
        assert spark.table(name).count() == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert clean.select_available(df, ["ts", "nothing", "k"]).columns == ["ts", "k"]


def test_mean_busyness_is_rounded_from_counts(spark):
    """Weeks whose mean over 168 hours is 0.75, 1.25 and 0.75: half up, where a sum of shares misses them by its last bit."""
    week, events = datetime(2020, 1, 6), []
    for key, top, each, hours in ((1, 300, 1, 78), (2, 350, 11, 35), (3, 900, 3, 78)):
        events += [(key, week)] * top + [(key, week + timedelta(hours=1 + i)) for i in range(hours)] * each
    got = rows(restaurant.busyness(spark.createDataFrame(events, "business_id int, ts timestamp"), F.col("ts"), "all"))
    assert {k: r["avg_busyness"] for k, r in got.items()} == {1: 0.8, 2: 1.3, 3: 0.8}


def test_cosine_of_repeated_pairs(spark):
    """Two points with one text near a venue have the same likeness to it as one."""
    pairs = spark.createDataFrame([(1, "t", 10), (1, "t", 11)], "a int, b string, poi int")
    vec_a = spark.createDataFrame([(1, "x", 0.6), (1, "y", 0.8)], "a int, term string, weight double")
    vec_b = spark.createDataFrame([("t", "x", 1.0)], "b string, term string, weight double")
    got = text.cosine_pairs(pairs, vec_a, vec_b, "a", "b").collect()
    assert sorted((r["poi"], r["similarity"]) for r in got) == [(10, 0.6), (11, 0.6)]


def test_explanations_at_their_thresholds(spark):
    """A measure level with its threshold but for its last bit isn't below it; ratings are rounded from their exact value."""
    cols = "business_id int, repeat_user_rate double, stability_cv double, gini_user_contribution double, rating_mean double, seasonal_variance double, top_user_share double"
    below = (1, 0.0, np.nextafter(0.5, 0).item(), np.nextafter(0.7, 0).item(), 4.55, np.nextafter(50.0, 0).item(), 0.5)
    level = (2, 0.0, 0.5, 0.7, 4.85, 50.0, 0.5)
    got = rows(clean.venue_explanations(spark.createDataFrame([below, level], cols)))
    assert got[1]["explain_1"] == "Excellent customer ratings (4.5★)" and got[2]["explain_1"] == "Excellent customer ratings (4.8★)"


def test_pool_rows_lists_every_venue(spark):
    df = spark.createDataFrame([(i, "x" if i < 3 else "y", "s" if i < 5 else "u") for i in range(8)], "business_id int, city string, state string")
    asked = spark.createDataFrame([(1, "x", "s"), (2, "none", "s"), (3, None, None)], "request_id int, city string, state string")
    got = {tuple(r) for r in clean.pool_rows(df, asked, 3).collect()}
    assert got == {(1, "city", i) for i in range(3)} | {(2, "state", i) for i in range(5)} | {(3, "all", i) for i in range(8)}


def test_candidates_are_made_where_the_user_lies(spark, monkeypatch):
    """Few venues travel to the users: candidates are weighted and ranked without being shuffled, and equal those met by cells."""
    rng = np.random.default_rng(3)
    users = [(i, 40 + float(x), -75 + float(y), 3.0, "Critic", "Explorer", 0.6, 4.0) for i, (x, y) in enumerate(rng.uniform(-0.2, 0.2, (30, 2)))]
    venues = [(100 + i, 40 + float(x), -75 + float(y), 50 + i, 0.1, 3.5, 0.5, 0.5, 70.0, "Bars, Food") for i, (x, y) in enumerate(rng.uniform(-0.2, 0.2, (40, 2)))]
    u = spark.createDataFrame(users, "user_id int, centroid_lat double, centroid_lon double, avg_visited_rating double, critic_tag string, archetype string, parking_sensitivity double, spatial_range_km double")
    v = spark.createDataFrame(venues, "business_id int, latitude double, longitude double, popularity int, repeat_user_rate double, avg_rating double, parking_score double, transit_access_score double, peak_busyness double, cuisine_categories string")
    best = recommend.score_candidates(u, v, keep=5)
    got = {(r["user_id"], r["business_id"], r["rank"], r["score"]) for r in best.collect()}
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # initial and final plan show the dealt users
    monkeypatch.setattr(recommend, "SMALL_VENUES", 0)
    assert got == {(r["user_id"], r["business_id"], r["rank"], r["score"]) for r in recommend.score_candidates(u, v, keep=5).collect()} and len(got) > 50


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [None, 1])
def test_personal_scores_travel_as_lists(spark, monkeypatch, chunk):
    """Products of items are neither shuffled nor joined; hot items cut into pieces give the same scores."""
    if chunk:
        monkeypatch.setattr(cf, "hot_keys", lambda df, on: scale.hot_keys(df, on, chunk))
    rng = np.random.default_rng(4)
    w = {(int(u), int(i)): float(1 + (u + i) % 3) for u, i in zip(rng.integers(0, 40, 300), rng.integers(0, 25, 300))}
    w[1000, 1000] = 2.0
    edges = spark.createDataFrame([(u, i, x) for (u, i), x in w.items()], "user_id long, business_id long, weight double")
    pairs = [p for p in w if p[0] % 2 == 0] + [(2, 999)]
    m = np.zeros((1001, 1001))
    for (u, i), x in w.items():
        m[u, i] = x
    unit = m / np.maximum(np.sqrt((m * m).sum(0)), 1e-300)
    cos = unit.T @ unit
    np.fill_diagonal(cos, 1.0)
    out = cf.item_knn_personal(edges, spark.createDataFrame(pairs, "user_id long, business_id long"))
    got = {(r[0], r[1]): r[2] for r in out.collect()}
    assert set(got) == set(pairs)
    for u, j in pairs:
        assert got[u, j] == pytest.approx(cos[m[u] > 0, j].sum(), abs=1e-12)
    assert "hashpartitioning(i#" not in plan_of(out) and "hashpartitioning(j#" not in plan_of(out)
    sims = {(r["i"], r["j"]): r["similarity"] for r in cf.item_cosines(edges).collect()}
    assert set(sims) == {(i, j) for i, j in zip(*cos.nonzero()) if i != j}
    assert all(v == pytest.approx(cos[k], abs=1e-12) for k, v in sims.items())


def test_blend_weights_are_not_shuffled(spark):
    parts = spark.createDataFrame([(u, b, ((u * 7 + b * 3) % 10) / 10, ((u + b * 5) % 10) / 10) for u in range(30) for b in range(1 + u % 25)], "user_id int, business_id int, g double, m double")
    train = parts.select("user_id", "business_id")
    test = train.where("(user_id + business_id) % 4 = 0")
    lams = [0.0, 0.3, 1.0]
    grid = parts.crossJoin(spark.createDataFrame([(x,) for x in lams], "lam double")).select("lam", "user_id", "business_id", F.round(F.col("lam") * F.col("g") + (1 - F.col("lam")) * F.col("m"), 9).alias("score"))
    plain = evaluate.user_metrics(evaluate.rerank(train, test, grid, ["lam"]), ["lam"])
    got = cf.weight_metrics(parts, train, test, lams)
    key = lambda r: (r["lam"], r["user_id"])
    want = {key(r): r.asDict() for r in plain.collect()}
    have = {key(r): r.asDict() for r in got.collect()}
    assert set(want) == set(have) and all(have[k] == pytest.approx(want[k]) for k in want)
    assert "Window" not in plan_of(got) and "hashpartitioning(lam" not in plan_of(got)


@pytest.mark.parametrize("longest", [4096, 2])
def test_friends_travel_as_lists(spark, monkeypatch, longest):
    """Pairs made through friends are not shuffled; cut lists and many partitions give the same ones."""
    monkeypatch.setattr(linkage, "LIST", longest)
    monkeypatch.setattr(linkage, "MEETINGS", 50)
    rng = np.random.default_rng(7)
    raw = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (90, 2)).tolist() if a != b} | {(0, i) for i in range(1, 25)}
    edges = spark.createDataFrame(sorted(raw), "user_a int, user_b int")
    friends = {}
    for a, b in raw:
        friends.setdefault(a, set()).add(b)
        friends.setdefault(b, set()).add(a)
    linked = {u: 1 / (1 + u) for u in range(0, 40, 3)}
    nodes = spark.createDataFrame(sorted(linked.items()), "b_user_id int, confidence double")
    far = linkage.friends_of_friends(edges, nodes, "b_user_id", "full", "confidence")
    want = {(u, w, c) for u, c in linked.items() for m in friends.get(u, ()) for w in friends[m] if w != u and w not in friends[u]}
    assert sorted(map(tuple, far.select("u", "w", "confidence").collect())) == sorted(want)
    got = {tuple(r) for r in linkage.friends_of_friends(edges, nodes, "b_user_id").collect()}
    known = {(u, w) for u in linked for w in friends.get(u, ())}
    touching = known | {(w, u) for u, w in known}
    assert got == {(u, w) for u, m in known for x, w in touching if x == m and w != u and (u, w) not in known}
    visits = spark.createDataFrame([(int(u), int(v)) for u, v in rng.integers(0, 40, (200, 2))] + [(None, 1)], "user_id int, business_id int")
    seen = {(r[0], r[1]) for r in visits.collect() if r[0] is not None}
    counts = {}
    for u in friends:
        for w, v in seen:
            if w in friends[u]:
                counts[u, v] = counts.get((u, v), 0) + 1
    out = linkage.friend_visits(edges, visits)
    assert {(r[0], r[1]): r[2] for r in out.collect()} == counts
    assert "hashpartitioning(user_id" in plan_of(out) and ", business_id#" not in "".join(x for x in plan_of(out).split("\n") if "hashpartitioning(u" in x)
    assert not any("hashpartitioning(u#" in x and ", w#" in x for x in plan_of(far).split("\n"))


def test_ranking_meets_edges_once(spark, monkeypatch):
    """All settings ride on one row per node and a user's edges lie together; the scores are those of each setting alone."""
    rng = np.random.default_rng(9)
    edges = spark.createDataFrame([(int(u), int(v), float(1 + (u * v) % 3)) for u, v in {(a, b) for a, b in rng.integers(0, 30, (250, 2)).tolist()}], "user_id int, business_id int, weight double")
    written = []
    monkeypatch.setattr(graph, "settle", lambda df: written.append(df) or scale.settle(df))
    cells = [(0.5, 0.85), (0.85, 0.5), (0.7, 0.7)]
    for light in (2_000_000, 0):
        together = {(r["cell"], r["business_id"]): r["score"] for r in graph.birank(edges, max_iter=2, tol=None, cells=cells, max_broadcast=light, chunk=3).venues.collect()}
        for c, (a, b) in enumerate(cells):
            alone = graph.birank(edges, alpha=a, beta=b, max_iter=2, tol=None).venues.collect()
            assert {r["business_id"]: pytest.approx(r["score"]) for r in alone} == {v: s for (k, v), s in together.items() if k == c}
    edge = next(df for df in written if "w_user" in df.columns)
    assert edge.withColumn("p", F.spark_partition_id()).groupBy("user_id").agg(F.count_distinct("p").alias("n")).agg(F.max("n")).first()[0] == 1


def test_terms_are_counted_in_their_row(spark):
    """Rows of one key add up, null and empty texts have no terms, and rows of their own are counted without a shuffle."""
    data = [(1, "b a b"), (2, ""), (3, None), (4, "a c"), (4, "c d"), (None, "e"), (None, "e f"), (5, "c")]
    docs = spark.createDataFrame(data, "doc int, text string")
    got = sorted((tuple(r) for r in text.term_counts(docs, "doc", "text").collect()), key=str)
    assert got == sorted([(1, "a", 1), (1, "b", 2), (4, "a", 1), (4, "c", 2), (4, "d", 1), (None, "e", 2), (None, "f", 1), (5, "c", 1)], key=str)
    runs = docs.select(text.counted(F.split("text", " ")).alias("x"))
    assert "Exchange" not in plan_of(runs) and [tuple(x) for x in runs.first()["x"]] == [("a", 1), ("b", 2)]


def test_diversity_of_many_lists_equals_one_by_one(spark, monkeypatch):
    """Lists of several users and batches against a plain loop; lists stay where candidates dealt by user lie."""
    import random

    monkeypatch.setattr(recommend, "FOLD_USERS", 3)
    rng = random.Random(6)
    kinds = [None, "", "a", "a, b", "b, a, a", "c, b", "d"]
    rows_ = []
    for u in range(17):
        for i in range(rng.choice([1, 2, 7, 30])):
            rows_.append((f"u{u}", i, i + 1, round(rng.random(), 2), 40 + rng.random() / 20, -75 + rng.random() / 20, rng.choice(kinds)))
    df = spark.createDataFrame(rows_, "user_id string, business_id int, rank bigint, score double, latitude double, longitude double, categories string")

    def like(a, b):
        x, y = (set((r[6] or "").split(", ")) for r in (a, b))
        p, q = (math.radians(r[4]) for r in (a, b))
        h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[5] - b[5]) / 2) ** 2
        return 0.7 * len(x & y) / len(x | y) + 0.3 * max(0.0, 1 - 2 * sc.EARTH_RADIUS_M / 1000 * math.asin(math.sqrt(h)) / 5)

    want = []
    for u in {r[0] for r in rows_}:
        left, chosen = [r for r in rows_ if r[0] == u], []
        while left and len(chosen) < 20:
            best = max(left, key=lambda r: (round(r[3] if not chosen else 0.7 * r[3] - 0.3 * max(like(r, c) for c in chosen), 9), -r[2]))
            left.remove(best)
            chosen.append(best)
            want.append((u, best[1], len(chosen)))
    out = recommend.diversify(df)
    assert out.columns == df.columns and out.schema == df.schema
    assert sorted((r["user_id"], r["business_id"], r["rank"]) for r in out.collect()) == sorted(want)
    dealt = recommend.diversify(df.repartition(4, "user_id"))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert recommend.diversify(df.limit(0)).count() == 0


def test_method_table_makes_its_users_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows_ = [(m, u, float((u * 7 + len(m)) % 11) / 11) for m in ("popularity", "random") for u in range(40)]
    df = spark.createDataFrame(rows_, "method string, user_id int, ndcg_10 double").withColumn("hit_10", F.lit(1.0))
    got = evaluate.method_table(df.mapInArrow(count, df.schema), "popularity", 20, ks=(10,)).collect()
    assert seen.value == len(rows_) and {r["method"]: r["n_users"] for r in got} == {"popularity": 40, "random": 40}


def test_factors_learnt_from_lists_equal_those_of_pairs(spark, monkeypatch):
    """Venues travel by what their factors weigh, not by their number; lists of a user's venues give the same draws and sums."""
    edges = spark.createDataFrame([(u, v) for u in range(30) for v in range(40) if (u * 7 + v * 11) % 5 == 0 or u == 3 and v < 35], "user_id int, business_id int")
    pairs = [{r[0]: r[1] for r in x.collect()} for x in cf.bpr_factors(edges, rank=4, epochs=2, max_broadcast=2)]
    monkeypatch.setattr(cf, "spread_join", lambda *_: pytest.fail("vectors are shuffled"))
    lists = [{r[0]: r[1] for r in x.collect()} for x in cf.bpr_factors(edges, rank=4, epochs=2, max_broadcast=3)]
    for a, b in zip(pairs, lists):
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-12, atol=1e-15) for k in a)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_variants_order_the_lists_of_many_users(spark, monkeypatch, kind):
    """First places by each variant's score, rounded, ties by venue, against sorting one list after another."""
    import random

    monkeypatch.setattr(recommend, "FOLD_USERS", 3)
    rng = random.Random(8)
    rows_ = [(f"u{u}", v, rng.randrange(2), rng.randrange(5) / 4 + rng.choice([0.0, 2e-10]), rng.random()) for u in range(11) for v in rng.sample(range(200), rng.choice([1, 4, 30]))]
    df = spark.createDataFrame(rows_, "user_id string, business_id bigint, rel int, s0 double, s1 double").withColumn("business_id", F.col("business_id").cast(kind))
    lists = df.groupBy("user_id").agg(F.collect_list(F.struct("business_id", "rel", "s0", "s1")).alias("items"))
    got = sorted(map(tuple, recommend._first_places(lists, ["one", "two"], 7, 9).collect()))
    venue = str if kind == "string" else int
    want = []
    for u in {r[0] for r in rows_}:
        mine = [r for r in rows_ if r[0] == u]
        for m, name in ((3, "one"), (4, "two")):
            best = sorted(mine, key=lambda r: (-round(r[m], 9), venue(r[1])))[:7]
            want += [(name, u, i, r[2], sum(x[2] for x in mine)) for i, r in enumerate(best, 1)]
    assert got == sorted(want)
