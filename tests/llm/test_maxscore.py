"""Exact top-k against a plain search, on odd vectors, ties, repeated rows and many shards."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import maxscore

SCHEMA = "vec_id bigint, embedding array<float>, e string, row bigint, g int, asked string"


def brute(rows, k, every=50):
    fine = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    out = []
    for n, (q, a) in enumerate(fine):
        if q is None or q % every:
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(a, b))), d is None, d or 0) for m, (d, b) in enumerate(fine) if m != n)
        out += [(q, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(scored[:k])]
    return Counter(out)


def vectors(rng, n):
    middles = [[rng.gauss(0, 0.1) for _ in range(16)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.06) for x in middles[i % 8]]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(90)]  # copies, also of a query's vector
    rows += [(50, rows[50][1]), (50, rows[51][1]), (100, rows[100][1]), (None, rows[0][1]), (None, rows[0][1])]
    rows += [(5000, None), (5050, [None] + [0.1] * 15), (5100, [math.nan] * 16), (5150, [math.inf] + [0.0] * 15), (5200, []), (5250, [0.5, -0.25]), (5300, [0.0] * 16)]
    rows += [(5350 + i, [round(rng.uniform(-1, 1)) / 256 for _ in range(16)]) for i in range(0, 200)]  # ties
    return rows


@pytest.mark.parametrize("shard, queries, least, k", [(1 << 17, 1 << 17, 1 << 17, 5), (300, 7, 300, 5), (70, 1000, 70, 3)])
def test_top_k_against_brute_force(spark, shard, queries, least, k):
    rows = vectors(random.Random(shard), 700)
    frame = spark.createDataFrame([(i, v, "e", 1, 2, "a") for i, v in rows], SCHEMA).repartition(5)
    got = maxscore.top_k(maxscore.whole_vectors(frame), F.col("vec_id") % 50 == 0, k, shard, queries, least)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, k)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e7, 1e15])
def test_kinds_of_numbers(spark, scale):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, scale) for _ in range(6)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = maxscore.top_k(maxscore.whole_vectors(frame), F.col("vec_id") % 50 == 0, 5, 100, 2, 100)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = maxscore.top_k(maxscore.whole_vectors(frame), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 256 * 128), (0, 2, 2, 0)]
    assert maxscore.top_k(maxscore.whole_vectors(frame.where("vec_id = 0")), F.col("vec_id") == 0).count() == 0
    assert maxscore.top_k(maxscore.whole_vectors(frame.where("vec_id < 0")), F.col("vec_id") == 0).count() == 0


def test_non_essential_terms_are_looked_up_for_few_pairs():
    rng = np.random.default_rng(3)
    values = rng.normal(0, 32, (8192, 64)).astype(np.int64)
    shard = maxscore.Shard(np.arange(8192), list(range(8192)), values)
    queries = values[:100]
    best = np.sort(queries @ values.T, axis=1)
    search = maxscore.Search(queries, np.arange(100), best[:, -6], shard, 5)
    assert 0 < search.looked < 0.2 * 100 * 8192
    assert (search.scores[:, 0] == [np.delete(queries[i] @ values.T, i).max() for i in range(100)]).all()
