"""Ranked search against a plain ranking, on odd rows, copies, ties and several passes."""

import math
import random
import re
from collections import Counter

import pytest

from footfall.llm import lexical

DOCS = "doc_id bigint, text string, n bigint, bag string, hash string, m string, score int, rank int"
ITEMS = "item_id bigint, text string, item string, place int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=20):
    cut = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(d, Counter(cut(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, length = len(bags), sum(x[2] for x in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for d, b, size in bags:
            m = 75 + (25 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 12 * m)) for w in cut(text))
            scored.append((-score, d is None, d or 0))
        out += [(item_id, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return Counter(out)


def rows():
    rng = random.Random(2)
    word = lambda: f"w{min(int(rng.expovariate(0.05)), 199)}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    # Copies, some in other case or with other marks; one bag in other order; ties between different bags; a very long text.
    for i in range(400, 480):
        docs.append((i, docs[i % 7][1].upper().replace(" ", ", ")))
    docs += [(480 + i, " ".join(rng.sample(docs[3][1].split(), len(docs[3][1].split())))) for i in range(5)]
    docs += [(500, " ".join(word() for _ in range(40_000))), (501, ""), (502, None), (503, "?! ..."), (None, docs[3][1]), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(510, "Été_école x   ÉTÉ été"), (511, "\x85w1\x7fw2")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(90)]
    items += [(3, items[3][1]), (3, "w1 w2"), (None, "w3 W3 w3"), (91, ""), (92, None), (93, "nowhere"), (94, "été ÉTÉ école"), (95, "w5 " * 300)]
    return docs, items


@pytest.mark.parametrize("passes, at_once", [(4 << 20, 64), (300, 8)])
def test_search_against_brute_force(spark, monkeypatch, passes, at_once):
    monkeypatch.setattr(lexical, "PASS_BYTES", passes if passes > 1000 else 4000)
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", at_once)
    docs, items = rows()
    frame = spark.createDataFrame([(*d, 1, "b", "h", "m", 2, 3) for d in docs], DOCS).repartition(6)
    asked = spark.createDataFrame([(*i, "i", 1) for i in items], ITEMS)
    got = Counter(tuple(r) for r in lexical.search(frame, asked).collect())
    assert got == brute(docs, items)


def test_sums_beyond_doubles_stay_exact():
    block = lexical.ItemBlock(0, [[0, 0, 1]], 3)
    import numpy as np

    value = np.array([(1 << 53) + 1, 3], np.int64)
    assert block.scores(np.array([0, 0]), np.array([0, 1]), value, 2).tolist() == [[2 * ((1 << 53) + 1) + 3], [0]]


def test_copies_are_one_class(spark):
    docs = [(i, "alpha beta beta gamma") for i in range(3000)] + [(3000 + i, f"alpha x{i}") for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)
    got = lexical.search(frame, spark.createDataFrame([(1, "beta gamma")], "item_id bigint, text string")).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i + 1, i) for i in range(20)]
    held = lexical.bags(frame, {b"beta": 0, b"gamma": 1})
    assert held.select("bag").distinct().count() == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), asked.where("item_id > 1")).count() == 0
