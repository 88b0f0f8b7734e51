"""Conversation repair against a plain search, on odd rows, ties, repeats and conversations cut into ranges."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from footfall.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, edit string, kind int, ck string"


def brute_edits(rows):
    """Cost and least letters, by a search over rows and states that knows nothing of tables."""
    after = lambda s: "u" if s[-1:] in ("", "s", "a") else "a"
    short = lambda s: (s[:1] if s[:1] == "s" else "", s[-1:]) if s else ("", "")

    @functools.lru_cache(None)
    def best(i, roles, inserted):
        out = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                out.append((0, ""))
        else:
            role, fault = rows[i]
            cut = fault == "truncated"
            todo = [("D", 3, roles)]
            if fault not in ("blank", "duplicate"):
                if re.fullmatch("s?(ua)*u?", roles + role[:1]) and role[:1]:
                    todo.append(("K", cut, roles + role[:1]))
                todo.append(("R", 2 + cut, roles + after(roles)))
            for letter, cost, then in todo:
                if found := best(i + 1, folded(then), 0):
                    out.append((cost + found[0], letter + found[1]))
        if inserted < 3 and (found := best(i, folded(roles + after(roles)), inserted + 1)):
            out.append((2 + found[0], "I" + found[1]))
        return min(out) if out else None

    def folded(roles):
        # Pairs in the middle say nothing about what may follow.
        return re.sub("(ua)+", "ua", roles)

    assert short("") == ("", "")
    return best(0, "", 0)


def brute(rows):
    """The query's rows by conv_id, one conversation after the other."""
    name = lambda x: " " if x is None else str(x)
    kept, ids = defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text, kind = name(role), name(text), zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv in ids:
        held = kept[conv]
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in held:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        cost, audit = brute_edits([(r[1], f) for r, f in zip(held, faults)])
        lines, roles, at = [], "", 0
        for letter in audit:
            if letter != "I":
                _, role, text = held[at]
                at += 1
            if letter == "D":
                continue
            new = role if letter == "K" else "assistant" if roles[-1:] == "u" else "user"
            roles += new[0]
            lines.append(f"{new}:{'' if letter == 'I' else text}")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_tables_give_the_cheapest_and_least_edits():
    rng, table = random.Random(3), repair.Tables()
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["blank", "duplicate", "truncated", None, None])) for _ in range(rng.randrange(12))]
        word = bytes(repair.symbol(*r) for r in rows)
        cost, audit = brute_edits(rows)
        vector, between, _ = table.backward(word)
        assert "".join(table.forward(word)[0]) == audit and between + table.vectors[vector][0] == cost
    assert len(table.vectors) == len(repair.Tables(3).vectors) <= 20


def test_ranges_compose():
    """A word cut anywhere gives the same letters through the functions of its parts."""
    rng, table = random.Random(4), repair.Tables()
    for _ in range(300):
        word = bytes(rng.randrange(9) for _ in range(rng.randrange(1, 60)))
        cut = rng.randrange(len(word))
        vector = table.backward(word[cut:])[0]
        head, state = table.forward(word[:cut], vector, 0, False)
        assert head + table.forward(word[cut:], 0, state)[0] == table.forward(word)[0]


def conversations():
    rng = random.Random(7)
    texts = ["Fine.", "And then", "What? ", "ok!", "", " \t\n", "é ü.", "a:b\nuser:c", "x" * 3000 + ".", "..", None]
    rows = []
    for conv in [None, *range(60)]:
        turns = rng.sample(range(-3, 25), rng.randrange(1, 12)) + [None] * (rng.random() < 0.2)
        rows += [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for t in turns]
    rows += [(100, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}" + "." * (i % 7 > 0)) for i in range(50)]
    rows += [(101, i, "user" if rng.random() < 0.6 else "assistant", rng.choice(["Yes.", "No.", "Well", f"Say {i}."])) for i in range(900)]
    # All of its rows are dropped; rows alike in all columns.
    dropped = next(i for i in range(200, 1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    twice = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:2".encode()) % 20 > 4)
    return rows + [(dropped, 1, "user", "Gone.")] + [(twice, 2, "user", "Same.")] * 40, dropped


@pytest.mark.parametrize("long, size", [(repair.LONG, repair.RANGE_SIZE), (5_000, 9_000), (-1, 3_000)])
def test_repair_against_brute_force(spark, long, size):
    rows, dropped = conversations()
    frame = spark.createDataFrame([(*r, "p", "e", 1, "c") for r in rows], SCHEMA).repartition(5)
    got = repair.digests(repair.repair(repair.damage(frame), long, size), frame).collect()
    want = brute(rows)
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want
    assert want[dropped] == (0,) * 6 + ("", hashlib.sha256().hexdigest())


def test_long_conversations_are_cut_and_rows_of_repair_are_whole(spark):
    rows, _ = conversations()
    frame = spark.createDataFrame([(*r, "p", "e", 1, "c") for r in rows], SCHEMA)
    made = repair.repair(frame, 5_000, 9_000).where("conv_id = 101").collect()
    assert len({r["part"] for r in made}) > 3
    assert sum(r["copies"] for r in made if r["edit"] != "I") == 900
    roles = "".join(r["role"][0] for r in sorted(made, key=lambda r: (r["part"], r["place"])) if r["role"])
    assert re.fullmatch("(ua)+", roles)


def test_no_conversations(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert repair.digests(repair.repair(repair.damage(frame)), frame).count() == 0
