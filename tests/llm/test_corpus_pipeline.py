"""Every stage of the pipeline against brute force, each on what the one before kept."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from test_llm_operators import ODD, brute_contamination, brute_groups, brute_lines, brute_quality, words


def given(spark, folder):
    rng = random.Random(21)
    rows = [(i, t, None) for i, t in enumerate(ODD)]
    passage, bench = words(rng, 70), words(rng, 30)
    for i in range(100, 150):
        ws = words(rng, 260)
        if i % 4 == 0:
            ws[100:100] = ["\n" + " ".join(passage) + "\n"]
        if i % 7 == 0:
            ws[30:30] = bench
        if i == 149:
            ws = ["again"] * 90
        rows.append((i, " ".join(ws), "en"))
    for i in range(200, 206):
        near = rows[12][1].split(" ")
        near[rng.randrange(len(near))] = f"n{i}"
        rows.append((i, " ".join(near), "en"))
    rows += [(300, rows[13][1], "en"), (13, ODD[4], None), (300, rows[13][1], "en"), (None, " ".join(words(rng, 50)), None)]
    frame = spark.createDataFrame([(d, t, lang, "s", len(t or ""), "clash", 5) for d, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, words bigint")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100, 1, 0), (101, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(bench))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, [(1, " ".join(bench))]


def triples(df):
    return [(r.doc_id, r.text, r.lang) for r in df.collect()]


def test_stages(spark, tmp_path):
    rows, items = given(spark, str(tmp_path))
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert Counter(triples(docs)) == Counter(rows)

    def after(k):
        nonlocal docs
        docs = pipeline.settled(pipeline.STAGES[k][1](spark, docs, str(tmp_path)))
        return triples(docs)

    good = lambda t: (f := brute_quality(t))[0] >= 20 and 100 * f[4] <= 30 * f[0]
    kept = [r for r in rows if good(r[1])]
    assert Counter(after(0)) == Counter(kept) and docs.columns == columns and kept != rows

    cut = brute_lines(kept, 50)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.encode().lower().split()] for i in range(len(w) - 4)}
    whole = {(d, t): grams(t) for d, t, _ in kept if cut[d, t] == t}
    # A copy of an earlier text that stays as it is: the next stage removes it.
    copy = lambda d, t: any(e is not None and d is not None and e < d and 10 * len(grams(t) & g) >= 8 * len(grams(t) | g) for (e, _), g in whole.items())
    lined = [(d, t if copy(d, t) else cut[d, t], lang) for d, t, lang in kept]
    assert Counter(after(1)) == Counter(lined) and docs.columns == columns and lined != kept
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    groups = brute_groups(lined, 5, 80)
    smallest = {c for _, _, c, _ in groups if c is not None}
    single = after(2)
    assert len(single) == len(set(single)) and {d for d, _, _ in single} == smallest | {None} and set(single) <= set(lined)
    assert docs.columns == columns

    clean = [r for r in single if not brute_contamination(r[1], items)[4]]
    assert Counter(after(3)) == Counter(clean) and clean != single and docs.columns == columns

    pieces = pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {d for d, _, _ in clean}
    assert sum(p.length for p in pieces) == sum(max(p.start + p.length for p in pieces if p.doc_id == d) for d, _, _ in clean)


def test_run_and_empty_tables(spark, tmp_path):
    given(spark, str(tmp_path))
    assert pipeline.run(spark, str(tmp_path)).count() > 20
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_line_dedup_spares_only_sure_copies(spark, tmp_path):
    rng = random.Random(4)
    passage, body, head = ("\n".join(" ".join(words(rng, 10, 9000)) for _ in range(n)) for n in (6, 30, 20))
    line = lambda n: " ".join(words(rng, n, 9000))
    texts = {
        1: f"{line(200)}\n{passage}\n{line(200)}",
        2: f"{line(20)}\n{passage}\n{line(20)}",  # 60 % repeated, no near copy
        3: f"{passage}\n{line(9)}\n{passage}",  # nearly all repeated, no near copy
        4: body,
        5: f"{body}\n{line(5)}",  # near copy of an uncut text
        6: f"{head}\n{passage}",
        7: f"{head}\n{passage}\n{line(5)}",  # near copy of a cut text
    }
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in texts.items()], "doc_id bigint, text string, n_chars bigint")
    cut = brute_lines([(d, t, None) for d, t in texts.items()], 50)
    lined = pipeline.settled(pipeline.line_dedup(spark, docs, str(tmp_path)))
    got = {r.doc_id: r.text for r in lined.collect()}
    assert got == {d: t if d == 5 else cut[d, t] for d, t in texts.items()}
    assert {d for d in got if got[d] != texts[d]} == {2, 3, 6, 7}
    left = {r.doc_id for r in pipeline.near_dedup(spark, lined, str(tmp_path)).collect()}
    assert 5 not in left and 4 in left
