"""The training-data operators against brute force, on odd rows: nulls, empty and very long texts, ties, repeats, clashing columns."""

import gzip
import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import chains, chat, decontaminate, lines, neardup, packing, quality, shared, simple8b, urls, warc
from footfall.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, node string, start string, piece string, words string, comp string, line string"
ODD = [None, "", " ", "\n\n", "word", "two words", "Ünï ÉTÉ straße don't\t _x_  12ab x² ½ ", "a  b \n c\r\n", "<|endoftext|> ok", "é" * 30, "x" * 5000]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", None, "k", "n", "s", "p", "w", "c", "l") for d, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Odd rows, repeated rows, copies, near copies, a shared passage, repeated lines, a very long text."""
    rng = random.Random(5)
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)]
    rows += [(None, "no id here " * 9, None), (None, None, "en"), (7, ODD[7], "en"), (7, ODD[7], "en")]
    base = words(rng, 300)
    for i in range(100, 112):
        near = list(base)
        for _ in range(i - 100):
            near[rng.randrange(len(near))] = f"z{rng.randrange(99)}"
        rows.append((i, " ".join(near), "en"))
    passage = words(rng, 60)
    for i in range(200, 230):
        body = words(rng, 80)
        if i % 3 == 0:
            body[40:40] = passage
        if i % 5 == 0:
            body[10:10] = ["\n" + " ".join(passage[:55]) + "\n"]
        rows.append((i, " ".join(body), "de"))
    rows.append((300, " ".join(words(rng, 30_000, 5000)), "fr"))
    return rows


def collected(df):
    return [r.asDict() for r in df.collect()]


PLAIN = {}


def plain_ids(path, text, end_id):
    """Ids by the library as it is, freshly loaded."""
    from tokenizers import Tokenizer

    if path not in PLAIN:
        PLAIN[path] = Tokenizer.from_file(path)
    return np.array([*PLAIN[path].encode(text or "", add_special_tokens=False).ids, end_id], "<u4")


def test_encoder_equals_the_library(corpus):
    for path, spaces in ((WORD_BPE, "dropped"), (BYTE_BPE, "kept")):
        encoder = Encoder(path, spaces)
        texts = [t for _, t, _ in corpus] + ["foo\tbar \n baz", "don't CAN'T 'tis", "end ", " start", "日本 語。", "Σας İI ǆ e\u0301x", "a\x1cb"]
        want = [plain_ids(path, t, 9).tobytes() for t in texts]
        assert encoder.ids(texts, 9) == want
        assert encoder.ids(texts, 9) == want


@pytest.mark.parametrize("path, spaces", [(WORD_BPE, "dropped"), (BYTE_BPE, "kept")])
def test_encoder_equals_the_library_on_random_texts(path, spaces):
    rng = random.Random(11)
    some = ["a", "Word", "ß", "é", "e\u0301", "\u0345", "İ", "Σ", "ǆ", "日本", "x1", "½", "_", ".", "!?", "'s", "'", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\r", "\x0b", "\x85", "\xa0", "\u3000", "\u2028", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "😀"]
    texts = ["".join(rng.choices(some, k=rng.randrange(1, 9))) for _ in range(20_000)] + ["a\n", "h\n ß", "a.\n", "\n", "a\n\n", " \n"]
    encoder = Encoder(path, spaces)
    got = encoder.ids(texts, 9)
    assert [t for t, g in zip(texts, got) if g != plain_ids(path, t, 9).tobytes()] == []


@pytest.mark.parametrize("path, spaces", [(WORD_BPE, "dropped"), (BYTE_BPE, "kept")])
def test_the_encoder_holds_bounded_bytes_and_keeps_what_comes_again(path, spaces):
    rng = random.Random(12)
    often = "The usual words, again."
    texts = [f"{often} {' '.join(''.join(rng.choices('abcdefghij', k=8)) + rng.choice(['', '.', '1']) for _ in range(40))} {'z' * 5000}{i}" for i in range(300)]
    encoder, most, learnt = Encoder(path, spaces, remembered=200_000), 0, []
    word = encoder._word
    encoder._word = lambda w, blank: learnt.append(w) or word(w, blank)
    for text in texts:
        assert encoder.ids([text], 9) == [plain_ids(path, text, 9).tobytes()]
        halves = {id(h): h for m in (encoder.first, encoder.later) for h in (m.now, m.before)}.values()
        most = max(most, sum(sys.getsizeof(k) + sys.getsizeof(v) for h in halves for k, v in h.items()))
    # Two halves for each of two places of a word, and the last text of each half.
    assert most < 900_000
    assert learnt.count("usual") == 1


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    rows = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words "), 2000), F.col("id").cast("string")).alias("text"))
    usual = spark.conf.get(shared.BATCH_BYTES)
    settled, seen = shared.settled, []
    monkeypatch.setattr(shared, "settled", lambda df: seen.append(spark.conf.get(shared.BATCH_BYTES)) or settled(df))
    monkeypatch.setattr(neardup, "settled", shared.settled)
    monkeypatch.setattr(quality, "settled", shared.settled)
    assert packing.pack_documents(rows.limit(3), BYTE_BPE).count() > 0 and shared.TEXT_BATCH in seen
    seen.clear()
    signed = neardup.near_duplicates(rows.limit(3), 5, 80)
    assert signed.count() == 3 and seen.count(shared.TEXT_BATCH) == 2
    seen.clear()
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.judge(rows.limit(3).withColumn("lang", F.lit("en")), labels).count() == 3 and seen.count(shared.TEXT_BATCH) == 1
    assert spark.conf.get(shared.BATCH_BYTES) == usual

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    with shared.text_batches(spark):
        held = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert len(held) > 1 and max(held) < 5_000_000


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**31, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 239, 1024, 1025, 7000])
def test_simple8b_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    ids[n // 3 : n // 2] = 0
    coded, first, escapes = simple8b.pack(ids)
    assert (simple8b.unpack(coded, escapes) == ids).all()
    for b in range(len(first) - 1):
        part = simple8b.unpack(coded[int(first[b]) : int(first[b + 1])], escapes)
        assert (part == ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_token_files(spark, corpus):
    files = simple8b.write_token_files(frame(spark, corpus), WORD_BPE, 1, file_ids=5000)
    got = collected(simple8b.read_token_files(files))
    assert files.count() > 3 and len(got) == len(corpus)
    ids = lambda t: plain_ids(WORD_BPE, t, 1)
    want = Counter((d, len(ids(t)), zlib.crc32(ids(t))) for d, t, _ in corpus)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    row = next(r for r in got if r["doc_id"] == 300)
    text = next(t for d, t, _ in corpus if d == 300)
    f = simple8b.TokenFile(row["uri"])
    assert (f.ids(row["file_start"] + 1500, row["file_start"] + 1700) == ids(text)[1500:1700]).all()
    assert simple8b.read_token_files(simple8b.write_token_files(frame(spark, []), WORD_BPE, 1)).count() == 0


def test_best_fit_closes_the_fullest_and_picks_the_tightest():
    fit = packing.BestFit(10, bins=2)
    assert [fit.put(n) for n in (6, 7, 3, 8, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    fit = packing.BestFit(10, bins=2)
    assert [fit.put(n)[0] for n in (6, 7, 8, 4, 2)] == [0, 1, 2, 0, 2]


def test_packing(spark, corpus):
    got = collected(packing.pack_documents(frame(spark, corpus), BYTE_BPE, 2, 256))
    want = Counter()
    for d, t, _ in corpus:
        ids = plain_ids(BYTE_BPE, t, 2)
        first = (len(ids) - 1) % 256 + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 256)], [*range(first, len(ids) + 1, 256)])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(parts[-1]) <= 256
    assert len(used) <= 1.02 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack_documents(frame(spark, []), BYTE_BPE).count() == 0


def test_packers_share_no_sequence(spark):
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), (F.col("id") % 90 + 1).alias("length"), F.col("id").alias("ids_crc32"))
    got = collected(packing.place_pieces(pieces, 100, bins=8, per_packer=500))
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert len(got) == 3000 and max(used.values()) <= 100 and len({s >> 40 for s in used}) == 6


def brute_lines(rows, least):
    """Text after deletion by (doc_id, text)."""
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    docs = sorted({(d, t) for d, t, _ in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    seen, out = {}, {}
    for d, t in docs:
        body = t.split("\n")
        held = [bare(x) for x in body if bare(x)]
        at = [i for i, x in enumerate(body) if bare(x)]
        gone = set()
        for s in range(len(at)):
            n, e = 0, s
            while e < len(at) and n < least:
                n, e = n + len(body[at[e]].encode().split()), e + 1
            if n >= least:
                key = tuple(bare(body[i]) for i in at[s:e])
                if key in seen:
                    source, first = seen[key]
                    up = down = 0
                    while up < least - 1 and held[e + up : e + up + 1] == source[first + e - s + up : first + e - s + up + 1] != []:
                        up += 1
                    while down < least - 1 and min(s, first) > down and held[s - down - 1] == source[first - down - 1]:
                        down += 1
                    gone.update(range(at[s - down], at[e - 1 + up] + 1))
                seen.setdefault(key, (held, s))
        out[d, t] = "\n".join(x for i, x in enumerate(body) if i not in gone)
    return out


def test_line_dedup(spark, corpus):
    rng = random.Random(2)
    pool = [" ".join(words(rng, rng.randrange(1, 9))) for _ in range(12)]
    rows = corpus + [(400 + i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(1, 40))), "en") for i in range(60)]
    rows += [(500, "\n".join(["same line again"] * 40), "en"), (None, rows[-1][1], None)]
    for least in (12, 50):
        got = collected(lines.dedup_lines(frame(spark, rows), run_words=least))
        want = brute_lines(rows, least)
        assert len(got) == len(rows)
        assert any(r["n_removed"] for r in got)
        expected = Counter((d, want.get((d, t))) for d, t, _ in rows)
        assert Counter((r["doc_id"], r["text"]) for r in got) == expected
    left = collected(lines.dedup_lines(frame(spark, rows), run_words=12, spared=lambda runs: runs.select("doc.k1", "doc.k2").distinct()))
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter((d, t) for d, t, _ in rows)
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_runs_grow_to_the_first_other_line(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(words(rng, n, 9000))
    run = "\n".join([line(61), line(8), "", *[line(8) for _ in range(4)]])
    docs = frame(spark, [(1, f"{line(9)}\n{run}\n{line(70)}", "en"), (2, f"{line(30)}\n{run}\nend", "en"), (3, run, "en"), (4, f"{run}\n \n{run}\nlast", "en")])
    got = {r["doc_id"]: r["text"] for r in collected(lines.dedup_lines(docs))}
    texts = {r["doc_id"]: r["text"] for r in collected(docs)}
    assert got == {1: texts[1], 2: texts[2].replace(run + "\n", ""), 3: "", 4: " \nlast"}


def pages_of(spark, rows):
    return spark.createDataFrame([(p, u, h, "k", "x") for p, u, h in rows], "page_id bigint, url string, html string, key string, digest string")


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rng = random.Random(3)
    bodies = ["<p>" + "é" * 60 + "</p>", "y" * 99, "z" * 100, "", None, "long " * 30_000]
    rows = [(i, rng.choice(["http://a.example/x?y=1 2", "https://B.example/\r\nEvil: 1", "no scheme", None, "http://www.c.example.org/é"]), rng.choice(bodies)) for i in range(80)]
    rows += [(None, "http://a.example/", "z" * 100), (None, None, None), (-5, None, "q" * 200), (7, "http://tie", "tie" * 50), (7, "http://tie", "tie" * 50)]
    got = collected(warc.archive_and_read(pages_of(spark, rows)))
    data = lambda h: (h or "").encode()
    first = {}
    for p, _, h in rows:
        if len(data(h)) >= 100 and p is not None:
            first[data(h)] = min(first.get(data(h), p), p)
    want = Counter()
    for p, _, h in rows:
        f = first.get(data(h))
        to = f if f is not None and p != f else None
        want[p, len(data(h)), hashlib.sha256(data(h)).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.archive_and_read(pages_of(spark, [])).count() == 0


def test_warc_archives_are_plain_gzip_members(spark):
    captures = collected(warc.write_archives(pages_of(spark, [(1, "http://a.b/c", "x" * 300), (2, "http://a.b/d", "x" * 300)])))
    store, path = shared.open_store(captures[0]["uri"])
    with store.open_input_file(path) as f:
        text = gzip.decompress(f.read()).decode()
    assert text.count("WARC/1.1\r\n") >= 1 and "WARC-Payload-Digest: sha256:" in text
    index = warc.write_index(shared.settled(spark.createDataFrame([tuple(c.values()) for c in captures], "key string, uri string, offset bigint, length bigint")))
    wanted = spark.createDataFrame([("b,a)/c " + "1".rjust(20, "0"),), ("nothing",)], "key string")
    assert [r["key"] for r in collected(warc.look_up(index, wanted))] == ["b,a)/c " + "1".rjust(20, "0")]


def test_chat_snapshots(spark):
    rng = random.Random(4)
    logs = [[(rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", None, "", "long " * 2000])) for _ in range(rng.randrange(1, 9))] for _ in range(25)]
    logs += [log[: rng.randrange(1, len(log) + 1)] for log in logs] + [[("user", "same")] * 4, [("user", "same")] * 3, logs[0]]
    rows = [(c, i * 2, role, text) for c, log in enumerate(logs) for i, (role, text) in enumerate(log)]
    rows += rows[:3] + [(None, 1, "user", "alone"), (None, 1, "user", "alone"), (None, 1, "user", "same"), (90, None, "user", "x"), (90, 5, "user", "b"), (90, 5, "user", "a")]
    turns = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, position string, start bigint")
    got = defaultdict(list)
    for r in sorted(collected(chat.format_chats(turns)), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["rendered"] if r["conv_id"] is None else "", r["position"])):
        got[r["conv_id"]].append(r)
    none = lambda x: (x is not None, x if x is not None else 0)
    convs = defaultdict(set)
    for k, (c, turn, role, text) in enumerate(set(rows)):
        convs[("n", k) if c is None else ("c", c)].add((c, turn, role, text))
    convs = {k: sorted(v, key=lambda r: (none(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))) for k, v in convs.items()}
    content = {k: [(r[2], r[3]) for r in v] for k, v in convs.items()}
    kept = set()
    for k, log in content.items():
        longer = any(len(o) > len(log) and o[: len(log)] == log for o in content.values())
        equal = [j for j, o in content.items() if o == log]
        if not longer and k == min(equal, key=lambda j: (convs[j][0][0] is None, convs[j][0][0] or 0)):
            kept.add(k)
    assert {c for c in got if c is not None} == {convs[k][0][0] for k in kept if convs[k][0][0] is not None}
    assert len(got[None]) == sum(1 for k in kept if convs[k][0][0] is None)
    for k in kept:
        c = convs[k][0][0]
        if c is not None:
            text = "".join(f"<|im_start|>{role or 'unknown'}\n{body or ''}<|im_end|>\n" for role, body in content[k])
            assert "".join(r["rendered"] for r in got[c]) == text
            assert [r["start"] for r in got[c]] == [0, *np.cumsum([r["n_chars"] for r in got[c]])[:-1].tolist()]
    assert chat.format_chats(turns.where("false")).count() == 0


def brute_contamination(text, items, window=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = cut(text), set(), set()
    for item, body in items:
        iw = cut(body)
        n = min(len(iw), window)
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        at = [i for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in grams] if n else []
        hit.update(j for i in at for j in range(i, i + n))
        if at and item is not None:
            found.add(str(item))
    ids = ",".join(sorted(found))
    return len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("small", [True, False])
def test_contamination(spark, corpus, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    rng = random.Random(6)
    passage = next(t for d, t, _ in corpus if d == 201).split()
    items = [(1, " ".join(passage[10:35])), (2, "W399, w17! w3"), (3, "É"), (4, ""), (5, None), (None, " ".join(passage[20:34])), (10, " ".join(words(rng, 8))), (11, "two  WORDS"), (1, " ".join(passage[10:35])), (12, "word"), (13, "w1 w2 w3 w4 w5 w6"), (14, "x" * 5000)]
    docs = corpus + [(600, "pre " + items[6][1].upper() + " post", "en"), (601, " ".join(passage[:22]) + " " + " ".join(words(rng, 600)), "en"), (602, ("word É. " * 50), "en"), (603, "w1 w2 w3 w4 w5 w6 " * 9, "en")]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id bigint, text string, words string")
    got = collected(decontaminate.contamination(frame(spark, docs), bench))
    want = Counter((d, *brute_contamination(t, items)) for d, t, _ in docs)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want
    clean = collected(decontaminate.contamination(frame(spark, docs), bench.where("false")))
    assert len(clean) == len(docs) and not any(r["n_hit"] for r in clean)
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def brute_groups(rows, k, percent):
    sets = []
    for _, t, _ in rows:
        ws = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    out = Counter()
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        smallest = min(ids) if ids else None
        out[d, len(sets[i]), smallest, d == smallest if smallest is not None else True] += 1
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, monkeypatch, k, percent):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "FIRST_PARTNERS", 1)
    rng = random.Random(9)
    rows = list(corpus)
    base = words(rng, 120)
    # A chain: each differs from the one before, the ends are far apart.
    for i in range(40):
        base[rng.randrange(120)] = f"c{i}"
        rows.append((700 + (i * 7) % 40, " ".join(base), "en"))
    rows += [(None, " ".join(base), "en"), (710, rows[-1][1], "en")]
    got = collected(neardup.near_duplicates(frame(spark, rows), k, percent))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_groups(rows, k, percent)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_odd_sketches_tell_similarities(spark):
    rng = np.random.default_rng(1)
    factors = rng.integers(0, 1 << 63, 140, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    most = neardup.most_differing_bits(85, 140)
    far = 0
    for i in range(200):
        common = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        share = (0.9, 0.3)[i % 2]
        own = int(400 * (1 / share - 1) / 2)
        sketches = [neardup.odd_sketch(neardup.min_hashes(np.concatenate([common, rng.integers(0, 1 << 63, own, dtype=np.uint64)]), factors)) for _ in range(2)]
        differ = int(np.bitwise_count((sketches[0] ^ sketches[1]).view(np.uint64)).sum())
        if i % 2 == 0:
            assert differ <= most
        else:
            far += differ > most
    assert far >= 95


def test_url_rules_and_lists(spark, monkeypatch):
    rows = [(1, "http://WWW.Example.com/en/a"), (2, "http://x.example.com/en/a"), (3, "http://example.com?x"), (4, "https://a.net/es/"), (5, "http://bad.org/p/?utm_source=z&b=2&a=1#f"), (6, "http://www.bad.org/p?a=1&b=2"), (7, "bad.org/p"), (8, None), (9, ""), (10, "x://://y"), (5, "http://bad.org/p/?utm_source=z&b=2&a=1#f"), (None, "http://ok.org/" + "y" * 9000), (11, "http://notexample.com/en/"), (12, "http://net/fr/x")]
    pages = spark.createDataFrame([(*r, "clash", "clash", True) for r in rows], "page_id bigint, url string, key string, host string, listed boolean")
    bad = spark.createDataFrame([("https://bad.org/p?b=2&a=1",), ("https://bad.org/p?b=2&a=1",), (None,), ("nohost",), *[(f"http://l{i}.org/",) for i in range(300)]], "url string")
    rules = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
    for limit in (1 << 20, 0):
        monkeypatch.setattr(urls, "BROADCAST_BYTES", limit)
        got = collected(urls.judge(pages, bad, rules))
        assert len(got) == len(rows)
        by = {r["page_id"]: (r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in got}
        assert by == {
            1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("x.example.com", "/en/a", "example.com/en/", "block"), 3: ("example.com", "", None, "allow"),
            4: ("a.net", "/es/", "net/es/", "block"), 5: ("bad.org", "/p/", None, "block"), 6: ("www.bad.org", "/p", None, "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
            9: ("", "", None, "allow"), 10: (":", "//y", None, "allow"), None: ("ok.org", "/yyyyyyyy", None, "allow"), 11: ("notexample.com", "/en/", "com/", "allow"), 12: ("net", "/fr/x", "net/fr/", "block"),
        }
    assert all(r["verdict"] == "allow" for r in collected(urls.judge(pages, bad.where("false"), ())))
    assert urls.judge(pages.where("false"), bad, rules).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = urls.blocked_bloom(keys, 50)
    assert urls.maybe_listed(keys, bloom, 50).count() == 2000
    others = spark.range(5000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert urls.maybe_listed(others, bloom, 50).count() < 250


def brute_quality(text):
    ws = (text or "").encode().split()
    words_ = [w.decode() for w in ws]
    at = defaultdict(list)
    for i in range(len(ws) - 7):
        at[tuple(ws[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dups += line in seen
            seen.add(line)
    return len(ws), sum(map(len, words_)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_quality_features(spark, corpus):
    rng = random.Random(8)
    rows = corpus + [(800 + i, " ".join(rng.choice(["a", "b", "c#", "é|"]) + rng.choice([" ", "\n", "\t"]) for _ in range(rng.randrange(1, 120))), "en") for i in range(40)]
    rows += [(900, "same line\n" * 30, "en"), (901, "<&>%$ " * 40, None)]
    labels = spark.createDataFrame([(100, 1, 0, "x"), (100, 0, 0, "x"), (None, 1, 0, "x"), (101, None, 1, "x"), (102, 1, None, "x"), (5555, 0, 1, "x")], "doc_id bigint, quality int, toxic int, text string")
    for given in (labels, labels.where("false")):
        got = collected(quality.judge(frame(spark, rows), given))
        want = Counter((d, *(f := brute_quality(t)), f[0] < 20 or 100 * f[4] > 30 * f[0]) for d, t, _ in rows)
        assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == want
        # Too few labels for any cutoff: only the base rules reject.
        assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.judge(frame(spark, []), labels).count() == 0


def test_binomial_tests_limit_false_rejection():
    exact = lambda k, n, p: sum(__import__("math").comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in ((0, 50, 0.05), (3, 80, 0.1), (20, 400, 0.05)):
        assert quality.binomial_cdf(k, n, p) == pytest.approx(exact(k, n, p), rel=1e-9)
    assert quality.accepted([(0, 5), (0, 90), (1, 95), (60, 100)], 2000, 100, 0.01, 0.001) == 2
    assert quality.accepted([(0, 5)], 100, 100, 0.01, 0.001) is None
    assert quality.accepted([(0, 0)], 0, 0, 0.01, 0.001) is None
    rng = np.random.default_rng(0)
    broken = 0
    for _ in range(300):
        scores = np.sort(rng.random(800))
        rejects = [(int((scores > c).sum()), int((scores > c).sum())) for c in np.linspace(1, 0.8, 21)]
        place = quality.accepted(rejects, 800, 1, 0.05, 0.05, caution=0)
        broken += place is not None and 1 - np.linspace(1, 0.8, 21)[place] > 0.05
    assert broken <= 300 * 0.05 + 12


def test_one_path_of_cutoffs_for_all_rules():
    cuts = {"a": [(0, 0), (0, 4), (0, 9), (0, 9), (1, 12), (7, 20)], "b": [(0, 1), (0, 2), (3, 2)]}
    path = quality.cutoff_path(cuts, 2)
    assert path == [(0, -1), (1, -1), (2, -1), (4, -1)]
    assert quality.cutoff_path({"a": []}, 2) == []


def test_small_strata_get_cutoffs(spark):
    """Of several hundred labels in each of four languages, toxic words in any script are found and wanted documents stay."""
    rng = random.Random(6)
    rows, labels = [], []
    marks = {"en": "nastyword", "de": "größtübel", "ru": "гадость", "rare": "vileness"}
    for lang, n in (("en", 900), ("de", 420), ("ru", 420), ("rare", 60)):
        for _ in range(n):
            i = len(rows)
            ws = words(rng, 40, 3000)
            if i % 9 == 0:
                ws[rng.randrange(40)] = marks[lang]
            rows.append((i, " ".join(ws), lang))
            labels.append((i, 1, int(i % 9 == 0)))
    # Two texts of a labelled doc_id: the choice doesn't hang on the order of rows.
    rows += [(5, " ".join(words(rng, 40, 3000)), "en")]
    tags = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = collected(quality.judge(frame(spark, rows), tags))
    again = collected(quality.judge(frame(spark, rows[::-1]).repartition(3), tags))
    verdicts = lambda got: Counter((r["doc_id"], r["n_words"], r["kept"]) for r in got)
    assert verdicts(got) == verdicts(again)
    kept = {r["doc_id"]: r["kept"] for r in got}
    lang = {d: x for d, _, x in rows}
    for d in kept:
        # Too few labels of the rare language: it rejects nothing.
        assert kept[d] == (d % 9 != 0 or lang[d] == "rare")


def test_quality_learns_cutoffs(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(4000):
        bad, toxic = i % 5 == 0, i % 11 == 0
        ws = words(rng, 40, 3000)
        if bad:
            ws = [w + "%%%" for w in ws]
        if toxic:
            ws[rng.randrange(40)] = "nastyword"
        rows.append((i, " ".join(ws), "en"))
        labels.append((i, int(not bad), int(toxic)))
    got = {r["doc_id"]: r["kept"] for r in collected(quality.judge(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))}
    assert not any(got[i] for i in range(4000) if i % 5 == 0)
    assert not any(got[i] for i in range(4000) if i % 11 == 0)
    assert all(got[i] for i in range(4000) if i % 5 and i % 11)


def test_chains_take_the_best_in_order():
    assert chains.best_chains([0, 20, 40], [100, 120, 141], [10, 10, 10]) == [[0, 1, 2]]
    assert sorted(chains.best_chains([0, 20], [100, 50], [10, 10])) == [[0], [1]]
    assert sorted(map(sorted, chains.best_chains([0, 200], [0, 200], [10, 10]))) == [[0], [1]]


@pytest.mark.parametrize("seed", range(8))
def test_chain_scores_against_all_predecessors(seed):
    rng = random.Random(seed)
    runs = sorted((rng.randrange(150), rng.randrange(150), rng.randrange(3, 12)) for _ in range(25))
    pos, rpos, size = map(list, zip(*runs))
    score = [0.0] * 25
    for j in range(25):
        score[j] = size[j]
        for i in range(25):
            a, b = pos[j] - pos[i] - size[i], rpos[j] - rpos[i] - size[i]
            if 0 <= a <= chains.LARGEST_GAP * 9 and 0 <= b:
                score[j] = max(score[j], size[j] + score[i] - chains.GAP_COST * (a + b))
    value = lambda c: sum(size[i] for i in c) - chains.GAP_COST * sum(pos[b] - pos[a] - size[a] + rpos[b] - rpos[a] - size[a] for a, b in zip(c, c[1:]))
    found = chains.best_chains(pos, rpos, size)
    assert sorted(i for c in found for i in c) == list(range(25))
    assert max(map(value, found)) == pytest.approx(max(score))


def test_a_long_run_out_of_reach_hides_no_near_predecessor():
    starts = [0, 560, 575, 590]
    assert sorted(chains.best_chains(starts, starts, [500, 6, 6, 6])) == [[0], [1, 2, 3]]


def test_fuzzy_passages(spark, corpus):
    rng = random.Random(11)
    passage = words(rng, 90, 5000)
    rows, edited = list(corpus), {}
    for i in range(1000, 1030):
        copy = list(passage)
        for _ in range(4):
            j = rng.randrange(len(copy))
            copy[j : j + 1] = rng.choice([[], ["new"], ["two", "new"]])
        body = [f"u{i}x{j}" for j in range(150)]
        body[60:60] = copy
        edited[i] = len(copy)
        rows.append((i, " ".join(body), "en"))
    rows += [(2000, " ".join(passage).upper(), "en"), (2000, " ".join(passage).upper(), "en"), (None, " ".join(passage), "en")]
    got = collected(chains.fuzzy_passages(frame(spark, rows)))
    by = defaultdict(list)
    for r in got:
        assert r["source_doc_id"] < r["doc_id"]
        by[r["doc_id"]].append(r)
    for i in range(1001, 1030):
        covered = {p for r in by[i] for p in range(r["start"], r["start"] + r["words"])} & set(range(60, 60 + edited[i]))
        assert len(covered) >= 0.8 * edited[i]
        assert all(r["start"] >= 56 and r["start"] + r["words"] <= 64 + edited[i] for r in by[i])
    assert by[2000] and not by[1000]
    assert {d for d in by if by[d]} <= set(range(101, 112)) | set(range(200, 230)) | set(range(1001, 1030)) | {2000}
    for r in (r for r in got if r["doc_id"] == 111):
        assert r["source_doc_id"] < 111
    assert chains.fuzzy_passages(frame(spark, [])).count() == 0


def test_passages_repeated_within_a_document(spark):
    fresh = iter(range(10_000))
    line = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    passage = line(120)
    text = " ".join([*line(90), *passage, *line(90), *passage, *line(90), *passage, *line(90)])
    got = collected(chains.fuzzy_passages(frame(spark, [(5, text, "en"), (6, " ".join(line(300)), "en"), (5, " ".join(line(90)), "en")])))
    rows = {(r["doc_id"], r["start"], r["words"], r["source_doc_id"], r["source_start"]) for r in got}
    assert {(5, 300, 120, 5, 90), (5, 510, 120, 5, 90)} <= rows
    # Seeds over the ends of the first copy can differ, so parts of a later copy may also meet the second one; nothing else is found.
    assert all(d == s == 5 and at % 210 - 90 == rat % 210 - 90 >= 0 and at % 210 + n <= 210 and rat < at for d, at, n, s, rat in rows)
    same = collected(chains.fuzzy_passages(frame(spark, [(5, text, "en"), (5, text, "en"), (None, text, "en")])))
    assert len(same) == len(got)


def test_passages_at_the_floor_keep_a_seed():
    rng, kept = random.Random(1), 0
    for _ in range(400):
        a, b = (np.array([rng.getrandbits(64) for _ in range(140)], np.uint64) for _ in range(2))
        b[50:90] = a[50:90]
        for j in rng.sample(range(50, 90), 8):
            b[j] = rng.getrandbits(64)
        kept += bool(set(chains.minimizers(a)[0]) & set(chains.minimizers(b)[0]))
    assert kept >= 0.95 * 400


def test_one_seed_is_enough(spark):
    fresh = iter(range(100_000))
    line = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    rows = []
    for i in range(60):
        passage = line(48)
        copy = list(passage)
        for j in (4, 9, 14, 19, 28, 33, 38, 43):  # equal stretches of 4 words and one of 8
            copy[j] = line(1)[0]
        rows += [(2 * i, " ".join([*line(60), *passage, *line(60)]), "en"), (2 * i + 1, " ".join([*line(60), *copy, *line(60)]), "en")]
    got = collected(chains.fuzzy_passages(frame(spark, rows)))
    assert all((r["start"], r["words"], r["source_doc_id"], r["differing"]) == (60, 48, r["doc_id"] - 1, 8) for r in got)
    assert len(got) >= 40


def test_seeds_are_shuffled_once(spark):
    """A seed's first place is carried over batches and rows alike count once; nothing but the seeds themselves is shuffled."""
    import random

    from footfall.llm import chains as ch

    draw = random.Random(3)
    data = [(draw.randrange(12), draw.randrange(40), draw.randrange(6)) for _ in range(3000)]
    found = spark.createDataFrame(data, "seed long, doc_id long, place long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = ch.first_places(found)
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    first = {}
    for s, d, p in sorted(data):
        first.setdefault(s, (d, p))
    assert got == sorted((d, p, *first[s]) for s, d, p in set(data) if (d, p) != first[s])
    assert ch.first_places(found)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_pages_travel_once_for_the_chains_of_a_part(spark):
    """A text that repeats a line has a chain per repeat; their pages overlap and are named once."""
    line = [f"u{i}" for i in range(11)]
    texts = chains._texts(frame(spark, [(1, " ".join(line * 300), "en")]))
    met = chains.first_places(chains.seeds(texts, chains.GRAM, chains.STRETCH)).where("place > source_place")
    found = collected(chains.chain_anchors(met, chains.GRAM))
    n_pages = -(-len(line) * 300 // chains.PAGE)
    assert len(found) >= 299 and sum(len(r["pages"] or []) for r in found) <= n_pages + 2
    assert not any(r["source_pages"] for r in found)
    got = collected(chains.fuzzy_passages(frame(spark, [(1, " ".join(line * 300), "en")])))
    # The last three repeats have less than 40 words left, and none before the first.
    assert len(got) >= 296 and all(r["differing"] == 0 for r in got)


def test_reach_does_not_hang_on_the_hash_of_a_text(spark):
    """Passages whose one seed is at their end: words before it count from the same reach, whatever the text's hash."""
    fresh = iter(range(100_000))
    line = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    rows = []
    for i in range(40):
        passage = line(66)
        copy = list(passage)
        for j in range(4, 56, 5):  # equal stretches of 4 words before the last ten
            copy[j] = line(1)[0]
        rows += [(2 * i, " ".join([*line(200), *passage, *line(60)]), "en"), (2 * i + 1, " ".join([*line(200), *copy, *line(60)]), "en")]
    got = collected(chains.fuzzy_passages(frame(spark, rows)))
    assert {(r["doc_id"], r["start"], r["words"], r["differing"]) for r in got} == {(2 * i + 1, 200, 66, 11) for i in range(40)}


@pytest.mark.parametrize("step", [1, -1])
def test_plain_extensions_equal_extend(step):
    """Extensions that stop at the first difference, all at once, against one at a time."""
    rng, stopped = np.random.default_rng(4), 0
    pairs = []
    for _ in range(400):
        a, b = (rng.integers(0, 4, n).astype("<u4") for n in rng.integers(1, 130, 2))
        same = min(len(a), len(b), int(rng.integers(0, 130)))
        b[:same] = a[:same]
        pairs.append((a, b))
    flat = [x[::step] for pair in pairs for x in pair]
    ends = np.cumsum([len(x) for x in flat])
    at = np.r_[0, ends[:-1]] if step == 1 else ends - 1
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    words = np.concatenate(flat)
    run = chains.equal_run(words, at[::2], at[1::2], np.minimum(n, m), step)
    on = chains.goes_on(words, at[::2] + step * run, at[1::2] + step * run, n - run, m - run, step)
    for (a, b), r, goes in zip(pairs, run.tolist(), on.tolist()):
        assert (a[:r] == b[:r]).all() and (r == min(len(a), len(b)) or a[r] != b[r])
        if r < min(len(a), len(b)):
            assert goes == any(len(a[r + i : r + i + 3]) == len(b[r + j : r + j + 3]) == 3 and (a[r + i : r + i + 3] == b[r + j : r + j + 3]).all() for _, i, j in chains._STEPS)
        if not goes or r == min(len(a), len(b)):
            stopped += 1
            assert chains.extend(a, b) == (r, r, 0)
    assert stopped > 50 and on.any()


def test_only_what_is_needed_travels_for_near_duplicates(spark, monkeypatch):
    """Keys that the filter rules out are not shuffled, and buckets that gave all their pairs don't come again."""
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 60, 10**6)), "en") for i in range(300)]
    base = words(rng, 200)
    for i in range(1000, 1060):
        near = list(base)
        for j in rng.sample(range(200), rng.randrange(2, 5)):
            near[j] = f"z{i}x{j}"
        rows.append((i, " ".join(near), "en"))
    monkeypatch.setattr(neardup, "FIRST_PARTNERS", 1)
    settled, meet, sizes, given = neardup.settled, neardup.other_components, [], []
    monkeypatch.setattr(neardup, "settled", lambda df: sizes.append((df.columns, (out := settled(df)).count())) or out)
    monkeypatch.setattr(neardup, "other_components", lambda members, *rest: given.append(members.count()) or meet(members, *rest))
    got = collected(neardup.near_duplicates(frame(spark, rows), 3, 85))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_groups(rows, 3, 85)
    candidates = next(n for columns, n in sizes if columns == ["node", "key"])
    assert candidates < 0.5 * neardup.bands_for(85) * len(rows)
    assert len(given) > 1 and given[-1] < given[0]


def test_a_passage_whose_parts_stand_in_other_documents_is_found(spark):
    """Halves in two documents, the whole in a third and a fourth: the third is the first that has it in one piece."""
    fresh = iter(range(100_000))
    line = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    rows, sizes = [], [40, 45, 60, 78] * 5
    for i, n in enumerate(sizes):
        passage = line(n)
        parts = (passage[: n // 2], passage[n // 2 :], passage, passage)
        rows += [(4 * i + j, " ".join([*line(60), *p, *line(60)]), "en") for j, p in enumerate(parts)]
    got = collected(chains.fuzzy_passages(frame(spark, rows)))
    assert {(r["doc_id"], r["start"], r["words"], r["source_doc_id"], r["source_start"], r["differing"]) for r in got} == {(4 * i + 3, 60, n, 4 * i + 2, 60, 0) for i, n in enumerate(sizes)}


def test_long_seeds_go_on_where_passages_end(spark):
    """Words covered by one passage or by several that touch are not asked for again; others are."""
    met = spark.createDataFrame([(1, p, 0, 7) for p in (0, 9, 10, 40, 45, 46, 90)] + [(2, 10, 0, 7)], "doc_id long, place long, source_id long, source_place long")
    passages = spark.createDataFrame([(1, 10, 40), (1, 50, 30)], "doc_id long, start long, words long")
    got = sorted((r["doc_id"], r["place"]) for r in chains.beyond(met, passages, 35).collect())
    assert got == [(1, 0), (1, 9), (1, 46), (1, 90), (2, 10)]
