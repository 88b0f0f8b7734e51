"""Ranked lexical search with bag deduplication.

Only terms of the items can score, so a document is its bag: the counts of those terms, and its length norm m. Documents of equal bag
and m, copies and near copies for the most part, are one class: grouped by hash and compared byte by byte. Every class is scored once
for each item, and of the best classes the members are listed by ascending doc_id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.shared import settled
from footfall.operators.scale import broadcast_if_small

# Digits, A-Z lower-cased, a-z and everything that isn't ASCII form terms; other bytes part them.
_TERMS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
PAIR = np.dtype([("term", "<u4"), ("tf", "<u4")])
# Items of one pass over the documents, in bytes of text, and items scored at once.
PASS_BYTES = 4 << 20
ITEMS_AT_ONCE = 64
CLASSES_AT_ONCE = 256
# Sums below it are exact in doubles.
EXACT = float(1 << 53)
# Rows of winning classes that are broadcast at most: with bags of some hundred bytes about 10 MB.
SMALL_ROWS = 20_000


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), bag (term numbers of ``vocabulary`` with their counts, as sorted PAIRs) of every document."""

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        number = vocabulary.get
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sizes, out = [], []
                for text in part.column(1).to_pylist():
                    words = terms(text)
                    sizes.append(len(words))
                    held = sorted((k, n) for w, n in Counter(words).items() if (k := number(w)) is not None)
                    out.append(np.array(held, PAIR).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n", "bag"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n bigint, bag binary")


def document_counts(held: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the ``size`` terms: one partial count per task."""

    def count(batches):
        import pyarrow as pa

        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), PAIR)["term"], minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    # At most one row per term of the items of this pass.
    for row in held.select("bag").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    return df


class ItemBlock:
    """Up to ITEMS_AT_ONCE items: a matrix of their terms (those of the block only) by items with the counts."""

    def __init__(self, first: int, items: list[list[int]], size: int):
        self.first, self.n = first, len(items)
        self.terms = np.unique(np.array([t for item in items for t in item], np.int64))
        self.local = np.full(size, -1, np.int64)
        self.local[self.terms] = np.arange(len(self.terms))
        self.longest = max(map(len, items))
        self.counts = np.zeros((len(self.terms), len(items)))
        for i, item in enumerate(items):
            np.add.at(self.counts[:, i], self.local[item], 1)

    def scores(self, rows: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Scores (classes x items) from entries (row, term, value)."""
        at = self.local[term]
        rows, at, value = rows[at >= 0], at[at >= 0], value[at >= 0]
        exact = float(value.max(initial=0)) * self.longest < EXACT
        dense = np.zeros((n, len(self.terms)), np.float64 if exact else np.int64)
        dense[rows, at] = value
        return (dense @ (self.counts if exact else self.counts.astype(np.int64))).astype(np.int64)


def best_classes(classes: DataFrame, items: list[list[int]], weights: np.ndarray, k: int) -> DataFrame:
    """The ``k`` best classes of each item by (score, smallest doc_id), of every task: item, score, first_doc, m, bag."""
    size, schema = len(weights), "item bigint, score bigint, first_doc bigint, m bigint, bag binary"

    def score(batches):
        import pyarrow as pa

        blocks = [ItemBlock(i, items[i : i + ITEMS_AT_ONCE], size) for i in range(0, len(items), ITEMS_AT_ONCE)]
        # Of each item, sorted: (-score, no doc_id, doc_id, m, bag).
        best: list[list[tuple]] = [[] for _ in items]
        floor = np.ones(len(items), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, CLASSES_AT_ONCE):
                docs, ms, held = (c.slice(i, CLASSES_AT_ONCE).to_pylist() for c in batch.columns)
                rows = np.repeat(np.arange(len(held)), [len(b) // PAIR.itemsize for b in held])
                pairs = np.frombuffer(b"".join(held), PAIR)
                tf = pairs["tf"].astype(np.int64)
                value = weights[pairs["term"]] * ((1_000_000_000 * tf) // (1_000 * tf + 12 * np.array(ms, np.int64)[rows]))
                for block in blocks:
                    found = block.scores(rows, pairs["term"], value, len(held))
                    here = slice(block.first, block.first + block.n)
                    fresh: dict[int, list] = {}
                    for r, j in zip(*(x.tolist() for x in np.nonzero(found >= floor[here]))):
                        fresh.setdefault(block.first + j, []).append((-int(found[r, j]), docs[r] is None, docs[r] or 0, ms[r], held[r]))
                    for j, more in fresh.items():
                        best[j] = sorted(best[j] + more)[:k]
                        if len(best[j]) == k:
                            floor[j] = -best[j][-1][0]
        rows = [(j, -s, None if none else d, m, b) for j, found in enumerate(best) for s, none, d, m, b in found]
        for i in range(0, len(rows), 4096):
            columns = zip(*rows[i : i + 4096])
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item", "score", "first_doc", "m", "bag"])

    return classes.select("first_doc", "m", "bag").mapInArrow(score, schema)


def _one_pass(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """Results for some items (item_id, text)."""
    spark = docs.sparkSession
    words = [terms(r["text"]) for r in items]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*map(set, words))))}
    if not vocabulary:
        return None
    held = settled(bags(docs, vocabulary))
    total = held.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("terms")).first()
    if not total["n"]:
        return None
    n, length = total["n"], total["terms"]
    df = document_counts(held, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    normed = held.where(F.octet_length("bag") > 0).select("doc_id", F.expr(f"75 + (25 * n * {n}L) div {length}L").alias("m"), "bag").withColumn("hash", F.xxhash64("m", "bag"))
    classes = normed.groupBy("hash", "m", "bag").agg(F.min("doc_id").alias("first_doc"))
    numbered = [[vocabulary[w] for w in item] for item in words]
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first_doc"))
    winners = best_classes(classes, numbered, weights, k).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    winners = settled(winners.select("item", "score", "m", "bag", F.xxhash64("m", "bag").alias("hash")))
    # Members of winning classes: the first k of each by doc_id.
    won = broadcast_if_small(winners.select("hash", "m", "bag").distinct(), SMALL_ROWS)
    member = Window.partitionBy("hash", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    members = normed.join(won, ["hash", "m", "bag"], "left_semi").withColumn("nth", F.row_number().over(member)).where(F.col("nth") <= k)
    named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item bigint, item_id bigint")
    ranked = winners.join(members, ["hash", "m", "bag"]).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item, ties by ascending doc_id.

    Scores are sums of term weight times a saturated count, in whole numbers. Null texts and texts without terms score nothing and don't count.
    Every row of ``docs`` is a document: repeated rows are ranked side by side; a missing doc_id comes last. Rows of ``items`` alike in
    item_id and text are one item; texts of one item_id are ranked each by itself. Other columns aren't used; empty tables give no rows.
    Items are taken some megabytes at a time; each such part passes over the documents once.
    """
    some = settled(items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where(F.octet_length("text") > 0).distinct())
    passes = max(1, -(-(some.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES))
    found = []
    for i in range(passes):
        # Bounded by PASS_BYTES, but for the unevenness of the hash.
        part = some.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()
        if (ranked := _one_pass(docs, part, k)) is not None:
            found.append(ranked)
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
