"""Benchmark passages in documents, found by winnowing.

A window is 13 consecutive words of an item. Its fingerprint is the smallest hash of the 5-word grams in it, so equal windows have
equal fingerprints wherever they stand and nothing that fills a window is missed. Document windows whose fingerprint an item
has are compared with the item's windows word by word. Shorter items are windows of their own length with the fingerprint
of what grams they hold.

Everything here is column expressions, joins and windows over the words of one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.shared import ascii_lower, content_keys, settled

WINDOW = 13
GRAM = 5
SALT = 29
# Fingerprints are broadcast up to this size (32 bytes each); beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 32
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order: runs of digits, letters and anything beyond ASCII, with A-Z lower-cased. Null has none."""
    spaced = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_A_WORD, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def given(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once per row: inside lambdas a plain expression would be worked out per element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hash of each ``k`` consecutive word hashes."""
    n = F.size(hashes) - (k - 1)
    starts = F.when(n > 0, F.slice(hashes, F.lit(1), n)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)]))


def window_minima(grams: Column, over: int) -> Column:
    """Smallest hash of each ``over`` consecutive grams."""
    n = F.size(grams) - (over - 1)
    starts = F.when(n > 0, F.slice(grams, F.lit(1), n)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda x, i: F.least(x, *[F.get(grams, i + j) for j in range(1, over)])) if over > 1 else grams


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """Distinct windows of the items: item_id, len, words (joined), kind, fingerprint, offset of the fingerprint's gram.

    kind ``window`` looks at minima of whole windows; kinds 1 to ``gram`` at grams of so many words.
    """
    w = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("len", F.least(F.size("words"), F.lit(window)))
    w = w.select("item_id", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("len")), lambda i: F.slice(F.col("words"), i + 1, F.col("len")))).alias("words"))
    w = w.select("item_id", "len", F.array_join("words", " ").alias("joined"), F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    kind, fingerprint, offset = F.lit(None), F.lit(None), F.lit(0)
    for k in range(1, gram + 1):
        grams = gram_hashes(F.col("h"), k)
        mine = F.col("len") == k if k < gram else F.col("len") >= gram
        kind = F.when(mine, F.when(F.col("len") == window, window).otherwise(k)).otherwise(kind)
        fingerprint = F.when(mine, F.array_min(grams)).otherwise(fingerprint)
        offset = F.when(mine & (F.col("len") < window), F.array_position(grams, F.array_min(grams)) - 1).otherwise(offset)
    return w.select("item_id", "len", "joined", kind.cast("int").alias("kind"), fingerprint.alias("fingerprint"), offset.cast("int").alias("offset")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows alike in id and text share a key of 128 bits: they have the same result."""
    return docs.select("doc_id", "text").withColumns(content_keys(SALT)).select("doc_id", "k1", "k2", words_of(F.col("text").cast("string")).alias("words"))


def find_windows(docs: DataFrame, windows: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as doc_id, k1, k2, n_words; and the occurrences of item windows: k1, k2, start, len, joined, each once.

    Texts are cut into words once: the pass that looks for fingerprints of whole windows gives a row for each document too. Only beyond the
    size that is broadcast these rows are read apart, as they have no fingerprint to be joined by.
    """
    probes = settled(windows.select("kind", "fingerprint", "offset", "len").distinct())
    small = probes.count() * ROW_BYTES <= BROADCAST_BYTES
    kinds = {r.kind for r in probes.select("kind").distinct().collect()} | {window}  # at most GRAM + 1 of them
    found = []
    for kind in sorted(kinds, reverse=True):
        over = window - gram + 1 if kind == window else 1
        grams = given(F.transform("words", lambda x: F.xxhash64(x)), lambda h: gram_hashes(h, min(kind, gram)))  # noqa: B023
        marks = F.transform(given(grams, lambda g: window_minima(g, over)), lambda f, i: F.struct(i.alias("at"), f.alias("fingerprint")))  # noqa: B023
        # The document itself comes before its marks.
        own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("fingerprint")))
        marks = docs.select("doc_id", "k1", "k2", "words", F.explode(F.concat(own, marks) if kind == window else marks).alias("m"))
        marks = marks.select("doc_id", "k1", "k2", "words", "m.at", "m.fingerprint")
        mine = probes.where(F.col("kind") == kind).drop("kind")
        if small:
            rows = marks.join(F.broadcast(mine), "fingerprint", "left")
        else:
            # Texts don't travel with every mark: rows that meet a fingerprint fetch the words again.
            met = marks.where("at >= 0").drop("words").join(mine, "fingerprint")
            rows = met.join(docs.select("k1", "k2", "words").dropDuplicates(["k1", "k2"]), ["k1", "k2"])
            if kind == window:
                rows = rows.unionByName(marks.where("at < 0").drop("fingerprint"), allowMissingColumns=True)
        start = F.col("at") - F.col("offset")
        here = (start >= 0) & (start + F.col("len") <= F.size("words"))
        rows = rows.where((F.col("at") < 0) | here)
        found.append(rows.select("doc_id", "k1", "k2", F.size("words").cast("bigint").alias("n_words"), start.alias("start"), "len", F.array_join(F.slice("words", start + 1, F.col("len")), " ").alias("joined")))
    seen = settled(reduce(DataFrame.unionByName, found))
    hits = seen.where("start is not null").select("k1", "k2", "start", "len", "joined")
    hits = hits.join(windows.select("len", "joined").distinct(), ["len", "joined"]).distinct()
    return seen.where("start is null").select("doc_id", "k1", "k2", "n_words"), hits


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of any item window is hit; a document is contaminated if at least a twentieth of its words are.
    Null and empty texts have no words and no hits. Repeated rows get a row each. Items of null or empty text have no window; an
    item without id marks words but isn't listed; an item given twice counts once. Other columns of either table are not used.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = settled(item_windows(items, window, gram))
    keyed = _keyed(docs)
    counted, hits = find_windows(keyed, windows, window, gram)
    hits = settled(hits)
    # Words under the union of a document's windows: each adds what reaches beyond all before it.
    before = Window.partitionBy("k1", "k2").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("len")
    covered = hits.select("k1", "k2", "start", "len", stop.alias("stop")).distinct().withColumn("reach", F.coalesce(F.max("stop").over(before), F.lit(0)))
    n_hit = covered.groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach"))).alias("n_hit"))
    named = windows.where(F.col("item_id").isNotNull()).select("item_id", "len", "joined").distinct()
    # The list of a document's items is part of its result.
    listed = hits.select("k1", "k2", "len", "joined").distinct().join(named, ["len", "joined"]).select("k1", "k2", "item_id").distinct()
    listed = listed.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    result = n_hit.join(listed, ["k1", "k2"], "left")
    out = counted.join(result, ["k1", "k2"], "left")
    hit, items_ = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"), F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), "k1", "k2",
    )
