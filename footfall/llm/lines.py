"""Repeated runs of lines, found by winnowing over line hashes.

A window starts at any line and takes as many lines as hold ``run_words`` words. The smallest line hash in it is its fingerprint, so
a run of that many words that stands in two places has a fingerprint in common there. Windows with a fingerprint that
occurs at several positions meet the first window of the same lines; windows that follow each other in both places join into
one run, and a run grows both ways over neighbouring lines that are equal in text and source. Later runs are deleted, the first
stays. No two later ones are compared.

Everything here is column expressions, joins and windows over the lines of one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.shared import content_keys, settled
from footfall.llm.urls import BITS_PER_URL, BROADCAST_BYTES, ROW_BYTES, WORDS, blocked_bloom, mark_listed
from footfall.operators.scale import spread_join

RUN_WORDS = 50
SALT = 31
BLANK = " \t\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of 128 bits that rows alike in both share."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns(content_keys(SALT))


def line_windows(keyed: DataFrame, run_words: int) -> DataFrame:
    """Windows of every document: doc (order and key), at and last_at (numbers among lines with a word, from 1), first_line and last_line
    (numbers among all lines, from 0), fingerprint, c1 and c2 (content)."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("k1"), F.col("k2")).alias("doc")
    lines = keyed.select(place, F.posexplode(F.split("text", "\n")).alias("line", "body"))
    bare = F.btrim(F.col("body"), F.lit(BLANK))
    lines = lines.where(bare != "").select("doc", "line", F.regexp_count(F.col("body"), F.lit(WORD)).alias("words"), F.xxhash64(bare).alias("h"))
    # Rows alike share all lines; one of each counts.
    lines = lines.groupBy("doc", "line").agg(F.first("words").alias("words"), F.first("h").alias("h"))
    by = Window.partitionBy("doc")
    upto = by.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.select("doc", "line", "h", F.row_number().over(by.orderBy("line")).alias("at"), (F.sum("words").over(upto) - F.col("words")).alias("ahead"), F.sum("words").over(by).alias("total"))
    reach = by.orderBy("ahead").rangeBetween(Window.currentRow, run_words - 1)
    held = lines.select("doc", "line", "at", "ahead", "total", F.max("line").over(reach).alias("last_line"), F.min("h").over(reach).alias("fingerprint"), F.collect_list("h").over(reach).alias("held"))
    whole = held.where(F.col("ahead") + run_words <= F.col("total"))
    return whole.select("doc", "at", (F.col("at") + F.size("held") - 1).alias("last_at"), F.col("line").alias("first_line"), "last_line", "fingerprint", F.xxhash64("held").alias("c1"), F.xxhash64(F.lit(37), "held").alias("c2"))


def repeated_runs(keyed: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Runs of lines that stand earlier too: doc, first_line, last_line (from 0), source, source_line (among lines with a word, from 1).

    A run is a chain of windows with one shift to one source, grown as :func:`grown` says. Earlier is a smaller doc_id (a missing one is the largest) or an earlier line of the same document.
    """
    windows = settled(line_windows(keyed, run_words))
    place = F.struct("doc", "at")
    # Positions by fingerprint: those of a single position can't repeat.
    at = F.xxhash64("doc", "at")
    shared = windows.groupBy("fingerprint").agg(F.min(at).alias("a"), F.max(at).alias("b")).where(F.col("a") != F.col("b")).select("fingerprint")
    some = windows.join(shared, "fingerprint", "left_semi")
    first = some.groupBy("c1", "c2").agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    later = some.join(first, ["c1", "c2"]).where(place != F.col("source"))
    later = later.select("doc", "at", "last_at", "first_line", "last_line", F.col("source.doc").alias("source"), F.col("source.at").alias("source_line"))
    # Windows that overlap or touch, with the same shift to the same source, are one run.
    by = Window.partitionBy("doc").orderBy("at")
    shift = F.col("source_line") - F.col("at")
    follows = (F.lag("source").over(by) == F.col("source")) & (F.lag(shift).over(by) == shift) & (F.lag("last_at").over(by) + 1 >= F.col("at"))
    marked = later.withColumn("fresh", F.when(follows, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("fresh").over(by)).groupBy("doc", "run")
    joined = runs.agg(F.min("at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.min_by("source", "at").alias("source"), F.min("source_line").alias("source_line"))
    return grown(keyed, settled(joined.drop("run")), run_words)


def grown(keyed: DataFrame, runs: DataFrame, run_words: int) -> DataFrame:
    """``runs`` grown both ways to the first line that differs from the source's, by at most ``run_words`` - 1 lines each way: a longer
    equal stretch has windows of its own. Only the lines next to a run travel, and only texts that a run names are read again."""
    most = run_words - 1
    keys = lambda c, a, b: [F.col(f"{c}.k1").alias(a), F.col(f"{c}.k2").alias(b)]
    named = settled(runs.select(*keys("doc", "__k1", "__k2")).union(runs.select(*keys("source", "__k1", "__k2"))).distinct())
    some, _ = parted(keyed.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "text"), named)
    bare = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(BLANK)).alias("bare"), i.alias("line")))
    held = F.transform(F.filter(bare, lambda x: x["bare"] != ""), lambda x: F.struct(F.xxhash64(x["bare"]).alias("h"), x["line"].alias("line")))
    held = settled(some.join(named, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select("__k1", "__k2", held.alias("held")))
    side = lambda a, b: held.select(F.col("__k1").alias(a), F.col("__k2").alias(b), "held")
    after = lambda at: F.slice("held", F.col(at) + 1, most)
    ahead = lambda at: F.reverse(F.slice("held", F.greatest(F.lit(1), F.col(at) - most), F.least(F.lit(most), F.col(at) - 1)))
    runs = runs.select("*", *keys("doc", "__k1", "__k2"), *keys("source", "__s1", "__s2"), (F.col("source_line") + F.col("last_at") - F.col("first_at")).alias("source_last"))
    met = spread_join(runs, side("__s1", "__s2"), ["__s1", "__s2"]).withColumns({"__next": after("source_last"), "__prev": ahead("source_line")}).drop("held")
    met = spread_join(met, side("__k1", "__k2"), ["__k1", "__k2"]).withColumns({"next": after("last_at"), "prev": ahead("first_at")}).drop("held")

    def equal(ours: str, theirs: str):
        """How many lines are equal before the first that isn't."""
        same = F.transform(ours, lambda x, i: F.coalesce(x["h"] == F.get(F.col(theirs), i)["h"], F.lit(False)))
        return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")

    met = met.withColumns({"up": equal("next", "__next"), "down": equal("prev", "__prev")})
    reach = lambda c, n, line: F.coalesce(F.get(F.col(c), F.col(n) - 1)["line"], F.col(line)).alias(line)
    return met.select("doc", reach("prev", "down", "first_line"), reach("next", "up", "last_line"), "source", (F.col("source_line") - F.col("down")).alias("source_line"))


def parted(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have one of ``keys`` (__k1, __k2), and those that have none, told apart by a blocked Bloom filter without a shuffle.
    Once the filter were too large to broadcast, all may have one."""
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (64 * WORDS)))
    if blocks * ROW_BYTES > BROADCAST_BYTES:
        return rows, rows.where(F.lit(False))
    bloom = F.broadcast(blocked_bloom(keys.select(F.col("__k1").alias("key")), blocks))
    marked = mark_listed(rows, bloom, F.col("__k1"), blocks, "__maybe")
    return marked.where("__maybe").drop("__maybe"), marked.where("not __maybe").drop("__maybe")


def with_runs(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with ``__runs`` of their key, null without; texts of documents without runs stay where they are."""
    some, none = parted(docs, gone)
    none = none.withColumn("__runs", F.lit(None).cast(gone.schema["__runs"].dataType))
    return some.join(gone, ["__k1", "__k2"], "left").unionByName(none)


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, spared: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with later repeated runs taken out of ``text``: all its columns, and n_lines, n_removed, words, words_removed.

    Lines are compared without blanks at their ends; lines without a word belong to no run and stay. A null text stays null with no lines.
    Rows alike in doc_id and text count as one document and get the same result. A text that is one run of an earlier one becomes empty.
    ``spared`` gets the runs and gives keys (k1, k2) of documents that are left whole. Columns of ``docs`` with the names of the four new ones are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "words", "words_removed")
    runs = settled(repeated_runs(_keyed(docs), run_words))
    gone = settled(runs.groupBy(F.col("doc.k1").alias("__k1"), F.col("doc.k2").alias("__k2")).agg(F.collect_set(F.struct("first_line", "last_line")).alias("__runs")))
    if spared is not None:
        gone = settled(gone.join(spared(runs).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), ["__k1", "__k2"], "left_anti"))
    text = F.col("text").cast("string")
    keys = content_keys(SALT)
    rows = with_runs(docs.withColumns({"__k1": keys["k1"], "__k2": keys["k2"]}), gone)
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.exists("__runs", lambda r: (r["first_line"] <= i) & (i <= r["last_line"])))
    rows = rows.withColumn("__new", F.when(F.col("__runs").isNull(), text).otherwise(F.array_join(kept, "\n")))
    words = lambda c: F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")
    lines = lambda c: F.coalesce(F.size(F.filter(F.split(c, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")), F.lit(0)).cast("bigint")
    changed = F.col("__runs").isNotNull()
    rows = rows.withColumns({"n_lines": lines(text), "words": words(text), "n_removed": F.when(changed, lines(text) - lines(F.col("__new"))).otherwise(F.lit(0).cast("bigint")), "words_removed": F.when(changed, words(text) - words(F.col("__new"))).otherwise(F.lit(0).cast("bigint"))})
    return rows.withColumn("text", F.col("__new")).drop("__k1", "__k2", "__runs", "__new")
