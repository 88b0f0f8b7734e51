"""A training corpus from raw documents, stage by stage, each written and read again.

Every stage takes (spark, docs, sf_dir). All but the last give the columns of ``documents``; decisions are made per content key
(doc_id and text), so repeated rows share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import decontaminate, lines, neardup, packing, quality
from footfall.llm.queries import vocabulary
from footfall.llm.decontaminate import given, gram_hashes
from footfall.llm.shared import ascii_lower, content_keys, settled, table
from footfall.llm.urls import BITS_PER_URL, BROADCAST_BYTES, ROW_BYTES, WORDS, blocked_bloom, mark_listed
from footfall.operators.scale import spread_join

# Near copies by the measure of the near-copy stage.
SHINGLE, PERCENT = 5, 80
# Workers that carry the memory of all stages remember fewer ids; those that come again are encoded again.
REMEMBERED = 24_000_000


def _without(docs: DataFrame, keys: DataFrame, salt: int) -> DataFrame:
    """``docs`` without rows whose content key is among ``keys`` (k1, k2), with the key as __k1 and __k2.

    A blocked Bloom filter of the keys lets the texts of other rows stay where they are; only rows it can't rule out meet the keys.
    """
    keys = settled(keys.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct())
    named = docs.withColumns({f"__{k}": c for k, c in content_keys(salt).items()})
    some, others = _marked(named, keys)
    return some.join(keys, ["__k1", "__k2"], "left_anti").unionByName(others)


def _marked(named: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may have one of the keys, and rows that have none. Once the filter were too large to broadcast, all may have one."""
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (64 * WORDS)))
    if blocks * ROW_BYTES > BROADCAST_BYTES:
        return named, named.where(F.lit(False))
    bloom = F.broadcast(blocked_bloom(keys.select(F.col("__k1").alias("key")), blocks))
    marked = mark_listed(named, bloom, F.col("__k1"), blocks, "__maybe")
    return marked.where("__maybe").drop("__maybe"), marked.where("not __maybe").drop("__maybe")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a risk-controlled cutoff of their language go."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("not kept"), quality.SALT).select(docs.columns)


def shingles(text: Column) -> Column:
    """Hashes of the distinct shingles of a text."""
    words = F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.array_distinct(given(hashes, lambda h: gram_hashes(h, SHINGLE)))


def sure_copies(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Keys (k1, k2) of documents with runs that the near-copy stage removes if they reach it whole.

    Such a document is a near copy of the source of one of its runs, and that source, an earlier document, has no runs itself, so no
    text of the two changes and the stage links them. Only pairs that the runs name are compared, by their whole shingle sets.
    """
    key = lambda c, a, b: [F.col(f"{c}.k1").alias(a), F.col(f"{c}.k2").alias(b)]
    cut = runs.select(*key("doc", "s1", "s2")).distinct()
    pairs = runs.select(*key("doc", "k1", "k2"), *key("source", "s1", "s2")).distinct().join(cut, ["s1", "s2"], "left_anti")
    pairs = settled(pairs)
    wanted = settled(pairs.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).union(pairs.select("s1", "s2")).distinct())
    some, _ = _marked(docs.select("text", "doc_id").withColumns({f"__{k}": c for k, c in content_keys(lines.SALT).items()}), wanted)
    some = some.join(wanted, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    sets = settled(some.select("__k1", "__k2", shingles(F.col("text").cast("string")).alias("held")))
    side = lambda a, b, name: sets.select(F.col("__k1").alias(a), F.col("__k2").alias(b), F.col("held").alias(name))
    met = spread_join(spread_join(pairs, side("s1", "s2", "theirs"), ["s1", "s2"]), side("k1", "k2", "ours"), ["k1", "k2"])
    common = F.size(F.array_intersect("ours", "theirs"))
    return met.where(100 * common >= PERCENT * (F.size("ours") + F.size("theirs") - common)).select("k1", "k2").distinct()


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, except from documents that the next stage removes as near copies."""
    cut = lines.dedup_lines(docs, spared=lambda runs: sure_copies(docs, runs))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    groups = settled(neardup.near_duplicates(docs, SHINGLE, PERCENT))
    left = _without(docs, groups.where("not first"), neardup.SALT)
    # Rows alike in id and text: one stays.
    again = groups.where("first").groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    some, others = _marked(left, settled(again.drop("n")))
    return some.dropDuplicates(["__k1", "__k2"]).unionByName(others).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark items go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"), decontaminate.SALT).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 1,024 ids."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", pack_sequences),
]

# Tokenizers, learnt cutoffs and sketches have no SQL form; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
    return docs
