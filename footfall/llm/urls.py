"""URL rules and lists: rules by host suffix and path prefix, long lists through a blocked Bloom filter and an exact join.

Everything here is column expressions and joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.shared import ascii_lower, settled

WORDS = 8
BITS_PER_URL = 12
# A block of the filter is a row of nine longs. Filters up to this size are broadcast, larger ones joined by block.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 96
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
# Parameters that only say where a reader came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host(url: Column) -> Column:
    """From the first "://" to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    """From the host to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without "www.", path without a last slash, parameters sorted and without tracking ones; null if there's no host."""
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, PARTS, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    name = F.regexp_replace(host(url), r"^www\.", "")
    return F.when(name != "", F.concat(name, F.regexp_replace(path(url), "/+$", ""), tail))


def rule_of(name: Column, place: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule (host, path start, verdict) that fits, else null. Few rules, as an expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((name == h) | name.endswith("." + h)) & place.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """One bit of the word: six bits of a second hash of the key."""
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit(WORDS)), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def blocked_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0..w7): each listed key sets one bit in each word of one block. ``listed`` has the column ``key``."""
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*[F.bit_or(_bit(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)])


def maybe_listed(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (with ``key``) that the filter doesn't rule out. The filter has at most ``blocks`` rows: small ones are broadcast."""
    held = F.broadcast(bloom) if blocks * ROW_BYTES <= BROADCAST_BYTES else bloom
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(_bit(F.col("key"), i)) != 0 for i in range(WORDS)])
    return rows.withColumn("block", _block(F.col("key"), blocks)).join(held, "block").where(hit).select(rows.columns)


def mark_listed(rows: DataFrame, bloom: DataFrame, key: Column, blocks: int, name: str) -> DataFrame:
    """``rows`` with a column that is false only where the filter rules ``key`` out."""
    hit = reduce(lambda a, b: a & b, [F.col(f"__w{i}").bitwiseAND(_bit(key, i)) != 0 for i in range(WORDS)])
    held = bloom.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)])
    met = rows.withColumn("__block", _block(key, blocks)).join(held, "__block", "left")
    return met.withColumn(name, F.coalesce(hit, F.lit(False))).select(*rows.columns, name)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row of ``pages`` (page_id, url); ``listed`` has the column ``url``.

    A fitting rule decides; else a page whose canonical URL is listed is blocked, any other allowed. The filter and the join
    see distinct URLs, so many rows of one URL cost no more. Null URLs, URLs without host and empty tables are handled: such pages fit no
    rule and no list. Repeated rows are kept; other columns of either table are not used.
    """
    keys = settled(listed.select(canonical(F.col("url")).alias("key")).where(F.col("key").isNotNull()).distinct())
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (64 * WORDS)))
    name, place = host(F.col("url")), path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col("page_id"), name.alias("host"), place.alias("path"), canonical(F.col("url")).alias("key")).select("*", rule.alias("rule"), verdict.alias("decided"))
    open_ = base.where(F.col("decided").isNull() & F.col("key").isNotNull()).select("key").distinct()
    found = settled(maybe_listed(open_, blocked_bloom(keys, blocks), blocks).join(keys, "key", "left_semi"))
    # Rows that need no look-up pass by; the others meet the found URLs.
    asked = F.col("decided").isNull() & F.col("key").isNotNull()
    looked = base.where(asked).join(found.withColumn("listed", F.lit(True)), "key", "left")
    rest = base.where(~asked).withColumn("listed", F.lit(False))
    both = looked.select(*base.columns, F.coalesce("listed", F.lit(False)).alias("listed")).unionByName(rest)
    return both.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
