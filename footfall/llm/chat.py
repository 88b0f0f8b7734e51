"""Conversations for training: snapshots that a longer log continues are dropped, the rest is rendered turn by turn.

Everything here is column expressions, joins and windows over bounded ranges; no conversation is gathered in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.shared import settled

HASHES = ["s0", "s1", "s2", "s3"]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Turns with their position in the conversation, the hash of all turns up to them and of those before them.

    A turn's hash covers its position, role and text; a prefix's hash is four running sums of 31 bits each, so it rolls along
    any cut of a conversation. Rows lie in ranges of (conversation, turn); a conversation over several ranges adds up one row
    per range.
    """
    own = F.concat(F.lit("-"), F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in ("turn", "role", "text")])))
    rows = turns.select(F.col("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.distinct().withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), own))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first(), F.col("text").asc_nulls_first()]
    placed = settled(rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("id", 33))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    spans = spans.select("conv", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = placed.join(spans, ["conv", "part"]).withColumn("position", F.col("id") - F.col("first") + F.col("ahead") + 1)
    content = [F.col("position"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    a, b = F.xxhash64(*content), F.xxhash64(F.lit(17), *content)
    low = F.lit((1 << 31) - 1)
    hashed = ranked.withColumns({h: F.shiftrightunsigned(x, s).bitwiseAND(low) for h, (x, s) in zip(HASHES, ((a, 0), (a, 32), (b, 0), (b, 32)))})
    hashed = settled(hashed.withColumn("n_chars", F.char_length(rendered())).select("conv", "conv_id", "turn", "role", "text", "part", "position", "n_chars", *HASHES))
    sums = hashed.groupBy("conv", "part").agg(*[F.sum(c).alias(c) for c in (*HASHES, "n_chars")])
    ahead = sums.select("conv", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead") for c in (*HASHES, "n_chars")])
    inside = Window.partitionBy("conv", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = hashed.select("*", *[F.sum(c).over(inside).alias(f"{c}_upto") for c in (*HASHES, "n_chars")]).join(ahead, ["conv", "part"])
    upto = {c: (F.col(f"{c}_upto") + F.col(f"{c}_ahead")) for c in (*HASHES, "n_chars")}
    return running.select(
        "conv", "conv_id", "turn", "role", "text", "position", "n_chars", (upto["n_chars"] - F.col("n_chars")).alias("start"),
        *[upto[h].alias(h) for h in HASHES], *[(upto[h] - F.col(h)).alias(f"{h}_before") for h in HASHES],
    )


def rendered() -> Column:
    """A turn in the chat template."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv of the conversations that no longer one continues; of equal ones the smallest conv_id (a missing one comes last)."""
    last = prefixes.groupBy("conv").agg(F.max_by(F.struct("position", "conv_id", *HASHES), "position").alias("l")).select("conv", "l.*")
    one = last.groupBy("position", *HASHES).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "conv")).alias("k"))
    continued = prefixes.where(F.col("position") > 1).select((F.col("position") - 1).alias("position"), *[F.col(f"{h}_before").alias(h) for h in HASHES]).distinct()
    return one.join(continued, ["position", *HASHES], "left_anti").select("k.conv")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per turn of the maximal conversations: conv_id, position, role, rendered, start, n_chars, trained.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Rows alike in these four count once; turns go by number, a
    missing number first, then by role and text. A row without conv_id is a conversation of its own. A missing
    text renders as empty, a missing role as "unknown". Concatenating a conversation's rows by position gives its text; ``start`` is the place in
    it. Assistant turns are those to train on.
    """
    prefixes = settled(prefix_hashes(turns))
    kept = settled(maximal(prefixes))
    return prefixes.join(kept, "conv", "left_semi").select(
        "conv_id", F.col("position").cast("bigint").alias("position"), "role", rendered().alias("rendered"),
        F.col("start").cast("bigint").alias("start"), F.col("n_chars").cast("bigint").alias("n_chars"), (F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("trained"),
    )
