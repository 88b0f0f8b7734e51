"""Near-duplicate documents: MinHash bands for candidates, odd sketches to weigh them, full shingle sets to confirm.

Documents with the same shingle set are one node. Each node has MinHash samples; bands of them are bucket keys. An odd sketch keeps
the parity of how many samples fall on each of its bits; two sketches differ in about twice as many bits as samples
differ, which tells high similarities apart well. Pairs whose sketches allow the asked similarity, five standard deviations
down, are weighed by odd sketches of the full sets: these never differ in more bits than the sets differ in shingles, so what they
rule out is no link. The rest is confirmed on the full sets.

No bucket is expanded into all its pairs. First each member meets its bucket's smallest node. Then, in buckets whose members
are still of several components, the members outside the largest component meet the others as blocks of sketches inside
tasks, and the likeliest partners in each other component are confirmed; that goes on with ever more partners, in buckets that
had more to offer, until none is left untested.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.shared import content_keys, settled, text_batches
from footfall.llm.urls import BITS_PER_URL, BROADCAST_BYTES, ROW_BYTES, WORDS, blocked_bloom, maybe_listed

SHINGLE = 5
PERCENT = 80
ROWS = 7
SALT = 43
# Chance that two documents at the threshold share no bucket.
MISSED = 1e-7
SKETCH_BITS = 512
DEVIATIONS = 5
BLOCK = 1024
PER_GROUP = 64
FIRST_PARTNERS = 4
MORE_PARTNERS = 16
SET_BITS = 1024
REMEMBERED = 100_000


def bands_for(percent: int, rows: int = ROWS, missed: float = MISSED) -> int:
    return math.ceil(math.log(missed) / math.log1p(-((percent / 100) ** rows)))


def most_differing_bits(percent: int, samples: int) -> int:
    """Bits in which the sketches of two documents at the threshold differ at most, ``DEVIATIONS`` up."""
    s = percent / 100
    differing = samples * (1 - s) + DEVIATIONS * math.sqrt(samples * s * (1 - s))
    expected = SKETCH_BITS / 2 * (1 - math.exp(-4 * differing / SKETCH_BITS))
    return math.ceil(expected + 2 * math.sqrt(expected))


class _Words(dict):
    """Word hashes; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_words = _Words()


def shingle_set(text: str | None, shingle: int):
    """Sorted hashes of the distinct shingles of a whole text; with fewer words, of the whole sequence; empty without words."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, len(words) if k < shingle else shingle, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def min_hashes(shingles, factors):
    """Smallest product of each factor with the shingles, mod 2^64."""
    import numpy as np

    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        best = np.minimum(best, (shingles[None, i : i + 4096] * factors[:, None]).min(axis=1))
    return best


def odd_sketch(samples):
    """Parity of the samples on each bit, as 64-bit words."""
    import numpy as np

    mixed = (samples ^ (np.arange(1, len(samples) + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))) * np.uint64(0xD6E8FEB86659FD93)
    odd = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_parity(shingles):
    """Odd sketch of a whole set, as 64-bit words."""
    import numpy as np

    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % SET_BITS, minlength=SET_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SIGNED = "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, node binary, bands array<bigint>, sketch array<bigint>"


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumns(content_keys(SALT)).select("doc_id", "k1", "k2", "text")


def signatures(keyed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Per row: size and digest of its shingle set, band keys and odd sketch (none for an empty set)."""
    n_bands = bands_for(percent)

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(8)
        factors = rng.integers(0, 1 << 63, n_bands * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        folds = rng.integers(0, 1 << 63, (n_bands, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, sizes, nodes, bands, sketches = batch.slice(i, 512), [], [], [], []
                for text in part.column(3).to_pylist():
                    shingles = shingle_set(text, shingle)
                    sizes.append(len(shingles))
                    nodes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                    if not len(shingles):
                        bands.append([])
                        sketches.append([])
                        continue
                    samples = min_hashes(shingles, factors)
                    mixed = ((samples.reshape(n_bands, ROWS) >> np.uint64(7)) * folds).sum(axis=1, dtype=np.uint64)
                    bands.append(((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                    sketches.append(odd_sketch(samples))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    names=[f.split()[0] for f in SIGNED.split(", ")],
                )

    return keyed.mapInArrow(sign, SIGNED)


def _listed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` that a Bloom filter of ``keys`` (both have ``key``) doesn't rule out; all of them once it were too large to broadcast.

    Spark would move a semi-join with the same keys below the filter and shuffle all rows: settle the rows first, or use an inner join.
    """
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (64 * WORDS)))
    return maybe_listed(rows, blocked_bloom(keys, blocks), blocks) if blocks * ROW_BYTES <= BROADCAST_BYTES else rows


def full_sets(keyed: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """node, n, parity (odd sketch of the set), shingles (sorted 64-bit hashes as bytes) of the nodes in ``reps`` (node, k1, k2)."""

    def fill(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_parity(x) for x in sets], pa.list_(pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["node", "n", "parity", "shingles"],
                )

    # Rows alike share a key; one of each is enough.
    some = _listed(keyed.withColumn("key", F.col("k1")), reps.select(F.col("k1").alias("key")))
    texts = some.join(reps, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(fill, "node binary, n bigint, parity array<bigint>, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), distinct, those that are alike on full sets. The pairs of one ``a`` are dealt in groups of about
    ``PER_GROUP``, and its set travels once per group."""

    def check(batches):
        import numpy as np
        import pyarrow as pa

        first, held = None, None
        for batch in batches:
            out = ([], [])
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                shingles = np.frombuffer(data, np.uint64)
                if b is None:
                    first, held = a, shingles
                    continue
                small, large = sorted((shingles, held), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (len(small) + len(large) - both):
                    out[0].append(first)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["a", "b"])

    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_GROUP).alias("groups"))
    dealt = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).alias("group"), "b")
    firsts = dealt.select("a", "group").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "group", F.lit(None).cast("binary").alias("b"), "shingles")
    others = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "group", "b", "shingles")
    rows = firsts.unionByName(others).repartition("a", "group").sortWithinPartitions("a", "group", F.col("b").asc_nulls_first())
    return rows.mapInArrow(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of the nodes of ``edges`` (a, b): each round every node joins its smallest neighbour
    and edges inside a joined group vanish."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = settled(both.distinct())
    comp = edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    while not edges.isEmpty():
        up = settled(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")))
        over = up.select(F.col("a").alias("up"), F.col("up").alias("over"))
        up = settled(up.join(over, "up").select(F.col("a"), F.col("over").alias("up")))
        comp = settled(comp.join(up.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
        left = edges.join(up, "a").select(F.col("up").alias("a"), "b")
        right = left.join(up.select(F.col("a").alias("b"), F.col("up").alias("to")), "b").select("a", F.col("to").alias("b"))
        edges = settled(right.where(F.col("a") != F.col("b")).distinct())
    return comp


def _differing(a: str, b: str, bits: int):
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(bits // 64)])


def other_components(members: DataFrame, sketches: DataFrame, most: int, percent: int, partners: int) -> DataFrame:
    """Pairs (a, b) of bucket members in different components that their sketches don't rule out: for each member outside
    its bucket's largest component the ``partners`` likeliest in each other component. If there were more, ``key`` names the bucket.

    ``members`` has key, node, comp; ``sketches`` has node, sketch, n, parity, which only travel for buckets of several components. Probes and targets meet in blocks of ``BLOCK``.
    """
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("all"), F.max("n").alias("most"))
    open_ = largest.where(F.col("comps") > 1).select("key", "largest", F.ceil(F.col("all") / BLOCK).alias("targets"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("probes"))
    rows = settled(members.join(open_, "key")).join(sketches, "node")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    probes = rows.where(F.col("comp") != F.col("largest")).select("key", place("probes").alias("i"), F.explode(F.sequence(F.lit(0), F.col("targets") - 1)).alias("j"), F.lit(0).alias("role"), "node", "comp", "sketch", "n", "parity")
    targets = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("i"), place("targets").alias("j"), F.lit(1).alias("role"), "node", "comp", "sketch", "n", "parity")
    dealt = probes.unionByName(targets).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(group):
            """Pairs of one block of probes and one of targets."""
            words = lambda part, i: np.array([g[i] for g in part], np.int64).view(np.uint64)
            left, right = [g for g in group if g[3] == 0], [g for g in group if g[3] == 1]
            out = []
            if not left or not right:
                return out
            number = {c: i for i, c in enumerate({g[5] for g in group})}
            comp_l, comp_r = (np.array([number[g[5]] for g in part]) for part in (left, right))
            sl, sr, pl, pr = words(left, 6), words(right, 6), words(left, 8), words(right, 8)
            nl, nr = (np.array([g[7] for g in part], np.int64) for part in (left, right))
            for i, probe in enumerate(left):
                differ = np.bitwise_count(sr ^ sl[i]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero((differ <= most) & (comp_r != comp_l[i]))
                odd, sizes = np.bitwise_count(pr[near] ^ pl[i]).sum(axis=1, dtype=np.int64), nr[near] + nl[i]
                fits = odd * (100 + percent) <= (100 - percent) * sizes
                near = near[fits][np.lexsort((odd[fits] / sizes[fits], comp_r[near[fits]]))]
                c = comp_r[near]
                starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
                nth = np.arange(len(c)) - np.repeat(starts, np.diff(np.r_[starts, len(c)]))
                cut = bool((nth >= partners).any())
                out += [(min(probe[4], right[j][4]), max(probe[4], right[j][4]), cut) for j in near[nth < partners]]
            return out

        def groups():
            held, key = [], None
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    if row[:3] != key and held:
                        yield held
                        held = []
                    key = row[:3]
                    held.append(row)
            if held:
                yield held

        for group in groups():
            found = pairs(group)
            if found:
                a, b, cut = zip(*found)
                keys = [group[0][0] if c else None for c in cut]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(keys, pa.int64())], names=["a", "b", "key"])

    return dealt.mapInArrow(meet, "a binary, b binary, key bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id, kept; k1 and k2 are keys of the row's id and text, and
    first marks the one key per group that stays.

    Texts are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id reachable.
    A text without words is linked with nothing and kept. A missing doc_id is never the smallest unless its group has no other,
    which is kept then. Repeated rows get a row each; those with the smallest doc_id are all kept. Other columns are ignored.
    """
    keyed = _keyed(docs)
    with text_batches(docs.sparkSession):
        signed = settled(signatures(keyed, shingle, percent))
    samples = bands_for(percent) * ROWS
    most = most_differing_bits(percent, samples)
    whole = signed.where(F.col("n_shingles") > 0)
    keys = whole.select("node", F.explode("bands").alias("key"))
    # A key of one node pairs nobody: hashes of nodes tell, so that the nodes travel for shared keys alone.
    short = F.xxhash64("node")
    shared = keys.groupBy("key").agg(F.min(short).alias("a"), F.max(short).alias("b")).where(F.col("a") != F.col("b")).select("key")
    shared = settled(shared)
    members = settled(settled(_listed(keys, shared)).join(shared, "key", "left_semi").distinct())
    leads = members.groupBy("key").agg(F.min("node").alias("lead"))
    buckets = members.join(leads, "key")
    reps = whole.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("r"), F.first("sketch").alias("sketch"))
    involved = settled(members.select("node").distinct().join(reps, "node").select("node", "r.k1", "r.k2", "sketch"))
    with text_batches(docs.sparkSession):
        sets = settled(full_sets(keyed, involved.drop("sketch"), shingle))
    sketches = settled(involved.select("node", "sketch").join(sets.select("node", "n", "parity"), "node"))

    def weighed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"), F.col("parity").alias("pa")), "a")
        both = left.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"), F.col("parity").alias("pb")), "b")
        fits = _differing("pa", "pb", SET_BITS) * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))
        return both.where((_differing("sa", "sb", SKETCH_BITS) <= most) & fits).select("a", "b")

    stars = settled(weighed(buckets.where(F.col("lead") != F.col("node")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()))
    tested, edges, partners = stars, settled(confirm(stars, sets, percent)), FIRST_PARTNERS
    comp, open_ = components(edges), members
    while True:
        placed = open_.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        found = settled(other_components(placed, sketches, most, percent, partners))
        fresh = settled(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            tested = tested.unionByName(fresh)
            linked = settled(confirm(fresh, sets, percent))
            if not linked.isEmpty():
                edges = edges.unionByName(linked)
                comp = components(edges)
        # A bucket that gave all its pairs is done, as components only grow.
        cut = found.where(F.col("key").isNotNull()).select("key").distinct()
        if cut.isEmpty():
            break
        open_ = settled(open_.join(cut, "key", "left_semi"))
        partners *= MORE_PARTNERS
    rows = signed.select("doc_id", "k1", "k2", "n_shingles", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k1"), F.col("k2"))
    grouped = rows.where(F.col("comp").isNotNull())
    smallest = grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("o"))
    alone = rows.where(F.col("comp").isNull()).withColumn("component_id", F.col("doc_id")).withColumn("first", F.lit(True))
    linked = grouped.join(smallest, "comp").withColumn("first", (F.col("k1") == F.col("o.k1")) & (F.col("k2") == F.col("o.k2")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    columns = ["doc_id", "n_shingles", "component_id", kept.alias("kept"), "k1", "k2", "first"]
    return linked.select(columns).unionByName(alone.select(columns))
