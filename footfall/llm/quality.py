"""Quality rules with risk-controlled cutoffs.

Each rule rejects documents whose feature exceeds a cutoff. Half of a stratum's labels lay out one path of cutoffs for all rules together,
from lenient to strict; the other half, the holdout, decides how far to go on it: a step is accepted while an exact binomial
test says that all rules together reject at most a stated share of wanted documents. Testing in that order needs no
correction over the steps; over strata the level is divided (Bonferroni), so with probability 1 - ``error`` no accepted step
breaks the limit anywhere. With four strata some 86 wanted holdout labels are enough; a stratum with fewer gets no cutoff and rejects
nothing. Of the accepted steps the one that separates best is used, the most lenient of equals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.shared import ascii_lower, content_keys, settled, text_batches

SALT = 41
# Fixed values of the base rules.
LEAST_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

# Largest share of wanted documents that all rules together may reject in a stratum, and the chance that this fails.
FALSE_REJECTION = 0.05
ERROR = 0.05
# How many rejected wanted documents outweigh one rejected unwanted document.
CAUTION = 20
SHARES = [round(0.9 * 0.85**i, 6) for i in range(40)]
RULES: dict[str, list[float]] = {"symbol_share": SHARES, "upper_share": SHARES, "dup_line_share": SHARES, "repeat_share": SHARES, "n_marked": [float(c) for c in range(12, -1, -1)]}

# The word list is learnt from at most so many labelled documents and holds at most so many word starts of this length.
LEARN_FROM = 50_000
LIST_SIZE = 400
# The path of cutoffs starts so many cutoffs before the first ones, and a rule takes part if it finds so many unwanted learning documents.
BACK_OFF = 8
LEAST_GAIN = 3
START = 4
LEAST_FOUND = 5
LEAST_RATIO = 25.0


def _upper_and_letters():
    """Tables over code points below 0x250: upper case, letter."""
    import numpy as np

    chars = [chr(i) for i in range(0x250)]
    return np.array([c.isupper() for c in chars]), np.array([c.isalpha() for c in chars])


def text_features(text: str | None, marked: frozenset[bytes], tables) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters, n_marked of a whole text."""
    import numpy as np

    if not text:
        return (0,) * 9
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    seen, dups, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(np.minimum(codes, 0x250), minlength=0x251)
    blank = int(counts[[32, 9, 10, 11, 12, 13]].sum())
    upper, letter = tables
    symbols = int(counts[[ord(c) for c in SYMBOLS]].sum())
    n_marked = len(marked.intersection([word_start(w) for w in data.lower().split()])) if marked else 0
    return n, len(codes) - blank, symbols, dups, repeat_words(words), lines, int(counts[:-1][upper].sum()), int(counts[:-1][letter].sum()), n_marked


def word_start(word: bytes) -> bytes:
    """The first ``START`` characters."""
    start = word[:START]
    return start if start.isascii() else word[: 4 * START].decode("utf-8", "ignore")[:START].encode()


def repeat_words(words: Sequence[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows of ``window`` words that stand in the text twice or more, the first included."""
    import numpy as np

    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    # Exact numbers of windows by doubling: a pair of numbers of half windows gets the number of its rank.
    width = 1
    while width < window:
        m = len(ids) - width
        ids = np.unique(ids[:m] * np.uint64(len(words) + 1) + ids[width:], return_inverse=True)[1].astype(np.uint64)
        width *= 2
    times = np.bincount(ids.astype(np.int64))
    again = np.flatnonzero(times[ids.astype(np.int64)] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


FEATURES = "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_letters bigint, n_marked bigint, k1 bigint, k2 bigint"


def features(docs: DataFrame, stratum: str, marked: Sequence[str] = ()) -> DataFrame:
    """A row of whole-text features per row of ``docs``; ``marked`` are word starts, at most ``LIST_SIZE`` of them."""
    starts = frozenset(m.encode() for m in marked)

    def measure(batches):
        import pyarrow as pa

        tables = _upper_and_letters()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [text_features(t, starts, tables) for t in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in zip(*rows)], part.column(3), part.column(4)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FEATURES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns(content_keys(SALT))
    return rows.mapInArrow(measure, FEATURES)


def wanted_labels(labels: DataFrame) -> DataFrame:
    """doc_id, wanted, toxic, learn: one row per labelled document. Wanted is of quality and not toxic; contradicting labels
    count as unwanted; half of the documents, by hash, are for learning the word list, the others are the holdout."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    one = rows.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return one.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("wanted"), (F.col("toxic") == 1).alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("boolean").alias("learn"))


def learn_marked(docs: DataFrame, labels: DataFrame, learn_from: int = LEARN_FROM) -> list[str]:
    """Word starts that stand out in toxic documents of the learning half: at most ``LIST_SIZE``, from at most ``learn_from`` documents."""
    sample = labels.where("learn").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(learn_from).select("doc_id", "toxic")
    sample = settled(sample)
    n = sample.agg(F.sum(F.col("toxic").cast("int")).alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    if not n["toxic"] or n["toxic"] == n["all"]:
        return []
    # At most learn_from rows of two columns.
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    starts = F.array_distinct(F.transform(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: F.substring(w, 1, START)))
    words = held.select("toxic", F.explode(starts).alias("start")).where(F.char_length("start") == START)
    found = words.groupBy("start").agg(F.sum(F.col("toxic").cast("int")).alias("bad"), F.count(F.lit(1)).alias("all"))
    ratio = (F.col("bad") / n["toxic"]) / ((F.col("all") - F.col("bad") + 1) / (n["all"] - n["toxic"]))
    best = found.where((F.col("bad") >= LEAST_FOUND) & (ratio >= LEAST_RATIO)).orderBy(F.desc("bad"), "start").limit(LIST_SIZE)
    return [r.start for r in best.collect()]


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of chance p, added up term by term."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def accepted(lenient_first: Sequence[tuple[int, int]], n_wanted: int, n_unwanted: int, limit: float, level: float, caution: float = CAUTION) -> int | None:
    """Place of the cutoff to use, given (wanted, unwanted) documents that each cutoff rejects, the most lenient first."""
    best, place = 0.0, None
    for i, (wanted, unwanted) in enumerate(lenient_first):
        # The exact upper bound of the false rejection rate is within the limit if so few rejections are this unlikely at the limit.
        if not n_wanted or wanted > limit * n_wanted or binomial_cdf(wanted, n_wanted, limit) > level:
            break
        gain = unwanted / max(1, n_unwanted) - caution * wanted / n_wanted
        if gain > best:
            best, place = gain, i
    return place


def rule_values():
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbol_share": share("n_symbols", "word_chars"), "upper_share": share("n_upper", "n_letters"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "n_marked": F.col("n_marked").cast("double")}


def cutoff_path(rejected: dict[str, list[tuple[int, int]]], most: int) -> list[tuple[int, ...]]:
    """Steps from lenient to strict, each the places of all rules' cutoffs (-1: none).

    ``rejected`` has per rule and cutoff, lenient first, the (wanted, unwanted) learning documents beyond it. At step v a rule
    takes the strictest cutoff beyond which at most v wanted ones lie, or the most lenient that finds as many unwanted ones. Steps
    before v = 0 back off from its cutoffs, steps after it go on to v = ``most``.
    """

    def place(cuts, v):
        found = max((u for w, u in cuts if w <= v), default=0)
        return -1 if found < LEAST_GAIN else next(i for i, (_, u) in enumerate(cuts) if u == found)

    counts = sorted({0} | {w for cuts in rejected.values() for w, _ in cuts if w <= most})
    steps = [tuple(place(cuts, v) for cuts in rejected.values()) for v in counts]
    steps = [tuple(max(-1, p - back) for p in steps[0]) for back in range(BACK_OFF, 0, -1)] + steps
    return [step for step in dict.fromkeys(steps) if max(step) >= 0]


def choose_cutoffs(measured: DataFrame, labels: DataFrame, limit: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """One row per stratum with an accepted step: stratum and cut_<rule>, null for a rule without cutoff.

    Of a labelled doc_id with several texts, the one with the smallest key among those that pass the base rules counts. Labels are counted
    by level first, so the path and the test of a stratum see at most some two hundred rows.
    """
    import pyarrow as pa

    values, rules = rule_values(), list(RULES)
    held = measured.where(~_base_failed()).join(labels.select("doc_id", "wanted", "learn"), "doc_id")
    one = held.groupBy("doc_id", "wanted", "learn").agg(F.min(F.struct("k1", "k2", "stratum", *[v.alias(r) for r, v in values.items()])).alias("r"))
    base = settled(one.select("wanted", "learn", "r.stratum", *[F.col(f"r.{r}").alias(r) for r in rules]))
    sums = [F.sum(F.col("wanted").cast("int")).alias("wanted"), F.sum((~F.col("wanted")).cast("int")).alias("unwanted")]
    level = lambda rule: F.aggregate(F.array(*[F.lit(c) for c in RULES[rule]]), F.lit(0), lambda a, c: a + (F.col(rule) > c).cast("int"))
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in rules])
    learnt = base.where("learn").select("stratum", "wanted", F.explode(levels).alias("l")).groupBy("stratum", "l.rule", "l.level").agg(*sums)

    def lay_out(key, frame):
        rows = frame.to_pylist()
        rejected = {}
        for rule, cuts in RULES.items():
            mine = [r for r in rows if r["rule"] == rule]
            # Cutoffs fall, so a document of level v is beyond the v last ones.
            rejected[rule] = [tuple(sum(r[c] for r in mine if r["level"] >= len(cuts) - i) for c in ("wanted", "unwanted")) for i in range(len(cuts))]
        n = sum(r["wanted"] for r in rows if r["rule"] == rules[0])
        steps = cutoff_path(rejected, math.floor(limit * n))
        columns = {"stratum": pa.array([key[0].as_py()] * len(steps), pa.string()), "step": pa.array(range(len(steps)), pa.int32())}
        for i, rule in enumerate(rules):
            columns[f"cut_{rule}"] = pa.array([RULES[rule][s[i]] if s[i] >= 0 else None for s in steps], pa.float64())
        return pa.table(columns)

    names = [f"cut_{r}" for r in rules]
    paths = settled(learnt.groupBy("stratum").applyInArrow(lay_out, "stratum string, step int, " + ", ".join(f"{n} double" for n in names)))
    by_stratum = paths.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("step", *names))).alias("path"))
    beyond = lambda s: reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > s[f"cut_{r}"], F.lit(False)) for r in rules])
    # A document that a step rejects is rejected by all later ones.
    passed = base.where("not learn").join(by_stratum, "stratum").select("stratum", "wanted", F.size("path").alias("steps"), F.size(F.filter("path", lambda s: ~beyond(s))).alias("first"))
    counted = settled(passed.groupBy("stratum", "steps", "first").agg(*sums))
    strata = max(1, counted.select("stratum").distinct().count())

    def choose(key, frame):
        rows = frame.to_pylist()
        rejects = [tuple(sum(r[c] for r in rows if r["first"] <= i) for c in ("wanted", "unwanted")) for i in range(rows[0]["steps"])]
        place = accepted(rejects, sum(r["wanted"] for r in rows), sum(r["unwanted"] for r in rows), limit, error / strata)
        found = [] if place is None else [place]
        return pa.table({"stratum": pa.array([key[0].as_py()] * len(found), pa.string()), "step": pa.array(found, pa.int32())})

    chosen = counted.groupBy("stratum").applyInArrow(choose, "stratum string, step int")
    return settled(paths.join(chosen, ["stratum", "step"]).drop("step"))


def _base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ``stratum``): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``kept`` is false where a base rule fails or a feature exceeds its stratum's cutoff. A null or empty text has no words and fails; a
    missing stratum is one of its own; repeated rows get a row each; labels of no document, without doc_id or quality, and an
    empty label table are harmless. Other columns are ignored. k1 and k2 are keys of the row's id and text.
    """
    known = settled(wanted_labels(labels))
    marked = learn_marked(docs, known)
    with text_batches(docs.sparkSession):
        measured = settled(features(docs, stratum, marked))
    cutoffs = choose_cutoffs(measured, known, limit, error)
    exceeded = F.lit(False)
    for rule, value in rule_values().items():
        exceeded = exceeded | F.coalesce(value > F.col(f"cut_{rule}"), F.lit(False))
    # One row per stratum: broadcast while that is a small table, else a join that splits large strata.
    wide = F.broadcast(cutoffs) if cutoffs.count() <= 10_000 else cutoffs
    out = measured.join(wide, "stratum", "left").withColumn("base_failed", _base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~exceeded).alias("kept"), "k1", "k2")
