"""Repair of conversation structure: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

A row is one of nine symbols (must go, or role initial s/u/a/other, whole or truncated). Read from the last row to the first, the least
cost of finishing from each of four states is a vector whose entries differ by small constants, so without its minimum it is
one of a few. The tables hold for each such vector and each block of four symbols the vector before the block and the cost in
between (the Four-Russians method): a conversation is one look-up per block. Only the vectors at block ends are kept; for
the edits the blocks are expanded again, from their end, and read forwards, taking the least letter among equal costs.

Conversations of usual length are solved where their sorted rows pass by. Long ones are cut into ranges: each range becomes its
function on vectors, then on states; only these small functions are combined per conversation, and every range is edited by itself.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.shared import settled
from footfall.operators.scale import lookup_join, spread_join
from footfall.session import settle

BLOCK = 4
SYMBOLS = 9
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
# States: nothing yet, after the system row, after a user row, after an assistant row. What an inserted or reroled row leads to.
NEXT = (2, 2, 3, 2)
KEEP = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}
FINAL = (0, 4, 2, 0)
# Longer conversations, in characters and 100 for each row, are cut into ranges of about RANGE_SIZE.
LONG = 1 << 20
RANGE_SIZE = 32 << 20
BLANK = " \t\n\x0b\x0c\r"
ROWS = "conv_id bigint, part bigint, place bigint, edit string, copies bigint, fault string, turn bigint, old_role string, role string, text string"
ORDER = ["conv_id", "part", "place"]
DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row in a state, by letter: (letter, cost, next state)."""
    if symbol == 0:
        return [("D", DELETE, state)]
    cut, initial = divmod(symbol - 1, 4)
    kept = KEEP.get((initial, state))
    return [("D", DELETE, state)] + ([("K", CUT * cut, kept)] if kept is not None else []) + [("R", REROLE + CUT * cut, NEXT[state])]


def before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Least costs before a row from those after it; rows may be inserted before it."""
    out = [min(c + costs[q] for _, c, q in edits(symbol, s)) for s in range(4)]
    for _ in range(2):
        out = [min(x, INSERT + out[NEXT[s]]) for s, x in enumerate(out)]
    return tuple(out)


class Tables:
    """``vectors`` without their minimum, 0 is the one after the last row; steps by one symbol and by whole blocks, as bytes to look up."""

    def __init__(self, block: int = BLOCK):
        number, steps, todo = {FINAL: 0}, {}, [FINAL]
        for v in todo:
            for s in range(SYMBOLS):
                u = before(v, s)
                low = min(u)
                u = tuple(x - low for x in u)
                if u not in number:
                    number[u] = len(todo)
                    todo.append(u)
                steps[number[v], s] = (number[u], low)
        self.vectors, self.block = todo, block
        to, add = (np.array([[steps[v, s][i] for s in range(SYMBOLS)] for v in range(len(todo))], np.uint8) for i in (0, 1))
        self.to, self.add = to.tolist(), add.tolist()
        far, cost = to, add
        for _ in range(block - 1):
            # A symbol before the block: after[v, s, rest] is the step by s from where the rest leads.
            cost = (cost[:, None, :] + add[far].transpose(0, 2, 1)).reshape(len(todo), -1)
            far = to[far].transpose(0, 2, 1).reshape(len(todo), -1)
        assert len(todo) < 256 and cost.max() < 256
        self.far, self.cost = [bytes(x) for x in far], [bytes(x) for x in cost.astype(np.uint8)]

    def codes(self, symbols: bytes) -> tuple[int, list[int]]:
        """Number of symbols before the first whole block, and the blocks' numbers."""
        head = len(symbols) % self.block
        blocks = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, self.block).astype(np.int64)
        return head, (blocks @ SYMBOLS ** np.arange(self.block)[::-1]).tolist()

    def backward(self, symbols: bytes, vector: int = 0) -> tuple[int, int, list[int]]:
        """Vector before all symbols, cost in between, and the vectors after the head and after every block."""
        head, codes = self.codes(symbols)
        ends, total = [vector], 0
        for code in reversed(codes):
            total += self.cost[vector][code]
            vector = self.far[vector][code]
            ends.append(vector)
        for s in reversed(symbols[:head]):
            total += self.add[vector][s]
            vector = self.to[vector][s]
        return vector, total, ends[::-1]

    def forward(self, symbols: bytes, vector: int = 0, state: int = 0, last: bool = True) -> tuple[list[str], int]:
        """Letters per row, inserted rows first, and the state in the end; ``last`` adds what must be inserted there."""
        head = len(symbols) % self.block
        _, _, ends = self.backward(symbols, vector)
        letters, at = [], 0
        for stop, end in zip(range(head, len(symbols) + 1, self.block), ends):
            part = symbols[at:stop]
            held = [end]
            for s in reversed(part):
                held.append(self.to[held[-1]][s])
            held.reverse()
            for s, here, after in zip(part, held, held[1:]):
                now, then, low, word = self.vectors[here], self.vectors[after], self.add[after][s], ""
                while True:
                    found = [(x, q) for x, c, q in edits(s, state) if c + then[q] == low + now[state]]
                    if now[state] == INSERT + now[NEXT[state]] and (not found or found[0][0] > "I"):
                        word, state = word + "I", NEXT[state]
                        continue
                    letter, state = found[0]
                    letters.append(word + letter)
                    break
            at = stop
        if last:
            word = ""
            while FINAL[state]:
                word, state = word + "I", NEXT[state]
            letters.append(word)
        return letters, state


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def fault(text: str, seen: bool) -> str | None:
    bare = text.strip(BLANK)
    return "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else None


def symbol(role: str, what: str | None) -> int:
    if what in ("blank", "duplicate"):
        return 0
    return 1 + "sua?".index(role[:1] if role[:1] in ("s", "u", "a") else "?") + 4 * (what == "truncated")


def edited(conv_id, part: int, rows: list[tuple], letters: list[str], state: int) -> list[tuple]:
    """Rows of ROWS from rows (turn, role, text, fault, copies) with their letters; copies after the first go."""
    out = []

    def add(edit, copies, what, turn, old, role, text):
        out.append((conv_id, part, len(out), edit, copies, what, turn, old, role, text))

    def through(word):
        nonlocal state
        for _ in range(word.count("I")):
            state = NEXT[state]
            add("I", 1, None, None, None, "user" if state == 2 else "assistant", "")

    for (turn, role, text, what, copies), word in zip(rows, letters):
        through(word)
        if word[-1] == "D":
            add("D", copies if what == "blank" else 1, what, turn, role, None, text)
        elif word[-1] == "K":
            state = KEEP["sua".index(role[0]), state]
            add("K", 1, what, turn, role, role, text)
        else:
            state = NEXT[state]
            add("R", 1, what, turn, role, "user" if state == 2 else "assistant", text)
        if copies > 1 and what != "blank":
            add("D", copies - 1, "duplicate", turn, role, None, text)
    if len(letters) > len(rows):
        through(letters[-1])
    return out


def _batches(rows, at_once: int = 4096):
    """Arrow batches with the columns of ROWS."""
    import pyarrow as pa

    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in ROWS.split(", ")]
    schema = pa.schema(list(zip(names, kinds)))
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows_of(batches, at_once: int = 2048):
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            yield from zip(*[c.slice(i, at_once).to_pylist() for c in batch.columns])


def _conversations(rows):
    """(first value, rows) of sorted rows, one conversation after the other."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def _solve(batches):
    """Repair conversations that pass by whole: conv_id, turn, role, text, sorted."""

    def rows():
        for conv_id, group in _conversations(_rows_of(batches)):
            seen, found = set(), []
            for _, turn, role, text in group:
                what = fault(text, (role, text) in seen)
                seen.add((role, text))
                found.append((turn, role, text, what, 1))
            letters, _ = tables().forward(bytes(symbol(r[1], r[3]) for r in found))
            yield from edited(conv_id, 0, found, letters, 0)

    yield from _batches(rows())


def _turn_order(*names: str) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), *[F.col(n) for n in names]]


def _state_map(table, symbols: bytes, vector: int, last: bool) -> bytes:
    return bytes(table.forward(symbols, vector, q, last)[1] for q in range(4))


def _long(rows: DataFrame, size: int, range_size: int) -> DataFrame:
    """Rows of ROWS for long conversations, range by range. ``rows``: conv_id, turn, role, text; ``size`` is their total."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    content = [F.col("conv_id").isNull(), F.col("conv_id"), F.col("role"), F.col("text")]
    same = settled(same.withColumns({"h1": F.xxhash64(*content), "h2": F.xxhash64(F.lit(7), *content)}))
    # A message that comes in several turns: the first of them.
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    again = same.groupBy("h1", "h2").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = spread_join(same, again, ["h1", "h2"], "left")
    late = F.coalesce(F.col("first") != turn, F.lit(False))
    parts = max(1, -(-size // range_size))
    # Rows of a conversation that are alike in all columns are one row here, so any conversation is cut evenly.
    placed = met.select("conv_id", "turn", "role", "text", "copies", late.alias("late")).repartitionByRange(parts, *_turn_order()).sortWithinPartitions(*_turn_order("text"))
    placed = settle(placed.withColumn("part", F.spark_partition_id().cast("bigint")))

    def symbols(batches):
        """One row for each conversation of a range: its symbols, and its function on vectors."""
        import pyarrow as pa

        table = tables()
        for conv_id, group in _conversations(_rows_of(batches)):
            word = bytearray()
            for _, _, role, text, _, later, part in group:
                word.append(symbol(role, fault(text, later)))
            maps = bytes(table.backward(bytes(word), v)[0] for v in range(len(table.vectors)))
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv_id], pa.int64()), "part": [part], "symbols": [bytes(word)], "maps": [maps]}, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("symbols", pa.binary()), ("maps", pa.binary())]))

    ranges = settled(placed.mapInArrow(symbols, "conv_id bigint, part bigint, symbols binary, maps binary"))

    def chained(key, group):
        """Vector after each range, read from the last one: one small row per range."""
        import pyarrow as pa
        import pyarrow.compute as pc

        group = group.take(pc.sort_indices(group, [("part", "descending")]))
        vector, out = 0, []
        for maps in group["maps"].to_pylist():
            out.append(vector)
            vector = maps[vector]
        return pa.table({"conv_id": group["conv_id"], "part": group["part"], "vector": pa.array(out, pa.int64()), "last": pa.array([i == 0 for i in range(len(out))])})

    key = lambda df: df.withColumn("ck", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    vectors = ranges.select("conv_id", "part", "maps").groupBy("conv_id").applyInArrow(chained, "conv_id bigint, part bigint, vector bigint, last boolean")
    known = settled(key(ranges.drop("maps")).join(key(vectors).drop("conv_id"), ["ck", "part"]))

    def states(batches):
        import pyarrow as pa

        for batch in batches:
            maps = [_state_map(tables(), s, v, last) for s, v, last in zip(*[batch[c].to_pylist() for c in ("symbols", "vector", "last")])]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["part"], pa.array(maps, pa.binary())], names=["conv_id", "part", "maps"])

    def entered(key, group):
        import pyarrow as pa
        import pyarrow.compute as pc

        group = group.take(pc.sort_indices(group, [("part", "ascending")]))
        state, out = 0, []
        for maps in group["maps"].to_pylist():
            out.append(state)
            state = maps[state]
        return pa.table({"conv_id": group["conv_id"], "part": group["part"], "state": pa.array(out, pa.int64())})

    begins = known.mapInArrow(states, "conv_id bigint, part bigint, maps binary").groupBy("conv_id").applyInArrow(entered, "conv_id bigint, part bigint, state bigint")
    solved = known.join(key(begins).drop("conv_id"), ["ck", "part"])

    def rewrite(group, found):
        import pyarrow as pa

        one = {c: found[c][0].as_py() for c in ("symbols", "vector", "last", "state")}
        letters, _ = tables().forward(one["symbols"], one["vector"], one["state"], one["last"])
        rows = sorted(zip(*[group[c].to_pylist() for c in ("at", "turn", "role", "text", "copies", "late")]))
        done = edited(found["conv_id"][0].as_py(), found["part"][0].as_py(), [(t, r, x, fault(x, late), n) for _, t, r, x, n, late in rows], letters, one["state"])
        return pa.Table.from_batches(list(_batches(done)))

    # A range of one conversation is a bounded group; its rows carry their order.
    texts = key(placed.withColumn("at", F.monotonically_increasing_id()))
    return texts.groupBy("ck", "part").cogroup(solved.groupBy("ck", "part")).applyInArrow(rewrite, ROWS)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with made faults, by crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1 empties its text, 2 takes its
    ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space in the key, roles and texts. conv_id, turn, role, text remain."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def repair(conversations: DataFrame, long: int = LONG, range_size: int = RANGE_SIZE) -> DataFrame:
    """Every row and every inserted row with its edit: the columns of ROWS. Rows with a repaired ``role``, by (conv_id, part, place),
    are the repaired conversation; ``copies`` counts equal rows.

    Rows go by turn (nulls first), those of one turn by role and a hash of the text. Missing roles and texts count as one space; a
    missing conv_id is a conversation of its own. Blank and repeated rows go, roles other than s, u, a by initial can't stay. Very long
    texts, rows alike, empty tables and further columns are fine. Rows of a conversation are given in order within one task if it is short.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), name("role").alias("role"), name("text").alias("text"))
    ck = F.xxhash64(F.col("conv_id").isNull(), F.col("conv_id"))
    sizes = rows.groupBy(ck.alias("ck")).agg(F.sum(F.length("text") + F.lit(100)).alias("size"))
    large = settled(sizes.where(F.col("size") > long))
    size = large.agg(F.sum("size")).first()[0] or 0
    short = rows
    if size:
        marked = lookup_join(rows.withColumn("ck", ck), large.select("ck", F.lit(True).alias("long")), ["ck"], "left")
        short = marked.where("long is null").select(rows.columns)
    short = short.repartition("conv_id").sortWithinPartitions(*_turn_order("text")).mapInArrow(_solve, ROWS)
    if not size:
        return short
    return short.unionByName(_long(marked.where("long").select(rows.columns), size, range_size).repartition("conv_id").sortWithinPartitions(*ORDER))


def _digest(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in DIGEST.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    held: dict[str, list] = {n: [] for n in names}
    for conv_id, group in _conversations(_rows_of(batches)):
        count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        turns, low, high, illegal, cost, last, audit, digest, any_ = 0, None, None, 0, 0, None, [], hashlib.sha256(), False
        for _, _, _, edit, copies, what, turn, old, role, text in group:
            audit.append(edit * copies)
            cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] * copies
            if edit != "I":
                if what:
                    count[what] += copies
                cost += CUT * (edit != "D" and what == "truncated")
                initial = old[:1]
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                illegal += copies - 1
                last = initial
                if turn is not None:
                    turns += turn != high
                    low, high = turn if low is None else low, turn
            if role is not None:
                digest.update((("\n" if any_ else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                any_ = True
        gaps = 0 if low is None else high - low + 1 - turns
        for n, v in zip(names, (conv_id, gaps, *count.values(), illegal, cost, "".join(audit), digest.hexdigest())):
            held[n].append(v)
        if len(held["conv_id"]) >= 4096:
            yield pa.RecordBatch.from_pydict(held, schema=schema)
            held = {n: [] for n in names}
    if held["conv_id"]:
        yield pa.RecordBatch.from_pydict(held, schema=schema)


def digests(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` from the rows of ``repair``, which are used as they come, task by task. The hash of a whole
    conversation is one running sum over its rows: they stream by, none is held."""
    made = repaired.mapInArrow(_digest, DIGEST)
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    out = ids.join(made, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
