"""Bounded-space best-fit packing of documents into sequences.

A packer keeps a fixed number of open sequences in lists keyed by free space; a bitset of the non-empty lists finds the
tightest fit by its lowest set bit. When none fits and all places are taken, the fullest open one closes.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import shared
from footfall.llm.tokens import REMEMBERED, Encoder, texts_of

OPEN = 32_768
# Pieces that one packer sees; their number grows with the input, so does the number of packers.
PIECES_PER_PACKER = 100_000


class BestFit:
    """Places lengths one by one: ``put(length)`` gives the sequence's number and the offset in it."""

    def __init__(self, capacity: int, bins: int = OPEN):
        self.capacity, self.bins = capacity, bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present, self.open, self.made = 0, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        fits = self.present >> length
        if fits:
            room = (fits & -fits).bit_length() - 1 + length
            number = self._take(room)
        else:
            if self.open >= self.bins:
                self._take((self.present & -self.present).bit_length() - 1)
            room, number = self.capacity, self.made
            self.made += 1
        left = room - length
        if left:
            self.free[left].append(number)
            self.present |= 1 << left
            self.open += 1
        return number, self.capacity - room

    def _take(self, room: int) -> int:
        number = self.free[room].pop()
        self.open -= 1
        if not self.free[room]:
            self.present &= ~(1 << room)
        return number


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, spaces: str = "kept", remembered: int = REMEMBERED) -> DataFrame:
    """Encode each text and cut it: doc_id, piece, start, length, ids_crc32. A document of more than ``capacity`` ids becomes
    pieces of that length, the first taking what is left over. A null text has the end id only; repeated rows are kept.
    ``remembered`` bounds half the bytes of ids that a worker remembers.
    """

    def cut(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        encoder = Encoder.of(tokenizer, spaces, remembered)
        for batch in batches:
            for i, texts in texts_of(batch, "text"):
                out = [[], [], [], [], []]
                for d, data in zip(batch.column(0).slice(i, len(texts)).to_pylist(), encoder.ids(texts, end_id)):
                    n = len(data) // 4
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                        for column, value in zip(out, (d, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def place_pieces(pieces: DataFrame, capacity: int, bins: int = OPEN, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length and more). Lengths are 1 to ``capacity``.

    Only these small rows travel. Pieces are dealt by hash to packers of about ``per_packer`` pieces; each takes the
    longest first and in a fixed order, so a task that runs again gives the same rows. The share of unfilled
    sequences falls with the number of pieces a packer sees. An empty table gives none.
    """
    with shared.text_batches(pieces.sparkSession):
        pieces = shared.settled(pieces)
    packers = max(1, -(-pieces.count() // per_packer))
    columns = pieces.columns

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        packer, first = BestFit(capacity, bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.put(n) for n in batch.column(columns.index("length")).to_pylist()]
            more = [pa.array([first + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "sequence_id", "offset"])

    key = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    dealt = pieces.repartition(packers, key).sortWithinPartitions(F.desc("length"), key, "doc_id", "piece")
    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return dealt.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` ids."""
    return place_pieces(cut_pieces(docs, tokenizer, end_id, capacity, remembered=remembered), capacity)
