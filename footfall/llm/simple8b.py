"""Token files: document ids in order, token ids in Simple-8b words, offsets per block.

A 64-bit word holds a 4-bit selector and 60 bits of ids: the selector says how many ids of which width it packs. An id of
60 bits or more is an escape: its word holds a place in a list of plain 64-bit values, so every word can be decoded on its
own and a block decodes in a few array operations. Blocks of 1,024 ids start at listed words; a range of ids reads only its
blocks.

File, all little-endian: header (magic, ids per block, documents, ids, words, escapes, 8 bytes each); words; first word of
each block and the number of words; escapes; document ids; null flags of the document ids; ids up to each document's end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm import shared
from footfall.llm.tokens import Encoder, texts_of

MAGIC = b"FFS8B\x00\x00\x01"
HEADER = struct.Struct("<8s5Q")
BLOCK = 1024
# Fixed values of the coding: ids per word and bits per id, by selector. 0 is a run of zeros, 15 an escape.
COUNTS = np.array([240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 15
# Ids gathered in a task before they go to a file; bounds its memory.
FILE_IDS = 1_000_000


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and their number), escapes. Greedy: each word takes as many ids as fit."""
    ids = np.asarray(ids, dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    limits = np.array([1 << int(b) for b in (*BITS[:14], 60)], dtype=np.uint64)
    kind = np.full((blocks, BLOCK), 99, dtype=np.uint8)
    # The first selector whose width holds the id; 99 after the last id, so that no word reaches there.
    kind.reshape(-1)[:n] = np.searchsorted(limits, ids, side="right")
    need = np.concatenate([kind, np.full((blocks, 256), 99, np.uint8)], axis=1)
    widest = {1: need}
    for c in (2, 4, 8, 16, 32, 64, 128):
        half = widest[c // 2]
        widest[c] = np.maximum(half, np.roll(half, -(c // 2), axis=1))
    choice = np.where(kind == ESCAPE, ESCAPE, 14).astype(np.uint8)
    for s in range(13, -1, -1):
        c = int(COUNTS[s])
        base = 1 << (c.bit_length() - 1)
        most = np.maximum(widest[base][:, :BLOCK], widest[base][:, c - base : c - base + BLOCK])
        choice[most <= s] = s
    flat, jump = choice.reshape(-1), COUNTS
    place = np.arange(blocks, dtype=np.int64) * BLOCK
    stop = np.minimum(place + BLOCK, n)
    rows, starts = np.arange(blocks), []
    # All blocks advance together, a word at a time.
    while len(rows):
        at = place[rows]
        starts.append(at)
        place[rows] = at + jump[flat[at]]
        rows = rows[place[rows] < stop[rows]]
    at = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    selector = flat[at]
    words = selector.astype(np.uint64) << np.uint64(60)
    escapes = ids[at[selector == ESCAPE]]
    words[selector == ESCAPE] |= np.arange(len(escapes), dtype=np.uint64)
    for s in range(1, ESCAPE):
        mine = np.flatnonzero(selector == s)
        for j in range(int(COUNTS[s]) if len(mine) else 0):
            words[mine] |= ids[at[mine] + j] << np.uint64(int(BITS[s]) * j)
    first = np.searchsorted(at, np.arange(blocks + 1) * BLOCK).astype(np.uint64)
    return words, first, escapes


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """Ids of whole blocks, all words at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    which = np.repeat(np.arange(len(words)), counts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    bits = BITS[selector][which]
    mask = (np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1)
    ids = (words[which] >> (bits * nth).astype(np.uint64)) & mask
    far = np.flatnonzero(selector[which] == ESCAPE)
    ids[far] = escapes[ids[far].astype(np.int64)]
    return ids


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, first, escapes = pack(ids)
    parts = [
        HEADER.pack(MAGIC, BLOCK, len(doc_ids), len(ids), len(words), len(escapes)),
        words.astype("<u8").tobytes(), first.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.cumsum(np.array(lengths, dtype=np.int64)).astype("<u8").tobytes(),
    ]
    return b"".join(parts)


class TokenFile:
    """A token file opened for ranges: reads the header and the tables, then only the words of the blocks asked for."""

    def __init__(self, uri: str):
        store, path = shared.open_store(uri)
        self.file = store.open_input_file(path)
        magic, self.block, self.docs, self.n, self.words, self.escaped = HEADER.unpack(self._at(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        blocks = -(-self.n // self.block)
        at = HEADER.size + 8 * self.words
        sizes = [8 * (blocks + 1), 8 * self.escaped, 8 * self.docs, self.docs, 8 * self.docs]
        tail = self._at(at, sum(sizes))
        cut = np.cumsum([0, *sizes])
        part = [tail[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.first, self.escapes = np.frombuffer(part[0], "<u8").astype(np.int64), np.frombuffer(part[1], "<u8")
        null = np.frombuffer(part[3], np.uint8)
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(part[2], "<i8"), null)]
        self.stops = np.frombuffer(part[4], "<u8").astype(np.int64)

    def _at(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        a, b = start // self.block, -(-stop // self.block)
        low, high = self.first[a], self.first[b]
        words = np.frombuffer(self._at(HEADER.size + 8 * int(low), 8 * int(high - low)), "<u8")
        return unpack(words, self.escapes)[start - a * self.block : stop - a * self.block]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, spaces: str = "dropped", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write token files in ascending doc_id order to the shared folder.

    Returns one row per file: part, number, uri, n_docs, n_ids; (part, number) ascends with doc_id. Rows are dealt in ranges of
    (doc_id, hash of the text), so many rows of one doc_id spread; null ids come first, a null text has the end id only,
    repeated rows are kept. Extra columns are ignored. Files don't depend on how often a task runs.
    """
    spark = docs.sparkSession
    folder = shared.shared_folder(spark)

    def write(batches):
        from pyspark import TaskContext
        import pyarrow as pa

        part, number = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(tokenizer, spaces)
        names, lengths, held, size = [], [], [], 0

        def flush():
            nonlocal number, names, lengths, held, size
            uri = f"{folder}/part-{part:06d}-{number:05d}.s8b"
            shared.write_file(uri, file_bytes(names, lengths, np.frombuffer(b"".join(held), "<u4")))
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "number": [number], "uri": [uri], "n_docs": [len(names)], "n_ids": [size]},
                schema=pa.schema([("part", pa.int64()), ("number", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )
            number, names, lengths, held, size = number + 1, [], [], [], 0
            return row

        for batch in batches:
            doc_ids = batch.column(0)
            for i, texts in texts_of(batch, "text"):
                for d, data in zip(doc_ids.slice(i, len(texts)).to_pylist(), encoder.ids(texts, end_id)):
                    names.append(d)
                    lengths.append(len(data) // 4)
                    held.append(data)
                    size += lengths[-1]
                    if size >= file_ids:
                        yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = F.xxhash64("text")
    placed = rows.repartitionByRange(F.col("doc_id").asc(), spread.asc()).sortWithinPartitions("doc_id", spread, "text")
    return shared.settled(placed.mapInArrow(write, "part bigint, number bigint, uri string, n_docs bigint, n_ids bigint"))


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, uri, file_start.

    ``start`` counts the ids of all documents in files before it: the running sum needs one row per file, no more.
    """
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("uri", pa.string()), ("file_start", pa.int64())])
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(uri)
                starts = np.concatenate([[0], f.stops[:-1]]).astype(np.int64)
                crcs, i = [], 0
                while i < f.docs:
                    # Some whole documents at a time, a longer one alone.
                    j = max(i + 1, int(np.searchsorted(f.stops, starts[i] + 64 * BLOCK, side="right")))
                    ids = f.ids(int(starts[i]), int(f.stops[j - 1])).astype("<u4")
                    crcs += [zlib.crc32(ids[a - starts[i] : b - starts[i]]) for a, b in zip(starts[i:j], f.stops[i:j])]
                    i = j
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids, pa.int64()), pa.array(starts + base), pa.array(f.stops - starts), pa.array(crcs, pa.int64()), pa.array([uri] * f.docs), pa.array(starts)], schema=schema
                )

    n = max(1, files.count())
    return placed.select("uri", "base").repartition(n, "uri").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, uri string, file_start bigint")
