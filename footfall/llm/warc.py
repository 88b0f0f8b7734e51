"""WARC archives with a two-level capture index.

Tasks write archives of gzip members, one record each. The index sorts captures by reversed-host URL key into compressed
blocks, one index file per key range, each with a sparse directory of its blocks' first keys. A look-up goes to the index
file by the files' first keys, to the block by binary search in the directory, to the record by a range read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm import shared
from footfall.llm.urls import PARTS, host

LEAST_REVISIT = 100
BLOCK_LINES = 512
ARCHIVE_BYTES = 64 << 20
READ_AT_ONCE = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def capture_key(url: Column, page_id: Column) -> Column:
    """Host labels reversed, the rest of the URL, and the page id: sorts the captures of a domain together."""
    labels = F.array_join(F.reverse(F.split(host(url), r"\.")), ",")
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*", "")
    return F.concat(labels, F.lit(")"), rest, F.lit(" "), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")))


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, key, payload, digest, refers_to (null: a response). Only digests and ids are grouped; the payloads of
    rows under ``LEAST_REVISIT`` bytes, which are all responses, don't travel."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), capture_key(F.col("url"), F.col("page_id")).alias("key"))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = large.join(first, "digest").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first")))
    # A row without id can't be the smallest unless all lack one.
    joined = joined.withColumn("refers_to", F.when(F.col("page_id").isNull(), F.col("first")).otherwise(F.col("refers_to")))
    small = rows.where(F.octet_length("payload") < LEAST_REVISIT).withColumn("refers_to", F.lit(None).cast("bigint"))
    columns = ["page_id", "url", "key", "payload", "digest", "refers_to"]
    return joined.select(columns).unionByName(small.select(columns))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:page:{'-' if i is None else i}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the captures: key, uri, offset, length.

    A null html is an empty payload; a null page_id is written as "-". Of equal payloads the smallest page_id is the response; rows
    repeated with that id are all responses. Each attempt of a task writes files of its own and only the attempt that
    counts names them. Other columns are ignored; an empty table gives none.
    """
    folder = shared.shared_folder(pages.sparkSession)

    def write(batches):
        import pyarrow as pa

        held, size, captures = [], 0, []

        def flush():
            nonlocal held, size, captures
            uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            shared.write_file(uri, b"".join(held))
            keys, at, n = zip(*captures)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([uri] * len(keys)), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["key", "uri", "offset", "length"])
            held, size, captures = [], 0, []
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in zip(*[c.slice(i, 256).to_pylist() for c in batch.columns]):
                    page_id, url, key, payload, digest, refers_to = row
                    data = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to), 4, mtime=0)
                    captures.append((key, size, len(data)))
                    held.append(data)
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        yield flush()
        if captures:
            yield flush()

    return shared.settled(classified(pages).mapInArrow(write, "key string, uri string, offset bigint, length bigint"))


def write_index(captures: DataFrame) -> DataFrame:
    """Sort the captures into index files and return one row per file: uri, first_key, last_key, blocks, captures.

    Ranges are cut by (key, uri, offset), so captures of one key may spread over files.
    """
    folder = shared.shared_folder(captures.sparkSession)

    def write(batches):
        import pyarrow as pa

        lines, body, directory, first, last, n = [], [], [], None, None, 0

        def close():
            nonlocal lines
            block = zlib.compress("\n".join(lines).encode())
            directory.append([json.loads(lines[0])[0], sum(map(len, body)) if not directory else directory[-1][1] + directory[-1][2], len(block)])
            body.append(block)
            lines = []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                first = row[0] if first is None else first
                last = row[0]
                lines.append(json.dumps(row))
                n += 1
                if len(lines) == BLOCK_LINES:
                    close()
        if lines:
            close()
        if n:
            uri = f"{folder}/{uuid.uuid4().hex}.idx"
            shared.write_file(uri, b"".join(body))
            shared.write_file(f"{uri}.dir", zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_pydict({"uri": [uri], "first_key": [first], "last_key": [last], "blocks": [len(directory)], "captures": [n]})

    order = ["key", "uri", "offset"]
    placed = captures.select("key", "uri", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return shared.settled(placed.mapInArrow(write, "uri string, first_key string, last_key string, blocks bigint, captures bigint"))


def look_up(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, uri, offset, length of all captures of the wanted keys (column ``key``, distinct).

    The driver holds one first and last key per index file, no more; each task reads the directory of its own file.
    """
    files = sorted((r.first_key.encode(), r.last_key.encode(), r.uri) for r in index.collect())
    if not files:
        return wanted.sparkSession.createDataFrame([], "key string, uri string, offset bigint, length bigint")
    firsts, lasts, uris = [f[0] for f in files], [f[1] for f in files], [f[2] for f in files]

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            keys, to = [], []
            for key in batch.column(0).to_pylist():
                k = key.encode()
                for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)):
                    keys.append(key)
                    to.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(to, pa.int32())], names=["key", "file"])

    def find(batches):
        import pyarrow as pa

        at, block, held, store = None, None, {}, None
        for batch in batches:
            found = []
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i != at:
                    fs, path = shared.open_store(uris[i])
                    with fs.open_input_file(path + ".dir") as f:
                        directory = json.loads(zlib.decompress(f.read()))
                    starts, store, at, block = [d[0].encode() for d in directory], fs.open_input_file(path), i, None
                k = key.encode()
                j = max(0, bisect.bisect_left(starts, k) - 1)
                while j < len(starts) and starts[j] <= k:
                    if j != block:
                        lines = zlib.decompress(store.read_at(directory[j][2], directory[j][1])).decode().split("\n")
                        block, held = j, {}
                        for row in map(json.loads, lines):
                            held.setdefault(row[0], []).append(row)
                    found += held.get(key, [])
                    j += 1
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "uri", "offset", "length"])

    routed = wanted.select("key").mapInArrow(route, "key string, file int")
    dealt = routed.repartition(len(files), "file").sortWithinPartitions("file", "key")
    return dealt.mapInArrow(find, "key string, uri string, offset bigint, length bigint")


def read_records(captures: DataFrame, payloads: bool = False) -> DataFrame:
    """Range-read the captures' records: page_id, record_type, refers_to, stated_digest, payload_bytes, payload_digest, and the
    payload if asked for. Neighbouring ranges of an archive are read together. Size and digest are of the payload as read."""
    fields = "page_id bigint, record_type string, refers_to bigint, stated_digest string, payload_bytes bigint, payload_digest string" + ", payload binary" * payloads

    def spans(batches):
        """Lists of ranges (uri, offset, length) that lie side by side, up to a size."""
        run, size = [], 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if run and (r[0] != run[-1][0] or r[1] != run[-1][1] + run[-1][2] or size >= READ_AT_ONCE):
                    yield run
                    run, size = [], 0
                run.append(r)
                size += r[2]
        if run:
            yield run

    def read(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payloads]
        opened, archive = None, None
        for run in spans(batches):
            if run[0][0] != opened:
                store, path = shared.open_store(run[0][0])
                opened, archive = run[0][0], store.open_input_file(path)
            data, rows = archive.read_at(sum(r[2] for r in run), run[0][1]), []
            for _, offset, length in run:
                at = offset - run[0][1]
                head, payload = parse_record(gzip.decompress(data[at : at + length]))
                rows.append((_page(head["WARC-Record-ID"]), head["WARC-Type"], _page(head.get("WARC-Refers-To")), head["WARC-Payload-Digest"].removeprefix("sha256:"), len(payload), hashlib.sha256(payload).hexdigest(), *[payload] * payloads))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in fields.split(", ")])

    # The 16 MB slices of an archive go to tasks of their own.
    slices = F.floor(F.col("offset") / (16 << 20))
    dealt = captures.select("uri", "offset", "length").repartition("uri", slices).sortWithinPartitions("uri", "offset")
    return dealt.mapInArrow(read, fields)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, index them, look every page up and read its record back.

    A revisit has the size and digest of the response that it refers to.
    """
    captures = write_archives(pages)
    index = write_index(captures)
    wanted = pages.select(capture_key(F.col("url").cast("string"), F.col("page_id").cast("bigint")).alias("key")).distinct()
    read = shared.settled(read_records(look_up(index, wanted)))
    responses = read.where(F.col("record_type") == "response")
    full = responses.where(F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest")).agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = read.where(F.col("record_type") == "revisit").join(full, ["refers_to", "stated_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(columns).unionByName(revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to"))
