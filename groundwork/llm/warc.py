"""WARC archives by way of chunked record tables.

A payload is a run of rows (record, chunk number, bytes), never one large value: it is cut as soon as it is
read, with its SHA-1 carried from chunk to chunk, and what is moved to tell equal payloads are digests. Chunks
stay in the order and the place they were cut in; the writer streams them into compressed archives, and the
reader streams archives into such rows, carrying each record's SHA-1 and length along. Equal payloads become
one response and revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

#: Bytes of a payload in a row, and of archives before the next file begins, about.
CHUNK, FILE_BYTES = 1 << 16, 64 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def cut(pages: DataFrame, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The chunks of all payloads: part (of the table), rid (record within all), id, url, chunk_no, data and, at a
    record's last chunk, payload_bytes and sha1 (hex). Null payloads are empty; every record has chunk 0."""
    spark, buckets = pages.sparkSession, common.partitions(pages, 64 << 20)
    # One number for each bucket, so that a task's chunks make one sorted file, and tasks go round the buckets.
    found = spark.range(40 * buckets).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(buckets)).alias("b")).agg(F.min("i"))
    number = [r[1] for r in sorted(found.collect())]
    # Payloads come as characters; a row of them is turned to bytes a chunk's worth of characters at a time.
    three = pages.select(pages[f"`{id_col}`"].cast("long").alias("id"), pages[f"`{url_col}`"].cast("string").alias("url"), pages[f"`{payload_col}`"].cast("string").alias("payload"))

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        names = ["part", "rid", "id", "url", "chunk_no", "data", "payload_bytes", "sha1"]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string())
        rows: list[tuple] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for key, url, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                view = memoryview(value.as_buffer() or b"")
                digest, rid = hashlib.sha1(), (task << 33) + made
                made += 1
                for no, at in enumerate(range(0, max(len(view), 1), chunk)):
                    data = view[at : at + chunk]
                    digest.update(data)
                    last = at + chunk >= len(view)
                    rows.append((number[task % buckets], rid, key, url, no, bytes(data), len(view) if last else None, digest.hexdigest() if last else None))
                    held += len(data) + 200
                    if held > 1 << 22:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    chunks = common.mapped(three, run, "part int, rid long, id long, url string, chunk_no int, data binary, payload_bytes long, sha1 string")
    table = f"warc_chunks_{uuid.uuid4().hex}"
    writer = chunks.write.format("parquet").bucketBy(buckets, "part").sortBy("part", "rid", "chunk_no").option("compression", "zstd")
    writer.option("path", common.fresh(spark, "warc-chunks")).saveAsTable(table)
    return spark.table(table)


def decided(chunks: DataFrame, least: int = 0) -> DataFrame:
    """Per record: part, rid, payload_bytes, sha1, response_id. Of equal payloads of at least `least` bytes, the row
    with the largest id is the response that the others revisit. Null ids lose to any other."""
    heads = common.written(chunks.filter("sha1 is not null").select("part", "rid", "id", "payload_bytes", "sha1"), "warc-records")
    groups = heads.groupBy("sha1").agg(F.max("id").alias("response_id"), F.count("*").alias("copies"))
    out = common.joined_on_hot(heads, common.written(groups, "warc-groups"), "sha1", "copies")
    return out.select("part", "rid", "payload_bytes", "sha1", F.when(F.col("payload_bytes") >= least, F.col("response_id")).otherwise(F.col("id")).alias("response_id"))


def chunked(pages: DataFrame, least: int = 0, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The chunked record table of pages, to be written: id, url, response_id, payload_bytes, sha1, chunk_no, data,
    in order within partitions. Every record has chunk 0; revisits have no data."""
    chunks = cut(pages, chunk, id_col, url_col, payload_col)
    found = common.written(decided(chunks, least), "warc-decided")
    both = chunks.select("part", "rid", "id", "url", "chunk_no", "data").join(found.hint("merge"), ["part", "rid"])
    holds = F.col("id").eqNullSafe(F.col("response_id"))
    both = both.filter(holds | (F.col("chunk_no") == 0)).withColumn("data", F.when(holds, F.col("data")))
    return both.sortWithinPartitions("part", "rid", "chunk_no").select("id", "url", "response_id", "payload_bytes", "sha1", "chunk_no", "data")


def digest32(sha1_hex: str) -> str:
    """Bare upper-case base32 of a SHA-1."""
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record_uri(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}')}>"


def _http(payload_bytes: int) -> bytes:
    """The head that makes a payload the block of a response record."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _header(row: dict) -> bytes:
    revisit = row["id"] != row["response_id"]
    size = 0 if revisit else len(_http(row["payload_bytes"])) + row["payload_bytes"]
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_uri(row['id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((row['url'] or 'about:blank').splitlines())}",
        f"WARC-Payload-Digest: sha1:{digest32(row['sha1'])}",
        f"X-Page-Id: {'' if row['id'] is None else row['id']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_uri(row['response_id'])}", f"X-Refers-To-Page-Id: {row['response_id']}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def write(chunks: DataFrame, folder: str, level: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a chunked record table as .warc.gz files, one gzip member for each record; returns (name).

    A record begins at its chunk 0; the rows of a task are streamed as they come. Files carry the number of
    the task attempt, and only those of attempts that ended well are named."""

    def run(batches):
        from pyspark import TaskContext

        task, names = TaskContext.get(), []
        rows = (dict(zip(b.schema.names, v)) for b in batches for v in zip(*(c.to_pylist() for c in b.columns)))
        row = next(rows, None)
        while row is not None:
            name, written = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):05d}.warc.gz", 0
            with files.new_file(folder, name) as out:
                while row is not None and written < file_bytes:
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    left = row["payload_bytes"] if row["id"] == row["response_id"] else 0
                    written += out.write(gz.compress(_header(row) + (_http(left) if row["id"] == row["response_id"] else b""))) or 0
                    begun = False
                    while row is not None and not (begun and row["chunk_no"] == 0):
                        begun = True
                        if row["data"]:
                            left -= len(row["data"])
                            written += out.write(gz.compress(row["data"])) or 0
                        row = next(rows, None)
                    if left:
                        raise ValueError("a record's chunks don't add up to its payload")
                    written += out.write(gz.compress(b"\r\n\r\n") + gz.flush()) or 0
            names.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    spark, name = chunks.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition"
    had = spark.conf.get(name)
    spark.conf.set(name, "false")  # chunks stay in their buckets when records' decisions come to them
    try:
        return common.written(common.mapped(chunks, run, "name string"), "warc-files")
    finally:
        spark.conf.set(name, had)


def _inflated(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of all gzip members of a stream, some at a time."""
    z = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            out = z.decompress(data, size)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)


class _Reader:
    """Lines and exact numbers of bytes from pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        got = next(self.pieces, None)
        self.held += got or b""
        return got is not None

    def line(self) -> bytes | None:
        while b"\r\n" not in self.held:
            if not self.more():
                return None
        line, _, self.held = self.held.partition(b"\r\n")
        return line

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def stream(file, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive: header (dict of lower-case names), chunk_no, data, last; with `last` come
    sha1 and length of the payload as read, carried along chunk by chunk."""
    reader = _Reader(_inflated(file))
    while True:
        line = reader.line()
        while line == b"":
            line = reader.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        header = {}
        while line := reader.line():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            header[name.strip().lower()] = value.strip()
        digest, length, number, held, size = hashlib.sha1(), 0, 0, b"", int(header["content-length"])
        if size and header.get("content-type", "").startswith("application/http"):
            while line := reader.line():  # the payload begins behind the empty line
                size -= len(line) + 2
            size -= 2
        for part in reader.take(size):
            digest.update(part)
            length += len(part)
            held += part
            while len(held) > chunk:
                yield {"header": header, "chunk_no": number, "data": held[:chunk], "last": False}
                held, number = held[chunk:], number + 1
        yield {"header": header, "chunk_no": number, "data": held, "last": True, "sha1": digest, "length": length}


_FIELDS = "page_id long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, chunk_no int, last boolean, verified boolean"


def read(names: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = False) -> DataFrame:
    """The chunked record table of the archives: page_id, record_id, record_type, url, payload_bytes,
    payload_digest, refers_to, chunk_no, last, verified (at a response's last chunk: whether its bytes have
    the digest and length it states) and, if asked for, data."""
    spark = names.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = [f.split() for f in _FIELDS.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[k]) for n, k in kinds] + [("data", pa.binary())] * with_data)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with files.open_stream(folder, name) as file:
                    for c in stream(file, chunk):
                        h = c["header"]
                        revisit, digest = h["warc-type"] == "revisit", h["warc-payload-digest"].removeprefix("sha1:")
                        ok = None
                        if c["last"] and not revisit:
                            ok = digest == base64.b32encode(c["sha1"].digest()).decode() and c["length"] == int(h["x-payload-length"])
                        rows.append({"page_id": int(h["x-page-id"]) if h["x-page-id"] else None, "record_id": h["warc-record-id"], "record_type": h["warc-type"], "url": h["warc-target-uri"], "payload_bytes": int(h["x-payload-length"]), "payload_digest": digest, "refers_to": int(h["x-refers-to-page-id"]) if revisit else None, "chunk_no": c["chunk_no"], "last": c["last"], "verified": ok} | ({"data": c["data"]} if with_data else {}))
                        size += len(c["data"]) if with_data else 200
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return common.mapped(names.repartition(parts, "name"), run, _FIELDS + ", data binary" * with_data)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages as WARC records and read the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Bytes that don't match their digest raise.

    Null html is an empty payload, and empty payloads are equal ones. Rows repeated with id and payload are
    each a response. An empty table gives no rows. Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = common.fresh(spark, "warc")
    table = read(write(chunked(pages, least), folder), folder)
    sound = F.when(F.coalesce("verified", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    return table.filter("last").select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


#: Hex to base32 by SQL: 160 bits are 32 groups of 5.
ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS response_id FROM p),
d AS (
  SELECT s, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT), 1), '' ORDER BY i) AS payload_digest
  FROM (SELECT s, (unhex(s))::BIT::VARCHAR AS b FROM (SELECT DISTINCT s FROM p)), range(32) AS r(i) GROUP BY s
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
FROM w JOIN d USING (s)
"""
