"""WARC archives of pages, and a two-level capture index over them.

Archives are written by Spark's text writer, one gzip member a record, so that its commit protocol holds if tasks are
lost or repeated; the line separator between two records is an empty gzip member, which readers of .warc.gz skip. Of
pages with equal payloads the one with the smallest id is a response record and the others are revisits of it. Which is
which is known from ids and digests alone: the repeated digests are sent to the tasks (up to `SENT` of them; beyond
that they are joined by a shuffle).

The index is made by reading the archives back. Its keys are the URL with its host reversed ("com,example,www)/path")
and the record's page id; sorted over range partitions they are packed into compressed blocks of `BLOCK_KEYS` keys,
which lie one after the other in index files like records in archives. A sparse directory has the first and last key of
each block with its file, offset and length, and above it there is one range of keys a partition. A lookup searches
the ranges, then the directory, reads the one block, searches that, each by bisection, and yields file, offset and
length; records are then read from their files at these ranges. No archive or block content is ever shuffled.

Ranges are read through Arrow's file systems (local, HDFS, S3, GCS, ABFS).

Defined results: a null payload counts as empty; a null URL has no target and the key "-"; rows with equal ids and
payloads are all responses if theirs is the smallest id, and are returned each; a null page id is the smallest only
among null ids; an empty table gives empty archives, index and results; further columns are ignored. A very long
payload is one record, of which a task holds a few copies.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, new_shared_path

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID_PREFIX = "urn:page:"
#: An empty gzip member; fixed bytes of the format.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
RECORDS_PER_FILE, BLOCK_KEYS, KEYS_PER_PART = 2000, 256, 50_000
#: Partitions of the index, and so ranges in its upper level; repeated digests that are sent to tasks; bytes read at once.
LEAST_PARTS, MOST_PARTS, SENT, READ_AT_ONCE = 32, 4096, 1_000_000, 1 << 22


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def escape(url: str) -> str:
    """A URL as a header value: blanks, control characters and the percent sign are percent-encoded."""
    return "".join(c if c > " " and c not in "%\x7f\x85  " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, in lower case, and without scheme and fragment."""
    if url is None:
        return "-"
    rest = url.partition("://")[2] or url
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:] or "/")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Key of the index; the id is padded so that its order as text is that of the numbers."""
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no payload, but the digest and length of what it stands for."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + payload if refers_to is None else HTTP
    head = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {escape(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def members(read, size: int) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and unpacked bytes of each gzip member of a file; empty ones are passed over. read: some bytes from an offset."""
    at, step = 0, 1 << 16
    while at < size:
        unpacker, out, end = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if end >= size:
                raise ValueError("file ends within a member")
            part = read(end, step)
            out.append(unpacker.decompress(part))
            end += len(part)
        end -= len(unpacker.unused_data)
        if raw := b"".join(out):
            yield at, end - at, raw
        at = end


class Ranges:
    """Reads ranges of files; neighbouring ones come from one read of READ_AT_ONCE bytes."""

    def __init__(self) -> None:
        self.path, self.file, self.size, self.at, self.held = None, None, 0, 0, b""

    def open(self, path: str) -> None:
        if path != self.path:
            from pyarrow import fs

            self.close()
            system, name = fs.FileSystem.from_uri(path)
            self.file = system.open_input_file(name)
            self.path, self.size, self.at, self.held = path, self.file.size(), 0, b""

    def read(self, offset: int, length: int) -> bytes:
        if not self.at <= offset <= offset + length <= self.at + len(self.held):
            self.at, self.held = offset, self.file.read_at(min(max(length, READ_AT_ONCE), self.size - offset), offset)
        return self.held[offset - self.at : offset - self.at + length]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.path, self.file = None, None


def page_number(header: str | None) -> int | None:
    number = (header or "").removeprefix("<" + ID_PREFIX).removesuffix(">")
    return int(number) if number else None


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row below `path`."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    first = materialize(pages.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-payloads")
    marked = pages.join(F.broadcast(first) if first.count() <= SENT else first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = marked.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("payload")).alias("known"))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                c = [x.to_pylist() for x in batch.slice(at, 256).columns]
                made = [record(i, u, p if r is None else k, r) for i, u, p, r, k in zip(*c)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    write_members(rows.mapInArrow(pack, "record binary"), path, RECORDS_PER_FILE)


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """path of each file that Spark wrote below a folder."""
    return spark.read.format("binaryFile").load(path).select("path")


def files_read(files: DataFrame, of_member, schema: str, arrow_schema: pa.Schema) -> DataFrame:
    """One row for each gzip member of the files. of_member(path, offset, length, unpacked): its values."""

    def run(batches):
        ranges = Ranges()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                ranges.open(path)
                rows = []
                for offset, length, raw in members(lambda at, n: ranges.read(at, min(n, ranges.size - at)), ranges.size):
                    rows.append(of_member(path, offset, length, raw))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)
        ranges.close()

    return files.mapInArrow(run, schema)


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """key, path, offset and length of each record, from reading the archives."""

    def entry(name: str, offset: int, length: int, raw: bytes) -> dict:
        headers, _ = parse(raw)
        target = headers.get("WARC-Target-URI")
        return {"key": capture_key(None if target is None else unquote_to_bytes(target).decode(), page_number(headers["WARC-Record-ID"])), "path": name, "offset": offset, "length": length}

    types = pa.schema([("key", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    return files_read(written_files(spark, path), entry, "key string, path string, offset long, length long", types)


def build_index(entries: DataFrame) -> DataFrame:
    """The directory: part, first and last key of each block, and the block's file, offset and length; blocks and directory are written to the shared folder."""
    spark = entries.sparkSession
    entries = materialize(entries.select(F.translate("key", "\t\n", "  ").alias("key"), "path", "offset", "length"), "captures")
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-entries.count() // KEYS_PER_PART)))

    def pack(batches):
        from pyspark import TaskContext

        part, lines = f"{TaskContext.get().partitionId()}\n", []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([zip_text(part + "\n".join(lines))], pa.binary())], names=["block"])
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                lines.append("\t".join(map(str, row)))
                if len(lines) == BLOCK_KEYS:
                    yield packed()
                    lines = []
        if lines:
            yield packed()

    ordered = entries.repartitionByRange(parts, "key", "path", "offset").sortWithinPartitions("key", "path", "offset")
    path = new_shared_path(spark, "capture-blocks")
    write_members(ordered.mapInArrow(pack, "block binary"), path, 1 << 20)

    def block(name: str, offset: int, length: int, raw: bytes) -> dict:
        part, *lines = raw.decode().split("\n")
        return {"part": int(part), "first_key": lines[0].split("\t")[0], "last_key": lines[-1].split("\t")[0], "path": name, "offset": offset, "length": length}

    types = pa.schema([("part", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    found = files_read(written_files(spark, path), block, "part int, first_key string, last_key string, path string, offset long, length long", types)
    return materialize(found, "capture-directory")


def zip_text(text: str) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(text.encode()) + packer.flush()


def write_members(packed: DataFrame, path: str, per_file: int) -> None:
    """Write a column of gzip members to files below `path`."""
    lines = packed.select(F.col(packed.columns[0]).cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", per_file).text(path)


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """key, path, offset and length of every capture of the given keys (one column, each key once).

    A task gets the directory of some partitions, which MOST_PARTS and BLOCK_KEYS keep small, and then their keys in order.
    """
    spark = index.sparkSession
    bounds = index.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("low", "high").collect()
    sent = spark.sparkContext.broadcast(([r["low"] for r in bounds], [r["high"] for r in bounds], [r["part"] for r in bounds]))

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series) -> pd.Series:
        low, high, part = sent.value
        return key.map(lambda k: part[bisect_left(high, k) : bisect_right(low, k)])

    placed = keys.select(F.explode(parts_of("key")).alias("part"), F.lit(1).alias("wanted"), F.col("key").alias("first_key"))
    blocks = index.select("part", F.lit(0).alias("wanted"), "first_key", "last_key", "path", "offset", "length")
    both = blocks.unionByName(placed, allowMissingColumns=True).repartition(max(len(bounds), 1), "part").sortWithinPartitions("part", "wanted", "first_key", "path", "offset")
    types = pa.schema([("key", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def search(batches):
        ranges, part, directory, opened = Ranges(), None, ([], [], []), {}
        for batch in batches:
            out = []
            for own, wanted, first, last, path, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if own != part:
                    part, directory, opened = own, ([], [], []), {}
                first_keys, last_keys, places = directory
                if not wanted:
                    first_keys.append(first)
                    last_keys.append(last)
                    places.append((path, offset, length))
                    continue
                for b in range(bisect_left(last_keys, first), bisect_right(first_keys, first)):
                    if b not in opened:
                        ranges.open(places[b][0])
                        lines = [x.split("\t") for x in zlib.decompress(ranges.read(*places[b][1:]), 31).decode().split("\n")[1:]]
                        opened = {b: ([x[0] for x in lines], lines)} if len(opened) > 4 else opened | {b: ([x[0] for x in lines], lines)}
                    names, lines = opened[b]
                    out += [{"key": first, "path": x[1], "offset": int(x[2]), "length": int(x[3])} for x in lines[bisect_left(names, first) : bisect_right(names, first)]]
            yield pa.RecordBatch.from_pylist(out, schema=types)
        ranges.close()

    return both.mapInArrow(search, "key string, path string, offset long, length long")


def read_captures(captures: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for revisits), digest and payload length of the captures.

    The ranges of a file come together and in order, and are read from it; a file has RECORDS_PER_FILE records at most.
    """
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])

    def cut(batches):
        ranges = Ranges()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                for path, offset, length in zip(*[c.to_pylist() for c in batch.slice(at, 128).columns]):
                    ranges.open(path)
                    headers, payload = parse(zlib.decompress(ranges.read(offset, length), 31))
                    target, own = headers.get("WARC-Target-URI"), headers["WARC-Type"] == "response"
                    rows.append({
                        "page_id": page_number(headers["WARC-Record-ID"]), "url": None if target is None else unquote_to_bytes(target).decode(), "record_type": headers["WARC-Type"], "refers_to": page_number(headers.get("WARC-Refers-To")),
                        "payload": payload.decode() if own else None, "payload_digest": digest_of(payload) if own else headers["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": len(payload) if own else int(headers["X-Payload-Length"]),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=types)
        ranges.close()

    placed = captures.select("path", "offset", "length").repartition("path").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(cut, "page_id long, url string, record_type string, refers_to long, payload string, payload_digest string, payload_bytes long")


def capture_keys(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The distinct index keys of rows with an id and a URL."""

    @F.pandas_udf("string")
    def key(url: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u, int(p) if p else None) for u, p in zip(url, page)], dtype=object)

    return df.select(F.translate(key(F.col(url_col), F.col(id_col).cast("string")), "\t\n", "  ").alias("key")).distinct()


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write archives and index of the pages, look every page up in the index, and read its record."""
    spark = df.sparkSession
    path = new_shared_path(spark, "archives")
    write_archives(df, path, id_col, url_col, payload_col)
    index = build_index(archive_entries(spark, path))
    return read_captures(lookup(index, capture_keys(df, id_col, url_col)))
