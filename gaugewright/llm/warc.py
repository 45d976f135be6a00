"""WARC archives of web pages and a two-level capture index.

Archives are ``.warc.gz`` files of bounded bytes, one gzip member a record, so that a record can be fetched by a range of
bytes. Records with equal payloads are stored once; the others revisit it. The index is sorted by reversed-host URL key
and dealt by ranges of keys into index files. An index file holds compressed blocks of capture lines (first level), then a
sparse directory of each block's first and last key (second level), then the directory's place. A lookup bisects the key
ranges of the index files, one row each; a task then reads the directory at a file's end, bisects it, reads the blocks it
names by their ranges, bisects their lines, and the records found are read by their ranges from the archives.

Tasks read and write these files through Arrow's file systems (local or mounted folders, HDFS, S3, GCS). Folders are named by
URI; one without a scheme belongs to Spark's default file system.
A task's files have fresh names and count only once Spark has committed the rows that list them, so tasks may be repeated
or lost; files of failed attempts stay behind unread.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import qualified, store
from .common import fresh_path, keep

END = b"\r\n\r\n"
BLOCK_LINES = 512
FILE_BYTES = 256 << 20  #: an archive file is closed when the next record would pass this
REQUEST_BYTES = 4 << 20  #: adjoining ranges are read together up to this
CHUNK_BYTES = 8 << 20  #: share of an archive that one task reads
DATE = "2020-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed-host sort key: ``http://www.a.com:80/X?q`` -> ``com,a)/x?q``; unparsable URLs sort by their text."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return text.lower()
    if not host:
        return text.lower()
    shown = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{shown}){parts.path or '/'}{query}".lower()


def target(url: str | None) -> str | None:
    """``url`` as records hold it, percent-encoded; index and lookups take their keys from this form."""
    return quote(url, safe=":/?#[]@!$&()*+,;=%~") if url else None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """Head of a record; ``refers_to`` makes it a revisit, which stores no payload."""
    again = refers_to is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target(url)}" if url else None, f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}" if again else None,
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None, f"WARC-Refers-To: <urn:page:{refers_to}>" if again else None,
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if again else size}",
    ]
    return "\r\n".join(x for x in lines if x).encode() + END


def _deflated(data: bytes, last: bool = False) -> bytes:
    """Raw deflate blocks that stand for themselves, so that pieces of a gzip member can be compressed apart."""
    squeeze = zlib.compressobj(wbits=-15)
    return squeeze.compress(data) + squeeze.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


_TAIL = _deflated(END, last=True)


def member(head: bytes, payload: bytes, packed: bytes) -> bytes:
    """One gzip member: head, payload (``packed`` is its deflated form) and the closing blank lines."""
    total = zlib.crc32(END, zlib.crc32(payload, zlib.crc32(head)))
    size = (len(head) + len(payload) + len(END)) & 0xFFFFFFFF
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + _deflated(head) + packed + _TAIL + struct.pack("<II", total, size)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one unpacked record; payloads may hold blank lines of their own."""
    body = data.index(END) + 4
    headers = dict(x.split(": ", 1) for x in data[: body - 4].decode().split("\r\n")[1:])
    end = body + int(headers["Content-Length"])
    if data[end:] != END:
        raise ValueError(f"record {headers['WARC-Record-ID']} has a wrong length")
    return headers, data[body:end]


def _page(text: str | None) -> int | None:
    found = re.search(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def capture(headers: dict[str, str], payload: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest); a stored payload is measured, a revisited one is known by its headers."""
    kind = headers["WARC-Type"]
    size, digest = (len(payload), payload_digest(payload)) if kind == "response" else (int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"))
    return _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, _page(headers.get("WARC-Refers-To")), size, digest


def key_of(url: str | None) -> str:
    """Index key of a URL, as records hold it."""
    return re.sub(r"\s", "%20", url_key(target(url)))


CAPTURES = "key string, page_id long, file string, offset long, length long"
_NAMES = ["key", "page_id", "file", "offset", "length"]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages(page_id, url, html, ...) as archives under ``path`` -> captures (key, page_id, file, offset, length), written.

    Of records with equal payloads of ``least_bytes`` or more, that with the largest page_id is the response; payloads are
    equal if length and SHA-256 are. Null html is an empty payload; rows with a null page_id only serve as response if no equal
    row has an id; repeated rows that share the largest page_id are all responses. Bytes that are no UTF-8 stay as they are
    in payloads and are replaced in URLs. A payload must fit a task; a file holds one record at least. Other columns are ignored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(2).to_pylist()
            sums, digests, packed = [hashlib.sha256(x).digest() for x in payloads], [payload_digest(x) for x in payloads], [_deflated(x) for x in payloads]
            sizes = [len(x) for x in payloads]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sums, pa.binary()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["page_id", "url", "sum", "digest", "size", "packed"])

    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    first = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("sum"), F.length(payload).cast("long").alias("size")).groupBy("sum", "size").agg(F.max("page_id").alias("keeper"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("binary").alias("url"), payload.alias("body"))
    marked = rows.mapInArrow(pack, "page_id long, url binary, sum binary, digest string, size long, packed binary").join(first, ["sum", "size"])  # payloads are compressed before they are shuffled
    again = F.coalesce((F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper"))) & F.col("keeper").isNotNull() & (F.col("size") >= least_bytes), F.lit(False))
    dealt = marked.select("page_id", "url", "digest", "size", F.when(again, F.col("keeper")).alias("refers_to"), F.when(~again, F.col("packed")).alias("packed"))

    path = qualified(pages.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = store(path)
        disk.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for page_id, url, digest, size, refers_to, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                url = url.decode(errors="replace") if url is not None else None
                body = zlib.decompressobj(-15).decompress(packed) if packed else b""
                data = member(header(page_id, url, digest, size, refers_to), body, packed or _deflated(b""))
                if out is None or (at and at + len(data) > file_bytes):
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = disk.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(data)
                found.append((key_of(url), page_id, name, at, len(data)))
                at += len(data)
            yield _table(found, _NAMES, _KINDS)
        if out is not None:
            out.close()

    return keep(dealt.mapInArrow(run, CAPTURES), "captures")


def scan_archives(files: DataFrame, path: str) -> DataFrame:
    """files(file) under ``path`` -> captures (key, page_id, file, offset, length): archives read from end to end, a record in memory at a time."""

    path = qualified(files.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found, begin, read = [], 0, 0
                with disk.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    left = b""
                    while left or (left := source.read(1 << 20)):
                        unpack, record = zlib.decompressobj(31), []
                        while not unpack.eof:
                            read += len(left)
                            record.append(unpack.decompress(left))
                            left = unpack.unused_data if unpack.eof else source.read(1 << 20)
                            if not left and not unpack.eof:
                                raise ValueError(f"{name} ends within a record")
                        read -= len(left)
                        headers, _ = parse(b"".join(record))
                        found.append((key_of(headers.get("WARC-Target-URI")), _page(headers["WARC-Record-ID"]), name, begin, read - begin))
                        begin = read
                yield _table(found, _NAMES, _KINDS)

    return files.select("file").distinct().mapInArrow(run, CAPTURES)


def build_index(captures: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write captures as index files under ``path``, and ``path``/parts with a row for each. Equal keys, however many, are spread over blocks and files."""
    spark = captures.sparkSession
    path = qualified(spark, path)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = store(path)
        disk.create_dir(folder, recursive=True)
        name, out, at, total = f"{uuid.uuid4().hex}.cdx", None, 0, 0
        directory: list[tuple[str, str, int, int]] = []
        lines: list[tuple[str, str]] = []

        def write(block: list[tuple[str, str]]) -> int:
            data = zlib.compress("\n".join(f"{k} {v}" for k, v in block).encode())
            directory.append((block[0][0], block[-1][0], at, len(data)))
            out.write(data)
            return len(data)

        for batch in batches:
            if batch.num_rows and out is None:
                out = disk.open_output_stream(f"{folder}/{name}", compression=None)
            total += batch.num_rows
            keys, *rest = (c.to_pylist() for c in batch.columns)
            lines += zip(keys, map(json.dumps, zip(*rest, strict=True)), strict=True)
            while len(lines) >= BLOCK_LINES:
                at += write(lines[:BLOCK_LINES])
                del lines[:BLOCK_LINES]
        if out is None:
            return
        if lines:
            at += write(lines)
        data = zlib.compress(json.dumps(directory).encode())
        out.write(data + struct.pack(">QQ", at, len(data)))
        out.close()
        row = (name, directory[0][0], directory[-1][1], len(directory), total)
        yield _table([row], ["part", "first_key", "last_key", "blocks", "captures"], [pa.string()] * 3 + [pa.int64()] * 2)

    order = ["key", "file", "offset"]
    ordered = captures.select(_NAMES).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, "part string, first_key string, last_key string, blocks long, captures long").write.parquet(f"{path}/parts")


def search(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """urls(url) -> captures (key, page_id, file, offset, length) of each distinct key, by bisection.

    The index files' key ranges, one row a file and as many files as the index had partitions, are bisected once per key;
    their directories and blocks are read by tasks. Repeated URLs count once; a null URL asks for captures without one.
    """
    index = qualified(spark, index)
    parts = spark.read.parquet(f"{index}/parts").orderBy("first_key", "last_key").collect()
    firsts, lasts, names = ([r[c] for r in parts] for c in ("first_key", "last_key", "part"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for url in batch.column(0).to_pylist():
                key = key_of(url.decode(errors="replace") if url is not None else None)
                found.update((names[k], key) for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)))
            yield _table(list(found), ["part", "key"], [pa.string()] * 2)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = store(index)
        part, source, directory, opened = None, None, [], (-1, [])
        for batch in batches:
            for name, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != part:
                    if source is not None:
                        source.close()
                    part, source, opened = name, disk.open_input_file(f"{folder}/{name}"), (-1, [])
                    at, size = struct.unpack(">QQ", source.read_at(16, source.size() - 16))
                    directory = json.loads(zlib.decompress(source.read_at(size, at)))
                low = bisect.bisect_left(directory, key, key=lambda x: x[1])
                high = bisect.bisect_right(directory, key, key=lambda x: x[0])
                for b in range(low, high):
                    if opened[0] != b:
                        opened = b, zlib.decompress(source.read_at(directory[b][3], directory[b][2])).decode().split("\n")
                    lines, found = opened[1], []
                    k = bisect.bisect_left(lines, f"{key} ", key=lambda x: x[: x.index(" ") + 1])
                    while k < len(lines) and lines[k].startswith(f"{key} "):
                        found.append((key, *json.loads(lines[k][len(key) + 1 :])))
                        k += 1
                    yield _table(found, _NAMES, _KINDS)

    wanted = urls.select(F.col("url").cast("binary").alias("url")).distinct().mapInArrow(place, "part string, key string").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, so that these small rows, each of which stands for reads, are not gathered in few tasks
    return wanted.repartition(n, "part").sortWithinPartitions("part", "key").mapInArrow(seek, CAPTURES)


def fetch(captures: DataFrame, archives: str, payloads: bool = True) -> DataFrame:
    """captures -> the same with url, record_type, refers_to, payload_bytes, payload_digest and, if asked, payload; only the records' ranges are read."""
    facts = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    archives = qualified(captures.sparkSession, archives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = store(archives)
        name, source = None, None

        def table(found: list[tuple]) -> pa.RecordBatch:
            return _table(found, ["key", "file", "offset", "length", *facts, *(["payload"] if payloads else [])], [*(_KINDS[i] for i in (0, 2, 3, 4)), *kinds, *([pa.binary()] if payloads else [])])

        for batch in batches:
            keys, files, offsets, lengths = (batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))
            cut = [0]
            for i in range(1, len(files)):
                if files[i] != files[i - 1] or offsets[i] != offsets[i - 1] + lengths[i - 1] or offsets[i] + lengths[i] - offsets[cut[-1]] > REQUEST_BYTES:
                    cut.append(i)
            found, held = [], 0
            for a, b in pairwise([*cut, len(files)]):
                if a == b:
                    continue
                if files[a] != name:
                    if source is not None:
                        source.close()
                    name, source = files[a], disk.open_input_file(f"{folder}/{files[a]}")
                data = memoryview(source.read_at(offsets[b - 1] + lengths[b - 1] - offsets[a], offsets[a]))
                for i in range(a, b):
                    headers, payload = parse(zlib.decompress(data[offsets[i] - offsets[a] : offsets[i] - offsets[a] + lengths[i]], 31))
                    found.append((keys[i], files[i], offsets[i], lengths[i], *capture(headers, payload), *([payload] if payloads else [])))
                    held += len(payload) if payloads else 0
                if held > REQUEST_BYTES:
                    yield table(found)
                    found, held = [], 0
            yield table(found)

    chunk = F.floor(F.col("offset") / CHUNK_BYTES)
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.repartition(n, "file", chunk).sortWithinPartitions("file", "offset")
    schema = "key string, file string, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    return dealt.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def lookup(spark: SparkSession, archives: str, index: str, urls: DataFrame, payloads: bool = True) -> DataFrame:
    """urls(url) -> the captures of each, read back through the index by ranges of bytes. Keys without captures give no row."""
    return fetch(search(spark, index, urls), archives, payloads)


def archive(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, str, str]:
    """Write archives and index to the shared folder, and return all pages' records, read back through the index, with the paths of both.

    A row stands for each row of pages(page_id, url, html, ...). Other columns are ignored; an empty table gives none.
    """
    spark = pages.sparkSession
    archives, index = fresh_path(spark, "warc"), fresh_path(spark, "warc-index")
    build_index(write_archives(pages, archives, least_bytes), index)
    return lookup(spark, archives, index, pages.select("url"), payloads=False), archives, index
