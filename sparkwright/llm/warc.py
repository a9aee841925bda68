"""WARC archives in seekable Zstandard bundles: writing, reading whole and looking up single records.

A bundle is a file of independent Zstandard frames, each of whole WARC records, with the seek table of the public seekable format
in a skippable frame at its end; any Zstandard tool reads it from front to back as WARC. The index maps a record to its bundle,
its frame and its offset inside of the decompressed frame, so a lookup reads the seek table and one frame.

Bundles are written by tasks into a folder that driver and executors share (any file system that pyarrow opens by URI). Each
attempt of a task writes files with names of its own; the index, a Parquet table that Spark commits, names the files that count,
so repeated, speculative and lost tasks leave at most files that no reader looks at. A task holds one frame, not a bundle.

Payloads that are equal are stored once: thin rows of digests and ids are grouped for that, and pages look up their group.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import HOT, checkpoint_folder, cut, text_bytes, written

#: Fixed values of the seekable Zstandard format: skippable frame that holds the table, end mark.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"


def _file(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class BundleWriter:
    """One bundle: frames as they fill, the seek table when closed."""

    def __init__(self, uri: str, level: int):
        import zstandard

        system, path = _file(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.size = 0

    def frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.sizes.append((len(packed), len(content)))
        self.size += len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        end = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(end)) + table + end)
        self.out.close()


class BundleReader:
    """Frames of one bundle by number, through the seek table."""

    def __init__(self, uri: str):
        import zstandard

        system, path = _file(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, _, mark = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if mark != SEEKABLE:
            raise ValueError(f"{uri} ends without a seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(count)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        packed, whole = self.sizes[number]
        return self.unpacker.decompress(self.file.read_at(packed, self.starts[number]), max_output_size=whole)


def _uri(url: str | None) -> str | None:
    """A URL that fits one header line: control characters and spaces are percent-encoded."""
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _name(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def record_bytes(page_id: int | None, url: str | None, date: str, digest: str, size: int, refers: str | None, payload: bytes) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, with the length of the payload that is not stored again."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{_name(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if (target := _uri(url)) is not None:
        head.insert(3, f"WARC-Target-URI: {target}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(content: bytes, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """(headers in lower case, HTTP head, payload, end) of the record that begins at `at`."""
    end = content.index(b"\r\n\r\n", at)
    lines = content[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    body, stop = end + 4, end + 4 + int(head["content-length"])
    cut_at = content.index(b"\r\n\r\n", body, stop) + 4
    return head, content[body:cut_at], content[cut_at:stop], stop + 4


def _writer(folder: str, date: str, frame_bytes: int, bundle_bytes: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, uri, held, size, ids = None, "", [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal held, size, ids
            number = len(bundle.sizes)
            bundle.frame(b"".join(held))
            ends, at = [], 0
            for record in held:
                ends.append((at, len(record)))
                at += len(record)
            arrays = [pa.array([_name(i) for i in ids], pa.string()), pa.array(ids, pa.int64()), pa.array([uri] * len(ids), pa.string())]
            arrays += [pa.array([number] * len(ids), pa.int32()), pa.array([a for a, _ in ends], pa.int64()), pa.array([n for _, n in ends], pa.int64())]
            held, size, ids = [], 0, []
            return pa.RecordBatch.from_arrays(arrays, names=["record_id", "page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "refers", "refers_to")]
            for page, url, digest, length, refers, other, payload in zip(*columns, text_bytes(batch.column("html"))):
                if bundle is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(uri, level)
                record = record_bytes(page, url, date, digest, length, _name(other) if refers else None, payload)
                held.append(record)
                ids.append(page)
                size += len(record)
                if size >= frame_bytes:
                    yield flush()
                    if bundle.size >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if held:
            yield flush()
        if bundle is not None:
            bundle.close()

    return write


def _fields(head: dict[str, str], http: bytes, payload: bytes) -> tuple:
    digest = head["warc-payload-digest"].partition(":")[2]
    kind, number = head["warc-type"], lambda name: int(n) if (n := name.strip("<>").rpartition(":")[2]) else None
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} does not fit its digest")
        size, other, text = len(payload), None, payload.decode()
    else:
        size, other, text = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), number(head["warc-refers-to"]), None
    return number(head["warc-record-id"]), head.get("warc-target-uri"), kind, size, digest, other, text


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
_NAMES = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _read_bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("bundle").to_pylist():
            bundle = BundleReader(uri)
            for number in range(len(bundle.sizes)):
                content, at, rows = bundle.frame(number), 0, []
                while at < len(content):
                    head, http, payload, at = parse_record(content, at)
                    rows.append(_fields(head, http, payload))
                yield _batch(rows)


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single records; rows are sorted by bundle and frame, so a frame is read once for all records asked from it."""
    uri, bundle, number, content = None, None, None, b""
    for batch in batches:
        rows = []
        for path, frame, offset, length in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")]):
            if path != uri:
                uri, bundle, number = path, BundleReader(path), None
            if frame != number:
                number, content = frame, bundle.frame(frame)
            rows.append(_fields(*parse_record(content[offset : offset + length], 0)[:3]))
        if rows:
            yield _batch(rows)


#: Groups of copies up to this number are broadcast (some 120 bytes each).
MOST_GROUPS = 100_000


def with_revisits(pages: DataFrame, least: int, most: int = MOST_GROUPS) -> DataFrame:
    """pages (page_id, url, html) with `digest`, `size`, `refers` (a revisit?) and `refers_to` (the page it revisits).

    Up to `most` groups of copies are broadcast, and pages are not shuffled. Beyond that pages are shuffled once by their group;
    groups of over a thousandth of the grouped rows, fewer than a thousand, are broadcast even then, so that none is one task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    # A second digest beside SHA-1: payloads are taken for equal by 416 bits.
    keyed = keyed.withColumn("key", F.when(F.col("size") >= least, F.concat("digest", F.sha2(payload, 256))))
    copies = keyed.where("key is not null").groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    copies = cut(copies.where("n > 1"))
    groups, total = copies.agg(F.count("*"), F.sum("n")).first()  # two numbers
    if groups <= most:
        looked = keyed.join(F.broadcast(copies.select("key", F.col("refers_to").alias("to"))), "key", "left")
    else:
        hot = copies.where(F.col("n") > total / HOT).select("key", F.col("refers_to").alias("hot_to"), F.lit(True).alias("hot"))
        cold = copies.where(F.col("n") <= total / HOT).select(F.col("key").alias("at"), F.col("refers_to").alias("cold_to"))
        looked = keyed.join(F.broadcast(hot), "key", "left")
        # Rows that are settled take a key of their own, which spreads them.
        own = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest").cast("string"))
        looked = looked.withColumn("at", F.when(F.col("hot").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(own))
        looked = looked.join(cold.hint("shuffle_hash"), "at", "left").withColumn("to", F.coalesce("hot_to", "cold_to"))
    refers = F.col("to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to"))
    return looked.select("page_id", "url", "html", "digest", "size", refers.alias("refers"), F.when(refers, F.col("to")).alias("refers_to"))


def write_archive(
    pages: DataFrame, folder: str | None = None, least: int = 1000, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, level: int = 3
) -> DataFrame:
    """Write a WARC record for each row of pages (page_id, url, html) into bundles in `folder`; the index, one row a record.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is a response and the others revisit
    it; smaller payloads are all responses. Rows that share the largest id of a group are all responses, as a record cannot
    revisit itself. A null html is an empty payload; a null id has the record identifier without a number, revisits a
    group's largest id and is a response where a group has no id; a null url leaves the target out; control characters and
    spaces of a url are percent-encoded; other columns are not stored. An empty table writes no bundle. A record longer than a
    frame has a frame of its own.
    """
    folder = folder or f"{checkpoint_folder(pages.sparkSession)}/bundles/{uuid.uuid4().hex}"
    rows = with_revisits(pages.select("page_id", "url", "html"), least)
    return written(rows.mapInArrow(_writer(folder, date, frame_bytes, bundle_bytes, level), INDEX))


def read_archive(index: DataFrame) -> DataFrame:
    """All records of the bundles that an index names, checked against their digests. The payload of a revisit is null."""
    bundles = index.select("bundle").distinct()
    return bundles.repartition("bundle").mapInArrow(_read_bundles, RECORD)


def read_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the page ids in `wanted`, each read from its frame; ids that the index does not have give no row."""
    found = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    return found.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_read_records, RECORD)


#: The same decisions in SQL, from the table instead of the archives.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), d AS (
  SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
         CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS kept
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM d
"""
