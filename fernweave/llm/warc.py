"""WARC archives with a Zstandard dictionary, written and read by Spark tasks.

A dictionary is built from a bounded sample of the records to be archived. Each archive begins with a skippable frame
that holds the dictionary; each record is a frame of its own after it, so that an archive can be read by any task and
from any record on. Records with equal payloads are told apart by id: the first is archived whole, the others as
revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm._common import join_unique, materialise, new_path

# The magic number of the dictionary's frame, and the profile of revisits of equal payloads.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Sample for the dictionary: records, more or less, bytes of each at most, and size of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8192, 65_536
#: Bytes of an archive after which the next is begun.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES, level: int = 3) -> bytes:
    """A dictionary from samples; where they are too few to train one, their own beginning."""
    try:
        return zstandard.train_dictionary(size, samples, level=level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def record_id(page_id: int | None, digest: str, whole: bool = True) -> str:
    """The id of a page's record: that of a response follows from page and payload, others are never used twice."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest if whole and page_id is not None else uuid.uuid4().hex}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without it."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, refers_to is None)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Archives in a folder; a new one is begun when one is full. Names are never used twice."""

    def __init__(self, folder: str, dictionary: bytes, level: int):
        self.files, self.root = pafs.FileSystem.from_uri(folder)
        self.dictionary = dictionary
        own = zstandard.ZstdCompressionDict(dictionary)
        own.precompute_compress(level=level)
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=False)
        self.out = None
        self.name, self.records, self.size = "", 0, 0
        self.done: list[tuple[str, int, int]] = []

    def write(self, record: bytes) -> None:
        if self.out is None:
            self.name, self.records = f"{uuid.uuid4().hex}.warc.zst", 0
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.size = self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(self.dictionary)) + self.dictionary)
            self.write(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(self.name[:32])}>\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())
            self.records = 0
        frame = self.zstd.compress(record)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.name, self.records, self.size))


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an archive, from its bytes in turn."""
    held = b""
    while len(held) < 8 or len(held) < 8 + struct.unpack("<I", held[4:8])[0]:
        more = next(chunks, b"")
        if not more:
            raise ValueError("an archive ends within its dictionary")
        held += more
    magic, size = struct.unpack("<II", held[:8])
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive does not begin with a dictionary")
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held[8 : 8 + size]))
    held = held[8 + size :]
    parts: list[bytes] = []
    frame, begun = zstd.decompressobj(), False
    while True:
        if not held:
            held = next(chunks, b"")
            if not held:
                break
        parts.append(frame.decompress(held))
        held, begun = b"", True
        if frame.eof:
            yield b"".join(parts)
            held, parts, frame, begun = frame.unused_data, [], zstd.decompressobj(), False
    if begun:
        raise ValueError("an archive ends within a record")


def _header(block: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in block.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def _page_of(urn: str | None) -> int | None:
    page = urn.split(":")[2] if urn and urn.startswith("<urn:page:") else ""
    return int(page) if page else None


def parse_record(record: bytes) -> tuple[int | None, str | None, str, bytes, int, str, int | None] | None:
    """(page id, url, type, payload, bytes of the full payload, digest, page referred to); None for other records."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = _header(head)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    return _page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, payload, int(_header(http)["content-length"]), digest, _page_of(fields.get("warc-refers-to"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, level: int = 3, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page; returns (folder, name, records, bytes) of each archive.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is archived whole, the
    others as revisits of it. A null html is an empty payload. Rows that repeat that smallest id are each archived
    whole, under one record id; null ids never become the one referred to, and pages without any id in their group are archived whole. A
    null url leaves the target out. An empty table gives no archives. Other columns are ignored. Archives that a lost
    task has left behind are not in the returned table, which is on disk when this returns.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    picked = pages.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{url_col}` as string) url", f"coalesce(cast(`{html_col}` as string), '') html_")
    share = min(1.0, SAMPLE_RECORDS / max(1, picked.count()))  # about as many records, and never more than twice
    drawn = picked.where(F.pmod(F.xxhash64("id", "url", "html_"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.select(F.substring("html_", 1, SAMPLE_BYTES)).limit(2 * SAMPLE_RECORDS).collect()
    samples = [record_bytes(k, f"https://www.example.com/{k}", r[0].encode("utf-8", "surrogatepass"), None, date) for k, r in enumerate(sample)]
    shared = spark.sparkContext.broadcast(build_dictionary(samples, level=level))  # DICTIONARY_BYTES at most
    key = F.sha2("html_", 256)
    large = picked.where(F.octet_length("html_") >= least_bytes).withColumn("key", key)
    first = large.groupBy("key").agg(F.min("id").alias("first"))
    marked = join_unique(large, first, "key").withColumn("refers_to", F.expr("case when id is null or id <> first then first end"))
    marked = marked.select("id", "url", "html_", "refers_to").unionByName(picked.where(F.octet_length("html_") < least_bytes).withColumn("refers_to", F.lit(None).cast("long")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)
        archives = ArchiveWriter(folder, shared.value, level)
        for batch in batches:
            for page, url, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archives.write(record_bytes(page, url, text.encode("utf-8", "surrogatepass"), first, date))
        archives.close()
        name, records, size = zip(*archives.done, strict=True) if archives.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([folder] * len(name), pa.string()), pa.array(name, pa.string()), pa.array(records, pa.int64()), pa.array(size, pa.int64())], names=["folder", "name", "records", "bytes"])

    written = marked.select("id", "url", "html_", "refers_to").mapInArrow(write, "folder string, name string, records long, bytes long")
    return materialise(written, "warc-archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload).

    archives: (folder, name). Payloads of responses are checked against their digests. Archives are read as streams; a
    record is the most that a task holds.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            own = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            keep = [k for k, n in enumerate(names) if n != "payload" or payloads]
            return pa.RecordBatch.from_arrays([own[k] for k in keep], names=[names[k] for k in keep])

        for batch in batches:
            for folder, name in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                files, root = pafs.FileSystem.from_uri(folder)
                found, held = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in records_of(iter(lambda s=stream: s.read(CHUNK), b"")):
                        if (one := parse_record(record)) is not None:
                            found.append(one if payloads else (*one[:3], None, *one[4:]))
                            held += len(one[3]) * payloads
                            if len(found) >= 4096 or held >= 8 << 20:
                                yield rows(found)
                                found, held = [], 0
                if found:
                    yield rows(found)

    schema = "page_id long, url string, record_type string" + ", payload binary" * payloads + ", payload_bytes long, payload_digest string, refers_to long"
    return archives.select("folder", "name").mapInArrow(read, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write the pages to archives and read their records back."""
    archives = write_archives(pages, **options)
    tasks = max(2, spark.sparkContext.defaultParallelism)
    return read_archives(archives.repartition(tasks, "name"))
