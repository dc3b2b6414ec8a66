"""Web archives in dictionary-compressed WARC.

An archive is a ``.warc.zst`` file: a skippable frame that holds a Zstandard
dictionary, then each record as a frame of its own. The dictionary is built
once from a bounded sample of the records to be archived. Files are written by
the tasks into a folder that all executors see; a stored manifest names the
files of the tasks that succeeded, so files that lost or repeated tasks leave
behind are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, text_or_empty

#: Fixed values of the format: the skippable frame of a dictionary, and the profile of a revisit.
DICTIONARY_FRAME = 0x184D2A5D
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are always stored.
LEAST_REVISIT = 1000
#: The dictionary, and what it is built from: so many records, so many bytes of each.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 64 * 1024, 512, 16 * 1024
#: A task starts another file when one has so many bytes.
ARCHIVE_BYTES = 64 * 1024 * 1024
DATE = "2000-01-01T00:00:00Z"
_ID = "urn:x-page:"


def planned_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which response each page revisits, or null.

    Payloads are compared by SHA-1 and size. Digests that occur once never
    leave the map side's aggregate's result, so only repeated ones are joined.
    """
    rows = pages.select("page_id", "url", text_or_empty("html").cast("binary").alias("payload")).withColumn(
        "digest", F.sha1("payload")
    )
    large = F.octet_length("payload") >= LEAST_REVISIT
    repeated = (
        rows.filter(large)
        .groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("last").isNotNull())
        .select(F.col("digest").alias("_digest"), "last")
    )
    revisits = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.join(repeated, large & (F.col("digest") == F.col("_digest")), "left").select(
        "page_id", "url", "payload", "digest", F.when(revisits, F.col("last")).alias("refers_to")
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{_ID}{page_id}>" if page_id is not None else f"<urn:sha1:{digest}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the response's HTTP head, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Profile", IDENTICAL)]
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; of too few to train on, their own bytes; empty if there are none."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def sampled_dictionary(pages: DataFrame) -> bytes:
    """The dictionary of the pages with the smallest hashes: at most 8 MB of them reach the driver.

    The hashes are found first, from small columns, as a sort with a limit
    sends the driver as many rows from every task.
    """
    order = F.xxhash64("page_id", "url")
    last = pages.select(order.alias("h")).orderBy("h").limit(SAMPLE_RECORDS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    payload = text_or_empty("html").cast("binary")
    rows = (
        pages.filter(order <= last)
        .limit(SAMPLE_RECORDS)
        .select(
            "page_id",
            F.substring("url", 1, 2048).alias("url"),
            F.substring(payload, 1, SAMPLE_BYTES).alias("payload"),
            F.sha1(payload).alias("digest"),
        )
        .collect()
    )
    rows.sort(key=lambda r: (r.digest, str(r.page_id)))
    return build_dictionary([record_bytes(r.page_id, r.url, bytes(r.payload), r.digest, None) for r in rows])


class ArchiveWriter:
    """Writes records into files of about ``most`` bytes; ``done`` lists (path, records, bytes)."""

    def __init__(self, folder: str, dictionary: bytes, most: int = ARCHIVE_BYTES):
        self._files, self._folder = FileSystem.from_uri(folder)
        self._raw, self._most, self._out = dictionary, most, None
        known = _dictionary(dictionary)
        if known is not None:
            known.precompute_compress(level=3)
        self._compressor = zstandard.ZstdCompressor(level=3, dict_data=known)
        self.done: list[tuple[str, int, int]] = []

    def write(self, record: bytes) -> None:
        if self._out is None:
            task = TaskContext.get()
            name = f"pages-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}.warc.zst"
            self._path, self._records = f"{self._folder}/{name}", 0
            self._out = self._files.open_output_stream(self._path, compression=None)
            if _dictionary(self._raw) is not None:
                self._out.write(struct.pack("<II", DICTIONARY_FRAME, len(self._raw)) + self._raw)
        self._out.write(self._compressor.compress(record))
        self._records += 1
        if self._out.tell() >= self._most:
            self.close()

    def close(self) -> None:
        if self._out is not None:
            self.done.append((self._path, self._records, self._out.tell()))
            self._out.close()
            self._out = None


def write_archives(records: DataFrame, folder: str, dictionary: bytes, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes planned records below ``folder``; the stored manifest (path, records, bytes) names the whole files."""
    files, path = FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, dictionary, most)
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch[c] for c in batch.schema.names)):
                writer.write(
                    record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                )
        writer.close()
        columns = list(zip(*writer.done)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "records", "bytes"])

    return stored(records.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def archived(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive that is open for reading, one at a time."""
    start = stream.read(8)
    dictionary = None
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_FRAME:
        dictionary, start = _dictionary(stream.read(struct.unpack("<I", start[4:])[0])), b""
    source = _Joined(start, stream)
    reader = io.BufferedReader(
        zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 18
    )
    while line := reader.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        block = reader.read(int(fields["Content-Length"]))
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, block


class _Joined:
    """A readable stream with some bytes put back at its start."""

    def __init__(self, first: bytes, rest):
        self._first, self._rest = first, rest

    def read(self, n: int) -> bytes:
        if self._first:
            out, self._first = self._first[:n], self._first[n:]
            return out
        return self._rest.read(n)


def _page_of(record_id: str) -> int | None:
    return int(record_id[len(_ID) + 1 : -1]) if record_id.startswith(f"<{_ID}") else None


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files of a manifest; a payload that differs from its digest is an error.

    Files are dealt out over tasks and streamed, so a task holds one record at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows = []
                with files.open_input_stream(path, compression=None) as stream:
                    for fields, block in archived(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        kind = fields["WARC-Type"]
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
                        if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, length):
                            raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
                        refers = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((_page_of(fields["WARC-Record-ID"]), length, digest, kind, refers))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    dealt = manifest.select("path").repartition(max(1, manifest.count()))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.mapInArrow(read, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages (page_id, url, html) to archives in the shared folder and reads them back.

    A null html is an empty payload, a null url leaves its field out, and other
    columns are ignored. A null page_id cannot be referred to: its record
    revisits the response of its group if that has an id. Rows that repeat the
    largest page_id of a group are responses all. Without pages there is no
    file and no row.
    """
    records = planned_records(pages)
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(records, folder, sampled_dictionary(pages)), folder)


#: The rows of archive_pages.
PAGES_SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN revisits THEN last END AS refers_to
FROM (
  SELECT *, strlen(coalesce(html, '')) >= 1000 AND coalesce(page_id < last, last IS NOT NULL) AS revisits
  FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
)
"""
