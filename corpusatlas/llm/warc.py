"""WARC archives with a Zstandard dictionary, written and read back on the executors.

A dictionary is trained on a bounded sample of the payloads. Every archive begins with a
skippable frame that holds it; each record is a Zstandard frame of its own, so that a
record can be read alone. Records with a payload seen at a smaller page are revisits of
that page and carry no payload.

Archives go to a folder that all executors share. Their names hold the task attempt, and
only names that a finished task has returned are read, so a lost executor or a repeated
attempt leaves files that nobody reads.

Defined cases: a null html is an empty payload; payloads under `least` bytes are always
responses; rows that repeat the smallest page id of a payload are all responses; a row with
a null page id comes back with a null one and is never referred to; a null url gives a
record without target; control characters in a url are percent-encoded; an empty table
writes no archive; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.session import materialise, scratch_folder

LEAST_BYTES = 100
DICTIONARY_BYTES = 64 << 10
#: Payloads that the dictionary is trained on, and the largest of them.
SAMPLE_RECORDS, SAMPLE_RECORD_BYTES = 1_000, 64 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most `SAMPLE_RECORDS` payloads chosen by a hash of the page id.

    The ids of as many rows are found first, by a threshold that follows from the count, so no
    other payload is sorted or sent.
    """
    size = F.octet_length("html")
    fitting = pages.where((size > 0) & (size <= SAMPLE_RECORD_BYTES))
    n = fitting.count()
    place = F.shiftrightunsigned(F.xxhash64(F.lit(9), "page_id"), 2)
    some = fitting
    if n > SAMPLE_RECORDS:
        some = fitting.where(place < F.lit(int((1 << 62) * SAMPLE_RECORDS / n)))
    rows = some.limit(SAMPLE_RECORDS).select("html").collect()
    samples = [r["html"].encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        # Too little to train on: the payloads themselves, last bytes first to be matched.
        return b"".join(samples)[-DICTIONARY_BYTES:]


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; `payload` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if url is not None:
        safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"WARC-Profile: {PROFILE}",
            f"Refers-To-Page-Id: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def marked(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Pages with the size and digest of their payload and the page they revisit."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("size"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    firsts = (
        known.where(F.col("size") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    revisits = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return known.join(firsts, "digest", "left").select(
        "page_id", "url", "size", "digest", revisits.alias("refers_to"),
        F.when(revisits.isNull(), F.col("payload").cast("binary")).alias("payload"),
    )


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, least: int = LEAST_BYTES) -> DataFrame:
    """Write every page to an archive below `folder`; returns `(path, records)`."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
        attempt = TaskContext.get().taskAttemptId()
        names, counts, out, size = [], [], None, 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                page_id, url, length, digest, refers_to, payload = row
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{attempt}-{len(names)}.warc.zst"
                    names.append(f"{folder}/{name}")
                    counts.append(0)
                    out = store.open_output_stream(f"{root}/{name}")
                    out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary)
                    size = 0
                frame = packer.compress(record(page_id, url, payload, length, digest, refers_to))
                out.write(frame)
                size += len(frame)
                counts[-1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"]
        )

    return marked(pages, least).mapInArrow(write, "path string, records bigint")


def _records(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of every record of one archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("an archive begins with a dictionary frame")
    dictionary = stream.read(size)
    words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    reader = io.BufferedReader(
        zstandard.ZstdDecompressor(dict_data=words).stream_reader(stream, read_across_frames=True), 1 << 18
    )
    while line := reader.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record begins with its version")
        fields = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = reader.read(int(fields["Content-Length"]))
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends with two line ends")
        yield fields, block


_READ = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in `path`; payloads are checked against their digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = pa.fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path) as stream:
                    yield from grouped(_parsed(stream))

    def _parsed(stream) -> Iterator[tuple]:
        for fields, block in _records(stream):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            kind = fields["WARC-Type"]
            if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
            number = lambda name: int(fields[name]) if name in fields else None
            yield (
                number("Page-Id"), fields.get("WARC-Target-URI"), size, digest, kind,
                number("Refers-To-Page-Id"), payload if payloads and kind == "response" else None,
            )

    def grouped(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += 200 + len(row[-1] or b"")
            if size >= most:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), _READ.types)], schema=_READ
        )

    # One task an archive: a given number of partitions is not packed together, however few bytes a path has.
    n_archives = archives.select("path").distinct().count()
    return archives.select("path").repartition(max(1, n_archives), "path").mapInArrow(
        read,
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, payload binary",
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    # Named as Spark resolves it, so that tasks write where Spark reads: a path without a scheme may be on any store.
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}")
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    folder = whole.toUri().toString()
    written = materialise(write_archives(pages, folder, train_dictionary(pages)), "archives")
    return read_archives(written)


ORACLE_SQL = f"""
WITH known AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT digest, min(page_id) AS first FROM known WHERE size >= {LEAST_BYTES} GROUP BY digest
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, known.digest AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM known LEFT JOIN firsts ON firsts.digest = known.digest AND size >= {LEAST_BYTES}
"""
