"""WARC archives with an index: written once, then read by coalesced byte ranges.

Each task writes one archive of gzip members, one for a record, into a shared folder and yields a row for each
record: archive, offset, length, URL and digests. Those rows, written as a table, are the index; archives of
tasks that failed or ran twice are in no row of it, so nothing reads them. Selected records are read back in
the order of archive and offset, neighbours in one read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import work_folder

#: Payloads of fewer bytes are never replaced by a revisit.
MIN_REVISIT_BYTES = 100
#: Ranges of selected records that are this near are read together, up to so many bytes at once.
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
#: Bytes of records that one task reads.
TASK_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "key long, archive string, offset long, length long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
RECORD = "key long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(key: int | None) -> str:
    """The record id that a key stands for."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}')}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit of the response with key refers_to."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ] + ([] if key is None else [f"X-Record-Key: {key}"])
    block = _HTTP
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"(?m)^([\w-]+): ?(.*?)\r?$", head.decode()))
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def digests(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """pages' keys with digest and size of the payload (null: empty), and the key of the response each one revisits.

    Of equal payloads of MIN_REVISIT_BYTES or more the record with the smallest key is the response; rows that
    repeat that key are responses too. Only keys and digests are shuffled, and equal digests are reduced to their
    smallest key before.
    """
    own = pages.select(F.col(key).alias("key"), _payload(payload).alias("_p"))
    own = own.select("key", F.sha2("_p", 256).alias("digest"), F.octet_length("_p").cast("long").alias("bytes"))
    firsts = own.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("key").alias("first"))
    return own.join(firsts, "digest", "left").select("key", "digest", "bytes", F.when(F.col("first") < F.col("key"), F.col("first")).alias("refers_to"))


def _payload(column: str) -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record for each page into archives in a shared folder and returns their index, read from its table.

    Keys are cast to long (other keys end the job, as Spark's casts do). The index has the URL as it is; the record has
    it percent-encoded, and a null URL as an empty one.
    """
    spark = pages.sparkSession
    folder = folder or work_folder(spark, "warc")
    facts = digests(pages, key, payload).distinct()
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), _payload(payload).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    facts = facts.select(F.col("key").cast("long").alias("_key"), F.col("digest").alias("_digest"), F.col("refers_to").cast("long"))
    joined = rows.join(facts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))).select("key", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(f"{base}/archives", recursive=True)
        name = f"{base}/archives/part-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    found = []
                    for row in batch.slice(k, 256).to_pylist():
                        if out is None:
                            out = system.open_output_stream(name, compression=None)
                        member = gzip.compress(record(row["key"], row["url"], row["payload"], row["digest"], row["refers_to"]), compresslevel=1, mtime=0)
                        out.write(member)
                        found.append((row["key"], name, offset, len(member), row["url"], "response" if row["refers_to"] is None else "revisit", row["refers_to"], row["digest"], len(row["payload"])))
                        offset += len(member)
                    yield _batch(found, INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    joined.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
INDEX_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in INDEX.split(", "))])
RECORD_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in RECORD.split(", "))])


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, ranges inside) of the reads that serve sorted (offset, length) ranges."""
    start = end = 0
    inside: list[tuple[int, int]] = []
    for offset, length in ranges:
        if inside and (offset - end > MAX_GAP or offset + length - start > MAX_READ):
            yield start, end, inside
            inside = []
        if not inside:
            start = offset
        inside.append((offset, length))
        end = max(end, offset + length) if len(inside) > 1 else offset + length
    if inside:
        yield start, end, inside


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the index rows, from the archives: each with its own fields, and a response with its payload.

    A response's digest and size are taken from the payload that was read, and a payload that does not have the
    digest of its header ends the job; a revisit has those of its header and a null payload. URLs are those of the
    records, percent-encoded; the index has them as they were.
    """
    held = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-held // TASK_BYTES))  # index rows are small, what they stand for is not
    sorted_rows = index.select("folder", "archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, opened, source = None, None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows, at = batch.slice(k, 1000).to_pylist(), 0
                while at < len(rows):
                    name, upto = rows[at]["archive"], at
                    while upto < len(rows) and rows[upto]["archive"] == name:
                        upto += 1
                    system = system or pa.fs.FileSystem.from_uri(rows[at]["folder"])[0]
                    if name != opened:
                        source, opened = system.open_input_file(name), name
                    for start, end, inside in coalesced([(r["offset"], r["length"]) for r in rows[at:upto]]):
                        source.seek(start)
                        block, found = source.read(end - start), []
                        for offset, length in inside:
                            fields, payload = parse(gzip.decompress(block[offset - start : offset - start + length]))
                            digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                            response = fields["warc-type"] == "response"
                            if response:
                                size = len(payload)
                                if hashlib.sha256(payload).hexdigest() != digest:
                                    raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                            numbers = [int(fields[x]) if x in fields else None for x in ("x-record-key", "x-refers-to-key")]
                            found.append((numbers[0], fields["warc-target-uri"], fields["warc-type"], numbers[1], digest, size, payload if response and payloads else None))
                        yield _batch(found, RECORD_SCHEMA)
                    at = upto

    return sorted_rows.mapInArrow(run, RECORD)
