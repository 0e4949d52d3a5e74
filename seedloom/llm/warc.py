"""WARC archives as a chunked record table.

Payloads travel as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes: the writer
streams them into per-record gzip members, the reader streams them out again with running
lengths and digests. Neither side holds a whole payload in Python.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import columns_of, in_batches, keep, table
from seedloom.session import scratch_path

CHUNK = 64 * 1024
ROLL = 512 * 1024 * 1024
# Payloads below this many bytes are stored again rather than referred to.
REVISIT_FROM = 100
# Fixed value: the WARC 1.1 profile of a record whose payload is stored elsewhere.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("file_bytes", pa.int64())])
CHUNKS = pa.schema(
    [
        ("file", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()),
        ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
        ("url", pa.string()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()),
        ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()), ("is_last", pa.bool_()),
    ]
)
_DDL = {"int64": "long", "string": "string", "binary": "binary", "bool": "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[str(f.type)]}" for f in schema)


def record_table(pages: DataFrame, page_id="page_id", url="url", payload="html") -> DataFrame:
    """Every page with its payload, digest and record type.

    Pages with equal payloads of ``REVISIT_FROM`` bytes or more revisit the one with the
    smallest id. A null payload is empty. A null id counts as larger than any other; if all
    ids of a group are null, or several rows share the smallest id, those rows are responses.
    Other columns are ignored.
    """
    p = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # One row for each digest and task goes into the shuffle, however often a payload repeats;
    # the join back is one that adaptive execution can split.
    repeated = (
        p.filter(F.col("payload_bytes") >= REVISIT_FROM)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null")
        .drop("n")
    )
    again = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return p.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
        "payload",
    )


def chunked(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """The rows of `record_table` cut into chunk rows; a revisit has one empty chunk."""
    held = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(held) / F.lit(size)).cast("int"))
    return records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1))).select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk_no",
        F.when(
            F.col("record_type") == "response",
            F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size)),
        ).otherwise(F.lit(b"")).alias("chunk"),
    )


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _head(page_id, url, size, digest, kind, refers_to, date) -> bytes:
    """WARC and HTTP header of a record; the HTTP length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    length = len(http) + (size if kind == "response" else 0)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _one_line(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", None if refers_to is None else _record_id(refers_to, digest)),
        ("WARC-Profile", PROFILE if kind == "revisit" else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", length),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n{http}".encode()


def write_archives(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Write chunk rows (each record's in order, in one partition) to ``folder``; returns the manifest.

    Every task attempt writes files of its own; only the manifest, itself written once, says
    which files count, so an attempt that was lost or repeated leaves no record twice.
    The folder can be any that pyarrow reaches by its address, and must be shared.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = zipped = path = None
        records = done = 0
        for page_id, url, size, digest, kind, refers_to, no, chunk in columns_of(batches):
            if no == 0:
                if zipped:
                    out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
                    zipped = None
                if out and out.tell() >= roll:
                    done = out.tell()
                    out.close()
                    yield path, records, done
                    out = None
                if out is None:
                    path, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path)
                zipped = zlib.compressobj(3, zlib.DEFLATED, 31)
                out.write(zipped.compress(_head(page_id, url, size, digest, kind, refers_to, date)))
                records += 1
            out.write(zipped.compress(chunk))
        if out:
            out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
            done = out.tell()
            out.close()
            yield path, records, done

    manifest = chunks.mapInArrow(lambda b: in_batches(write(b), MANIFEST, most=1), _ddl(MANIFEST))
    return keep(manifest, "warc-manifest")


class _Unzipped:
    """Decompressed bytes of consecutive gzip members, never more than asked for."""

    def __init__(self, stream):
        self.stream, self.raw, self.zip, self.held = stream, b"", zlib.decompressobj(31), b""

    def some(self, most: int) -> bytes:
        if self.held:
            out, self.held = self.held[:most], self.held[most:]
            return out
        while True:
            if self.zip.eof:
                self.raw, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(256 * 1024)
                if not self.raw:
                    return b""
            out = self.zip.decompress(self.raw, most)
            self.raw = b"" if self.zip.eof else self.zip.unconsumed_tail
            if out:
                return out

    def head(self) -> list[str]:
        """Lines up to the next empty one."""
        got = b""
        while b"\r\n\r\n" not in got:
            more = self.some(4096)
            if not more:
                return []
            got += more
        top, _, rest = got.partition(b"\r\n\r\n")
        self.held = rest + self.held
        return top.decode().split("\r\n")


def _fields(lines: list[str]) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines[1:])


def _records(path: str, fs, size: int):
    """Chunk rows of one archive."""
    number = lambda v: None if v is None else int(v)
    with fs.open_input_stream(path) as raw:
        stream, record_no = _Unzipped(raw), 0
        while lines := stream.head():
            warc, http = _fields(lines), _fields(stream.head())
            kind, full = warc["WARC-Type"], int(http["Content-Length"])
            left = full if kind == "response" else 0
            row = (
                path, record_no, warc["WARC-Record-ID"], kind, number(warc.get("X-Page-Id")),
                number(warc.get("X-Refers-To-Page-Id")), warc.get("WARC-Target-URI"), full,
                warc["WARC-Payload-Digest"].removeprefix("sha256:"),
            )
            digest, read, chunk_no = hashlib.sha256(), 0, 0
            while True:
                chunk = b""
                while left and len(chunk) < size:
                    part = stream.some(min(size - len(chunk), left))
                    if not part:
                        raise EOFError(f"{path}: record {record_no} is cut short")
                    chunk += part
                    left -= len(part)
                digest.update(chunk)
                read += len(chunk)
                yield (*row, chunk_no, chunk, read, digest.copy().hexdigest(), not left)
                chunk_no += 1
                if not left:
                    break
            end = b""
            while len(end) < 4 and (more := stream.some(4 - len(end))):
                end += more
            if end != b"\r\n\r\n":
                raise ValueError(f"{path}: record {record_no} does not end where it says")
            record_no += 1


def read_archives(manifest: DataFrame, folder: str, payload: bool = True, size: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives that a manifest lists, one task per file.

    ``payload=False`` returns only each record's last row, without its bytes.
    """

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for (path,) in columns_of(batches):
            for row in _records(path, fs, size):
                if payload:
                    yield row
                elif row[-1]:
                    yield (*row[:10], None, *row[11:])

    weight = lambda row: 512 + len(row[10] or b"")
    # A task for every file: the list is small, the files are not, so its partitions may not be merged.
    files = manifest.select("file").repartitionByRange(max(1, manifest.count()), "file")
    return files.mapInArrow(lambda b: in_batches(read(b), CHUNKS, weight, 4 << 20), _ddl(CHUNKS))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page as read back from the archives; digests of responses are those of the
    bytes read, lengths and digests of revisits those of their headers."""
    folder = scratch_path(spark, "warc")
    manifest = write_archives(chunked(record_table(table(spark, sf_dir, "pages"))), folder)
    rows = read_archives(manifest, folder, payload=False)
    own = F.col("record_type") == "response"
    return rows.select(
        "page_id",
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND (page_id IS NULL OR page_id > first_id)
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND (page_id IS NULL OR page_id > first_id)
    THEN first_id END AS refers_to
FROM q
"""
