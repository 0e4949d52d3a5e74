"""Reading regions of large text files: an index of byte ranges, and a reader that opens only those.

The index is a table of its own (file, chrom, first, last, begin, stop, lines): one row for each run of lines of
one chromosome inside a block of the file, with the half-open positions and bytes it spans. Keep it beside the
files. Comment lines are listed under the chromosome ``#``, so that headers are read with every region.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.functions.names import normalize_chrom
from seedloom.operators.base import small_side
from seedloom.operators.intervals import overlap_join

BLOCK = 1 << 20
# Bytes that a task holds of a range, and of the lines it sends on.
PIECE = 1 << 20
HEADER = "#"

# Columns of chromosome, start and end of a line, and what to take off the start to count from 0.
LAYOUTS = {"vcf": (0, 1, None, 1), "bed": (0, 1, 2, 0), "bedgraph": (0, 1, 2, 0)}

_INDEX = "file string, chrom string, first long, last long, begin long, stop long, lines long"


def _open(uri: str) -> pa.NativeFile:
    """A file that executors reach by an address that pyarrow knows (file, hdfs, s3, gs)."""
    if uri.startswith("file:"):
        return pa.OSFile("/" + uri[len("file:") :].lstrip("/"))
    if ":/" not in uri:
        return pa.OSFile(uri)
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def lines_between(uri: str, begin: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of all lines that begin in [begin, stop); the last one is read to its end."""
    with _open(uri) as f:
        # Whether a line begins at ``begin`` is told by the byte before it.
        at = max(0, begin - 1)
        f.seek(at)
        held, skip = b"", begin > 0
        while True:
            piece = f.read(PIECE)
            held += piece
            lines = held.split(b"\n")
            held = lines.pop()
            for line in lines:
                if not skip:
                    if at >= stop:
                        return
                    yield at, line.rstrip(b"\r")
                skip = False
                at += len(line) + 1
            if not piece:
                if held and not skip and at < stop:
                    yield at, held.rstrip(b"\r")
                return
            if at >= stop:
                return


def index_positions(spark: SparkSession, path: str, layout: str = "vcf", block: int = BLOCK) -> DataFrame:
    """The index of uncompressed text files; each block of a file is read by one task, once.

    Lines need not be sorted, but regions are read in few bytes only where they are nearly so. Lines
    without a position are left out; empty files have no rows.
    """
    chrom, start, end, less = LAYOUTS[layout]
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("at"))
    schema = pa.schema([("file", pa.string()), ("chrom", pa.string()), *[(c, pa.int64()) for c in ("first", "last", "begin", "stop", "lines")]])

    def segments(uri: str, at: int):
        open_ = None
        for begin, line in lines_between(uri, at, at + block):
            f = line.split(None, 3) if layout != "vcf" else line.split(b"\t", 3)
            if line.startswith(b"#") or line.startswith((b"track", b"browser")):
                name, lo, hi = HEADER, 0, 0
            else:
                try:
                    name, lo = f[chrom].decode(), int(f[start]) - less
                    hi = lo + 1 if end is None else int(f[end])
                except (IndexError, ValueError):
                    continue
            if open_ and open_[0] == name:
                open_[1:] = [min(open_[1], lo), max(open_[2], hi), open_[3], begin + 1, open_[5] + 1]
            else:
                if open_:
                    yield (uri, *open_)
                open_ = [name, lo, hi, begin, begin + 1, 1]
        if open_:
            yield (uri, *open_)

    def run(batches):
        for batch in batches:
            for uri, at in zip(*(c.to_pylist() for c in batch.columns)):
                rows = list(segments(uri, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.repartition("file", "at").mapInArrow(run, _INDEX)


def matching_ranges(index: DataFrame, regions: DataFrame) -> DataFrame:
    """file, begin, stop of the index rows that a region (chrom, start, end; half-open) touches, and of headers."""
    known = index.filter(F.col("chrom") != HEADER).select("file", "begin", "stop", normalize_chrom("chrom").alias("chrom"), F.col("first").alias("start"), F.col("last").alias("end"))
    asked = regions.select(normalize_chrom("chrom").alias("chrom"), "start", "end")
    hits = overlap_join(known, asked, closed=False).select("file", "begin", "stop")
    return hits.union(index.filter(F.col("chrom") == HEADER).select("file", "begin", "stop")).distinct()


def read_ranges(index: DataFrame, regions: DataFrame) -> DataFrame:
    """file, at (first byte of the line), value: the lines of the ranges that regions touch. No other byte is read
    but those up to the end of a range's last line."""
    ranges = matching_ranges(index, regions).repartition("file", "begin")
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            for uri, begin, stop in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for at, line in lines_between(uri, begin, stop):
                    held.append((uri, at, line.decode("utf-8", "replace")))
                    size += len(line) + 16
                    if size > PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return ranges.mapInArrow(run, "file string, at long, value string")


def in_regions(rows: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Rows (chrom, start, end) that touch a region, once each; ``key`` tells rows apart."""
    spans = regions.select(normalize_chrom("chrom").alias("_c"), "start", "end")
    return overlap_join(rows.withColumn("_c", normalize_chrom("chrom")), small_side(spans), by="_c", closed=False).select(*rows.columns).dropDuplicates(key)
