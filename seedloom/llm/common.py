"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.session import scratch_path

#: Words a task remembers the hash of; beyond it the memory is emptied, results stay the same.
REMEMBERED = 300_000

# Stripped from the ends of a token before it counts as a word.
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


class WordHashes(dict):
    """token -> 63-bit hash of its word (lower case, punctuation stripped), 0 for none."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        word = word_of(token)
        value = (xxhash.xxh64_intdigest(word) >> 1 or 1) if word else 0
        self[token] = value
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of a text, in order."""
        tokens = text.split()
        h = np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        return h if h.all() else h[h != 0]


def word_of(token: str) -> str:
    """A token in lower case without punctuation at its ends; empty if nothing is left."""
    return token.lower().strip(_EDGE)


class Tokens:
    """All tokens of an array of texts. White space is Python's; a text's first and last token may be empty.

    ``ends[i]`` to ``ends[i + 1]`` are the tokens of text i, ``distinct[places[k]]`` is token k.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        ends = lists.offsets.to_numpy()
        self.ends, self.flat = ends - ends[0], lists.flatten()
        coded = self.flat.dictionary_encode()
        self.places = coded.indices.to_numpy()
        self.distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()

    def hashes(self) -> np.ndarray:
        """Hash of the word of each token as :class:`WordHashes` has it, every distinct token hashed once."""
        digest = xxhash.xxh64_intdigest
        h = [(digest(w) >> 1 or 1) if w else 0 for w in self.words()]
        return np.array(h, dtype=np.uint64)[self.places]

    def words(self) -> list[str]:
        """The word of each distinct token, as :func:`word_of` has it."""
        return [token.lower().strip(_EDGE) for token in self.distinct]


def slices_of(batches: Iterable[pa.RecordBatch], col: int, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where the bytes of the text column ``col`` reach ``most``; a longer text stands alone."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def columns_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time, so that only one text is a Python string."""
    for batch in batches:
        cols = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in cols)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size=lambda row: 1, most: int = 4_000) -> Iterator[pa.RecordBatch]:
    """Rows to Arrow batches of at most about ``most`` of the given size."""
    held, full = [], 0
    for row in rows:
        held.append(row)
        full += size(row)
        if full >= most:
            yield _batch(held, schema)
            held, full = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=field.type) for col, field in zip(zip(*rows), schema)], schema=schema
    )


def with_mapped(df: DataFrame, col: str, to: str, kind: str, make) -> DataFrame:
    """``df`` with ``to`` = make()(value of ``col``), row by row inside Arrow batches.

    ``make`` runs once per task. One value at a time is a Python object, and about 8 MB of results
    go out together. A column named ``to`` is replaced; all others pass through.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != to or c == col])
    schema = T.StructType([*df.schema.fields, T.StructField("_mapped", {"binary": T.BinaryType(), "string": T.StringType(), "double": T.DoubleType()}[kind])])
    types = {"binary": pa.binary(), "string": pa.string(), "double": pa.float64()}

    def run(batches):
        call = make()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(col))
            start, held, size = 0, [], 0
            for i in range(batch.num_rows):
                held.append(call(values[i].as_py()))
                size += 64 + (len(held[-1]) if kind != "double" else 0)
                if size > 8 << 20 or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(held))
                    arrays = [*part.columns, pa.array(held, type=types[kind])]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "_mapped"])
                    start, held, size = i + 1, [], 0

    out = df.mapInArrow(run, schema)
    return out.drop(to).withColumnRenamed("_mapped", to)


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at ``threshold`` with
    probability ``recall`` or more, within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        if hit >= 1:
            bands = 1
        elif hit <= 0:
            break
        else:
            bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError(f"no banding reaches recall {recall} at {threshold} with {most} hashes")
    return best
