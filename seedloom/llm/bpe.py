"""Byte-level BPE encoding and decoding of whole texts by a local rank file.

Texts are cut at boundaries that no match of the pattern crosses, so a text of any length is
encoded piece by piece; the ids equal those of one call over the whole text.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.llm.common import slices_of, table, text_or_empty, with_mapped

RANKS = "byte_bpe_50k.tiktoken"
# A piece handed to the library at once, in code points; longer runs are cut or merged here.
PIECE = 50_000
# A new piece may start at white space after anything else, and at a letter before or after a
# number: every alternative of the pattern ends there and the next match starts there.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def pieces(text: str, size: int = PIECE):
    """Consecutive parts of ``text``, each ended at the first safe boundary after ``size``."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text) or not at:
        yield text[at:]


def merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one long match: the lowest rank first, leftmost on ties, in n log n."""
    n = len(raw)
    start, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(raw[start[a] : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]


def encode_text(text: str, encoding, ranks, pattern: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    out = []
    for piece in pieces(text):
        if len(piece) <= 2 * PIECE:
            ids = encoding.encode_ordinary(piece)
        else:  # one run without a boundary: match by match
            ids = []
            for m in regex.finditer(pattern, piece):
                raw = m[0].encode()
                ids += [ranks[raw]] if raw in ranks else merge_long(raw, ranks)
        out.append(np.asarray(ids, dtype="<u4").tobytes())
    return b"".join(out)


def decode_ids(ids: bytes, encoding) -> bytes:
    """The bytes that little-endian unsigned 32-bit ids stand for."""
    got = np.frombuffer(ids, dtype="<u4")
    step = 1 << 16
    return b"".join(encoding.decode_bytes(got[i : i + step].tolist()) for i in range(0, len(got), step))


def encode(df: DataFrame, text: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``ids`` (binary, 4 bytes an id, little-endian) and ``n_tokens``.

    ``ranks`` is the path of a tiktoken rank file that every executor has. A null text is
    encoded as the empty one: no ids. Special tokens are ordinary text. Columns named ``ids``
    or ``n_tokens`` are replaced, all others stay.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def make():
        encoding, table_ = _encoding(path, pattern)
        return lambda value: encode_text(value or "", encoding, table_, pattern)

    return with_mapped(df, text, "ids", "binary", make).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(df: DataFrame, ids: str = "ids", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``decoded``, the raw bytes that the ids stand for; null ids give no bytes."""
    path = ranks or public_tokenizers.path(RANKS)

    def make():
        encoding, _ = _encoding(path, pattern)
        return lambda value: decode_ids(value or b"", encoding)

    return with_mapped(df, ids, "decoded", "binary", make)


def round_trip(df: DataFrame, text: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``ids``, ``n_tokens`` and ``decoded`` in place of the text: :func:`encode` and :func:`decode` in one pass.

    One Python process for a task, not two, and neither texts nor ids travel back and forth between them. Columns of these names
    are replaced, all others but the text stay.
    """
    path = ranks or public_tokenizers.path(RANKS)
    others = [c for c in df.columns if c not in (text, "ids", "n_tokens", "decoded")]
    df = df.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in others])
    made = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]

    def run(batches):
        encoding, table_ = _encoding(path, pattern)
        for batch in slices_of(batches, 0):
            ids = [encode_text(value.as_py() or "", encoding, table_, pattern) for value in batch.column(0)]
            decoded = [decode_ids(value, encoding) for value in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=[*others, "ids", "decoded"])

    out = df.mapInArrow(run, T.StructType([*df.schema.fields[1:], *made]))
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns from the operator's own: text -> ids -> bytes."""
    coded = round_trip(docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
