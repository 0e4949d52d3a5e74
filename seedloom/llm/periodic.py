"""Periodic runs of words, found by internal pattern matching, and texts with the repeats taken out.

A run is a maximal stretch of words with smallest period q that is at least ``EXPONENT`` periods and
``SHORTEST`` words long. For every power of two B the words are cut in blocks of B. A run with
B <= q < 2B holds a whole block, and that block stands again q words later. So each block asks for its
occurrences in the neighbouring window of B starts: prefix doubling gives the block's interval in the
suffix array, a wavelet tree over the suffix array answers range successor in that interval. One or
two occurrences are candidate periods themselves. Three or more form a progression; then only the
distance between the ends of the two stretches that carry its step can be a period. Candidates are
extended word by word to both sides, and are runs if they are long enough.

Texts are independent of each other: rows stay where they are, nothing is shuffled. Short texts are
searched together, with a word of its own after each, so that array operations are long. A task
holds about ``TOGETHER`` words or the longest text, about 100 bytes a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.llm.common import table

EXPONENT = 4
SHORTEST = 6
TOGETHER = 60_000

RUNS = "array<struct<start:long,length:long,period:long>>"


class WaveletTree:
    """Range successor over a permutation of 0..n-1: bits by level, high to low, with block counts."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.levels = []
        v = values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (v >> b & 1).astype(bool)
            raw = np.packbits(bit, bitorder="little")
            words = np.zeros(len(v) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(raw)] = raw
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((b, words, before, int(len(v) - bit.sum())))
            v = np.concatenate([v[~bit], v[bit]])

    @staticmethod
    def _ones(words, before, at):
        """Ones before each place of ``at``."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & mask)

    def below(self, lo, hi, bound):
        """How many values of each interval [lo, hi) are below ``bound``."""
        got = np.zeros(len(lo), dtype=np.int64)
        for b, words, before, zeros in self.levels:
            a, z = self._ones(words, before, lo), self._ones(words, before, hi)
            up = (bound >> b & 1).astype(bool)
            got += np.where(up, (hi - z) - (lo - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return got

    def nth(self, lo, hi, nth):
        """The nth smallest value (from 0) of each interval [lo, hi)."""
        got = np.zeros(len(lo), dtype=np.int64)
        for b, words, before, zeros in self.levels:
            a, z = self._ones(words, before, lo), self._ones(words, before, hi)
            low = (hi - z) - (lo - a)
            up = nth >= low
            nth = np.where(up, nth - low, nth)
            got |= up.astype(np.int64) << b
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return got


def blocks_by_level(ids: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple]]:
    """Suffix array (ordered as far as asked), and (B, starts, lo, hi) of repeated blocks by level.

    Prefix doubling: a place's rank is the first place of its class in the order by the next B
    words, so a class is the interval [rank, rank + size) of the suffix array.
    """
    n = len(ids)
    _, inverse, sizes = np.unique(ids, return_inverse=True, return_counts=True)
    rank, size = (np.cumsum(sizes) - sizes)[inverse], sizes[inverse]
    levels, b = [], 1
    while True:
        x = np.arange(0, n - 2 * b + 1, b)
        x = x[size[x] > 1]
        levels.append((b, x, rank[x], rank[x] + size[x]))
        open_ = np.flatnonzero(size > 1)
        if 2 * b * EXPONENT > longest or not len(open_):
            break
        after = np.zeros(len(open_), dtype=np.int64)
        inside = open_ + b < n
        after[inside] = rank[open_[inside] + b] + 1
        order = np.lexsort((after, rank[open_]))
        places, old, after = open_[order], rank[open_][order], after[order]
        new_old = np.r_[True, old[1:] != old[:-1]]
        new_key = new_old | np.r_[True, after[1:] != after[:-1]]
        first_old = np.flatnonzero(new_old)[np.cumsum(new_old) - 1]
        starts = np.flatnonzero(new_key)
        nth_key = np.cumsum(new_key) - 1
        rank[places] = old + starts[nth_key] - first_old
        size[places] = np.diff(np.r_[starts, len(places)])[nth_key]
        b *= 2
    return np.argsort(rank, kind="stable"), levels


def _same_until(ids: np.ndarray, i: int, q: int, stop: int) -> int:
    """The first j >= i, ``stop`` at most, whose word differs from the word q before it."""
    step = 32
    while i < stop:
        to = min(i + step, stop)
        differs = ids[i:to] != ids[i - q : to - q]
        j = int(differs.argmax())
        if differs[j]:
            return i + j
        i, step = to, step * 2
    return stop


def _same_from(ids: np.ndarray, i: int, q: int) -> int:
    """The smallest s <= i such that words s..i-1 equal the words q after them."""
    step = 32
    while i > 0:
        to = max(i - step, 0)
        differs = (ids[to:i] != ids[to + q : i + q])[::-1]
        j = int(differs.argmax())
        if differs[j]:
            return i - j
        i, step = to, step * 2
    return 0


def find_runs(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of a sequence of integers, by start and period.

    ``longest`` bounds the length of a run if it is known (separated texts searched together).
    """
    n = len(ids)
    if n < SHORTEST:
        return []
    suffixes, levels = blocks_by_level(ids, n if longest is None else longest)
    if not any(len(x) for _, x, _, _ in levels):
        return []
    tree = WaveletTree(suffixes)
    found: dict[tuple[int, int], int] = {}
    reach = np.zeros(n, dtype=np.int64)  # end of the runs of lower levels that hold a place
    for b, x, lo, hi in levels:
        # Inside such a run no block of this level can carry another run (its period would divide).
        free = reach[x] < x + 3 * b
        x, lo, hi = x[free], lo[free], hi[free]
        near = tree.below(lo, hi, x + b)
        has = near < hi - lo
        x, lo, hi, near = x[has], lo[has], hi[has], near[has]
        y = tree.nth(lo, hi, near)
        has = y < x + 2 * b
        x, lo, hi, near, y1 = x[has], lo[has], hi[has], near[has], y[has]
        y2, y3 = (np.full(len(x), n + 2 * b, dtype=np.int64) for _ in range(2))
        for k, into, where in ((1, y2, y1), (2, y3, y2)):
            has = np.flatnonzero((where < x + 2 * b) & (near + k < hi - lo))
            into[has] = tree.nth(lo[has], hi[has], near[has] + k)
        progression = y3 < x + 2 * b
        pairs = [(int(s), int(q)) for s, q in zip(x[~progression], (y1 - x)[~progression])]
        two = ~progression & (y2 < x + 2 * b)
        pairs += [(int(s), int(q)) for s, q in zip(x[two], (y2 - x)[two])]
        for s, a, step in zip(x[progression].tolist(), y1[progression].tolist(), (y2 - y1)[progression].tolist()):
            end = _same_until(ids, s + step, step, min(n, s + 3 * b))
            other = _same_until(ids, a + step, step, min(n, a + 5 * b))
            if b <= other - end < 2 * b:
                pairs.append((s, other - end))
        seen: dict[int, tuple[int, int]] = {}
        for s, q in sorted(pairs):
            first, last = seen.get(q, (0, 0))
            if first <= s and s + q < last:
                continue
            first, last = _same_from(ids, s, q), _same_until(ids, s + q, q, n)
            seen[q] = first, last
            if last - first >= max(SHORTEST, EXPONENT * q):
                found[first, last] = min(q, found.get((first, last), q))
        for (first, last), q in found.items():
            if b <= q < 2 * b:
                np.maximum(reach[first:last], last, out=reach[first:last])
    return sorted((s, e - s, q) for (s, e), q in found.items())


def words_of(doc_id, data: bytes) -> list[bytes]:
    return data.split()


def collapse_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", read: Callable = words_of) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period in words) and ``collapsed``: the
    words without those that a run holds after its first period, joined by one space.

    Words are what stands between space, tab, line feed, vertical tab, form feed and carriage return, in
    bytes of UTF-8; ``read(id, bytes)`` may give others. Null and empty texts have no word, no run
    and an empty collapsed text. Repeated rows each have their own result, ids may be null or
    shared. Columns of the three names are replaced, others pass through; an empty table gives none.
    """
    new = ["n_words", "runs", "collapsed"]
    own = docs.drop(*new)
    sent = own.withColumn("_data", F.col(f"`{text}`").cast("string").cast("binary"))
    added = T.StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string")
    schema = T.StructType([*own.schema.fields, *added.fields])

    def run(batches):
        types = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
        for batch in batches:
            data = batch.column(batch.schema.get_field_index("_data"))
            ids = batch.column(batch.schema.get_field_index(doc_id))
            kept = batch.select([c for c in batch.schema.names if c != "_data"])
            start, held, size = 0, [], 0
            for i in range(batch.num_rows):
                held.append(read(ids[i].as_py(), data[i].as_py() or b""))
                size += len(held[-1]) + 8
                if size >= TOGETHER or i + 1 == batch.num_rows:
                    part = kept.slice(start, len(held))
                    arrays = [pa.array(col, type=t) for col, t in zip(zip(*_searched(held)), types)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *new])
                    start, held, size = i + 1, [], 0

    return sent.mapInArrow(run, schema)


def _searched(texts: list[list[bytes]]) -> list[tuple]:
    """(n_words, runs, collapsed) of each text; all are searched together."""
    known: dict[bytes, int] = {}
    total = sum(map(len, texts))
    ids = np.empty(total + len(texts), dtype=np.int64)
    starts, at = [], 0
    for i, words in enumerate(texts):
        starts.append(at)
        ids[at : at + len(words)] = [known.setdefault(w, len(known)) for w in words]
        at += len(words)
        ids[at] = -1 - i
        at += 1
    runs: list[list] = [[] for _ in texts]
    for s, length, q in find_runs(ids, max(map(len, texts))):
        i = int(np.searchsorted(starts, s, side="right")) - 1
        runs[i].append((s - starts[i], length, q))
    return [(len(w), [dict(zip(("start", "length", "period"), r)) for r in rs], _collapsed(w, rs)) for w, rs in zip(texts, runs)]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for s, length, q in runs:
            edge[s + q] += 1
            edge[s + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words).decode()


def echoed(doc_id, data: bytes) -> list[bytes]:
    """The words of a row; one id in ten has its words from a place on replaced by a repeated stretch.

    With h = crc32 of the decimal id, g = h div 10: if h mod 10 is 0, a = g mod n and the words
    from a on repeat the first 1 + (n - a) div (3 + g mod 8) of them. A null id changes nothing.
    """
    words = data.split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = collapse_runs(docs, read=echoed).drop("text")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    got = got.withColumn("best", longest)
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        "best.length",
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
