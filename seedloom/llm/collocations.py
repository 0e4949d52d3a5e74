"""Phrase collocations by the stripes pattern.

A stripe is a prefix with an associative counter of the words that follow it. Tasks build the
stripes of their texts, an exchange deals them by prefix (long stripes in slices by next word) and
they are merged elementwise. The one table of merged stripes gives all figures: an element is the count of
an extension, of a prefix and of a rest, and the greatest element of a stripe is what subsumes it.

A phrase cannot be frequent unless its parts are. Three passes over the texts use that: the first counts
words, the second the stripes of the frequent words, the third those of longer phrases where each two
neighbouring words are a frequent pair. Every pass counts exactly. Hash tables of ``CELLS`` cells or more, eight
for each frequent pair, tell the third pass which pairs are frequent; a cell that several pairs share only lets
more through. A second bit says which pairs are so frequent that their stripes are sliced, the same for
all tasks.

Between passes words travel as numbers of the frequent words, the most frequent first, and a longer stripe
inside the stripe of its prefix, in compressed columns. So a word of the input costs an exchange one element
of a few bytes for each phrase length at most, however much of the corpus is frequent.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedloom.llm.common import columns_of, in_batches, keep, table

LONGEST = 5
FEWEST = 100
SUBSUMED = 100
BEST = 2_000
# Cells of the hash table of frequent pairs, at least, and for each pair.
CELLS, SPARE = 1 << 22, 8
_BLOCK = 1 << 14
# The stripes of a pair are dealt in slices by next word if its cell has a pair with so many.
HOT, SLICES = 65_535, 1024
# Stripes travel in so many parcels by hash of prefix and slice, many in one row; words in fewer.
PARCELS, WORD_PARCELS = 2048, 256
# Words a task holds before it counts them, and distinct words before it sends their counts.
TOGETHER, DISTINCT = 3_000_000, 1_000_000

# Lower case, and what ends a piece as line feed, and tab as space.
_PLAIN = bytes(
    10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PARCEL = pa.schema([("lang", pa.string()), ("parcel", pa.int32()), ("data", pa.binary())])
_PARCEL_DDL = "lang string, parcel int, data binary"
# h is the hash of a pair.
_COUNTS = pa.schema([
    ("lang", pa.string()), ("size", pa.int32()), ("prefix", pa.string()), ("next", pa.string()), ("n", pa.int64()), ("h", pa.int64()),
])
_COUNTS_DDL = "lang string, size int, prefix string, next string, n long, h long"


def pieces(data: bytes) -> list[list[bytes]]:
    """Words of each piece of a text in UTF-8: A-Z lower-cased, cut at .,;:!? and line ends."""
    # Of the characters that split() takes for space, only the space itself is left.
    return [words for piece in data.translate(_PLAIN).split(b"\n") if (words := piece.split())]


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _spread(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers below 2^32 as bytes: all lowest bytes first, as the others are mostly zero."""
    flat = np.concatenate([[len(c) for c in columns], *columns]).astype("<u4")
    return _squeezed(len(columns).to_bytes(4, "little") + flat.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = _spread(data)
    n = int.from_bytes(raw[:4], "little")
    flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=4).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
    return np.split(flat[n:], np.cumsum(flat[: n - 1]))


def _unpack_first(data: bytes) -> list[np.ndarray]:
    """The same, the first column as the sums of its steps."""
    first, *rest = _unpack(data)
    return [np.cumsum(first), *rest]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


def _pair_hash(group: str, pairs: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of word numbers (first << 32 | second) of a language."""
    return _mixed(pairs.astype(np.uint64) ^ np.uint64(xxhash.xxh64_intdigest(group, 1)))


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def _parcel_of(h: np.ndarray) -> np.ndarray:
    return (_mixed(h) >> np.uint64(40)).astype(np.int64) % PARCELS


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of ``n`` of each, and the place of every key among them."""
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, at, n)
    return found, total, at


def _runs(values: np.ndarray):
    """(value, start, end) of each run of equal values."""
    starts = np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]]).tolist()
    return zip(values[starts].tolist(), starts, [*starts[1:], len(values)])


def _texts(words: pa.Array, numbers: np.ndarray) -> list[str]:
    return words.take(pa.array(numbers)).cast(pa.string()).to_pylist()


class _Held:
    """Words of the texts of a task by group, as numbers of a vocabulary, until they are counted."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.groups: dict[str, tuple[list, list]] = {}
        self.size = 0

    def add(self, group: str, data: bytes) -> None:
        number = self.words
        texts, ends = self.groups.setdefault(group, ([], []))
        found = pieces(data)
        ids = [number.setdefault(w, len(number)) for words in found for w in words]
        texts.append(np.array(ids, dtype=np.int32))
        ends.append(np.fromiter(map(len, found), dtype=np.int32, count=len(found)))
        self.size += len(ids) + 1

    def each(self, vocabulary: dict[str, pa.Array]):
        """(group, numbers of the words in the group's ``vocabulary``, whether the next word follows in the
        piece) of every group; the number is -1 and nothing follows if a word is not in it."""
        words = list(self.words)
        for group, (texts, lengths) in self.groups.items():
            known = vocabulary.get(group)
            ids = np.concatenate(texts)
            if known is None or not len(ids):
                continue
            used, ids = np.unique(ids, return_inverse=True)
            number = pc.index_in(pa.array([words[i] for i in used.tolist()], pa.binary()), value_set=known)
            ids = pc.fill_null(number, -1).to_numpy(zero_copy_only=False).astype(np.int64)[ids]
            last = np.zeros(len(ids), dtype=bool)
            last[np.cumsum(np.concatenate(lengths), dtype=np.int64) - 1] = True
            last[-1] = True
            yield group, ids, (ids >= 0) & ~last & (np.r_[ids[1:], -1] >= 0)


def _in_parcels(rows: DataFrame, count) -> DataFrame:
    """Parcels that ``count`` makes of the words of each task, held ``TOGETHER`` at a time."""

    def run(batches):
        def made():
            held = _Held()
            for lang, data in columns_of(batches):
                held.add(lang, data)
                if held.size >= TOGETHER:
                    yield from count(held)
                    held = _Held()
            yield from count(held)

        yield from _sent(made())

    return rows.mapInArrow(run, _PARCEL_DDL)


def _sent(parcels):
    return in_batches(parcels, _PARCEL, size=lambda row: len(row[2]) + 64, most=1 << 22)


def _merged(parcels: DataFrame, merge) -> DataFrame:
    """The rows of ``_COUNTS`` that ``merge`` (lang, parcel, list of its data -> columns) makes of each parcel."""

    def run(batches):
        for (lang, parcel), rows in groupby(columns_of(batches), key=lambda row: row[:2]):
            found = merge(lang, parcel, [data for _, _, data in rows])
            if len(found[0]):
                m = len(found[0])
                columns = [pa.repeat(pa.scalar(lang, pa.string()), m), *[pa.array(c, f.type) for c, f in zip(found, list(_COUNTS)[1:])]]
                yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

    # Dealt by parcel, so the elements of a stripe meet in one task and need no second exchange.
    return parcels.repartition("lang", "parcel").sortWithinPartitions("lang", "parcel").mapInArrow(run, _COUNTS_DDL)


def word_counts(rows: DataFrame, fewest: int) -> DataFrame:
    """(lang, data) -> the words with a count of ``fewest`` or more, and the number of all words (size 0)."""

    def run(batches):
        def flush(counts, totals):
            for group, counted in counts.items():
                yield group, -1, totals[group].to_bytes(8, "little")
                words = sorted(counted)
                parcel = np.fromiter((xxhash.xxh32_intdigest(w) % WORD_PARCELS for w in words), dtype=np.int64, count=len(words))
                n = np.fromiter((counted[w] for w in words), dtype=np.int64, count=len(words))
                order = np.argsort(parcel, kind="stable")
                for p, a, b in _runs(parcel[order]):
                    some = order[a:b]
                    text = _squeezed(b"\n".join([words[i] for i in some.tolist()]))
                    yield group, p, len(text).to_bytes(8, "little") + text + _pack(n[some] & 0xFFFFFFFF, n[some] >> 32)

        def made():
            counts, totals, held = {}, Counter(), 0
            for lang, data in columns_of(batches):
                counted = counts.setdefault(lang, Counter())
                held -= len(counted)
                for words in pieces(data):
                    counted.update(words)
                    totals[lang] += len(words)
                held += len(counted)
                if held >= DISTINCT:
                    yield from flush(counts, totals)
                    counts, totals, held = {}, Counter(), 0
            yield from flush(counts, totals)

        yield from _sent(made())

    def merge(lang, parcel, parts):
        if parcel < 0:
            return [0], [""], [""], [sum(int.from_bytes(part, "little") for part in parts)], [0]
        total = Counter()
        for part in parts:
            to = 8 + int.from_bytes(part[:8], "little")
            low, high = _unpack(part[to:])
            for word, n in zip(_spread(part[8:to]).split(b"\n"), (low + (high << 32)).tolist()):
                total[word] += n
        found = [(word.decode(), n) for word, n in total.items() if n >= fewest]
        m = len(found)
        return [1] * m, [""] * m, [word for word, _ in found], [n for _, n in found], [0] * m

    return _merged(rows.mapInArrow(run, _PARCEL_DDL), merge)


def vocabulary_of(words: DataFrame) -> dict[str, pa.Array]:
    """lang -> its frequent words, the most frequent first; a word's place is its number."""
    got = words.filter("size = 1").select("lang", F.col("next").cast("binary").alias("next"), "n").toArrow().combine_chunks()
    got = got.sort_by([("lang", "ascending"), ("n", "descending"), ("next", "ascending")])
    langs = got.column("lang").to_pylist()
    out = {}
    for lang, rows in groupby(range(len(langs)), key=langs.__getitem__):
        out[lang] = pa.concat_arrays(got.column("next").take(pa.array(list(rows))).chunks).cast(pa.binary())
    return out


def pair_counts(rows: DataFrame, vocabulary: dict[str, pa.Array], fewest: int) -> DataFrame:
    """(lang, data) -> the phrases of two words with a count of ``fewest`` or more, and their hashes."""

    def count(held):
        for group, ids, follows in held.each(vocabulary):
            at = np.flatnonzero(follows)
            keys, n = np.unique(ids[at] << 32 | ids[at + 1], return_counts=True)
            parcel = _parcel_of(_pair_hash(group, keys))
            order = np.argsort(parcel, kind="stable")
            first, second, n = keys[order] >> 32, keys[order] & 0xFFFFFFFF, n[order]
            for p, a, b in _runs(parcel[order]):
                yield group, p, _pack(np.diff(first[a:b], prepend=0), second[a:b], n[a:b])

    def merge(lang, parcel, parts):
        first, second, n = map(np.concatenate, zip(*map(_unpack_first, parts)))
        keys, total, _ = _summed(first << 32 | second, n)
        keys, total = keys[total >= fewest], total[total >= fewest]
        first, second = (_texts(vocabulary[lang], w) for w in (keys >> 32, keys & 0xFFFFFFFF))
        return [2] * len(keys), first, second, total, _pair_hash(lang, keys).view(np.int64)

    return _merged(_in_parcels(rows, count), merge)


def frequent_cells(pairs: DataFrame, cells: int) -> np.ndarray:
    """Bits of the cells of the pairs of ``pair_counts``, and of those with a pair that reaches ``HOT``: two
    rows of ``cells`` bits or more, ``SPARE`` cells for each pair at least.

    The cells of a block meet in a task; two bits a cell reach the driver.
    """
    cells = 1 << (max(cells, SPARE * pairs.count()) - 1).bit_length()
    block = min(_BLOCK, cells)
    cell = F.shiftrightunsigned("h", 64 - (cells.bit_length() - 1))
    rows = pairs.select(F.floor(cell / block).cast("int").alias("block"), (cell % block).cast("int").alias("at"), (F.col("n") >= HOT).alias("hot"))
    schema = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            of, at, hot = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for b in np.unique(of).tolist():
                bits = found.setdefault(b, np.zeros((2, block), dtype=bool))
                bits[0, at[of == b]] = True
                bits[1, at[(of == b) & hot]] = True
        yield from in_batches(((b, np.packbits(bits, axis=1).tobytes()) for b, bits in found.items()), schema)

    got = rows.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary").toArrow()
    out = np.zeros((2, cells // block, block // 8), dtype=np.uint8)
    for b, packed in zip(*(got.column(i).to_pylist() for i in range(2))):
        out[:, b] = np.frombuffer(packed, dtype=np.uint8).reshape(2, -1)
    return out.reshape(2, -1)


def stripes(rows: DataFrame, vocabulary: dict[str, pa.Array], bits: np.ndarray, longest: int) -> DataFrame:
    """(lang, data) -> stripes of the phrases of three words and more of each task, in parcels.

    A parcel has the prefixes of two words in order, with the number of elements of each; then of all
    elements the next words and counts, and with the elements as prefixes the same again.
    """
    cells = bits.shape[1] * 8

    def has(which, h):
        cell = _cell(h, cells)
        return (bits[which][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1

    def count(held):
        for group, ids, follows in held.each(vocabulary):
            width = len(vocabulary[group])
            at = np.flatnonzero(follows)
            h = _pair_hash(group, ids[at] << 32 | ids[at + 1])
            some = has(0, h)
            at, h = at[some], h[some]
            frequent = np.zeros(len(ids), dtype=bool)
            frequent[at] = True
            some = frequent[at + 1]
            at, h = at[some], h[some]
            if not len(at):
                continue
            part = np.where(has(1, h), ids[at + 2] % SLICES + 1, 0)
            parcel = _parcel_of(h + part.astype(np.uint64))
            pairs, label = np.unique(ids[at] << 32 | ids[at + 1], return_inverse=True)
            roots, label = np.unique(parcel * len(pairs) + label, return_inverse=True)
            parcel, pairs = roots // len(pairs), pairs[roots % len(pairs)]
            # Elements stand in order of their prefixes, so those of a parcel are a run in every level.
            levels, size = [], len(roots)
            for k in range(3, longest + 1):
                keys, label, n = np.unique(label * width + ids[at + k - 1], return_inverse=True, return_counts=True)
                levels.append((np.bincount(keys // width, minlength=size), keys % width, n))
                some, size = frequent[at + k - 1], len(keys)
                at, label = at[some], label[some]
            ends = [np.r_[0, np.cumsum(length)] for length, _, _ in levels]
            for p, a, b in _runs(parcel):
                columns = [np.diff(pairs[a:b] >> 32, prepend=0), pairs[a:b] & 0xFFFFFFFF]
                for (length, word, n), end in zip(levels, ends):
                    columns.append(length[a:b])
                    a, b = end[a], end[b]
                    columns += [word[a:b], n[a:b]]
                yield group, p, _pack(*columns)

    return _in_parcels(rows, count)


def stripe_counts(parcels: DataFrame, vocabulary: dict[str, pa.Array], fewest: int) -> DataFrame:
    """Parcels of ``stripes`` -> the phrases of three words and more with a count of ``fewest`` or more."""

    def merge(lang, parcel, parts):
        known = vocabulary[lang]
        first, second, *levels = map(np.concatenate, zip(*map(_unpack_first, parts)))
        pairs, label = np.unique(first << 32 | second, return_inverse=True)
        # Of the prefixes with a count of their own, only frequent ones go on; the last place is for the others.
        alive = np.ones(len(pairs) + 1, dtype=bool)
        of_prefix = lambda at: [f"{a} {b}" for a, b in zip(_texts(known, pairs[at] >> 32), _texts(known, pairs[at] & 0xFFFFFFFF))]
        out = [[], [], [], [], []]
        for i in range(0, len(levels), 3):
            length, word, n = levels[i : i + 3]
            prefix = np.repeat(label, length)
            some = alive[prefix]
            keys, total, place = _summed(prefix[some] * len(known) + word[some], n[some])
            big = np.flatnonzero(total >= fewest)
            label = np.full(len(word), len(keys))
            label[some] = place
            alive = np.zeros(len(keys) + 1, dtype=bool)
            alive[big] = True
            before, after = of_prefix(keys[big] // len(known)), _texts(known, keys[big] % len(known))
            for column, values in zip(out, ([3 + i // 3] * len(big), before, after, total[big].tolist(), [0] * len(big))):
                column += values
            text = dict(zip(big.tolist(), map(" ".join, zip(before, after))))
            of_prefix = lambda at, text=text: [text[x] for x in at.tolist()]
        return out

    return _merged(parcels, merge)


def phrase_counts(docs: DataFrame, text="text", lang="lang", longest=LONGEST, fewest=FEWEST, cells=CELLS) -> DataFrame:
    """lang, size, prefix, next, phrase, n: every phrase of up to ``longest`` words with a count of
    ``fewest`` or more in its language, and a row of size 0 with the number of all words.

    Null texts are empty, a null language is ``und``; repeated rows count each time.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("data"),
    )
    merged = words = keep(word_counts(rows, fewest), "words")
    vocabulary = vocabulary_of(words)
    if longest > 1:
        pairs = keep(pair_counts(rows, vocabulary, fewest), "pairs")
        merged = merged.union(pairs)
    if longest > 2:
        dealt = stripes(rows, vocabulary, frequent_cells(pairs, cells), longest)
        merged = merged.union(keep(stripe_counts(dealt, vocabulary, fewest), "stripes"))
    phrase = F.when(F.col("size") > 1, F.concat_ws(" ", "prefix", "next")).otherwise(F.col("next"))
    return merged.select("lang", "size", "prefix", "next", phrase.alias("phrase"), "n")


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(counts: DataFrame, subsumed: int = SUBSUMED) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer one subsumes.

    ``counts`` is the table of ``phrase_counts``. score is floor(1000 a n / (l r)) at the cut with the
    lowest score (the first of them); a phrase goes if one that holds it has ``subsumed`` percent
    of its count or more. It is enough to look at phrases one word longer: one that is two words longer
    holds one that is one word longer, which is as frequent at least.
    """
    total = counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    count_of = counts.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("found"))
    long = counts.filter("size > 1")
    words = F.split("phrase", " ", -1)
    cuts = long.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _part(words, F.lit(1), F.col("k")), "rest": _part(words, F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(count_of.toDF("lang", "first", "l"), ["lang", "first"]).join(count_of.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = cuts.join(total, "lang")
    big = lambda c, p: f"cast({c} as decimal({p}, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({big('a', 18)} * {big(1000, 4)} * {big('total', 15)}) div ({big('l', 18)} * {big('r', 18)})"))
    lowest = cuts.groupBy("lang", "phrase", "size", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))

    longer = long.filter("size > 2")
    rest = _part(words, F.lit(2), F.col("size") - 1)
    holds = longer.select("lang", F.col("prefix").alias("phrase"), F.col("n").alias("over")).union(longer.select("lang", rest, "n"))
    holds = holds.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = lowest.join(holds, ["lang", "phrase"], "left").filter(f"over is null or 100 * over < {int(subsumed)} * a")
    return left.select("lang", "phrase", "a", "low.l", "low.r", F.col("total").alias("n"), "low.score")


def best_by_language(found: DataFrame, best: int = BEST) -> DataFrame:
    """The first ``best`` phrases of each language with their rank: score, then count, then phrase.

    Two steps, so that a language with most of the phrases is ordered by many tasks at first.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    slot = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = found.withColumn("_slot", slot).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slot").orderBy(*order)))
    some = some.filter(F.col("rank") <= best).drop("_slot", "rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= best)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = phrase_counts(table(spark, sf_dir, "documents").select("text", "lang"))
    return best_by_language(collocations(counts)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), t AS (
  SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 6) AS s(k)
), c AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100
), cut AS (
  SELECT lang, phrase, f, k, unnest(range(1, k)) AS i, string_split(phrase, ' ') AS ws FROM c WHERE k > 1
), s AS (
  SELECT cut.lang, cut.phrase, cut.f, cut.k, i, a.f AS l, b.f AS r, t.n,
    (1000::HUGEINT * cut.f::HUGEINT * t.n::HUGEINT) // (a.f::HUGEINT * b.f::HUGEINT) AS score
  FROM cut JOIN t USING (lang)
  JOIN c AS a ON a.lang = cut.lang AND a.phrase = array_to_string(ws[1:i], ' ')
  JOIN c AS b ON b.lang = cut.lang AND b.phrase = array_to_string(ws[i + 1:], ' ')
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), inside AS (
  SELECT DISTINCT lang, f, array_to_string(ws[x:y], ' ') AS phrase
  FROM (SELECT DISTINCT lang, f, k, ws FROM cut), range(1, 6) AS o(x), range(1, 6) AS u(y)
  WHERE x < y AND y <= k AND y - x + 1 < k
), kept AS (
  SELECT * FROM low WHERE NOT EXISTS (
    SELECT 1 FROM inside WHERE inside.lang = low.lang AND inside.phrase = low.phrase AND 100 * inside.f >= 100 * low.f)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, f AS a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
