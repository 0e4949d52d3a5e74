"""I-Match fingerprints over an inverse-document-frequency band.

The lexicon holds the terms in a band of document frequencies given as shares of the corpus, so
it has at most (mean distinct terms of a document) / (lower share) terms, however large the
corpus. A fingerprint is a row of hashes: one for each of several randomised subsets of the
lexicon, over the sorted distinct terms of the text that the subset holds. Subsets of many sizes
are drawn: large ones tell small edits apart, small ones survive large edits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import WordHashes, columns_of, in_batches, keep, table

# Terms found in less than the first or more than the second share of documents are left out.
BAND = (0.001, 0.05)
# Subsets hold 1, 1/2, 1/4, ... of the lexicon; so many of each size.
SIZES, DRAWS = 12, 8
# A text with fewer lexicon terms is fingerprinted over all its terms.
FEWEST = 4

_FIRST = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([d * 0x632BE59BD9B4E019 & 2**64 - 1 for d in range(DRAWS)], dtype=np.uint64)


def terms(text: str, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the words of a text."""
    return np.unique(words.of(text)).view(np.int64)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(text) -> term, df over all rows. Each task sums what it has read before it is shuffled."""

    def run(batches):
        words = WordHashes()
        held, size = [], 0
        for (text,) in columns_of(batches):
            held.append(terms(text, words))
            size += len(held[-1])
            if size > 2_000_000:
                yield _counted(held)
                held, size = [], 0
        if size:
            yield _counted(held)

    def _counted(held):
        term, df = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], names=["term", "df"])

    return docs.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, band=BAND) -> np.ndarray:
    """Sorted hashes of the terms in the band. Its size bound is in the module's docstring."""
    total = docs.count()
    low, high = band[0] * total, band[1] * total
    rows = document_frequencies(docs).filter((F.col("df") >= low) & (F.col("df") <= high)).select("term")
    return np.sort(rows.toPandas()["term"].to_numpy(dtype=np.int64))


def subset_hashes(own: np.ndarray) -> np.ndarray:
    """16-bit hash of the sorted terms in each subset, 0 where a subset holds none of them.

    The subsets of one draw are nested: a term of level n is in the n + 1 largest, and each
    level holds half of the terms of the one before. Terms are sorted by falling level, then by
    hash, so every subset is a prefix and one running hash gives all of a draw's.
    """
    out = np.zeros(SIZES * DRAWS, dtype=np.uint16)
    with np.errstate(over="ignore"):
        m = (own.view(np.uint64) ^ _SALTS[:, None]) * _FIRST
        m = (m ^ (m >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    # Leading zero bits; the top bits of a product are its best mixed ones.
    level = np.minimum(64 - np.frexp(m.astype(np.float64))[1], SIZES - 1)
    order = np.argsort(-level, axis=1, kind="stable")
    ends = (level[:, None, :] >= np.arange(SIZES)[None, :, None]).sum(axis=2)
    for d in range(DRAWS):
        held, running, at = own[order[d]].tobytes(), xxhash.xxh32(seed=d), 0
        for size in range(SIZES - 1, -1, -1):
            end = int(ends[d, size])
            if end:
                running.update(held[8 * at : 8 * end])
                out[size * DRAWS + d] = running.intdigest() % 65_535 + 1
                at = end
    return out


def fingerprint(text: str, words: WordHashes, lex: np.ndarray) -> np.ndarray:
    all_terms = terms(text, words)
    if len(lex) and len(all_terms):
        at = np.minimum(np.searchsorted(lex, all_terms), len(lex) - 1)
        own = all_terms[lex[at] == all_terms]
        if len(own) >= FEWEST:
            return subset_hashes(own)
    return subset_hashes(all_terms)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the subsets that hold terms of either; 1 for two empty texts."""
    either = (a != 0) | (b != 0)
    return float((a == b)[either].mean()) if either.any() else 1.0


def show(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def ordered_with_halo(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc, text) dealt out by ranges of doc, each range in order and followed by the first row
    of the next range (the last by the first of all), marked ``halo``.

    Range bounds are figures of the ids, so a lost task finds its rows again; one row for each
    range travels twice.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce("doc", F.lit(-(2**63))).alias("doc"))
    cut = ids.agg(F.percentile_approx("doc", [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cut))
    # Part of a row: number of cuts at or below its id. As an array position, found by bisection
    # in the engine: width_bucket takes an ordered array of bounds.
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    at = lambda c: F.lit(0) if bounds is None else F.size(F.filter(bounds, lambda b: b <= c))
    dealt = docs.withColumn("key", F.coalesce("doc", F.lit(-(2**63)))).withColumn("part", at(F.col("key")))
    firsts = {r["part"]: r["first"] for r in ids.groupBy(at(F.col("doc")).alias("part")).agg(F.min("doc").alias("first")).collect()}
    if not firsts:
        return dealt.withColumn("halo", F.lit(False)).drop("key")
    order = sorted(firsts)
    before = {firsts[p]: order[i - 1] for i, p in enumerate(order)}
    lead = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])
    copies = F.array(F.struct(F.col("part"), F.lit(False).alias("halo")))
    also = F.element_at(lead, F.col("key"))
    both = F.when(also.isNull(), copies).otherwise(
        F.concat(copies, F.array(F.struct(also.alias("part"), F.lit(True).alias("halo"))))
    )
    spread = dealt.withColumn("to", F.explode(both)).select("doc", "text", "to.part", "to.halo")
    return spread.repartition("part").sortWithinPartitions("part", "halo", "doc", "text")


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def _edited(lex: np.ndarray):
    def run(batches):
        words = WordHashes()

        def pairs():
            """Each row with the next of its part; of several halo rows the first counts."""
            held = None
            for doc, text, part, halo in columns_of(batches):
                if held is not None and held[2] == part:
                    yield held[0], held[1], text
                    held = None if halo else (doc, text, part)
                elif not halo:
                    held = doc, text, part

        def rows():
            known_text = known = None
            for doc, text, following in pairs():
                own = known if text is known_text else fingerprint(text, words, lex)
                n = len(text)
                edited = text[: n - n // 2] + following[: n // 2]
                changed = fingerprint(edited, words, lex)
                known_text, known = following, fingerprint(following, words, lex)
                digest = hashlib.sha256(edited.encode()).hexdigest()
                yield doc, n, digest, show(own), show(changed), likeness(own, changed), likeness(own, known)

        return in_batches(rows(), _OUT)

    return run


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", band=BAND) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    A null text is empty; empty texts have the fingerprint of no terms, and likeness 1 to each
    other. Rows follow each other by doc_id (nulls first), those that share one by text; the
    last is followed by the first, a single row by itself. Other columns are ignored.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    lex = lexicon(d.select("text"), band)
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered_with_halo(d).mapInArrow(_edited(lex), kinds)


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
