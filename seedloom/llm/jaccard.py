"""N-gram Jaccard join by MinHash banding.

1. Every text becomes the set of hashes of its word n-grams; texts with equal sets form one
   class from here on, so a group of copies costs one row.
2. Band hashes of the classes are shuffled; classes that share a band are joined to the smallest
   of them (a star, not all pairs) and the stars grow into candidate clusters.
3. Within a cluster, blocks of classes meet block by block and every pair is verified on the
   full sets by a matrix product in the task; a pair is never a row. Out come, per class, its
   number of links, and one row for each class to the smallest it is linked with in that block.
4. Those rows connect the classes into groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import WordHashes, choose_bands, columns_of, in_batches, keep, table, text_or_empty

N = 5
THRESHOLD = 0.8
RECALL = 0.999
# Classes in a block; a cluster of up to this many is verified in one step.
BLOCK = 256
# The same by the n-grams of its texts.
BLOCK_GRAMS = 1_000_000
# Cells of a block's membership matrix that are held at once.
CELLS = 8_000_000

_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) | 1 for k in range(64)], dtype=np.uint64)


def shingles(text: str, words: WordHashes, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram of all its words."""
    h = words.of(text)
    if not len(h):
        return h
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        s = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for j in range(k):
            s = (s ^ h[j : len(h) - k + 1 + j]) * _MIX[j]
            s ^= s >> np.uint64(29)
    return np.unique(s)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_240_607))
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, count, dtype=np.uint64)


def band_hashes(s: np.ndarray, bands: int, rows: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """One signed 64-bit hash per band of the MinHash signature of a set."""
    low = np.full(bands * rows, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 512):
            v = s[at : at + 512, None] * a + b
            low = np.minimum(low, (v ^ (v >> np.uint64(31))).min(axis=0))
    return [
        xxhash.xxh64_intdigest(np.append(low[i * rows : (i + 1) * rows], np.uint64(i)).tobytes()) - 2**63
        for i in range(bands)
    ]


_SIGNED = pa.schema([("doc", pa.int64()), ("set_hash", pa.string()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def set_hash(s: np.ndarray) -> str:
    """128 bits that stand for an n-gram set; the empty string for the empty set."""
    return xxhash.xxh128_hexdigest(s.tobytes()) if len(s) else ""


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc, text) -> doc, set_hash, size of the set, band hashes (none for the empty set)."""

    def run(batches):
        words, (a, b) = WordHashes(), _permutations(bands * rows)

        def sign():
            for doc, text in columns_of(batches):
                s = shingles(text, words, n)
                yield doc, set_hash(s), len(s), band_hashes(s, bands, rows, a, b) if len(s) else []

        return in_batches(sign(), _SIGNED)

    return docs.mapInArrow(run, "doc long, set_hash string, size long, bands array<long>")


def grow_clusters(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) is connected to.

    Each round, every node takes the smallest label among its neighbours' labels, and labels
    jump to the label of their own node; chains halve. Each round's table is written to the
    shared folder, so lineage stays short. The only figure that reaches the driver is how many
    labels changed.
    """
    both = keep(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges"
    )
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), name)
    for _ in range(most):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        hooked = labels.join(seen.withColumnRenamed("a", "node"), "node", "left").select(
            "node", "root", F.least("root", F.coalesce("m", "root")).alias("m")
        )
        up = labels.select(F.col("node").alias("m"), F.col("root").alias("above"))
        new = keep(
            hooked.join(up, "m", "left").select(
                "node",
                F.least("m", F.coalesce("above", "m")).alias("root"),
                (F.least("m", F.coalesce("above", "m")) < F.col("root")).alias("moved"),
            ),
            name,
        )
        moved = new.filter("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            return labels
    raise RuntimeError(f"{name}: clusters still grow after {most} rounds")


def _links(sets_a, sets_b, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of two blocks with similarity ``threshold`` or more."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    flat = np.concatenate([*sets_a, *sets_b])
    _, col = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(sets_a) + len(sets_b)), np.concatenate([size_a, size_b]))
    shared = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    wide = max(1, CELLS // (len(sets_a) + len(sets_b)))
    for lo in range(0, int(col[-1]) + 1, wide):
        i, j = np.searchsorted(col, [lo, lo + wide])
        m = np.zeros((len(sets_a) + len(sets_b), min(wide, int(col[-1]) + 1 - lo)), dtype=np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        shared += m[: len(sets_a)] @ m[len(sets_a) :].T
    shared = shared.astype(np.int64)
    # Integers decide, so that exactly 0.8 counts: shared / (a + b - shared) >= threshold.
    parts = round(threshold * 1_000_000)
    return shared * (1_000_000 + parts) >= parts * (size_a[:, None] + size_b[None, :])


def _smallest_linked(hit: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the smallest index it is connected to."""
    label = np.arange(len(hit))
    while True:
        best = np.minimum(label, np.where(hit, label[None, :], len(hit)).min(axis=1))
        if (best == label).all():
            return label
        label = best


_FOUND = pa.schema([("node", pa.string()), ("links", pa.int64()), ("root", pa.string())])


def _verify(threshold: float, n: int):
    def run(key, rows):
        words, found = WordHashes(), {}
        for node, block, text in columns_of(rows.select(["node", "block", "text"]).to_batches()):
            s = shingles(text, words, n)
            if set_hash(s) == node:  # a row that shares its doc_id can have another set
                found[node] = block, s
        low, high = key[1].as_py(), key[2].as_py()
        names = sorted(found, key=lambda v: (found[v][0] != low, v))
        x = [v for v in names if found[v][0] == low]
        y = x if low == high else [v for v in names if found[v][0] == high]
        if not x or not y:
            return _FOUND.empty_table()
        hit = _links([found[v][1] for v in x], [found[v][1] for v in y], threshold)
        if low == high:
            np.fill_diagonal(hit, False)
        else:
            square = np.zeros((len(names), len(names)), dtype=bool)
            square[: len(x), len(x) :] = hit
            square[len(x) :, : len(x)] = hit.T
            hit = square
        links, label = hit.sum(axis=1), _smallest_linked(hit)
        linked = np.flatnonzero(links)
        return pa.Table.from_arrays(
            [pa.array([names[i] for i in linked], pa.string()), pa.array(links[linked], pa.int64()), pa.array([names[label[i]] for i in linked], pa.string())],
            schema=_FOUND,
        )

    return run


def similarity_join(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, set_id.

    Words are the white-space tokens in lower case without punctuation at their ends; a text of
    fewer than ``n`` words is a single n-gram of all its words. ``set_id`` is the smallest
    doc_id with the same n-gram set; texts without any word (null, empty, only punctuation)
    share the empty set, which is linked to no other. ``n_links`` counts the other sets with
    similarity ``threshold`` or more (copies are not links), ``class_id`` is the smallest doc_id
    reached over links and copies. Rows that share a doc_id each have a row of the result.
    A null doc_id is never a set_id; a set that only null ids hold is not compared. An empty
    table gives an empty result. Other columns are ignored.

    Pairs at the threshold are found with probability ``recall``, more similar ones more often;
    all that are reported are exact.
    """
    bands, rows = choose_bands(threshold, recall)
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    signed = keep(signatures(d, n, bands, rows), "signatures")
    # One row per set; copies meet in partial aggregates, not in one task.
    nodes = signed.filter("doc is not null").groupBy(F.col("set_hash").alias("node")).agg(
        F.min("doc").alias("set_id"), F.max("size").alias("size"), F.first("bands").alias("bands")
    )
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    stars = buckets.groupBy("band", "bucket").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    edges = buckets.join(stars, ["band", "bucket"]).filter("node > b").select(F.col("node").alias("a"), "b")
    clusters = grow_clusters(edges, "candidates").join(nodes.drop("bands"), "node")
    blocks = clusters.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_GRAMS))).cast("int").alias("blocks")
    )
    placed = clusters.join(blocks, "root").select(
        "node", "root", "blocks", F.col("set_id").alias("doc"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("block")
    )
    met = d.join(placed, "doc").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "root", "block", "text", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    found = keep(
        met.groupBy("root", "low", "high").applyInArrow(_verify(threshold, n), "node string, links long, root string"), "links"
    )
    # A root of two blocks is of the lower block, and may be greater than its nodes.
    groups = grow_clusters(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "groups")
    linked = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    members = nodes.select("node", "set_id").join(linked, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = members.join(members.groupBy("root").agg(F.min("set_id").alias("class_id")), "root").select(
        F.col("node").alias("set_hash"), "set_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    return signed.select("doc", "set_hash").join(named, "set_hash", "left").select(
        F.col("doc").alias("doc_id"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "set_id"
    )


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))
