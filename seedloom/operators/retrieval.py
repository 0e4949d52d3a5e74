"""Nearest neighbours over embeddings, exact and by centroid lists, and what is built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedloom.operators.base import as_list, seeded_unit
from seedloom.session import settle

# Vector components in the query block and the item block that meet in one task.
QUERY_VALUES = 1 << 20
ITEM_VALUES = 1 << 21
# Queries and items whose scores a task holds at a time, whatever the width of the vectors.
QUERY_TILE, ITEM_TILE = 1024, 2048
# New candidates for each query of a tile that are merged by sorting; more are picked by the k-th value.
MERGED = 64

PAIR = "query_id long, item_id long, score double"


def _block_rows(df: DataFrame, vec: str) -> tuple[int, int, int]:
    """Rows of ``df``, and rows per query block and per item block for the width of these vectors."""
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    d = max(1, seen["d"] or 1)
    return seen["n"], max(1, QUERY_VALUES // d), max(1, ITEM_VALUES // d)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    s = q @ x.T
    if metric == "ip":
        return s
    if metric == "l2":
        return -(np.square(q).sum(1)[:, None] - 2 * s + np.square(x).sum(1)[None, :])
    raise ValueError(metric)


def _top(q_ids, q, x_ids, x, k, metric) -> pa.Table:
    """Best k items of each query, scored tile by tile: only one tile of scores is held."""
    # ids break ties, so the same pairs win however the items are split
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    k = min(k, len(x_ids))
    found = []
    for at in range(0, len(q_ids), QUERY_TILE):
        best, score = _top_tile(q[at : at + QUERY_TILE], x, k, metric)
        found.append((np.repeat(q_ids[at : at + QUERY_TILE], k), x_ids[best.ravel()], score.ravel()))
    return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "item_id", "score"), zip(*found))})


def _top_tile(q: np.ndarray, x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the best k items of each query, and their scores; of equal scores the first items win."""
    best = np.empty((len(q), 0), dtype=np.int64)
    score = np.empty((len(q), 0))
    for at in range(0, len(x), ITEM_TILE):
        s = _scores(q, x[at : at + ITEM_TILE], metric)
        if best.shape[1] == k:
            # an item that comes later needs more than the k-th score
            row, col = np.nonzero(s > score[:, -1:])
            if len(row) <= MERGED * len(q):
                some, place = np.unique(row, return_inverse=True)
                rows = np.concatenate([np.repeat(np.arange(len(some)), k), place])
                cols = np.concatenate([best[some].ravel(), col + at])
                values = np.concatenate([score[some].ravel(), s[row, col]])
                order = np.lexsort((cols, -values, rows))
                first = np.searchsorted(rows[order], np.arange(len(some)))
                keep = order[first[:, None] + np.arange(k)]
                best[some], score[some] = cols[keep], values[keep]
                continue
        # the best so far stand before the new ones, in order: ties stay with them
        s = np.concatenate([score, s], axis=1)
        ids = np.concatenate([best, np.broadcast_to(np.arange(at, at + s.shape[1] - best.shape[1]), (len(q), s.shape[1] - best.shape[1]))], axis=1)
        pick = _partial(s, min(k, s.shape[1]))
        best, score = np.take_along_axis(ids, pick, 1), np.take_along_axis(s, pick, 1)
    return best, score


def _partial(s: np.ndarray, k: int) -> np.ndarray:
    """Stable top-k columns: everything above the k-th value, then its ties from the left."""
    if k == s.shape[1]:
        return np.argsort(-s, axis=1, kind="stable")
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((s.shape[0], k), dtype=np.int64)
    for i in range(s.shape[0]):
        cand = np.flatnonzero(s[i] >= kth[i, 0])
        out[i] = cand[np.argsort(-s[i, cand], kind="stable")[:k]]
    return out


def _matrix(col) -> np.ndarray:
    """Vectors of one width, as a pandas or an Arrow column, as the rows of a matrix."""
    if isinstance(col, pd.Series):
        return np.stack(col.to_numpy()).astype(np.float64)
    width = pc.list_value_length(col)
    if col.null_count or pc.count_distinct(width).as_py() != 1:
        raise ValueError("vectors must be known and of one width")
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(col), -1)


def _meet_blocks(q: DataFrame, x: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """k items for each query of a block (id, v), out of the items of the block with the same keys."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _top(a["id"].to_numpy(), _matrix(a["v"]), b["id"].to_numpy(), _matrix(b["v"]), k, metric)

    return keep_top(q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(meet, PAIR), k)


def keep_top(pairs: DataFrame, k: int, by=("query_id",)) -> DataFrame:
    """Best k pairs per query with their rank; Spark trims to k per task before the shuffle."""
    w = Window.partitionBy(*as_list(by)).orderBy(F.col("score").desc(), F.col("item_id"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_join(queries: DataFrame, items: DataFrame, k: int, metric: str = "ip", q_key: str = "query_id", i_key: str = "item_id", vec: str = "embedding") -> DataFrame:
    """Exact top-k items per query: (query_id, item_id, score, rank).

    Queries and items are cut into blocks of fixed size; every pair of blocks meets in one
    task as matrix products that keep k items per query. No pair list is ever written, and
    a task never holds more than one block of each side and one tile of scores.
    """
    ni, q_rows, i_rows = _block_rows(items, vec)
    nq = queries.count()
    bq, bi = max(1, math.ceil(nq / q_rows)), max(1, math.ceil(ni / i_rows))
    q = queries.select(F.col(q_key).alias("id"), F.col(vec).alias("v"))
    x = items.select(F.col(i_key).alias("id"), F.col(vec).alias("v"))
    q = q.withColumn("bq", F.pmod(F.xxhash64("id"), F.lit(bq)).cast("int")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.lit(bi - 1))))
    x = x.withColumn("bi", F.pmod(F.xxhash64("id"), F.lit(bi)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    return _meet_blocks(q, x, ["bq", "bi"], k, metric)


def train_centroids(items: DataFrame, n_lists: int, rate: float = 1.0, seed: int = 1, vec: str = "embedding", key: str = "item_id", iterations: int = 20) -> np.ndarray:
    """K-means centroids (n_lists x dims) of all vectors, or of a hash sample at the given rate."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    picked = items if rate >= 1 else items.filter(seeded_unit(seed, key) < rate)
    vectors = picked.select(array_to_vector(F.transform(vec, lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=iterations).fit(vectors)
    return np.array(model.clusterCenters())


def assign_lists(df: DataFrame, centroids: np.ndarray, n: int, vec: str = "embedding") -> DataFrame:
    """The ``n`` nearest centroid lists of each vector as rows (..., list_id)."""

    def nearest(v: pd.Series) -> pd.Series:
        s = _scores(_matrix(v), centroids, "l2")
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return df.withColumn("list_id", F.explode(F.pandas_udf(nearest, "array<int>")(vec)))


def knn_join_ivf(queries: DataFrame, items: DataFrame, k: int, n_lists: int, nprobe: int, rate: float = 1.0, metric: str = "ip", seed: int = 1, q_key: str = "query_id", i_key: str = "item_id", vec: str = "embedding") -> DataFrame:
    """Approximate top-k: search the ``nprobe`` nearest of ``n_lists`` centroid lists, exactly inside.

    A list of any size is cut into blocks by its own row count, so a crowded centroid becomes
    many tasks.
    """
    x = items.select(F.col(i_key).alias("id"), F.col(vec).alias("embedding"))
    q = queries.select(F.col(q_key).alias("id"), F.col(vec).alias("embedding"))
    centroids = train_centroids(x, n_lists, rate, seed, key="id")
    x = settle(assign_lists(x, centroids, 1))
    q = settle(assign_lists(q, centroids, nprobe))
    _, q_rows, i_rows = _block_rows(x, "embedding")
    sizes = x.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / i_rows).cast("int").alias("nb"))
    qsizes = q.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / q_rows).cast("int").alias("nq"))
    # one row per list, so n_lists rows at most
    shape = {r["list_id"]: (r["nb"], r["nq"]) for r in sizes.join(qsizes, "list_id").limit(n_lists).collect()}
    blocks = lambda i: F.element_at(F.create_map(*[F.lit(v) for k, n in shape.items() for v in (k, n[i])]), F.col("list_id"))
    x, q = (d.filter(F.col("list_id").isin(*shape)) for d in (x, q))
    x = x.withColumn("bi", F.pmod(F.xxhash64("id"), blocks(0)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), blocks(1) - 1)))
    q = q.withColumn("bq", F.pmod(F.xxhash64("id"), blocks(1)).cast("int")).withColumn("bi", F.explode(F.sequence(F.lit(0), blocks(0) - 1)))

    x, q = (d.withColumnRenamed("embedding", "v") for d in (x, q))
    return _meet_blocks(q, x, ["list_id", "bq", "bi"], k, metric)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    hit = exact.select("query_id", "item_id").join(found.select("query_id", "item_id").withColumn("_h", F.lit(1)), ["query_id", "item_id"], "left")
    return hit.agg(F.avg(F.coalesce("_h", F.lit(0)).cast("double")).alias("recall"))


def drop_same_document(neighbours: DataFrame, sample_docs: DataFrame, item_docs: DataFrame, k: int) -> DataFrame:
    """Neighbours from other documents than the query's, first k kept, as an array padded with -1.

    ``neighbours`` (query_id, item_id, rank); ``sample_docs`` (query_id, doc_id) all
    documents of the query's sample; ``item_docs`` (item_id, doc_id).
    """
    rows = neighbours.join(item_docs, "item_id").join(sample_docs, ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank", "item_id")
    kept = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)
    lists = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "item_id"))), lambda s: s["item_id"]).alias("_n"))
    out = neighbours.select("query_id").distinct().join(lists, "query_id", "left")
    have = F.coalesce("_n", F.array().cast("array<bigint>"))
    fill = F.array_repeat(F.lit(-1).cast("long"), F.lit(k) - F.size(have))
    return out.select("query_id", F.concat(have, fill).alias("neighbours"))


def neighbour_continuation(neighbours: DataFrame, chunks: DataFrame, n_next: int = 1) -> DataFrame:
    """Tokens of each neighbour chunk and of the ``n_next`` chunks after it (ids wrap around)."""
    n = chunks.count()
    rows = neighbours.filter(F.col("item_id") >= 0).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_next))))
    rows = rows.withColumn("chunk_id", F.pmod(F.col("item_id") + F.col("step"), F.lit(n)))
    return rows.join(chunks.select("chunk_id", "tokens"), "chunk_id")


def top_similar(pairs: DataFrame, k: int, topic: str | None = None, one_per_topic: bool = False, ascending: bool = False, query: str = "query_id") -> DataFrame:
    """The k most similar examples per query, listed from least to most similar.

    ``one_per_topic`` keeps the best example of each topic first. ``ascending`` ranks the
    least similar examples first, the order an earlier tool used.
    """
    score = F.col("score").asc() if ascending else F.col("score").desc()
    rows = pairs
    if one_per_topic:
        w = Window.partitionBy(query, topic).orderBy(F.col("score").desc(), F.col("item_id"))
        rows = rows.withColumn("_t", F.row_number().over(w)).filter("_t = 1").drop("_t")
    w = Window.partitionBy(query).orderBy(score, F.col("item_id"))
    rows = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)
    count = F.count(F.lit(1)).over(Window.partitionBy(query))
    return rows.withColumn("place", count - F.col("_k") + 1).drop("_k")
