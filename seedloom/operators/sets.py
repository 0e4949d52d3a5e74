"""Unions, de-duplication, upserts and shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedloom.operators.base import as_list, attach_row, small_side
from seedloom.operators.ordered import ordered_scan, row_index, running_sum


def union_shards(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_wide(dfs: list[DataFrame], fill: str = "NA", places: int = 4) -> DataFrame:
    """Union of tables with different columns; numbers as fixed-point text, gaps as ``fill``."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    for c, t in out.dtypes:
        text = F.format_string(f"%.{places}f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string")
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.lit(fill)).otherwise(text))
    return out


def first_wins(df: DataFrame, key, order) -> DataFrame:
    """The first row of each key; the row is picked before the shuffle, so copies cost little."""
    w = Window.partitionBy(*as_list(key)).orderBy(*[F.col(c) for c in as_list(order)])
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")


def drop_duplicate_windows(df: DataFrame, keys=("chrom", "start", "end")) -> DataFrame:
    return df.dropDuplicates(as_list(keys))


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys, order="layer") -> DataFrame:
    """Results with the newest row per key; several old matches become the one new row."""
    keys = as_list(keys)
    both = existing.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("_age", *[F.col(c) for c in existing.columns if c not in keys])
    # old rows without a new match stay as they are, even when repeated
    newest = both.filter("_age = 0").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_age")
    kept = existing.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(newest).orderBy(order)


def merge_unique(dfs: list[DataFrame], id_col: str) -> DataFrame:
    """Union of shards; an id found twice is an error."""
    out = union_shards(dfs)
    twice = out.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {id_col}: {twice[0][0]}")
    return out


def partition_slice(df: DataFrame, part: int, n_parts: int, order) -> DataFrame:
    """Rows [floor(i N / n), floor((i + 1) N / n)) in the given order."""
    out = ordered_scan(df, None, order, _i=row_index(), _rest=row_index(reverse=True))
    n = F.col("_i") + F.col("_rest") - 1
    at = F.col("_i") - 1
    lo, hi = F.floor(n * part / n_parts), F.floor(n * (part + 1) / n_parts)
    return out.filter((at >= lo) & (at < hi)).drop("_i", "_rest")


def union_indexed(left: dict[str, DataFrame], right: dict[str, DataFrame], order) -> DataFrame:
    """Window sets present on both sides, with a local index and a global one.

    Names are taken in sorted order; each set's rows follow the previous set's.
    """
    names = sorted(set(left) & set(right))
    if not names:
        raise ValueError("no common names")
    parts = [left[n].withColumn("name", F.lit(n)) for n in names]
    both = union_shards(parts)
    out = ordered_scan(both, "name", order, _i=row_index())
    sizes = both.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    offsets = ordered_scan(sizes, None, "name", _c=running_sum("_n")).select("name", (F.col("_c") - F.col("_n")).alias("_off"))
    out = out.join(small_side(offsets), "name")
    return out.select(*both.columns, (F.col("_i") - 1).alias("local_index"), (F.col("_off") + F.col("_i") - 1).alias("global_index"))


def take_every(df: DataFrame, order: str, stride: int, limit: int, tie: str) -> DataFrame:
    """Every ``stride``-th row counted from the newest, at most ``limit``, oldest first."""
    out = ordered_scan(df, None, [order, tie], _back=row_index(reverse=True))
    picked = out.filter(((F.col("_back") - 1) % stride == 0) & (F.col("_back") <= limit * stride))
    return picked.drop("_back").orderBy(order, tie)


def order_by_work(df: DataFrame, samples: str, seqs: str, max_length: str) -> DataFrame:
    """Longest work first: samples x sequences x length."""
    out = df.withColumn("work", F.col(samples) * F.col(seqs) * F.col(max_length))
    return out.orderBy(F.desc("work"), *df.columns)
