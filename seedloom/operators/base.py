"""Small checks and keys shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.session import settle


def as_list(cols) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


# Accepted spellings of the sample id column.
ID_ALIASES = ("SampleID", "sample_id", "sampleid", "Sample", "sample", "ID", "id", "IID")


def standardize_id(df: DataFrame, to: str = "SampleID") -> DataFrame:
    """Rename the first known id spelling to ``to`` and trim it to a string."""
    for alias in ID_ALIASES:
        if alias in df.columns:
            out = df if alias == to else df.withColumnRenamed(alias, to)
            return out.withColumn(to, F.trim(F.col(to).cast("string")))
    raise ValueError(f"no sample id column among {df.columns}")


def is_finite(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(is_finite(c), c)


def valid_positions(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where every named column is a finite number."""
    out = df
    for c in cols:
        out = out.filter(is_finite(c))
    return out


def seeded_key(seed: int, *cols) -> Column:
    """A reproducible pseudo-random sort key: depends on key values, never on partitioning."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(F.lit(seed), *parts)


def seeded_unit(seed: int, *cols) -> Column:
    """A reproducible uniform number in [0, 1)."""
    return F.pmod(seeded_key(seed, *cols), F.lit(1 << 30)).cast("double") / float(1 << 30)


def ratio(num: Column, den: Column) -> Column:
    """num/den, null where den is zero."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table (a global aggregate) on every row of ``df``.

    The side carried to all tasks is a single aggregate row by construction.
    """
    key = "_one"
    small = one_row.withColumn(key, F.lit(1))
    return df.withColumn(key, F.lit(1)).join(F.broadcast(small), key).drop(key)


# Largest side, in rows and in bytes of its values, that joins here may hand to every task.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after seeing that ``df`` has at most ``rows`` rows and ``size`` bytes.

    The table is settled first, so that it is computed once and the look at its size is
    cheap. A larger one joins by shuffle.
    """
    kept = settle(df)
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept.columns]))) if kept.columns else F.lit(0)
    seen = kept.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return F.broadcast(kept) if seen["n"] <= rows and (seen["b"] or 0) <= size else kept


# Rows that one task sorts or keeps in hash tables. Partitions cut by their shuffled bytes do not bound it: rows
# that compress well take many times that in memory.
TASK_ROWS = 250_000


def tasks_of(df: DataFrame, rows: int) -> int:
    """Number of tasks for ``rows`` rows, 0 if one can hold them."""
    return 0 if rows <= TASK_ROWS else max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, rows: int, *keys) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of about ``TASK_ROWS`` of its ``rows``; what one task holds stays as it is."""
    tasks = tasks_of(df, rows)
    return df.repartition(tasks, *keys) if tasks else df


def for_each(left: DataFrame, right: DataFrame, key, shards: int = 16) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, where that product is the result asked for.

    A hash join on a shard of the left key: the right side is repeated once per shard and
    broadcast only when that is seen to be small, else both sides shuffle.
    """
    keyed = small_side(right.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    shard = F.pmod(F.xxhash64(*as_list(key)), F.lit(shards)).cast("int")
    return left.withColumn("_k", shard).join(keyed, "_k").drop("_k")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` (a column -> column function).

    Without it the optimizer may repeat an array expression for every element of a lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
