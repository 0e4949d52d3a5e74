"""Sample x position matrices: wide CSV files and the long table used everywhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.operators.base import as_list, finite_or_null, small_side


def matrix_from_arrays(df: DataFrame, col: str, keep) -> DataFrame:
    """One array per sample -> rows (keep..., position, value) with 1-based positions."""
    return df.select(*as_list(keep), F.posexplode(col).alias("_i", "value")).select(
        *as_list(keep), (F.col("_i") + 1).cast("long").alias("position"), "value"
    )


def read_position_matrix(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Wide ``sample_id,pos_N...`` CSV -> (sample_id, position, value).

    The position is the number that ends the column name; only columns in [lo, hi] are
    read further. Missing and NaN cells become NULL.

    Every file's own header names its columns. Cells become rows as they are read, so neither plan
    nor task grows with a table of all columns. Fields are parted by plain commas.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.split("value", ",", -1).alias("_f")).filter("_f[0] <> '' or size(_f) > 1")
    top = lines.first()
    if top is None:
        raise ValueError("empty matrix")
    is_head = F.col("_f")[0] == top["_f"][0]
    number = lambda c: F.regexp_extract(c, r"(\d+)\s*\"?$", 1).try_cast("long")
    heads = lines.filter(is_head).select("file", F.transform("_f", number).alias("_p")).distinct()
    cells = lines.filter(~is_head).join(small_side(heads), "file").select(
        F.regexp_replace(F.col("_f")[0], r'^"|"$', "").alias("sample_id"), F.posexplode(F.arrays_zip("_p", "_f")).alias("_i", "_c")
    )
    out = cells.filter("_i > 0").select("sample_id", F.col("_c._p").alias("position"), finite_or_null(F.col("_c._f").try_cast("double")).alias("value")).filter("position is not null")
    if lo is not None:
        out = out.filter(F.col("position") >= lo)
    if hi is not None:
        out = out.filter(F.col("position") <= hi)
    return out


def melt_positions(wide: DataFrame, id_col: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    import re

    picked = {}
    for c in wide.columns:
        m = re.search(r"(\d+)$", c)
        if c != id_col and m:
            pos = int(m.group(1))
            if (lo is None or pos >= lo) and (hi is None or pos <= hi):
                picked[c] = pos
    if not picked:
        raise ValueError(f"no position columns in [{lo}, {hi}]")
    typed = wide.select(
        F.col(id_col).cast("string").alias("sample_id"),
        *[finite_or_null(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(str(p)) for c, p in picked.items()],
    )
    return typed.unpivot("sample_id", [str(p) for p in picked.values()], "position", "value").select(
        "sample_id", F.col("position").cast("long").alias("position"), "value"
    )


def widen_positions(long: DataFrame, positions: list[int]) -> DataFrame:
    """Long rows -> one row per sample with ``pos_N`` columns; absent positions are NULL.

    The column list is the caller's: a wide table cannot have more columns than a plan can
    hold, so the positions of one block are named, never discovered by a scan.
    """
    named = long.withColumn("_c", F.concat(F.lit("pos_"), F.col("position").cast("string")))
    return named.groupBy("sample_id").pivot("_c", [f"pos_{p}" for p in positions]).agg(F.first("value", True))


def write_position_matrix(long: DataFrame, path: str, positions: list[int], gz: bool = False) -> None:
    widen_positions(long, positions).write.mode("overwrite").option("header", True).option(
        "compression", "gzip" if gz else "none"
    ).csv(path)
