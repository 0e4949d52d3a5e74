"""Ranks, rank tests, multiple-testing correction and distribution summaries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.functions.signal import log2_fold_change
from seedloom.functions.tails import exact_rank_p, normal_p
from seedloom.operators.base import as_list, ratio
from seedloom.operators.ordered import (
    following,
    in_parts,
    lay_out,
    ordered_scan,
    previous,
    quantile_aggs,
    release,
    row_index,
    running_min,
    running_sum,
    scan,
    value_counts,
)
from seedloom.session import settle


def join_groups(df: DataFrame, other: DataFrame, by) -> DataFrame:
    """Left join on group keys; with no keys the other side is a single row."""
    from seedloom.operators.base import attach_row

    by = as_list(by)
    return df.join(other, by, "left") if by else attach_row(df, other)


def average_rank(df: DataFrame, value: str, by=None, to: str = "rank") -> DataFrame:
    """1-based rank with ties sharing their mean rank; null values stay unranked."""
    by = as_list(by)
    vc = value_counts(df, by, value).select(*by, value, (F.col("cum") - (F.col("n") - 1) / 2.0).alias(to))
    return df.join(vc, by + [value], "left")


def min_rank_desc(df: DataFrame, value: str, by=None, to: str = "rank") -> DataFrame:
    """Rank by descending value; ties share the lowest rank; nulls stay unranked."""
    by = as_list(by)
    vc = value_counts(df, by, value).select(*by, value, (F.col("total") - F.col("cum") + 1).alias(to))
    return df.join(vc, by + [value], "left")


def reverse_running_min(df: DataFrame, col: str, order, by=None, to: str = "run_min") -> DataFrame:
    return ordered_scan(df, by, order, **{to: running_min(col, reverse=True)})


def bh_adjust(df: DataFrame, p: str = "p", by=None, to: str = "padj", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg q-values per family; null p-values count for nothing and stay null."""
    by = as_list(by)
    df = settle(df)  # tests end in a Python tail probability; the passes below read it once computed
    known = df.filter(F.col(p).isNotNull())
    laid = lay_out(known, by, p, salt=True)
    ranked = scan(laid, by, p, _r=row_index(), _back=row_index(reverse=True))
    q = F.col(p) * (F.col("_r") + F.col("_back") - 1) / F.col("_r")
    out = release(scan(ranked.withColumn("_q", q), by, p, _min=running_min("_q", reverse=True)))
    out = out.withColumn(to, F.least(F.greatest(F.col("_min"), F.lit(0.0)), F.lit(1.0)))
    out = out.select(*df.columns, to).unionByName(
        df.filter(F.col(p).isNull()).withColumn(to, F.lit(None).cast("double"))
    )
    return out.withColumn("rejected", F.coalesce(F.col(to) <= alpha, F.lit(False)))


def mann_whitney(df: DataFrame, by, value: str, is_a: Column, is_b: Column, min_n: int = 10, method: str = "normal", rows: int = 0) -> DataFrame:
    """Two-sided rank-sum test of group a against group b for every key.

    Values are first counted per (key, value), so the rank sums, the tie term and the group
    means all come from one ordered scan of the distinct values. The tail probability is the
    only Python step and runs once per key. ``method`` is the caller's: ``normal``, with tie and
    continuity correction, or ``exact``, for distinct values and groups whose sizes' product fits a task.
    ``rows``, the number of rows if it is known, sets the number of tasks: the rows of each key are then dealt
    once, in parts by value, and nothing but the sums of the parts goes further.
    """
    if method not in ("normal", "exact"):
        raise ValueError(method)
    by = as_list(by)
    known = df.filter(F.col(value).isNotNull() & (is_a | is_b))
    tags = {"_a": F.when(is_a, 1).otherwise(0), "_b": F.when(is_b, 1).otherwise(0)}
    n = F.col("n").cast("double")
    sums = [
        F.sum("_a").alias("n_a"),
        F.sum("_b").alias("n_b"),
        F.sum(F.col("_a") * F.col(value)).alias("_sa"),
        F.sum(F.col("_b") * F.col(value)).alias("_sb"),
        F.sum(F.col("_a") * (F.col("cum") - (F.col("n") - 1) / 2.0)).alias("_ra"),
        F.sum(n * n * n - n).alias("_ties"),
    ]
    if rows and by:
        part = in_parts(known.select(*by, value, *[c.alias(k) for k, c in tags.items()]), by, value, rows)
        counts = part.groupBy(*by, "_part", value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in tags])
        upto = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = counts.withColumn("cum", F.sum("n").over(upto)).groupBy(*by, "_part").agg(F.sum("n").alias("_n"), *sums)
        # ranks in a part go on from those of the parts before it
        before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
        parts = parts.withColumn("_ra", F.col("_ra") + F.col("n_a") * before)
        agg = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "_sa", "_sb", "_ra", "_ties")])
    else:
        agg = value_counts(known, by, value, **tags).groupBy(*by).agg(*sums)
    agg = agg.withColumns({"mean_a": ratio(F.col("_sa"), F.col("n_a")), "mean_b": ratio(F.col("_sb"), F.col("n_b"))})
    agg = agg.select(*by, "n_a", "n_b", "mean_a", "mean_b", "_ra", "_ties")
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("_ra") - a * (a + 1) / 2
    enough = (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n) & (F.col("n_a") > 0) & (F.col("n_b") > 0)
    agg = agg.withColumn("u", F.when(enough, u))
    big = F.greatest(F.col("u"), a * b - F.col("u"))
    total = a + b
    var = a * b / 12.0 * (total + 1 - F.col("_ties") / (total * (total - 1)))
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    z = F.when(sd > 0, (big - a * b / 2 - 0.5) / sd).otherwise(F.lit(float("-inf")))
    agg = agg.withColumn("z", F.when(enough, z))
    exact = F.pandas_udf(exact_rank_p, "double")("u", "n_a", "n_b", "_ties")
    p = exact if method == "exact" else F.pandas_udf(normal_p, "double")("z")
    return agg.withColumn("pvalue", p).drop("_ra", "_ties")


def position_differential(matrix: DataFrame, a, b, by=("position",), family=(), group: str = "grp", value: str = "value", min_n: int = 10) -> DataFrame:
    """Rank test, fold change and q-value for every position, all blocks in one job."""
    by = as_list(by)
    out = mann_whitney(matrix, by, value, F.col(group) == a, F.col(group) == b, min_n)
    out = out.withColumn("log2fc", log2_fold_change("mean_a", "mean_b"))
    out = bh_adjust(out, "pvalue", family, "padj").drop("rejected")
    return out.withColumn(
        "significant", F.coalesce((F.col("padj") < 0.05) & (F.abs("log2fc") > 1), F.lit(False))
    )


def local_maxima(df: DataFrame, value: str, pos: str, by=None, laid: bool = False) -> DataFrame:
    """Peaks: a value, or a flat run of one value, higher than both its neighbours.

    The first and the last run of a group are never peaks. One row per peak, placed at the
    middle of its run. ``laid`` says that ``df`` comes from ``lay_out`` and has no nulls.
    """
    by = as_list(by)
    if not laid:
        df = lay_out(df.filter(F.col(value).isNotNull()).select(*by, pos, value), by, pos)
    near = scan(df, by, pos, _pv=previous(value), _nv=following(value))
    near = near.withColumn("_new", F.when(F.col("_pv").isNull() | (F.col("_pv") != F.col(value)), 1).otherwise(0).cast("long"))
    runs = release(scan(near, by, pos, _run=running_sum("_new"))).groupBy(*by, "_run").agg(
        F.min(pos).alias("_lo"),
        F.max(pos).alias("_hi"),
        F.first(value).alias(value),
        F.min_by("_pv", pos).alias("_pv"),
        F.max_by("_nv", pos).alias("_nv"),
    )
    peaks = runs.filter((F.col(value) > F.col("_pv")) & (F.col(value) > F.col("_nv")))
    return peaks.select(*by, F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("long").alias(pos), value)


# Fixed names of the distribution metrics.
METRICS = (
    "mean max std cv median mode iqr skewness kurtosis top5_percent_mean low5_percent_mean "
    "percentile_90 percentile_10 peak_count peak_density peak_mean shannon_entropy"
).split()


def distribution_metrics(df: DataFrame, by, value: str = "value", pos: str = "position", small: bool = False) -> DataFrame:
    """The 17 distribution metrics of the values of each group, ordered by ``pos`` for peaks.

    ``small`` says that groups are many and small: the values of each then stand in one row, so no row is written
    or dealt again if ``df`` is dealt by some of ``by``.
    """
    by = as_list(by)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, pos, value)
    v = F.col(value)
    up = F.when(v > 0, v)
    aggs = [
        F.avg(v).alias("mean"),
        F.max(v).alias("max"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.when(F.count(v) > 2, F.skewness(v)).alias("skewness"),
        F.when(F.count(v) > 3, F.kurtosis(v)).alias("kurtosis"),
        F.count(v).alias("_n"),
        F.coalesce(F.log(F.sum(up)) - F.sum(up * F.log(up)) / F.sum(up), F.lit(0.0)).alias("shannon_entropy"),
    ]
    if small:
        groups = rows.groupBy(*by).agg(*aggs, F.sort_array(F.collect_list(F.struct(pos, value))).alias("_at"))
        # the joins below match no null: a group without a key has sums only
        keyed = reduce(lambda a, c: a & F.col(c).isNotNull(), by, F.lit(True))
        out = _array_metrics(groups.withColumn("_at", F.when(keyed, F.col("_at"))), value, rows.schema[value].dataType)
    else:
        # laid out once for the peaks; the other two passes read the same settled rows
        rows = lay_out(rows, by, pos)
        base = rows.groupBy(*by).agg(*aggs)
        vc = value_counts(rows, by, value)
        k = F.greatest(F.lit(1), F.floor(F.col("total") * 0.05))
        before = F.col("cum") - F.col("n")
        in_top = F.greatest(F.lit(0), F.col("cum") - F.greatest(before, F.col("total") - k))
        in_low = F.greatest(F.lit(0), F.least("cum", k) - before)
        shape = vc.groupBy(*by).agg(
            *quantile_aggs(value, QUARTILES),
            F.max_by(value, F.struct("n", -v)).alias("mode"),
            (F.sum(v * in_top) / F.max(k)).alias("top5_percent_mean"),
            (F.sum(v * in_low) / F.max(k)).alias("low5_percent_mean"),
        )
        out = join_groups(base, shape, by)
        peaks = join_groups(local_maxima(rows, value, pos, by, laid=True), base.select(*by, "mean"), by).filter(v >= F.col("mean"))
        peaks = peaks.groupBy(*by).agg(F.count(F.lit(1)).alias("_pc"), F.avg(v).alias("peak_mean"))
        out = join_groups(out, peaks, by)
    out = out.withColumn("iqr", F.col("_q75") - F.col("_q25"))
    out = out.withColumn("cv", ratio(F.col("std"), F.col("mean")))
    enough = F.col("_n") >= 3
    out = out.withColumn("peak_count", F.when(enough, F.coalesce("_pc", F.lit(0))).otherwise(0).cast("double"))
    out = out.withColumn("peak_density", F.col("peak_count") / F.col("_n"))
    return out.select(*by, F.col("_n").alias("n"), *METRICS)


QUARTILES = {"median": 0.5, "_q25": 0.25, "_q75": 0.75, "percentile_90": 0.9, "percentile_10": 0.1}


def _array_metrics(groups: DataFrame, value: str, kind) -> DataFrame:
    """What :func:`distribution_metrics` reads off ordered values, from ``_at``, the (position, value) of a group in order."""
    groups = groups.withColumn("_s", F.sort_array(F.transform("_at", lambda x: x[value])))
    none, n = F.lit(None).cast(kind), F.col("_n")
    added = {}
    for name, q in QUARTILES.items():
        at = F.lit(float(q)) * (n - 1)
        low, high = (F.get("_s", end(at).cast("int")) for end in (F.floor, F.ceil))
        added[name] = low + (high - low) * (at - F.floor(at))
    k = F.greatest(F.lit(1), F.floor(n * 0.05)).cast("int")
    for name, start in (("top5_percent_mean", n.cast("int") - k + 1), ("low5_percent_mean", F.lit(1))):
        added[name] = F.aggregate(F.slice("_s", start, k), F.lit(0.0), lambda a, x: a + x) / k

    def count_ties(seen: Column, x: Column) -> Column:
        run = F.when(x == seen["last"], seen["run"] + 1).otherwise(1)
        more = run > seen["most"]
        return F.struct(x.alias("last"), run.alias("run"), F.when(more, x).otherwise(seen["best"]).alias("best"), F.greatest(run, seen["most"]).alias("most"))

    nothing = F.struct(none.alias("last"), F.lit(0).alias("run"), none.alias("best"), F.lit(0).alias("most"))
    added["mode"] = F.aggregate("_s", nothing, count_ties, lambda seen: seen["best"])

    def count_peaks(seen: Column, x: Column) -> Column:
        """A run of one value is a peak if the values rise to it and fall after it."""
        last = seen["last"]
        peak = seen["up"] & (x[value] < last) & (last >= F.col("mean"))
        rising = F.when(x[value] > last, True).when(x[value] < last, False).otherwise(seen["up"])
        return F.struct(
            x[value].alias("last"), rising.alias("up"), (seen["n"] + F.when(peak, 1).otherwise(0)).alias("n"),
            (seen["sum"] + F.when(peak, last.cast("double")).otherwise(0.0)).alias("sum"),
        )

    nothing = F.struct(none.alias("last"), F.lit(False).alias("up"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))
    groups = groups.withColumns({**added, "_peaks": F.aggregate("_at", nothing, count_peaks)})
    return groups.withColumns({"_pc": F.col("_peaks.n"), "peak_mean": ratio(F.col("_peaks.sum"), F.col("_peaks.n"))}).drop("_at", "_s", "_peaks")


def column_profile(matrix: DataFrame, by=("position",), value: str = "value") -> DataFrame:
    """Mean over samples at each position; samples without a value do not count."""
    v = F.col(value)
    return matrix.groupBy(*as_list(by)).agg(F.avg(F.when(~F.isnan(v), v)).alias(value))


def rank_desc(df: DataFrame, metrics, key: str, by=None) -> DataFrame:
    """Descending rank of each metric (wide in, long inside) and the mean rank over metrics."""
    by = as_list(by)
    long = df.select(key, *by, *metrics).unpivot([key] + by, list(metrics), "metric", "score")
    ranked = min_rank_desc(long, "score", by + ["metric"], "rank")
    wide = ranked.groupBy(key, *by).pivot("metric", list(metrics)).agg(F.first("rank"))
    mean = ranked.groupBy(key, *by).agg(F.avg("rank").alias("mean_rank"))
    return wide.select(key, *by, *[F.col(m).alias(f"{m}_rank") for m in metrics]).join(mean, [key] + by)


# Positions of a smoothing tile, at least.
TILE = 8192


def gaussian_smooth(df: DataFrame, value: str, pos: str, sigma: float, by=None, nearest: bool = False, to: str = "smooth") -> DataFrame:
    """Gaussian smoothing along ``pos`` with a kernel of ``max(3, int(6 sigma) | 1)`` points.

    Outside a group and at positions without a value the signal is zero; when ``nearest``, it goes
    on with its edge value outside. Positions are cut in tiles of ``TILE`` or four times the
    kernel's half; a tile also gets the half kernel of its neighbours on both sides, so a row has
    three copies at most and 1.5 on average, whatever the kernel. Each tile is one convolution. Without a value in
    reach, and without a position, the result is null. A group has one row per position; rows
    of one position count together.
    """
    by = as_list(by)
    width = max(3, int(6 * sigma) | 1)
    half = width // 2
    size = max(TILE, 4 * half)
    weights = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    kernel = weights / weights.sum()
    cols = [c for c in df.columns if c != to]
    rows = df.select(*cols).filter(F.col(pos).isNotNull())
    rows = rows.withColumns({"_at": F.col(pos).cast("long"), "_v": F.col(value).cast("double"), "_lo": F.lit(None).cast("long"), "_hi": F.lit(None).cast("long")})
    if nearest:
        ends = rows.groupBy(*by).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
        rows = join_groups(rows.drop("_lo", "_hi"), ends, by) if not by else _null_safe_left(rows.drop("_lo", "_hi"), ends, by)
    tile = lambda at: F.floor(at / F.lit(size)).cast("long")
    reach = F.sequence(tile(F.col("_at") - half), tile(F.col("_at") + half))
    copies = rows.withColumn("_tile", F.explode(reach)).withColumn("_home", F.col("_tile") == tile(F.col("_at")))
    # A copy for a neighbour needs its place and value only.
    copies = copies.select(*[c if c in by else F.when(F.col("_home"), F.col(c)).alias(c) for c in cols], "_at", "_v", "_lo", "_hi", "_tile", "_home")
    schema = T.StructType([*df.select(*cols).schema.fields, T.StructField(to, T.DoubleType())])

    def smoothed(table: pa.Table) -> pa.Table:
        at = table["_at"].to_numpy()
        # The signal from the first to the last of the tile's positions, with half a kernel on both sides.
        base, n = int(at.min()) - half, int(at.max() - at.min()) + 1 + 2 * half
        at = at - base
        v = table["_v"].to_numpy(zero_copy_only=False).astype(np.float64)
        has = table["_v"].is_valid().to_numpy(zero_copy_only=False)
        signal, known = np.zeros(n), np.zeros(n)
        np.add.at(signal, at[has], v[has])
        known[at[has]] = 1
        lo, hi = (table[c][0].as_py() for c in ("_lo", "_hi"))
        if lo is not None:
            first, last = lo - base, hi - base
            if 0 < first < n:
                signal[:first], known[:first] = signal[first], known[first]
            if 0 <= last < n - 1:
                signal[last + 1 :], known[last + 1 :] = signal[last], known[last]
        seen = np.cumsum(np.r_[0, known])
        seen = seen[width:] - seen[: n - width + 1] > 0
        home = table["_home"].to_numpy(zero_copy_only=False)
        out = table.filter(table["_home"]).select(cols)
        place = at[home] - half
        smooth = np.convolve(signal, kernel, "valid")[place]
        return out.append_column(to, pa.array(smooth, pa.float64(), mask=~seen[place]))

    done = copies.groupBy(*by, "_tile").applyInArrow(smoothed, schema)
    lost = df.select(*cols).filter(F.col(pos).isNull()).withColumn(to, F.lit(None).cast("double"))
    return done.unionByName(lost)


def _null_safe_left(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    renamed = other.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[c for c in other.columns if c not in by])
    cond = F.lit(True)
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(renamed, cond, "left").drop(*[f"_k{i}" for i in range(len(by))])
