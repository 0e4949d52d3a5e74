"""Signal tracks: means, renormalisation, averaging, scaling, coverage.

A track table is run-length: (track, chrom, start, end, value), half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.operators.base import as_list, attach_row, dealt, for_each, is_finite, ratio, small_side
from seedloom.operators.intervals import not_overlapping, scaffold_fill
from seedloom.operators.ordered import following, lay_out, ordered_scan, release, running_sum, scan

def span() -> Column:
    return F.col("end") - F.col("start")


def _nonzero() -> Column:
    return is_finite("value") & (F.col("value") != 0)


def nonzero_mean_weighted(track: DataFrame, by, to: str = "mean", empty: float | None = None) -> DataFrame:
    ok = _nonzero()
    mean = ratio(F.sum(F.when(ok, F.col("value") * span())), F.sum(F.when(ok, span())))
    if empty is not None:
        mean = F.coalesce(mean, F.lit(empty))
    return track.groupBy(*as_list(by)).agg(mean.alias(to))


def nonzero_mean(track: DataFrame, by=("track",), weighted: bool = True, to: str = "mean") -> DataFrame:
    """Mean of the non-zero signal, per base or (unweighted) per interval; none -> 0.0."""
    if weighted:
        return nonzero_mean_weighted(track, by, to, empty=0.0)
    mean = F.avg(F.when(_nonzero(), F.col("value")))
    return track.groupBy(*as_list(by)).agg(F.coalesce(mean, F.lit(0.0)).alias(to))


def nonzero_mean_by_chrom(track: DataFrame, chroms: DataFrame, by=("track",), to: str = "mean") -> DataFrame:
    """Mean per (track, chrom) for every wanted chromosome; empty or missing -> 1.0."""
    by = as_list(by)
    grid = for_each(track.select(*by).distinct(), chroms.select("chrom").distinct(), by)
    means = nonzero_mean_weighted(track, by + ["chrom"], to)
    return grid.join(means, by + ["chrom"], "left").withColumn(to, F.coalesce(F.col(to), F.lit(1.0)))


def renormalise(track: DataFrame, by=("track",), target: float = 100.0, reads: float = 1e6) -> DataFrame:
    """Scale each track so that its total signal is ``target`` x one million."""
    by = as_list(by)
    totals = track.groupBy(*by).agg(F.sum(F.col("value") * span()).alias("_total"))
    scale = ratio(F.lit(target), F.col("_total") / F.lit(reads))
    out = track.join(small_side(totals), by).withColumn("scale", F.coalesce(scale, F.lit(1.0)))
    return out.withColumn("value", F.col("value") * F.col("scale")).drop("_total")


def total_is(track: DataFrame, by=("track",), target: float = 100.0, reads: float = 1e6, tol: float = 1e-6) -> DataFrame:
    """Re-measured totals with a verdict; the post-condition of :func:`renormalise`."""
    total = F.sum(F.col("value") * span())
    return track.groupBy(*as_list(by)).agg(total.alias("total"), (F.abs(total / F.lit(target * reads) - 1) < tol).alias("ok"))


# Bases of a tile whose sums run together.
SUM_TILE = 1 << 20


def average_tracks(tracks: DataFrame, drop_tail: DataFrame | None = None, step: int = 32000) -> DataFrame:
    """Mean signal over the tracks that have a chromosome; bases without signal count as 0.

    Works on interval ends: each interval adds its value at its start and takes it back at
    its end, and a running sum over those points gives the total on every stretch. Intervals are cut at
    tiles of ``SUM_TILE`` bases, so a sum runs over one tile only and starts anew at the next, and values
    are integers there, in parts of 2^-100 of the tile's greatest: what is added is taken back to
    the last bit. A stretch ends at a tile's end. Zero stretches are not written. ``drop_tail``
    (chrom, size) cuts each chromosome at its last full ``step``.
    """
    tile = lambda at: F.floor(at / F.lit(SUM_TILE)).cast("long")
    tiles = F.when(_nonzero() & (F.col("end") > F.col("start")), tile(F.col("end") - 1) - tile(F.col("start")) + 1)
    per = small_side(tracks.groupBy("chrom").agg(F.count_distinct("track").alias("_tracks"), F.sum(tiles).alias("_cuts")))
    cuts = per.agg(F.sum("_cuts")).first()[0] or 0
    live = tracks.filter(_nonzero() & (F.col("end") > F.col("start")))
    if drop_tail is not None:
        sizes = drop_tail.select("chrom", (F.floor(F.col("size") / step) * step).alias("_cut"))
        live = live.join(small_side(sizes), "chrom").withColumn("end", F.least("end", "_cut")).drop("_cut")
        live = live.filter(F.col("end") > F.col("start"))
    cut = live.select("chrom", "value", "start", "end", F.explode(F.sequence(tile(F.col("start")), tile(F.col("end") - 1))).alias("_tile"))
    # Tiles are dealt once, to as many tasks as their rows fill; all that follows stays there.
    cut = dealt(cut, cuts, "chrom", "_tile")
    from_, to = F.greatest("start", F.col("_tile") * SUM_TILE), F.least("end", (F.col("_tile") + 1) * SUM_TILE)
    # The exponent of a tile's unit: its greatest value has 100 bits, which leaves 2^26 values on top of each other.
    top = F.max(F.abs("value")).over(Window.partitionBy("chrom", "_tile"))
    cut = cut.withColumn("_bits", F.lit(100) - F.ceil(F.log2(top)))
    whole = F.round(F.col("value") * F.pow(F.lit(2.0), F.col("_bits"))).cast("decimal(38,0)")
    ends = cut.select(
        "chrom", "_tile", "_bits",
        F.explode(
            F.array(
                F.struct(from_.alias("pos"), whole.alias("d"), F.lit(1).cast("long").alias("k")),
                F.struct(to.alias("pos"), (-whole).alias("d"), F.lit(-1).cast("long").alias("k")),
            )
        ).alias("_e"),
    )
    points = ends.groupBy("chrom", "_tile", F.col("_e.pos").alias("pos")).agg(F.sum("_e.d").alias("d"), F.sum("_e.k").alias("k"), F.first("_bits").alias("_bits"))
    along = Window.partitionBy("chrom", "_tile").orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = points.select("chrom", "pos", "_bits", F.sum("d").over(upto).alias("total"), F.sum("k").over(upto).alias("open"), F.lead("pos").over(along).alias("stop"))
    runs = runs.filter((F.col("open") > 0) & F.col("stop").isNotNull()).join(per, "chrom")
    total = F.col("total").cast("double") / F.pow(F.lit(2.0), F.col("_bits"))
    return runs.select("chrom", F.col("pos").alias("start"), F.col("stop").alias("end"), (total / F.col("_tracks")).alias("value"))


def weighted_quantile(df: DataFrame, q: float, by=("track",), value: str = "value", weight: str = "w", tie=("chrom", "start"), to: str = "quantile") -> DataFrame:
    """Quantile of weighted values, interpolated between centred weight fractions.

    Rows stay separate even when their values are equal, as the interpolation points depend
    on it; ``tie`` fixes their order.
    """
    by = as_list(by)
    ok = df.filter(is_finite(value) & (F.col(value) != 0) & (F.col(weight) > 0))
    order = [value] + as_list(tie)
    run = ordered_scan(ok.select(*by, *order, weight), by, order, _cum=running_sum(weight), _rest=running_sum(weight, reverse=True))
    total = F.col("_cum") + F.col("_rest") - F.col(weight)
    run = run.withColumn("_f", (F.col("_cum") - F.col(weight) / 2.0) / total)
    point = F.struct(F.col("_f"), F.col(value).alias("_v"))
    agg = run.groupBy(*by).agg(
        F.max(F.when(F.col("_f") <= q, point)).alias("_lo"), F.min(F.when(F.col("_f") >= q, point)).alias("_hi")
    )
    lo, hi = F.col("_lo"), F.col("_hi")
    span = hi["_f"] - lo["_f"]
    mid = lo["_v"] + (hi["_v"] - lo["_v"]) * F.when(span > 0, (F.lit(q) - lo["_f"]) / span).otherwise(0.0)
    out = F.when(lo.isNull(), hi["_v"]).when(hi.isNull(), lo["_v"]).otherwise(mid)
    return agg.select(*by, out.alias(to))


def fit_scaler(track: DataFrame, q: float, by=("track",)) -> DataFrame:
    """Per track the cap (weighted quantile) and the length-weighted mean of capped values."""
    by = as_list(by)
    rows = track.withColumn("w", span())
    caps = weighted_quantile(rows, q, by, to="cap")
    named = track.select(*by).distinct()
    capped = track.filter(_nonzero()).join(small_side(caps), by)
    means = capped.groupBy(*by).agg(ratio(F.sum(F.least("value", "cap") * span()), F.sum(span())).alias("mean"))
    return named.join(means, by, "left").join(caps, by, "left").withColumn("mean", F.coalesce("mean", F.lit(1.0)))


def collapse_positions(df: DataFrame, by, scores: str = "scores", positions: str = "pos_list", eff: DataFrame | None = None) -> DataFrame:
    """Average the scores that share a reference coordinate; uncovered coordinates are 0.0.

    Inserted bases repeat their coordinate. Only the first ``min(len(scores), len(pos))``
    pairs are used. ``eff`` gives (by..., eff_start, eff_end) for the coordinates to list.
    """
    by = as_list(by)
    n = F.least(F.size(scores), F.size(positions))
    pairs = F.arrays_zip(F.slice(positions, F.lit(1), n).alias("p"), F.slice(scores, F.lit(1), n).alias("s"))
    long = df.select(*by, F.explode(pairs).alias("_z")).select(*by, F.col("_z.p").cast("long").alias("position"), F.col("_z.s").alias("value"))
    mean = long.groupBy(*by, "position").agg(F.avg("value").alias("value"))
    return mean if eff is None else scaffold_fill(mean, eff, by)


def track_mean_map(means: DataFrame, chroms: list[str], prefix: str = "prefix", order: str = "ord") -> DataFrame:
    """prefix -> {chrom -> first mean}, chromosomes without one at 0.0."""
    first = means.groupBy(prefix, "chrom").agg(F.min_by("mean", order).alias("mean"))
    # the inner map has at most one entry per wanted chromosome
    have = first.filter(F.col("chrom").isin(*chroms)).groupBy(prefix).agg(
        F.map_from_entries(F.collect_list(F.struct("chrom", "mean"))).alias("_m")
    )
    all_ = first.select(prefix).distinct().join(have, prefix, "left")
    keys = F.array(*[F.lit(c) for c in chroms])
    full = F.map_from_arrays(keys, F.transform(keys, lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit(0.0))))
    return all_.select(prefix, full.alias("means"))


# Names of the coverage normalisations.
NORMALISATIONS = ("None", "CPM", "RPKM", "BPM", "RPGC")


def coverage(reads: DataFrame, bin_size: int = 50, min_mapq: int = 0, strand: str | None = None, blacklist: DataFrame | None = None, norm: str = "None", genome_size: int | None = None) -> DataFrame:
    """Binned read counts (chrom, start, end, value) from alignment rows.

    CPM divides by million kept reads, RPKM also by the bin in kilobases, BPM by the million
    binned counts, RPGC by the mean depth over ``genome_size``.
    """
    if norm not in NORMALISATIONS:
        raise ValueError(f"norm is one of {NORMALISATIONS}")
    kept = reads.filter((F.col("mapq") >= min_mapq) & (F.col("end") > F.col("start")))
    if strand:
        kept = kept.filter(F.col("strand") == strand)
    if blacklist is not None:
        kept = not_overlapping(kept, blacklist)
    first = F.floor(F.col("start") / bin_size)
    last = F.floor((F.col("end") - 1) / bin_size)
    bins = kept.withColumn("_b", F.explode(F.sequence(first, last))).groupBy("chrom", "_b").agg(F.count(F.lit(1)).alias("_n"))
    value = F.col("_n").cast("double")
    if norm == "BPM":
        bins = attach_row(bins, bins.agg(F.sum("_n").alias("_all")))
        value = value / (F.col("_all") / 1e6)
    elif norm != "None":
        bins = attach_row(bins, kept.agg(F.count(F.lit(1)).alias("_reads"), F.sum(span()).alias("_bases")))
        if norm == "CPM":
            value = value / (F.col("_reads") / 1e6)
        elif norm == "RPKM":
            value = value / (F.col("_reads") / 1e6 * (bin_size / 1000.0))
        else:
            if not genome_size:
                raise ValueError("RPGC needs genome_size")
            value = value / (F.col("_bases") / float(genome_size))
    start = F.col("_b") * bin_size
    return bins.select("chrom", start.alias("start"), (start + bin_size).alias("end"), value.alias("value"))


def window_profile(df: DataFrame, col: str = "values") -> DataFrame:
    """Min, max, mean and percentage of zeros of each window's array."""
    n = F.size(col)
    total = F.aggregate(col, F.lit(0.0), lambda a, v: a + v)
    zeros = F.size(F.filter(col, lambda v: v == 0))
    return df.select(
        *[c for c in df.columns if c != col],
        F.array_min(col).alias("min"),
        F.array_max(col).alias("max"),
        ratio(total, n).alias("mean"),
        (ratio(zeros, n) * 100).alias("zero_ratio"),
    )
