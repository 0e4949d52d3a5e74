"""Genes against matrices and signal tracks; gene scores, ranks and association tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.tails import normal_quantile, t_test_p
from seedloom.operators.base import as_list, attach_row, dealt, ratio, seeded_unit, small_side, tasks_of
from seedloom.operators.intervals import effective_intervals, extend_flank, overlap_join
from seedloom.operators.ordered import ordered_scan, row_index, value_counts
from seedloom.operators.stats import METRICS, bh_adjust, column_profile, distribution_metrics, mann_whitney
from seedloom.session import settle


def gene_signal_mean(genes: DataFrame, track: DataFrame, key: str = "gene_id", by=("chrom",), dense: bool = False) -> DataFrame:
    """Mean signal over each gene's half-open span.

    By default bases without data do not count; ``dense`` counts them as zero. Genes without
    any signal, or with an empty span, get NULL (0.0 when dense and the span is not empty).
    """
    spans = genes.select(key, *as_list(by), "start", "end")
    known = track.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    hits = overlap_join(spans, known.select(*as_list(by), "start", "end", "value"), by=by, closed=False)
    width = F.least("end", "b_end") - F.greatest("start", "b_start")
    sums = hits.groupBy(key).agg(F.sum(F.col("b_value") * width).alias("_s"), F.sum(width).alias("_w"))
    out = spans.join(sums, key, "left")
    if dense:
        mean = F.when(F.col("end") > F.col("start"), F.coalesce("_s", F.lit(0.0)) / (F.col("end") - F.col("start")))
    else:
        mean = ratio(F.col("_s"), F.col("_w"))
    return out.select(key, mean.alias("mean_signal"))


def gene_positions(genes: DataFrame, positions: DataFrame, flank: int, key: str = "gene_id", by=()) -> DataFrame:
    """Position rows that fall in each gene's flanked, 1-based closed region.

    Genes meet the distinct positions, and the rows are joined to those pairs by their position: many samples with
    the same few positions would all stand in one bin of an interval join. A small table of pairs goes to every task.
    """
    return _at_genes(positions, _gene_pairs(genes, positions, flank, key, by), key, by)


def _gene_pairs(genes: DataFrame, positions: DataFrame, flank: int, key: str, by=()) -> DataFrame:
    """Each gene with the positions in its region."""
    by = as_list(by)
    region = extend_flank(genes, flank).select(key, *by, F.col("region_start").alias("start"), F.col("region_end").alias("end"))
    points = positions.select(*by, "position").distinct().withColumn("start", F.col("position")).withColumn("end", F.col("position"))
    met = overlap_join(region, points, by=by, bin_size=1024)
    return small_side(met.select(key, *by, F.col("b_position").alias("position")))


def _at_genes(positions: DataFrame, pairs: DataFrame, key: str, by=()) -> DataFrame:
    by = as_list(by)
    return positions.join(pairs, [*by, "position"]).select(key, *[c for c in positions.columns if c not in by])


def within_effective(matrix: DataFrame, blocks: DataFrame, by=("block",), strict: bool = True) -> DataFrame:
    """Matrix rows inside their block's effective interval, so each position comes from one block."""
    eff = effective_intervals(blocks, strict=strict).select(*as_list(by), "eff_start", "eff_end")
    return matrix.join(small_side(eff), as_list(by)).filter(F.col("position").between(F.col("eff_start"), F.col("eff_end"))).drop("eff_start", "eff_end")


def gene_metrics(matrix: DataFrame, genes: DataFrame, flank: int = 0, key: str = "gene_id", blocks: DataFrame | None = None) -> DataFrame:
    """The 17 metrics of the mean profile over each gene, best mean first."""
    rows = within_effective(matrix, blocks) if blocks is not None else matrix
    profile = column_profile(rows, ["position"])
    out = distribution_metrics(gene_positions(genes, profile, flank, key), key)
    return out.withColumnRenamed("n", "covered_positions").orderBy(F.desc("mean"), key)


def gene_pvalues(matrix: DataFrame, genes: DataFrame, flank: int = 0, key: str = "gene_id", group: str = "grp", case=1, control=0, metrics=tuple(METRICS), min_n: int = 10) -> DataFrame:
    """Case against control per (gene, metric), with q-values over the genes of each metric.

    Where samples are many, they are dealt whole and meet the genes where they then stand: overlapping genes
    have many rows of each sample, and these are never written.
    """
    cells = matrix.select("sample_id", group, "position", "value")
    pairs = _gene_pairs(genes, cells, flank, key)
    hits = _at_genes(cells, pairs, key)
    n, samples = hits.agg(F.count(F.lit(1)), F.approx_count_distinct("sample_id")).first()
    by = [key, "sample_id", group]
    whole = samples >= 4 * tasks_of(hits, n)
    hits = _at_genes(dealt(cells, n, "sample_id"), pairs, key) if whole else dealt(hits, n, *by)
    per = distribution_metrics(hits, by, small=True)
    long = per.select(key, group, *metrics).unpivot([key, group], list(metrics), "metric", "score")
    tested = mann_whitney(long, [key, "metric"], "score", F.col(group) == control, F.col(group) == case, min_n, rows=n * len(metrics))
    return bh_adjust(tested, "pvalue", "metric", "padj").withColumnRenamed("rejected", "significant")


def alternate_lane(genes: DataFrame, by, order=("start", "gene_id")) -> DataFrame:
    """Lane 0, 1, 0, 1 ... along each chromosome."""
    return ordered_scan(genes, by, list(order), _i=row_index()).withColumn("lane", (F.col("_i") - 1) % 2).drop("_i")


def peak_position(curves: DataFrame, order: str = "ord", pos: str = "position", value: str = "value", by=()) -> DataFrame:
    """Highest position over all curves and regions; the first in (order, position) wins ties."""
    key = F.struct(F.col(value), -F.col(order), -F.col(pos))
    return curves.filter(F.col(value).isNotNull()).groupBy(*as_list(by)).agg(
        F.max_by(pos, key).alias("peak_position"), F.max(value).alias("peak_value")
    )


def sample_pcs(matrix: DataFrame, k: int, method: str = "gram", **options) -> DataFrame:
    """Principal-component scores of the samples (up to sign): sample_id, pcs ARRAY.

    ``gram`` is exact and needs the samples x samples square in a task; ``covariance`` is exact for any
    number of samples and needs the positions x positions square; ``power`` takes any number of
    both. The choice is the caller's, never the table's.
    """
    return {"gram": gram_pcs, "covariance": covariance_pcs, "power": power_pcs}[method](matrix, k, **options)


def gram_pcs(matrix: DataFrame, k: int, max_samples: int = 4096) -> DataFrame:
    """Principal-component scores of the samples (up to sign): sample_id, pcs ARRAY.

    Positions are the rows of the job and samples the vector, so the components come from
    the samples x samples product that MLlib sums over the cluster. Each centred row is
    given with both signs, which makes MLlib's own column centring a no-op. The number of
    samples is checked, as one task holds one square matrix of that size.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    names = matrix.select("sample_id").distinct()
    n = names.count()
    if n > max_samples:
        raise ValueError(f"{n} samples: use method='power', or raise max_samples with executors that hold its square")
    index = small_side(ordered_scan(names, None, "sample_id", _i=row_index()))
    rows = matrix.join(index, "sample_id").groupBy("position").agg(
        F.array_sort(F.collect_list(F.struct("_i", F.coalesce("value", F.lit(0.0)).alias("v")))).alias("_r")
    )
    at = F.map_from_entries(F.transform("_r", lambda r: F.struct(r["_i"], r["v"])))
    full = F.when(F.size("_r") == n, F.transform("_r", lambda r: r["v"])).otherwise(
        F.transform(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0)))
    )
    rows = rows.select("position", full.alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.lit(float(n))
    rows = rows.withColumn("_m", mean).select("position", F.transform("x", lambda v: v - F.col("_m")).alias("x"))
    trace, p = rows.agg(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)), F.count(F.lit(1))).first()
    k = min(k, n, p)
    both = rows.select(F.explode(F.array(F.col("x"), F.transform("x", lambda v: -v))).alias("x"))
    model = PCA(k=k, inputCol="v", outputCol="o").fit(both.select(array_to_vector("x").alias("v")))
    scale = [(max(float(r), 0.0) * trace) ** 0.5 for r in model.explainedVariance.toArray()]
    basis = model.pc.toArray()  # samples x k, bounded by max_samples
    spark = matrix.sparkSession
    scores = spark.createDataFrame(
        [(i + 1, [float(basis[i, j] * scale[j]) for j in range(k)]) for i in range(n)], "_i long, pcs array<double>"
    )
    return index.join(scores, "_i").select("sample_id", "pcs")


def covariance_pcs(matrix: DataFrame, k: int, max_positions: int = 4096) -> DataFrame:
    """Principal-component scores of the samples (up to sign): sample_id, pcs ARRAY.

    Samples are the rows of the job and positions the vector: MLlib sums the positions x positions
    covariance over the cluster, and each sample is projected where it stands. Missing cells count as
    0, cells given twice are added. The number of positions is checked, as one task holds one square
    matrix of that size.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    names = matrix.select("position").distinct()
    p = names.count()
    if p > max_positions:
        raise ValueError(f"{p} positions: use method='power', or raise max_positions with executors that hold its square")
    index = small_side(ordered_scan(names, None, "position", _i=row_index()))
    # dealt by sample once, for the cells and for the rows
    cells = matrix.join(index, "position").select("sample_id", "_i", F.coalesce("value", F.lit(0.0)).alias("v")).repartition("sample_id")
    rows = cells.groupBy("sample_id", "_i").agg(F.sum("v").alias("v")).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("_i", "v"))).alias("_r"))
    at = F.map_from_entries(F.transform("_r", lambda r: F.struct(r["_i"], r["v"])))
    full = F.when(F.size("_r") == p, F.transform("_r", lambda r: r["v"])).otherwise(
        F.transform(F.sequence(F.lit(1).cast("long"), F.lit(p).cast("long")), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0)))
    )
    rows = settle(rows.select("sample_id", full.alias("x")))
    n = rows.count()
    k = min(k, n, p)
    if n < 2:
        return rows.select("sample_id", F.array_repeat(F.lit(0.0), k).alias("pcs"))
    basis = PCA(k=k, inputCol="v", outputCol="o").fit(rows.select(array_to_vector("x").alias("v"))).pc.toArray()  # positions x k
    mean = np.array(rows.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(p)]).alias("m")).first()["m"])

    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x.to_numpy()) - mean) @ basis))

    return rows.select("sample_id", F.pandas_udf(project, "array<double>")("x").alias("pcs"))


def power_pcs(matrix: DataFrame, k: int, extra: int = 8, rounds: int = 60, tolerance: float = 1e-12, seed: int = 1) -> DataFrame:
    """Principal-component scores of the samples (up to sign): sample_id, pcs ARRAY.

    Block power iteration for cohorts of any size: k + ``extra`` random columns over the samples are
    carried through the centred matrix and back, and made orthonormal again, until the leading
    variances stand still (relative change below ``tolerance``) or ``rounds`` are over. A round is two
    joins with sums by position and by sample; centring is done on the sums, missing cells
    count as 0. Only products of the k + extra columns come to the driver.
    """
    cells = settle(matrix.select("sample_id", "position", F.coalesce("value", F.lit(0.0)).cast("double").alias("v")))
    n, p = cells.agg(F.count_distinct("sample_id"), F.count_distinct("position")).first()
    k = min(k, n, p)
    m = min(k + extra, n)
    means = settle(cells.groupBy("position").agg((F.sum("v") / F.lit(float(max(n, 1)))).alias("mean")))
    cols = [f"y{j}" for j in range(m)]

    def products(df: DataFrame) -> np.ndarray:
        got = df.agg(*[F.sum(F.col(cols[a]) * F.col(cols[b])).alias(f"g{a}_{b}") for a in range(m) for b in range(a, m)]).first()
        return np.array([[got[f"g{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(m)] for a in range(m)], dtype=float)

    def mixed(df: DataFrame, key: str, mix: np.ndarray, names: list[str]) -> DataFrame:
        return df.select(key, *[sum((F.col(cols[i]) * float(mix[i, j]) for i in range(1, m)), F.col(cols[0]) * float(mix[0, j])).alias(c) for j, c in enumerate(names)])

    def through(y: DataFrame) -> DataFrame:
        """Centred matrix times y: one row per position."""
        whole = y.agg(*[F.sum(c).alias(c) for c in cols]).first()
        z = cells.join(small_side(y), "sample_id").groupBy("position").agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in cols])
        return settle(z.join(means, "position").select("position", "mean", *[(F.col(c) - F.col("mean") * float(whole[c])).alias(c) for c in cols]))

    def back(z: DataFrame) -> DataFrame:
        shift = z.agg(*[F.sum(F.col("mean") * F.col(c)).alias(c) for c in cols]).first()
        w = cells.join(small_side(z.drop("mean")), "position").groupBy("sample_id").agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in cols])
        return settle(w.select("sample_id", *[(F.col(c) - float(shift[c])).alias(c) for c in cols]))

    def orthonormal(y: DataFrame) -> DataFrame:
        vals, vecs = np.linalg.eigh(products(y))
        big = vals > max(vals.max(), 0.0) * 1e-14
        scale = np.where(big, 1 / np.sqrt(np.where(big, vals, 1.0)), 0.0)
        return settle(mixed(y, "sample_id", vecs * scale, cols))

    ids = cells.select("sample_id").distinct()
    y = orthonormal(settle(ids.select("sample_id", *[(seeded_unit(seed + j, "sample_id") - 0.5).alias(c) for j, c in enumerate(cols)])))
    last = None
    for _ in range(rounds):
        z = through(y)
        vals, vecs = np.linalg.eigh(products(z))
        top = vals[::-1][:k]
        if last is not None and np.all(np.abs(top - last) <= tolerance * np.maximum(top, 1e-300)):
            break
        last = top
        y = orthonormal(back(z))
    else:
        z = through(y)
        vals, vecs = np.linalg.eigh(products(z))
    mix = vecs[:, ::-1][:, :k] * np.sqrt(np.maximum(vals[::-1][:k], 0.0))
    names = [f"p{j}" for j in range(k)]
    return mixed(y, "sample_id", mix, names).select("sample_id", F.array(*names).alias("pcs"))


def ols_association(matrix: DataFrame, pheno: DataFrame, y: str, k_pcs: int, pcs: DataFrame | None = None, method: str = "gram") -> DataFrame:
    """Per position the effect and p-value of x in y ~ 1 + x + PC1..PCk.

    The intercept and the components span a fixed space for all positions, so each position
    only needs a few sums: x.x, x.y and x against an orthonormal basis of that space
    (Frisch-Waugh). Missing x count as 0; samples without y are left out.
    """
    known = pheno.filter(F.col(y).isNotNull() & ~F.isnan(y)).select("sample_id", F.col(y).cast("double").alias("_y"))
    rows = matrix.join(small_side(known), "sample_id")
    if pcs is None and k_pcs:
        pcs = sample_pcs(rows.select("sample_id", "position", "value"), k_pcs, method)
    present = rows.select("sample_id", "_y").distinct()
    base = present.join(pcs, "sample_id") if k_pcs else present.withColumn("pcs", F.array().cast("array<double>"))
    base = settle(base)
    # the fixed part of the design; only its (k + 1) x (k + 1) products come to the driver
    width = base.select(F.size("pcs").alias("k")).first()["k"]
    fixed = [F.lit(1.0)] + [F.col("pcs")[j] for j in range(width)]
    m = len(fixed)
    got = base.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(fixed[i] * fixed[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)],
    ).first()
    n = got["n"]
    gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], dtype=float)
    norm = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    vals, vecs = np.linalg.eigh(gram / np.outer(norm, norm))
    keep = vals > vals.max() * 1e-12
    mix = (vecs[:, keep] / np.sqrt(vals[keep])) / norm[:, None]
    k = mix.shape[1]
    q = [sum((fixed[i] * float(mix[i, j]) for i in range(1, m)), fixed[0] * float(mix[0, j])) for j in range(k)]
    table = base.select("sample_id", "_y", F.array(*q).alias("_q"))
    on_y = table.agg(*[F.sum(F.col("_q")[j] * F.col("_y")).alias(f"b{j}") for j in range(k)]).first()
    fitted = sum((F.col("_q")[j] * float(on_y[f"b{j}"]) for j in range(1, k)), F.col("_q")[0] * float(on_y["b0"]))
    table = table.select("sample_id", (F.col("_y") - fitted).alias("_e"), "_q")
    ee = table.agg(F.sum(F.col("_e") * F.col("_e")).alias("ee")).first()["ee"]
    x = F.when(F.isnan("value"), 0.0).otherwise(F.coalesce("value", F.lit(0.0)))
    sums = (
        rows.join(small_side(table), "sample_id")
        .groupBy("position")
        .agg(
            F.sum(x * x).alias("_xx"),
            F.sum(x * F.col("_e")).alias("_xe"),
            *[F.sum(x * F.col("_q")[j]).alias(f"_x{j}") for j in range(k)],
        )
    )
    sxx = F.col("_xx")
    for j in range(k):
        sxx = sxx - F.col(f"_x{j}") * F.col(f"_x{j}")
    dof = n - k - 1
    out = sums.withColumn("_sxx", F.when(sxx > F.col("_xx") * 1e-12, sxx))
    out = out.withColumn("beta", F.col("_xe") / F.col("_sxx"))
    rss = F.greatest(F.lit(float(ee)) - F.col("beta") * F.col("_xe"), F.lit(0.0))
    out = out.withColumn("_se", F.sqrt(rss / F.lit(float(dof)) / F.col("_sxx")) if dof > 0 else F.lit(None).cast("double"))
    out = out.withColumn("t", ratio(F.col("beta"), F.col("_se")))
    tail = F.pandas_udf(t_test_p, "double")
    return out.withColumn("pval", tail("t", F.lit(float(dof)))).select("position", "beta", "t", "pval")


def directional_association(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Forward and reverse association tables joined into one consistency p-value."""
    from seedloom.functions.signal import combine_directions

    f = forward.select("position", F.col("beta").alias("forward_beta"), F.col("pval").alias("forward_p"))
    r = reverse.select("position", F.col("beta").alias("reverse_beta"), F.col("pval").alias("reverse_p"))
    out = f.join(r, "position")
    return out.withColumn("combined_p", combine_directions("forward_p", "reverse_p", "forward_beta", "reverse_beta"))


def quantile_grid(df: DataFrame, value: str, points: int) -> list[float]:
    """``points`` evenly spaced exact quantiles of one column (a list of that fixed length)."""
    vc = value_counts(df.select(value), None, value)
    step = (F.col("total") - 1) / F.lit(float(points - 1))
    first = F.col("cum") - F.col("n")
    lo_i = F.greatest(F.lit(0), F.floor((first - 1) / step)).cast("long")
    hi_i = F.least(F.lit(points - 1), F.ceil(F.col("cum") / step)).cast("long")
    rows = vc.filter(F.col("total") > 1).withColumn("_i", F.explode(F.sequence(lo_i, hi_i)))
    at = F.col("_i") * step
    rows = rows.withColumn("_lo", F.floor(at + 1e-9)).withColumn("_hi", F.ceil(at - 1e-9)).withColumn("_at", at)
    covers = lambda r: (first <= F.col(r)) & (F.col(r) < F.col("cum"))
    grid = rows.groupBy("_i").agg(
        F.max(F.when(covers("_lo"), F.col(value))).alias("_a"),
        F.max(F.when(covers("_hi"), F.col(value))).alias("_b"),
        F.max(F.col("_at") - F.col("_lo")).alias("_f"),
    )
    got = grid.orderBy("_i").limit(points).collect()
    return [r["_a"] + (r["_b"] - r["_a"]) * max(r["_f"], 0.0) for r in got]


def rank_normal(df: DataFrame, value: str, points: int) -> DataFrame:
    """Map a column to normal scores through its quantile grid (ties take the middle); fewer than two
    values have no quantiles: NULL."""
    n = df.filter(F.col(value).isNotNull()).count()
    points = min(points, n)
    if points < 2:
        return df.withColumn(value, F.lit(None).cast("double"))
    grid = quantile_grid(df, value, points)

    def transform(v: pd.Series) -> pd.Series:
        q, ref = np.array(grid), np.linspace(0, 1, points)
        up = np.interp(v, q, ref)
        down = -np.interp(-v, -q[::-1], -ref[::-1])
        p = (up + down) / 2
        tiny = 1e-7
        return normal_quantile(pd.Series(np.clip(p, tiny - np.spacing(1), 1 - (tiny - np.spacing(1)))))

    return df.withColumn(value, F.pandas_udf(transform, "double")(value))


def normalize_fold_change(df: DataFrame, method: str = "zscore", pred: str = "pred", raw: str = "raw", points: int = 1000) -> DataFrame:
    """Normalised log2 fold change of predicted over raw expression per gene.

    NULL becomes 0, both columns get a pseudo-count, are normalised, then shifted together
    above zero. ``points`` is the size of the quantile grid. Significant: |log2FC| > 2 with a mean over 1.
    """
    eps = 1e-6
    out = df
    for c in (pred, raw):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)) + eps)
    if method == "zscore":
        stats = out.agg(*[f(c).alias(f"_{n}_{c}") for c in (pred, raw) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
        out = attach_row(out, stats)
        for c in (pred, raw):
            sd = F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
            out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / sd)
        out = out.select(*df.columns)
    elif method == "quantile":
        for c in (pred, raw):
            out = rank_normal(out, c, points)
    else:
        raise ValueError(method)
    low = out.agg(F.least(F.min(pred), F.min(raw)).alias("_low"))
    out = attach_row(out, low)
    for c in (pred, raw):
        out = out.withColumn(c, F.col(c) + F.abs("_low") + eps)
    out = out.drop("_low").withColumn("log2fc", F.log2(F.col(pred) / F.col(raw)))
    out = out.withColumn("mean_expression", (F.col(pred) + F.col(raw)) / 2)
    return out.withColumn("significant", (F.abs("log2fc") > 2) & (F.col("mean_expression") > 1))


def fold_change_counts(df: DataFrame) -> DataFrame:
    """Genes, expressed genes, and how many go up or down."""
    on = F.col("mean_expression") > 1
    return df.agg(
        F.count(F.lit(1)).alias("genes"),
        F.count(F.when(on, 1)).alias("expressed"),
        F.count(F.when(on & (F.col("log2fc") > 2), 1)).alias("up"),
        F.count(F.when(on & (F.col("log2fc") < -2), 1)).alias("down"),
    )


def top_by_abs(df: DataFrame, col: str, n: int, key: str, means) -> DataFrame:
    """The n rows with the largest absolute value, averaged per key."""
    top = df.orderBy(F.abs(F.col(col)).desc(), key).limit(n)
    return top.groupBy(key).agg(*[F.avg(m).alias(m) for m in as_list(means)])


def top_per_group(df: DataFrame, score: Column, n: int, by, key: str) -> DataFrame:
    """The n best rows of each group; Spark keeps only n per task before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*as_list(by)).orderBy(F.col("score").desc(), F.col(key))
    return df.withColumn("score", score).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def top_significant(df: DataFrame, q_cols, sig_cols, n: int, key: str) -> DataFrame:
    """Lowest q over directions, significant rows if there are any, else all; first n."""
    inf = F.lit(float("inf"))
    qs = [F.coalesce(F.col(c), inf) for c in as_list(q_cols)]
    sigs = [F.coalesce(F.col(c), F.lit(False)) for c in as_list(sig_cols)]
    min_q = qs[0] if len(qs) == 1 else F.least(*qs)
    sig = sigs[0]
    for s in sigs[1:]:
        sig = sig | s
    out = df.withColumn("min_q", min_q).withColumn("_sig", sig)
    # significant rows sort first; whether any exist is one flag
    any_ = out.agg(F.coalesce(F.max("_sig"), F.lit(False)).alias("_any"))
    out = attach_row(out, any_).filter(F.col("_sig") | ~F.col("_any")).drop("_sig", "_any")
    return out.orderBy("min_q", key).limit(n)
