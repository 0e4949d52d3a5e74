"""Evaluation metrics for signals, classes, retrieval and timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.operators.base import as_list, attach_row, is_finite, ratio, small_side
from seedloom.operators.ordered import ordered_scan, quantiles, running_sum, value_counts
from seedloom.operators.stats import join_groups
from seedloom.session import settle


def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation; null when a side is constant (std <= 1e-8)."""
    sa = F.stddev_pop(F.when(b.isNotNull(), a))
    sb = F.stddev_pop(F.when(a.isNotNull(), b))
    # one condition guards the division, as the built-in corr fails on a constant side
    return F.when((sa > 1e-8) & (sb > 1e-8), F.try_divide(F.covar_pop(a, b), sa * sb))


# Distinct value pairs of a group that one task ranks; groups with more go through ordered scans.
RANKED = 100_000


def spearman(df: DataFrame, a: str, b: str, by=None, to: str = "spearman") -> DataFrame:
    """Correlation of tie-averaged ranks, from counted value pairs.

    Groups of at most ``RANKED`` pairs are dealt by group and ranked in one shuffle; the others are spread.
    """
    by = as_list(by)
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    # several passes read the counted pairs, so they are written once
    pairs = settle(rows.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_w")))
    if not by:
        return _spread_ranks(pairs, a, b, by, to)
    for c in by:
        pairs = pairs.filter(F.col(c).isNotNull())
    large = settle(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > RANKED).select(*by))
    if large.isEmpty():
        return _dealt_ranks(pairs, a, b, by, to)
    # A group is large by its rows, so the list is a small part of them.
    large = small_side(large)
    dealt = _dealt_ranks(pairs.join(large, by, "left_anti"), a, b, by, to)
    return dealt.unionByName(_spread_ranks(settle(pairs.join(large, by, "left_semi")), a, b, by, to))


def _dealt_ranks(pairs: DataFrame, a: str, b: str, by: list[str], to: str) -> DataFrame:
    for c in (a, b):
        along = Window.partitionBy(*by).orderBy(c)
        # the running sum takes in a value's ties, so its mean rank lies half their number below
        upto, ties = F.sum("_w").over(along), F.sum("_w").over(along.rangeBetween(Window.currentRow, Window.currentRow))
        total = F.sum("_w").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        pairs = pairs.withColumn(f"_r_{c}", upto - (ties - 1) / 2.0 - (total + 1) / 2.0)
    return _rank_correlation(pairs, a, b, by, to)


def _spread_ranks(pairs: DataFrame, a: str, b: str, by: list[str], to: str) -> DataFrame:
    for c in (a, b):
        counts = pairs.groupBy(*by, c).agg(F.sum("_w").alias("_n"))
        run = ordered_scan(counts, by, c, _cum=running_sum("_n"), _rest=running_sum("_n", reverse=True))
        total = F.col("_cum") + F.col("_rest") - F.col("_n")
        # mean rank of the value minus the mean of all ranks
        centred = F.col("_cum") - (F.col("_n") - 1) / 2.0 - (total + 1) / 2.0
        pairs = pairs.join(run.select(*by, c, centred.alias(f"_r_{c}")), by + [c])
    return _rank_correlation(pairs, a, b, by, to)


def _rank_correlation(pairs: DataFrame, a: str, b: str, by: list[str], to: str) -> DataFrame:
    x, y, w = F.col(f"_r_{a}"), F.col(f"_r_{b}"), F.col("_w")
    sxx, syy = F.sum(w * x * x), F.sum(w * y * y)
    return pairs.groupBy(*by).agg(F.when((sxx > 0) & (syy > 0), F.sum(w * x * y) / F.sqrt(sxx * syy)).alias(to))


def regression_metrics(df: DataFrame, pred: str = "pred", truth: str = "truth", by=None, clamp_log: bool = False, ranks: bool = True) -> DataFrame:
    """n, mae, mse, rmse, r2, pearson, log_pearson (of log(x + 1)), spearman per group.

    ``clamp_log`` sets negatives to zero before the logarithm. Constant series have no
    correlation (NULL).
    """
    by = as_list(by)
    rows = df.filter(is_finite(pred) & is_finite(truth))
    p, t = F.col(pred).cast("double"), F.col(truth).cast("double")
    lp, lt = (F.log1p(F.greatest(p, F.lit(0.0))), F.log1p(F.greatest(t, F.lit(0.0)))) if clamp_log else (F.log(p + 1), F.log(t + 1))
    err = F.sum((t - p) * (t - p))
    var = F.var_pop(t) * F.count(t)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(t - p)).alias("mae"),
        F.avg((t - p) * (t - p)).alias("mse"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        F.when(var > 0, 1 - err / var).alias("r2"),
        _corr(p, t).alias("pearson"),
        _corr(lp, lt).alias("log_pearson"),
    )
    return join_groups(out, spearman(rows, pred, truth, by), by) if ranks else out


def rank_curve(df: DataFrame, score: str, positive: Column, by=None) -> DataFrame:
    """AUROC and average precision of a score, and of its negation for the other class.

    One ordered scan of distinct scores; ties share a threshold. NULL when a class is empty.
    """
    by = as_list(by)
    counts = (
        df.filter(F.col(score).isNotNull() & positive.isNotNull())
        .groupBy(*by, score)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(positive.cast("long")).alias("_p"))
    )
    run = ordered_scan(
        counts, by, score,
        _cn=running_sum("_n"), _cp=running_sum("_p"), _rn=running_sum("_n", True), _rp=running_sum("_p", True),
    )
    n, p = F.col("_n"), F.col("_p")
    total, pos = F.col("_cn") + F.col("_rn") - n, F.col("_cp") + F.col("_rp") - p
    neg = total - pos
    below = F.col("_cn") - F.col("_cp") - (n - p)
    run = run.withColumn("_ok", (pos > 0) & (neg > 0)).withColumn("_pos", pos).withColumn("_neg", neg)
    run = run.withColumn("_auc", p * (below + (n - p) / 2.0))
    run = run.withColumn("_ap", p * F.col("_rp") / F.col("_rn"))
    run = run.withColumn("_ap0", (n - p) * (F.col("_cn") - F.col("_cp")) / F.col("_cn"))
    ok, P, N = F.max("_ok"), F.max("_pos"), F.max("_neg")
    return run.groupBy(*by).agg(
        F.when(ok, F.sum("_auc") / (P * N)).alias("auroc"),
        F.when(ok, F.sum("_ap") / P).alias("auprc"),
        F.when(ok, F.sum("_ap0") / N).alias("auprc_other"),
    )


def zero_inflated_metrics(df: DataFrame, pred: str = "pred", truth: str = "truth", by=None) -> DataFrame:
    """Metrics over all rows and over rows with a non-zero truth, plus zero detection scores."""
    by = as_list(by)
    rows = settle(df.filter(is_finite(pred) & is_finite(truth)).select(*by, pred, truth))
    base = regression_metrics(rows, pred, truth, by)
    nz = regression_metrics(rows.filter(F.col(truth) != 0), pred, truth, by)
    enough = F.col("nonzero_n") >= 2
    nz = nz.select(*by, *[F.col(c).alias(f"nonzero_{c}") for c in nz.columns if c not in by])
    for c in ("pearson", "log_pearson", "spearman"):
        nz = nz.withColumn(f"nonzero_{c}", F.when(enough, F.col(f"nonzero_{c}")))
    # auroc of "non-zero by pred" equals auroc of "zero by -pred"
    curve = rank_curve(rows, pred, F.col(truth) != 0, by).select(
        *by, F.col("auroc").alias("zero_auroc"), F.col("auprc_other").alias("zero_auprc"), F.col("auprc").alias("nonzero_auprc")
    )
    zero = rows.groupBy(*by).agg((F.avg((F.col(truth) == 0).cast("double")) * 100).alias("zero_ratio"))
    out = base
    for other in (nz, curve, zero):
        out = join_groups(out, other, by)
    return out


def per_window_metrics(df: DataFrame, window, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """One row per window that has more than one distinct value on both sides where both are positive."""
    by = as_list(window)
    p, t = F.col(pred), F.col(truth)
    both = (p > 0) & (t > 0)
    pz, tz = F.when(both, p), F.when(both, t)
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("length"),
        _corr(pz, tz).alias("pearson_corr"),
        F.avg((p - t) * (p - t)).alias("mse"),
        F.avg(F.abs(p - t)).alias("mae"),
        F.avg(p).alias("pred_mean"),
        F.avg(t).alias("true_mean"),
        F.max(p).alias("pred_max"),
        F.max(t).alias("true_max"),
        F.avg((p == 0).cast("double")).alias("pred_zero_ratio"),
        F.avg((t == 0).cast("double")).alias("true_zero_ratio"),
        F.count(F.when(both, 1)).alias("non_zero_count"),
        (F.min(pz) < F.max(pz)).alias("_vp"),
        (F.min(tz) < F.max(tz)).alias("_vt"),
    )
    base = base.filter((F.col("non_zero_count") > 1) & F.col("_vp") & F.col("_vt")).drop("_vp", "_vt")
    rho = spearman(df.filter(both), pred, truth, by, "spearman_corr")
    return base.join(rho, by)


def summarise_windows(windows: DataFrame, cols=("pearson_corr", "spearman_corr")) -> DataFrame:
    """Mean, median, population std, extremes and quartiles of per-window scores, one row per score."""
    # both passes read the scores, so they are written once
    long = settle(windows.select(*cols).unpivot([], list(cols), "score", "value").filter(F.col("value").isNotNull()))
    base = long.groupBy("score").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return base.join(quantiles(long, "score", "value", {"median": 0.5, "q25": 0.25, "q75": 0.75}), "score")


def chromosome_stats(windows: DataFrame, chrom: str = "chrom") -> DataFrame:
    return windows.groupBy(chrom).agg(
        F.round(F.avg("pearson_corr"), 4).alias("pearson_mean"),
        F.round(F.stddev_samp("pearson_corr"), 4).alias("pearson_std"),
        F.count("pearson_corr").alias("n"),
        F.round(F.avg("spearman_corr"), 4).alias("spearman_mean"),
        F.round(F.stddev_samp("spearman_corr"), 4).alias("spearman_std"),
        F.round(F.avg("length"), 4).alias("length_mean"),
        F.sum("length").alias("length_sum"),
        F.round(F.avg("mse"), 4).alias("mse_mean"),
        F.round(F.avg("mae"), 4).alias("mae_mean"),
    )


def distribution_compare(df: DataFrame, pred: str = "pred", truth: str = "truth", by=None) -> DataFrame:
    """Moments, extremes, zero ratio and quartiles of both sides, with R2 and RMSE."""
    by = as_list(by)
    sides = {"pred": pred, "true": truth}
    aggs = []
    for n, c in sides.items():
        v = F.col(c)
        aggs += [
            F.avg(v).alias(f"{n}_mean"), F.stddev_pop(v).alias(f"{n}_std"), F.min(v).alias(f"{n}_min"),
            F.max(v).alias(f"{n}_max"), F.avg((v == 0).cast("double")).alias(f"{n}_zero_ratio"),
        ]
    out = df.groupBy(*by).agg(*aggs)
    fit = regression_metrics(df, pred, truth, by, ranks=False).select(*by, "mse", "mae", "rmse", "r2")
    out = join_groups(out, fit, by)
    for n, c in sides.items():
        q = quantiles(df, by, c, {f"{n}_q25": 0.25, f"{n}_median": 0.5, f"{n}_q75": 0.75})
        out = join_groups(out, q, by)
    return out


# Fixed percentages of the extreme value report.
PERCENTS = (0, 1, 5, 25, 50, 75, 95, 99, 100)


def extreme_value_report(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Percentiles of both sides and the weight of predictions above their 99th percentile.

    Also counts predictions over 100 times the 99.9th percentile of the truth.
    """
    pq = quantiles(df, None, pred, {f"pred_p{p}": p / 100 for p in PERCENTS})
    tq = quantiles(df, None, truth, {f"true_p{p}": p / 100 for p in PERCENTS} | {"_t999": 0.999})
    cuts = attach_row(pq, tq)
    rows = attach_row(df.select(pred, truth), cuts.select("pred_p99", "_t999"))
    p, t = F.col(pred), F.col(truth)
    far = p > F.col("pred_p99")
    sq = (p - t) * (p - t)
    agg = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(far, 1)).alias("extreme_count"),
        F.avg(far.cast("double")).alias("extreme_ratio"),
        ratio(F.sum(F.when(far, sq)), F.sum(sq)).alias("extreme_mse_share"),
        F.avg(F.when(~far, sq)).alias("mse_filtered"),
        _corr(F.when(~far, p), F.when(~far, t)).alias("pearson_filtered"),
        F.count(F.when(p > F.col("_t999") * 100, 1)).alias("absurd_count"),
    )
    rho = spearman(rows.filter(~far), pred, truth, None, "spearman_filtered")
    return attach_row(attach_row(agg, rho), cuts.drop("_t999"))


def grouped_metrics(df: DataFrame, by, chroms, trim: int = 100, pred: str = "pred", truth: str = "truth", chrom: str = "chrom") -> DataFrame:
    """Zero-inflated metrics per group over array windows of the validation chromosomes.

    ``trim`` positions are cut at both ends of every window.
    """
    by = as_list(by)
    n = F.size(pred) - 2 * trim
    zipped = F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("t"))
    rows = df.filter(F.col(chrom).isin(*chroms) & (n > 0)).select(*by, F.explode(F.slice(zipped, F.lit(trim + 1), n)).alias("_z"))
    rows = rows.select(*by, F.col("_z.p").cast("double").alias("pred"), F.col("_z.t").cast("double").alias("truth"))
    return zero_inflated_metrics(rows, "pred", "truth", by)


def average_metric_rows(rows: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    return rows.groupBy(metric).agg(F.round(F.avg(F.when(~F.isnan(value), F.col(value))), 6).alias(value))


def index_statistics(index: DataFrame, chrom: str = "chrom", file: str = "file_name") -> DataFrame:
    """Window counts in all, per chromosome and per file, and distinct names, in one table."""
    sets = index.groupingSets([[], [chrom], [file]], chrom, file).agg(F.count(F.lit(1)).alias("windows"), F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "chromosome").otherwise("file")
    return sets.select(kind.alias("kind"), F.coalesce(F.when(F.col("_g") == 1, F.col(chrom)), F.when(F.col("_g") == 2, F.col(file)), F.lit("")).alias("name"), "windows")


def modality_heads(meta: DataFrame) -> DataFrame:
    """Distinct assay_strand heads."""
    return meta.select(F.concat_ws("_", "assay", "strand").alias("head")).distinct()


def first_seen_order(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return df.groupBy(col).agg(F.min(order).alias("first_at")).orderBy("first_at", col)


def class_report(df: DataFrame, label: str = "label", pred: str = "pred", ignore=None) -> DataFrame:
    """Per-class tp, fp, fn, precision, recall, f1 and IoU from the confusion counts."""
    rows = df if ignore is None else df.filter(F.col(label) != ignore)
    cm = rows.groupBy(F.col(label).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = cm.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called")),
            )
        ).alias("s")
    ).select("s.*")
    out = per.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("called").alias("called"))
    tp, a, c = F.col("tp"), F.col("actual"), F.col("called")
    return out.select(
        "class", "tp", (c - tp).alias("fp"), (a - tp).alias("fn"),
        F.coalesce(ratio(tp, c), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(tp, a), F.lit(0.0)).alias("recall"),
        F.coalesce(ratio(2 * tp, a + c), F.lit(0.0)).alias("f1"),
        F.coalesce(ratio(tp, a + c - tp), F.lit(0.0)).alias("iou"),
    )


def confusion_report(df: DataFrame, label: str = "label", pred: str = "pred", ignore=None) -> DataFrame:
    """Overall accuracy, Cohen's kappa, correlation coefficient and class means (one row)."""
    per = class_report(df, label, pred, ignore)
    tp, a, c = F.col("tp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    one = per.agg(
        F.sum(a).alias("n"), F.sum(tp).alias("_hit"),
        F.sum(a.cast("double") * c).alias("_ac"), F.sum(a.cast("double") * a).alias("_aa"), F.sum(c.cast("double") * c).alias("_cc"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.avg("iou").alias("iou"),
    )
    n = F.col("n").cast("double")
    pe = F.col("_ac") / (n * n)
    acc = F.col("_hit") / n
    cov = F.col("_hit") * n - F.col("_ac")
    den = F.sqrt((n * n - F.col("_aa")) * (n * n - F.col("_cc")))
    return one.select(
        "n", acc.alias("accuracy"), "precision", "recall", "f1", "iou",
        F.coalesce(ratio(acc - pe, 1 - pe), F.lit(0.0)).alias("kappa"),
        F.coalesce(ratio(cov, den), F.lit(0.0)).alias("mcc"),
    )


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred", scores: str = "scores", n_classes: int = 2) -> DataFrame:
    """accuracy, roc_auc, precision, recall, f1, mcc; binary uses class 1, else macro means.

    ``scores`` is an array with one score per class.
    """
    whole = confusion_report(df, label, pred)
    if n_classes == 2:
        one = class_report(df, label, pred).filter(F.col("class") == 1).select("precision", "recall", "f1")
        auc = rank_curve(df.withColumn("_s", F.get(scores, F.lit(1))), "_s", F.col(label) == 1).select(F.col("auroc").alias("roc_auc"))
        zero = df.limit(1).agg(F.lit(0.0).alias("_z"))
        one = attach_row(zero, one.agg(F.max("precision").alias("precision"), F.max("recall").alias("recall"), F.max("f1").alias("f1"))).drop("_z")
        out = attach_row(attach_row(whole.select("accuracy", "mcc"), auc), one)
    else:
        long = df.select(label, F.posexplode(scores).alias("_c", "_s"))
        auc = rank_curve(long, "_s", F.col(label) == F.col("_c"), "_c").agg(F.avg("auroc").alias("roc_auc"))
        out = attach_row(whole, auc)
    return out.select("accuracy", "roc_auc", "precision", "recall", "f1", "mcc")


def multilabel_metrics(df: DataFrame, labels: str = "labels", preds: str = "preds", scores: str = "scores") -> DataFrame:
    """Exact-match accuracy and means over labels of AUC, precision, recall, F1 and MCC."""
    exact = df.agg(F.avg((F.col(labels) == F.col(preds)).cast("double")).alias("accuracy"))
    long = df.select(F.posexplode(F.arrays_zip(F.col(labels).alias("t"), F.col(preds).alias("p"), F.col(scores).alias("s"))).alias("_c", "_z"))
    long = long.select("_c", F.col("_z.t").alias("t"), F.col("_z.p").alias("p"), F.col("_z.s").alias("s"))
    n = lambda c: F.sum(c.cast("double"))
    t, p = F.col("t") == 1, F.col("p") == 1
    per = long.groupBy("_c").agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    per = per.select(
        "_c",
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        F.coalesce(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), zero).alias("mcc"),
    )
    per = per.join(rank_curve(long, "s", t, "_c").select("_c", "auroc"), "_c")
    mean = per.agg(F.avg("auroc").alias("roc_auc"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "mcc")])
    return attach_row(exact, mean)


def multi_target_regression(df: DataFrame, preds: str = "preds", truths: str = "truths") -> DataFrame:
    """Means over targets of mse, mae, r2, pearson and spearman."""
    long = df.select(F.posexplode(F.arrays_zip(F.col(preds).alias("p"), F.col(truths).alias("t"))).alias("target", "_z"))
    long = long.select("target", F.col("_z.p").alias("pred"), F.col("_z.t").alias("truth"))
    per = regression_metrics(long, by="target")
    return per.agg(*[F.avg(c).alias(c) for c in ("mse", "mae", "r2", "pearson", "spearman")])


def signal_error(df: DataFrame, a: str, b: str, peak: float = 1.0) -> DataFrame:
    """MSE, PSNR and mean absolute error over paired arrays."""
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y)
    rows = df.select(
        F.aggregate(gap, F.lit(0.0), lambda s, d: s + d * d).alias("_sq"), F.aggregate(gap, F.lit(0.0), lambda s, d: s + F.abs(d)).alias("_ab"), F.size(a).alias("_n")
    )
    mse = F.sum("_sq") / F.sum("_n")
    out = rows.agg(mse.alias("mse"), (F.sum("_ab") / F.sum("_n")).alias("abs_error"))
    return out.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(peak * peak) / F.col("mse"))))


def topk_hits(hits: DataFrame, k: int, query: str = "query", rank: str = "rank", hit: str = "hit") -> DataFrame:
    """For every depth r <= k: questions whose first hit is at rank <= r, and their share."""
    first = hits.groupBy(query).agg(F.min(F.when(F.col(hit), F.col(rank))).alias("_first"))
    n = first.agg(F.count(F.lit(1)).alias("questions"))
    at = first.filter(F.col("_first") <= k).groupBy(F.col("_first").alias("depth")).agg(F.count(F.lit(1)).alias("_new"))
    # k rows at most
    depths = n.select(F.explode(F.sequence(F.lit(1), F.lit(k))).alias("depth"), "questions")
    run = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = depths.join(at, "depth", "left").withColumn("hits", F.sum(F.coalesce("_new", F.lit(0))).over(run))
    return out.select("depth", "hits", ratio(F.col("hits"), F.col("questions")).alias("accuracy"))


def retrieval_rank(df: DataFrame, scores: str = "scores", positive: str = "positive", ks=(1, 5)) -> DataFrame:
    """In-batch mean rank of the positive (1 = best) and top-k accuracy."""
    mine = F.get(F.col(scores), F.col(positive).cast("int"))
    better = F.size(F.filter(scores, lambda s: s > mine))
    rows = df.select((better + 1).alias("rank"))
    return rows.agg(F.avg("rank").alias("mean_rank"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}") for k in ks])


def perplexity(df: DataFrame, loss: str, mask: str, tokens: str = "tokens", original: str = "original_tokens", by=None) -> DataFrame:
    """Masked loss sum, perplexity and the one adjusted to the original token count."""
    s = df.groupBy(*as_list(by)).agg(F.sum(F.col(loss) * F.col(mask)).alias("loss"), F.max(tokens).alias("_t"), F.max(original).alias("_o"))
    avg = F.col("loss") / (F.col("_t") - 1)
    per = F.exp(F.least(F.lit(20.0), avg))
    r = (F.col("_t") - 1) / (F.col("_o") - 1)
    return s.select(*as_list(by), "loss", avg.alias("avg_loss"), per.alias("ppl"), F.exp(F.least(F.lit(20.0), avg * r)).alias("adjusted_ppl"), r.alias("token_ratio"))


def cloze_accuracy(df: DataFrame, sample: str, correct: str, masked: str) -> DataFrame:
    """Share of samples whose scored tokens are all right."""
    per = df.groupBy(sample).agg(F.coalesce(F.bool_and(F.when(F.col(masked), F.col(correct))), F.lit(True)).alias("_ok"))
    return per.agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("_ok").cast("double")).alias("accuracy"))


def ensemble_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """Best accuracy of ``score >= threshold`` over 0.00, 0.01 ... 0.99; the lowest best wins.

    Rows are first counted per threshold step they still pass, so each row is one count.
    """
    step = F.least(F.lit(99), F.greatest(F.lit(-1), F.floor(F.col(score) * 100 + 1e-9))).cast("int")
    counts = df.groupBy(step.alias("_s")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("_p"), F.count(F.when(F.col(label) != 1, 1)).alias("_q")
    )  # at most 101 rows
    total = counts.agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_tq"))
    grid = total.select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("_s"), "*")
    below = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    low = counts.filter("_s < 0").agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("_lp"), F.coalesce(F.sum("_q"), F.lit(0)).alias("_lq"))
    grid = attach_row(grid.join(counts.filter("_s >= 0"), "_s", "left"), low)
    zero = F.lit(0)
    p_below = F.coalesce(F.sum(F.coalesce("_p", zero)).over(below), zero) + F.col("_lp")
    q_below = F.coalesce(F.sum(F.coalesce("_q", zero)).over(below), zero) + F.col("_lq")
    acc = (F.col("_tp") - p_below + q_below) / (F.col("_tp") + F.col("_tq"))
    best = grid.select("_s", acc.alias("accuracy")).agg(F.max_by("_s", F.struct("accuracy", -F.col("_s"))).alias("_s"), F.max("accuracy").alias("accuracy"))
    return best.select((F.col("_s") / 100.0).alias("threshold"), "accuracy")


def rank_time_report(df: DataFrame, step: str, rank: str, duration: str, n: int = 2) -> DataFrame:
    """Per step the fastest and slowest rank, and the n ranks with most and least throughput."""
    per = df.groupBy(step, rank).agg(F.sum(duration).alias("time"), F.count(F.lit(1)).alias("calls"))
    per = per.withColumn("throughput", ratio(F.col("calls"), F.col("time")))
    base = per.groupBy(step).agg(
        F.min("time").alias("min_time"), F.min_by(rank, F.struct("time", rank)).alias("min_rank"),
        F.max("time").alias("max_time"), F.max_by(rank, F.struct(F.col("time"), -F.col(rank))).alias("max_rank"),
    )
    for name, order in (("top", F.col("throughput").desc()), ("bottom", F.col("throughput").asc())):
        w = Window.partitionBy(step).orderBy(order, F.col(rank))
        few = per.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
        few = few.groupBy(step).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", rank))), lambda s: s[rank]).alias(f"{name}_ranks"))
        base = base.join(few, step, "left")
    return base


def best_layer(df: DataFrame, metric: str, by: str = "task", layer: str = "layer") -> DataFrame:
    """The row with the best metric per dataset, the lowest layer first on ties."""
    cols = [c for c in df.columns if c != by]
    return df.filter(F.col(metric).isNotNull()).groupBy(by).agg(F.max_by(F.struct(*cols), F.struct(F.col(metric), -F.col(layer))).alias("_r")).select(by, "_r.*")


def last_layer(df: DataFrame, by: str = "task", layer: str = "layer") -> DataFrame:
    cols = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*cols), layer).alias("_r")).select(by, "_r.*")


def best_per_metric(df: DataFrame, metrics, by: str = "task", layer: str = "layer") -> DataFrame:
    aggs = []
    for m in as_list(metrics):
        aggs += [F.max(m).alias(m), F.max_by(layer, F.when(F.col(m).isNotNull(), F.struct(F.col(m), -F.col(layer)))).alias(f"{m}_layer")]
    return df.groupBy(by).agg(*aggs)


def dataset_profile(df: DataFrame, dataset: str = "dataset", split: str = "split", length: str = "length", label: str = "label") -> DataFrame:
    """Rows, length range and share of the dataset for every (dataset, split, label)."""
    per = df.groupBy(dataset, split, label).agg(F.count(F.lit(1)).alias("rows"), F.min(length).alias("min_length"), F.max(length).alias("max_length"))
    total = per.groupBy(dataset).agg(F.sum("rows").alias("_all"))
    return per.join(total, dataset).withColumn("share", F.col("rows") / F.col("_all")).drop("_all")


def profile_mismatches(profile: DataFrame, declared: DataFrame, keys=("dataset", "split", "label"), value: str = "rows") -> DataFrame:
    """Declared counts that the data does not bear out (or lacks, or has without declaration)."""
    d = declared.select(*keys, F.col(value).alias("declared"))
    both = profile.select(*keys, F.col(value).alias("found")).join(d, as_list(keys), "full")
    return both.filter(~F.col("found").eqNullSafe(F.col("declared")))


def unequal_class_counts(profile: DataFrame, dataset: str = "dataset", split: str = "split", label: str = "label") -> DataFrame:
    """Datasets whose splits do not have the same number of classes."""
    per = profile.groupBy(dataset, split).agg(F.count_distinct(label).alias("classes"))
    return per.groupBy(dataset).agg(F.min("classes").alias("least"), F.max("classes").alias("most")).filter("least <> most")
