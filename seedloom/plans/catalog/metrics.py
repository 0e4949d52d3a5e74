from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.operators import metrics as mt
from seedloom.plans.registry import query


def ranked(src: str, by: str) -> str:
    """Oracle text: ``src`` with tie-averaged ranks rp, rt of pred and truth within ``by``."""
    return f"""(SELECT *, rank() OVER (PARTITION BY {by} ORDER BY pred) + (count(*) OVER (PARTITION BY {by}, pred) - 1) / 2.0 AS rp,
        rank() OVER (PARTITION BY {by} ORDER BY truth) + (count(*) OVER (PARTITION BY {by}, truth) - 1) / 2.0 AS rt FROM {src})"""


def reg_sql(src: str, by: str, pre: str = "") -> str:
    return f"""SELECT {by}, count(*) AS {pre}n, avg(abs(truth - pred)) AS {pre}mae, avg((truth - pred) ** 2) AS {pre}mse, sqrt(avg((truth - pred) ** 2)) AS {pre}rmse,
        1 - sum((truth - pred) ** 2) / (var_pop(truth) * count(*)) AS {pre}r2, corr(pred, truth) AS {pre}pearson, corr(ln(pred + 1), ln(truth + 1)) AS {pre}log_pearson,
        corr(rp, rt) AS {pre}spearman FROM {ranked(src, by)} GROUP BY {by}"""


def auc_sql(src: str, by: str, score: str, positive: str) -> str:
    """Oracle text: auroc and average precision of ``positive`` by descending ``score``."""
    return f"""SELECT {by}, sum(p * (neg_below + (n - p) / 2.0)) / (max(tp_all) * max(n_all - tp_all)) AS auroc, sum(p * tp / CAST(pp AS DOUBLE)) / max(tp_all) AS ap FROM (
        SELECT *, sum(n - p) OVER (PARTITION BY {by} ORDER BY s) - (n - p) AS neg_below, sum(p) OVER (PARTITION BY {by} ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY {by} ORDER BY s DESC) AS pp,
          sum(p) OVER (PARTITION BY {by}) AS tp_all, sum(n) OVER (PARTITION BY {by}) AS n_all
        FROM (SELECT {by}, {score} AS s, count(*) AS n, CAST(count(*) FILTER ({positive}) AS DOUBLE) AS p FROM {src} GROUP BY 1, 2)) GROUP BY {by}"""


REG = "n:l mae:d mse:d rmse:d r2:d pearson:d log_pearson:d spearman:d"
ZIF = REG + " " + " ".join(f"nonzero_{c}" for c in REG.split()) + " zero_auroc:d zero_auprc:d nonzero_auprc:d zero_ratio:d"


def zif_sql(src: str, by: str) -> str:
    return f"""SELECT a.*, b.* EXCLUDE ({by}), c.auroc AS zero_auroc, c.ap AS zero_auprc, d.ap AS nonzero_auprc, z.zero_ratio FROM ({reg_sql(src, by)}) a
        LEFT JOIN ({reg_sql(f'(SELECT * FROM {src} WHERE truth <> 0)', by, 'nonzero_')}) b USING ({by})
        LEFT JOIN ({auc_sql(src, by, '-pred', 'truth = 0')}) c USING ({by}) LEFT JOIN ({auc_sql(src, by, 'pred', 'truth <> 0')}) d USING ({by})
        JOIN (SELECT {by}, 100.0 * avg(CASE WHEN truth = 0 THEN 1 ELSE 0 END) AS zero_ratio FROM {src} GROUP BY 1) z USING ({by})"""


@query("a22_regression_metrics", f"track:l {REG}", reg_sql("preds", "track"))
def _(t):
    return mt.regression_metrics(t.preds, by="track")


@query("a23_zero_inflated_metrics", f"chrom:s {ZIF}", zif_sql("preds", "chrom"))
def _(t):
    return mt.zero_inflated_metrics(t.preds, by="chrom")


PW = f"""SELECT chrom, window_id, count(*) AS length, corr(CASE WHEN pred > 0 AND truth > 0 THEN pred END, CASE WHEN pred > 0 AND truth > 0 THEN truth END) AS pearson_corr, avg((pred - truth) ** 2) AS mse, avg(abs(pred - truth)) AS mae,
    avg(pred) AS pred_mean, avg(truth) AS true_mean, avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0 END) AS pred_zero_ratio, count(*) FILTER (pred > 0 AND truth > 0) AS non_zero_count FROM windowed GROUP BY 1, 2
    HAVING count(DISTINCT pred) FILTER (pred > 0 AND truth > 0) > 1 AND count(DISTINCT truth) FILTER (pred > 0 AND truth > 0) > 1"""
PW_ALL = f"""SELECT w.*, s.spearman_corr FROM ({PW}) w JOIN (SELECT chrom, window_id, corr(rp, rt) AS spearman_corr FROM {ranked('(SELECT * FROM windowed WHERE pred > 0 AND truth > 0)', 'chrom, window_id')} GROUP BY 1, 2) s USING (chrom, window_id)"""


def windows(t):
    return mt.per_window_metrics(t.windowed, ["chrom", "window_id"])


@query(
    "a24_per_window_metrics",
    "chrom:s window_id:l length:l pearson_corr:d spearman_corr:d mse:d mae:d pred_mean:d true_mean:d pred_zero_ratio:d non_zero_count:l",
    PW_ALL,
)
def _(t):
    return windows(t)


@query(
    "a24_summarise_windows",
    "score:s mean:d std:d min:d max:d median:d q25:d q75:d",
    f"""WITH w AS ({PW_ALL}) SELECT score, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, median(v) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75
        FROM (SELECT 'pearson_corr' AS score, pearson_corr AS v FROM w UNION ALL SELECT 'spearman_corr', spearman_corr FROM w) GROUP BY 1""",
)
def _(t):
    return mt.summarise_windows(windows(t))


@query(
    "a25_chromosome_stats",
    "chrom:s pearson_mean:d n:l spearman_std:d length_sum:l mae_mean:d",
    f"SELECT chrom, round(avg(pearson_corr), 4) AS pearson_mean, count(*) AS n, round(stddev_samp(spearman_corr), 4) AS spearman_std, sum(length) AS length_sum, round(avg(mae), 4) AS mae_mean FROM ({PW_ALL}) GROUP BY 1",
)
def _(t):
    return mt.chromosome_stats(windows(t))


SIDE = "avg({c}) AS {n}_mean, stddev_pop({c}) AS {n}_std, min({c}) AS {n}_min, max({c}) AS {n}_max, avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0 END) AS {n}_zero_ratio, quantile_cont({c}, 0.25) AS {n}_q25, median({c}) AS {n}_median, quantile_cont({c}, 0.75) AS {n}_q75"


@query(
    "a26_distribution_compare",
    "track:l pred_mean:d pred_std:d pred_min:d pred_max:d pred_zero_ratio:d pred_q25:d pred_median:d pred_q75:d true_mean:d true_std:d true_min:d true_max:d true_zero_ratio:d true_q25:d true_median:d true_q75:d rmse:d r2:d",
    f"SELECT track, {SIDE.format(n='pred', c='pred')}, {SIDE.format(n='true', c='truth')}, sqrt(avg((truth - pred) ** 2)) AS rmse, 1 - sum((truth - pred) ** 2) / (var_pop(truth) * count(*)) AS r2 FROM preds GROUP BY 1",
)
def _(t):
    return mt.distribution_compare(t.preds, by="track")


@query(
    "a27_extreme_value_report",
    "n:l extreme_count:l extreme_ratio:d extreme_mse_share:d mse_filtered:d pearson_filtered:d spearman_filtered:d absurd_count:l pred_p1:d pred_p50:d pred_p99:d true_p5:d true_p95:d",
    f"""WITH x AS (SELECT 1 AS one, l_extendedprice / 1000 AS pred, l_quantity AS truth FROM lineitem), q AS (SELECT quantile_cont(pred, 0.99) AS p99, quantile_cont(truth, 0.999) AS t999, quantile_cont(pred, 0.01) AS pred_p1, median(pred) AS pred_p50,
         quantile_cont(truth, 0.05) AS true_p5, quantile_cont(truth, 0.95) AS true_p95 FROM x), k AS (SELECT * FROM x, q WHERE pred <= p99)
        SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM x, q WHERE pred > p99) AS extreme_count, (SELECT avg(CASE WHEN pred > p99 THEN 1.0 ELSE 0 END) FROM x, q) AS extreme_ratio,
          (SELECT sum((pred - truth) ** 2) FILTER (pred > p99) / sum((pred - truth) ** 2) FROM x, q) AS extreme_mse_share, (SELECT avg((pred - truth) ** 2) FROM k) AS mse_filtered, (SELECT corr(pred, truth) FROM k) AS pearson_filtered,
          (SELECT corr(rp, rt) FROM {ranked('k', 'one')}) AS spearman_filtered, (SELECT count(*) FROM x, q WHERE pred > 100 * t999) AS absurd_count, pred_p1, pred_p50, p99 AS pred_p99, true_p5, true_p95 FROM q""",
)
def _(t):
    df = t.lineitem.select((F.col("l_extendedprice") / 1000).alias("pred"), F.col("l_quantity").alias("truth"))
    return mt.extreme_value_report(df)


@query(
    "a28_grouped_metrics",
    f"lang:s {ZIF}",
    zif_sql("(SELECT lang, ascii(bases[j]) % 7 * 1.0 AS pred, ascii(bases[j]) % 5 * 1.0 AS truth FROM (SELECT lang, text AS bases, unnest(range(101, n_chars - 99)) AS j FROM documents WHERE source IN ('src1', 'src2', 'src3')))", "lang"),
)
def _(t):
    code = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    df = t.documents.select("lang", "source", F.transform(code, lambda c: (c % 7).cast("double")).alias("pred"), F.transform(code, lambda c: (c % 5).cast("double")).alias("truth"))
    return mt.grouped_metrics(df, "lang", ["src1", "src2", "src3"], chrom="source")


@query(
    "a29_average_metric_rows",
    "metric:s value:d",
    "SELECT l_linestatus AS metric, round(avg(l_tax / l_discount), 6) AS value FROM lineitem WHERE l_discount <> 0 GROUP BY 1",
)
def _(t):
    v = F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("nan")))
    return mt.average_metric_rows(t.lineitem.select(F.col("l_linestatus").alias("metric"), v.alias("value")))


@query(
    "a30_index_statistics",
    "kind:s name:s windows:l",
    "SELECT 'total' AS kind, '' AS name, count(*) AS windows FROM documents UNION ALL SELECT 'chromosome', lang, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'file', source, count(*) FROM documents GROUP BY 2",
)
def _(t):
    return mt.index_statistics(t.documents, "lang", "source")


@query("a30_modality_heads", "head:s", "SELECT DISTINCT assay || '_' || strand AS head FROM meta")
def _(t):
    return mt.modality_heads(t.meta)


@query("a30_first_seen_order", "biosample:l first_at:l", "SELECT biosample, min(track_index) AS first_at FROM meta GROUP BY 1")
def _(t):
    return mt.first_seen_order(t.meta, "biosample", "track_index")


SCORED = "(SELECT 1 AS one, doc_id, quality AS label, n_chars, n_chars / 20000.0 AS score, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS pred, toxic FROM labels JOIN documents USING (doc_id))"


def scored(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("label"), "n_chars", (F.col("n_chars") / 20000.0).alias("score"), (F.col("n_chars") > 500).cast("int").alias("pred"), "toxic")


@query(
    "a32_classification_metrics",
    "accuracy:d roc_auc:d precision:d recall:d f1:d mcc:d",
    f"""SELECT (tp + tn) / n AS accuracy, (SELECT auroc FROM ({auc_sql(SCORED, 'one', 'score', 'label = 1')})) AS roc_auc, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
          (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (label = 1 AND pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 0 AND pred = 0) AS DOUBLE) AS tn,
          CAST(count(*) FILTER (label = 0 AND pred = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (label = 1 AND pred = 0) AS DOUBLE) AS fn FROM {SCORED})""",
)
def _(t):
    return mt.classification_metrics(scored(t).withColumn("scores", F.array(1 - F.col("score"), F.col("score"))))


LONG = f"(SELECT 0 AS c, label AS t, pred AS p, score AS s FROM {SCORED} UNION ALL SELECT 1, toxic, n_chars % 2, 1 - score FROM {SCORED})"


@query(
    "a32_multilabel_metrics",
    "accuracy:d roc_auc:d precision:d recall:d f1:d mcc:d",
    f"""WITH k AS (SELECT c, CAST(count(*) FILTER (t = 1 AND p = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (t = 0 AND p = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (t = 1 AND p = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (t = 0 AND p = 0) AS DOUBLE) AS tn FROM {LONG} GROUP BY 1)
        SELECT (SELECT avg(CASE WHEN label = pred AND toxic = n_chars % 2 THEN 1.0 ELSE 0 END) FROM {SCORED}) AS accuracy, (SELECT avg(auroc) FROM ({auc_sql(LONG, 'c', 's', 't = 1')})) AS roc_auc, avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS precision, avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS recall,
          avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1, avg(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)) AS mcc FROM k""",
)
def _(t):
    df = scored(t).select(
        F.array("label", "toxic").alias("labels"), F.array("pred", (F.col("n_chars") % 2).cast("int")).alias("preds"), F.array("score", 1 - F.col("score")).alias("scores")
    )
    return mt.multilabel_metrics(df)


@query(
    "a33_multi_target_regression",
    "mse:d mae:d r2:d pearson:d spearman:d",
    f"""SELECT avg(mse) AS mse, avg(mae) AS mae, avg(r2) AS r2, avg(pearson) AS pearson, avg(spearman) AS spearman FROM ({reg_sql('(SELECT 1 AS target, l_tax AS pred, l_discount AS truth FROM lineitem UNION ALL SELECT 2, l_quantity / 50, l_extendedprice / 100000 FROM lineitem)', 'target')})""",
)
def _(t):
    df = t.lineitem.select(F.array("l_tax", F.col("l_quantity") / 50).alias("preds"), F.array("l_discount", F.col("l_extendedprice") / 100000).alias("truths"))
    return mt.multi_target_regression(df)


@query(
    "a34_class_report",
    "class:l tp:l fp:l fn:l precision:d recall:d f1:d iou:d",
    f"""SELECT class, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp + fn) AS iou FROM (
        SELECT c.class, CAST(count(*) FILTER (label = class AND pred = class) AS DOUBLE) AS tp, CAST(count(*) FILTER (label <> class AND pred = class) AS DOUBLE) AS fp, CAST(count(*) FILTER (label = class AND pred <> class) AS DOUBLE) AS fn
        FROM {SCORED} s, (SELECT unnest([0, 1]) AS class) c GROUP BY 1)""",
)
def _(t):
    return mt.class_report(scored(t))


@query(
    "a34_confusion_report",
    "n:l accuracy:d kappa:d",
    f"""SELECT n, po AS accuracy, (po - pe) / (1 - pe) AS kappa FROM (SELECT count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END) AS po,
        avg(label) * avg(pred) + (1 - avg(label)) * (1 - avg(pred)) AS pe FROM {SCORED})""",
)
def _(t):
    return mt.confusion_report(scored(t))


@query(
    "a35_signal_error",
    "mse:d abs_error:d psnr:d",
    "SELECT mse, abs_error, 10 * log10(1 / mse) AS psnr FROM (SELECT avg((a.value - b.value) ** 2) AS mse, avg(abs(a.value - b.value)) AS abs_error FROM matrix a JOIN matrix_rev b USING (sample_id, position))",
)
def _(t):
    e = F.transform("embedding", lambda v: v.cast("double"))
    return mt.signal_error(t.embeddings.select(e.alias("a"), F.reverse(e).alias("b")), "a", "b")


HITS = "(SELECT vec_id % 50 AS query, vec_id // 50 + 1 AS rank, label % 3 = 0 AS hit FROM embeddings WHERE vec_id < 500)"


@query(
    "a42_topk_hits",
    "depth:l hits:l accuracy:d",
    f"SELECT depth, count(*) FILTER (f <= depth) AS hits, count(*) FILTER (f <= depth) / CAST(count(*) AS DOUBLE) AS accuracy FROM (SELECT query, min(rank) FILTER (hit) AS f FROM {HITS.replace(' WHERE vec_id < 500', '')} GROUP BY 1), (SELECT unnest(range(1, 6)) AS depth) GROUP BY 1",
)
def _(t):
    h = t.embeddings.select((F.col("vec_id") % 50).alias("query"), (F.floor(F.col("vec_id") / 50) + 1).alias("rank"), (F.col("label") % 3 == 0).alias("hit"))
    return mt.topk_hits(h, 5)


@query(
    "a43_retrieval_rank",
    "mean_rank:d top1:d top5:d",
    """SELECT avg(r) AS mean_rank, avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END) AS top1, avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END) AS top5 FROM (
         SELECT vec_id, 1 + len(list_filter(embedding, lambda s: s > embedding[vec_id % 64 + 1])) AS r FROM embeddings)""",
)
def _(t):
    return mt.retrieval_rank(t.embeddings.select(F.col("embedding").alias("scores"), (F.col("vec_id") % 64).alias("positive")))


@query(
    "a44_perplexity",
    "task:l loss:d avg_loss:d ppl:d adjusted_ppl:d token_ratio:d",
    """SELECT task, loss, loss / (n - 1) AS avg_loss, exp(least(20, loss / (n - 1))) AS ppl, exp(least(20, loss / (n - 1) * (n - 1) / (o - 1))) AS adjusted_ppl, (n - 1) / (o - 1) AS token_ratio FROM (
        SELECT l_suppkey % 4 AS task, sum(l_quantity / 10 * (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)) AS loss, CAST(4000 AS DOUBLE) AS n, CAST(5000 AS DOUBLE) AS o FROM lineitem GROUP BY 1)""",
)
def _(t):
    df = t.lineitem.select(
        (F.col("l_suppkey") % 4).alias("task"), (F.col("l_quantity") / 10).alias("loss_in"), (F.col("l_linestatus") == "F").cast("int").alias("mask"), F.lit(4000).alias("tokens"), F.lit(5000).alias("original_tokens")
    )
    return mt.perplexity(df, "loss_in", "mask", by="task")


@query(
    "a45_cloze_accuracy",
    "samples:l accuracy:d",
    "SELECT count(*) AS samples, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS accuracy FROM (SELECT l_orderkey, coalesce(bool_and(l_discount > 0.03) FILTER (l_linestatus = 'F'), TRUE) AS ok FROM lineitem GROUP BY 1)",
)
def _(t):
    df = t.lineitem.select("l_orderkey", (F.col("l_discount") > 0.03).alias("ok"), (F.col("l_linestatus") == "F").alias("scored"))
    return mt.cloze_accuracy(df, "l_orderkey", "ok", "scored")


@query(
    "a46_ensemble_threshold",
    "threshold:d accuracy:d",
    f"""SELECT t AS threshold, acc AS accuracy FROM (SELECT k, k / 100.0 AS t, avg(CASE WHEN (s >= k) = (label = 1) THEN 1.0 ELSE 0 END) AS acc FROM (SELECT label, least(1999, n_chars) // 20 AS s FROM {SCORED}), (SELECT unnest(range(0, 100)) AS k) GROUP BY 1)
        ORDER BY acc DESC, k LIMIT 1""",
)
def _(t):
    return mt.ensemble_threshold(scored(t).withColumn("s", F.least(F.lit(1999), F.col("n_chars")) / 2000.0), "s", "label")


@query(
    "a48_rank_time_report",
    "event_type:s min_time:d min_rank:l max_time:d max_rank:l top_ranks:al bottom_ranks:al",
    """WITH per AS (SELECT event_type, user_id % 8 AS rank, sum(value) AS time, count(*) AS calls FROM events GROUP BY 1, 2),
       k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY calls / time DESC, rank) AS hi, row_number() OVER (PARTITION BY event_type ORDER BY calls / time, rank) AS lo FROM per)
       SELECT event_type, min(time) AS min_time, arg_min(rank, time) AS min_rank, max(time) AS max_time, arg_max(rank, time) AS max_rank, list(rank ORDER BY hi) FILTER (hi <= 2) AS top_ranks, list(rank ORDER BY lo) FILTER (lo <= 2) AS bottom_ranks FROM k GROUP BY 1""",
)
def _(t):
    return mt.rank_time_report(t.events.withColumn("rank", F.col("user_id") % 8), "event_type", "rank", "value")


LAYERS = "(SELECT l_suppkey AS task, l_linenumber AS layer, avg(l_discount) AS acc, avg(l_tax) AS f1 FROM lineitem GROUP BY 1, 2)"


def layers(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("task"), F.col("l_linenumber").alias("layer")).agg(F.round(F.avg("l_discount"), 9).alias("acc"), F.round(F.avg("l_tax"), 9).alias("f1"))


@query(
    "a49_best_layer",
    "task:l layer:l acc:d f1:d",
    f"SELECT task, layer, acc, f1 FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(acc, 9) DESC, layer) AS k FROM {LAYERS}) WHERE k = 1",
)
def _(t):
    return mt.best_layer(layers(t), "acc")


@query("a49_last_layer", "task:l layer:l acc:d", f"SELECT task, layer, acc FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY layer DESC) AS k FROM {LAYERS}) WHERE k = 1")
def _(t):
    return mt.last_layer(layers(t))


@query(
    "a49_best_per_metric",
    "task:l acc:d acc_layer:l f1:d f1_layer:l",
    f"SELECT task, max(acc) AS acc, arg_max(layer, (round(acc, 9), -layer)) AS acc_layer, max(f1) AS f1, arg_max(layer, (round(f1, 9), -layer)) AS f1_layer FROM {LAYERS} GROUP BY 1",
)
def _(t):
    return mt.best_per_metric(layers(t), ["acc", "f1"])


@query(
    "a50_dataset_profile",
    "dataset:s split:l label:l rows:l min_length:l max_length:l share:d",
    """SELECT lang AS dataset, doc_id % 3 AS split, quality AS label, count(*) AS rows, min(n_chars) AS min_length, max(n_chars) AS max_length, count(*) / CAST(sum(count(*)) OVER (PARTITION BY lang) AS DOUBLE) AS share
       FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3""",
)
def _(t):
    d = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("dataset"), (F.col("doc_id") % 3).alias("split"), F.col("n_chars").alias("length"), F.col("quality").alias("label"))
    return mt.dataset_profile(d)


@query(
    "a50_profile_mismatches",
    "dataset:s split:l label:l found:l declared:l",
    """WITH f AS (SELECT lang AS dataset, doc_id % 3 AS split, quality AS label, count(*) AS found FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3)
       SELECT dataset, split, label, found, found + 1 AS declared FROM f WHERE split = 1""",
)
def _(t):
    d = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("dataset"), (F.col("doc_id") % 3).alias("split"), F.col("n_chars").alias("length"), F.col("quality").alias("label"))
    profile = mt.dataset_profile(d)
    declared = profile.select("dataset", "split", "label", F.when(F.col("split") == 1, F.col("rows") + 1).otherwise(F.col("rows")).alias("rows"))
    return mt.profile_mismatches(profile, declared)
