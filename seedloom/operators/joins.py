"""Joins between samples, directions, predictions, passages and topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.operators.base import as_list, ratio, small_side


def join_samples(pheno: DataFrame, samples: DataFrame, on: str) -> DataFrame:
    """Phenotypes of the samples at hand; an error when nothing matches."""
    out = pheno.join(samples, on)
    if not out.limit(1).count():
        raise ValueError(f"no common {on}")
    return out


def samples_in_all_blocks(matrix: DataFrame, blocks: list, block: str = "block", key: str = "sample_id") -> DataFrame:
    """Rows of the samples that have every wanted block."""
    wanted = matrix.filter(F.col(block).isin(*blocks))
    full = wanted.select(key, block).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return wanted.join(full.filter(F.col("_n") == len(set(blocks))).select(key), key, "left_semi")


def sum_directions(fwd: DataFrame, rev: DataFrame, on=("sample_id", "position"), value: str = "value") -> DataFrame:
    on = as_list(on)
    r = rev.select(*on, F.col(value).alias("_rev"))
    return fwd.join(r, on).withColumn(value, F.col(value) + F.col("_rev")).drop("_rev")


def combine_direction_tables(tables: dict[str, DataFrame], keys) -> DataFrame:
    """Full outer join of one table per direction; other columns get the direction as suffix."""
    keys = as_list(keys)
    named = [df.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c not in keys]) for tag, df in tables.items()]
    return reduce(lambda a, b: a.join(b, keys, "full"), named)


def attach_rank(pvals: DataFrame, ranks: DataFrame, key: str, rank: str = "mean_rank") -> DataFrame:
    return pvals.join(ranks.select(key, rank), key, "left").orderBy(F.col(rank).asc_nulls_last(), key)


def pair_prediction(pred: DataFrame, truth: DataFrame, on=("chrom", "pos")) -> DataFrame:
    """Predicted and true value per position; truth beyond the prediction is cut."""
    return pred.join(truth, as_list(on))


def ensemble_join(scores: dict[str, DataFrame], keys=("dataset", "uid"), cols=("scores",)) -> DataFrame:
    """Sum of class scores over models; each model must score the same ids."""
    keys = as_list(keys)
    cols = as_list(cols)
    if len(scores) < 1:
        raise ValueError("no models")
    parts = [df.select(*keys, *cols).withColumn("_model", F.lit(m)) for m, df in scores.items()]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    # two-step: repeated ids inside a model do not stand in for a missing model
    per = both.groupBy(*keys, "_model").agg(*[F.sum(c).alias(c) for c in cols])
    out = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("_n"))
    miss = F.raise_error(F.lit("models do not score the same ids"))
    first = F.when(F.col("_n") != len(scores), miss.cast("double")).otherwise(F.col(cols[0]))
    return out.withColumn(cols[0], first).drop("_n")


def zip_by_line(a: DataFrame, b: DataFrame, line_no: str = "line_no") -> DataFrame:
    """Line n of one text with line n of the other; both carry their line number."""
    return a.join(b, line_no)


def split_by_topic(train: DataFrame, test: DataFrame, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """Training rows whose topic the test set has, and the rest."""
    seen = test.select(topic).distinct()
    return train.join(seen, topic, "left_semi"), train.join(seen, topic, "left_anti")


def lookup_passages(hits: DataFrame, passages: DataFrame, key: str = "passage_id") -> DataFrame:
    """Text and title of retrieved ids; a missing or empty text is a miss."""
    out = hits.join(passages, key, "left")
    return out.withColumn("missing", F.col("text").isNull() | (F.trim("text") == ""))


def recall_precision(true_ids: DataFrame, pred_ids: DataFrame, key: str = "gene_id") -> DataFrame:
    """Recall and precision of a predicted id set; an empty set is an error."""
    t = true_ids.select(key).distinct().withColumn("_t", F.lit(1))
    p = pred_ids.select(key).distinct().withColumn("_p", F.lit(1))
    n = t.join(p, key, "full").agg(
        F.count("_t").alias("n_true"), F.count("_p").alias("n_pred"), F.count(F.when(F.col("_t") == F.col("_p"), 1)).alias("common")
    )
    empty = (F.col("n_true") == 0) | (F.col("n_pred") == 0)
    n = n.withColumn("common", F.when(empty, F.raise_error(F.lit("empty id set")).cast("long")).otherwise(F.col("common")))
    return n.withColumn("recall", ratio(F.col("common"), F.col("n_true"))).withColumn("precision", ratio(F.col("common"), F.col("n_pred")))
