"""Readers and writers of tables: phenotypes, labelled sets, predictions, indices, metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.functions.text import array_from_json
from seedloom.operators.base import as_list, standardize_id


def read_table_loose(spark: SparkSession, path: str) -> DataFrame:
    """Phenotype table whose fields are parted by white space or commas; the id column is SampleID."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    head = lines.first()
    if head is None:
        raise ValueError("empty table")
    import re

    names = [n for n in re.split(r"[\s,]+", head[0].strip()) if n]
    f = F.split(F.trim("value"), r"[\s,]+")
    rows = lines.filter(F.col("value") != head[0]).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return standardize_id(rows)


def read_labelled_jsonl(spark: SparkSession, path: str, seq_key: str = "sequence", label_key: str = "label", n_seq: int | None = None) -> DataFrame:
    """(sequences ARRAY<STRING>, label ARRAY<DOUBLE>) from JSON lines.

    With one sequence the key is ``seq_key``, else ``seq_key`` plus 1..n; n is counted from
    the keys of the first line when not given. A missing key is an error.
    """
    lines = spark.read.text(path).filter("trim(value) <> ''")
    if n_seq is None:
        keys = lines.select(F.json_object_keys("value").alias("k")).first()
        n_seq = max(1, len([k for k in (keys[0] if keys else []) if k.startswith("seq")]))
    names = [seq_key] if n_seq == 1 else [f"{seq_key}{i}" for i in range(1, n_seq + 1)]
    need = lambda k: F.coalesce(F.get_json_object("value", f"$.{k}"), F.raise_error(F.concat(F.lit(f"missing {k} in "), F.substring("value", 1, 80))).cast("string"))
    raw = need(label_key)
    label = F.when(raw.startswith("["), F.from_json(raw, "array<double>")).otherwise(F.array(raw.try_cast("double")))
    return lines.select(F.array(*[need(n) for n in names]).alias("sequences"), label.alias("label"))


def read_predictions(spark: SparkSession, path: str, arrays=("predicted_expression", "true_expression")) -> DataFrame:
    """Prediction CSV with array columns written as JSON text."""
    out = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    for c in as_list(arrays):
        if c in out.columns:
            out = out.withColumn(c, array_from_json(c))
    for c in ("start", "end"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("long"))
    return out


def prediction_rows(df: DataFrame, by=("biosample", "modality"), window=("chromosome", "start", "end")) -> DataFrame:
    """One row per window of each (biosample, modality)."""
    return df.dropDuplicates(as_list(by) + as_list(window))


def write_predictions(df: DataFrame, path: str, by=("biosample", "modality"), window=("chromosome", "start", "end")) -> None:
    """De-duplicated windows, one folder per (biosample, modality), in genome order inside files.

    Range partitions keep a large modality in several files.
    """
    rows = prediction_rows(df, by, window)
    order = as_list(by) + as_list(window)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*as_list(by)).parquet(path)


def write_index(df: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """Window index as fully quoted CSV, and its statistics as one JSON row beside it."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{path}/index")
    if stats is not None:
        stats.select(F.to_json(F.struct(*stats.columns)).alias("value")).write.mode("overwrite").text(f"{path}/statistics")


def read_metric_files(spark: SparkSession, path: str) -> DataFrame:
    """(split, sample, checkpoint, metric, value) from ``key: value`` files in
    ``split/sample.checkpoint-N/``."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).withColumn("_f", F.input_file_name())
    where = r"/([^/]+)/([^/]+)\.checkpoint-(\d+)/[^/]*$"
    pair = r"^\s*([^:]+?)\s*:\s*(\S+)\s*$"
    out = lines.filter(F.col("value").rlike(pair)).select(
        F.regexp_extract("_f", where, 1).alias("split"), F.regexp_extract("_f", where, 2).alias("sample"),
        F.regexp_extract("_f", where, 3).try_cast("long").alias("checkpoint"),
        F.regexp_extract("value", pair, 1).alias("metric"), F.regexp_extract("value", pair, 2).try_cast("double").alias("value"),
    )
    return out.filter("split <> ''")


def widen_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.groupBy("split", "sample", "checkpoint").pivot("metric", metrics).agg(F.first("value"))
