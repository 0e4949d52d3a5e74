"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of their docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm import bpe, decontam, jaccard, linededup, toxicity
from seedloom.llm.common import keep, table


ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each (doc_id, text) in ``_row``: rows are judged by it, with an id or without."""
    return docs.withColumn(ROW, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (score of a half or more).

    Null and empty texts have the score of a text without any word and stay unless most labelled
    rows are toxic; rows that share an id are judged one by one. An empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, to="_toxicity").filter("_toxicity < 0.5").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in one; n_chars follows the text."""
    cut = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Texts are compared, not ids: rows without an id are in groups like any other and stay only where no
    row with an id does, and of rows that share an id each text is judged for itself. Rows that agree in id and
    text stay or go together. Texts without a word (null, empty) are copies of each other.
    """
    rows = numbered(docs)
    joined = jaccard.similarity_join(rows.select(ROW, "text"), doc_id=ROW).select(F.col("doc_id").alias(ROW), "class_id")
    ids = joined.distinct().join(rows.select(ROW, "doc_id").distinct(), ROW)
    first = ids.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first"))
    return rows.join(first.select(f"first.{ROW}"), ROW, "left_semi").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a passage of the benchmark go, with an id or without.

    Clean rows that share the id of one that goes stay. Null and empty texts hold nothing.
    """
    rows = numbered(docs)
    found = decontam.leaked_items(rows.select(ROW, "text"), table(spark, sf_dir, "benchmark"), doc_id=ROW)
    return rows.join(found.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row that is left; a null text is encoded as empty."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

# A classifier and a random-walk search have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
