"""Row selection over metadata, labels, texts and windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.spans import grounded_count
from seedloom.operators.base import as_list, attach_row, seeded_key, seeded_unit, small_side
from seedloom.operators.ordered import ordered_scan, row_index


def filter_metadata(meta: DataFrame, output_types, assays=None, biosamples=None) -> DataFrame:
    """Tracks of the wanted kinds; RNA rows without a strand are left out; accession counts first."""
    out = meta.filter(F.col("output_type").isin(*output_types))
    if assays:
        out = out.filter(F.col("assay").isin(*assays))
    if biosamples:
        out = out.filter(F.col("biosample").isin(*biosamples))
    out = out.filter(~((F.col("output_type") == "RNA_SEQ") & (F.col("strand") == ".")))
    n = F.size(F.filter(F.split("accession", ","), lambda a: F.trim(a) != ""))
    return out.select(n.alias("num_file_accession"), *meta.columns)


def select_tracks(meta: DataFrame, ids: DataFrame, **equals) -> DataFrame:
    """Tracks whose index is in ``ids`` and whose columns equal the given values."""
    out = meta.join(small_side(ids.select("track_index").distinct()), "track_index", "left_semi")
    for col, value in equals.items():
        out = out.filter(F.col(col) == value)
    return out


def track_metadata_rows(samples: DataFrame, means: DataFrame) -> DataFrame:
    """One row per (sample, tissue, track number) with the mean measured for that track."""
    rows = samples.select("sample", F.posexplode("tissues").alias("_i", "tissue"))
    rows = rows.withColumn("track_index", F.col("_i") + 1).drop("_i")
    return rows.join(means, ["sample", "tissue"], "left")


def encode_group(meta: DataFrame, label: str, key: str = "sample_id") -> DataFrame:
    """control when the numeric label is zero, else case; a sample with two groups is an error."""
    named = meta.withColumn("group", F.when(F.col(label).try_cast("double") == 0.0, "control").otherwise("case"))
    per = named.filter(F.col(label).isNotNull()).groupBy(key).agg(
        F.min("group").alias("group"), F.max("group").alias("_other")
    )
    clash = F.raise_error(F.concat(F.lit("conflicting groups for sample "), F.col(key).cast("string")))
    return per.select(key, F.when(F.col("group") != F.col("_other"), clash.cast("string")).otherwise(F.col("group")).alias("group"))


def sample_limit(df: DataFrame, n: int, seed: int, key: str, order: str | None = None) -> DataFrame:
    """At most n rows, drawn by key hash; the original order is the caller's ``order`` column."""
    picked = df.withColumn("_h", seeded_key(seed, key)).orderBy("_h", key).limit(n).drop("_h")
    return picked.orderBy(order or key)


def choose_label(cols: list[str], prefix: str | None = None) -> Column:
    """First non-empty of the columns; a value with the preferred prefix goes first."""
    filled = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in cols]
    if prefix:
        return F.coalesce(*[F.when(f.startswith(prefix), f) for f in filled], *filled)
    return F.coalesce(*filled)


def keep_least_toxic_half(df: DataFrame, score: str, seed: int, key: str) -> DataFrame:
    """The half of all lines with the lowest scores (null scores never kept), shuffled."""
    n = df.agg((F.count(F.lit(1)) / 2).cast("long").alias("_keep"))
    ranked = ordered_scan(df.filter(F.col(score).isNotNull()), None, [score, key], _rank=row_index())
    kept = attach_row(ranked, n).filter(F.col("_rank") <= F.col("_keep")).drop("_rank", "_keep")
    return kept.withColumn("_h", seeded_key(seed, key)).orderBy("_h", key).drop("_h")


def filter_knowledge_examples(df: DataFrame, seen: bool = True, topics: bool = True) -> DataFrame:
    """Dialogue rows whose knowledge can serve as a prompt example.

    Rows without a passage go. Outside the seen set, bracketed knowledge and knowledge that
    does not name its topic go; for unseen topics also knowledge over 20 words or starting
    with It / This.
    """
    out = df.filter(F.col("knowledge") != "no_passages_used")
    if seen:
        return out
    out = out.filter(~F.col("knowledge").contains("(") & F.col("knowledge").contains(F.col("topic")))
    if topics:
        words = F.size(F.split(F.trim("knowledge"), r"\s+"))
        out = out.filter((words <= 20) & ~F.col("knowledge").rlike(r"^(It|This)\b"))
    return out


def grounded_tokens(min_run: int = 10, text: str = "response_tokens", source: str = "knowledge_tokens") -> Column:
    """Number of response tokens that sit in runs of at least ``min_run`` tokens of the knowledge."""
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([grounded_count(x, y, min_run) for x, y in zip(a, b)], dtype="int64")

    return F.pandas_udf(count, "long")(F.col(text), F.col(source))


def filter_grounded_responses(df: DataFrame, min_run: int = 10, lo: float = 0.6, hi: float = 0.9, know: float = 0.8) -> DataFrame:
    """Responses of which lo..hi is quoted from the knowledge, quoting at least ``know`` of it."""
    kept = df.withColumn("_q", grounded_tokens(min_run))
    r = F.col("_q") / F.size("response_tokens")
    k = F.col("_q") / F.size("knowledge_tokens")
    full = (F.size("response_tokens") > 0) & (F.size("knowledge_tokens") > 0)
    return kept.filter(full & (r >= lo) & (r <= hi) & (k >= know)).drop("_q")


def subsample(df: DataFrame, rate: float, seed: int, *key: str) -> DataFrame:
    """A uniform subset that depends only on the keys."""
    return df.filter(seeded_unit(seed, *key) < F.lit(rate))


def limit_per_class(df: DataFrame, cls: str, order: str, class_frac: float, row_frac: float) -> DataFrame:
    """The first share of the classes (in name order) and of the rows within each."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_scan(counts, None, cls, _c=row_index(), _rest=row_index(reverse=True))
    total = F.col("_c") + F.col("_rest") - 1
    keep = ranked.filter(F.col("_c") <= F.greatest(F.lit(1), F.floor(total * F.lit(class_frac)))).select(cls, "_n")
    rows = ordered_scan(df, cls, order, _k=row_index()).join(small_side(keep), cls)
    return rows.filter(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(row_frac)))).drop("_k", "_n")


def filter_chrom_token(df: DataFrame, col: str, names, to: str = "chrom_token") -> DataFrame:
    return df.withColumn(to, F.regexp_extract(col, r"(Chr\d+)", 1)).filter(F.col(to).isin(*as_list(names)))


def check_contigs(regions: DataFrame, seqs: DataFrame, name: str = "chrom", ref: str = "seqid") -> DataFrame:
    """Region names that the reference has under none of the spellings N, chrN, ChrN."""
    known = seqs.select(F.regexp_replace(F.col(ref).cast("string"), r"^(chr|Chr)", "").alias("_bare")).distinct()
    asked = regions.select(name).distinct()
    asked = asked.withColumn("_bare", F.regexp_replace(F.col(name).cast("string"), r"^(chr|Chr)", ""))
    return asked.join(known, "_bare", "left_anti").select(name)
