"""How the given tables stand in for genome files: Spark frames and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.operators.base import dealt
from seedloom.sources.matrix import matrix_from_arrays

# ---- SQL views -------------------------------------------------------------------------

VIEWS = {
    "signal": """
        SELECT l_suppkey % 4 AS track, l_returnflag AS chrom,
               (l_orderkey * 10 + l_linenumber) * 64 AS start,
               (l_orderkey * 10 + l_linenumber) * 64 + max(CAST(l_quantity AS INTEGER)) AS "end",
               max(l_discount) AS value
        FROM lineitem GROUP BY 1, 2, 3""",
    "seqs": "SELECT doc_id AS seqid, source AS file_name, text AS bases, n_chars AS len FROM documents",
    "matrix": """
        SELECT vec_id AS sample_id, i AS position, CAST(embedding[i] AS DOUBLE) + 1.0 AS value,
               label % 2 AS grp
        FROM embeddings, range(1, 65) r(i)""",
    "matrix_rev": """
        SELECT vec_id AS sample_id, i AS position, CAST(embedding[65 - i] AS DOUBLE) + 1.0 AS value,
               label % 2 AS grp
        FROM embeddings, range(1, 65) r(i)""",
    "genes": """
        SELECT p_partkey AS gene_id,
               CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom,
               p_partkey * 4800 AS start, p_partkey * 4800 + p_size * 400 AS "end",
               p_name AS label, p_retailprice AS metric
        FROM part""",
    "span_genes": """
        SELECT p_partkey AS gene_id, p_partkey % 60 + 1 AS start,
               p_partkey % 60 + 1 + p_size % 5 AS "end"
        FROM part""",
    "preds": """
        SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS track, l_returnflag AS chrom,
               l_discount AS truth, l_tax AS pred FROM lineitem""",
    "windowed": """
        SELECT l_suppkey % 4 AS track, l_returnflag AS chrom, l_orderkey AS window_id,
               l_discount AS truth, l_tax AS pred FROM lineitem""",
    "pvals": """
        SELECT DISTINCT l_suppkey % 4 AS family, l_partkey AS position,
               (l_partkey % 1000 + 1) / 1001.0 AS p FROM lineitem""",
    "meta": """
        SELECT o_orderkey AS track_index, o_orderpriority AS assay, o_orderstatus AS strand,
               o_custkey % 10 AS biosample, o_totalprice AS nonzero_mean FROM orders""",
    "flat_tokens": """
        SELECT doc_id, pos, total, tok, unnest(CASE WHEN pos % 512 = 0 AND pos > 0 THEN [pos // 512 - 1, pos // 512] ELSE [pos // 512] END) AS sid
        FROM (SELECT doc_id, tok, before + i - 1 AS pos, total FROM (
          SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS i, before, total FROM (
            SELECT doc_id, toks, sum(len(toks)) OVER (ORDER BY doc_id) - len(toks) AS before, sum(len(toks)) OVER () AS total FROM tokens)),
          LATERAL (SELECT length(w) AS tok))""",
    "tokens": "SELECT doc_id, source, string_split(text, ' ') AS toks FROM documents",
}

# ---- Spark frames ----------------------------------------------------------------------


def _signal(t):
    li = t.lineitem
    at = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 64
    rows = li.select(
        (F.col("l_suppkey") % 4).alias("track"),
        F.col("l_returnflag").alias("chrom"),
        at.alias("start"),
        F.col("l_quantity").cast("int").alias("_len"),
        F.col("l_discount").alias("value"),
    )
    return (
        dealt(rows, li.count(), "track", "chrom", "start")
        .groupBy("track", "chrom", "start")
        .agg(F.max("_len").alias("_len"), F.max("value").alias("value"))
        .select("track", "chrom", "start", (F.col("start") + F.col("_len")).alias("end"), "value")
    )


def _seqs(t):
    return t.documents.select(
        F.col("doc_id").alias("seqid"),
        F.col("source").alias("file_name"),
        F.col("text").alias("bases"),
        F.col("n_chars").alias("len"),
    )


def _matrix(t, reverse=False):
    arr = F.col("embedding")
    arr = F.reverse(arr) if reverse else arr
    src = t.embeddings.select(
        F.col("vec_id").alias("sample_id"), arr.alias("values"), (F.col("label") % 2).alias("grp")
    )
    long = matrix_from_arrays(src, "values", keep=["sample_id", "grp"])
    return long.select("sample_id", "position", (F.col("value").cast("double") + 1.0).alias("value"), "grp")


def _genes(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("gene_id"),
        F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R").alias("chrom"),
        (k * 4800).alias("start"),
        (k * 4800 + F.col("p_size") * 400).alias("end"),
        F.col("p_name").alias("label"),
        F.col("p_retailprice").alias("metric"),
    )


def _span_genes(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("gene_id"), (k % 60 + 1).alias("start"), (k % 60 + 1 + F.col("p_size") % 5).alias("end")
    )


def _preds(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_suppkey") % 4).alias("track"),
        F.col("l_returnflag").alias("chrom"),
        F.col("l_discount").alias("truth"),
        F.col("l_tax").alias("pred"),
    )


def _windowed(t):
    return _preds(t).select("track", "chrom", F.col("l_orderkey").alias("window_id"), "truth", "pred")


def _pvals(t):
    return t.lineitem.select(
        (F.col("l_suppkey") % 4).alias("family"),
        F.col("l_partkey").alias("position"),
        ((F.col("l_partkey") % 1000 + 1) / F.lit(1001.0)).alias("p"),
    ).distinct()


def _meta(t):
    return t.orders.select(
        F.col("o_orderkey").alias("track_index"),
        F.col("o_orderpriority").alias("assay"),
        F.col("o_orderstatus").alias("strand"),
        (F.col("o_custkey") % 10).alias("biosample"),
        F.col("o_totalprice").alias("nonzero_mean"),
    )


def _tokens(t):
    return t.documents.select("doc_id", "source", F.split("text", " ").alias("toks"))


FRAMES = {
    "signal": _signal,
    "seqs": _seqs,
    "matrix": _matrix,
    "matrix_rev": lambda t: _matrix(t, reverse=True),
    "genes": _genes,
    "span_genes": _span_genes,
    "preds": _preds,
    "windowed": _windowed,
    "pvals": _pvals,
    "meta": _meta,
    "tokens": _tokens,
}
