from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.functions.names import safe_name
from seedloom.operators import genes as gn
from seedloom.operators import joins as jn
from seedloom.operators import stats as st
from seedloom.operators.filters import choose_label
from seedloom.plans.catalog.signals import METRIC_COLS, bh_sql, metrics_sql, rank_test_sql
from seedloom.plans.registry import query

OVERLAP = """SELECT g.gene_id, sum(s.value * (least(g."end", s."end") - greatest(g.start, s.start))) AS sv, sum(least(g."end", s."end") - greatest(g.start, s.start)) AS sw
    FROM genes g JOIN signal s ON g.chrom = s.chrom AND s.start < g."end" AND s."end" > g.start GROUP BY 1"""


@query("a09_gene_signal_mean", "gene_id:l mean_signal:d", f"SELECT g.gene_id, sv / sw AS mean_signal FROM genes g LEFT JOIN ({OVERLAP}) o USING (gene_id)")
def _(t):
    return gn.gene_signal_mean(t.genes, t.signal)


@query("j06_gene_signal_join_dense", "gene_id:l mean_signal:d", f"""SELECT g.gene_id, CASE WHEN "end" > start THEN coalesce(sv, 0) / ("end" - start) END AS mean_signal FROM genes g LEFT JOIN ({OVERLAP}) o USING (gene_id)""")
def _(t):
    return gn.gene_signal_mean(t.genes, t.signal, dense=True)


LOCI = '(SELECT DISTINCT start * 100 + "end" AS gene_id, start, "end" FROM span_genes)'
HITS = f"(SELECT l.gene_id, p.position, p.value FROM {LOCI} l JOIN (SELECT position, avg(value) AS value FROM matrix GROUP BY 1) p ON p.position BETWEEN greatest(1, l.start - 3) AND l.\"end\" + 3)"


def loci(t):
    return t.span_genes.select((F.col("start") * 100 + F.col("end")).alias("gene_id"), "start", "end").distinct()


@query("a12_gene_metrics", "gene_id:l covered_positions:l " + METRIC_COLS[4:], f"SELECT n AS covered_positions, * FROM ({metrics_sql(HITS, 'gene_id')})")
def _(t):
    return gn.gene_metrics(t.matrix, loci(t), 3)


SAMPLE_HITS = f"(SELECT l.gene_id, m.sample_id, any_value(m.grp) AS grp, avg(m.value) AS value FROM {LOCI} l JOIN matrix m ON m.position BETWEEN l.start AND l.\"end\" GROUP BY 1, 2)"


@query(
    "a13_gene_pvalues",
    "gene_id:l n_a:l n_b:l mean_a:d mean_b:d pvalue:d padj:d significant:b",
    f"SELECT *, padj <= 0.05 AS significant FROM ({bh_sql(rank_test_sql(SAMPLE_HITS, 'gene_id'), 'gene_id')})",
)
def _(t):
    return gn.gene_pvalues(t.matrix, loci(t), metrics=("mean",)).filter("metric = 'mean'")


@query("a18_ols_association", "position:l beta:d pval:d")
def _(t):
    pheno = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("double").alias("y"))
    return gn.ols_association(t.matrix, pheno, "y", 3, method="covariance")


@query(
    "a18_ols_association_unadjusted",
    "position:l beta:d t:d",
    """SELECT position, b AS beta, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS t FROM (
         SELECT position, regr_slope(label, value) AS b, regr_sxx(label, value) AS sxx, regr_syy(label, value) AS syy, regr_sxy(label, value) AS sxy, count(*) AS n
         FROM matrix JOIN embeddings ON vec_id = sample_id GROUP BY 1)""",
)
def _(t):
    pheno = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("double").alias("y"))
    return gn.ols_association(t.matrix, pheno, "y", 0)


@query("a19_sample_pcs", "sample_id:l norm:d")
def _(t):
    out = gn.sample_pcs(t.matrix, 3, "covariance")
    return out.withColumn("norm", F.sqrt(F.aggregate("pcs", F.lit(0.0), lambda a, v: a + v * v)))


@query(
    "a21_peak_position",
    "sample_id:l peak_position:l peak_value:d",
    """SELECT sample_id, arg_max(position, (value, -d, -position)) AS peak_position, max(value) AS peak_value
       FROM (SELECT *, 0 AS d FROM matrix UNION ALL SELECT *, 1 FROM matrix_rev) GROUP BY 1""",
)
def _(t):
    both = t.matrix.withColumn("ord", F.lit(0)).unionByName(t.matrix_rev.withColumn("ord", F.lit(1)))
    return gn.peak_position(both, by="sample_id")


@query(
    "f01_rank_desc",
    "gene_id:l metric_rank:l size_rank:l mean_rank:d",
    """SELECT *, (metric_rank + size_rank) / 2.0 AS mean_rank FROM (SELECT gene_id, rank() OVER (PARTITION BY chrom ORDER BY metric DESC) AS metric_rank,
       rank() OVER (PARTITION BY chrom ORDER BY "end" - start DESC) AS size_rank FROM genes)""",
)
def _(t):
    g = t.genes.withColumn("size", (F.col("end") - F.col("start")).cast("double"))
    return st.rank_desc(g, ["metric", "size"], "gene_id", "chrom")


@query("f10_alternate_lane", "gene_id:l lane:l", "SELECT gene_id, (row_number() OVER (PARTITION BY chrom ORDER BY start, gene_id) - 1) % 2 AS lane FROM genes")
def _(t):
    return gn.alternate_lane(t.genes, "chrom")


@query(
    "j01_join_samples",
    "doc_id:l quality:l n_chars:l",
    "SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)",
)
def _(t):
    return jn.join_samples(t.labels, t.documents.select("doc_id", "n_chars"), "doc_id")


@query(
    "j02_samples_in_all_blocks",
    "sample_id:l position:l",
    """SELECT sample_id, position FROM (SELECT *, count(DISTINCT position // 16) OVER (PARTITION BY sample_id) AS nb FROM matrix WHERE value > 0.75 AND position // 16 < 4) WHERE nb = 4""",
)
def _(t):
    m = t.matrix.filter("value > 0.75").withColumn("block", F.floor(F.col("position") / 16))
    return jn.samples_in_all_blocks(m, [0, 1, 2, 3])


@query(
    "j03_sum_directions",
    "sample_id:l position:l value:d",
    "SELECT a.sample_id, a.position, a.value + b.value AS value FROM matrix a JOIN matrix_rev b USING (sample_id, position) WHERE b.value > 1",
)
def _(t):
    return jn.sum_directions(t.matrix, t.matrix_rev.filter("value > 1"))


@query(
    "j04_combine_direction_tables",
    "chrom:s size:l n_fwd:n n_rev:n",
    """SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.size, b.size) AS size, a.n AS n_fwd, b.n AS n_rev FROM
       (SELECT chrom, ("end" - start) // 400 AS size, count(*) AS n FROM genes WHERE gene_id % 2 = 0 GROUP BY 1, 2) a FULL JOIN
       (SELECT chrom, ("end" - start) // 400 AS size, count(*) AS n FROM genes WHERE metric > 910 GROUP BY 1, 2) b ON a.chrom = b.chrom AND a.size = b.size""",
)
def _(t):
    g = t.genes.withColumn("size", F.floor((F.col("end") - F.col("start")) / 400))
    one = lambda df: df.groupBy("chrom", "size").agg(F.count(F.lit(1)).alias("n"))
    return jn.combine_direction_tables({"fwd": one(g.filter("gene_id % 2 = 0")), "rev": one(g.filter("metric > 910"))}, ["chrom", "size"])


@query(
    "j05_attach_rank",
    "gene_id:l metric:d mean_rank:n",
    "SELECT gene_id, metric, CASE WHEN gene_id % 3 = 0 THEN rank() OVER (PARTITION BY gene_id % 3 ORDER BY metric DESC) END AS mean_rank FROM genes",
)
def _(t):
    ranks = st.min_rank_desc(t.genes.filter("gene_id % 3 = 0"), "metric", None, "mean_rank")
    return jn.attach_rank(t.genes.select("gene_id", "metric"), ranks, "gene_id")


@query(
    "j07_pair_prediction",
    "pair:l chrom:s pos:l pred:d truth:d",
    """WITH m AS (SELECT track, chrom, start AS pos, max(value) AS value FROM signal GROUP BY 1, 2, 3)
       SELECT a.track // 2 AS pair, chrom, pos, a.value AS pred, b.value AS truth FROM m a JOIN m b USING (chrom, pos) WHERE a.track % 2 = 0 AND b.track = a.track + 1""",
)
def _(t):
    peaks = t.signal.groupBy((F.col("track") / 2).cast("long").alias("pair"), "chrom", F.col("start").alias("pos"), (F.col("track") % 2).alias("side")).agg(F.max("value").alias("value"))
    one = lambda k, n: peaks.filter(F.col("side") == k).select("pair", "chrom", "pos", F.col("value").alias(n))
    return jn.pair_prediction(one(0, "pred"), one(1, "truth"), on=("pair", "chrom", "pos"))


@query(
    "j16_recall_precision",
    "n_true:l n_pred:l common:l recall:d precision:d",
    """SELECT n_true, n_pred, common, common / n_true AS recall, common / n_pred AS precision FROM (SELECT
       count(*) FILTER (gene_id % 3 = 0) AS n_true, count(*) FILTER (gene_id % 2 = 0) AS n_pred, CAST(count(*) FILTER (gene_id % 6 = 0) AS DOUBLE) AS common FROM genes)""",
)
def _(t):
    return jn.recall_precision(t.genes.filter("gene_id % 3 = 0"), t.genes.filter("gene_id % 2 = 0"))


@query("p06_choose_label", "gene_id:l label:s", "SELECT p_partkey AS gene_id, CASE WHEN p_type LIKE 'ECO%' THEN p_type WHEN p_brand LIKE 'ECO%' THEN p_brand ELSE p_brand END AS label FROM part")
def _(t):
    df = t.part.select(F.col("p_partkey").alias("gene_id"), F.lit("").alias("alias"), "p_brand", "p_type")
    return df.withColumn("label", choose_label(["alias", "p_brand", "p_type"], "ECO"))


@query(
    "t01_top_by_abs",
    "label:s metric:d",
    "SELECT label, avg(metric) AS metric FROM (SELECT label, gene_id, metric FROM genes ORDER BY abs(metric - 950) DESC, gene_id LIMIT 50) GROUP BY 1",
)
def _(t):
    g = t.genes.withColumn("d", F.col("metric") - 950).orderBy("gene_id")
    top = g.orderBy(F.abs("d").desc(), "gene_id").limit(50)
    return gn.top_by_abs(top, "d", 50, "label", "metric")


@query(
    "t02_top_per_group",
    "chrom:s gene_id:l score:d place:l",
    "SELECT * FROM (SELECT chrom, gene_id, -log10((gene_id % 1000 + 1) / 1001.0) AS score, row_number() OVER (PARTITION BY chrom ORDER BY (gene_id % 1000 + 1) / 1001.0, gene_id) AS place FROM genes) WHERE place <= 10",
)
def _(t):
    from seedloom.functions.signal import neglog10

    g = t.genes.withColumn("q", (F.col("gene_id") % 1000 + 1) / F.lit(1001.0))
    return gn.top_per_group(g, neglog10("q"), 10, "chrom", "gene_id")


@query(
    "t03_top_significant",
    "gene_id:l min_q:d",
    """SELECT gene_id, least(q1, q2) AS min_q FROM (SELECT gene_id, (gene_id % 997 + 1) / 998.0 AS q1, (gene_id * 7 % 997 + 1) / 998.0 AS q2 FROM genes)
       WHERE q1 < 0.05 OR q2 < 0.05 ORDER BY min_q, gene_id LIMIT 20""",
)
def _(t):
    g = t.genes.select("gene_id", ((F.col("gene_id") % 997 + 1) / F.lit(998.0)).alias("q1"), ((F.col("gene_id") * 7 % 997 + 1) / F.lit(998.0)).alias("q2"))
    g = g.withColumn("s1", F.col("q1") < 0.05).withColumn("s2", F.col("q2") < 0.05)
    return gn.top_significant(g, ["q1", "q2"], ["s1", "s2"], 20, "gene_id")


@query("x08_safe_name", "gene_id:l name:s", "SELECT gene_id, regexp_replace(label || '/' || chrom, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM genes")
def _(t):
    return t.genes.select("gene_id", safe_name(F.concat("label", F.lit("/"), "chrom")).alias("name"))


@query(
    "x14_normalize_fold_change",
    "gene_id:l log2fc:d mean_expression:d significant:b",
    """WITH a AS (SELECT gene_id, metric + 1e-6 AS p, ("end" - start) / 400.0 + 1e-6 AS r FROM genes),
       z AS (SELECT gene_id, (p - avg(p) OVER ()) / stddev_pop(p) OVER () AS p, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS r FROM a),
       s AS (SELECT gene_id, p + abs(m) + 1e-6 AS p, r + abs(m) + 1e-6 AS r FROM z, (SELECT least(min(p), min(r)) AS m FROM z))
       SELECT gene_id, log2(p / r) AS log2fc, (p + r) / 2 AS mean_expression, abs(log2(p / r)) > 2 AND (p + r) / 2 > 1 AS significant FROM s
       WHERE p > 1e-4 AND r > 1e-4""",
)
def _(t):
    g = t.genes.select("gene_id", F.col("metric").alias("pred"), ((F.col("end") - F.col("start")) / 400.0).alias("raw"))
    return gn.normalize_fold_change(g).filter("pred > 1e-4 and raw > 1e-4")
