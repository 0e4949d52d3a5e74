from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.functions import signal as sg
from seedloom.operators import stats as st
from seedloom.operators import tracks as tr
from seedloom.plans.registry import query

NZ = 'sum(value * ("end" - start)) FILTER (value <> 0) / sum("end" - start) FILTER (value <> 0)'


@query("a01_nonzero_mean", "track:l mean:d", f"SELECT track, coalesce({NZ}, 0.0) AS mean FROM signal GROUP BY 1")
def _(t):
    return tr.nonzero_mean(t.signal)


@query(
    "a02_nonzero_mean_by_chrom",
    "track:l chrom:s mean:d",
    f"""SELECT a.track, c.chrom, coalesce(m.mean, 1.0) AS mean FROM (SELECT DISTINCT track FROM signal) a,
        (SELECT DISTINCT chrom FROM genes UNION SELECT 'Z') c
        LEFT JOIN (SELECT track, chrom, {NZ} AS mean FROM signal GROUP BY 1, 2) m ON m.track = a.track AND m.chrom = c.chrom""",
)
def _(t):
    chroms = t.genes.select("chrom").union(t.genes.select(F.lit("Z"))).distinct()
    return tr.nonzero_mean_by_chrom(t.signal, chroms)


@query("a03_nonzero_mean_unweighted", "track:l mean:d", "SELECT track, coalesce(avg(value) FILTER (value <> 0), 0.0) AS mean FROM signal GROUP BY 1")
def _(t):
    return tr.nonzero_mean(t.signal, weighted=False)


@query(
    "a04_renormalise",
    "track:l chrom:s start:l value:d",
    """SELECT s.track, chrom, start, value * (100 / (tot / 1e6)) AS value FROM signal s
       JOIN (SELECT track, sum(value * ("end" - start)) AS tot FROM signal GROUP BY 1) USING (track)""",
)
def _(t):
    return tr.renormalise(t.signal)


@query(
    "a05_average_tracks",
    "chrom:s pos:l value:d",
    """SELECT chrom, pos, sum(value) / n AS value FROM (SELECT chrom, unnest(range(start, "end")) AS pos, value FROM signal)
       JOIN (SELECT chrom, count(DISTINCT track) AS n FROM signal GROUP BY 1) USING (chrom) GROUP BY chrom, pos, n HAVING sum(value) > 0""",
)
def _(t):
    from seedloom.operators.intervals import intervals_to_bases

    return intervals_to_bases(tr.average_tracks(t.signal))


WQ = """SELECT track, max(lo_v) AS lo_v, max(lo_f) AS lo_f, max(hi_v) AS hi_v, max(hi_f) AS hi_f FROM (
      SELECT track, arg_max(value, (f, value)) FILTER (f <= 0.9) AS lo_v, max(f) FILTER (f <= 0.9) AS lo_f,
             arg_min(value, (f, value)) FILTER (f >= 0.9) AS hi_v, min(f) FILTER (f >= 0.9) AS hi_f FROM (
        SELECT track, value, (sum(w) OVER (PARTITION BY track ORDER BY value, chrom, start ROWS UNBOUNDED PRECEDING) - w / 2.0) / sum(w) OVER (PARTITION BY track) AS f
        FROM (SELECT *, "end" - start AS w FROM signal WHERE value <> 0)) GROUP BY track) GROUP BY track"""
WQ_VALUE = "CASE WHEN hi_f > lo_f THEN lo_v + (hi_v - lo_v) * (0.9 - lo_f) / (hi_f - lo_f) ELSE coalesce(lo_v, hi_v) END"


@query("a06_weighted_quantile", "track:l quantile:d", f"SELECT track, {WQ_VALUE} AS quantile FROM ({WQ})")
def _(t):
    return tr.weighted_quantile(t.signal.withColumn("w", F.col("end") - F.col("start")), 0.9)


@query(
    "a07_fit_scaler",
    "track:l cap:d mean:d",
    f"""SELECT track, cap, sum(least(value, cap) * ("end" - start)) / sum("end" - start) AS mean FROM signal
        JOIN (SELECT track, {WQ_VALUE} AS cap FROM ({WQ})) USING (track) WHERE value <> 0 GROUP BY 1, 2""",
)
def _(t):
    return tr.fit_scaler(t.signal, 0.9)


@query(
    "a08_collapse_positions",
    "sample_id:l position:l value:d",
    """SELECT g.sample_id, g.position, coalesce(avg(m.value), 0.0) AS value FROM
       (SELECT vec_id AS sample_id, unnest(range(1, 41)) AS position FROM embeddings) g
       LEFT JOIN (SELECT sample_id, position // 2 + 1 AS position, value FROM matrix WHERE position <= 60) m USING (sample_id, position) GROUP BY 1, 2""",
)
def _(t):
    e = F.transform("embedding", lambda v: v.cast("double") + 1.0)
    pos = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.floor(i / 2) + 1)
    df = t.embeddings.select(F.col("vec_id").alias("sample_id"), e.alias("scores"), pos.alias("pos_list"))
    eff = df.select("sample_id", F.lit(1).cast("long").alias("eff_start"), F.lit(40).cast("long").alias("eff_end"))
    return tr.collapse_positions(df, "sample_id", eff=eff)


@query("a10_column_profile", "grp:l position:l value:d", "SELECT grp, position, avg(value) AS value FROM matrix GROUP BY 1, 2")
def _(t):
    return st.column_profile(t.matrix, ["grp", "position"])


def metrics_sql(src: str, key: str) -> str:
    """Oracle text for the 17 metrics of ``src`` (key, position, value)."""
    return f"""
      SELECT b.{key}, b.n, b.mean, b.max, b.std, b.std / b.mean AS cv, b.median, m.mode, b.q75 - b.q25 AS iqr,
        CASE WHEN b.n > 2 THEN c.m3 / power(c.m2, 1.5) END AS skewness,
        CASE WHEN b.n > 3 THEN c.m4 / (c.m2 * c.m2) - 3 END AS kurtosis,
        tp.top5_percent_mean, tp.low5_percent_mean, b.percentile_90, b.percentile_10,
        coalesce(p.pc, 0) AS peak_count, coalesce(p.pc, 0) / CAST(b.n AS DOUBLE) AS peak_density, p.pm AS peak_mean, b.shannon_entropy
      FROM (SELECT {key}, count(*) AS n, avg(value) AS mean, max(value) AS max, coalesce(stddev_samp(value), 0.0) AS std,
              median(value) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75,
              quantile_cont(value, 0.9) AS percentile_90, quantile_cont(value, 0.1) AS percentile_10,
              ln(sum(value)) - sum(value * ln(value)) / sum(value) AS shannon_entropy FROM {src} GROUP BY 1) b
      JOIN (SELECT {key}, avg(power(value - mu, 2)) AS m2, avg(power(value - mu, 3)) AS m3, avg(power(value - mu, 4)) AS m4
            FROM (SELECT *, avg(value) OVER (PARTITION BY {key}) AS mu FROM {src}) GROUP BY 1) c USING ({key})
      JOIN (SELECT {key}, arg_max(value, (cnt, -value)) AS mode FROM (SELECT {key}, value, count(*) AS cnt FROM {src} GROUP BY 1, 2) GROUP BY 1) m USING ({key})
      JOIN (SELECT {key}, avg(value) FILTER (dn <= greatest(1, floor(n * 0.05))) AS top5_percent_mean, avg(value) FILTER (up <= greatest(1, floor(n * 0.05))) AS low5_percent_mean
            FROM (SELECT {key}, value, row_number() OVER (PARTITION BY {key} ORDER BY value DESC) AS dn, row_number() OVER (PARTITION BY {key} ORDER BY value) AS up,
                  count(*) OVER (PARTITION BY {key}) AS n FROM {src}) GROUP BY 1) tp USING ({key})
      LEFT JOIN (SELECT {key}, count(*) AS pc, avg(value) AS pm FROM ({peaks_sql(src, key)}) WHERE value >= mu GROUP BY 1) p USING ({key})"""


def peaks_sql(src: str, key: str) -> str:
    return f"""SELECT {key}, (lo + hi) // 2 AS position, value, mu FROM (
        SELECT *, lag(value) OVER (PARTITION BY {key} ORDER BY lo) AS pv, lead(value) OVER (PARTITION BY {key} ORDER BY lo) AS nv FROM (
          SELECT {key}, run, any_value(value) AS value, any_value(mu) AS mu, min(position) AS lo, max(position) AS hi FROM (
            SELECT *, sum(isnew) OVER (PARTITION BY {key} ORDER BY position) AS run FROM (
              SELECT {key}, position, value, avg(value) OVER (PARTITION BY {key}) AS mu,
                CASE WHEN lag(value) OVER (PARTITION BY {key} ORDER BY position) = value THEN 0 ELSE 1 END AS isnew FROM {src}))
          GROUP BY {key}, run)) WHERE value > pv AND value > nv"""


METRIC_COLS = "n:l " + " ".join(f"{m}:d" for m in st.METRICS)
ROUNDED = "(SELECT sample_id, position, round(value * 8) / 8 AS value FROM matrix)"


@query("a11_distribution_metrics", f"sample_id:l {METRIC_COLS}", metrics_sql("matrix", "sample_id"))
def _(t):
    return st.distribution_metrics(t.matrix, "sample_id")


@query("f09_local_maxima", "sample_id:l position:l value:d", f"SELECT sample_id, position, value FROM ({peaks_sql(ROUNDED, 'sample_id')})")
def _(t):
    return st.local_maxima(t.matrix.withColumn("value", F.round(F.col("value") * 8) / 8), "value", "position", "sample_id")


# erfc by its power series, as text: p-value of a z-score in plain SQL
ERFC = """(CASE WHEN {z} <= 0 THEN least(1.0, 1 + 2 / sqrt(pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 120), lambda n: exp((2 * n + 1) * ln(greatest(abs({z}), 1e-300) / sqrt(2)) + 2 * n * ln(2) - lgamma(2 * n + 2) + lgamma(n + 1)))))
  ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 120), lambda n: exp((2 * n + 1) * ln({z} / sqrt(2)) + 2 * n * ln(2) - lgamma(2 * n + 2) + lgamma(n + 1))))) END)"""


def rank_test_sql(src: str, key: str) -> str:
    """Oracle text of the rank test of grp 0 against grp 1 for every key of ``src``."""
    return f"""SELECT {key}, n_a, n_b, mean_a, mean_b, u, z, {ERFC.format(z='z')} AS pvalue FROM (
        SELECT *, (greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS z FROM (
          SELECT {key}, count(*) FILTER (grp = 0) AS n_a, count(*) FILTER (grp = 1) AS n_b, avg(value) FILTER (grp = 0) AS mean_a, avg(value) FILTER (grp = 1) AS mean_b,
            sum(r) FILTER (grp = 0) - count(*) FILTER (grp = 0) * (count(*) FILTER (grp = 0) + 1) / 2.0 AS u,
            sum(CAST(tn AS DOUBLE) * tn - 1) AS ties
          FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY value) + (count(*) OVER (PARTITION BY {key}, value) - 1) / 2.0 AS r,
                count(*) OVER (PARTITION BY {key}, value) AS tn FROM {src}) GROUP BY {key}))"""


def bh_sql(src: str, key: str, family: str = "1", p: str = "pvalue") -> str:
    return f"""SELECT *, least(1.0, min(qq) OVER (PARTITION BY fam ORDER BY {p} DESC, {key} DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM (
        SELECT *, {family} AS fam, {p} * count(*) OVER (PARTITION BY {family}) / row_number() OVER (PARTITION BY {family} ORDER BY {p}, {key}) AS qq FROM ({src}))"""


DIFF_COLS = "position:l n_a:l n_b:l mean_a:d mean_b:d log2fc:d u:d z:d pvalue:d padj:d significant:b"
LOG2FC = "log2(mean_b / mean_a)"


@query(
    "a14_mann_whitney",
    "position:l n_a:l n_b:l u:d z:d pvalue:d",
    rank_test_sql("(SELECT position, grp, round(value * 10) AS value FROM matrix)", "position"),
)
def _(t):
    m = t.matrix.withColumn("value", F.round(F.col("value") * 10))
    return st.mann_whitney(m, "position", "value", F.col("grp") == 0, F.col("grp") == 1)


@query(
    "a17_position_differential",
    DIFF_COLS,
    f"SELECT *, {LOG2FC} AS log2fc, padj < 0.05 AND abs({LOG2FC}) > 1 AS significant FROM ({bh_sql(rank_test_sql('matrix', 'position'), 'position')})",
)
def _(t):
    return st.position_differential(t.matrix, 0, 1)


@query("a15_bh_adjust", "family:l position:l padj:d rejected:b", f"SELECT family, position, padj, padj <= 0.05 AS rejected FROM ({bh_sql('SELECT * FROM pvals', 'position', 'family', 'p')}) ")
def _(t):
    return st.bh_adjust(t.pvals, "p", "family")


@query(
    "a16_log2_fold_change",
    "l_orderkey:l lfc:d",
    """SELECT l_orderkey, CASE WHEN a > 0 AND b > 0 THEN log2(b / a) WHEN a = 0 AND b > 0 THEN 1e9 WHEN a > 0 AND b = 0 THEN -1e9 ELSE 0 END AS lfc
       FROM (SELECT l_orderkey, avg(truth) AS a, avg(pred) AS b FROM preds GROUP BY 1)""",
)
def _(t):
    m = t.preds.groupBy("l_orderkey").agg(F.avg("truth").alias("a"), F.avg("pred").alias("b"))
    x = sg.log2_fold_change("a", "b")
    inf = F.lit(float("inf"))
    return m.select("l_orderkey", F.when(x == inf, 1e9).when(x == -inf, -1e9).otherwise(x).alias("lfc"))


@query(
    "a20_combine_directions",
    "p1:d p2:d d:d p:d",
    """SELECT DISTINCT p1, p2, d, CASE WHEN sign(d) <> sign(p1 - 0.5) THEN 1.0 ELSE least(1.0, sqrt(p1 * p2) / greatest(1e-12, least(p1, p2) / greatest(p1, p2))) END AS p FROM (
       SELECT (l_partkey % 1000 + 1) / 1001.0 AS p1, (l_suppkey % 1000 + 1) / 1001.0 AS p2, round(l_discount * 100) - 5 AS d FROM lineitem)""",
)
def _(t):
    df = t.lineitem.select(
        ((F.col("l_partkey") % 1000 + 1) / F.lit(1001.0)).alias("p1"), ((F.col("l_suppkey") % 1000 + 1) / F.lit(1001.0)).alias("p2"),
        (F.round(F.col("l_discount") * 100) - 5).alias("d"),
    ).distinct()
    return df.withColumn("p", sg.combine_directions("p1", "p2", F.col("d"), F.col("p1") - 0.5))


@query(
    "a31_track_mean_map",
    "prefix:l a:d n:d z:d",
    """SELECT track AS prefix, coalesce(max(m) FILTER (chrom = 'A'), 0) AS a, coalesce(max(m) FILTER (chrom = 'N'), 0) AS n, 0.0 AS z
       FROM (SELECT track, chrom, arg_min(value, start) AS m FROM signal GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    means = t.signal.select(F.col("track").alias("prefix"), "chrom", F.col("value").alias("mean"), F.col("start").alias("ord"))
    out = tr.track_mean_map(means, ["A", "N", "Z"])
    return out.select("prefix", *[F.element_at("means", k).alias(c) for k, c in (("A", "a"), ("N", "n"), ("Z", "z"))])


@query(
    "a51_coverage",
    "chrom:s start:l end:l value:d",
    """WITH kept AS (SELECT l_returnflag AS chrom, l_orderkey * 16 AS start, l_orderkey * 16 + CAST(l_quantity AS INT) AS "end" FROM lineitem l
         WHERE l_linenumber >= 2 AND l_linestatus = 'F' AND NOT EXISTS (SELECT 1 FROM genes g WHERE g.gene_id % 10 = 0 AND g.chrom = l.l_returnflag AND g.start < l_orderkey * 16 + CAST(l_quantity AS INT) AND g."end" > l_orderkey * 16))
       SELECT chrom, b * 50 AS start, b * 50 + 50 AS "end", count(*) / ((SELECT count(*) FROM kept) / 1e6) AS value
       FROM (SELECT chrom, unnest(range(start // 50, ("end" - 1) // 50 + 1)) AS b FROM kept) GROUP BY chrom, b""",
)
def _(t):
    li = t.lineitem
    reads = li.select(
        F.col("l_returnflag").alias("chrom"), (F.col("l_orderkey") * 16).alias("start"),
        (F.col("l_orderkey") * 16 + F.col("l_quantity").cast("int")).alias("end"),
        F.col("l_linestatus").alias("strand"), F.col("l_linenumber").alias("mapq"),
    )
    return tr.coverage(reads, 50, 2, "F", t.genes.filter("gene_id % 10 = 0"), "CPM")


@query(
    "a52_window_profile",
    "vec_id:l min:d max:d mean:d zero_ratio:d",
    """SELECT vec_id, list_min(v) AS min, list_max(v) AS max, list_avg(v) AS mean, 100.0 * len(list_filter(v, lambda x: x = 0)) / len(v) AS zero_ratio
       FROM (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 10)) AS v FROM embeddings)""",
)
def _(t):
    return tr.window_profile(t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 10)).alias("values")))


@query(
    "f02_average_rank",
    "l_orderkey:l l_linenumber:l rank:d",
    "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rank FROM lineitem",
)
def _(t):
    return st.average_rank(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), "l_extendedprice", "l_returnflag")


@query(
    "f03_reverse_running_min",
    "family:l position:l run_min:d",
    "SELECT family, position, min(p) OVER (PARTITION BY family ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS run_min FROM pvals",
)
def _(t):
    return st.reverse_running_min(t.pvals, "p", "position", "family")


@query(
    "f08_gaussian_smooth",
    "sample_id:l position:l smooth:d",
    """WITH k AS (SELECT d, exp(-0.5 * power(d / 2.0, 2)) / sum(exp(-0.5 * power(d / 2.0, 2))) OVER () AS w FROM range(-6, 7) r(d))
       SELECT m.sample_id, m.position + d AS position, sum(value * w) AS smooth FROM matrix m, k WHERE m.position + d BETWEEN 1 AND 64 GROUP BY 1, 2""",
)
def _(t):
    return st.gaussian_smooth(t.matrix, "value", "position", 2.0, "sample_id")


@query(
    "f08_gaussian_smooth_wide",
    "family:l position:l smooth:d",
    """WITH k AS (SELECT d, exp(-0.5 * power(d / 100.0, 2)) / sum(exp(-0.5 * power(d / 100.0, 2))) OVER () AS w FROM range(-300, 301) r(d)),
       v AS (SELECT DISTINCT user_id % 8 AS family, CAST(event_id AS BIGINT) AS position, value FROM events)
       SELECT a.family, a.position, sum(b.value * w) AS smooth FROM v a JOIN v b ON a.family = b.family AND b.position BETWEEN a.position - 300 AND a.position + 300
       JOIN k ON k.d = b.position - a.position GROUP BY 1, 2""",
)
def _(t):
    rows = t.events.select((F.col("user_id") % 8).alias("family"), F.col("event_id").cast("long").alias("position"), "value").distinct()
    return st.gaussian_smooth(rows, "value", "position", 100.0, "family")


SCALE = "CASE WHEN {v} > 10 THEN 2 * sqrt(10 * ({v})) - 10 ELSE {v} END"


@query(
    "x11_scale_signal",
    "k:l scaled:d back:d",
    f"""SELECT k, scaled, power(CASE WHEN scaled > 10 THEN power((scaled + 10) / 2, 2) / 10 ELSE scaled END, 1 / 0.75) * 2.5 AS back FROM (
        SELECT k, {SCALE.format(v='power(least(v, 90000) / 2.5, 0.75)')} AS scaled FROM (SELECT DISTINCT l_orderkey AS k, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS v FROM lineitem))""",
)
def _(t):
    df = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("v"))
    df = df.withColumn("scaled", sg.scale_signal("v", 2.5, 90000))
    return df.withColumn("back", sg.unscale_signal("scaled", 2.5))


@query("x12_soft_clip", "v:d clipped:d", f"SELECT DISTINCT v, {SCALE.format(v='v / 2.0')} AS clipped FROM (SELECT l_quantity AS v FROM lineitem)")
def _(t):
    df = t.lineitem.select(F.col("l_quantity").alias("v")).distinct()
    return df.withColumn("clipped", sg.soft_clip("v", 2.0))


@query("x13_neglog10", "family:l position:l score:d", "SELECT family, position, -log10(greatest(p, 1e-300)) AS score FROM pvals")
def _(t):
    return t.pvals.withColumn("score", sg.neglog10("p"))


@query(
    "x26_positive_strand_values",
    "track:l chrom:s start:l value:d",
    "SELECT track, chrom, start, value FROM signal",
)
def _(t):
    minus = F.col("track") % 2 == 1
    df = t.signal.withColumn("strand", F.when(minus, "-").otherwise("+")).withColumn("value", F.when(minus, -F.col("value")).otherwise(F.col("value")))
    return df.withColumn("value", sg.positive_strand_values("value", "strand"))
