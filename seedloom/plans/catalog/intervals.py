from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.operators import intervals as iv
from seedloom.operators.base import dealt
from seedloom.operators.ordered import ordered_scan, running_sum
from seedloom.plans.registry import query
from seedloom.session import settle

# Windows of the sequences, as (chrom, start, end), used by several entries below.
SEQ_WINDOWS = """
    SELECT DISTINCT seqid, file_name, start, start + 400 AS "end" FROM (
        SELECT seqid, file_name, unnest(list_append(range(0, len - 400 + 1, 300), len - 400)) AS start
        FROM seqs WHERE len >= 400)"""


def seq_windows(t):
    return iv.sliding_windows(t.seqs, 400, 100).select("seqid", "file_name", "start", "end")


@query("w01_sliding_windows", "seqid:l start:l end:l", f'SELECT seqid, start, "end" FROM ({SEQ_WINDOWS})')
def _(t):
    return seq_windows(t)


@query(
    "w02_stride_windows",
    "seqid:l start:l end:l",
    'SELECT seqid, start, least(start + 500, len) AS "end" FROM (SELECT seqid, len, unnest(range(0, len, 250)) AS start FROM seqs)',
)
def _(t):
    regions = t.seqs.select("seqid", F.lit(0).cast("long").alias("start"), F.col("len").alias("end"))
    return iv.stride_windows(regions, 500, 250)


EFF = """
    SELECT gene_id, chrom, start, "end",
      CASE WHEN pe IS NOT NULL AND greatest(ps, start) <= least(pe, "end")
           THEN greatest(start, CAST(floor((greatest(ps, start) + least(pe, "end")) / 2.0) AS BIGINT) + 1) ELSE start END AS l,
      CASE WHEN ns IS NOT NULL AND greatest(start, ns) <= least("end", ne)
           THEN least("end", CAST(floor((greatest(start, ns) + least("end", ne)) / 2.0) AS BIGINT)) ELSE "end" END AS r
    FROM (SELECT *, lag(start) OVER w AS ps, lag("end") OVER w AS pe, lead(start) OVER w AS ns, lead("end") OVER w AS ne
          FROM genes WINDOW w AS (PARTITION BY chrom ORDER BY start, "end"))"""


@query(
    "w03_effective_intervals",
    "gene_id:l chrom:s eff_start:l eff_end:l",
    f'SELECT gene_id, chrom, CASE WHEN l > r THEN start ELSE l END AS eff_start, CASE WHEN l > r THEN "end" ELSE r END AS eff_end FROM ({EFF})',
)
def _(t):
    return iv.effective_intervals(t.genes, by="chrom", strict=False)


@query(
    "w04_overlap_join",
    "gene_id:l track:l chrom:s start:l",
    """SELECT g.gene_id, s.track, s.chrom, s.start FROM genes g JOIN signal s ON g.chrom = s.chrom
       AND s.start <= g."end" + 100 AND s."end" >= g.start - 100""",
)
def _(t):
    out = iv.overlap_join(t.genes, t.signal, flank=100)
    return out.select("gene_id", F.col("b_track").alias("track"), "chrom", F.col("b_start").alias("start"))


@query(
    "w05_extend_flank",
    "gene_id:l region_start:l region_end:l region_len:l gene_len:l",
    """SELECT gene_id, greatest(1, start - 2000) AS region_start, "end" + 2000 AS region_end,
       "end" + 2000 - greatest(1, start - 2000) + 1 AS region_len, "end" - start + 1 AS gene_len FROM genes""",
)
def _(t):
    return iv.extend_flank(t.genes, 2000)


@query(
    "w06_explode_window",
    "seqid:l pos:l code:l",
    """SELECT seqid, start + j AS pos, ascii(substr(bases, CAST(start + j + 1 AS BIGINT), 1)) AS code
       FROM (SELECT seqid, bases, start, unnest(range(0, least(len, 400))) AS j FROM
             (SELECT DISTINCT seqid, bases, len, unnest(list_append(range(0, greatest(len - 400, 0) + 1, 1200), greatest(len - 400, 0))) AS start FROM seqs))""",
)
def _(t):
    win = t.seqs.withColumn("_last", F.greatest(F.col("len") - 400, F.lit(0)).cast("long"))
    starts = F.array_union(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(1200).cast("long")), F.array("_last"))
    win = win.withColumn("start", F.explode(starts)).withColumn("end", F.col("start") + F.least("len", F.lit(400)))
    text = F.substring(F.col("bases"), (F.col("start") + 1).cast("int"), F.lit(400))
    win = win.select("seqid", "start", "end", F.transform(F.split(text, ""), lambda c: F.ascii(c)).alias("code"))
    return iv.explode_window(win, "code")


@query(
    "w07_merge_overlapping",
    "chrom:s pos:l pred:d truth:d",
    "SELECT chrom, l_orderkey AS pos, avg(pred) AS pred, avg(truth) AS truth FROM preds GROUP BY 1, 2",
)
def _(t):
    rows = t.preds.withColumnRenamed("l_orderkey", "pos")
    return iv.merge_overlapping(rows, ["pred", "truth"])


@query(
    "w08_intervals_to_bases",
    "track:l chrom:s pos:l value:d",
    'SELECT track, chrom, unnest(range(start, "end")) AS pos, value FROM signal',
)
def _(t):
    return iv.intervals_to_bases(t.signal)


@query(
    "w08_bases_to_intervals",
    "track:l chrom:s start:l end:l value:d",
    """SELECT track, chrom, min(pos) AS start, max(pos) + 1 AS "end", value FROM (
         SELECT *, pos - row_number() OVER (PARTITION BY track, chrom, value ORDER BY pos) AS g FROM (
           SELECT track, chrom, unnest(range(start - start % 128, start - start % 128 + 64)) AS pos, round(max(value) * 5) AS value
           FROM signal GROUP BY track, chrom, start - start % 128) WHERE value <> 0)
       GROUP BY track, chrom, value, g""",
)
def _(t):
    lo = F.col("start") - F.col("start") % 128
    rows = dealt(t.signal.withColumn("_lo", lo), t.lineitem.count(), "track", "chrom", "_lo")
    coarse = rows.groupBy("track", "chrom", "_lo").agg(F.round(F.max("value") * 5).alias("value"))
    one = coarse.select("track", "chrom", F.col("_lo").alias("start"), (F.col("_lo") + 64).alias("end"), "value")
    bases = iv.intervals_to_bases(one)
    return iv.bases_to_intervals(bases, ["track", "chrom"])


@query(
    "w09_scaffold_fill",
    "grp:l position:l value:d",
    """SELECT g.grp, g.position, coalesce(m.value, 0.0) AS value FROM
       (SELECT grp, unnest(range(1, 81)) AS position FROM (SELECT DISTINCT grp FROM matrix)) g
       LEFT JOIN (SELECT grp, position, max(value) AS value FROM matrix WHERE position % 3 <> 0 GROUP BY 1, 2) m
       USING (grp, position)""",
)
def _(t):
    curve = t.matrix.filter(F.col("position") % 3 != 0).withColumn("ord", -F.col("value"))
    eff = t.matrix.select("grp").distinct().select("grp", F.lit(1).alias("eff_start"), F.lit(80).alias("eff_end"))
    eff = eff.withColumn("eff_start", F.col("eff_start").cast("long")).withColumn("eff_end", F.col("eff_end").cast("long"))
    return iv.scaffold_fill(curve, eff, by=["grp"])


@query(
    "w10_extract_windows",
    "chrom:s start:l end:l sequence:s signal_0:ad",
    """WITH win AS (SELECT DISTINCT chrom, start - start % 256 AS start, start - start % 256 + 256 AS "end" FROM signal WHERE track = 0),
       bases AS (SELECT w.chrom, w.start, j, coalesce(max(s.value), 0.0) AS v
         FROM (SELECT chrom, start, unnest(range(start, "end")) AS j FROM win) w
         LEFT JOIN (SELECT chrom, unnest(range(start, "end")) AS j, value FROM signal WHERE track = 0) s USING (chrom, j)
         GROUP BY 1, 2, 3)
       SELECT b.chrom, b.start, b.start + 256 AS "end", repeat('ACGT', 64) AS sequence, list(b.v ORDER BY j) AS signal_0
       FROM bases b GROUP BY b.chrom, b.start""",
)
def _(t):
    lo = F.col("start") - F.col("start") % 256
    win = t.signal.filter("track = 0").select("chrom", lo.alias("start"), (lo + 256).alias("end"))
    win = settle(win.distinct())  # the chunks are made of the windows as well
    chunks = win.select(F.col("chrom").alias("seqid"), F.explode(F.array(F.col("start"), F.col("start") + 128)).alias("chunk_start"))
    chunks = chunks.withColumn("bases", F.repeat(F.lit("ACGT"), 32))
    return iv.extract_windows(win, chunks, t.signal, track_ids=[0])


@query(
    "w11_pad_window",
    "seqid:l sequence:s signal:ad",
    """SELECT seqid, rpad(substr(bases, 1, 600), 600, 'N') AS sequence,
         list_concat(list_transform(sig, lambda v: least(CAST(v AS DOUBLE), quantile)), CASE WHEN len(sig) < 600 THEN list_resize([]::DOUBLE[], 600 - len(sig), 0.0) ELSE []::DOUBLE[] END) AS signal
       FROM (SELECT seqid, bases, list_transform(range(1, least(len, 600) + 1), lambda i: (i * 7919) % 101) AS sig,
               (SELECT quantile_cont(u.v, 0.99) FROM (SELECT CAST((i * 7919) % 101 AS DOUBLE) AS v FROM range(1, least(len, 600) + 1) r(i)) u) AS quantile
             FROM seqs WHERE len > 0)""",
)
def _(t):
    n = F.least(F.col("len"), F.lit(600))
    sig = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: ((i * 7919) % 101).cast("double"))
    df = t.seqs.filter("len > 0").select("seqid", F.col("bases").alias("sequence"), sig.alias("signal"))
    return iv.pad_window(df, 600, signals=["signal"], clip="signal")


@query("w12_holdout_windows", "seqid:l file_name:s start:l end:l")
def _(t):
    win = iv.sliding_windows(t.seqs, 400, 200).select("seqid", "file_name", "start", "end")
    return iv.holdout_windows(win, 0.2, seed=3, by=["seqid", "file_name"])


@query(
    "w13_match_chrom_prefix",
    "name:s matched:s candidates:l",
    """WITH ref AS (SELECT DISTINCT p_name AS matched FROM part),
       req AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part UNION SELECT DISTINCT p_name FROM part)
       SELECT name, arg_min(matched, ((matched <> name)::INT, matched)) AS matched, count(*) AS candidates
       FROM req JOIN ref ON starts_with(matched, name) GROUP BY name""",
)
def _(t):
    ref = t.part.select(F.col("p_name").alias("name")).distinct().withColumn("ord", F.col("name"))
    req = t.part.select(F.split("p_name", " ")[0].alias("name")).union(t.part.select("p_name")).distinct()
    return iv.match_chrom_prefix(req, ref)


@query(
    "w14_slice_positions",
    "sample_id:l position:l value:d",
    "SELECT sample_id, position * 2 AS position, value FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY position) AS k FROM matrix) WHERE k BETWEEN 9 AND 24",
)
def _(t):
    # positions with gaps: places count, not positions
    return iv.slice_positions(t.matrix.withColumn("position", F.col("position") * 2), 9, 24, by="sample_id")


@query(
    "w15_position_window",
    "sample_id:l position:l value:d",
    "SELECT sample_id, position, value FROM matrix WHERE position BETWEEN 27 AND 37",
)
def _(t):
    return iv.position_window(t.matrix, 32, 5, by="sample_id")


@query(
    "w16_select_blocks",
    "block:s gene_id:l",
    "SELECT 'block_' || (gene_id % 40) AS block, gene_id FROM genes WHERE gene_id % 40 BETWEEN 9 AND 21",
)
def _(t):
    df = t.genes.select(F.concat(F.lit("block_"), (F.col("gene_id") % 40).cast("string")).alias("block"), "gene_id")
    return iv.select_blocks(df, 9, 21)


@query(
    "w17_paired_track_index",
    "cell_type:s chrom:s start:l end:l rna_plus_track:l rna_minus_track:l atac_track:l rna_plus_mean:d rna_minus_cap:d",
    f"""WITH st AS (SELECT track, sum(value * ("end" - start)) / sum("end" - start) AS mean, max(value) AS cap FROM signal WHERE value <> 0 GROUP BY 1),
        win AS (SELECT DISTINCT file_name AS chrom, start, "end" FROM ({SEQ_WINDOWS}))
        SELECT c.cell_type, w.chrom, w.start, w."end", 0 AS rna_plus_track, 1 AS rna_minus_track, 2 AS atac_track,
          (SELECT mean FROM st WHERE track = 0) AS rna_plus_mean, (SELECT cap FROM st WHERE track = 1) AS rna_minus_cap
        FROM win w, (SELECT DISTINCT l_returnflag AS cell_type FROM lineitem WHERE l_suppkey % 4 < 3) c""",
)
def _(t):
    from seedloom.operators.tracks import nonzero_mean_weighted

    kind = F.when(F.col("track") == 0, "rna_plus").when(F.col("track") == 1, "rna_minus").when(F.col("track") == 2, "atac")
    tracks = t.signal.select(F.col("chrom").alias("cell_type"), "track", kind.alias("kind")).filter("kind is not null").distinct()
    stats = nonzero_mean_weighted(t.signal, ["track"], "mean").join(t.signal.groupBy("track").agg(F.max("value").alias("cap")), "track")
    win = seq_windows(t).select(F.col("file_name").alias("chrom"), "start", "end").distinct()
    return iv.paired_track_index(win, tracks, stats)


HEADS = ["1-URGENT_F", "1-URGENT_O", "2-HIGH_F", "2-HIGH_O"]


@query(
    "w18_multimodal_index",
    "biosample:l chrom:s start:l a_track:l a_mean:d b_track:l b_mean:d",
    f"""WITH win AS (SELECT DISTINCT file_name AS chrom, start, "end" FROM ({SEQ_WINDOWS})),
        first AS (SELECT biosample, assay || '_' || strand AS head, min(track_index) AS track, arg_min(nonzero_mean, track_index) AS mean FROM meta GROUP BY 1, 2),
        wide AS (SELECT b.biosample, a.track AS a_track, coalesce(a.mean, 1.0) AS a_mean, c.track AS b_track, coalesce(c.mean, 1.0) AS b_mean
                 FROM (SELECT DISTINCT biosample FROM meta) b
                 LEFT JOIN first a ON a.biosample = b.biosample AND a.head = '1-URGENT_F'
                 LEFT JOIN first c ON c.biosample = b.biosample AND c.head = '2-HIGH_O')
        SELECT w2.biosample, w.chrom, w.start, a_track, a_mean, b_track, b_mean FROM win w, wide w2""",
)
def _(t):
    win = seq_windows(t).select(F.col("file_name").alias("chrom"), "start", "end").distinct()
    out = iv.multimodal_index(t.meta, win, HEADS)
    return out.select(
        "biosample", "chrom", "start",
        F.col("1-URGENT_F_track").alias("a_track"), F.col("1-URGENT_F_mean").alias("a_mean"),
        F.col("2-HIGH_O_track").alias("b_track"), F.col("2-HIGH_O_mean").alias("b_mean"),
    )


@query(
    "w19_predictions_to_track",
    "chrom:s start:l p1:d p2:d call:s",
    """SELECT *, CASE WHEN p1 >= 0.0503 AND p2 < 0.0503 THEN 'japonica' WHEN p2 >= 0.0503 AND p1 < 0.0503 THEN 'indica' ELSE 'uncertain' END AS call
       FROM (SELECT chrom, l_orderkey AS start, avg(truth) AS p1, avg(pred) AS p2 FROM preds GROUP BY 1, 2)""",
)
def _(t):
    df = t.preds.select("chrom", F.col("l_orderkey").alias("start"), F.col("truth").alias("p1"), F.col("pred").alias("p2"))
    return iv.predictions_to_track(df, 0.0503, by=["chrom", "start"])


@query(
    "f04_with_neighbours",
    "gene_id:l prev_start:n next_start:n",
    "SELECT gene_id, lag(start) OVER w AS prev_start, lead(start) OVER w AS next_start FROM genes WINDOW w AS (PARTITION BY chrom ORDER BY start)",
)
def _(t):
    return iv.with_neighbours(t.genes, "chrom", "start", ["start"])


@query(
    "f05_with_ahead",
    "seqid:l start:l start_ahead:n",
    f"SELECT seqid, start, lead(start, 2) OVER (PARTITION BY file_name ORDER BY seqid, start) AS start_ahead FROM ({SEQ_WINDOWS})",
)
def _(t):
    return iv.with_ahead(seq_windows(t), "start", 2, "file_name", ["seqid", "start"])


@query(
    "f06_running_sum",
    "track:l chrom:s start:l value:d running:d",
    "SELECT track, chrom, start, value, sum(value) OVER (PARTITION BY track ORDER BY chrom, start) AS running FROM signal",
)
def _(t):
    return ordered_scan(t.signal, "track", ["chrom", "start"], running=running_sum("value"))


@query(
    "f07_global_prefix_sum",
    "doc_id:l n_tokens:l before:l",
    "SELECT doc_id, len(toks) AS n_tokens, sum(len(toks)) OVER (ORDER BY doc_id) - len(toks) AS before FROM tokens",
)
def _(t):
    from seedloom.operators.packing import global_prefix_sum

    df = t.tokens.select("doc_id", F.size("toks").cast("long").alias("n_tokens"))
    return global_prefix_sum(df, "n_tokens", "doc_id", "before")


@query(
    "p14_filter_chrom_token",
    "seqid:l token:s",
    "SELECT seqid, 'Chr' || (seqid % 12) AS token FROM seqs WHERE seqid % 12 IN (1, 5, 11)",
)
def _(t):
    from seedloom.operators.filters import filter_chrom_token

    df = t.seqs.select("seqid", F.concat(F.lit("genome_Chr"), (F.col("seqid") % 12).cast("string"), F.lit("_x")).alias("file"))
    return filter_chrom_token(df, "file", ["Chr1", "Chr5", "Chr11"], to="token")


@query(
    "p14_region_mask",
    "sample_id:l kept:ad",
    "SELECT vec_id AS sample_id, list_filter(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), lambda v: v > 0.1) AS kept FROM embeddings",
)
def _(t):
    e = F.transform("embedding", lambda v: v.cast("double"))
    df = t.embeddings.select(
        F.col("vec_id").alias("sample_id"), e.alias("kept"), F.transform(e, lambda v: F.when(v > 0.1, 1.0).otherwise(0.0)).alias("mask")
    )
    return iv.region_mask(df, "mask", "kept")


@query(
    "t06_order_by_genome",
    "file_name:s start:l seqid:l",
    f"SELECT file_name, start, seqid FROM ({SEQ_WINDOWS})",
)
def _(t):
    return iv.order_by_genome(seq_windows(t), "file_name")
