from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.operators import filters as fl
from seedloom.operators import joins as jn
from seedloom.operators import sets as se
from seedloom.operators.base import require_columns, standardize_id, valid_positions
from seedloom.plans.registry import query


@query(
    "p01_filter_metadata",
    "num_file_accession:l track_index:l output_type:s strand:s",
    """SELECT 1 + track_index % 3 AS num_file_accession, track_index, CASE WHEN assay = '1-URGENT' THEN 'ATAC' ELSE 'RNA_SEQ' END AS output_type, CASE strand WHEN 'P' THEN '.' ELSE strand END AS strand
       FROM meta WHERE assay IN ('1-URGENT', '2-HIGH') AND biosample IN (1, 2, 3) AND NOT (assay = '2-HIGH' AND strand = 'P')""",
)
def _(t):
    kind = F.when(F.col("assay") == "1-URGENT", "ATAC").when(F.col("assay") == "2-HIGH", "RNA_SEQ").otherwise("OTHER")
    m = t.meta.withColumn("output_type", kind).withColumn("strand", F.when(F.col("strand") == "P", ".").otherwise(F.col("strand")))
    m = m.withColumn("accession", F.array_join(F.array_repeat(F.lit("ENC"), (1 + F.col("track_index") % 3).cast("int")), ","))
    return fl.filter_metadata(m, ["ATAC", "RNA_SEQ"], ["1-URGENT", "2-HIGH"], [1, 2, 3])


@query(
    "p02_select_tracks",
    "track_index:l nonzero_mean:d",
    "SELECT track_index, nonzero_mean FROM meta WHERE assay = '5-LOW' AND strand = 'F' AND track_index IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
)
def _(t):
    ids = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("track_index"))
    return fl.select_tracks(t.meta, ids, assay="5-LOW", strand="F")


@query(
    "p03_track_metadata_rows",
    "sample:l tissue:s track_index:l mean:d",
    """SELECT s.sample, c.tissue, c.k AS track_index, m.mean FROM (SELECT DISTINCT l_suppkey AS sample FROM lineitem) s,
       (SELECT * FROM (VALUES ('A', 1), ('N', 2), ('Z', 3)) v(tissue, k)) c
       LEFT JOIN (SELECT l_suppkey AS sample, l_returnflag AS tissue, avg(l_discount) AS mean FROM lineitem GROUP BY 1, 2) m ON m.sample = s.sample AND m.tissue = c.tissue""",
)
def _(t):
    s = t.lineitem.select(F.col("l_suppkey").alias("sample")).distinct().withColumn("tissues", F.array(F.lit("A"), F.lit("N"), F.lit("Z")))
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("tissue")).agg(F.avg("l_discount").alias("mean"))
    return fl.track_metadata_rows(s, m)


@query("p04_encode_group", "doc_id:l group:s", """SELECT doc_id, CASE WHEN quality = 0 THEN 'control' ELSE 'case' END AS "group" FROM labels""")
def _(t):
    return fl.encode_group(t.labels, "quality", "doc_id")


@query("p05_sample_limit", "doc_id:l quality:l")
def _(t):
    return fl.sample_limit(t.labels, 50, 7, "doc_id").select("doc_id", "quality")


@query(
    "p08_valid_positions",
    "l_orderkey:l l_linenumber:l r:d",
    "SELECT l_orderkey, l_linenumber, l_tax / l_discount AS r FROM lineitem WHERE l_discount <> 0",
)
def _(t):
    df = t.lineitem.withColumn("r", F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("nan"))))
    return valid_positions(df, "r")


@query(
    "p09_keep_least_toxic_half",
    "doc_id:l n_chars:l",
    """SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY score, doc_id) AS k FROM (SELECT l.doc_id, d.n_chars, CASE WHEN toxic = 0 THEN n_chars END AS score FROM labels l JOIN documents d USING (doc_id)) WHERE score IS NOT NULL)
       WHERE k <= (SELECT count(*) // 2 FROM labels)""",
)
def _(t):
    df = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("score", F.when(F.col("toxic") == 0, F.col("n_chars")))
    return fl.keep_least_toxic_half(df, "score", 1, "doc_id")


@query(
    "p10_filter_knowledge_examples",
    "conv_id:l turn:l",
    """SELECT conv_id, turn FROM (SELECT *, trim(text, E' \n\t') AS k, string_split(text, ' ')[1] AS topic FROM conversations)
       WHERE NOT contains(text, '(') AND contains(text, topic) AND len(regexp_split_to_array(trim(text), '\\s+')) <= 20 AND NOT regexp_matches(text, '^(It|This)\\b')""",
)
def _(t):
    df = t.conversations.withColumn("knowledge", F.col("text")).withColumn("topic", F.split("text", " ")[0])
    return fl.filter_knowledge_examples(df, seen=False)


@query("p11_filter_grounded_responses", "doc_id:l n:l")
def _(t):
    d = t.documents.select("doc_id", F.split("text", " ").alias("w"))
    n = F.floor(F.size("w") * 0.85).cast("int")
    d = d.select("doc_id", F.size("w").alias("n"), F.slice("w", F.lit(1), n).alias("knowledge_tokens"), F.col("w").alias("response_tokens"))
    return fl.filter_grounded_responses(d, hi=0.95)


@query("p12_subsample", "doc_id:l")
def _(t):
    return fl.subsample(t.documents, 0.3, 5, "doc_id")


@query(
    "p13_limit_per_class",
    "label:l vec_id:l",
    """WITH c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) AS k, count(*) OVER () AS total FROM embeddings GROUP BY label)
       SELECT label, vec_id FROM (SELECT e.label, vec_id, n, row_number() OVER (PARTITION BY e.label ORDER BY vec_id) AS i FROM embeddings e JOIN c ON c.label = e.label AND c.k <= greatest(1, floor(total * 0.5))) WHERE i <= greatest(1, floor(n * 0.4))""",
)
def _(t):
    return fl.limit_per_class(t.embeddings.select("label", "vec_id"), "label", "vec_id", 0.5, 0.4)


@query(
    "p15_check_contigs",
    "chrom:s",
    "SELECT DISTINCT 'chr' || doc_id AS chrom FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)",
)
def _(t):
    regions = t.labels.select(F.concat(F.lit("chr"), F.col("doc_id").cast("string")).alias("chrom"))
    return fl.check_contigs(regions, t.seqs.filter("len > 500"))


@query("j12_ensemble_join", "doc_id:l a:d b:d", "SELECT doc_id, quality * 0.5 + toxic * 0.25 AS a, (1 - quality) * 0.5 + toxic * 0.75 AS b FROM labels")
def _(t):
    one = t.labels.select("doc_id", (F.col("quality") * 0.5).alias("a"), ((1 - F.col("quality")) * 0.5).alias("b"))
    two = t.labels.select("doc_id", (F.col("toxic") * 0.25).alias("a"), (F.col("toxic") * 0.75).alias("b"))
    return jn.ensemble_join({"m1": one, "m2": two}, "doc_id", ["a", "b"])


@query(
    "j13_zip_by_line",
    "line_no:l a:s b:s",
    "SELECT conv_id * 1000 + turn AS line_no, a.text AS a, b.text AS b FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') a JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') b USING (conv_id, turn)",
)
def _(t):
    c = t.conversations
    a = c.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.col("text").alias("a"))
    b = c.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("line_no"), F.col("text").alias("b"))
    return jn.zip_by_line(a, b)


@query(
    "j14_split_by_topic",
    "doc_id:l seen:b",
    "SELECT doc_id, source IN (SELECT source FROM documents WHERE n_chars > 10000) AS seen FROM documents WHERE n_chars <= 10000",
)
def _(t):
    train, test = t.documents.filter("n_chars <= 10000"), t.documents.filter("n_chars > 10000")
    seen, rest = jn.split_by_topic(train, test, "source")
    return seen.withColumn("seen", F.lit(True)).unionByName(rest.withColumn("seen", F.lit(False)))


@query(
    "j15_lookup_passages",
    "q:l passage_id:l text:s missing:b",
    "SELECT doc_id AS q, doc_id % 60 AS passage_id, text, text IS NULL AS missing FROM (SELECT doc_id FROM labels) l LEFT JOIN benchmark ON item_id = doc_id % 60",
)
def _(t):
    hits = t.labels.select(F.col("doc_id").alias("q"), (F.col("doc_id") % 60).alias("passage_id"))
    return jn.lookup_passages(hits, t.benchmark.select(F.col("item_id").alias("passage_id"), "text"))


@query("u01_union_shards", "l_orderkey:l l_linenumber:l v:d", "SELECT l_orderkey, l_linenumber, l_tax AS v FROM lineitem")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_tax").alias("v"), "l_returnflag")
    return se.union_shards([li.filter(F.col("l_returnflag") == f) for f in ("A", "N", "R")])


@query(
    "u02_union_wide",
    "k:l a:s b:s",
    "SELECT doc_id AS k, printf('%.4f', quality * 0.5) AS a, 'NA' AS b FROM labels UNION ALL SELECT doc_id, 'NA', printf('%.4f', toxic * 0.25) FROM labels",
)
def _(t):
    a = t.labels.select(F.col("doc_id").alias("k"), (F.col("quality") * F.lit(0.5)).alias("a"))
    b = t.labels.select(F.col("doc_id").alias("k"), (F.col("toxic") * F.lit(0.25)).alias("b"))
    return se.union_wide([a, b])


@query(
    "u03_first_wins",
    "conv_id:l turn:l text:s",
    "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS k FROM conversations) WHERE k = 1",
)
def _(t):
    return se.first_wins(t.conversations, "conv_id", ["role", "turn"])


@query("u04_drop_duplicate_windows", "l_orderkey:l l_linenumber:l", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return se.drop_duplicate_windows(t.lineitem, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("u05_common_ids", "doc_id:l", "SELECT doc_id FROM documents WHERE n_chars > 300 INTERSECT SELECT doc_id FROM labels")
def _(t):
    return se.common_ids(t.documents.filter("n_chars > 300"), t.labels, "doc_id")


@query("u05_missing_ids", "doc_id:l", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return se.missing_ids(t.documents, t.labels, "doc_id")


@query(
    "u06_upsert",
    "task:l layer:l score:d",
    """WITH old AS (SELECT l_suppkey AS task, l_linenumber AS layer, max(l_tax) AS score FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
            new AS (SELECT l_suppkey AS task, l_linenumber AS layer, max(l_discount) AS score FROM lineitem WHERE l_linenumber >= 4 GROUP BY 1, 2)
       SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.task = old.task AND new.layer = old.layer)""",
)
def _(t):
    g = lambda df, c: df.groupBy(F.col("l_suppkey").alias("task"), F.col("l_linenumber").alias("layer")).agg(F.max(c).alias("score"))
    return se.upsert(g(t.lineitem.filter("l_linenumber <= 4"), "l_tax"), g(t.lineitem.filter("l_linenumber >= 4"), "l_discount"), ["task", "layer"])


@query("u07_merge_unique", "vec_id:l label:l", "SELECT vec_id, label FROM embeddings")
def _(t):
    e = t.embeddings.select("vec_id", "label")
    return se.merge_unique([e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")], "vec_id")


@query(
    "u08_partition_slice",
    "doc_id:l",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i >= (n * 3) // 7 AND i < (n * 4) // 7",
)
def _(t):
    return se.partition_slice(t.documents.select("doc_id"), 3, 7, "doc_id")


@query(
    "u09_union_indexed",
    "name:s doc_id:l local_index:l global_index:l",
    """SELECT lang AS name, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS local_index, row_number() OVER (ORDER BY lang, doc_id) - 1 AS global_index
       FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')""",
)
def _(t):
    d = t.documents.select("doc_id", "lang")
    sets = {k: d.filter(F.col("lang") == k).select("doc_id") for k in ("en", "fr", "de", "es")}
    return se.union_indexed(sets | {"xx": sets["en"]}, sets, "doc_id")


@query(
    "t05_take_every",
    "o_orderkey:l",
    "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE (k - 1) % 5 = 0 AND k <= 200",
)
def _(t):
    return se.take_every(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 5, 40, "o_orderkey")


@query(
    "t07_order_by_work",
    "source:s work:l",
    "SELECT source, count(*) * 2 * max(n_chars) AS work FROM documents GROUP BY 1",
)
def _(t):
    d = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("samples"), F.lit(2).alias("seqs"), F.max("n_chars").alias("longest"))
    return se.order_by_work(d, "samples", "seqs", "longest")


@query("p07_standardize_id", "SampleID:s quality:l", 'SELECT CAST(doc_id AS VARCHAR) AS "SampleID", quality FROM labels')
def _(t):
    raw = t.labels.select(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" ")).alias("sample_id"), "quality")
    return standardize_id(require_columns(raw, ["quality"]))
