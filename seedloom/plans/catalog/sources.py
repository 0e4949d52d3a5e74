"""Readers and writers, on files that Spark first writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.functions import dna
from seedloom.operators import variants as vr
from seedloom.plans.registry import query
from seedloom.session import scratch_path, settle
from seedloom.sources import corpora as cp
from seedloom.sources import genome as gm
from seedloom.sources import matrix as mx
from seedloom.sources import tables as tb


def as_text(t, df, name, ext="txt", **options):
    """Write a one-column table as text files and return their folder."""
    path = f"{scratch_path(t.spark, name)}.{ext}"
    writer = df.write
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.text(path)
    return path


def with_header(t, header, rows):
    """Lines (``value``) with a header at the top of each file that a task writes, and a file with the header alone."""
    first = F.col("_id").bitwiseAND((1 << 33) - 1) == 0
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    rows = rows.select(F.when(first, F.concat(F.lit(header + "\n"), "value")).otherwise(F.col("value")).alias("value"))
    return t.region.limit(1).select(F.lit(header).alias("value")).unionByName(rows)


LETTERS = "regexp_replace(text, '[^A-Za-z]', 'N', 'g')"


def letters(t):
    """Documents as base strings: everything but Latin letters reads N."""
    return t.documents.select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "N").alias("bases"))


@query("s01_read_fasta", "seqid:s len:l bases:s", f"SELECT 'seq' || doc_id AS seqid, length(text) AS len, upper({LETTERS}) AS bases FROM documents")
def _(t):
    lines = F.array_join(F.regexp_extract_all("bases", F.lit("(.{1,60})"), F.lit(1)), "\n")
    rec = letters(t).select(F.concat(F.lit(">seq"), F.col("doc_id").cast("string"), F.lit(" d=1\n"), lines).alias("value"))
    chunks = settle(gm.read_fasta(t.spark, as_text(t, rec, "fasta", "fa"), chunk=600, upper=True))
    item = F.struct("chunk_start", "bases")
    record = ["file", "record_no", "seqid"]
    out = chunks.groupBy(*record).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["bases"]), "").alias("bases"))
    return out.join(gm.sequence_lengths(chunks), record)


@query(
    "s01_read_fasta_files",
    "seqid:s len:l bases:s",
    f"SELECT 'seq' || doc_id // 2 AS seqid, length(text) AS len, {LETTERS} AS bases FROM documents UNION ALL SELECT 'none' || doc_id // 2, 0, '' FROM documents",
)
def _(t):
    """Two folders of files that use the same names, each record followed by one without bases."""
    k = (F.col("doc_id") / 2).cast("long").cast("string")
    rec = letters(t).select(F.concat(F.lit(">seq"), k, F.lit("\n"), F.col("bases"), F.lit("\n>none"), k).alias("value"), (F.col("doc_id") % 2).alias("half"))
    path = scratch_path(t.spark, "fasta-files")
    rec.write.partitionBy("half").text(path)
    chunks = settle(gm.read_fasta(t.spark, path, chunk=1 << 20))
    item = F.struct("chunk_start", "bases")
    record = ["file", "record_no", "seqid"]
    out = chunks.groupBy(*record).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["bases"]), "").alias("bases"))
    return out.join(gm.sequence_lengths(chunks), record)


def vcf_rows(t):
    """Parts as variants, with two samples whose genotypes come from the key."""
    k = F.col("p_partkey")
    chrom = F.concat(F.lit("chr"), (k % 3 + 1).cast("string"))
    ref = F.when(k % 4 == 2, "CG").otherwise("C")
    alt = F.when(k % 4 == 0, "T").when(k % 4 == 1, "CTT").when(k % 4 == 2, "C").otherwise("A,<DEL>")
    g1 = F.when(k % 5 == 0, "0/0").when(k % 5 == 1, "0|1").when(k % 5 == 2, "./.").otherwise("1/1:12")
    g2 = F.when(k % 4 == 3, "1/2").otherwise("0/1")
    return t.part.select(F.concat_ws("\t", chrom, (k * 10 + 1).cast("string"), F.lit("."), ref, alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), g1, g2).alias("value"))


def vcf(t):
    head = t.region.limit(1).select(F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"))).alias("value"))
    return as_text(t, head.unionByName(vcf_rows(t)), "vcf", "vcf")


CALLS = """SELECT 'chr' || (k % 3 + 1) AS chrom, k * 10 + 1 AS pos, CASE WHEN k % 4 = 2 THEN 'CG' ELSE 'C' END AS ref, sample,
    CASE WHEN sample = 's1' THEN CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 1 END ELSE CASE WHEN k % 4 = 3 THEN 2 ELSE 1 END END AS top, k
    FROM (SELECT p_partkey AS k FROM part), (SELECT unnest(['s1', 's2']) AS sample)"""


@query("s02_read_vcf", "chrom:s pos:l ref:s sample:s top:l", f"SELECT chrom, pos, ref, sample, top FROM ({CALLS}) WHERE (chrom = 'chr1' AND pos > 100 AND pos <= 9000) OR chrom = 'chr2'")
def _(t):
    regions = t.spark.createDataFrame([("Chr1", 100, 9000), ("2", 0, 10**9)], "chrom string, start long, end long")
    return gm.read_vcf(t.spark, vcf(t), regions).withColumn("top", F.greatest("a1", "a2"))


@query(
    "s02_read_vcf_files",
    "chrom:s pos:l ref:s sample:s top:l n:l",
    f"SELECT chrom, pos, ref, file || sample AS sample, top, count(*) AS n FROM ({CALLS}), (SELECT unnest(['a', 'b']) AS file) WHERE chrom <> 'chr3' GROUP BY ALL",
)
def _(t):
    """Two files with samples of their own; every call is there twice, once per file."""
    path = scratch_path(t.spark, "vcf-files")
    for name in ("a", "b"):
        cols = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
        rows = vcf_rows(t).agg(F.concat_ws("\n", F.lit(f"{cols}\t{name}s1\t{name}s2"), F.collect_list("value")).alias("value"))
        rows.write.text(f"{path}/{name}")
    regions = t.spark.createDataFrame([("Chr1", 0, 9000), ("1", 8000, 10**9), ("2", 0, 10**9)], "chrom string, start long, end long")
    out = gm.read_vcf(t.spark, f"{path}/*", regions).withColumn("top", F.greatest("a1", "a2"))
    return out.groupBy("chrom", "pos", "ref", "sample", "top").agg(F.count(F.lit(1)).alias("n"))


ALLELE = "CASE WHEN top = -1 THEN repeat('N', length(ref)) WHEN k % 4 = 0 THEN 'T' WHEN k % 4 = 1 THEN 'CTT' WHEN k % 4 = 2 THEN 'C' WHEN top = 2 THEN 'N' ELSE 'A' END"


@query(
    "x03_called_allele",
    "chrom:s pos:l sample:s allele:s kind:s",
    f"SELECT chrom, pos, sample, {ALLELE} AS allele, CASE WHEN top = -1 THEN 'COMPLEX' WHEN k % 4 = 0 THEN 'SNP' WHEN k % 4 = 1 THEN 'INS' WHEN k % 4 = 2 OR top = 2 THEN 'DEL' ELSE 'SNP' END AS kind FROM ({CALLS}) WHERE top <> 0",
)
def _(t):
    return vr.call_variants(gm.read_vcf(t.spark, vcf(t)))


@query("x02_classify_variant", "p_partkey:l kind:s", "SELECT p_partkey, CASE WHEN length(p_type) = 5 AND length(p_brand) = 7 THEN 'SNP' WHEN length(p_type) = 5 THEN 'INS' WHEN length(p_brand) = 7 THEN 'DEL' ELSE 'COMPLEX' END AS kind FROM part")
def _(t):
    ref = F.substring(F.col("p_type"), F.lit(5), F.length("p_type"))
    alt = F.substring(F.col("p_brand"), F.lit(7), F.length("p_brand"))
    return t.part.select("p_partkey", dna.classify_variant(ref, alt).alias("kind"))


@query(
    "x04_apply_variants",
    "doc_id:l sequence:s n:l last:l",
    f"""SELECT doc_id, CASE WHEN n >= 30 THEN substr(b, 1, 4) || 'T' || substr(b, 6, 5) || substr(b, 11, 1) || 'GG' || substr(b, 12, 8) || 'CN' || substr(b, 22) ELSE b END AS sequence,
          CASE WHEN n >= 30 THEN n + 2 ELSE n END AS n, 100 + n AS last FROM (SELECT doc_id, {LETTERS} AS b, length(text) AS n FROM documents)""",
)
def _(t):
    # a SNP at base 5, an insertion of two bases after base 11, a two-base deletion at 20
    w = letters(t).withColumn("start", F.lit(101).cast("long"))
    edits = F.array(
        F.struct(F.lit(105).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("allele"), F.lit("SNP").alias("kind")),
        F.struct(F.lit(111).cast("long").alias("pos"), F.substring("bases", 11, 1).alias("ref"), F.concat(F.substring("bases", 11, 1), F.lit("GG")).alias("allele"), F.lit("INS").alias("kind")),
        F.struct(F.lit(120).cast("long").alias("pos"), F.lit("CG").alias("ref"), F.lit("C").alias("allele"), F.lit("DEL").alias("kind")),
        F.struct(F.lit(90).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("allele"), F.lit("SNP").alias("kind")),
    )
    v = w.filter(F.length("bases") >= 30).select("doc_id", F.explode(edits).alias("e")).select("doc_id", "e.*")
    out = vr.apply_variants(w, v, by="doc_id")
    return out.select("doc_id", "sequence", F.size("pos_list").alias("n"), F.element_at("pos_list", -1).alias("last"))


@query("s03_read_bed", "chrom:s start:l end:l n:l", """SELECT chrom, start, "end", 1 AS n FROM genes""")
def _(t):
    g = t.genes
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    bed = gm.read_bed(t.spark, as_text(t, g.select(F.when(F.col("gene_id") % 50 == 0, F.concat(F.lit("# note\n\n"), line)).otherwise(line).alias("value")), "bed", "bed"))
    # block numbers are dense from 1 in every file
    return bed.withColumn("n", F.when(F.col("block_no") > 0, 1).otherwise(0))


@query("s04_read_gff", "gene_id:s name:s seqid:s start:l end:l strand:s", """SELECT 'g' || gene_id AS gene_id, label AS name, 'Chr0' || (gene_id % 3) AS seqid, start, "end", '+' AS strand FROM genes WHERE gene_id % 2 = 0 AND gene_id % 3 = 1""")
def _(t):
    k = F.col("gene_id")
    id_ = F.concat(F.lit("g"), k.cast("string"))
    attrs = F.when(k % 4 == 0, F.concat(F.lit("ID="), id_, F.lit(";Name="), F.col("label"))).otherwise(F.concat(F.lit('gene_id "'), id_, F.lit('"; gene_name "'), F.col("label"), F.lit('";')))
    line = F.concat_ws("\t", F.concat(F.lit("Chr0"), (k % 3).cast("string")), F.lit("src"), F.when(k % 2 == 0, "gene").otherwise("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    path = as_text(t, t.genes.select(line.alias("value")), "gff", "gff", compression="gzip")
    return gm.genes_of(gm.read_gff(t.spark, path, "gene", "chr1"))


@query("s05_signal_tables", "track:s chrom:s start:l end:l value:d", """SELECT 'all' AS track, chrom, start, "end", max(value) AS value FROM signal GROUP BY 2, 3, 4""")
def _(t):
    s = t.signal.groupBy("chrom", "start", "end").agg(F.max("value").alias("value"))
    line = F.concat_ws("\t", "chrom", *[F.col(c).cast("string") for c in ("start", "end", "value")])
    track = gm.read_signal(t.spark, as_text(t, s.select(line.alias("value")), "track", "bedgraph"), "all")
    out = f"{scratch_path(t.spark, 'signal')}.parquet"
    gm.write_signal(track, out)
    return gm.read_signal(t.spark, out)


@query("s06_read_chrom_sizes", "chrom:s size:l", "SELECT 'seq' || doc_id AS chrom, n_chars AS size FROM documents")
def _(t):
    line = F.concat(F.lit("seq"), F.col("doc_id").cast("string"), F.lit("\t"), F.col("n_chars").cast("string"))
    return gm.read_chrom_sizes(t.spark, as_text(t, t.documents.select(line.alias("value")), "sizes"))


@query("s07_read_labelled_jsonl", "first:s n:l label:ad", "SELECT text AS first, 2 AS n, [quality, toxic] AS label FROM labels JOIN documents USING (doc_id)")
def _(t):
    d = t.labels.join(t.documents, "doc_id").select(F.to_json(F.struct(F.col("text").alias("sequence1"), F.col("lang").alias("sequence2"), F.array("quality", "toxic").alias("label"))).alias("value"))
    out = tb.read_labelled_jsonl(t.spark, as_text(t, d, "labelled", "jsonl"))
    return out.select(F.col("sequences")[0].alias("first"), F.size("sequences").alias("n"), "label")


@query("s08_read_table_loose", "SampleID:s Trait:l", 'SELECT CAST(doc_id AS VARCHAR) AS "SampleID", quality AS "Trait" FROM labels')
def _(t):
    k, q = F.col("doc_id").cast("string"), F.col("quality").cast("string")
    # the head line sorts first in a single small file
    rows = t.labels.select(F.when(F.col("doc_id") % 2 == 0, F.concat(k, F.lit(","), q)).otherwise(F.concat(k, F.lit("   "), q)).alias("value"))
    head = t.region.limit(1).select(F.lit("sample_id Trait").alias("value"))
    return tb.read_table_loose(t.spark, as_text(t, head.unionByName(rows).coalesce(1), "pheno"))


@query("s09_read_position_matrix", "sample_id:s position:l value:d", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, position, value FROM matrix WHERE position BETWEEN 10 AND 20")
def _(t):
    path = scratch_path(t.spark, "matrix")
    mx.write_position_matrix(t.matrix, path, list(range(1, 65)), gz=True)
    return mx.read_position_matrix(t.spark, path, 10, 20)


@query("s09_read_block_matrices", "sample_id:s position:l value:d", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, position, value FROM matrix")
def _(t):
    """One file per block of positions, each with its own header."""
    path = scratch_path(t.spark, "blocks")
    for i in range(4):
        mx.write_position_matrix(t.matrix, f"{path}/{i}", list(range(16 * i + 1, 16 * i + 17)))
    return mx.read_position_matrix(t.spark, f"{path}/*")


@query("s10_write_position_matrix", "sample_id:l pos_3:d pos_70:d", "SELECT sample_id, value AS pos_3, NULL AS pos_70 FROM matrix WHERE position = 3")
def _(t):
    return mx.widen_positions(t.matrix, [3, 70])


@query("s11_read_predictions", "chromosome:s start:l end:l predicted_expression:ad true_expression:ad", "SELECT lang AS chromosome, doc_id AS start, doc_id + 2 AS \"end\", [n_chars / 4.0, 1.5] AS predicted_expression, [0.25, n_chars] AS true_expression FROM documents")
def _(t):
    n = F.col("n_chars").cast("double")
    df = t.documents.select(
        F.col("lang").alias("chromosome"), F.col("doc_id").alias("start"), (F.col("doc_id") + 2).alias("end"),
        F.to_json(F.array(n / 4, F.lit(1.5))).alias("predicted_expression"), F.to_json(F.array(F.lit(0.25), n)).alias("true_expression"),
    )
    path = scratch_path(t.spark, "predictions")
    df.write.option("header", True).option("escape", '"').csv(path)
    return tb.read_predictions(t.spark, path)


@query("s12_write_predictions", "biosample:s modality:s chromosome:s start:l", "SELECT DISTINCT l_linestatus AS biosample, CAST(l_linenumber AS VARCHAR) AS modality, l_returnflag AS chromosome, l_orderkey AS start FROM lineitem")
def _(t):
    df = t.lineitem.select(F.col("l_linestatus").alias("biosample"), F.col("l_linenumber").alias("modality"), F.col("l_returnflag").alias("chromosome"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 1).alias("end"))
    path = scratch_path(t.spark, "written")
    tb.write_predictions(df, path)
    return t.spark.read.parquet(path)


@query("s13_write_index", "chrom:s start:l end:l total:l", "SELECT source AS chrom, doc_id AS start, doc_id + n_chars AS \"end\", count(*) OVER () AS total FROM documents")
def _(t):
    idx = t.documents.select(F.col("source").alias("chrom"), F.col("doc_id").alias("start"), (F.col("doc_id") + F.col("n_chars")).alias("end"))
    path = scratch_path(t.spark, "index")
    tb.write_index(idx, path, idx.agg(F.count(F.lit(1)).alias("windows")))
    stats = t.spark.read.schema("windows long").json(f"{path}/statistics")
    out = t.spark.read.option("header", True).schema("chrom string, start long, end long").csv(f"{path}/index")
    from seedloom.operators.base import attach_row

    return attach_row(out, stats.select(F.col("windows").alias("total")))


@query("s14_read_corpus_jsonl", "text:as title:as", "SELECT [text, 'end'] AS text, [lang] AS title FROM documents")
def _(t):
    d = t.documents.select(F.to_json(F.struct(F.array("text", F.lit("end")).alias("text"), F.col("lang").alias("title"))).alias("value"))
    return cp.read_corpus_jsonl(t.spark, as_text(t, d, "corpus", "jsonl", compression="gzip"), ["text", "title"])


@query("s15_token_tables", "doc_id:l dataset:s length:l", "SELECT doc_id, 'a' AS dataset, len(toks) AS length FROM tokens UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM tokens), 'b', len(toks) FROM tokens WHERE doc_id % 2 = 0")
def _(t):
    rows = t.tokens.select("doc_id", F.lit(0).alias("seq_no"), F.transform("toks", lambda w: F.length(w)).alias("tokens"))
    paths = {n: scratch_path(t.spark, f"tokens-{n}") for n in ("a", "b")}
    cp.write_token_table(rows, paths["a"], "a")
    cp.write_token_table(rows.filter("doc_id % 2 = 0"), paths["b"], "b")
    return cp.append_token_tables({n: t.spark.read.parquet(p) for n, p in paths.items()})


FLAT_TEXT = "replace(replace(text, chr(10), ' '), chr(9), ' ')"


@query("s16_read_passages_tsv", "id:l text:s title:s", f"SELECT doc_id AS id, {FLAT_TEXT} AS text, source AS title FROM documents WHERE n_chars > 0")
def _(t):
    flat = F.translate("text", "\n\t", "  ")
    rows = t.documents.filter("n_chars > 0").select(F.concat_ws("\t", F.col("doc_id").cast("string"), flat, "source").alias("value"))
    return cp.read_passages_tsv(t.spark, as_text(t, with_header(t, "id\ttext\ttitle", rows), "passages", "tsv", maxRecordsPerFile=0))


@query("s17_read_qa", "question:s answers:as", "SELECT source || doc_id AS question, [lang, 'it''s'] AS answers FROM documents")
def _(t):
    rows = t.documents.select(F.concat("source", F.col("doc_id").cast("string"), F.lit("\t['"), "lang", F.lit("', \"it's\"]")).alias("value"))
    return cp.read_qa(t.spark, as_text(t, rows, "qa", "tsv"))


@query("s18_read_pair_tsv", "uid:l text_a:s text_b:s label:l", "SELECT doc_id AS uid, source AS text_a, lang AS text_b, doc_id % 2 AS label FROM documents WHERE doc_id % 5 <> 0")
def _(t):
    k = F.col("doc_id").cast("string")
    row = F.concat_ws("\t", k, F.lit("1"), F.lit("2"), "source", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")), (F.col("doc_id") % 2).cast("string"))
    lines = with_header(t, "id\tqid1\tqid2\tquestion1\tquestion2\tis_duplicate", t.documents.select(row.alias("value")))
    return cp.read_pair_tsv(t.spark, as_text(t, lines, "pairs", "tsv", maxRecordsPerFile=0), "QQP")


@query("s19_read_reading_comp", "question_no:l first:s second:s label:l", "SELECT 0 AS question_no, 'is ' || lang || ' it' AS first, 'is ' || source || ' it' AS second, 1 AS label FROM documents UNION ALL SELECT 1, 'who? ' || source, 'who? ' || lang, 0 FROM documents")
def _(t):
    rec = F.struct(
        F.col("text").alias("article"), F.array(F.lit("is _ it"), F.lit("who?")).alias("questions"),
        F.array(F.array("lang", "source"), F.array("source", "lang")).alias("options"), F.array(F.lit("B"), F.lit("A")).alias("answers"),
    )
    out = cp.read_reading_comp(t.spark, as_text(t, t.documents.select(F.to_json(rec).alias("value")), "race"))
    return out.select("question_no", F.col("candidates")[0].alias("first"), F.col("candidates")[1].alias("second"), "label")


@query(
    "s20_read_dialogues",
    "turn:l role:s topic:s knowledge:s text:s",
    """SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, CASE WHEN role = 'assistant' THEN 'wizard' ELSE 'apprentice' END AS role, CASE WHEN role = 'assistant' THEN 'page' ELSE 'topic' || conv_id END AS topic,
       CASE WHEN role = 'assistant' THEN 'fact' ELSE 'no_passages_used' END AS knowledge, text FROM conversations""",
)
def _(t):
    none = F.create_map().cast("map<string,string>")

    def turn(s):
        wiz = s["role"] == "assistant"
        given = lambda v: F.when(wiz, F.create_map(F.lit("k"), F.lit(v))).otherwise(none)
        return F.struct(
            F.when(wiz, "0_Wizard").otherwise("1_Apprentice").alias("speaker"), s["text"].alias("text"),
            given("fact").alias("checked_sentence"), given("page").alias("checked_passage"),
        )

    c = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), turn).alias("dialog"))
    path = scratch_path(t.spark, "dialogues")
    c.select(F.concat(F.lit("topic"), F.col("conv_id").cast("string")).alias("chosen_topic"), "dialog").write.json(path)
    return cp.read_dialogues(t.spark, path, lines=True)


@query("s21_read_metric_files", "sample:s checkpoint:l acc:d f1:d", "SELECT 's' || l_suppkey % 10 AS sample, l_linenumber AS checkpoint, avg(l_discount) AS acc, avg(l_tax) AS f1 FROM lineitem GROUP BY 1, 2")
def _(t):
    root = scratch_path(t.spark, "metrics")
    rows = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("task"), F.col("l_linenumber").alias("layer")).agg(F.avg("l_discount").alias("acc"), F.avg("l_tax").alias("f1"))
    rows = rows.select(
        F.concat(F.lit("s"), F.col("task").cast("string"), F.lit(".checkpoint-"), F.col("layer").cast("string")).alias("d"),
        F.concat(F.lit("acc: "), F.format_string("%.12f", F.col("acc")), F.lit("\nf1: "), F.format_string("%.12f", F.col("f1")), F.lit("\nnote\n")).alias("value"),
    )
    # one folder per sample and checkpoint: test/d=<name>/part-..., read back by its name
    rows.write.partitionBy("d").text(f"{root}/test")
    out = tb.read_metric_files(t.spark, f"{root}/test")
    wide = tb.widen_metrics(out, ["acc", "f1"])
    return wide.withColumn("sample", F.regexp_replace("sample", "^d=", ""))


@query("x07_parse_attributes", "gene_id:l id:s note:s", "SELECT gene_id, 'g' || gene_id AS id, label AS note FROM genes")
def _(t):
    from seedloom.functions.names import parse_attributes

    id_ = F.concat(F.lit("g"), F.col("gene_id").cast("string"))
    text = F.when(F.col("gene_id") % 2 == 0, F.concat(F.lit("ID="), id_, F.lit("; Note="), F.col("label"), F.lit(";"))).otherwise(F.concat(F.lit('ID "'), id_, F.lit('"; Note "'), F.col("label"), F.lit('";')))
    df = t.genes.select("gene_id", parse_attributes(text).alias("m"))
    return df.select("gene_id", F.element_at("m", "ID").alias("id"), F.element_at("m", "Note").alias("note"))
