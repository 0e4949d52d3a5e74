"""File layouts that no given table stands in for."""

import json

from pyspark.sql import functions as F

from seedloom.operators import tracks as tr
from seedloom.operators import variants as vr
from seedloom.sources import corpora as cp
from seedloom.sources import genome as gm
from seedloom.sources import matrix as mx
from seedloom.sources import tables as tb


def test_mnli_pairs(spark, tmp_path):
    head = "\t".join(["index", "p", "g", "a", "b", "c", "d", "e", "sentence1", "sentence2", "l1", "gold"])
    good = "\t".join(["7", "x", "x", "x", "x", "x", "x", "x", "one", "two", "neutral", "entailment"])
    bad = "\t".join(["8", "x", "x", "x", "x", "x", "x", "x", "one", "", "neutral", "entailment"])
    (tmp_path / "train.tsv").write_text("\n".join([head, good, bad, "short\trow"]) + "\n")
    assert [tuple(r) for r in cp.read_pair_tsv(spark, str(tmp_path / "train.tsv"), "MNLI").collect()] == [(7, "one", "two", 1)]


def test_search_dialogues(spark, tmp_path):
    d = {
        "apprentice_persona": "p",
        "dialog_history": [
            {"action": "Apprentice => Wizard", "text": "hi", "context": None},
            {"action": "Wizard => SearchAgent", "text": "q", "context": None},
            {
                "action": "Wizard => Apprentice", "text": "yo",
                "context": {"contents": [{"title": "T", "content": ["a", "b"]}], "selected_contents": [[False], [False, True]]},
            },
        ],
    }
    (tmp_path / "d.json").write_text(json.dumps([d]))
    out = cp.read_dialogues(spark, str(tmp_path / "d.json"), "search").orderBy("turn").collect()
    assert [(r["role"], r["topic"], r["knowledge"]) for r in out] == [("apprentice", "no_topic", "no_passages_used"), ("wizard", "T", "b")]


def test_qa_json(spark, tmp_path):
    q = [{"question": "q", "answers": ["a"], "positive_ctxs": [{"title": "t", "text": "x", "passage_id": "3", "score": 1.0}], "negative_ctxs": [], "hard_negative_ctxs": []}]
    (tmp_path / "qa.json").write_text(json.dumps(q))
    r = cp.read_qa(spark, str(tmp_path / "qa.json")).first()
    assert r["positive_ctxs"][0]["passage_id"] == "3" and r["answers"] == ["a"]


def test_fasta_chunks_keep_offsets(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">1 first\nACGT\nACGT\nAC\n>Chr2\nNNNN\n")
    out = gm.read_fasta(spark, str(tmp_path / "x.fa"), chunk=8).orderBy("seqid", "chunk_no").collect()
    assert [(r["seqid"], r["chunk_start"], r["bases"]) for r in out] == [("1", 0, "ACGTACGT"), ("1", 8, "AC"), ("Chr2", 0, "NNNN")]


def test_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "fa").mkdir()
    (tmp_path / "fa" / "a.fa").write_text(">c1\nAAAA\n>empty\n>c1\nGG\n")
    (tmp_path / "fa" / "b.fa").write_text(">c1\nCC\nCC\n")
    out = gm.read_fasta(spark, str(tmp_path / "fa"))
    assert sorted((r["seqid"], r["bases"]) for r in out.collect()) == [("c1", "AAAA"), ("c1", "CCCC"), ("c1", "GG"), ("empty", "")]
    assert sorted(r["len"] for r in gm.sequence_lengths(out).collect()) == [0, 2, 4, 4]
    (tmp_path / "vcf").mkdir()
    for name in ("s1", "s2"):
        head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + name
        (tmp_path / "vcf" / f"{name}.vcf").write_text(head + "\nchr1\t5\t.\tA\tT\t.\t.\t.\tGT\t0/1\nchr1\t9\t.\tA\tT\t.\t.\t.\tGT\t1/1\n")
    regions = spark.createDataFrame([("1", 0, 6), ("chr1", 2, 20)], "chrom string, start long, end long")
    got = gm.read_vcf(spark, str(tmp_path / "vcf"), regions).collect()
    assert sorted((r["sample"], r["pos"]) for r in got) == [("s1", 5), ("s1", 9), ("s2", 5), ("s2", 9)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("sample_id,pos_1,pos_2\nx,1,2\n")
    (tmp_path / "m" / "b.csv").write_text("sample_id,pos_4,pos_3\nx,4,\ny,NaN,3.5\n")
    got = mx.read_position_matrix(spark, str(tmp_path / "m")).collect()
    assert sorted((r["sample_id"], r["position"], r["value"]) for r in got if r["value"]) == [("x", 1, 1.0), ("x", 2, 2.0), ("x", 4, 4.0), ("y", 3, 3.5)]
    assert len(got) == 6


def test_many_edits_stay_linear(spark):
    n = 4000
    w = spark.createDataFrame([(1, 1, "A" * (3 * n))], "block int, start long, bases string")
    v = spark.range(n).select(F.lit(1).alias("block"), (F.col("id") * 3 + 2).alias("pos"), F.lit("A").alias("ref"), F.lit("ATT").alias("allele"), F.lit("INS").alias("kind"))
    r = vr.apply_variants(w, v, "block").select("sequence", F.size("pos_list").alias("n"), F.element_at("pos_list", -1).alias("last")).first()
    assert r["sequence"] == "AATTA" * n and (r["n"], r["last"]) == (5 * n, 3 * n)


def test_metric_file_names(spark, tmp_path):
    where = tmp_path / "test" / "s1.checkpoint-20"
    where.mkdir(parents=True)
    (where / "metrics.txt").write_text("mae: 0.5\nnote\nr2: 0.25\n")
    rows = {r["metric"]: r for r in tb.read_metric_files(spark, str(tmp_path)).collect()}
    assert rows["mae"]["value"] == 0.5 and (rows["r2"]["split"], rows["r2"]["sample"], rows["r2"]["checkpoint"]) == ("test", "s1", 20)


def test_coverage_normalisations(spark):
    reads = spark.createDataFrame([("c", 0, 60, "+", 9), ("c", 50, 90, "+", 9), ("c", 0, 10, "-", 9), ("c", 0, 10, "+", 0)], "chrom string, start long, end long, strand string, mapq int")
    value = lambda **k: [r["value"] for r in tr.coverage(reads, 50, 1, "+", **k).orderBy("start").collect()]
    assert value() == [1.0, 2.0]
    assert value(norm="CPM") == [5e5, 1e6] and value(norm="RPKM") == [1e7, 2e7]
    assert value(norm="RPGC", genome_size=100) == [1.0, 2.0]
    black = spark.createDataFrame([("c", 80, 200)], "chrom string, start long, end long")
    assert value(blacklist=black) == [1.0, 1.0]
