"""Literal cases: small inputs with known results."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedloom.functions import dna, names, signal, spans, tails
from seedloom.functions import text as tx
from seedloom.operators import answers as an
from seedloom.operators import corpus as co
from seedloom.operators import filters as fl
from seedloom.operators import genes as gn
from seedloom.operators import intervals as iv
from seedloom.operators import metrics as mt
from seedloom.operators import packing as pk
from seedloom.operators import stats as st
from seedloom.operators import tracks as tr
from seedloom.operators import variants as vr


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("n,starts", [(100, [0, 20, 40, 60]), (105, [0, 20, 40, 60, 65]), (30, [])])
def test_sliding_windows(spark, n, starts):
    df = spark.createDataFrame([(n,)], "len long")
    assert [r["start"] for r in iv.sliding_windows(df, 40, 20).orderBy("start").collect()] == starts


def test_stride_windows(spark):
    df = spark.createDataFrame([(0, 10)], "start long, end long")
    assert rows(iv.stride_windows(df, 8, 4).select("start", "end"), "start") == [(0, 8), (4, 10), (8, 10)]


def test_effective_intervals(spark):
    df = spark.createDataFrame([(1, 8), (5, 12), (9, 16)], "start long, end long")
    out = iv.effective_intervals(df).select("eff_start", "eff_end")
    assert rows(out, "eff_start") == [(1, 6), (7, 10), (11, 16)]


def test_effective_intervals_strict(spark):
    df = spark.createDataFrame([(1, 100), (2, 3), (2, 3)], "start long, end long")
    with pytest.raises(Exception):
        iv.effective_intervals(df).collect()
    assert iv.effective_intervals(df, strict=False).count() == 3


def test_overlap_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    a = [(i, "c", int(s), int(s + rng.integers(1, 5000))) for i, s in enumerate(rng.integers(0, 50000, 60))]
    b = [(i, "c", int(s), int(s + rng.integers(1, 900))) for i, s in enumerate(rng.integers(0, 50000, 60))]
    want = sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])
    shape = "id long, chrom string, start long, end long"
    got = iv.overlap_join(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape), closed=False, bin_size=700)
    assert rows(got.select("id", "b_id"), "id", "b_id") == want


def test_reverse_complement(spark):
    assert one(spark, dna.reverse_complement(F.lit("ACGTN"))) == "NACGT"


def test_classify_variant(spark):
    cases = [("A", "G", "SNP"), ("A", "AT", "INS"), ("AT", "A", "DEL"), ("AT", "GC", "COMPLEX")]
    for ref, alt, kind in cases:
        assert one(spark, dna.classify_variant(F.lit(ref), F.lit(alt))) == kind


def test_called_allele(spark):
    for gt, want in [((0, 0), None), ((0, 2), "T"), ((1, 2), "T"), ((-1, -1), "N")]:
        got = one(spark, dna.called_allele(F.lit("A"), F.array(F.lit("G"), F.lit("T")), F.lit(gt[0]), F.lit(gt[1])))
        assert (got and got["allele"]) == want


@pytest.mark.parametrize(
    "pos,ref,allele,kind,seq,coords",
    [
        (12, "C", "CTT", "INS", "ACTTGT", [11, 12, 12, 12, 13, 14]),
        (12, "CG", "C", "DEL", "ACNT", [11, 12, 13, 14]),
        (99, "C", "T", "SNP", "ACGT", [11, 12, 13, 14]),
    ],
)
def test_apply_variants(spark, pos, ref, allele, kind, seq, coords):
    w = spark.createDataFrame([("b", "s", 11, "ACGT")], "block string, sample string, start long, bases string")
    v = spark.createDataFrame([("b", "s", pos, ref, allele, kind)], "block string, sample string, pos long, ref string, allele string, kind string")
    out = vr.apply_variants(w, v).first()
    assert (out["sequence"], out["pos_list"]) == (seq, coords)
    assert out["pos_list_revcomp"] == coords[::-1]


def test_collapse_positions(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0, 6.0], [11, 12, 12, 13], 11, 14)], "id long, scores array<double>, pos_list array<int>, eff_start long, eff_end long")
    out = tr.collapse_positions(df, "id", eff=df.select("id", "eff_start", "eff_end"))
    assert [r["value"] for r in out.orderBy("position").collect()] == [1.0, 3.0, 6.0, 0.0]


def test_nonzero_mean(spark):
    df = spark.createDataFrame([("t", "c", 0, 2, 3.0), ("t", "c", 2, 3, 0.0), ("t", "c", 3, 5, 1.0)], "track string, chrom string, start long, end long, value double")
    assert tr.nonzero_mean(df).first()["mean"] == 2.0


def test_renormalise(spark):
    df = spark.createDataFrame([("t", "c", 0, 100, 2e6)], "track string, chrom string, start long, end long, value double")
    out = tr.renormalise(df)
    assert out.first()["scale"] == 0.5
    assert tr.total_is(out).first()["ok"]


def test_weighted_quantile(spark):
    df = spark.createDataFrame([("t", "c", i, v, w) for i, (v, w) in enumerate([(1.0, 1), (2.0, 1), (3.0, 2)])], "track string, chrom string, start long, value double, w long")
    assert tr.weighted_quantile(df, 0.5).first()["quantile"] == pytest.approx(2.3333333)


def test_average_tracks_and_tail(spark):
    df = spark.createDataFrame([("a", "c", 0, 4, 2.0), ("b", "c", 2, 6, 4.0)], "track string, chrom string, start long, end long, value double")
    assert rows(tr.average_tracks(df), "start") == [("c", 0, 2, 1.0), ("c", 2, 4, 3.0), ("c", 4, 6, 2.0)]
    sizes = spark.createDataFrame([("c", 6)], "chrom string, size long")
    assert rows(tr.average_tracks(df, sizes, step=4), "start") == [("c", 0, 2, 1.0), ("c", 2, 4, 3.0)]


def test_scaling(spark):
    assert one(spark, signal.scale_signal(F.lit(16.0), 1.0)) == pytest.approx(8)
    assert one(spark, signal.scale_signal(F.lit(81.0), 1.0)) == pytest.approx(22.8633535)
    assert one(spark, signal.unscale_signal(F.lit(22.863353450309965), 1.0)) == pytest.approx(81)


def test_bh(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])], "i long, p double")
    got = [r["padj"] for r in st.bh_adjust(df).orderBy("i").collect()]
    assert got[:4] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and got[4] is None


def test_fold_change(spark):
    for a, b, want in [(2.0, 8.0, 2.0), (0.0, 1.0, math.inf), (1.0, 0.0, -math.inf), (0.0, 0.0, 0.0)]:
        assert one(spark, signal.log2_fold_change(F.lit(a), F.lit(b))) == want


def test_combine_directions(spark):
    f = lambda p, q, s: one(spark, signal.combine_directions(F.lit(p), F.lit(q), F.lit(1.0), F.lit(s)))
    assert f(0.01, 0.01, 1.0) == pytest.approx(0.01)
    assert f(0.01, 0.04, 1.0) == pytest.approx(0.08)
    assert f(0.01, 0.01, -1.0) == 1


def test_distribution_metrics(spark):
    v = [0.0, 2.0, 0.0, 1.0, 1.0, 0.0]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(v)], "g string, position long, value double")
    r = st.distribution_metrics(df, "g").first()
    assert (r["peak_count"], r["peak_density"], r["peak_mean"]) == (2, pytest.approx(1 / 3), 1.5)
    e = spark.createDataFrame([("g", i, x) for i, x in enumerate([1.0, 1.0, 2.0])], "g string, position long, value double")
    assert st.distribution_metrics(e, "g").first()["shannon_entropy"] == pytest.approx(1.0397208)


def test_rank_test_exact_and_normal(spark):
    a, b = [1.1, 2.2, 3.3], [4.4, 5.5, 6.6, 7.7]
    df = spark.createDataFrame([("k", 0, x) for x in a] + [("k", 1, x) for x in b], "k string, grp int, value double")
    r = st.mann_whitney(df, "k", "value", F.col("grp") == 0, F.col("grp") == 1, min_n=1, method="exact").first()
    assert r["u"] == 0 and r["pvalue"] == pytest.approx(2 / 35)
    assert st.mann_whitney(df, "k", "value", F.col("grp") == 0, F.col("grp") == 1).first()["pvalue"] is None
    assert list(tails.arrangements(2, 2)) == [1, 1, 2, 1, 1]


def test_association_against_least_squares(spark):
    rng = np.random.default_rng(5)
    n, p, k = 40, 12, 2
    x = rng.normal(size=(n, p))
    y = x[:, 3] * 0.8 + rng.normal(size=n)
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(p)], "sample_id long, position long, value double")
    pheno = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "sample_id long, y double")
    got = {r["position"]: r for r in gn.ols_association(long, pheno, "y", k).collect()}
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    pcs = u[:, :k] * s[:k]
    for j in range(p):
        d = np.column_stack([np.ones(n), x[:, j], pcs])
        beta, *_ = np.linalg.lstsq(d, y, rcond=None)
        res = y - d @ beta
        se = math.sqrt(res @ res / (n - k - 2) * np.linalg.inv(d.T @ d)[1, 1])
        assert got[j]["beta"] == pytest.approx(beta[1], rel=1e-6)
        assert got[j]["t"] == pytest.approx(beta[1] / se, rel=1e-6)
    scores = {r["sample_id"]: r["pcs"] for r in gn.sample_pcs(long, k).collect()}
    ours = np.array([scores[i] for i in range(n)])
    assert np.allclose(np.abs((ours * pcs).sum(0)), (pcs * pcs).sum(0), rtol=1e-6)
    scores = {r["sample_id"]: r["pcs"] for r in gn.sample_pcs(long, k, "power", extra=6, rounds=12).collect()}
    ours = np.array([scores[i] for i in range(n)])
    assert np.allclose(np.abs((ours * pcs).sum(0)), (pcs * pcs).sum(0), rtol=1e-3)


def test_student_tail():
    assert tails.t_test_p(pd.Series([2.2281388520]), pd.Series([10.0]))[0] == pytest.approx(0.05, abs=1e-9)


def test_quantile_normalisation_is_monotone(spark):
    df = spark.createDataFrame([(i, float(i * i), float(i)) for i in range(50)], "id long, pred double, raw double")
    out = gn.normalize_fold_change(df, "quantile").orderBy("id").toPandas()
    assert (out["pred"].diff().dropna() > 0).all() and np.allclose(out["log2fc"], 0, atol=1e-9)


def test_zero_metrics(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.4, 0.0), (0.35, 1.0), (0.8, 1.0)], "pred double, truth double")
    r = mt.zero_inflated_metrics(df).first()
    assert r["zero_auroc"] == pytest.approx(0.75) and r["nonzero_auprc"] == pytest.approx(0.8333333)


def test_split_ratio_and_blend(spark):
    df = spark.range(10)
    out = pk.split_ratio(df, "8,1,1", "id").groupBy("split").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    assert rows(out, "a") == [("train", 0, 7), ("valid", 8, 8), ("test", 9, 9)]
    assert rows(pk.blend_exhaustive(spark, [2, 1]).select("dataset_id"), "position") == [(0,), (1,), (0,)]
    got = pk.blend(spark, [0.5, 0.3, 0.2], 101).groupBy("dataset_id").count().collect()
    assert all(abs(r["count"] - 101 * [0.5, 0.3, 0.2][r["dataset_id"]]) <= 1 for r in got)
    assert pk.intersect_splits(pk.split_fractions("9,1,0"), pk.split_fractions("1,0,0")) == [(0.0, 0.9), None, None]
    assert pk.blend_sizes([1, 1], 5, 0.5) == [5, 5]
    with pytest.raises(ValueError):
        pk.blend_sizes([1, 1], 10, available=[1, 9])
    assert pk.parse_blend(["1", "a", "2", "b"]) == [(1.0, "a"), (2.0, "b")]


def test_pack(spark):
    docs = spark.createDataFrame([(0, list(range(5))), (1, list(range(5, 8))), (2, list(range(8, 12)))], "doc_id long, tokens array<int>")
    assert rows(pk.pack_sequences(docs, 4), "sample_id") == [(0, [0, 1, 2, 3, 4]), (1, [4, 5, 6, 7, 8])]
    kept = rows(pk.pack_sequences(docs, 4, keep_partial=True), "sample_id")
    assert kept[-1] == (2, [8, 9, 10, 11, -1])


def test_knapsack(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([5, 4, 3, 2])], "id long, size long")
    out = pk.pack_knapsack(df, "size", 7, "id").groupBy("bin").agg(F.sort_array(F.collect_list("size")).alias("s"))
    assert rows(out, "bin") == [(0, [2, 5]), (1, [3, 4])]
    with pytest.raises(ValueError):
        pk.pack_knapsack(df, "size", 4, "id")


def test_knapsack_against_item_by_item(spark):
    import bisect

    rng = np.random.default_rng(1)
    sizes = [int(v) for v in rng.integers(1, 40, 300)]
    left, bins = sorted(sizes), []
    while left:
        room, bag = 64, []
        while (i := bisect.bisect(left, room)) > 0:
            room -= left[i - 1]
            bag.append(left.pop(i - 1))
        bins.append(sorted(bag))
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    got = pk.pack_knapsack(df, "size", 64, "id").groupBy("bin").agg(F.sort_array(F.collect_list("size")).alias("s"))
    assert [r["s"] for r in got.orderBy("bin").collect()] == bins


def test_document_order_is_a_permutation(spark):
    docs = spark.range(20).withColumnRenamed("id", "doc_id")
    a = pk.document_order(docs, 2, 9, separate_last=True).orderBy("position").collect()
    b = pk.document_order(docs.repartition(5), 2, 9, separate_last=True).orderBy("position").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert {r["epoch"] for r in a[:20]} == {0} and sorted(r["doc_id"] for r in a[20:]) == list(range(20))


def test_spans(spark):
    assert spans.sentence_spans([3, 3, 3, 3, 3], 6, 2, 2) == [{"begin": 0, "end": 2, "target": 6}, {"begin": 2, "end": 5, "target": 6}]
    assert spans.sentence_spans([3, 600], 6, 2, 2, longest=512) == []
    assert spans.sentence_spans([3, 600], 6, 2, 2) == [{"begin": 0, "end": 2, "target": 6}]
    out = one(spark, spans.corrupt_spans(F.array(*[F.lit(i) for i in range(10, 15)]), F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(4))), [90, 91], 1, 2, 6, 8, 0))
    assert out["text_enc"] == [10, 90, 13, 91, 0, 0]
    assert out["text_dec"] == [1, 90, 11, 12, 91, 14, 0, 0]
    assert out["labels"] == [90, 11, 12, 91, 14, 2, -1, -1]
    with pytest.raises(Exception):
        one(spark, spans.corrupt_spans(F.array(F.lit(1)), F.array(F.array(F.lit(0))), [], 1, 2, 6, 8, 0))


def masks(spark, tokens, pieces, rate=0.25, **kw):
    df = spark.createDataFrame([(1, tokens, pieces)], "sample_id long, tokens array<int>, pieces array<string>")
    return co.mask_tokens(df, rate, **kw).first()


def test_masks(spark):
    m = masks(spark, list(range(40)), ["w"] * 40, fixed=True, mask_id=-7)
    assert len(m["positions"]) == 10 and all(m["tokens"][i] == -7 for i in m["positions"])
    assert [i for s in m["spans"] for i in s] == m["positions"] == m["labels"]
    assert all(s == list(range(s[0], s[-1] + 1)) for s in m["spans"])
    m = masks(spark, list(range(300)), ["w", "##x", "##y"] * 100, 0.3, fixed=True, mask_id=-7, skip=(0, 30))
    assert len(m["positions"]) % 3 == 0 and 80 <= len(m["positions"]) <= 90 and not {0, 30} & set(m["positions"])
    assert all(len(set(m["tokens"][i : i + 3]) & {-7}) == 0 or m["tokens"][i : i + 3] == [-7] * 3 for i in range(3, 300, 3) if i != 30)
    m = masks(spark, [], [])
    assert (m["tokens"], m["positions"], m["spans"]) == ([], [], [])
    long = masks(spark, list(range(6000)), ["w"] * 6000, 0.15, vocab=50)
    assert len(long["positions"]) == 900
    kept = sum(long["tokens"][i] == i for i in long["positions"])
    assert 40 < kept < 160


def test_pair_segments(spark):
    rows = [(k, [[100 * k + i] * 3 for i in range(n)]) for k, n in enumerate((1, 2, 9, 40))]
    df = spark.createDataFrame(rows, "sample_id long, sents array<array<int>>")
    for r in co.pair_segments(df, 24, 32).collect():
        used = sum(r["mask"])
        assert len(r["tokens"]) == len(r["types"]) == len(r["mask"]) == 32
        assert r["tokens"][0] == 2 and used <= 27 and r["truncated"] == (rows[r["sample_id"]][0] > 1)
        assert sum(r["types"]) == (r["types"].count(1)) and r["types"][used:] == [0] * (32 - used)


def test_reset_positions_and_repeats_are_linear(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i % 7).cast("int")).alias("tokens"))
        t0 = time.perf_counter()
        r = co.lm_example(df, eod=3, reset=True).select(F.element_at("position_ids", -1).alias("last"), F.size("position_ids").alias("n")).first()
        out = one(spark, F.size(tx.repeat_replace(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i % 7).cast("int")), 3, F.array(F.lit(4)), 9)))
        took.append(time.perf_counter() - t0)
        assert r["n"] == n - 1 and out == n + 3
    assert took[1] < 10


def test_sft_errors(spark):
    shape = "conv_id long, turn long, role string, tokens array<int>"
    bad = spark.createDataFrame([(1, 0, "assistant", [5])], shape)
    with pytest.raises(Exception):
        co.sft_examples(bad, 8, 0, -1).collect()
    ok = spark.createDataFrame([(1, 0, "user", [5, 6]), (1, 1, "assistant", [7])], shape)
    r = co.sft_examples(ok, 6, 0, -1).first()
    assert (r["tokens"], r["labels"], r["loss_mask"]) == ([5, 6, 7, 0, -1, -1], [-100, 7, 0, -1, -1, -1], [0, 1, 1, 0, 0, 0])


def test_grounded():
    assert spans.grounded_count(list("aaaaaaaaaaab"), list("a"), 10) == 11
    assert spans.grounded_count(list("aaaab"), list("a"), 10) == 0


def test_text_scores(spark):
    df = spark.createDataFrame([(1, "the red cat", "a red dog"), (2, "x", ""), (3, "", "y")], "id long, guess string, answer string")
    got = {r["id"]: tuple(r)[1:] for r in an.token_f1(df, "id").collect()}
    assert got == {1: (0.5, 0.5, 0.5), 3: (0.0, 0.0, 0.0)}
    assert one(spark, tx.anls(F.lit("abcd"), F.array(F.lit("abcx")))) == 0.75
    v = spark.createDataFrame([("yes", ["yes", "yes"] + ["no"] * 8)], "pred string, golds array<string>")
    assert an.vqa_accuracy(v, "VQAv2").first()[0] == pytest.approx(66.666667)
    for p, want in [("95", 1.0), ("94", 0.0)]:
        c = spark.createDataFrame([(p, ["100"])], "pred string, golds array<string>").select(an.vqa_score("ChartQA"))
        assert c.first()[0] == want


def test_topk_hits(spark):
    df = spark.createDataFrame([(1, 1, True), (2, 3, True), (2, 1, False), (3, 1, False)], "query long, rank int, hit boolean")
    assert [r["hits"] for r in mt.topk_hits(df, 3).orderBy("depth").collect()] == [1, 1, 2]


def test_calls(spark):
    df = spark.createDataFrame([(0.7, 0.2), (0.2, 0.7), (0.6, 0.6)], "p1 double, p2 double")
    assert [r["call"] for r in iv.call_windows(df, 0.5).collect()] == ["japonica", "indica", "uncertain"]


def test_names(spark):
    for raw in ("chrom01", "01", "Chr1"):
        assert one(spark, names.normalize_chrom(F.lit(raw))) == "chr1"
    assert one(spark, names.parse_attributes(F.lit('ID=g1;Name="x y"'))) == {"ID": "g1", "Name": "x y"}
    assert one(spark, names.parse_attributes(F.lit('gene_id "g2"; note "a b";'))) == {"gene_id": "g2", "note": "a b"}


def test_encode_group_conflict(spark):
    df = spark.createDataFrame([("a", "0"), ("a", "1")], "sample_id string, y string")
    with pytest.raises(Exception):
        fl.encode_group(df, "y").collect()


def test_truncate_bytes(spark):
    assert one(spark, tx.truncate_bytes(F.lit("aé"), 2)) == "a"
    assert one(spark, tx.truncate_bytes(F.lit("<|endoftext|>"), 20)) is None
