"""Operators on the shapes that hurt: long intervals, crowded bins, wide kernels, long sums, swaps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedloom.operators import base, ordered
from seedloom.operators import corpus as co
from seedloom.operators import genes as gn
from seedloom.operators import intervals as iv
from seedloom.operators import stats as st
from seedloom.operators import tracks as tr
from seedloom.operators.ordered import lay_out


def overlaps(a, b, flank=0):
    return sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] - flank < y[3] and x[3] + flank > y[2])


def test_overlap_join_levels(spark):
    """Intervals from one base to a whole chromosome on both sides, every pair once."""
    rng = random.Random(1)

    def side(n):
        out = []
        for i in range(n):
            size = rng.choice([1, 3, 40, 900, 5_000, 70_000, 1_000_000])
            start = rng.randrange(0, 1_000_000)
            out.append((i, rng.choice("xy"), start, start + size))
        return out + [(n, "x", 0, 2_000_000), (n + 1, "x", 0, 2_000_000), (n + 2, "y", 7, 7)]

    a, b = side(120), side(150)
    shape = "id long, chrom string, start long, end long"
    left, right = spark.createDataFrame(a, shape), spark.createDataFrame(b, shape)
    for flank in (0, 500):
        got = iv.overlap_join(left, right, flank=flank, closed=False, bin_size=16).select("id", "b_id").collect()
        want = [(i, j) for i, j in overlaps(a, b, flank) if (i != 122 or flank) and j != 152]
        assert sorted(map(tuple, got)) == want
    empty = right.limit(0)
    assert iv.overlap_join(left, empty).count() == 0 and iv.overlap_join(empty, right).count() == 0


def test_overlap_join_long_intervals_stay_few_rows(spark):
    """A chromosome-long interval is a few rows, not one for each bin."""
    one = spark.createDataFrame([(1, "x", 0, 1 << 30)], "id long, chrom string, start long, end long")
    points = spark.range(1000).selectExpr("id", "'x' chrom", "id * 1000003 start", "id * 1000003 + 1 end")
    joined = iv.overlap_join(one, points, closed=False)
    assert joined.count() == 1000
    both = iv._in_bins(one.withColumn("_lo", F.col("start")).withColumn("_hi", F.col("end") - 1), "_lo", "_hi", iv._level("_lo", "_hi", 1024), "_at", "_bin", 1024)
    assert both.count() <= 2


def test_overlap_join_crowded_bin(spark):
    """A third of all rows in one bin: it is split by its load, and no pair is lost or doubled."""
    a = spark.range(9000).selectExpr("id", "'x' chrom", "if(id % 3 = 0, 500, id * 5000) start", "if(id % 3 = 0, 500, id * 5000) + 20 + id % 3 end")
    b = spark.createDataFrame([(1, "x", 510, 512), (2, "x", 400, 505), (3, "x", 10**7, 10**7 + 9)], "id long, chrom string, start long, end long")
    joined = iv.overlap_join(a, b, closed=False, crowd=100)
    got = {(r["b_id"], r["n"]) for r in joined.groupBy("b_id").agg(F.count_distinct("id").alias("n")).collect()}
    assert got == {(1, 3000), (2, 3000), (3, 1)} and joined.count() == 6001


@pytest.mark.parametrize("nearest", [False, True])
def test_gaussian_smooth_wide(spark, monkeypatch, nearest):
    monkeypatch.setattr(st, "TILE", 64)
    rng = np.random.default_rng(3)
    sigma, rows, want = 20.0, [], {}
    half = (max(3, int(6 * sigma) | 1)) // 2
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for g, lo, n in (("a", -700, 2000), ("b", 5, 90), (None, 1, 1)):
        v = rng.normal(size=n)
        padded = np.pad(v, half, mode="edge") if nearest else np.pad(v, half)
        for i, s in enumerate(np.convolve(padded, kernel, "valid")):
            rows.append((g, lo + i, float(v[i]), "p"))
            want[g, lo + i] = s
    df = spark.createDataFrame([*rows, ("a", None, 1.0, "p")], "g string, pos long, v double, payload string").repartition(4)
    got = st.gaussian_smooth(df, "v", "pos", sigma, "g", nearest).collect()
    assert len(got) == len(rows) + 1 and {r["payload"] for r in got} == {"p"}
    for r in got:
        assert r["smooth"] == (None if r["pos"] is None else pytest.approx(want[r["g"], r["pos"]], abs=1e-12))


def test_gaussian_smooth_copies_do_not_grow(spark):
    """Rows sent to tiles do not depend on the kernel."""
    df = spark.range(200_000).selectExpr("id pos", "1.0 v")
    for sigma in (1.0, 100.0, 2000.0):
        size, half = max(st.TILE, 4 * ((int(6 * sigma) | 1) // 2)), (int(6 * sigma) | 1) // 2
        text = st.gaussian_smooth(df, "v", "pos", sigma)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Generate explode") == 1
        copies = sum(1 + (p % size < half) + (p % size >= size - half) for p in range(0, 200_000, 97)) / len(range(0, 200_000, 97))
        assert copies <= 1.6


def test_average_tracks_is_exact(spark, monkeypatch):
    """Adding and taking back leaves no trace, over tiles and along a chromosome."""
    monkeypatch.setattr(tr, "SUM_TILE", 1000)
    rng = random.Random(8)
    rows = [(k % 3, "c", s, s + rng.randint(1, 2500), rng.choice([1e-3, 0.1, 0.3, 1e6, 7.7e5]) * rng.random()) for k in range(400) for s in [rng.randrange(0, 20_000)]]
    rows += [(0, "c", 90_000, 90_001, 1e-7), (1, "c", 90_001, 90_002, 3e-9)]
    signal = spark.createDataFrame(rows, "track long, chrom string, start long, end long, value double")
    want = np.zeros(100_000)
    for _, _, s, e, v in rows:
        want[s:e] += v
    got = np.zeros(100_000)
    for r in tr.average_tracks(signal).collect():
        assert not got[r["start"] : r["end"]].any()
        got[r["start"] : r["end"]] = r["value"] * 3
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def tasks(df):
    """Tasks that have rows, and the rows of the largest."""
    seen = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    return len(seen), max(seen)


def test_average_tracks_tasks_grow_with_rows(spark, monkeypatch):
    """Tiles go to as many tasks as their rows fill, whatever the session's number of partitions is."""
    monkeypatch.setattr(base, "TASK_ROWS", 200)
    monkeypatch.setattr(tr, "SUM_TILE", 1000)
    signal = spark.range(6000).selectExpr("id % 3 track", "if(id < 0, 'd', 'c') chrom", "id * 50 start", "id * 50 + 40 end", "double(id % 7) / 10 value")
    runs = tr.average_tracks(signal)
    n, most = tasks(runs)
    assert n >= 20 and most < 600 and runs.count() == signal.filter("value > 0").count()


def test_overlap_join_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(base, "TASK_ROWS", 200)
    a = spark.range(3000).selectExpr("id", "'x' chrom", "id * 1000 start", "id * 1000 + 300 end")
    b = spark.range(3000).selectExpr("id", "'x' chrom", "id * 1000 + 100 start", "id * 1000 + 150 end")
    joined = iv.overlap_join(a, b, closed=False, bin_size=512)
    n, most = tasks(joined)
    assert n >= 20 and most < 600 and joined.filter("id = b_id").count() == joined.count() == 3000


def test_bases_to_intervals_orders_runs_only(spark, monkeypatch):
    """Runs are found in tiles dealt by their rows; only runs are put in order over all of them."""
    monkeypatch.setattr(base, "TASK_ROWS", 200)
    monkeypatch.setattr(iv, "RUN_TILE", 16)
    seen = []
    monkeypatch.setattr(iv, "lay_out", lambda df, *by: (seen.append(df.count()), lay_out(df, *by))[1])
    rng = random.Random(9)
    spans, at = [], -200
    for _ in range(60):
        at += rng.choice([0, 0, 1, 30])
        size = rng.randint(1, 90)
        spans.append((at, at + size, rng.choice([1.0, 2.0, 0.0])))
        at += size
    rows = [(c, p, v) for c in ("x", None) for s, e, v in spans for p in range(s, e)]
    rows += [("y", 5, 1.0), ("y", 5, 1.0), ("y", 15, 2.0), ("y", 15, 2.0), ("y", 16, 2.0), ("y", None, 3.0), ("y", None, 3.0)]
    want = [("y", 5, 6, 1.0), ("y", 5, 6, 1.0), ("y", 15, 16, 2.0), ("y", 15, 17, 2.0), ("y", None, None, 3.0), ("y", None, None, 3.0)]
    for c in ("x", None):
        runs = []
        for s, e, v in spans:
            if v and runs and runs[-1][1] == s and runs[-1][2] == v:
                runs[-1] = (runs[-1][0], e, v)
            elif v:
                runs.append((s, e, v))
        want += [(c, *r) for r in runs]
    rng.shuffle(rows)
    got = iv.bases_to_intervals(spark.createDataFrame(rows, "chrom string, pos long, value double").repartition(4))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert seen[0] < len(rows) / 4


def test_signal_tasks_grow_with_rows(spark, sf_dir, monkeypatch):
    from seedloom.plans.registry import Tables

    monkeypatch.setattr(base, "TASK_ROWS", 200)
    assert tasks(Tables(spark, sf_dir).signal)[0] >= 20


def test_extract_windows_reads_written_windows(spark):
    """Windows that come out of a shuffle are computed once, not for each pass over them."""
    index = spark.range(40).selectExpr("'c' chrom", "id % 20 * 8 start", "id % 20 * 8 + 8 end").distinct()
    seqs = spark.range(10).selectExpr("'c' seqid", "id * 16 chunk_start", "repeat('ACGT', 4) bases")
    tracks = spark.createDataFrame([(0, "c", 4, 10, 2.0), (1, "c", 0, 99, 7.0)], "track long, chrom string, start long, end long, value double")
    out = iv.extract_windows(index, seqs, tracks, track_ids=[0])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "% 20" not in plan
    got = {r["start"]: (r["sequence"], r["signal_0"]) for r in out.collect()}
    assert len(got) == 20 and got[0] == ("ACGTACGT", [0.0] * 4 + [2.0] * 4) and got[8] == ("ACGTACGT", [2.0] * 2 + [0.0] * 6)


def test_permuted_masks(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        n = rng.randint(1, 120)
        rows.append((i, [rng.randint(10, 900) for _ in range(n)], ["##x" if k and rng.random() < 0.3 else "x" for k in range(n)]))
    df = spark.createDataFrame(rows, "sample_id long, tokens array<int>, pieces array<string>")
    plain = {r["sample_id"]: r for r in co.mask_tokens(df).collect()}
    got = co.mask_tokens(df, permute=True).collect()
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(co.mask_tokens(df.repartition(5), permute=True).collect())]
    moved = 0
    for r in got:
        old, was = r["original"], plain[r["sample_id"]]
        to, of = r["swapped_to"], r["swapped_from"]
        assert to == sorted(to) and sorted(of) == to and len(set(to)) == len(to)
        assert len(to) <= max(1, round(len(old) * 0.15)) + 4 and not set(to) & set(was["positions"])
        assert r["positions"] == sorted(was["positions"] + to) and r["labels"] == [old[p] for p in r["positions"]]
        expected = list(was["tokens"])
        for a, b in zip(to, of):
            expected[a] = old[b]
        assert r["tokens"] == expected and r["spans"] == was["spans"]
        moved += to != of
    assert moved > 20


def test_byte_range_index(spark, tmp_path):
    """Region reads through the index give the rows of a full read, from a part of the bytes."""
    from seedloom.sources import genome as gn
    from seedloom.sources import ranges as rg

    rng = random.Random(4)
    folder = tmp_path / "vcf"
    folder.mkdir()
    total = 0
    for name in ("a", "b"):
        lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"]
        for c in ("chr1", "chr2"):
            lines += [f"{c}\t{p}\t.\tA\tC\t.\t.\t{'x' * rng.randint(0, 60)}\tGT\t{rng.choice(['0|1', '1/1', '.'])}\t0|0" for p in sorted(rng.randint(1, 100_000) for _ in range(1500))]
        data = ("\r\n" if name == "b" else "\n").join(lines) + ("" if name == "a" else "\r\n")
        (folder / f"{name}.vcf").write_bytes(data.encode())
        total += len(data)
    index = rg.index_positions(spark, str(folder), "vcf", block=4096).cache()
    assert index.filter("chrom <> '#'").agg(F.sum("lines")).first()[0] == 6000
    shape = "chrom string, start long, end long"
    for spans in ([("1", 0, 900)], [("chr2", 50_000, 52_000), ("chr2", 51_000, 51_500), ("chr1", 99_000, 200_000)], [("chr9", 0, 10)]):
        regions = spark.createDataFrame(spans, shape)
        whole = sorted(map(str, gn.read_vcf(spark, str(folder), regions).collect()))
        part = sorted(map(str, gn.read_vcf(spark, str(folder), regions, index).collect()))
        assert part == whole
        read = rg.matching_ranges(index, regions).agg(F.sum(F.col("stop") - F.col("begin"))).first()[0]
        assert read < 0.12 * total
    track = tmp_path / "t.bedgraph"
    rows = [f"chr1\t{i * 10}\t{i * 10 + 10}\t{i % 7}" for i in range(5000)]
    track.write_text("track type=bedGraph\n" + "\n".join(rows))
    index = rg.index_positions(spark, str(track), "bedgraph", block=2048)
    regions = spark.createDataFrame([("chr1", 1234, 1301), ("chr1", 1290, 1310)], shape)
    got = sorted(map(tuple, gn.read_signal(spark, str(track), regions=regions, index=index).collect()))
    assert got == sorted(("t", "chr1", i * 10, i * 10 + 10, float(i % 7)) for i in range(123, 131))
    assert got == sorted(map(tuple, gn.read_signal(spark, str(track), regions=regions).collect()))
    assert rg.matching_ranges(index, regions).agg(F.sum(F.col("stop") - F.col("begin"))).first()[0] <= 3 * 2048
    assert rg.index_positions(spark, str(track), "bedgraph", block=1 << 20).count() == 2


def test_token_f1_needs_no_shuffle(spark):
    from seedloom.operators import answers as an

    df = spark.createDataFrame([(1, "a b b c", "b b b d"), (2, "", "x y"), (3, None, "x"), (4, "x", ""), (5, "b a b", "b a b")], "k long, guess string, answer string")
    out = an.token_f1(df, "k")
    got = {r["k"]: (r["precision"], r["recall"], r["f1"]) for r in out.collect()}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("Exchange SinglePartition", "")
    # Articles are no tokens.
    assert set(got) == {1, 2, 3, 5} and got[2] == got[3] == (0.0, 0.0, 0.0) and got[5] == (1.0, 1.0, 1.0)
    assert got[1] == pytest.approx((2 / 3, 2 / 4, 4 / 7))


def test_boosted_probes(spark):
    """Probabilities of several classes rank them (a class in the shadow of another has AUC, not calls)."""
    from seedloom.operators import probes as pb

    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        c = i % 3
        x = rng.normal(size=3) + [2.0 * (c == 0), 2.0 * (c == 1), 0.0]
        y = 3 * x[0] - x[1] + (60.0 if i % 40 == 0 else 0.0)
        rows.append((i, [float(v) for v in x], c, float(y)))
    df = spark.createDataFrame(rows, "item_id long, embedding array<float>, label int, y double")
    train, test = df.filter("item_id % 4 <> 0"), df.filter("item_id % 4 = 0")
    got = pb.probe_boosted(train, test, n_classes=3, rounds=8, depth=3).first()
    assert got["accuracy"] > 0.6 and got["roc_auc"] > 0.85 and got["roc_auc"] > got["accuracy"]
    boosted = pb.probe_boosted(train, test, label="y", rounds=8, depth=3, task="regression").first()
    robust, plain = (pb.probe_linear(train, test, label="y", robust=r).first() for r in (True, False))
    assert boosted["n"] == 150 and robust["mae"] < plain["mae"] and robust["mae"] < 7


def test_gene_pvalues_tasks(spark, monkeypatch):
    """Many samples at few positions: parts are as many as the counted rows fill, results do not depend on them."""
    rows = [(i, p, i % 2, ((i * 37 + p * 11) % 101) / 8 if (i + p) % 17 else None) for i in range(60) for p in range(1, 9)]
    matrix = spark.createDataFrame(rows + [(7, None, 1, 2.0), (8, 3, None, 1.0)] + rows[:5], "sample_id long, position long, grp int, value double")
    loci = spark.createDataFrame([(1, 1, 3), (2, 2, 2), (3, 5, 9), (3, 5, 9), (4, None, 3), (5, 20, 30)], "gene_id long, start long, end long")
    near = gn.gene_positions(loci, matrix, 1)
    want = loci.join(matrix, F.col("position").between(F.greatest(F.lit(1), F.col("start") - 1), F.col("end") + 1)).select(near.columns)
    assert sorted(map(str, near.collect())) == sorted(map(str, want.collect()))
    same = lambda r: str([round(v, 9) if isinstance(v, float) else v for v in r])
    run = lambda: sorted(map(same, gn.gene_pvalues(matrix, loci, 1, metrics=("mean", "max")).collect()))
    whole = run()
    parts = []
    settled = ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df: parts.append(df.rdd.getNumPartitions()) or settled(df))
    monkeypatch.setattr(base, "TASK_ROWS", 200)
    assert run() == whole
    assert max(parts) >= near.count() // 200


def test_gene_pvalues_writes_no_hits(spark, monkeypatch):
    """Genes overlap, so a sample has many times its rows in hits: neither they nor the scores are written."""
    rows = [(i, p, i % 2, ((i * 37 + p * 11) % 101) / 8) for i in range(80) for p in range(1, 9)]
    matrix = spark.createDataFrame(rows, "sample_id long, position long, grp int, value double")
    loci = spark.createDataFrame([(g, 1 + g % 4, 5 + g % 4) for g in range(30)], "gene_id long, start long, end long")
    run = lambda: sorted(map(str, gn.gene_pvalues(matrix, loci, metrics=("mean", "peak_count")).collect()))
    whole = run()
    written = []
    settled = base.settle
    for module in (base, ordered, st):
        monkeypatch.setattr(module, "settle", lambda df: written.append((out := settled(df)).count()) or out)
    assert run() == whole and max(written) <= 30 * 5
    # groups cut in parts by value: the picked values alone are written
    monkeypatch.setattr(base, "TASK_ROWS", 4000)
    written.clear()
    assert run() == whole and max(written) < 80 * 30


def test_small_groups_have_the_same_metrics(spark):
    """Metrics read off arrays are those of ordered scans: ties, flat runs, few values, nulls and NaN."""
    rng = random.Random(3)
    values = [0.0, 0.5, 1.0, 1.0, 2.5, -1.5, None, float("nan"), 7.25]
    rows = [(g, g % 2 if g % 5 else None, p, rng.choice(values)) for g in range(60) for p in range(1, 2 + g)]
    df = spark.createDataFrame(rows, "g long, h int, position long, value double")
    near = lambda r: [pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(v, float) else v for v in r]
    order = lambda r: str(r[:2])
    got, want = (sorted(map(tuple, st.distribution_metrics(df, ["g", "h"], small=s).collect()), key=order) for s in (True, False))
    assert len(got) == len(want) > 50 and got == [tuple(near(r)) for r in want]


def test_rank_test_in_parts(spark, monkeypatch):
    """Keys cut at any value, ties and null keys included, have the ranks of the whole key."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([0, 1, 1, 2, None]), rng.choice([0.0, -0.0, None, float(rng.randrange(40)), rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, grp int, v double")
    run = lambda n: sorted((tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in st.mann_whitney(df, "k", "v", F.col("grp") == 0, F.col("grp") == 1, rows=n).collect()))
    want = run(0)
    monkeypatch.setattr(base, "TASK_ROWS", 300)
    parts = ordered.in_parts(df, "k", "v", 3000).groupBy("k").agg(F.count_distinct("_part").alias("n"))
    assert max(r["n"] for r in parts.collect()) > 3
    assert run(3000) == want and len(want) == 3
