"""Work that must stay bounded in a task, whatever the size of the tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seedloom.functions import spans as sp
from seedloom.operators import corpus as co
from seedloom.operators import genes as gn
from seedloom.operators import metrics as mt
from seedloom.operators import probes as pb
from seedloom.operators import retrieval as rt
from seedloom.operators.ordered import lay_out, ordered_scan
from seedloom.plans.catalog import sources
from seedloom.plans.registry import Tables, spark_queries
from seedloom.sources import genome as gm


def nearest(q, x, k):
    s = q @ x.T
    return np.array([sorted(range(len(x)), key=lambda j: (-r[j], j))[:k] for r in s])


@pytest.mark.parametrize("rising", [False, True])
def test_knn_tiles_find_what_brute_force_finds(rising):
    """Many ties, several tiles, and items whose scores rise so that every tile has better ones."""
    rng = np.random.default_rng(1)
    q, x = rng.integers(1, 4, (70, 3)).astype(float), rng.integers(0, 4, (9000, 3)).astype(float)
    if rising:
        x = x * np.arange(1, 9001)[:, None] // 50
    ids = rng.permutation(9000)
    got = rt._top(np.arange(70), q, ids, x[ids], 7, "ip")
    assert got["item_id"].to_numpy().reshape(70, 7).tolist() == nearest(q, x, 7).tolist()
    few = rt._top(np.arange(70), q, ids[:3], x[ids[:3]], 7, "ip")
    assert few.num_rows == 210


def test_knn_holds_one_tile_of_scores():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(4096, 8)), rng.normal(size=(16384, 8))
    tracemalloc.start()
    rt._top(np.arange(4096), q, np.arange(16384), x, 5, "ip")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # all scores are 512 MB


def test_knn_join_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(rt, "QUERY_VALUES", 40)
    monkeypatch.setattr(rt, "ITEM_VALUES", 60)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (90, 2)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<float>")
    q = df.withColumnRenamed("item_id", "query_id")
    want = nearest(x, x, 4)
    for got in (rt.knn_join(q, df, 4), rt.knn_join_ivf(q, df, 4, n_lists=3, nprobe=3)):
        rows = {(r["query_id"], r["rank"]): r["item_id"] for r in got.collect()}
        assert [[rows[i, k + 1] for k in range(4)] for i in range(90)] == want.tolist()


def test_covariance_components_take_more_samples_than_a_square(spark):
    """The query takes any cohort, and its scores are those of the samples x samples product."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) * [1, 2, 3, 4, 5]
    x[7, 2] = 0.0
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(300) for j in range(5) if (i, j) != (7, 2)], "sample_id long, position long, value double")
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    want = u[:, :3] * s[:3]
    got = {r["sample_id"]: r["pcs"] for r in gn.sample_pcs(long, 3, "covariance").collect()}
    got = np.array([got[i] for i in range(300)])
    assert np.allclose(np.abs((got * want).sum(0)), (want * want).sum(0), rtol=1e-9)
    one = gn.sample_pcs(long.filter("sample_id = 1"), 3, "covariance").collect()
    assert [r["pcs"] for r in one] == [[0.0]]


@pytest.mark.parametrize("name", ["a18_ols_association", "a19_sample_pcs"])
def test_cohort_over_4096_samples(spark, tmp_path, name):
    vectors = spark.range(4200).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (i + 1) + i).cast("float") for i in range(64)]).alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert spark_queries()[name](spark, str(tmp_path)).count() == (64 if name.startswith("a18") else 4200)


@pytest.mark.parametrize("order", [["v", "w"], ["-v", "w"]])
def test_parts_are_the_number_of_bounds_a_row_is_past(spark, tmp_path, order):
    """Parts rise with the order, nulls and ties included, and the rows are spread over them."""
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") * 7 % 500).alias("v"), F.col("id").alias("w"))
    df.write.parquet(f"{tmp_path}/t")
    rows = lay_out(spark.read.parquet(f"{tmp_path}/t"), "g", order).collect()
    sign = -1 if order[0] == "-v" else 1
    least = float("inf") if sign < 0 else float("-inf")
    rows.sort(key=lambda r: (r["g"], least if r["v"] is None else sign * r["v"], r["w"]))
    parts = [r["_pid"] for r in rows]
    assert parts == sorted(parts)
    assert max(parts) >= 8 and max(map(parts.count, set(parts))) < 3000 / 4


def test_part_search_has_no_state_but_the_part(spark, tmp_path):
    spark.range(3000).write.parquet(f"{tmp_path}/t")
    plan = lay_out(spark.read.parquet(f"{tmp_path}/t"), None, "id")._jdf.queryExecution().analyzed().toString()
    assert "named_struct(lo" not in plan and "struct(lo" not in plan


def test_eval_windows_do_not_repeat_the_document(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.sequence(F.lit(1), F.lit(1000)).alias("tokens"))
    out = co.overlapping_eval_windows(df, 128, 32)
    exploded = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert len(exploded) == 1 and "tokens" not in exploded[0].split("], [")[-1] and "sequence" not in exploded[0].split("explode")[0]
    rows = sorted(out.collect(), key=lambda r: r["window_no"])
    assert [r["text"][0] for r in rows] == [1 + 32 * k for k in range(29)] and all(len(r["text"]) == 129 for r in rows)
    wide = out.select("doc_id", "window_no")._jdf.queryExecution().optimizedPlan().toString()
    assert "slice" in wide


def test_embedding_holds_one_model_batch_of_texts(spark, monkeypatch):
    """The model's texts are converted a batch at a time: frames of a whole Arrow batch are not made."""
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(50)], "item_id long, sequence string")
    plan = pb.embed(df, lambda: lambda xs: np.array([[[len(x)] for x in xs], [[len(xs)] for _ in xs]]), [0, 5], size=8)
    assert "MapInArrow" in plan._jdf.queryExecution().optimizedPlan().toString()
    rows = plan.collect()
    assert sorted((r["item_id"], r["layer"]) for r in rows) == [(i, n) for i in range(50) for n in (0, 5)]
    assert all(r["embedding"] == [r["item_id"] % 7] for r in rows if r["layer"] == 0)
    assert max(r["embedding"][0] for r in rows if r["layer"] == 5) <= 8


def test_lines_are_written_by_many_tasks_with_a_header_each(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = spark.range(0, 100, numPartitions=5).select(F.concat_ws("\t", F.col("id").cast("string"), F.lit("a")).alias("value"))
    path = sources.as_text(t, sources.with_header(t, "id\ttext", rows), "lines", "tsv")
    got = spark.read.option("header", True).option("sep", "\t").csv(path)
    assert sorted(int(r["id"]) for r in got.collect()) == list(range(100))
    assert len(got.inputFiles()) >= 5


@pytest.mark.parametrize("permute", [False, True])
def test_masks_are_drawn_for_a_slice_of_rows_at_once(spark, monkeypatch, permute):
    """Words are array elements of an Arrow task, not values of nested lambdas, and slices change nothing."""
    df = spark.createDataFrame([(i, list(range(i % 50)), ["##x" if k % 5 == 2 else "x" for k in range(i % 50)]) for i in range(120)], "sample_id long, tokens array<int>, pieces array<string>")
    out = co.mask_tokens(df, permute=permute)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(tuple(r) for r in out.collect())
    given = sorted(df.collect())
    columns = [
        pa.array([r["sample_id"] for r in given]), pa.array([r["tokens"] for r in given], pa.list_(pa.int32())), pa.array([r["tokens"] for r in given], pa.list_(pa.int32())),
        pa.array([[p.startswith("##") for p in r["pieces"]] for r in given], pa.list_(pa.bool_())), pa.array([str(r["sample_id"]) for r in given]),
        pa.array([max(1, int(len(r["tokens"]) * 0.15 + 0.5)) for r in given], pa.int32()),
    ]
    batch = pa.RecordBatch.from_arrays(columns, ["sample_id", "original", "_tokens", "_inner", "_name", "_budget"])
    monkeypatch.setattr(sp, "MASK_TOKENS", 100)
    parts = list(sp.Masks(1, (1.0, 1 / 2, 1 / 3), 1000, 4, (), False, permute)([batch]))
    assert len(parts) > 20 and max(sum(map(len, p.column("original").to_pylist())) for p in parts) <= 100
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == want


@pytest.mark.parametrize("limit", [100_000, 20])
def test_rank_correlation_deals_groups_whole_unless_they_are_large(spark, monkeypatch, limit):
    """Small groups are ranked in one shuffle, larger ones by ordered scans, with the same scores."""
    scans = []
    monkeypatch.setattr(mt, "RANKED", limit)
    monkeypatch.setattr(mt, "ordered_scan", lambda df, *a, **kw: scans.append(df) or ordered_scan(df, *a, **kw))
    rng = np.random.default_rng(5)
    rows = [(g, float(x), float(x % 3 + y)) for g, n in (("a", 400), ("b", 6), (None, 9), ("c", 1)) for x, y in rng.integers(0, 9, (n, 2))]
    got = {r["g"]: r["spearman"] for r in mt.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "g").collect()}
    assert bool(scans) == (limit == 20) and set(got) == {"a", "b", "c"} and got["c"] is None
    for g in "ab":
        x, y = np.array([r[1:] for r in rows if r[0] == g]).T
        rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
        assert got[g] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-12)


def test_window_summary_computes_the_scores_once(spark):
    rows = spark.range(60).select((F.col("id") / 60).alias("pearson_corr"), (F.col("id") % 7 / 7).alias("spearman_corr"))
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = mt.summarise_windows(rows.mapInArrow(passed, rows.schema)).collect()
    assert seen.value == 60 and {r["score"] for r in out} == {"pearson_corr", "spearman_corr"}


def test_fasta_records_go_on_over_splits_without_a_layout_pass(spark, tmp_path, monkeypatch):
    """Splits of 64 bytes: records begin, go on through and end in splits, some of which have no header."""
    lengths = [0, 1000, 3, 45, 0, 200, 7]
    text = "stray\n" + "".join(f">s{i % 5} x\n" + "".join("ACGTN"[(i + k) % 5] + "\n" * (k % 10 == 9) for k in range(n)) + "\n" for i, n in enumerate(lengths))
    for name in ("a", "b"):
        (tmp_path / f"{name}.fa").write_text(text)
    monkeypatch.setattr(gm, "lay_out", None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = gm.read_fasta(spark, str(tmp_path), chunk=50).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["record_no"], r["chunk_no"])):
        record = got.setdefault((r["file"][-4:], r["record_no"], r["seqid"]), [])
        assert r["chunk_start"] == len("".join(record))
        record.append(r["bases"])
    want = {(f, i + 1, f"s{i % 5}"): "".join("ACGTN"[(i + k) % 5] for k in range(n)) for f in ("a.fa", "b.fa") for i, n in enumerate(lengths)}
    assert {k: "".join(v) for k, v in got.items()} == want
