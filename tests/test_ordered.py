"""Ordered scans against a plain recomputation, with groups that cross partitions."""

import itertools

import numpy as np
import pytest

from seedloom.operators.ordered import following, ordered_scan, previous, quantiles, row_index, running_min, running_sum


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = [("big", i, int(v)) for i, v in enumerate(rng.integers(0, 100, 4000))]
    rows += [(f"g{k}", i, int(v)) for k in range(30) for i, v in enumerate(rng.integers(0, 100, 1 + k % 4))]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, spark.createDataFrame(rows, "g string, i long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.mark.parametrize("shuffled", [False, True])
def test_scans(data, shuffled):
    """Over a table that is only read, and over one that comes out of a shuffle (written once)."""
    rows, df = data
    df = df.repartition(7) if shuffled else df
    got = ordered_scan(
        df, "g", "i", s=running_sum("v"), back=running_sum("v", True), low=running_min("v", True), n=row_index(), p=previous("v", 2), f=following("v", 2)
    )
    got = {(r["g"], r["i"]): r for r in got.collect()}
    for g, part in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        v = [r[2] for r in part]
        for i in range(len(v)):
            r = got[(g, i)]
            assert r["s"] == sum(v[: i + 1]) and r["back"] == sum(v[i:]) and r["low"] == min(v[i:]) and r["n"] == i + 1
            assert r["p"] == (v[i - 2] if i >= 2 else None) and r["f"] == (v[i + 2] if i + 2 < len(v) else None)


def test_quantiles(data):
    rows, df = data
    got = {r["g"]: r for r in quantiles(df, "g", "v", {"a": 0.1, "m": 0.5, "z": 0.99}).collect()}
    for g, part in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        v = [r[2] for r in part]
        assert [got[g][k] for k in "amz"] == pytest.approx(np.quantile(v, [0.1, 0.5, 0.99]))


def test_layout_carries_no_payload(spark):
    """The pass for the bounds reads the keys only, rows are dealt once and nothing is written before."""
    df = spark.range(5000).selectExpr("id", "cast(id % 7 as string) g", "id * 2 v", "repeat('x', 50) payload")
    plan = ordered_scan(df, "g", "id", s=running_sum("v"))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    wide = [line for line in text.splitlines() if "Exchange" in line]
    assert "LogicalRDD" not in plan.optimizedPlan().toString() and text.count("REPARTITION_BY_COL") == 1
    assert len([line for line in wide if "_pid" in line and "REPARTITION" in line]) == 1


def test_descending_and_null_keys(spark, data):
    rng = np.random.default_rng(2)
    rows = [(None if k % 5 == 0 else f"g{k % 5}", None if k % 11 == 0 else float(k % 400), k, int(v)) for k, v in enumerate(rng.integers(0, 9, 3000))]
    df = spark.createDataFrame(rows, "g string, a double, i long, v long")
    got = {r["i"]: (r["s"], r["p"]) for r in ordered_scan(df, "g", ["-a", "i"], s=running_sum("v"), p=previous("v")).collect()}
    key = lambda r: (r[0] or "", r[1] is None, -(r[1] or 0), r[2])
    for g, part in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        total, before = 0, None
        for _, _, i, v in part:
            total += v
            assert got[i] == (total, before)
            before = v
