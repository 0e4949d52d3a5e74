"""Running sums, minima and neighbours over an order, without one task per group.

A window function sends each whole group to one task. Here a first pass over the keys alone
finds bounds that cut (group, order) into parts of like size. They make the number of a row's part a
function of its keys: the rows are dealt by it once, are scanned part by part, and no pass depends on
how another one was laid out, so nothing is written in between. Only the groups that a bound
falls into reach over several parts; a table with one row per part carries their sums over, joined
on the part. A group that holds a third of all rows is spread over a third of the parts.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.operators import base
from seedloom.operators.base import as_list, dealt, small_side, tasks_of
from seedloom.session import settle

PID = "_pid"
SALT = "_salt"
# Whether a row's group may reach over several parts; whether the rows were dealt by part.
CROSS, DEALT = "_cross", "_dealt"
# Parts for each shuffle partition.
PARTS = 2


@dataclass(frozen=True)
class Scan:
    kind: str  # sum | min | max | lag | lead
    col: Column
    reverse: bool = False
    n: int = 1


def running_sum(col, reverse: bool = False) -> Scan:
    return Scan("sum", F.col(col) if isinstance(col, str) else col, reverse)


def running_min(col, reverse: bool = False) -> Scan:
    return Scan("min", F.col(col) if isinstance(col, str) else col, reverse)


def running_max(col, reverse: bool = False) -> Scan:
    return Scan("max", F.col(col) if isinstance(col, str) else col, reverse)


def row_index(reverse: bool = False) -> Scan:
    """1-based row number (from the end when ``reverse``)."""
    return Scan("sum", F.lit(1).cast("long"), reverse)


def previous(col, n: int = 1) -> Scan:
    return Scan("lag", F.col(col) if isinstance(col, str) else col, n=n)


def following(col, n: int = 1) -> Scan:
    return Scan("lead", F.col(col) if isinstance(col, str) else col, n=n)


def lay_out(df: DataFrame, by, order, salt: bool = False) -> DataFrame:
    """``df`` with the number of each row's part in ``_pid`` and, in ``_cross``, whether its group may
    reach into other parts.

    The bounds are the last keys of range partitions of the keys alone: as many as parts, held as one
    value in the plan. ``salt`` adds a random last key, so that rows with equal keys can be split
    too; such a table is written once, range-partitioned, for the draw must not change. So is a table that is
    itself the outcome of shuffles or Python, as the passes over it would each compute it; a table that
    is only read, filtered and projected is not.
    """
    by = as_list(by)
    order = [*as_list(order), *([SALT] if salt else [])]
    names = [*by, *[c.lstrip("-") for c in order]]
    down = [False] * len(by) + [c.startswith("-") for c in order]
    if salt or derived(df):
        df = df.withColumn(SALT, F.rand(17)) if salt else df
        ends = [F.col(f"`{c}`").desc_nulls_last() if d else F.col(f"`{c}`").asc_nulls_first() for c, d in zip(names, down)]
        return settle(df.repartitionByRange(*ends).withColumn(PID, F.spark_partition_id())).withColumn(CROSS, F.lit(True))
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]
    parts = PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(f"k{i}").desc_nulls_last() if d else F.col(f"k{i}").asc_nulls_first() for i, d in enumerate(down)]
    ranged = df.select(*keys).repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    key = F.struct(*[f"k{i}" for i in range(len(names))])
    # One task has all rows of a part, in order.
    numbered = ranged.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), key.alias("key"))
    ends = numbered.groupBy("part").agg(F.max_by("key", "at").alias("key"))
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    found = sorted((r["part"], r["key"]) for r in ends.select("part", F.to_json("key", {"ignoreNullFields": "false", **form}).alias("key")).collect())
    kinds = T.ArrayType(ends.schema["key"].dataType)
    cuts = [json.loads(k) for _, k in found[:-1]]
    if not cuts:
        return df.withColumns({PID: F.lit(0), CROSS: F.lit(False)})
    bounds = F.from_json(F.lit(json.dumps(cuts)), kinds, form)
    row = [F.col(f"`{c}`") for c in names]

    def past(bound: Column) -> Column:
        """Whether the row comes after the bound."""
        after, same = F.lit(False), F.lit(True)
        for i, (c, d) in enumerate(zip(row, down)):
            here, there = (bound[f"k{i}"], c) if d else (c, bound[f"k{i}"])
            # nulls come first where the order rises, last where it falls
            after = after | (same & F.coalesce(here > there, here.isNotNull() & there.isNull()))
            same = same & here.eqNullSafe(there)
        return after

    # A row's part is the number of bounds it comes after, found by halving steps. Beyond the last bound
    # there is none, so the comparison is NULL and the step not taken.
    if any(down):
        after = past
    else:
        whole = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(row)])
        after = lambda bound: whole > bound  # noqa: E731  structs compare key by key, nulls first
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    taken = lambda at, n: F.when(after(F.get(bounds, at + n - 1)) & (at + n <= len(cuts)), at + n).otherwise(at)
    out = df.withColumn(PID, F.aggregate(steps, F.lit(0), taken))
    near = F.lit(False) if by else F.lit(True)
    for place in (F.col(PID) - 1, F.col(PID)):
        bound = F.get(bounds, place)
        same = bound.isNotNull()
        for i, c in enumerate(row[: len(by)]):
            same = same & c.eqNullSafe(bound[f"k{i}"])
        near = near | same
    return out.withColumn(CROSS, near)


# Steps of a plan that cost more than to read their result again.
_COSTLY = re.compile(r"(?m)^[\s:|+-]*(Aggregate|Join|Window|Sort|Repartition\w*|Deduplicate|Distinct|Generate|MapIn\w+|FlatMap\w+|\w*EvalPython)\b")


def derived(df: DataFrame) -> bool:
    """Whether ``df`` is the outcome of shuffles or Python, not of reading, filtering and projecting alone."""
    return bool(_COSTLY.search(df._jdf.queryExecution().optimizedPlan().treeString()))


def _sort_keys(order, turn: bool = False) -> list[Column]:
    """Order columns; a leading '-' means descending. ``turn`` gives the opposite order."""
    keys = []
    for c in as_list(order):
        down = c.startswith("-")
        col = F.col(c[1:] if down else c)
        if turn:
            keys.append(col.asc_nulls_first() if down else col.desc_nulls_last())
        else:
            keys.append(col.desc_nulls_last() if down else col.asc_nulls_first())
    return keys


def scan(laid: DataFrame, by, order, **scans: Scan) -> DataFrame:
    """Add one column per scan to a table made by :func:`lay_out`.

    A second scan over the outcome of a first one reads it from where it is written once.
    """
    by = as_list(by)
    if DEALT in laid.columns:
        laid = settle(laid)
    order = [*as_list(order), *([SALT] if SALT in laid.columns else [])]
    keys, back = _sort_keys(order), _sort_keys(order, turn=True)
    group = [PID] + by
    local = Window.partitionBy(*group).orderBy(*keys)
    behind = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    # reverse scans run forward over the turned-round order: Spark computes a frame that ends
    # at the last row anew for every row
    turned = Window.partitionBy(*group).orderBy(*back)
    aggs = {"sum": F.sum, "min": F.min, "max": F.max}

    out = laid.repartition(PID).withColumn(DEALT, F.lit(True))
    shifts = {k: s for k, s in scans.items() if s.kind in ("lag", "lead")}
    if shifts:
        out = out.withColumn("_rn", F.row_number().over(local)).withColumn(
            "_left", F.count(F.lit(1)).over(whole) - F.col("_rn")
        )
    for name, s in scans.items():
        if s.kind == "lag":
            out = out.withColumn(f"_l_{name}", F.lag(s.col, s.n).over(local))
        elif s.kind == "lead":
            out = out.withColumn(f"_l_{name}", F.lead(s.col, s.n).over(local))
        elif s.reverse and s.kind == "sum":
            rest = F.sum(s.col).over(whole) - F.sum(s.col).over(behind) + F.coalesce(s.col, F.lit(0))
            out = out.withColumn(f"_l_{name}", rest)
        else:
            over = turned.rowsBetween(Window.unboundedPreceding, Window.currentRow) if s.reverse else behind
            out = out.withColumn(f"_l_{name}", aggs[s.kind](s.col).over(over))

    # One row per (group, part), of the groups that may reach over several parts: two in a part at most.
    crossing = laid.filter(CROSS)
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = across.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    after = across.orderBy(PID).rowsBetween(1, Window.unboundedFollowing)
    tables = []
    sums = {k: s for k, s in scans.items() if k not in shifts}
    if sums:
        edges = crossing.groupBy(*group).agg(*[aggs[s.kind](s.col).alias(f"_e_{k}") for k, s in sums.items()])
        tables.append((edges, {k: aggs[s.kind](f"_e_{k}").over(after if s.reverse else before) for k, s in sums.items()}))
    for kind, sort in (("lag", back), ("lead", keys)):
        near = {k: s for k, s in shifts.items() if s.kind == kind}
        if near:
            far = max(s.n for s in near.values())
            # the rows at the near end of the part, nearest first
            ends = crossing.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*sort))).filter(F.col("_i") <= far)
            item = {k: F.when(F.col("_i") <= s.n, F.struct(F.col("_i").alias("i"), s.col.alias("v"))) for k, s in near.items()}
            edges = ends.groupBy(*group).agg(*[F.sort_array(F.collect_list(v)).alias(f"_e_{k}") for k, v in item.items()])
            rows = lambda n: across.orderBy(PID).rowsBetween(-n, -1) if kind == "lag" else across.orderBy(PID).rowsBetween(1, n)
            turn = F.reverse if kind == "lag" else (lambda x: x)
            tables.append((edges, {k: F.flatten(turn(F.collect_list(f"_e_{k}").over(rows(s.n)))) for k, s in near.items()}))

    there: dict[str, Column] = {}
    joined = list(out.columns)
    for t, (edges, picked) in enumerate(tables):
        spread = edges.withColumn("_span", F.count(F.lit(1)).over(across)).withColumns({f"_o_{k}": v for k, v in picked.items()})
        cols = [F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(by)] + [F.col(f"_o_{k}").alias(k) for k in picked]
        pair = spread.filter(F.col("_span") > 1).groupBy(F.col(PID).alias(f"_p{t}")).agg(F.collect_list(F.struct(*cols)).alias("_two"))
        pair = pair.select(f"_p{t}", F.get("_two", F.lit(0)).alias(f"_a{t}"), F.get("_two", F.lit(1)).alias(f"_b{t}"))
        out = out.join(pair, F.col(PID) == F.col(f"_p{t}"), "left")
        for k in picked:
            value = F.lit(None)
            for side in (f"_b{t}", f"_a{t}"):
                same = F.col(side).isNotNull()
                for i, c in enumerate(by):
                    same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"{side}.g{i}"))
                value = F.when(same, F.col(f"{side}.{k}")).otherwise(value)
            there[k] = value
    added = {}
    for name, s in scans.items():
        here, far = F.col(f"_l_{name}"), there[name]
        if s.kind == "lag":
            gap = s.n - F.col("_rn")  # 0-based place in the earlier rows, nearest first
            value = F.when(F.col("_rn") > s.n, here).otherwise(F.get(far, gap.cast("int"))["v"])
        elif s.kind == "lead":
            gap = s.n - 1 - F.col("_left")
            value = F.when(F.col("_left") >= s.n, here).otherwise(F.get(far, gap.cast("int"))["v"])
        elif s.kind == "sum":
            value = F.coalesce(here + F.coalesce(far, F.lit(0)), far)
        else:
            value = (F.least if s.kind == "min" else F.greatest)(here, far)
        added[name] = value
    kept = [c for c in joined if c in laid.columns or c == DEALT]
    return out.select(*[F.col(f"`{c}`") for c in kept if c not in added], *[v.alias(k) for k, v in added.items()])


def release(df: DataFrame) -> DataFrame:
    return df.drop(PID, SALT, CROSS, DEALT)


def ordered_scan(df: DataFrame, by, order, salt: bool = False, **scans: Scan) -> DataFrame:
    return release(scan(lay_out(df, by, order, salt), by, order, **scans))


def value_counts(df: DataFrame, by, value: str, **sums: Column) -> DataFrame:
    """Distinct non-null values per group with their count, running count and group total.

    Columns: by, value, n, cum (rows with a value <= this one), total, plus for every named
    extra sum its own per-value sum. Ties are merged before the shuffle, so one value held
    by a third of the rows costs one row here.
    """
    by = as_list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    )
    out = ordered_scan(counts, by, value, cum=running_sum("n"), _rest=running_sum("n", reverse=True))
    return out.withColumn("total", F.col("cum") + F.col("_rest") - F.col("n")).drop("_rest")


def in_parts(df: DataFrame, by, value: str, rows: int, to: str = "_part") -> DataFrame:
    """``df`` dealt by group and, in ``to``, the part of the group that the value is in: parts come one after another
    in the order of the values and have about a quarter of ``TASK_ROWS`` rows, equal values excepted.

    The values at which groups are cut are picked from those with a certain hash, some hundred in each part. The
    picked ones are all that is written, for groups are too costly to compute for their counts and again for the cuts.
    """
    if not tasks_of(df, rows):
        return df.withColumn(to, F.lit(0))
    by, part = as_list(by), max(1, base.TASK_ROWS // 4)
    step = max(1, part // 100)
    picked = settle(df.filter(F.pmod(F.xxhash64(value), F.lit(step)) == 0).select(*by, value))
    groups = picked.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("_v")).filter(F.size("_v") > part // step)
    cuts = F.transform(F.sequence(F.lit(part // step), F.size("_v"), F.lit(part // step)), lambda i: F.element_at("_v", i))
    out = df.join(small_side(groups.select(*by, cuts.alias("_cuts"))), by, "left")
    passed = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return dealt(out.withColumn(to, F.when(F.col("_cuts").isNull(), 0).otherwise(passed)).drop("_cuts"), rows, *by, to)


def quantiles(df: DataFrame, by, value: str, named: dict[str, float], counted: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles per group (one output column per name)."""
    by = as_list(by)
    vc = df if counted else value_counts(df, by, value)
    aggs = quantile_aggs(value, named)
    return vc.groupBy(*by).agg(*aggs)


def quantile_aggs(value: str, named: dict[str, float]) -> list[Column]:
    """Aggregates that read quantiles off a :func:`value_counts` table."""
    first = F.col("cum") - F.col("n")
    out = []
    for name, q in named.items():
        at = F.lit(float(q)) * (F.col("total") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        v_lo = F.max(F.when((first <= lo) & (lo < F.col("cum")), F.col(value)))
        v_hi = F.max(F.when((first <= hi) & (hi < F.col("cum")), F.col(value)))
        frac = F.max(at - lo)
        out.append((v_lo + (v_hi - v_lo) * frac).alias(name))
    return out
