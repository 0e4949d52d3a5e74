"""Packing, blending, splitting, shuffling and sharding of tokenised documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.operators.base import as_list, attach_row, seeded_key, small_side
from seedloom.operators.ordered import ordered_scan, row_index, running_sum


def global_prefix_sum(df: DataFrame, col: str, order, to: str = "before") -> DataFrame:
    """Sum of ``col`` over all earlier rows, without a single-task window."""
    out = ordered_scan(df, None, order, _upto=running_sum(col))
    return out.withColumn(to, F.col("_upto") - F.col(col)).drop("_upto")


def numbered(df: DataFrame, order, to: str = "row_no", total: str | None = None) -> DataFrame:
    """0-based row number in a global order (and the number of rows)."""
    out = ordered_scan(df, None, order, _fwd=row_index(), _bwd=row_index(reverse=True))
    if total:
        out = out.withColumn(total, F.col("_fwd") + F.col("_bwd") - 1)
    return out.withColumn(to, F.col("_fwd") - 1).drop("_fwd", "_bwd")


def split_fractions(text: str) -> list[tuple[float, float] | None]:
    """``"99,1,0"`` -> normalised [begin, end) bounds; a zero share has none."""
    parts = [float(p) for p in text.replace("/", ",").split(",") if p.strip()]
    parts = (parts + [0.0, 0.0, 0.0])[:3] if len(parts) < 3 else parts
    total = sum(parts)
    if total <= 0 or any(p < 0 for p in parts):
        raise ValueError(f"bad split {text}")
    bounds, at = [], 0.0
    for p in parts:
        share = p / total
        bounds.append((at, at + share) if share > 0 else None)
        at += share
    return bounds


def intersect_splits(a, b) -> list[tuple[float, float] | None]:
    """Overlap of two split vectors, split by split."""
    out = []
    for x, y in zip(a, b):
        lo, hi = (max(x[0], y[0]), min(x[1], y[1])) if x and y else (0.0, 0.0)
        out.append((lo, hi) if hi > lo else None)
    return out


def split_ratio(df: DataFrame, text: str, order, names=("train", "valid", "test")) -> DataFrame:
    """Contiguous splits [round(b n), round(e n)); rows outside every split are left out."""
    out = numbered(df, order, "_i", "_n")
    split = F.lit(None).cast("string")
    for name, bound in zip(names, split_fractions(text)):
        if bound:
            lo, hi = (F.bround(F.col("_n") * F.lit(v), 0) for v in bound)
            split = F.when((F.col("_i") >= lo) & (F.col("_i") < hi), name).otherwise(split)
    return out.withColumn("split", split).filter("split is not null").drop("_i", "_n")


def token_budget(df: DataFrame, length: str, seq: int, samples: int, extra: int = 1, share: float = 0.8) -> DataFrame:
    """Tokens per epoch, epochs needed, and whether the last epoch is shuffled on its own."""
    t = df.agg(F.sum(length).cast("long").alias("tokens_per_epoch"))
    need = F.lit(samples * seq + extra)
    out = t.withColumn("epochs", F.greatest(F.lit(1), F.ceil(need / F.col("tokens_per_epoch"))).cast("long"))
    per_epoch = F.floor((F.col("tokens_per_epoch") - extra) / seq)
    before = F.floor(((F.col("epochs") - 1) * F.col("tokens_per_epoch") - extra) / seq)
    from_last = F.lit(samples) - before
    return out.withColumn("separate_last", (F.col("epochs") > 1) & (from_last < F.floor(per_epoch * F.lit(share))))


def document_order(docs: DataFrame, epochs: int, seed: int, key: str = "doc_id", separate_last: bool = False) -> DataFrame:
    """Every document once per epoch, shuffled; the last epoch after all others if asked."""
    rows = docs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    last = F.lit(separate_last) & (F.col("epoch") == epochs - 1) & F.lit(epochs > 1)
    rows = rows.withColumn("_last", last.cast("int")).withColumn("_h", seeded_key(seed, key, "epoch"))
    return numbered(rows, ["_last", "_h", key, "epoch"], "position").drop("_last", "_h")


def pack_sequences(docs: DataFrame, seq: int, order="doc_id", tokens: str = "tokens", extra: int = 1, keep_partial: bool = False, pad: int = -1) -> DataFrame:
    """Concatenate documents and cut samples of ``seq`` tokens (plus ``extra`` shared ones).

    Each document is sent, as slices, to the samples it reaches; a sample then joins at most
    ``seq + extra`` tokens. The last partial sample is dropped, or kept and padded. Only
    lengths go through the prefix sum; ``order`` must identify a document.
    """
    key = as_list(order)
    sizes = docs.select(*key, F.size(tokens).cast("long").alias("_n")).filter("_n > 0")
    at = docs.join(small_side(global_prefix_sum(sizes, "_n", order, "_at")), key)
    total = docs.agg(F.sum(F.size(tokens)).cast("long").alias("_total"))
    at = attach_row(at, total)
    usable = F.col("_total") - extra
    last = (F.ceil(usable / seq) if keep_partial else F.floor(usable / seq)).cast("long") - 1
    first_s = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_at") - extra + 1 - 1) / seq).cast("long"))
    last_s = F.least(F.floor((F.col("_at") + F.col("_n") - 1) / seq).cast("long"), last)
    at = at.withColumn("_f", first_s).withColumn("_l", last_s).filter("_l >= _f")
    parts = at.withColumn("sample_id", F.explode(F.sequence("_f", "_l")))
    begin = F.greatest(F.col("sample_id") * seq, F.col("_at"))
    end = F.least(F.col("sample_id") * seq + seq + extra, F.col("_at") + F.col("_n"))
    parts = parts.filter(end > begin).select(
        "sample_id",
        begin.alias("_b"),
        F.slice(tokens, (begin - F.col("_at") + 1).cast("int"), (end - begin).cast("int")).alias("_t"),
    )
    out = parts.groupBy("sample_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_t"))), lambda s: s["_t"])).alias(tokens)
    )
    if keep_partial:
        fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(seq + extra) - F.size(tokens)))
        out = out.withColumn(tokens, F.concat(tokens, fill.cast(dict(docs.dtypes)[tokens])))
    return out


def sample_parts(docs: DataFrame, seq: int, order="doc_id", length: str = "length", extra: int = 1) -> DataFrame:
    """Sample index only: (sample_id, doc, offset, len) pieces, tokens untouched."""
    key = as_list(order)
    flat = docs.filter(F.col(length) > 0).select(*key, F.col(length).cast("long").alias("_n"))
    at = attach_row(global_prefix_sum(flat, "_n", order, "_at"), flat.agg(F.sum("_n").alias("_total")))
    last = F.floor((F.col("_total") - extra) / seq).cast("long") - 1
    at = at.withColumn("_f", F.greatest(F.lit(0).cast("long"), F.floor((F.col("_at") - extra) / seq).cast("long")))
    at = at.withColumn("_l", F.least(F.floor((F.col("_at") + F.col("_n") - 1) / seq).cast("long"), last)).filter("_l >= _f")
    parts = at.withColumn("sample_id", F.explode(F.sequence("_f", "_l")))
    begin = F.greatest(F.col("sample_id") * seq, F.col("_at"))
    end = F.least(F.col("sample_id") * seq + seq + extra, F.col("_at") + F.col("_n"))
    return parts.filter(end > begin).select("sample_id", *key, (begin - F.col("_at")).alias("offset"), (end - begin).alias("len"))


def shuffle_samples(spark: SparkSession, n: int, total: int, seed: int) -> DataFrame:
    """Permutation of [0, n), then of the final-epoch range [n, total)."""
    ids = spark.range(total).withColumn("_late", (F.col("id") >= n).cast("int")).withColumn("_h", seeded_key(seed, "id"))
    return numbered(ids, ["_late", "_h", "id"], "position").select("position", F.col("id").alias("sample_id"))


def blend_counts(weights: list[float], size: int) -> list[int]:
    """Samples per dataset: ``w n`` rounded by largest remainder, so that they add up to n."""
    total = sum(weights)
    exact = [w / total * size for w in weights]
    counts = [math.floor(e) for e in exact]
    for i in sorted(range(len(exact)), key=lambda i: (counts[i] - exact[i], i))[: size - sum(counts)]:
        counts[i] += 1
    return counts


def _interleave(spark: SparkSession, counts: list[int]) -> DataFrame:
    """Sample k of dataset d goes to the place (k + 1/2) / share of d; ties by dataset number."""
    offsets = [0]
    for c in counts:
        offsets.append(offsets[-1] + c)
    starts = F.array(*[F.lit(o).cast("long") for o in offsets])
    sizes = F.array(*[F.lit(c).cast("long") for c in counts])
    d = F.size(F.filter(F.slice(starts, 2, len(counts)), lambda o: o <= F.col("id")))
    rows = spark.range(offsets[-1]).withColumn("dataset_id", d)
    k = F.col("id") - F.get(starts, F.col("dataset_id"))
    rows = rows.withColumn("dataset_sample_id", k)
    key = (F.col("dataset_sample_id") * 2 + 1) / F.get(sizes, F.col("dataset_id"))
    return numbered(rows.withColumn("_key", key), ["_key", "dataset_id"], "position").select("position", "dataset_id", "dataset_sample_id")


def blend(spark: SparkSession, weights: list[float], size: int) -> DataFrame:
    """(position, dataset_id, dataset_sample_id) with each dataset within one of its share."""
    return _interleave(spark, blend_counts(weights, size))


def blend_exhaustive(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """Same order, each dataset used exactly ``sizes[d]`` times."""
    return _interleave(spark, list(sizes))


def blend_wants(shares: DataFrame, n: int, surplus: float = 0.0, weight: str = "weight", available: str | None = None) -> DataFrame:
    """Samples to ask of each dataset, one row each, in ``want``: ceil(ceil(n w) (1 + surplus)) for its share w
    of all weights. With ``available``, asking for more than that fails."""
    rows = attach_row(shares, shares.agg(F.sum(weight).alias("_all")))
    want = F.ceil(F.ceil(F.lit(n) * F.col(weight) / F.col("_all")) * F.lit(1 + surplus)).cast("long")
    if available is not None:
        want = F.when(want <= F.col(available), want).otherwise(F.raise_error(F.concat(want.cast("string"), F.lit(" samples wanted, available: "), F.col(available).cast("string"))))
    return rows.withColumn("want", want).drop("_all")


def blend_sizes(weights: list[float], n: int, surplus: float = 0.0, available: list[int] | None = None) -> list[int]:
    """Samples to ask of each dataset: ceil(ceil(n w) (1 + surplus)); asking too much is an error."""
    total = sum(weights)
    out = [math.ceil(math.ceil(n * w / total) * (1 + surplus)) for w in weights]
    if available is not None:
        for d, (want, have) in enumerate(zip(out, available)):
            if want > have:
                raise ValueError(f"dataset {d}: {want} samples wanted, {have} available")
    return out


def parse_blend(items: list[str]) -> list[tuple[float | None, str]]:
    """``w1 p1 w2 p2`` -> pairs; a list of paths alone has no weights."""
    if len(items) % 2 == 0:
        try:
            return [(float(w), p.strip()) for w, p in zip(items[::2], items[1::2])]
        except ValueError:
            pass
    return [(None, p.strip()) for p in items]


def knapsack_patterns(histogram: dict[int, int], cap: int) -> list[tuple[int, int, dict[int, int]]]:
    """Greedy fill over a size histogram: (first bin, repeats, {size: count}) per pattern.

    The largest size that still fits is always taken next. A bin depends only on which sizes
    are left, so one pattern repeats until one of its sizes runs short; the list is no longer
    than a few times the number of distinct sizes, however many items there are.
    """
    import bisect

    left = {s: c for s, c in histogram.items() if c > 0}
    if left and max(left) > cap:
        raise ValueError(f"item of size {max(left)} is larger than {cap}")
    sizes = sorted(left)
    out, bin_no = [], 0
    while sizes:
        used: dict[int, int] = {}
        room = cap
        while True:
            i = bisect.bisect_right(sizes, room) - 1
            while i >= 0 and left[sizes[i]] - used.get(sizes[i], 0) <= 0:
                i -= 1
            if i < 0:
                break
            s = sizes[i]
            take = min(room // s if s else left[s], left[s] - used.get(s, 0))
            used[s] = used.get(s, 0) + take
            room -= take * s
        repeats = min(left[s] // m for s, m in used.items())
        out.append((bin_no, repeats, used))
        bin_no += repeats
        for s, m in used.items():
            left[s] -= m * repeats
        sizes = [s for s in sizes if left[s] > 0]
    return out


def pack_knapsack(df: DataFrame, size: str, cap: int, order: str) -> DataFrame:
    """Bin number of every item under the greedy largest-that-fits rule, exact for any input size.

    Only the histogram of sizes (at most ``cap`` + 1 rows) comes to the driver; items get
    their rank within their size and from it their bin. Of equal sizes the latest in
    ``order`` goes first.
    """
    spark = df.sparkSession
    hist = df.groupBy(F.col(size).cast("long").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    over = df.agg(F.max(size)).first()[0]
    if over is not None and over > cap:
        raise ValueError(f"item of size {over} is larger than {cap}")
    patterns = knapsack_patterns({r["s"]: r["c"] for r in hist.collect()}, cap)
    seen: dict[int, int] = {}
    entries = []
    for first_bin, repeats, used in patterns:
        for s, m in used.items():
            a = seen.get(s, 0)
            entries.append((s, a, a + m * repeats, m, first_bin))
            seen[s] = a + m * repeats
    table = spark.createDataFrame(entries or [(0, 0, 0, 1, 0)], "_s long, _a long, _z long, _m long, _bin long")
    ranked = ordered_scan(df, size, "-" + order, _r=row_index()).withColumn("_r", F.col("_r") - 1)
    hit = (F.col(size).cast("long") == F.col("_s")) & (F.col("_r") >= F.col("_a")) & (F.col("_r") < F.col("_z"))
    out = ranked.join(small_side(table), hit)
    return out.select(*df.columns, (F.col("_bin") + F.floor((F.col("_r") - F.col("_a")) / F.col("_m"))).alias("bin"))


def partition_input(df: DataFrame, parts: int, order: str, contiguous: bool = False) -> DataFrame:
    """Partition number per row: round-robin, or runs of ceil(N / parts)."""
    out = numbered(df, order, "_i", "_n")
    part = F.floor(F.col("_i") / F.ceil(F.col("_n") / parts)) if contiguous else F.col("_i") % parts
    return out.withColumn("part", part).drop("_i", "_n")


def assign_shards(df: DataFrame, ranks: int, micro: int, order, consumed: int = 0, seed: int | None = None, drop_last: bool = True) -> DataFrame:
    """(epoch_pos, rank, step) of each sample for data-parallel ranks, after a resume offset.

    Sequential order, or a per-epoch permutation when ``seed`` is given.
    """
    keys = as_list(order)
    if seed is not None:
        df = df.withColumn("_h", seeded_key(seed, *keys))
        keys = ["_h"] + keys
    out = numbered(df, keys, "_i", "_n")
    total = ranks * micro
    i = F.col("_i") - consumed
    out = out.filter(i >= 0).withColumn("step", F.floor(i / total)).withColumn("rank", F.floor((i % total) / micro))
    if drop_last:
        out = out.filter((F.col("step") + 1) * total <= F.col("_n") - consumed)
    return out.withColumn("slot", i % micro).drop("_i", "_n", "_h")


def resume_blocks(spark: SparkSession, n: int, size: int, done: DataFrame, workers: int = 1) -> DataFrame:
    """Ranges of ``size`` ids in [0, n) with no written block yet, dealt over the workers."""
    blocks = spark.range((n + size - 1) // size).select((F.col("id") * size).alias("start"), F.least((F.col("id") + 1) * size, F.lit(n)).alias("end"))
    missing = blocks.join(done.select("start", "end"), ["start", "end"], "left_anti")
    return numbered(missing, "start", "_i").withColumn("worker", F.col("_i") % workers).drop("_i")


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks; empty when a recomputation agrees."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def fingerprint(*cols: str) -> Column:
    """md5 of the ordered JSON of configuration columns."""
    return F.md5(F.to_json(F.struct(*sorted(cols))))
