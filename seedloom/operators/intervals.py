"""Windows over sequences, interval overlap, and the per-base / run-length forms of a track.

Interval tables use (chrom, start, end), 0-based and half-open unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.operators.base import BROADCAST_ROWS, as_list, dealt, for_each, let, seeded_key, seeded_unit, small_side
from seedloom.operators.ordered import derived, following, lay_out, ordered_scan, previous, release, row_index, running_sum, scan
from seedloom.session import settle


def sliding_windows(lens: DataFrame, w: int, overlap: int, length: str = "len") -> DataFrame:
    """Windows of ``w`` every ``w - overlap`` bases plus one flush with the end."""
    if not 0 <= overlap < w:
        raise ValueError("need 0 <= overlap < w")
    last = F.col(length) - F.lit(w)
    starts = F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(w - overlap).cast("long")), F.array(last))
    return (
        lens.filter(F.col(length) >= w)
        .withColumn("start", F.explode(starts))
        .withColumn("end", F.col("start") + F.lit(w))
    )


def stride_windows(regions: DataFrame, w: int, stride: int) -> DataFrame:
    """Windows from each region's start every ``stride``; the last ones stop at its end."""
    out = regions.filter(F.col("end") > F.col("start")).withColumn(
        "_at", F.explode(F.sequence(F.col("start").cast("long"), F.col("end") - 1, F.lit(stride).cast("long")))
    )
    return (
        out.withColumn("_stop", F.least(F.col("_at") + w, F.col("end")))
        .drop("start", "end")
        .withColumnRenamed("_at", "start")
        .withColumnRenamed("_stop", "end")
    )


def with_neighbours(df: DataFrame, by, order, cols: list[str]) -> DataFrame:
    """Previous and next row's values as ``prev_*`` / ``next_*`` columns."""
    scans = {f"prev_{c}": previous(c) for c in cols} | {f"next_{c}": following(c) for c in cols}
    return ordered_scan(df, by, order, **scans)


def with_ahead(df: DataFrame, col: str, n: int, by, order) -> DataFrame:
    return ordered_scan(df, by, order, **{f"{col}_ahead": following(col, n)})


def effective_intervals(blocks: DataFrame, by=None, strict: bool = True, order=("start", "end")) -> DataFrame:
    """Cut the overlap of neighbouring closed intervals at its midpoint.

    The left block keeps positions up to the midpoint, the right block those after it. An
    interval left empty is an error when ``strict``, else it keeps its full extent.
    """
    near = with_neighbours(blocks, by, list(order), ["start", "end"])

    def midpoint(a_start, a_end, b_start, b_end):
        lo, hi = F.greatest(a_start, b_start), F.least(a_end, b_end)
        known = a_start.isNotNull() & b_start.isNotNull()
        return F.when(known & (lo <= hi), F.floor((lo + hi) / 2).cast("long"))

    start, end = F.col("start"), F.col("end")
    left = midpoint(F.col("prev_start"), F.col("prev_end"), start, end)
    right = midpoint(start, end, F.col("next_start"), F.col("next_end"))
    out = near.withColumn("eff_start", F.coalesce(F.greatest(start, left + 1), start)).withColumn(
        "eff_end", F.coalesce(F.least(end, right), end)
    )
    empty = F.col("eff_start") > F.col("eff_end")
    if strict:
        checked = F.when(
            empty,
            F.raise_error(F.concat(F.lit("empty effective interval at "), start.cast("string"))).cast("long"),
        ).otherwise(F.col("eff_start"))
        out = out.withColumn("eff_start", checked)
    else:
        out = out.withColumn("_e", empty)
        out = (
            out.withColumn("eff_start", F.when(F.col("_e"), start).otherwise(F.col("eff_start")))
            .withColumn("eff_end", F.when(F.col("_e"), end).otherwise(F.col("eff_end")))
            .drop("_e")
        )
    return out.select(*blocks.columns, "eff_start", "eff_end")


# Each level of bins is so many times as wide as the one before it.
LEVEL = 4
# Intervals of one side in one bin that one task meets; more are dealt over slices.
CROWD = 20_000


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    flank: int = 0,
    by=("chrom",),
    closed: bool = True,
    bin_size: int = 16384,
    how: str = "inner",
    crowd: int = CROWD,
) -> DataFrame:
    """Pairs of overlapping intervals; columns of ``b`` are prefixed with ``b_``.

    Bins come in levels: ``bin_size`` wide, then four times as wide each. An interval is at home at
    the first level whose bins are as long as it is, so it has two bins there at most; a pair is
    matched at the higher level of the two, where the other side stands in two bins at most as
    well. A long interval costs a few rows, not one for each bin it covers. Only levels that the other
    side uses are written. A pair that shares both bins is kept in the first one. A bin with
    more than ``crowd`` rows of ``a`` is dealt over slices, and its rows of ``b`` go to each of them.
    The tasks of the join are as many as the counted rows fill.
    ``bin_size`` is best near the usual interval length. ``flank`` widens ``a`` for the test. Rows without start or end meet nothing.
    """
    if how != "inner":
        raise ValueError("overlap_join is an inner join; left-join its result on the key for the rest")
    by = as_list(by)
    last = 0 if closed else 1
    left = a.withColumn("_lo", F.col("start") - flank).withColumn("_hi", F.col("end") + flank - last)
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    right = right.withColumn("_blo", F.col("b_start")).withColumn("_bhi", F.col("b_end") - last)
    left = left.filter(F.col("_lo") <= F.col("_hi")).withColumn("_lev", _level("_lo", "_hi", bin_size))
    right = right.filter(F.col("_blo") <= F.col("_bhi")).withColumn("_blev", _level("_blo", "_bhi", bin_size))
    # A handful of numbers from each side: the levels in use, with their rows.
    seen = left.select(F.lit(0).alias("side"), F.col("_lev").alias("level")).union(right.select(F.lit(1), "_blev")).groupBy("side", "level").count().collect()
    # No bin can be crowded by fewer rows than a crowd.
    many = sum(r["count"] for r in seen if r["side"] == 0) > crowd
    used = [sorted(r["level"] for r in seen if r["side"] == side) for side in (0, 1)]
    # Rows that both sides have in all bins, of those that stand at their home in one.
    written = lambda side, levels: sum(r["count"] * sum(map(levels(r["level"]), used[1 - side])) for r in seen if r["side"] == side)
    at_home = sum(r["count"] for r in seen)
    if not all(used):
        return left.join(right.limit(0), F.lit(False)).drop("_lo", "_hi", "_blo", "_bhi", "_lev", "_blev")
    low = [n for n in used[1] if n >= used[0][0]]
    high = [n for n in used[0] if n > used[1][0]]
    parts = []
    if low:
        up = _in_bins(left, "_lo", "_hi", F.explode(F.filter(F.array(*map(F.lit, low)), lambda n: n >= F.col("_lev"))), "_at", "_bin", bin_size)
        parts.append((up, _in_bins(right, "_blo", "_bhi", F.col("_blev"), "_bat", "_bbin", bin_size), at_home + written(0, lambda own: lambda n: n >= own)))
    if high:
        up = _in_bins(right, "_blo", "_bhi", F.explode(F.filter(F.array(*map(F.lit, high)), lambda n: n > F.col("_blev"))), "_bat", "_bbin", bin_size)
        parts.append((_in_bins(left, "_lo", "_hi", F.col("_lev"), "_at", "_bin", bin_size), up, at_home + written(1, lambda own: lambda n: n > own)))
    out = None
    for lefts, rights, rows in parts:
        keys = {"_at": "_bat", "_bin": "_bbin"}
        if many:
            lefts, rights = _sliced(lefts, rights, by, crowd)
            keys["_slice"] = "_bslice"
        keys |= {c: f"b_{c}" for c in by}
        lefts, rights = dealt(lefts, rows, *keys), dealt(rights, rows, *keys.values())
        cond = F.lit(True)
        for here, there in keys.items():
            cond = cond & (F.col(here) == F.col(there))
        wide = _width(F.col("_at"), bin_size)
        first = F.greatest(F.floor(F.col("_lo") / wide), F.floor(F.col("_blo") / wide))
        hit = cond & (F.col("_lo") <= F.col("_bhi")) & (F.col("_hi") >= F.col("_blo")) & (F.col("_bin") == first)
        pairs = lefts.join(rights, hit).select(*a.columns, *[f"b_{c}" for c in b.columns])
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _width(level: Column, bin_size: int) -> Column:
    return F.lit(bin_size) * F.pow(F.lit(float(LEVEL)), level)


def _level(lo: str, hi: str, bin_size: int) -> Column:
    """The first level whose bins are as long as the interval."""
    length = (F.col(hi) - F.col(lo) + 1) / F.lit(bin_size)
    return F.greatest(F.lit(0), F.ceil(F.log(float(LEVEL), length))).cast("int")


def _in_bins(df: DataFrame, lo: str, hi: str, level: Column, at: str, to: str, bin_size: int) -> DataFrame:
    """One row for each bin of a level that an interval touches."""
    wide = _width(F.col(at), bin_size)
    return df.withColumn(at, level).withColumn(to, F.explode(F.sequence(F.floor(F.col(lo) / wide).cast("long"), F.floor(F.col(hi) / wide).cast("long"))))


def _sliced(left: DataFrame, right: DataFrame, by: list[str], crowd: int) -> tuple[DataFrame, DataFrame]:
    """``_slice`` and ``_bslice``: bins with more than ``crowd`` rows of ``left`` are split by their load.

    A row's slice is a hash of its values, so that a task run again deals it the same way.
    """
    keys = [*by, "_at", "_bin"]
    loads = settle(left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(crowd)).cast("int").alias("_n")).filter("_n > 1"))
    crowded = loads.limit(BROADCAST_ROWS + 1).count()
    if not crowded:
        return left.withColumn("_slice", F.lit(0)), right.withColumn("_bslice", F.lit(0))
    if crowded <= BROADCAST_ROWS:
        loads = F.broadcast(loads)
    dealt = F.pmod(F.xxhash64(*[f"`{c}`" for c in left.columns]), F.coalesce("_n", F.lit(1))).cast("int")
    left = left.join(loads, keys, "left").withColumn("_slice", dealt).drop("_n")
    other = loads.select(*[F.col(c).alias(f"b_{c}") for c in by], F.col("_at").alias("_bat"), F.col("_bin").alias("_bbin"), "_n")
    right = right.join(other, [*[f"b_{c}" for c in by], "_bat", "_bbin"], "left")
    return left, right.withColumn("_bslice", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")


def not_overlapping(a: DataFrame, b: DataFrame, by=("chrom",), bin_size: int = 16384) -> DataFrame:
    """Rows of ``a`` (half-open) that touch no interval of ``b``; ``a`` may repeat rows."""
    by = as_list(by)
    left = a.withColumn("_row", F.struct(*by, "start", "end"))
    spans = a.select(*by, "start", "end").distinct()
    hits = overlap_join(spans, b.select(*by, "start", "end"), by=by, closed=False, bin_size=bin_size)
    hits = hits.select(F.struct(*by, "start", "end").alias("_row")).distinct()
    return left.join(hits, "_row", "left_anti").drop("_row")


def extend_flank(g: DataFrame, f: int) -> DataFrame:
    out = g.withColumn("region_start", F.greatest(F.lit(1).cast("long"), F.col("start") - f)).withColumn(
        "region_end", F.col("end") + f
    )
    return out.withColumn("region_len", F.col("region_end") - F.col("region_start") + 1).withColumn(
        "gene_len", F.col("end") - F.col("start") + 1
    )


def explode_window(df: DataFrame, array_cols, pos: str = "pos") -> DataFrame:
    """One row per base at start + j; windows whose arrays do not fit their span are left out."""
    cols = as_list(array_cols)
    fits = F.lit(True)
    for c in cols:
        fits = fits & (F.size(c) == F.col("end") - F.col("start"))
    keep = [c for c in df.columns if c not in cols]
    return (
        df.filter(fits)
        .select(*keep, F.posexplode(F.arrays_zip(*cols)).alias("_j", "_v"))
        .select(*keep, (F.col("start") + F.col("_j")).alias(pos), *[F.col("_v")[c].alias(c) for c in cols])
    )


def misfit_windows(df: DataFrame, array_cols) -> DataFrame:
    """How many windows :func:`explode_window` leaves out."""
    bad = F.lit(False)
    for c in as_list(array_cols):
        bad = bad | (F.size(c) != F.col("end") - F.col("start"))
    return df.agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(bad, 1)).alias("dropped"))


def merge_overlapping(df: DataFrame, value="value", by=("chrom", "pos")) -> DataFrame:
    """Mean value per position over all windows that cover it."""
    return df.groupBy(*as_list(by)).agg(*[F.avg(v).alias(v) for v in as_list(value)])


def intervals_to_bases(track: DataFrame, pos: str = "pos") -> DataFrame:
    return (
        track.filter(F.col("end") > F.col("start"))
        .withColumn(pos, F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
        .drop("start", "end")
    )


# Positions of a tile in which runs are found.
RUN_TILE = 4096


def bases_to_intervals(bases: DataFrame, by=("chrom",), pos: str = "pos", value: str = "value") -> DataFrame:
    """Merge runs of neighbouring positions with the same value; zeros are not written.

    Runs are first found inside tiles of ``RUN_TILE`` positions, dealt to as many tasks as their rows fill;
    only the runs, not the bases, are put in order over all tiles and joined where they touch.
    """
    by = as_list(by)
    rows = bases.filter(F.col(value) != 0).select(*by, pos, value)
    tiled = dealt(rows.withColumn("_tile", F.floor(F.col(pos) / F.lit(RUN_TILE))), rows.count(), *by, "_tile")
    along = Window.partitionBy(*by, "_tile").orderBy(pos)
    follows = (F.col(pos) == F.lag(pos).over(along) + 1) & (F.col(value) == F.lag(value).over(along))
    near = tiled.withColumn("_new", F.coalesce(~follows, F.lit(True)).cast("long"))
    near = near.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = near.groupBy(*by, "_tile", "_run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.first(value).alias(value))
    # The last run of a tile comes after one that begins where it does.
    order = ["start", "end"]
    near = scan(lay_out(runs.drop("_tile", "_run"), by, order), by, order, _pe=previous("end"), _pv=previous(value))
    new = ~((F.col("start") == F.col("_pe")) & (F.col(value) == F.col("_pv")))
    near = near.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long"))
    out = release(scan(near, by, order, _run=running_sum("_new")))
    return out.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first(value).alias(value)).drop("_run")


def scaffold_fill(curve: DataFrame, eff: DataFrame, by=("block",), pos: str = "position", value: str = "value") -> DataFrame:
    """Every position of each closed effective interval, 0.0 where the curve has none.

    Of several curve rows at a position the one with the lowest ``ord`` wins when that
    column exists, else any one.
    """
    by = as_list(by)
    grid = eff.select(*by, F.explode(F.sequence(F.col("eff_start"), F.col("eff_end"))).alias(pos))
    order = F.col("ord") if "ord" in curve.columns else F.col(value)
    one = curve.groupBy(*by, pos).agg(F.min_by(value, order).alias(value))
    return grid.join(one, by + [pos], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def slice_positions(df: DataFrame, i0: int, i1: int, by=("block",), order="position") -> DataFrame:
    """Rows whose 1-based place within their block is in [i0, i1]."""
    out = ordered_scan(df, by, order, _place=row_index())
    return out.filter(F.col("_place").between(i0, i1)).drop("_place")


def position_window(df: DataFrame, centre: int, k: int, by=(), pos: str = "position") -> DataFrame:
    """Positions within k of the centre; an error unless each group has all 2k+1 of them."""
    by = as_list(by)
    near = df.filter(F.col(pos).between(centre - k, centre + k))
    seen = near.groupBy(*by).agg(F.count_distinct(pos).alias("n")).filter(F.col("n") != 2 * k + 1)
    if seen.limit(1).count() or not near.limit(1).count():
        raise ValueError(f"window {centre}±{k} is not fully covered")
    return near


def block_number(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    text = F.regexp_extract(c, r"block_(\d+)", 1)
    return F.when(text != "", text).try_cast("long")


def select_blocks(df: DataFrame, lo: int | None = None, hi: int | None = None, col: str = "block") -> DataFrame:
    """Blocks numbered in [lo, hi], in numeric order."""
    out = df.withColumn("_no", block_number(col)).filter(F.col("_no").isNotNull())
    if lo is not None:
        out = out.filter(F.col("_no") >= lo)
    if hi is not None:
        out = out.filter(F.col("_no") <= hi)
    return out.orderBy("_no").drop("_no")


def holdout_windows(index: DataFrame, ratio: float, seed: int = 0, by=("chrom", "file_name")) -> DataFrame:
    """Held-out windows that start inside a window and end before the window two further on.

    A row qualifies when it ends where the row two ahead starts. ``int(n * ratio)`` of the
    rows of each group are wanted; their new starts are uniform in [start, end]. When a
    group has no qualifying row, rows of the index itself are drawn. Draws come from key
    hashes, so the outcome does not depend on partitioning.
    """
    by = as_list(by)
    key = by + ["start", "end"]
    two = with_neighbours_ahead(index, by)
    two = two.withColumn("_fit", F.coalesce(F.col("end") == F.col("_s2"), F.lit(False)))
    two = two.withColumn("_h", seeded_key(seed, *key))
    totals = two.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_fit"), 1)).alias("_nfit")
    )
    rows = two.join(small_side(totals), by).filter((F.col("_nfit") == 0) | F.col("_fit"))
    picked = ordered_scan(rows, by, ["_h", "start"], _rank=row_index())
    picked = picked.filter(F.col("_rank") <= F.floor(F.col("_n") * F.lit(ratio)))
    width = F.col("end") - F.col("start")
    shift = F.floor(seeded_unit(seed + 1, *key) * (width + 1)).cast("long")
    moved = picked.withColumn("_ns", F.when(F.col("_fit"), F.col("start") + shift).otherwise(F.col("start")))
    moved = moved.withColumn("_ne", F.col("_ns") + width)
    kept = moved.filter(~F.col("_fit") | (F.col("_ne") <= F.col("_e2")))
    return kept.select(*by, F.col("_ns").alias("start"), F.col("_ne").alias("end"))


def with_neighbours_ahead(index: DataFrame, by) -> DataFrame:
    return ordered_scan(
        index.select(*as_list(by), "start", "end"),
        by,
        ["start", "end"],
        _s2=following("start", 2),
        _e2=following("end", 2),
    )


def match_chrom_prefix(requested: DataFrame, reference: DataFrame, name: str = "name") -> DataFrame:
    """Each requested name with the reference name it selects.

    Reference names that start with the request are candidates: a single one is taken, else
    an exact one, else the first in file order (``ord``). Both sides are name lists.
    """
    ref = reference.select(F.col(name).alias("matched"), F.col("ord").alias("_ord"))
    # every prefix of a reference name is a join key, so the match is a hash join
    keyed = ref.withColumn(
        name, F.explode(F.transform(F.sequence(F.lit(1), F.length("matched")), lambda i: F.substring(F.col("matched"), F.lit(1), i)))
    )
    return (
        requested.join(keyed, name)
        .withColumn("_inexact", (F.col("matched") != F.col(name)).cast("int"))
        .groupBy(name)
        .agg(F.min_by("matched", F.struct("_inexact", "_ord")).alias("matched"), F.count(F.lit(1)).alias("candidates"))
    )


def extract_windows(index: DataFrame, seqs: DataFrame, tracks: DataFrame | None = None, max_len: int | None = None,
                    track_ids: list[str] = (), chunk: str = "bases") -> DataFrame:
    """Sequence and stacked signal arrays for each window.

    ``seqs`` has chunks (seqid, chunk_start, bases); ``tracks`` is run-length
    (track, chrom, start, end, value). Windows get ``sequence`` and one array per track id,
    zero where the track says nothing.
    """
    win = index.withColumn("_stop", F.col("end") if max_len is None else F.least(F.col("end"), F.col("start") + max_len))
    # The passes over the windows read them from where they are written once.
    win = win.withColumn("_wid", F.struct("chrom", "start", "end"))
    win = settle(win) if derived(win) else win
    pieces = seqs.select(
        F.col("seqid").alias("chrom"),
        F.col("chunk_start").alias("start"),
        (F.col("chunk_start") + F.length(chunk)).alias("end"),
        F.col(chunk).alias("_text"),
    )
    span = settle(win.select("_wid", "chrom", "start", F.col("_stop").alias("end")).distinct())
    hits = overlap_join(span, pieces, closed=False)
    lo = F.greatest("start", "b_start")
    part = F.substring(F.col("b__text"), (lo - F.col("b_start") + 1).cast("int"), (F.least("end", "b_end") - lo).cast("int"))
    seq = hits.groupBy("_wid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(lo.alias("p"), part.alias("t")))), lambda s: s["t"]), "").alias("sequence")
    )
    out = win.join(seq, "_wid", "left")
    if tracks is not None:
        cover = overlap_join(span, tracks.filter(F.col("track").isin(*track_ids)), closed=False)
        from_ = F.greatest("start", "b_start") - F.col("start")
        runs = cover.withColumn(
            "_run", F.struct(from_.alias("i"), (F.least("end", "b_end") - F.col("start")).alias("j"), F.col("b_value").alias("v"))
        )
        for tid in track_ids:
            mine = (
                runs.filter(F.col("b_track") == tid)
                .groupBy("_wid")
                .agg(F.array_sort(F.collect_list("_run")).alias("_runs"))
            )
            out = out.join(mine, "_wid", "left").withColumn(
                f"signal_{tid}", runs_to_array(F.col("_runs"), F.col("_stop") - F.col("start"))
            ).drop("_runs")
    return out.drop("_wid", "_stop")


def runs_to_array(runs: Column, length: Column) -> Column:
    """Sorted, non-overlapping runs (i, j, v) -> a dense array, zeros in the gaps."""
    zero = F.lit(0.0)

    def fill(rs):
        # before each run its gap, then the run; behind the last one zeros up to the length
        begin = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(rs, k - 1)["j"])
        stop = lambda k: F.coalesce(F.get(rs, k)["i"], length.cast("long"))
        value = lambda r: F.when(F.isnan(r["v"]), zero).otherwise(F.coalesce(r["v"], zero))
        gap = lambda k: F.array_repeat(zero, (stop(k) - begin(k)).cast("int"))
        run = lambda k: F.array_repeat(value(F.get(rs, k)), F.coalesce(F.get(rs, k)["j"] - F.get(rs, k)["i"], F.lit(0)).cast("int"))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(rs)), lambda k: F.concat(gap(k), run(k))))

    return let(F.coalesce(runs, F.array().cast("array<struct<i:bigint,j:bigint,v:double>>")), fill)


def pad_text(col: Column, n: int, fill: str = "N") -> Column:
    return F.rpad(F.substring(col, 1, n), n, fill)


def pad_signal(col: Column, n: int, fill: float = 0.0) -> Column:
    cut = F.slice(col, 1, n)
    return F.concat(cut, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(n) - F.size(cut))))


def array_quantile(col: Column, q: float) -> Column:
    """Linear-interpolated quantile of one array (a window, so bounded by its length)."""


    def read(s):
        at = F.lit(q) * (F.size(s) - 1)
        lo, hi = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return lo + (hi - lo) * (at - F.floor(at))

    return let(F.array_sort(col), read)


def pad_window(df: DataFrame, n: int, text: str = "sequence", signals=(), clip: str | None = None, q: float = 0.99) -> DataFrame:
    """Cut or pad a window's sequence (N) and signals (0.0) to ``n`` bases.

    The ``clip`` signal is first limited to its own ``q`` quantile inside the window.
    """
    out = df
    if clip:
        limited = let(array_quantile(F.col(clip), q), lambda cap: F.transform(clip, lambda v: F.least(v, cap)))
        out = out.withColumn(clip, limited)
    for s in as_list(signals):
        out = out.withColumn(s, pad_signal(F.col(s), n))
    return out.withColumn(text, pad_text(F.col(text), n))


def paired_track_index(windows: DataFrame, tracks: DataFrame, stats: DataFrame) -> DataFrame:
    """Windows x cell type with RNA+, RNA- and ATAC tracks and per-strand mean and cap.

    ``tracks`` has (cell_type, kind, track) with kind rna_plus | rna_minus | atac; ``stats``
    has (track, mean, cap). Only cells with all three tracks are kept.
    """
    kinds = ["rna_plus", "rna_minus", "atac"]
    named = tracks.join(small_side(stats), "track", "left")
    cells = named.groupBy("cell_type").pivot("kind", kinds).agg(
        F.min("track").alias("track"),
        F.min_by("mean", "track").alias("mean"),
        F.min_by("cap", "track").alias("cap"),
    )
    cells = cells.filter(
        F.col("rna_plus_track").isNotNull() & F.col("rna_minus_track").isNotNull() & F.col("atac_track").isNotNull()
    ).drop("atac_mean", "atac_cap")
    return for_each(windows, cells, ["chrom", "start", "end"])


def multimodal_index(meta: DataFrame, windows: DataFrame, heads: list[str]) -> DataFrame:
    """Per biosample the first track of each assay_strand head, joined with the windows.

    ``meta`` has (biosample, assay, strand, track_index, nonzero_mean); a missing mean is 1.0.
    """
    m = meta.withColumn("_head", F.concat_ws("_", "assay", "strand"))
    wide = m.groupBy("biosample").pivot("_head", heads).agg(
        F.min("track_index").alias("track"),
        F.min_by("nonzero_mean", "track_index").alias("mean"),
    )
    for h in heads:
        wide = wide.withColumn(f"{h}_mean", F.coalesce(F.col(f"{h}_mean"), F.lit(1.0)))
    return for_each(windows, wide, ["chrom", "start", "end"])


def call_windows(df: DataFrame, eps: float, p1: str = "p1", p2: str = "p2", names=("japonica", "indica")) -> DataFrame:
    """Window call from two class probabilities: one above ``eps`` and the other below it."""
    a, b = F.col(p1), F.col(p2)
    return df.withColumn(
        "call",
        F.when((a >= eps) & (b < eps), names[0]).when((b >= eps) & (a < eps), names[1]).otherwise("uncertain"),
    )


def predictions_to_track(df: DataFrame, eps: float, p1: str = "p1", p2: str = "p2", by=("chrom", "start", "end")) -> DataFrame:
    """Average repeated windows, then call each one."""
    return call_windows(merge_overlapping(df, [p1, p2], by), eps, p1, p2)


def chrom_number(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_extract(c.cast("string"), r"(\d+)", 1)
    return F.when(digits != "", digits).try_cast("long")


def order_by_genome(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Global genome order: chromosome number (names without one last), then start, end."""
    return df.orderBy(chrom_number(chrom).asc_nulls_last(), F.col(chrom), "start", "end")


def region_mask(df: DataFrame, mask: str, cols) -> DataFrame:
    """Array positions where the mask exceeds 0.5."""
    cols = as_list(cols)
    kept = F.filter(F.arrays_zip(mask, *cols), lambda r: r[mask] > 0.5)
    out = df.withColumn("_kept", kept)
    for c in cols:
        out = out.withColumn(c, F.col("_kept").getField(c))
    return out.drop("_kept")
