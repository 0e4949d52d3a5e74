"""Sharding by balanced label propagation.

Documents with equal texts are linked. Labels start spread evenly and propagate: in every
round, each group's copies are counted per shard, and a document outside its group's best shard
moves there as far as that shard's quota allows. Documents without links fill the shards up at the
end, so the counts of any two shards differ by at most one (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedloom.llm.common import keep, table, text_or_empty

SHARDS = 16
# Steps by which a quota is filled: groups x parts of a group.
STEPS, PARTS = 512, 32
# Rows that one task puts in order at most, about.
TOGETHER = 50_000


def ranked(df: DataFrame, within: list[str], total: int, to: str, order: list[str]) -> DataFrame:
    """0-based rank of each row within ``within``, in an order that hashes decide.

    Rows are dealt into buckets of about ``TOGETHER``; buckets are ordered in one task each, and
    what stands before a bucket is a running sum over the table of bucket sizes.
    """
    buckets = max(1, -(-total // TOGETHER))
    key = F.pmod(F.xxhash64(*order, F.lit(3)), F.lit(buckets))
    dealt = df.withColumn("_bucket", key)
    sizes = dealt.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*within, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order))
    return (
        dealt.withColumn("_row", row)
        .join(starts, [*within, "_bucket"])
        .withColumn(to, F.col("_start") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_start")
    )


def _lookup(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def propagate(linked: DataFrame, targets: list[int]) -> DataFrame:
    """(group, doc, size, crc, label) once no document asks to move; no shard exceeds its target.

    Rounds end by themselves: a move goes from a shard to one with as many copies of the group or more, so
    the sum over groups of squared counts grows with each, and a round without moves closes a shard.

    Moves into a shard are taken group by group in steps of a bounded histogram
    (shards x STEPS x PARTS rows), which is the only table handed to all tasks. A shard that had to turn a
    step away is full but for less than that step and takes no more; its askers try the next best.
    """
    shards, closed = len(targets), set()
    while True:
        counts = linked.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
        load = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        free = [0 if s in closed else targets[s] - load.get(s, 0) for s in range(shards)]
        rooms = counts.withColumn("free", _lookup(free, F.col("label")))
        # Where the group has most copies and room is left; ties go to the smaller shard.
        best = rooms.filter("free > 0").groupBy("group").agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("best"))
        now = linked.join(counts, ["group", "label"]).join(best, "group", "left")
        to = -F.col("best.minus")
        gains = (F.col("best.n") > F.col("n")) | ((F.col("best.n") == F.col("n")) & (to < F.col("label")))
        step = F.pmod(F.xxhash64("group"), F.lit(STEPS)) * PARTS + F.pmod(F.xxhash64("doc", "crc", F.lit(5)), F.lit(PARTS))
        now = now.select(*linked.columns, F.when(gains, to).alias("to"), step.alias("step"))
        asked = now.filter("to is not null").groupBy("to", "step").agg(F.count(F.lit(1)).alias("n"))
        filled = F.sum("n").over(Window.partitionBy("to").orderBy("step"))
        fits = asked.withColumn("filled", filled).withColumn("fits", F.col("filled") <= _lookup(free, F.col("to")))
        totals = fits.groupBy("to").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("fits"), F.col("n")).otherwise(0)).alias("took")).collect()
        if not totals:
            break
        closed |= {r["to"] for r in totals if r["took"] < r["n"]}
        taken = fits.filter("fits").select("to", "step", F.lit(True).alias("taken"))
        linked = keep(
            now.join(F.broadcast(taken), ["to", "step"], "left").select(
                *[c for c in linked.columns if c != "label"],
                F.when(F.col("taken"), F.col("to")).otherwise(F.col("label")).cast("int").alias("label"),
            ),
            "labels",
        )
    return linked


def balanced_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has size 1 and the crc of no bytes, and is
    linked with other empty texts. Rows that share a doc_id, or have none, each get a place. An empty table
    gives an empty result. Other columns are ignored.
    """
    body = text_or_empty(text)
    rows = keep(
        docs.select(
            F.col(doc_id).cast("long").alias("doc"),
            (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("crc"),
            F.md5(body).alias("group"),
        ),
        "sizes",
    )
    total = rows.count()
    several = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    linked = rows.join(several, "group")
    alone = rows.join(several, "group", "left_anti")
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    n_linked = linked.count()
    start = ranked(linked, [], n_linked, "at", ["doc", "group"])
    start = keep(start.withColumn("label", F.pmod("at", F.lit(shards)).cast("int")).drop("at"), "labels")
    settled = propagate(start, targets)
    load = {r["label"]: r["n"] for r in settled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Documents without links take the places that are left, in an order of hashes.
    ends, filled = [], 0
    for s in range(shards):
        filled += targets[s] - load.get(s, 0)
        ends.append(filled)
    spot = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("at")))
    rest = ranked(alone, [], total - n_linked, "at", ["doc", "group"]).withColumn("label", spot).drop("at")
    cols = ["doc", "size", "crc", "group", "label"]
    placed = keep(settled.select(cols).union(rest.select(cols)), "placed")
    return ranked(placed, ["label"], total // shards, "slot", ["doc", "group"]).select(
        F.col("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("label").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
