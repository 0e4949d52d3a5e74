"""Sample sequences from a reference and called variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.functions.dna import called_allele, reverse_complement
from seedloom.operators.base import as_list, let


def call_variants(variants: DataFrame) -> DataFrame:
    """Variants x samples -> (..., allele, kind), homozygous reference rows left out."""
    out = variants.withColumn("_a", called_allele("ref", "alts", "a1", "a2")).filter("_a is not null")
    return out.withColumn("allele", F.col("_a.allele")).withColumn("kind", F.col("_a.kind")).drop("_a")


def apply_variants(windows: DataFrame, variants: DataFrame, by=("block", "sample")) -> DataFrame:
    """Sequence of each window with its variants, and the reference coordinate of each base.

    ``windows`` has (by..., start, bases): start is the 1-based coordinate of the first base.
    ``variants`` has (by..., pos, ref, allele, kind). A SNP replaces its base; an insertion
    keeps the first base and repeats its coordinate for the new ones; deletions and complex
    changes are padded with N to the reference length. Variants that do not lie in the window
    are skipped. Of variants that touch the same base the leftmost is written last, as when
    they are applied from right to left.

    Only the bases a variant touches become rows; the stretches between stay substrings.
    """
    by = as_list(by)
    w = windows.withColumn("_n", F.length("bases"))
    v = variants.select(*by, "pos", "ref", "allele", "kind").join(w.select(*by, "start", "_n"), by)
    off = F.col("pos") - F.col("start")
    v = v.withColumn("_o", off.cast("int")).withColumn("_r", F.length("ref"))
    v = v.filter((F.col("_o") >= 0) & (F.col("_o") + F.col("_r") <= F.col("_n")))
    # what each variant writes over its reference bases: one text per base
    per_base = F.transform(
        F.sequence(F.lit(1), F.col("_r")),
        lambda i: F.when(
            F.col("kind").isin("SNP", "INS") & (i == 1),
            F.when(F.col("kind") == "INS", F.concat(F.substring("ref", 1, 1), F.substring(F.col("allele"), F.lit(2), F.length("allele")))).otherwise(F.col("allele")),
        ).otherwise(F.when(i <= F.length("allele"), F.substring(F.col("allele"), i, F.lit(1))).otherwise(F.lit("N"))),
    )
    edits = v.select(*by, "_o", F.posexplode(per_base).alias("_j", "_t"))
    edits = edits.groupBy(*by, (F.col("_o") + F.col("_j")).alias("_at")).agg(F.min_by("_t", "_o").alias("_t"))
    packed = edits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "_t"))).alias("_e"))
    out = w.join(packed, by, "left")
    empty = F.array().cast("array<struct<_at:int,_t:string>>")
    e = F.coalesce("_e", empty)

    def coords(a, b):
        # coordinates of offsets [a, b)
        return F.when(b > a, F.sequence((F.col("start") + a).cast("long"), (F.col("start") + b - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def pieces(x):
        # what stands before each edit, the edit, and in the end what stands behind the last one
        n = F.size(x)
        begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(x, k - 1)["_at"] + 1)
        stop = lambda k: F.when(k == n, F.col("_n")).otherwise(F.get(x, k)["_at"])
        text = lambda k: F.coalesce(F.get(x, k)["_t"], F.lit(""))
        here = lambda k: F.array_repeat((F.col("start") + stop(k)).cast("long"), F.length(text(k)))
        every = F.sequence(F.lit(0), n)
        return F.struct(
            F.array_join(F.transform(every, lambda k: F.concat(F.substring(F.col("bases"), begin(k) + 1, stop(k) - begin(k)), text(k))), "").alias("sequence"),
            F.flatten(F.transform(every, lambda k: F.concat(coords(begin(k), stop(k)), here(k)))).alias("pos_list"),
        )

    out = out.withColumn("_s", let(e, pieces))
    keep = [c for c in windows.columns if c != "bases"]
    return out.select(*keep, "_s.sequence", "_s.pos_list").withColumn("sequence_revcomp", reverse_complement("sequence")).withColumn("pos_list_revcomp", F.reverse("pos_list"))
