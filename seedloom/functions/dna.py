"""Column functions on bases and variant alleles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def reverse_complement(col) -> Column:
    """Case is kept, N stays N, other letters are only reversed."""
    return F.reverse(F.translate(_c(col), "ACGTNacgtn", "TGCANtgcan"))


def classify_variant(ref, alt) -> Column:
    """SNP, INS, DEL or COMPLEX by allele lengths."""
    r, a = F.length(_c(ref)), F.length(_c(alt))
    return (
        F.when((r == 1) & (a == 1), "SNP").when((r == 1) & (a > 1), "INS").when((r > 1) & (a == 1), "DEL").otherwise("COMPLEX")
    )


def called_allele(ref, alts, a1, a2) -> Column:
    """STRUCT(allele, kind) of one sample's genotype, NULL for homozygous reference.

    Missing calls and out-of-range indices give N's of the reference length as COMPLEX,
    symbolic alleles the same as DEL; a heterozygous call takes its alternative, two
    alternatives the higher index.
    """
    r, alt, x, y = _c(ref), _c(alts), _c(a1), _c(a2)
    gap = F.repeat(F.lit("N"), F.length(r))
    missing = x.isNull() | y.isNull() | (x < 0) | (y < 0)
    pick = F.greatest(x, y)
    allele = F.get(alt, pick - 1)
    symbolic = allele.startswith("<") | allele.isin("*", ".")

    def named(a, k):
        return F.struct(a.alias("allele"), k.alias("kind"))

    return (
        F.when(missing, named(gap, F.lit("COMPLEX")))
        .when((x == 0) & (y == 0), None)
        .when(allele.isNull(), named(gap, F.lit("COMPLEX")))
        .when(symbolic, named(gap, F.lit("DEL")))
        .otherwise(named(allele, classify_variant(r, allele)))
    )
