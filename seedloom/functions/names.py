"""Column functions on chromosome names, file names and annotation attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_chrom(col) -> Column:
    """``chrom01``, ``01``, ``Chr1`` -> ``chr1``; names without a number keep their text."""
    bare = F.regexp_replace(F.lower(F.trim(_c(col).cast("string"))), r"^chr(omosome|om)?_?", "")
    number = F.when(bare.rlike(r"^[0-9]{1,18}$"), bare).try_cast("long").cast("string")
    return F.when(bare == "", None).otherwise(F.concat(F.lit("chr"), F.coalesce(number, bare)))


def safe_name(col) -> Column:
    """Name fit for a file: anything but letters, digits, dot, dash, underscore becomes _."""
    return F.regexp_replace(_c(col), r"[^A-Za-z0-9_.\-]", "_")


def parse_attributes(col) -> Column:
    """``k=v;k=v`` or ``k "v"; k "v"`` -> map; of a repeated key the last value counts."""
    text = F.regexp_replace(_c(col), r'"([^"]*)"', "$1")
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^([^=\s]+)", 1).alias("k"),
            F.trim(F.regexp_extract(p, r"^[^=\s]+\s*[=\s]\s*(.*)$", 1)).alias("v"),
        ),
    )
    keys = F.array_distinct(F.transform(pairs, lambda e: e["k"]))
    last = F.transform(
        keys, lambda k: F.element_at(F.transform(F.filter(pairs, lambda e: e["k"] == k), lambda e: e["v"]), -1)
    )
    return F.map_from_arrays(keys, last)
