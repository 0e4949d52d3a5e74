"""Line dedup over range-partitioned hashes; the result is a keep bitmap per document, not text.

Only DataFrame and SQL functions. Lines become 128-bit hashes with document and position. The
hashes are range-partitioned and sorted by document and position within a hash, so a scan meets
the occurrence that stays first. A key that is frequent enough to fill a task by itself leaves
that path: a bounded table of such keys is decided by partial aggregates and met by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedloom.llm.common import keep, table, text_or_empty
from seedloom.operators.base import let

SHORTEST = 20
DOCUMENTS = 3
# Keys that leave the range-partitioned path; a key with over about 1/HOT of all lines is among them.
HOT = 512
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Stands for a null id: smaller than any other.
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line without the six ASCII space characters at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), text_or_empty(text).alias("text")
    )


def line_hashes(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc, text) -> h1, h2, doc, text_hash, n_lines, pos of every line long enough to count."""
    lines = F.split("text", "\n", -1)
    rows = docs.select("doc", F.xxhash64("text").alias("text_hash"), F.size(lines).alias("n_lines"), F.posexplode(lines).alias("pos", "line"))
    keyed = rows.select("doc", "text_hash", "n_lines", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= shortest)
    return keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_hash", "n_lines", "pos"
    )


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, documents: int = DOCUMENTS) -> DataFrame:
    """doc, text_hash, n_lines, n_dropped, keep_runs for every document that loses lines.

    ``keep_runs`` is the run-length form of the keep bitmap: (start, length) of each run of kept
    lines. A line is dropped if its key has ``shortest`` code points or more, is found under
    ``documents`` ids or more, and the document is not the one with the largest id. Rows that share
    a doc_id count as one document, each has its own bitmap (text_hash tells them apart); a
    null id is smaller than any other. Null and empty texts have one empty line. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = keep(line_hashes(_named(docs, doc_id, text), shortest), "line-hashes")
    top = rows.agg(F.expr(f"approx_top_k(h1, {HOT}, 20000)").alias("top")).first()["top"] or []
    hot = [r["item"] for r in top]
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)

    decided = rows.filter(is_hot).groupBy("h1", "h2").agg(F.max("doc").alias("last"), F.count_distinct("doc").alias("n"))
    decided = decided.filter(F.col("n") >= documents).drop("n")  # HOT rows at most
    from_hot = rows.filter(is_hot).join(F.broadcast(decided), ["h1", "h2"]).filter("doc < last")

    same = Window.partitionBy("h1", "h2")
    ranked = (
        rows.filter(~is_hot)
        .repartitionByRange("h1", "h2")
        .withColumn("nth", F.dense_rank().over(same.orderBy(F.col("doc").desc())))
        .withColumn("n", F.max("nth").over(same))
    )
    from_rest = ranked.filter((F.col("n") >= documents) & (F.col("nth") > 1))
    cols = ["doc", "text_hash", "n_lines", "pos"]
    dropped = from_rest.select(cols).union(from_hot.select(cols))
    p = F.col("gone")
    runs = F.transform(
        F.sequence(F.lit(0), F.size(p)),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get(p, i - 1) + 1).alias("start"),
            (F.when(i == F.size(p), F.col("n_lines")).otherwise(F.get(p, i)) - F.when(i == 0, F.lit(0)).otherwise(F.get(p, i - 1) + 1)).alias("length"),
        ),
    )
    return (
        dropped.groupBy("doc", "text_hash")
        .agg(F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone"))
        .select("doc", "text_hash", "n_lines", F.size(p).alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("keep_runs"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut to its kept lines, and n_lines and n_dropped of the text before.

    Columns of these two names are replaced; the others stay as they are.
    """
    own = docs.drop("n_lines", "n_dropped")
    keyed = own.withColumns(
        {"_doc_key": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), "_text_key": F.xxhash64(text_or_empty(text))}
    )
    found = bitmaps.select(F.col("doc").alias("_doc_key"), F.col("text_hash").alias("_text_key"), F.col("n_dropped").alias("_gone"), F.col("keep_runs").alias("_runs"))
    lines = F.split(text_or_empty(text), "\n", -1)
    # The text is split once, not once per run.
    cut = let(lines, lambda ls: F.array_join(F.flatten(F.transform("_runs", lambda r: F.slice(ls, r["start"] + 1, r["length"]))), "\n"))
    joined = keyed.join(found, ["_doc_key", "_text_key"], "left")
    new = {
        text: F.when(F.col("_runs").isNull(), F.col(text)).otherwise(cut),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce("_gone", F.lit(0)).cast("long"),
    }
    return joined.withColumns(new).select(*own.columns, "n_lines", "n_dropped")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = apply_bitmaps(docs, keep_bitmaps(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty("text"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), r AS (
  SELECT k.doc_id, k.line, k.pos, g.key IS NOT NULL AND k.doc_id < g.last AS gone
  FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
