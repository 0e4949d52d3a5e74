"""Readers of text corpora, question sets and dialogues; token tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.operators.base import as_list
from seedloom.operators.ordered import ordered_scan, row_index
from seedloom.operators.sets import merge_unique


def read_corpus_jsonl(spark: SparkSession, path, keys=("text",)) -> DataFrame:
    """Named text keys of JSON lines (plain or gzip, any glob), each as a list of texts.

    A key may hold one text or a list of sentences.
    """
    lines = spark.read.text(path).filter("trim(value) <> ''")

    def texts(k):
        raw = F.get_json_object("value", f"$.{k}")
        listed = F.from_json(raw, "array<string>")
        return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("[") & (F.size(listed) > 0), listed).otherwise(F.array(raw))

    return lines.select(*[texts(k).alias(k) for k in as_list(keys)])


def write_token_table(df: DataFrame, path: str, dataset: str, mode: int = 0) -> None:
    """Parquet (dataset, doc_id, seq_no, mode, tokens, length), sorted by document inside files."""
    rows = df.withColumn("dataset", F.lit(dataset)).withColumn("mode", F.lit(mode).cast("byte")).withColumn("length", F.size("tokens"))
    rows.repartitionByRange("doc_id", "seq_no").sortWithinPartitions("doc_id", "seq_no").write.mode("overwrite").parquet(path)


def append_token_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Token tables joined in name order; document ids go on from one table to the next."""
    out, offset = [], 0
    for name in sorted(tables):
        df = tables[name]
        top = df.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).alias("n")).first()["n"]
        out.append(df.withColumn("doc_id", F.col("doc_id") + F.lit(offset)))
        offset += top
    return reduce(lambda a, b: a.unionByName(b), out)


def read_passages_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, title`` with header; an id found twice is an error."""
    out = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return merge_unique([out.withColumn("id", F.col("id").cast("long"))], "id")


CONTEXT = "array<struct<title:string,text:string,passage_id:string,score:double>>"


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """(question, answers) of a TSV, plus positive, negative and hard-negative contexts of a JSON."""
    if path.rstrip("/").split("?")[0].endswith((".json", ".jsonl")):
        shape = f"question string, answers array<string>, positive_ctxs {CONTEXT}, negative_ctxs {CONTEXT}, hard_negative_ctxs {CONTEXT}"
        multi = not path.endswith(".jsonl")
        return spark.read.schema(shape).option("multiLine", multi).json(path)
    f = F.split("value", "\t")
    lines = spark.read.text(path).filter("value <> ''")
    # answers are written as a list of quoted texts
    listed = F.regexp_extract_all(f[1], F.lit(r"""(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")"""), F.lit(0))
    return lines.filter(F.size(f) >= 2).select(
        f[0].alias("question"), F.transform(listed, lambda a: F.regexp_replace(F.substring(a, F.lit(2), F.length(a) - 2), r"\\(['\"])", "$1")).alias("answers")
    )


# Fixed layouts of sentence-pair files: column places of (id, text_a, text_b, label), and
# the number of columns of a test file, which has no label.
PAIR_LAYOUTS = {
    "MNLI": {"train": (0, 8, 9, -1), "test": (0, 8, 9, None), "test_columns": 10},
    "QQP": {"train": (0, 3, 4, 5), "test": (0, 1, 2, None), "test_columns": 3},
}
MNLI_LABELS = {"contradiction": 0, "entailment": 1, "neutral": 2}


def read_pair_tsv(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(uid, text_a, text_b, label): the header tells a test file by its column count.

    Rows with missing fields or empty texts are skipped; test rows get label 0.
    """
    spec = PAIR_LAYOUTS[layout]
    lines = spark.read.text(path)
    head = lines.first()[0]
    width = len(head.split("\t"))
    test = width == spec["test_columns"]
    uid, a, b, label = spec["test" if test else "train"]
    f = F.split(F.trim("value"), "\t")
    at = lambda i: F.trim(F.element_at(f, i + 1 if i >= 0 else i))
    rows = lines.filter((F.col("value") != head) & (F.size(f) == width))
    if label is None:
        value = F.lit(0)
    elif layout == "MNLI":
        pairs = [F.lit(x) for kv in MNLI_LABELS.items() for x in kv]
        value = F.try_element_at(F.create_map(*pairs), at(label))
    else:
        value = at(label).try_cast("int")
    out = rows.select(at(uid).try_cast("long").alias("uid"), at(a).alias("text_a"), at(b).alias("text_b"), value.alias("label"))
    return out.filter((F.col("text_a") != "") & (F.col("text_b") != "") & F.col("uid").isNotNull() & F.col("label").isNotNull())


def read_reading_comp(spark: SparkSession, path: str) -> DataFrame:
    """One row per question: the article and four candidate texts (question with its option).

    A ``_`` in the question is filled by the option, else the option follows the question.
    """
    shape = "article string, questions array<string>, options array<array<string>>, answers array<string>"
    rows = spark.read.schema(shape).option("recursiveFileLookup", True).json(path)
    z = F.arrays_zip("questions", "options", "answers")
    out = rows.select("article", F.posexplode(z).alias("question_no", "_z"))
    q = F.col("_z.questions")
    cand = F.transform("_z.options", lambda o: F.when(q.contains("_"), F.replace(q, F.lit("_"), o)).otherwise(F.concat(q, F.lit(" "), o)))
    return out.select(F.trim(F.regexp_replace("article", r"\s+", " ")).alias("article"), "question_no", cand.alias("candidates"), (F.ascii("_z.answers") - 65).alias("label"))


DIALOG = (
    "chosen_topic string, dialog array<struct<speaker:string,text:string,"
    "checked_sentence:map<string,string>,checked_passage:map<string,string>>>"
)
SEARCH_DIALOG = (
    "apprentice_persona string, dialog_history array<struct<action:string,text:string,"
    "context:struct<contents:array<struct<title:string,content:array<string>>>,selected_contents:array<array<boolean>>>>>"
)


def read_dialogues(spark: SparkSession, path: str, layout: str = "wiki", lines: bool = False) -> DataFrame:
    """(conv_id, turn, role, topic, knowledge, text) rows of nested dialogue files.

    ``wiki``: chosen topic, turns with checked sentence and passage. ``search``: histories
    with actions and selected search contents. A file is one JSON array, or (``lines``) one
    dialogue per line, which also splits large files over tasks.
    """
    rows = spark.read.schema(DIALOG if layout == "wiki" else SEARCH_DIALOG).option("multiLine", not lines).json(path)
    rows = rows.withColumn("_f", F.input_file_name()).withColumn("_i", F.monotonically_increasing_id())
    rows = ordered_scan(rows, None, ["_f", "_i"], conv_id=row_index())
    if layout == "wiki":
        t = rows.select("conv_id", "chosen_topic", F.posexplode("dialog").alias("turn", "d"))
        one = lambda m: F.when(F.size(m) > 0, F.map_values(m)[0])
        passage = F.when(F.size("d.checked_passage") == 1, F.map_values("d.checked_passage")[0])
        topic = F.when(passage != "no_passages_used", passage).otherwise(F.col("chosen_topic"))
        role = F.when(F.lower("d.speaker").contains("wizard"), "wizard").otherwise("apprentice")
        return t.select("conv_id", "turn", role.alias("role"), F.coalesce(topic, F.col("chosen_topic")).alias("topic"), F.coalesce(one(F.col("d.checked_sentence")), F.lit("no_passages_used")).alias("knowledge"), F.col("d.text").alias("text"))
    t = rows.select("conv_id", F.posexplode("dialog_history").alias("turn", "d"))
    t = t.filter(F.col("d.action").isin("Wizard => Apprentice", "Apprentice => Wizard"))
    # first selected content: entry 0 of the flags says that nothing was selected
    contents, flags = F.col("d.context.contents"), F.col("d.context.selected_contents")
    pairs = F.transform(contents, lambda c, i: F.struct(c["title"].alias("title"), F.transform(c["content"], lambda s, j: F.struct(s.alias("s"), F.coalesce(F.get(F.get(flags, i + 1), j), F.lit(False)).alias("on"))).alias("c")))
    hits = F.flatten(F.transform(pairs, lambda p: F.transform(F.filter(p["c"], lambda e: e["on"]), lambda e: F.struct(p["title"].alias("title"), e["s"].alias("s")))))
    role = F.when(F.col("d.action").startswith("Wizard"), "wizard").otherwise("apprentice")
    return t.select("conv_id", "turn", role.alias("role"), F.coalesce(F.get(hits, F.lit(0))["title"], F.lit("no_topic")).alias("topic"), F.coalesce(F.get(hits, F.lit(0))["s"], F.lit("no_passages_used")).alias("knowledge"), F.col("d.text").alias("text"))
