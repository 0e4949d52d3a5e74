from __future__ import annotations

from pyspark.sql import functions as F

from seedloom.functions import names as nm
from seedloom.functions import text as tx
from seedloom.operators import answers as an
from seedloom.plans.registry import query

NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[!"#$%&()*+,\-./:;<=>?@\[\]\\^`{{|}}~_'']', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"""
NORM_DROP = NORM.replace("' ', 'g'), '\\b", "'', 'g'), '\\b")


@query("x01_reverse_complement", "seqid:l rc:s", "SELECT seqid, reverse(translate(bases, 'ACGTNacgtn', 'TGCANtgcan')) AS rc FROM seqs")
def _(t):
    from seedloom.functions.dna import reverse_complement

    return t.seqs.select("seqid", reverse_complement("bases").alias("rc"))


@query("x06_normalize_chrom", "n_nationkey:l chrom:s", "SELECT n_nationkey, 'chr' || n_nationkey AS chrom FROM nation")
def _(t):
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, F.concat(F.lit(" chrom0"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("Chr"), k.cast("string"))).otherwise(F.lpad(k.cast("string"), 3, "0"))
    return t.nation.select("n_nationkey", nm.normalize_chrom(name).alias("chrom"))


@query("x09_array_json", "event_id:l text:s back:ad", "SELECT event_id, '[' || CAST(json_extract(props, '$.k') AS BIGINT) || ',' || event_id % 7 || ']' AS text, [CAST(json_extract(props, '$.k') AS DOUBLE), event_id % 7] AS back FROM events")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    df = t.events.select("event_id", tx.array_to_json(F.array(k, F.col("event_id") % 7)).alias("text"))
    return df.withColumn("back", tx.array_from_json("text"))


@query("x10_encode_label", "doc_id:l code:d", "SELECT doc_id, CASE WHEN quality = 1 THEN doc_id / 4.0 END AS code FROM labels")
def _(t):
    raw = F.when(F.col("quality") == 1, F.concat(F.lit(" "), (F.col("doc_id") / 4.0).cast("string"))).otherwise("wild")
    return t.labels.select("doc_id", tx.encode_label(raw).alias("code"))


# Latin letters only: the engines' word boundaries differ elsewhere, so other letters become x.
PLAIN = "regexp_replace(text, '[^ -~\\n]', 'x', 'g')"


def plain(t):
    return t.documents.select("doc_id", "source", F.regexp_replace("text", r"[^ -~\n]", "x").alias("text"))


@query("x15_normalize_answer", "doc_id:l norm:s", f"SELECT doc_id, {NORM.format(c=PLAIN)} AS norm FROM documents")
def _(t):
    return plain(t).select("doc_id", tx.normalize_answer("text").alias("norm"))


@query("x16_clean_text", "doc_id:l clean:s", r"SELECT doc_id, replace(replace(replace(regexp_replace(replace(text, chr(10), ' '), '\s+', ' ', 'g'), ' . ', '. '), ' . ', '. '), ' . ', '. ') AS clean FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.clean_text("text").alias("clean"))


@query("x16_detokenize_ptb", "doc_id:l out:s", """SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, '. ', ' .' || chr(10) || ' N '), ' ''', ''''), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)), ' n''t', 'n''t'), ' N ', '1 '), '$ 1', '$1'), '# 1', '#1') AS out FROM documents""")
def _(t):
    src = F.replace("text", F.lit(". "), F.lit(" .\n N "))
    return t.documents.select("doc_id", tx.detokenize(src, "ptb").alias("out"))


@query("x17_words", "doc_id:l words:as", "SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]'), lambda w: lower(w)) AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.words("text").alias("words"))


@query("x17_has_answer", "doc_id:l hit:b", """SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\pL\\pN\\pM])the[^\\pL\\pN\\pM\\x21-\\x7e]+of([^\\pL\\pN\\pM]|$)') OR regexp_matches(text, '(?i)(^|[^\\pL\\pN\\pM])and[^\\pL\\pN\\pM\\x21-\\x7e]+the([^\\pL\\pN\\pM]|$)') AS hit FROM documents""")
def _(t):
    df = t.documents.withColumn("answers", F.array(F.lit("the of"), F.lit("And the")))
    return tx.has_answer(df, "text", "answers", to="hit")


@query("x18_anls", "p_partkey:l score:d", "SELECT p_partkey, CASE WHEN d < 0.5 THEN 1 - d ELSE 0 END AS score FROM (SELECT p_partkey, least(levenshtein(lower(p_brand), 'brand#12') / CAST(greatest(length(p_brand), 8) AS DOUBLE), levenshtein(lower(p_brand), 'bran') / CAST(greatest(length(p_brand), 4) AS DOUBLE)) AS d FROM part)")
def _(t):
    return t.part.select("p_partkey", tx.anls(F.col("p_brand"), F.array(F.lit("Brand#12"), F.lit("  BRAN "))).alias("score"))


@query("x19_extract_answer", "doc_id:l braced:s number:s", """SELECT doc_id, CAST(n_chars AS VARCHAR) AS braced, CASE WHEN doc_id % 2 = 0 THEN n_chars || '.5' ELSE 'the answer was ' || n_chars END AS number FROM documents""")
def _(t):
    n = F.col("n_chars").cast("string")
    braced = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("so \\answer{")).otherwise("thus \\boxed{"), n, F.lit("} end}"))
    number = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("the answer is "), n, F.lit(".5 units"))).otherwise(F.concat(F.lit("the answer was "), n))
    return t.documents.select("doc_id", tx.extract_answer(braced).alias("braced"), tx.extract_answer(number, "number").alias("number"))


@query("x19_choice_letter", "doc_id:l letter:s", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE 'A' END AS letter FROM documents")
def _(t):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "Not (A), rather (B).").when(k == 1, "I take C !").when(k == 2, "it must surely be the green round thing").otherwise("no idea")
    opts = F.create_map(*[F.lit(v) for v in ("A", "red", "B", "blue", "C", "black", "D", "green")])
    return t.documents.select("doc_id", text.alias("x")).select("doc_id", tx.choice_letter("x", ["A", "B", "C", "D"], opts).alias("letter"))


@query("x20_truncate_bytes", "doc_id:l n:l")
def _(t):
    return t.documents.select("doc_id", F.octet_length(tx.truncate_bytes("text", 1000)).alias("n"))


@query("x21_build_prompt", "conv_id:l turn:l prompt:s", "SELECT conv_id, turn, '( ' || text || ' ) ' || role || ' => ' || upper(role) AS prompt FROM conversations")
def _(t):
    p = an.build_prompt("knowledge", history="text", topic="role", knowledge=F.upper("role"))
    return t.conversations.select("conv_id", "turn", p.alias("prompt"))


@query("x22_answer_field", "doc_id:l answers:as", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [lang] WHEN 1 THEN [lang, source] ELSE [source] END AS answers FROM documents")
def _(t):
    k = F.col("doc_id") % 3
    df = t.documents.select("doc_id", F.when(k == 0, F.col("lang")).alias("a"), F.when(k == 1, F.array("lang", "source")).alias("b"), F.when(k == 2, F.array("source")).alias("c"))
    return df.select("doc_id", tx.answer_field("a", "b", "c").alias("answers"))


@query("x23_join_pieces", "doc_id:l text:s", "SELECT doc_id, CASE WHEN text LIKE 'e%' THEN '##' ELSE '' END || replace(text, ' e', 'e') AS text FROM documents")
def _(t):
    pieces = F.transform(F.split("text", " "), lambda w: F.when(w.startswith("e"), F.concat(F.lit("##"), w)).otherwise(w))
    return t.documents.select("doc_id", tx.join_pieces(pieces).alias("text"))


@query("x24_masked_mean", "vec_id:l mean:ad", "SELECT vec_id, list_transform(range(1, 17), lambda i: (CAST(embedding[i] AS DOUBLE) + embedding[32 + i]) / 2) AS mean FROM embeddings")
def _(t):
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("embedding", r * 16 + 1, F.lit(16)))
    return t.embeddings.select("vec_id", tx.masked_mean(rows, F.array(*[F.lit(v) for v in (1, 0, 1, 0)])).alias("mean"))


@query("x24_combine_embeddings", "vec_id:l mean:ad n:l", "SELECT vec_id, list_transform(range(1, 33), lambda i: (CAST(embedding[i] AS DOUBLE) + embedding[32 + i]) / 2) AS mean, 64 AS n FROM embeddings")
def _(t):
    two = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return t.embeddings.select("vec_id", tx.combine_embeddings(two).alias("mean"), F.size(tx.combine_embeddings(two, "concat")).alias("n"))


@query("x25_repeat_replace", "doc_id:l n:l total:l", "SELECT doc_id, len(toks) + 2 * least(1, c) + greatest(0, least(1, c - 1)) AS n, list_sum(list_transform(toks, lambda w: CASE WHEN length(w) = 4 THEN 0 ELSE length(w) END)) + 99 * (3 * least(1, c) + 2 * greatest(0, least(1, c - 1)) + greatest(0, c - 2)) AS total FROM (SELECT doc_id, toks, len(list_filter(toks, lambda w: length(w) = 4)) AS c FROM tokens)")
def _(t):
    df = t.tokens.select("doc_id", F.transform("toks", lambda w: F.length(w)).alias("arr"))
    out = df.select("doc_id", tx.repeat_replace("arr", 4, F.array(F.lit(3), F.lit(2)), 99).alias("arr"))
    return out.select("doc_id", F.size("arr").alias("n"), F.aggregate("arr", F.lit(0), lambda a, v: a + v).alias("total"))


@query("x27_class_scores", "vec_id:l p0:d sig0:d cls:l", "SELECT vec_id, exp(embedding[1]) / list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE)))) AS p0, 1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))) AS sig0, list_position(embedding, list_max(embedding)) - 1 AS cls FROM embeddings")
def _(t):
    return t.embeddings.select(
        "vec_id", F.get(tx.class_scores("embedding"), F.lit(0)).alias("p0"), F.get(tx.class_scores("embedding", "sigmoid"), F.lit(0)).alias("sig0"), tx.predicted_class("embedding").alias("cls")
    )


@query(
    "a36_token_f1",
    "doc_id:l precision:d recall:d f1:d",
    f"""WITH d AS (SELECT doc_id, {PLAIN} AS text FROM documents), g AS (SELECT doc_id, string_split({NORM.format(c='text')}, ' ') AS ws, string_split({NORM.format(c='substr(text, 1, length(text) // 2)')}, ' ') AS ga FROM d WHERE text <> ''),
        a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM g) WHERE w <> '' GROUP BY 1, 2), b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ga) AS w FROM g) WHERE w <> '' GROUP BY 1, 2),
        s AS (SELECT doc_id, CAST(sum(least(a.n, b.n)) AS DOUBLE) AS same FROM a JOIN b USING (doc_id, w) GROUP BY 1), na AS (SELECT doc_id, sum(n) AS na FROM a GROUP BY 1), nb AS (SELECT doc_id, sum(n) AS nb FROM b GROUP BY 1)
        SELECT doc_id, coalesce(same / nb, 0) AS precision, coalesce(same / na, 0) AS recall, coalesce(2 * same / (na + nb), 0) AS f1 FROM g LEFT JOIN s USING (doc_id) LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id)""",
)
def _(t):
    df = plain(t).select("doc_id", F.col("text").alias("answer"), F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("guess"))
    return an.token_f1(df, "doc_id")


@query("a37_exact_match", "doc_id:l exact:d", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS exact FROM documents")
def _(t):
    df = plain(t).select("doc_id", "text", F.array(F.lit("zzz"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit("The  "), F.upper("text"), F.lit(" !")))).alias("golds"))
    return an.exact_match(df, "text", "golds")


@query(
    "a38_vqa_accuracy",
    "task:s accuracy:d",
    """SELECT 'VQAv2' AS task, 100 * avg(least(1.0, (n_chars % 5) / 3.0)) AS accuracy FROM documents UNION ALL SELECT 'ChartQA', 100 * avg(CASE WHEN abs(doc_id % 11) <= 5 THEN 1.0 ELSE 0 END) FROM documents UNION ALL SELECT 'AI2D', 100 * avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) FROM documents""",
)
def _(t):
    d = t.documents
    golds = F.concat(F.array_repeat(F.lit("yes"), (F.col("n_chars") % 5).cast("int")), F.array(F.lit("no")))
    v = an.vqa_accuracy(d.select(F.lit("yes").alias("pred"), golds.alias("golds")), "VQAv2").withColumn("task", F.lit("VQAv2"))
    c = d.select(F.concat((100 - F.col("doc_id") % 11).cast("string"), F.lit("%")).alias("pred"), F.array(F.lit("100")).alias("golds"))
    c = an.vqa_accuracy(c, "ChartQA").withColumn("task", F.lit("ChartQA"))
    a = an.vqa_accuracy(d.select(F.lit("en").alias("pred"), F.array("lang").alias("golds")), "AI2D").withColumn("task", F.lit("AI2D"))
    return v.unionByName(c).unionByName(a)


@query(
    "a39_ocr_score",
    "type:s score:l",
    """WITH h AS (SELECT source AS type, CASE WHEN contains(lower(trim(replace(text, chr(10), ' '))), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(trim(replace(text, chr(10), ' '))), 'and of') THEN 1 ELSE 0 END AS s FROM documents)
       SELECT type, sum(s) AS score FROM h GROUP BY 1 UNION ALL SELECT 'total', sum(s) FROM h""",
)
def _(t):
    df = t.documents.select(F.col("source").alias("type"), F.col("lang").alias("dataset"), F.col("text").alias("pred"), F.array(F.lit(" The"), F.lit("AND of ")).alias("golds"))
    return an.ocr_score(df)


@query(
    "a40_choice_accuracy",
    "role:s accuracy:d n:l",
    """WITH c AS (SELECT role, CASE WHEN turn % 3 = 2 THEN 0.0 ELSE 1.0 END AS ok FROM conversations) SELECT role, 100 * avg(ok) AS accuracy, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'total-acc', 100 * avg(ok), count(*) FROM c""",
)
def _(t):
    k = F.col("turn") % 3
    df = t.conversations.select("role", F.when(k == 0, "A. one").when(k == 1, "(A) one").otherwise("B two").alias("pred"), F.when(k == 1, "(A) one").otherwise("(a) one").alias("gold"))
    return an.choice_accuracy(df, "role", an.choice_correct())


@query(
    "a41_open_answer_accuracy",
    "source:s accuracy:d n:l",
    """WITH c AS (SELECT source, CASE WHEN doc_id % 3 = 2 THEN 0.0 ELSE 1.0 END AS ok FROM documents) SELECT source, 100 * avg(ok) AS accuracy, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'total-acc', 100 * avg(ok), count(*) FROM c""",
)
def _(t):
    k = F.col("doc_id") % 3
    n = F.col("n_chars").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Long text.\nThe result is "), n, F.lit(".00"))).when(k == 1, F.concat(F.lit("x = Blue Box "), n)).otherwise(F.lit("nothing known"))
    df = t.documents.select("source", text.alias("text"), F.when(k == 1, F.array(F.lit("blue box"))).otherwise(F.array(n)).alias("golds"))
    return an.open_answer_accuracy(df.withColumn("candidates", an.open_candidates(F.col("text"))), "source")
