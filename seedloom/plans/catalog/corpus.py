from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from seedloom.operators import corpus as co
from seedloom.operators import packing as pk
from seedloom.plans.registry import query


def lengths(t):
    """Documents with one token per word: the token is the word's length."""
    return t.tokens.select("doc_id", "source", F.transform("toks", lambda w: F.length(w)).alias("tokens"))


TOK = "(SELECT doc_id, source, list_transform(toks, lambda w: length(w)) AS tokens FROM tokens)"


def sources(t) -> list[tuple[str, int]]:
    rows = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()
    return [(r["source"], r["n"]) for r in rows]


@query(
    "c01_split_sentences",
    "doc_id:l sentence:s",
    "SELECT doc_id, sentence FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))), E' ') AS sentence FROM documents) WHERE sentence <> ''",
)
def _(t):
    return co.split_sentences(t.documents.select("doc_id", "text"))


@query(
    "c02_tokenise",
    "doc_id:l length:l tokens:al",
    "SELECT doc_id, len(ids) + 1 AS length, list_append(ids, 0) AS tokens FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: length(w)) AS ids FROM documents) WHERE len(ids) > 0",
)
def _(t):
    docs = t.documents.select("doc_id", F.lit(0).alias("seq_no"), "text")

    def by_length(texts):
        return texts.map(lambda s: [len(w) for w in s.split()])

    return co.tokenise(docs, "text", by_length, eod=0)


@query(
    "c03_partition_input",
    "doc_id:l part:l block:l",
    "SELECT doc_id, (k - 1) % 7 AS part, (k - 1) // CAST(ceil(n / 7.0) AS BIGINT) AS block FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents)",
)
def _(t):
    d = t.documents.select("doc_id")
    a = pk.partition_input(d, 7, "doc_id")
    return a.join(pk.partition_input(d, 7, "doc_id", contiguous=True).withColumnRenamed("part", "block"), "doc_id")


@query("c04_pair_image_text", "sample_id:l mode:l n:l", """SELECT page_id AS sample_id, 0 AS mode, 32 AS n FROM pages JOIN documents ON doc_id = page_id UNION ALL SELECT page_id, 1, octet_length(encode(html)) FROM pages JOIN documents ON doc_id = page_id""")
def _(t):
    texts = lengths(t).select(F.col("doc_id").alias("sample_id"), "tokens")
    images = t.pages.select(F.col("page_id").alias("sample_id"), F.encode("html", "UTF-8").alias("content"))
    out = co.pair_image_text(texts, images, 32, 0)
    return out.withColumn("n", F.when(F.col("mode") == 0, F.size("tokens")).otherwise(F.octet_length("content")))


@query(
    "c05_split_ratio",
    "doc_id:l split:s",
    """SELECT doc_id, CASE WHEN i < round_even(n * 0.8, 0) THEN 'train' WHEN i < round_even(n * 0.95, 0) THEN 'valid' ELSE 'test' END AS split
       FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)""",
)
def _(t):
    return pk.split_ratio(t.documents.select("doc_id"), "80,15,5", "doc_id")


@query("c06_document_order", "position:l doc_id:l epoch:l")
def _(t):
    return pk.document_order(t.documents.select("doc_id"), 3, 11, separate_last=True)


@query("c07_pack_sequences", "sample_id:l tokens:al", "SELECT sid AS sample_id, list(tok ORDER BY pos) AS tokens FROM flat_tokens WHERE sid < (total - 1) // 512 GROUP BY 1")
def _(t):
    return pk.pack_sequences(lengths(t), 512)


@query("c07_sample_parts", "sample_id:l n:l len:l", "SELECT sid AS sample_id, count(DISTINCT doc_id) AS n, count(*) AS len FROM flat_tokens WHERE sid < (total - 1) // 512 GROUP BY 1")
def _(t):
    docs = t.tokens.select("doc_id", F.size("toks").alias("length"))
    return pk.sample_parts(docs, 512).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"))


@query("c08_shuffle_samples", "position:l sample_id:l")
def _(t):
    n = t.documents.count()
    return pk.shuffle_samples(t.spark, n * 8 // 10, n, 5)


@query(
    "c09_lm_example",
    "doc_id:l labels:al loss_mask:al position_ids:al",
    f"SELECT doc_id, tokens[2:] AS labels, list_transform(tokens[2:], lambda v: CASE WHEN v IN (-1, 5) THEN 0 ELSE 1 END) AS loss_mask, range(0, len(tokens) - 1) AS position_ids FROM {TOK}",
)
def _(t):
    return co.lm_example(lengths(t), masked=[5])


@query(
    "c09_reset_positions",
    "doc_id:l position_ids:al",
    f"""WITH x AS (SELECT doc_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS k FROM (SELECT doc_id, tokens[:len(tokens) - 1] AS tokens FROM {TOK})),
        y AS (SELECT *, coalesce(max(CASE WHEN tok = 3 THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM x)
        SELECT d.doc_id, coalesce(list(k - stop - 1 ORDER BY k) FILTER (k IS NOT NULL), []) AS position_ids FROM {TOK} d LEFT JOIN y USING (doc_id) GROUP BY 1""",
)
def _(t):
    return co.lm_example(lengths(t), eod=3, reset=True)


@query("c10_blend", "position:l dataset_id:l dataset_sample_id:l")
def _(t):
    named = sources(t)
    return pk.blend(t.spark, [float(n * (i % 3 + 1)) for i, (_, n) in enumerate(named)], sum(n for _, n in named))


@query(
    "c11_blend_exhaustive",
    "position:l dataset_id:l dataset_sample_id:l",
    """SELECT row_number() OVER (ORDER BY (2.0 * k + 1) / n, d) - 1 AS position, d AS dataset_id, k AS dataset_sample_id FROM (
         SELECT d, n, unnest(range(0, n)) AS k FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS d FROM documents GROUP BY 1))""",
)
def _(t):
    return pk.blend_exhaustive(t.spark, [n for _, n in sources(t)])


@query(
    "c12_blend_sizes",
    "source:s want:l",
    "SELECT source, ceil(ceil(1000 * n / sum(n) OVER ()) * 1.005) AS want FROM (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY 1)",
)
def _(t):
    per = t.documents.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return pk.blend_wants(per, 1000, 0.005).select("source", "want")


def sentence_lengths(t):
    sents = co.split_sentences(t.documents.select("doc_id", "text"))
    item = F.struct("seq_no", F.size(F.split("sentence", " ")).alias("n"))
    return sents.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["n"]).alias("lengths"))


SENTENCES = (
    "(SELECT doc_id, list(len(string_split(s, ' ')) ORDER BY k) AS lens FROM (SELECT doc_id, trim(unnest(parts), E' ') AS s, generate_subscripts(parts, 1) AS k FROM "
    "(SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)) WHERE s <> '' GROUP BY doc_id)"
)


def draw(digest: str, nth: int) -> str:
    return f"(CAST('0x' || substr({digest}, {6 * nth + 1}, 6) AS BIGINT) / 16777216.0)"


def spans_sql(lens: str, target: int, min_sent: int, keep: int, short: float = 0.0) -> str:
    """Spans of every document: the end of the next one is found in the running sums."""
    d = "md5('1:' || doc_id || ':' || b)"
    want = f"CASE WHEN {draw(d, 0)} < {short} THEN 2 + CAST(floor({draw(d, 1)} * ({target} - 1)) AS BIGINT) ELSE {target} END" if short else str(target)
    e = f"greatest(len(list_filter(p, lambda x: x < p[b + 1] + want)), b + {min_sent})"
    step = f"SELECT doc_id, nth, b, CASE WHEN n - {e} < {max(keep, 1)} THEN n ELSE {e} END AS e, want, n, p"
    return f"""
      WITH RECURSIVE docs AS (SELECT doc_id, len(lens) AS n, list_prepend(0, list_transform(range(1, len(lens) + 1), lambda k: CAST(list_sum(lens[1:k]) AS BIGINT))) AS p FROM {lens} WHERE len(lens) >= {max(min_sent, 1)}),
      walk AS (
        {step} FROM (SELECT *, {want} AS want FROM (SELECT doc_id, n, p, 0 AS b, 0 AS nth FROM docs))
        UNION ALL
        {step} FROM (SELECT *, {want} AS want FROM (SELECT doc_id, n, p, e AS b, nth + 1 AS nth FROM walk WHERE e < n))
      ) SELECT doc_id, nth, b, e, want FROM walk"""


@query("c13_sentence_spans", "doc_id:l span_no:l begin:l end:l target:l", f'SELECT doc_id, nth AS span_no, b AS "begin", e AS "end", want AS target FROM ({spans_sql(SENTENCES, 64, 2, 2, 0.1)})')
def _(t):
    return co.sentence_spans(sentence_lengths(t), 64, short=0.1)


@query("c14_title_blocks", "doc_id:l begin:l end:l block:l", f'SELECT doc_id, b AS "begin", e AS "end", row_number() OVER (ORDER BY doc_id, nth) - 1 AS block FROM ({spans_sql(SENTENCES, 58, 1, 1)})')
def _(t):
    return co.title_blocks(sentence_lengths(t).withColumn("title_len", F.lit(6)), 64)


def chunked_sents(t):
    """Documents as lists of sentences of twelve tokens."""
    chunks = co.chunk_documents(lengths(t), 12)
    rows = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "tokens"))), lambda s: s["tokens"]).alias("sents"))
    return rows.withColumn("lengths", F.transform("sents", lambda s: F.size(s)))


TWELVES = f"(SELECT doc_id, list_transform(range(0, CAST(ceil(len(tokens) / 12.0) AS BIGINT)), lambda i: len(tokens[i * 12 + 1 : i * 12 + 12])) AS lens FROM {TOK} WHERE len(tokens) > 0)"


@query("c15_inverse_cloze", "block:l picked:l query:al block_tokens:al")
def _(t):
    docs = chunked_sents(t)
    blocks = co.title_blocks(docs.withColumn("title_len", F.lit(2)), 62)
    return co.inverse_cloze(co.span_sentences(docs, blocks).withColumn("title", F.array(F.lit(1), F.lit(2))), 64)


@query(
    "c16_mask_tokens",
    "sample_id:l tokens:al positions:al labels:al",
    f"""WITH w AS (SELECT doc_id, n, tok, k, md5('1:' || doc_id || ':' || k) AS d FROM (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS tok, generate_subscripts(tokens, 1) - 1 AS k FROM {TOK})),
        r AS (SELECT *, {draw("d", 0)} AS u, 1 + CAST({draw("d", 1)} >= 6 / 11.0 AS INT) + CAST({draw("d", 1)} >= 9 / 11.0 AS INT) AS reach FROM w),
        q AS (SELECT *, least(u, CASE WHEN lag(reach, 1) OVER o > 1 THEN lag(u, 1) OVER o END, CASE WHEN lag(reach, 2) OVER o > 2 THEN lag(u, 2) OVER o END) AS p FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
        m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) <= greatest(1, round(n * 0.15)) AS hit FROM q)
        SELECT doc_id AS sample_id, list(CASE WHEN NOT hit THEN tok WHEN {draw("d", 2)} < 0.8 THEN 4 WHEN {draw("d", 2)} < 0.9 THEN tok ELSE floor({draw("d", 3)} * 1000) END ORDER BY k) AS tokens,
          list(k ORDER BY k) FILTER (hit) AS positions, list(tok ORDER BY k) FILTER (hit) AS labels FROM m GROUP BY doc_id""",
)
def _(t):
    df = t.tokens.select(F.col("doc_id").alias("sample_id"), F.transform("toks", lambda w: F.length(w)).alias("tokens"), F.col("toks").alias("pieces"))
    return co.mask_tokens(df)


@query("c16_permute_tokens", "sample_id:l tokens:al positions:al labels:al swapped_to:al swapped_from:al")
def _(t):
    df = t.tokens.select(F.col("doc_id").alias("sample_id"), F.transform("toks", lambda w: F.length(w)).alias("tokens"), F.col("toks").alias("pieces"))
    return co.mask_tokens(df, permute=True)


@query("c17_pair_segments", "sample_id:s tokens:al types:al swapped:b")
def _(t):
    docs = chunked_sents(t)
    spans = co.span_sentences(docs, co.sentence_spans(docs, 120, min_sent=1))
    return co.pair_segments(spans.withColumn("sample_id", F.concat_ws(":", "doc_id", "span_no")), 120, 128)


@query("c18_span_corruption", "sample_id:l text_enc:al text_dec:al labels:al")
def _(t):
    df = pk.pack_sequences(lengths(t), 128, extra=0).select("sample_id", "tokens", F.transform("tokens", lambda v: F.lit("w")).alias("pieces"))
    masked = co.mask_tokens(df)
    return co.span_corruption(masked.select("sample_id", F.col("original").alias("tokens"), "spans"), 128, 64, list(range(9000, 9064)), 1, 2)


CHUNKS = f"(SELECT doc_id, i AS chunk_no, tokens[i * 64 + 1 : i * 64 + 64] AS tokens FROM (SELECT doc_id, tokens, unnest(range(0, CAST(ceil(len(tokens) / 64.0) AS BIGINT))) AS i FROM {TOK}))"


@query("c19_chunk_documents", "doc_id:l chunk_no:l tokens:al chunk_id:l", f"SELECT *, row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS chunk_id FROM {CHUNKS}")
def _(t):
    return co.number_chunks(co.chunk_documents(lengths(t), 64))


@query("c19_doc_chunk_offsets", "doc_id:l n_chunks:l chunks_upto:l", f"SELECT doc_id, n AS n_chunks, sum(n) OVER (ORDER BY doc_id) AS chunks_upto FROM (SELECT doc_id, count(*) AS n FROM {CHUNKS} GROUP BY 1)")
def _(t):
    return co.doc_chunk_offsets(co.chunk_documents(lengths(t), 64))


@query(
    "c20_chunk_sets",
    "dataset:s doc_id:l chunk_no:l part:s sampled:b",
    f"""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY source) * 0.75) AS tr FROM documents)
        SELECT source AS dataset, doc_id, chunk_no, CASE WHEN tr THEN 'train' ELSE 'valid' END AS part, tr AND row_number() OVER (PARTITION BY source, tr ORDER BY doc_id, chunk_no) <= floor(500.0 / 20) AS sampled
        FROM {CHUNKS} JOIN d USING (doc_id)""",
)
def _(t):
    chunks = co.chunk_documents(lengths(t), 64).join(t.documents.select("doc_id", F.col("source").alias("dataset")), "doc_id")
    ratios = chunks.select("dataset").distinct().withColumn("ratio", F.lit(1.0))
    return co.chunk_sets(chunks, 0.75, 500, ratios)


@query("c21_sample_chunks", "sample_id:l chunk_no:l n:l total:l", "SELECT sid AS sample_id, (pos - sid * 512) // 64 AS chunk_no, count(*) AS n, sum(tok) AS total FROM flat_tokens WHERE sid < (total - 1) // 512 AND pos < sid * 512 + 512 GROUP BY 1, 2")
def _(t):
    out = co.sample_chunks(pk.pack_sequences(lengths(t), 512), 512, 64)
    return out.select("sample_id", "chunk_no", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0), lambda a, v: a + v).alias("total"))


@query(
    "c22_sft_examples",
    "conv_id:l tokens:al labels:al loss_mask:al",
    """WITH w AS (SELECT conv_id, turn, k, role, length(string_split(text, ' ')[k]) AS tok FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations), generate_series(1, len(string_split(text, ' '))) g(k) WHERE role IN ('system', 'user', 'assistant')),
       c AS (SELECT conv_id, list(tok ORDER BY turn, k)[:127] AS t, list(CASE WHEN role = 'assistant' THEN tok ELSE -100 END ORDER BY turn, k)[:127] AS y FROM w GROUP BY 1),
       p AS (SELECT conv_id, list_resize(list_append(t, 0), 129, -1) AS t, list_resize(list_append(y, 0), 129, -1) AS y FROM c)
       SELECT conv_id, t[:128] AS tokens, y[2:129] AS labels, list_transform(y[2:129], lambda v: CASE WHEN v IN (-1, -100) THEN 0 ELSE 1 END) AS loss_mask FROM p""",
)
def _(t):
    turns = t.conversations.select("conv_id", "turn", "role", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("tokens"))
    return co.sft_examples(turns, 128, 0, -1)


@query("c23_pack_knapsack", "doc_id:l size:l bin:l")
def _(t):
    docs = t.documents.select("doc_id", (F.col("n_chars") % 2000 + 1).alias("size"))
    return pk.pack_knapsack(docs, "size", 2048, "doc_id")


@query("c24_truncate_to_budget", "doc_id:l tokens:al", f"SELECT doc_id, tokens[:32 - 16 + 2] AS tokens FROM {TOK}")
def _(t):
    d = lengths(t).select("doc_id", "tokens", F.col("tokens").alias("target"), F.lit(16).alias("image_tokens"), F.lit(2).alias("images"))
    return co.truncate_to_budget(d, 32, "image_tokens", "images")


@query(
    "c25_candidate_inputs",
    "doc_id:l tokens:al types:al mask:al",
    f"""SELECT doc_id, list_resize(list_concat([101], a, [102], b, [102]), 128, 0) AS tokens,
          list_resize(list_concat(list_transform(range(0, len(a) + 2), lambda i: 0), list_transform(range(0, len(b) + 1), lambda i: 1)), 128, 0) AS types,
          list_resize(list_transform(range(0, len(a) + len(b) + 3), lambda i: 1), 128, 0) AS mask
        FROM (SELECT doc_id, b, a[:greatest(0, 125 - len(b))] AS a FROM (SELECT doc_id, tokens AS a, list_reverse(tokens)[:24] AS b FROM {TOK}))""",
)
def _(t):
    d = lengths(t).select("doc_id", F.col("tokens").alias("a"), F.reverse("tokens").alias("b"))
    return co.candidate_inputs(d, 128, 101, 102, 0, max_b=24)


@query("c26_negatives", "doc_id:l negatives:al", f"SELECT doc_id, list_concat(list_filter(tokens, lambda v: v > 6), list_filter(tokens, lambda v: v <= 6))[:7] AS negatives FROM {TOK}")
def _(t):
    d = lengths(t).select("doc_id", F.filter("tokens", lambda v: v > 6).alias("hard"), F.filter("tokens", lambda v: v <= 6).alias("other"))
    return co.negatives(d, 7, key="doc_id")


@query(
    "c27_dialogue_examples",
    "conv_id:l turn:l context:s response:s",
    """WITH c AS (SELECT conv_id, turn, role, CASE WHEN text SIMILAR TO '(.|\\n)*[.?!]' THEN text ELSE text || '.' END AS text FROM conversations)
       SELECT conv_id, turn, context, text AS response FROM (SELECT *, string_agg(text, ' [SEP] ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM c) WHERE role = 'assistant' AND context IS NOT NULL""",
)
def _(t):
    c = t.conversations.withColumn("topic", F.lit("t")).withColumn("knowledge", F.lit(None).cast("string"))
    return co.dialogue_examples(c)


@query("c28_annotate", "doc_id:l n_words:l share:d", "SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda v: v[1] <> lower(v[1]))) / CAST(greatest(1, len(w)) AS DOUBLE) AS share FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda v: v <> '') AS w FROM documents)")
def _(t):
    def score(texts: pd.Series) -> pd.DataFrame:
        words = texts.str.split()
        return pd.DataFrame({"n_words": words.map(len), "share": [sum(w[:1].isupper() for w in ws) / max(1, len(ws)) for ws in words]})

    return co.annotate(t.documents.select("doc_id", "text"), score, "n_words:int,share:double").select("doc_id", "scores.*")


@query(
    "c29_assign_shards",
    "doc_id:l step:l rank:l",
    """SELECT doc_id, i // 32 AS step, (i % 32) // 4 AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 - 64 AS i, count(*) OVER () - 64 AS n FROM documents) WHERE i >= 0 AND (i // 32 + 1) * 32 <= n""",
)
def _(t):
    return pk.assign_shards(t.documents.select("doc_id"), 8, 4, "doc_id", consumed=64)


@query(
    "c30_resume_blocks",
    "start:l end:l worker:l",
    """SELECT start, "end", (row_number() OVER (ORDER BY start) - 1) % 4 AS worker FROM (SELECT start, least(start + 16, n) AS "end" FROM (SELECT n, unnest(range(0, n, 16)) AS start FROM (SELECT count(*) AS n FROM documents)))
       WHERE start NOT IN (SELECT DISTINCT doc_id // 16 * 16 FROM labels WHERE quality = 1)""",
)
def _(t):
    n = t.documents.count()
    lo = F.floor(F.col("doc_id") / 16) * 16
    done = t.labels.filter("quality = 1").select(lo.alias("start"), F.least(lo + 16, F.lit(n)).alias("end")).distinct()
    return pk.resume_blocks(t.spark, n, 16, done, 4)


@query("c31_fingerprint", "doc_id:l key:s", """SELECT doc_id, md5('{"lang":"' || lang || '","source":"' || source || '"}') AS key FROM documents""")
def _(t):
    return t.documents.select("doc_id", pk.fingerprint("source", "lang").alias("key"))


@query(
    "a47_token_budget",
    "tokens_per_epoch:l epochs:l separate_last:b",
    """SELECT t AS tokens_per_epoch, e AS epochs, e > 1 AND n - ((e - 1) * t - 1) // 512 < floor(((t - 1) // 512) * 0.8) AS separate_last FROM (SELECT t, n, CAST(ceil((n * 512 + 1) / CAST(t AS DOUBLE)) AS BIGINT) AS e FROM
       (SELECT sum(len(toks)) AS t, 1000 AS n FROM tokens))""",
)
def _(t):
    return pk.token_budget(t.tokens.select(F.size("toks").alias("length")), "length", 512, 1000)


@query(
    "f11_dialogue_history",
    "conv_id:l turn:l history:as",
    "SELECT conv_id, turn, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS history FROM conversations",
)
def _(t):
    return co.dialogue_history(t.conversations, 3)


@query(
    "f12_overlapping_eval_windows",
    "doc_id:l window_no:l text:al pad_mask:al",
    f"""SELECT doc_id, w AS window_no, list_resize(tokens[w * 32 + 1 : w * 32 + 129], 129, 0) AS text, list_transform(range(0, 128), lambda i: CASE WHEN i < len(tokens[w * 32 + 1 : w * 32 + 129]) - 1 AND (w = 0 OR i >= 96) THEN 1 ELSE 0 END) AS pad_mask
        FROM (SELECT doc_id, tokens, unnest(range(0, CAST(ceil(greatest(len(tokens) - 129, 0) / 32.0) AS BIGINT) + 1)) AS w FROM {TOK} WHERE len(tokens) > 1)""",
)
def _(t):
    return co.overlapping_eval_windows(lengths(t), 128, 32)


@query("x05_nucleotide_ids", "doc_id:l ids:al", "SELECT doc_id, list_transform(string_split(text, ''), lambda b: CASE b WHEN 'C' THEN 5 WHEN 'G' THEN 6 WHEN 'T' THEN 7 WHEN 'A' THEN 8 WHEN 'N' THEN 9 ELSE 1 END) AS ids FROM documents")
def _(t):
    return t.documents.select("doc_id", co.nucleotide_ids("text").alias("ids"))
