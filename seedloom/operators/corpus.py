"""From raw documents and dialogues to token tables and training examples."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.functions import spans as sp
from seedloom.functions.signal import _c
from seedloom.operators.base import as_list, attach_row, let, seeded_key, seeded_unit, small_side
from seedloom.operators.ordered import ordered_scan, previous, row_index, running_sum


def split_sentences(df: DataFrame, text: str = "text", keep_newlines: bool = False, splitter: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """One row per sentence (seq_no from 0). ``splitter`` is text series -> list series.

    The built-in rule ends a sentence after . ! ? and white space. Either sees whole texts.
    """
    if splitter is not None:
        sents = F.pandas_udf(splitter, "array<string>")(text)
    else:
        gap = r"([.!?])[ \t\x0B\f\r]+" if keep_newlines else r"([.!?])\s+"
        sents = F.split(F.regexp_replace(text, gap, "$1\u0001"), "\u0001")
    keep = [c for c in df.columns if c != text]
    out = df.select(*keep, F.posexplode(sents).alias("_i", "sentence")).filter(F.col("sentence") != "")
    if keep_newlines is False:
        out = out.withColumn("sentence", F.trim("sentence")).filter(F.col("sentence") != "")
    return out.select(*keep, F.col("_i").cast("long").alias("seq_no"), "sentence")


# Token ids of the nucleotide vocabulary, in order.
NUCLEOTIDE_VOCAB = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "C", "G", "T", "A", "N")


def nucleotide_ids(col) -> Column:
    """One id per base; anything outside the vocabulary is unknown."""
    bases = F.array(*[F.lit(b) for b in NUCLEOTIDE_VOCAB[5:]])
    return F.transform(
        F.filter(F.split(_c(col), ""), lambda b: b != ""),
        lambda b: F.when(F.array_position(bases, b) > 0, F.array_position(bases, b) + 4).otherwise(F.lit(1)).cast("int"),
    )


def word_ids(col, vocab: int) -> Column:
    """White-space words hashed to ids; a stand-in where no tokenizer is given."""
    words = F.filter(F.split(_c(col), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(vocab)).cast("int"))


def tokenise(df: DataFrame, text: str, tokenizer: Callable[[pd.Series], pd.Series] | Column, doc: str = "doc_id", seq: str = "seq_no", eod: int | None = None) -> DataFrame:
    """Token arrays per sentence; empty ones go, the end-of-document id joins the last one.

    ``tokenizer`` is a text series -> id-list series function (one Arrow call per batch) or a
    ready column.
    """
    ids = tokenizer if isinstance(tokenizer, Column) else F.pandas_udf(tokenizer, "array<int>")(text)
    out = df.withColumn("tokens", ids).filter(F.size("tokens") > 0).drop(text)
    if eod is not None:
        out = out.withColumn("_last", F.max(seq).over(Window.partitionBy(doc)))
        end = F.when(F.col(seq) == F.col("_last"), F.array(F.lit(eod))).otherwise(F.array().cast("array<int>"))
        out = out.withColumn("tokens", F.concat("tokens", end)).drop("_last")
    return out.withColumn("length", F.size("tokens"))


def pair_image_text(texts: DataFrame, images: DataFrame, n: int, eod: int, key: str = "sample_id") -> DataFrame:
    """Text rows (mode 0, padded or cut to n with the end id) and their image bytes (mode 1)."""
    cut = F.slice("tokens", 1, n - 1)
    fill = F.array_repeat(F.lit(eod), F.lit(n) - F.size(cut))
    text = texts.join(images.select(key), key, "left_semi").select(
        key, F.lit(0).cast("byte").alias("mode"), F.concat(cut, fill).alias("tokens"), F.lit(None).cast("binary").alias("content")
    )
    image = images.join(texts.select(key), key, "left_semi").select(
        key, F.lit(1).cast("byte").alias("mode"), F.lit(None).cast("array<int>").alias("tokens"), "content"
    )
    return text.unionByName(image)


def lm_example(df: DataFrame, tokens: str = "tokens", pad: int = -1, eod: int | None = None, masked=(), eod_loss: bool = True, reset: bool = False) -> DataFrame:
    """Inputs, shifted labels, loss mask and position ids of packed samples.

    Loss is off for padding, for the listed label tokens and, if asked, for the end id.
    With ``reset`` positions restart after each end id.
    """
    n = F.size(tokens)
    x, y = F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1)
    off = [pad, *masked] + ([eod] if eod is not None and not eod_loss else [])
    out = df.withColumn("labels", y).withColumn("inputs", x)
    out = out.withColumn("loss_mask", F.transform("labels", lambda v: F.when(v.isin(*off), 0).otherwise(1)))
    if reset and eod is not None:
        # Lengths of the parts that end ids close, each counted from 0.
        ends = F.array_compact(F.transform("inputs", lambda v, i: F.when(v == eod, i)))

        def counted(e):
            stop = lambda k: F.when(k < F.size(e), F.get(e, k)).otherwise(n - 2)
            part = lambda k: stop(k) - F.when(k > 0, F.get(e, k - 1)).otherwise(-1)
            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(e)), lambda k: sp.upto(part(k))))

        ids = F.when(n > 1, let(ends, counted)).otherwise(sp.none())
    else:
        ids = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return out.withColumn("position_ids", ids)


SPANS = "array<struct<begin:int,end:int,target:int>>"


def sentence_spans(df: DataFrame, target: int, lengths: str = "lengths", key: str = "doc_id", min_sent: int = 2, short: float = 0.0, seed: int = 1, longest: int | None = None) -> DataFrame:
    """Spans (begin, end, target) of each document's sentences; see ``functions.spans``."""
    udf = F.pandas_udf(lambda a, t, k: sp.span_series(a, t, k, min_sent, 2, short, seed, longest), SPANS)
    rows = df.withColumn("_s", udf(F.col(lengths), F.lit(target), F.col(key).cast("string")))
    return rows.select(key, F.posexplode("_s").alias("span_no", "_x")).select(key, "span_no", "_x.*")


def title_blocks(df: DataFrame, target: int, lengths: str = "lengths", title_len: str = "title_len", key: str = "doc_id", min_sent: int = 1, longest: int | None = None) -> DataFrame:
    """Blocks of sentences that leave room for the title, numbered over all documents."""
    udf = F.pandas_udf(lambda a, t, k: sp.span_series(a, t, k, min_sent, min_sent, 0.0, 0, longest), SPANS)
    rows = df.withColumn("_s", udf(F.col(lengths), F.lit(target) - F.col(title_len), F.col(key).cast("string")))
    out = rows.select(key, F.posexplode("_s").alias("_no", "_x")).select(key, "_no", "_x.begin", "_x.end")
    return ordered_scan(out, None, [key, "_no"], _b=row_index()).withColumn("block", F.col("_b") - 1).drop("_b", "_no")


def without_spans(df: DataFrame, lengths: str = "lengths", key: str = "doc_id", min_sent: int = 2, longest: int | None = None) -> DataFrame:
    """Documents that ``sentence_spans`` leaves out, and why."""
    too_long = F.exists(lengths, lambda n: n > longest) if longest is not None else F.lit(False)
    why = F.when(F.size(lengths) < min_sent, "too few sentences").when(too_long, "sentence too long")
    return df.select(key, why.alias("reason")).filter("reason is not null")


def span_sentences(docs: DataFrame, spans: DataFrame, sents: str = "sents", key: str = "doc_id") -> DataFrame:
    """The sentences of every span or block, from documents that hold theirs as an array."""
    return spans.join(docs.select(key, F.col(sents).alias("_all")), key).withColumn(sents, F.slice("_all", F.col("begin") + 1, F.col("end") - F.col("begin"))).drop("_all")


def inverse_cloze(df: DataFrame, n: int, sents: str = "sents", title: str = "title", keep: float = 0.1, seed: int = 1, key: str = "block") -> DataFrame:
    """A random sentence as query; it stays in its block only with probability ``keep``."""
    at = F.pmod(seeded_key(seed, key), F.size(sents).cast("long")).cast("int")
    stay = seeded_unit(seed + 1, key) < keep
    rest = F.filter(F.transform(sents, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda e: stay | (e["i"] != at))
    body = F.flatten(F.transform(rest, lambda e: e["s"]))
    return df.filter(F.size(sents) > 0).select(
        key, at.alias("picked"), F.slice(F.get(sents, at), 1, n).alias("query"), F.slice(F.concat(F.col(title), body), 1, n).alias("block_tokens")
    )


def mask_tokens(df: DataFrame, rate: float = 0.15, vocab: int = 1000, mask_id: int = 4, tokens: str = "tokens", pieces: str = "pieces", key: str = "sample_id", seed: int = 1, ngram_weights=(1.0, 1 / 2, 1 / 3), skip=(), fixed: bool = False, permute: bool = False) -> DataFrame:
    """Whole-word masking, reproducible from (seed, sample id); ``skip`` lists special tokens.

    ``ngram_weights`` are the shares of n-grams of 1, 2, ... words: 1/n favours short ones, its
    reverse long ones, powers of (1 - p) give a geometric length. ``permute`` also gives a second choice
    of words a drawn order, with both index arrays in ``swapped_to`` and ``swapped_from``.
    """
    budget = F.greatest(F.lit(1), F.round(F.size(tokens) * F.lit(rate)).cast("int"))
    given = df.select(
        key, F.col(tokens).alias("original"), F.col(tokens).cast("array<int>").alias("_tokens"),
        F.transform(pieces, lambda p: p.startswith("##")).alias("_inner"), F.col(key).cast("string").alias("_name"), budget.alias("_budget"),
    )
    lists = {"tokens": "array<int>", "positions": "array<int>", "labels": "array<int>", "spans": "array<array<int>>"}
    lists |= {"swapped_to": "array<int>", "swapped_from": "array<int>"} if permute else {}
    shape = ", ".join([f"`{c}` {given.schema[c].dataType.simpleString()}" for c in given.columns[:2]] + [f"{c} {t}" for c, t in lists.items()])
    return given.mapInArrow(sp.Masks(seed, tuple(ngram_weights), vocab, mask_id, tuple(skip), fixed, permute), shape)


def pair_segments(df: DataFrame, target: int, max_len: int, cls: int = 2, sep: int = 3, pad: int = 0, sents: str = "sents", key: str = "sample_id", seed: int = 1) -> DataFrame:
    """Two-segment examples with types and pad mask from lists of sentences."""
    made = sp.pair_up(F.col(sents), F.col(key), target, cls, sep, pad, max_len, seed)
    return df.withColumn("_p", made).select(key, "_p.*")


def span_corruption(df: DataFrame, enc_len: int, dec_len: int, sentinels: list[int], bos: int, eos: int, pad: int = 0, tokens: str = "tokens", spans: str = "spans") -> DataFrame:
    """Encoder/decoder arrays with one sentinel per masked span."""
    keep = [c for c in df.columns if c not in (tokens, spans)]
    made = sp.corrupt_spans(F.col(tokens), F.col(spans), sentinels, bos, eos, enc_len, dec_len, pad)
    return df.withColumn("_c", made).select(*keep, "_c.*")


def chunk_documents(docs: DataFrame, c: int, tokens: str = "tokens", key: str = "doc_id", eod: int | None = None, size_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of ``c`` consecutive tokens: (doc, chunk_no, tokens, length, valid).

    A trailing end id is dropped first. ``size_of`` gives a chunk's length under another
    tokenizer; chunks of length zero are invalid.
    """
    t = F.col(tokens)
    if eod is not None:
        t = F.when(F.element_at(tokens, -1) == eod, F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(t)
    rows = docs.filter(F.size(tokens) > 0).select(key, t.alias("_t")).filter(F.size("_t") > 0)
    n = F.ceil(F.size("_t") / c).cast("int")
    out = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    out = out.withColumn("tokens", F.slice("_t", F.col("chunk_no") * c + 1, F.lit(c))).drop("_t")
    size = size_of(F.col("tokens")) if size_of else F.size("tokens")
    return out.withColumn("length", size).withColumn("valid", F.col("length") > 0)


def number_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Global chunk ids over valid chunks in document order; only the keys are ordered."""
    keys = chunks.filter("valid").select(key, "chunk_no")
    ids = ordered_scan(keys, None, [key, "chunk_no"], _i=row_index())
    ids = ids.select(key, "chunk_no", (F.col("_i") - 1).alias("chunk_id"))
    return chunks.join(small_side(ids), [key, "chunk_no"])


def doc_chunk_offsets(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cumulative number of valid chunks at the end of each document."""
    per = chunks.groupBy(key).agg(F.count(F.when(F.col("valid"), 1)).alias("n_chunks"))
    return ordered_scan(per, None, key, chunks_upto=running_sum("n_chunks"))


def chunk_sets(chunks: DataFrame, train_fraction: float, n_train: int, ratios: DataFrame, dataset: str = "dataset", key: str = "doc_id") -> DataFrame:
    """Label chunks: ``train`` when their document is among the first share of its dataset's
    documents, else ``valid``; ``sampled`` marks each dataset's first n_train * ratio training chunks.

    ``ratios`` has (dataset, ratio), a short list.
    """
    docs = chunks.select(dataset, key).distinct()
    ranked = ordered_scan(docs, dataset, key, _d=row_index(), _b=row_index(reverse=True))
    n = F.col("_d") + F.col("_b") - 1
    ranked = ranked.withColumn("_train", F.col("_d") <= F.floor(n * F.lit(train_fraction))).select(dataset, key, "_train")
    rows = chunks.join(ranked, [dataset, key]).withColumn("part", F.when(F.col("_train"), "train").otherwise("valid")).drop("_train")
    rows = ordered_scan(rows, [dataset, "part"], [key, "chunk_no"], _k=row_index())
    shares = attach_row(ratios, ratios.agg(F.sum("ratio").alias("_sum"))).select(dataset, F.floor(F.lit(n_train) * F.col("ratio") / F.col("_sum")).alias("_want"))
    rows = rows.join(small_side(shares), dataset, "left")
    return rows.withColumn("sampled", (F.col("part") == "train") & F.coalesce(F.col("_k") <= F.col("_want"), F.lit(False))).drop("_k", "_want")


def sample_chunks(samples: DataFrame, seq: int, c: int, tokens: str = "tokens", key: str = "sample_id") -> DataFrame:
    """The L / c chunks of each packed sample, with the columns of the sample."""
    out = samples.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.lit(seq // c - 1))))
    return out.withColumn("tokens", F.slice(tokens, F.col("chunk_no") * c + 1, F.lit(c)))


# Fixed value: label that switches the loss off.
IGNORE = -100


def sft_examples(turns: DataFrame, n: int, eod: int, pad: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Conversation -> inputs, shifted targets and loss mask of length ``n``.

    ``turns`` has (key, order, role, tokens). Targets of system and user turns are ignored.
    The conversation is cut to n - 1 tokens, closed with the end id and padded. An empty
    assistant turn, or one that does not follow a user turn, is an error.
    """
    near = ordered_scan(turns.select(key, order, F.lower("role").alias("role"), "tokens"), key, order, _before=previous("role"), _len=running_sum(F.size("tokens")))
    wrong = (F.col("role") == "assistant") & ((F.size("tokens") == 0) | ~F.col("_before").eqNullSafe(F.lit("user")))
    wrong = wrong | ~F.col("role").isin("system", "user", "assistant")
    fail = F.raise_error(F.concat(F.lit("bad turn in conversation "), F.col(key).cast("string"))).cast("string")
    near = near.withColumn("role", F.when(wrong, fail).otherwise(F.col("role")))
    # turns that start past the cut add nothing, so a sample never holds more than n tokens
    near = near.withColumn("_begin", F.col("_len") - F.size("tokens"))
    begin = F.col("_begin")
    near = near.withColumn("tokens", F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.lit(n - 1) - begin).cast("int")))
    near = near.filter((begin < n - 1) | (F.col("role") == ""))  # naming role keeps the check of cut turns
    target = F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(F.transform("tokens", lambda v: F.lit(IGNORE)))
    item = F.struct(F.col(order).alias("o"), F.col("tokens").alias("t"), target.alias("y"))
    per = near.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    per = per.select(key, F.flatten(F.col("_s.t")).alias("_t"), F.flatten(F.col("_s.y")).alias("_y"))
    fill = F.array_repeat(F.lit(pad), F.lit(n) - F.size("_t"))
    tail = F.concat(F.array(F.lit(eod)), fill)
    per = per.select(key, F.concat("_t", tail).alias("_t"), F.concat("_y", tail).alias("_y"))
    out = per.select(key, F.slice("_t", 1, n).alias("tokens"), F.slice("_y", 2, n).alias("labels"))
    return out.withColumn("loss_mask", F.transform("labels", lambda v: F.when(v.isin(pad, IGNORE), 0).otherwise(1)))


def truncate_to_budget(df: DataFrame, budget: int, image_tokens: str, images: str, tokens: str = "tokens", target: str = "target") -> DataFrame:
    """Cut text so that it fits beside its image tokens; a sample left without any target is an error.

    Each image already holds one placeholder in the text, hence budget - image_tokens + images.
    """
    room = F.greatest(F.lit(0), F.lit(budget) - F.col(image_tokens) + F.col(images))
    out = df.withColumn(tokens, F.slice(tokens, F.lit(1), room)).withColumn(target, F.slice(target, F.lit(1), room))
    fine = F.exists(target, lambda v: v != IGNORE)
    return out.withColumn(target, F.when(fine, F.col(target)).otherwise(F.raise_error(F.lit("all targets are masked")).cast("array<int>")))


def candidate_inputs(df: DataFrame, n: int, cls: int, sep: int, pad: int, a: str = "a", b: str = "b", max_b: int = 128) -> DataFrame:
    """[CLS] a [SEP] b [SEP] with types and pad mask; b is cut to ``max_b``, a to what is left."""
    out = df.withColumn("_b", F.slice(b, 1, max_b))
    out = out.withColumn("_a", F.slice(a, F.lit(1), F.greatest(F.lit(0), F.lit(n - 3) - F.size("_b"))))
    one = lambda v: F.array(F.lit(v))
    body = F.concat(one(cls), "_a", one(sep), "_b", one(sep))
    fill = F.lit(n) - F.size("_a") - F.size("_b") - 3
    types = F.concat(F.array_repeat(F.lit(0), F.size("_a") + 2), F.array_repeat(F.lit(1), F.size("_b") + 1), F.array_repeat(F.lit(0), fill))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("_a") + F.size("_b") + 3), F.array_repeat(F.lit(0), fill))
    out = out.withColumn("tokens", F.concat(body, F.array_repeat(F.lit(pad), fill))).withColumn("types", types).withColumn("mask", mask)
    return out.drop("_a", "_b")


def negatives(df: DataFrame, n: int, hard: str = "hard", other: str = "other", key: str = "id", seed: int | None = None) -> DataFrame:
    """Up to ``n`` negatives: hard ones first, then ordinary ones (shuffled by key when seeded)."""

    def mixed(col):
        if seed is None:
            return F.col(col)
        keyed = F.transform(col, lambda v: F.struct(F.xxhash64(F.lit(seed), F.col(key), v).alias("h"), v.alias("v")))
        return F.transform(F.array_sort(keyed), lambda e: e["v"])

    return df.withColumn("negatives", F.slice(F.concat(mixed(hard), mixed(other)), 1, n))


def end_punctuation(col) -> Column:
    return F.when(_c(col).rlike(r"[.?!]$"), _c(col)).otherwise(F.concat(_c(col), F.lit(".")))


def dialogue_history(turns: DataFrame, last: int | None = None, key: str = "conv_id", order: str = "turn", text: str = "text", to: str = "history") -> DataFrame:
    """Texts of the earlier turns of the same conversation (of the last few, if given).

    A short history is read off an ordered scan, which splits long conversations over tasks;
    the full history grows with the turn number by definition.
    """
    if last is not None:
        near = ordered_scan(turns, key, order, **{f"_b{i}": previous(text, i) for i in range(1, last + 1)})
        back = F.array_compact(F.array(*[F.col(f"_b{i}") for i in range(last, 0, -1)]))
        return near.withColumn(to, back).drop(*[f"_b{i}" for i in range(1, last + 1)])
    span = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn(to, F.collect_list(text).over(span))


def dialogue_examples(turns: DataFrame, speaker: str = "role", answerer: str = "assistant", key: str = "conv_id", order: str = "turn", last: int | None = None, drop_unknown: bool = False) -> DataFrame:
    """(topic, context, knowledge, response) for every answering turn but the first.

    Context joins the earlier turns with `` [SEP] ``; texts get an end mark when they have
    none. ``drop_unknown`` leaves out turns without a topic.
    """
    marked = turns.withColumn("text", end_punctuation("text"))
    rows = dialogue_history(marked, last, key, order).filter((F.col(speaker) == answerer) & (F.size("history") > 0))
    knowledge = F.coalesce(F.col("knowledge"), F.lit("no_passages_used"))
    topic = F.col("topic")
    if drop_unknown:
        rows = rows.filter(topic.isNotNull() & (topic != "no_topic"))
    return rows.select(key, order, topic.alias("topic"), F.array_join("history", " [SEP] ").alias("context"), knowledge.alias("knowledge"), F.col("text").alias("response"))


def annotate(df: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame], schema: str, text: str = "text", to: str = "scores") -> DataFrame:
    """Score struct per row from a pluggable text series -> frame function."""
    return df.withColumn(to, F.pandas_udf(scorer, f"struct<{schema}>")(text))


def overlapping_eval_windows(tokens: DataFrame, length: int, overlap: int, key: str = "doc_id", col: str = "tokens", pad: int = 0) -> DataFrame:
    """Evaluation windows every ``overlap`` targets; only new targets are scored after the first."""
    n = F.size(col)
    targets = F.greatest(n - 1 - length, F.lit(0))
    count = F.ceil(targets / overlap).cast("int") + 1
    # Windows are cut inside the document's row: a row per window never holds the whole document.
    cuts = let(F.col(col), lambda t: F.transform(F.sequence(F.lit(0), count - 1), lambda w: F.struct(w.alias("no"), F.slice(t, w * overlap + 1, F.lit(length + 1)).alias("cut"))))
    rows = tokens.filter(n > 1).select(key, F.explode(cuts).alias("_w")).select(key, F.col("_w.no").alias("window_no"), F.col("_w.cut").alias("_cut"))
    cut = F.col("_cut")
    seen = F.size(cut)
    full = F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length + 1) - seen))
    fresh = F.when(F.col("window_no") == 0, 0).otherwise(length - overlap)
    mask = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when((i < seen - 1) & (i >= fresh), 1).otherwise(0))
    return rows.select(key, "window_no", full.alias("text"), mask.alias("pad_mask"))
