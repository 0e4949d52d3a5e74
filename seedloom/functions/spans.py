"""Spans, masks and segment pairs of token lists, as column expressions; masks as arrays of Arrow batches.

Random choices are digits of ``md5("seed:key[:number]")``, so any engine draws the same.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from seedloom.operators.base import let

_NO_INTS = "array<int>"


def digest(seed, *parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def unit(d: Column, nth: int) -> Column:
    """The nth six hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(d, 6 * nth + 1, 6), 16, 10).cast("double") / float(1 << 24)


def none() -> Column:
    return F.array().cast(_NO_INTS)


def upto(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(none())


# Sentence spans: the only part whose next step depends on the last one.


def sentence_spans(lengths, target: int, min_sent: int, keep: int, short: float = 0.0, seed: int = 0, key="", longest: int | None = None) -> list[dict]:
    """Cut a document's sentences into spans that reach ``target`` tokens.

    A span ends where it is long enough, has ``min_sent`` sentences and leaves ``keep`` of them; the last
    one takes what is left. Its end is found in the running sum of the lengths. With ``short``,
    that share of the spans gets a smaller target. A document with fewer than ``min_sent`` sentences,
    or with one over ``longest`` tokens, has no spans.
    """
    n = len(lengths)
    if n < min_sent or n == 0 or (longest is not None and max(lengths) > longest):
        return []
    upto_ = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))])
    out, begin = [], 0
    while begin < n:
        want = target
        if short:
            d = hashlib.md5(f"{seed}:{key}:{begin}".encode()).hexdigest()
            draw, size = (int(d[i : i + 6], 16) / (1 << 24) for i in (0, 6))
            if draw < short:
                want = 2 + int(size * (target - 1))
        end = max(int(np.searchsorted(upto_, upto_[begin] + want)), begin + min_sent)
        # A span may not leave fewer than ``keep`` sentences: it takes them all.
        end = n if n - end < max(keep, 1) else end
        out.append({"begin": begin, "end": end, "target": want})
        begin = end
    return out


def span_series(lengths: pd.Series, targets: pd.Series, ids: pd.Series, min_sent: int, keep: int, short: float, seed: int, longest: int | None) -> pd.Series:
    return pd.Series([sentence_spans(s, int(t), min_sent, keep, short, seed, k, longest) for s, t, k in zip(lengths, targets, ids)])


def grounded_count(text, source, min_run: int) -> int:
    """Tokens inside runs of at least ``min_run`` tokens that the source has."""
    known = set(source)
    found = np.fromiter((t in known for t in text), dtype=bool, count=len(text))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]])))
    runs = edges[1::2] - edges[::2]
    return int(runs[runs >= min_run].sum())


# Masking


# Tokens that are masked together: arrays of a slice of rows, not of a whole Arrow batch.
MASK_TOKENS = 1 << 18


@dataclass(frozen=True)
class Masks:
    """Whole-word n-gram masking of token lists, a slice of rows at a time.

    Every word draws a priority and how many words its n-gram reaches over (lengths 1, 2, ... by
    ``ngram_weights``); a word's own priority is the best of the n-grams that reach it. Words are taken by priority as
    long as they fit into the row's budget (one word at least), so n-grams are masked together.
    Of the masked words 80% become the mask id, 10% stay, 10% get ids below ``vocab``; ``fixed``
    always writes the mask id. Tokens in ``skip`` are never masked. Neighbouring masks are one span.

    ``permute`` draws a second set of n-grams by the same rule, within the same budget, among the words that
    were not masked, and gives its tokens a drawn order: place ``swapped_to[i]`` gets the token of
    place ``swapped_from[i]``. These places are positions with labels, too, but no spans.
    """

    seed: int
    ngram_weights: tuple
    vocab: int
    mask_id: int
    skip: tuple
    fixed: bool
    permute: bool

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: key, original, tokens (ints), inner (whether a piece goes on a word), name (key as text), budget."""
        for batch in batches:
            upto_ = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_tokens")), 0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                done = upto_[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto_, done + MASK_TOKENS, side="right")))
                part = batch.slice(begin, end - begin)
                made = self.masked(part.column("_tokens"), part.column("_inner"), part.column("_name"), part.column("_budget"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made.values()], [*batch.schema.names[:2], *made])
                begin = end

    def masked(self, tokens: pa.Array, inner: pa.Array, names: pa.Array, budget: pa.Array) -> dict[str, pa.Array]:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = tokens.flatten()
        old, unknown = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_null(flat).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        special = np.isin(old, self.skip) & ~unknown if self.skip else np.zeros(len(row), dtype=bool)
        joined = (at > 0) & ~_own_word(inner, sizes, row, at) & ~special
        joined[1:] &= ~special[:-1]
        heads = np.flatnonzero(~joined)
        length = np.diff(np.append(heads, len(row)))
        # rows, places in them and tokens of the words
        of = row[heads]
        count = np.bincount(of, minlength=len(sizes))
        k = np.arange(len(heads)) - (np.cumsum(count) - count)[of]
        free = ~special[heads] & ~unknown[heads] if self.skip else np.ones(len(heads), dtype=bool)
        names, budget = names.to_pylist(), budget.to_numpy(zero_copy_only=False)

        draw = _digits(_digests(self.seed, names, count))
        hit = _taken(self._priority(draw, k), of, length, free, budget)
        masked, word = np.repeat(hit, length), np.repeat(np.arange(len(heads)), length)
        new, gone = old.copy(), unknown.copy()
        third, fourth = (draw[word[masked], i] / UNITS for i in (2, 3))
        to_mask = np.ones(len(third), dtype=bool) if self.fixed else third < 0.8
        to_other = ~to_mask & (third >= 0.9) & bool(self.vocab)
        new[masked] = np.where(to_mask, self.mask_id, np.where(to_other, np.floor(fourth * self.vocab).astype(np.int64), old[masked]))
        gone[masked] &= ~(to_mask | to_other)
        spans = _span_lists(row[masked], at[masked], len(sizes))
        places = masked
        more = {}
        if self.permute:
            draw = _digits(_digests(f"{self.seed}:move", names, count))
            moved = np.repeat(_taken(self._priority(draw, k), of, length, free & ~hit, budget), length)
            to = np.flatnonzero(moved)
            count = np.bincount(row[to], minlength=len(sizes))
            d = _digests(f"{self.seed}:swap", names, count, at[to]).view(">u8").astype(np.uint64)
            from_ = to[np.lexsort((at[to], d[:, 1], d[:, 0], row[to]))]
            new[to], gone[to] = old[from_], unknown[from_]
            places = masked | moved
            more = {"swapped_to": _lists(at[to], count), "swapped_from": _lists(at[from_], count)}
        count = np.bincount(row[places], minlength=len(sizes))
        return {
            "tokens": _lists(new, sizes, gone),
            "positions": _lists(at[places], count),
            "labels": _lists(old[places], count, unknown[places]),
            "spans": spans,
            **more,
        }

    def _priority(self, draw: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The best draw of the n-grams that reach a word."""
        steps = np.cumsum(self.ngram_weights) / float(np.sum(self.ngram_weights))
        own, second = draw[:, 0], draw[:, 1] / UNITS
        reach = 1 + sum((second >= float(s)).astype(np.int64) for s in steps[:-1])
        best = own.copy()
        for o in range(1, len(self.ngram_weights)):
            reached = (k[o:] >= o) & (reach[:-o] > o)
            best[o:] = np.minimum(best[o:], np.where(reached, own[:-o], UNITS))
        return best


def _digests(seed, names: list, count: np.ndarray, numbers: np.ndarray | None = None) -> np.ndarray:
    """`digest` of the seed, a row's name and each of its numbers (0, 1, ... if none are given), 16 bytes each."""
    if numbers is None:
        few = [b"%d" % i for i in range(int(count.max(initial=0)))]
        texts = (itertools.islice(few, int(c)) for c in count)
    else:
        all_ = iter([b"%d" % i for i in numbers.tolist()])
        texts = (itertools.islice(all_, int(c)) for c in count)
    heads = [f"{seed}:" if n is None else f"{seed}:{n}:" for n in names]
    made = [hashlib.md5(h + t, usedforsecurity=False).digest() for h, ts in zip((h.encode() for h in heads), texts) for t in ts]
    return np.frombuffer(b"".join(made), dtype=np.uint8).reshape(-1, 16)


# What the draws of `unit` are parts of.
UNITS = 1 << 24


def _digits(digests: np.ndarray) -> np.ndarray:
    """The four draws of each digest, as integers (see `unit`)."""
    d = digests[:, :12].astype(np.int64).reshape(-1, 4, 3)
    return (d[:, :, 0] << 16) | (d[:, :, 1] << 8) | d[:, :, 2]


def _own_word(inner: pa.Array, sizes: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a token's piece is known not to go on the word before it."""
    plain = pc.fill_null(pc.invert(inner.flatten()), False).to_numpy(zero_copy_only=False)
    have = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if np.array_equal(have, sizes):
        return plain
    there = at < have[row]
    out = np.zeros(len(row), dtype=bool)
    out[there] = plain[((np.cumsum(have) - have)[row] + at)[there]]
    return out


def _taken(priority: np.ndarray, of: np.ndarray, length: np.ndarray, free: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """The free words of each row by priority, then place, as long as they fit into its budget; one at least."""
    words = np.flatnonzero(free)
    words = words[np.argsort(of[words] * UNITS + priority[words], kind="stable")]
    rows, used = of[words], np.cumsum(length[words])
    first = np.append(True, rows[1:] != rows[:-1])[: len(rows)]
    before = (used - length[words])[first][np.cumsum(first) - 1]
    out = np.zeros(len(of), dtype=bool)
    out[words[first | (used - before <= budget[rows])]] = True
    return out


def _lists(values: np.ndarray, count: np.ndarray, gone: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(_ends(count), pa.array(values, pa.int32(), mask=gone))


def _ends(count: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(count)), pa.int32())


def _span_lists(row: np.ndarray, at: np.ndarray, rows: int) -> pa.Array:
    """Maximal runs of consecutive numbers of each row's ascending numbers."""
    new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))[: len(row)]
    firsts = np.flatnonzero(new)
    runs = _lists(at, np.diff(np.append(firsts, len(row))))
    return pa.ListArray.from_arrays(_ends(np.bincount(row[firsts], minlength=rows)), runs)


def corrupt_spans(tokens: Column, spans: Column, *args, **kw) -> Column:
    """See `_corrupted`; the arrays are evaluated once per row."""
    return let(tokens, lambda t: let(spans, lambda s: _corrupted(t, s, *args, **kw)))


def _corrupted(tokens: Column, spans: Column, sentinels: list[int], bos: int, eos: int, enc_len: int, dec_len: int, pad: int) -> Column:
    """Struct of text_enc, text_dec, labels, loss_mask: each span is a sentinel on the encoder side, and
    follows that sentinel on the decoder side. Fails where a sample does not fit."""
    marks = F.array(*[F.lit(s) for s in sentinels])
    first = lambda k: F.element_at(F.get(spans, k), 1)
    after = lambda k: F.element_at(F.get(spans, k), -1) + 1
    m = F.size(spans)

    def before(k):
        begin = F.when(k == 0, F.lit(0)).otherwise(after(k - 1))
        stop = F.when(k == m, F.size(tokens)).otherwise(first(k))
        kept = F.slice(tokens, begin + 1, stop - begin)
        return F.concat(kept, F.when(k < m, F.array(F.get(marks, k))).otherwise(none()))

    enc = F.flatten(F.transform(F.sequence(F.lit(0), m), before))
    said = F.flatten(F.transform(spans, lambda s, k: F.concat(F.array(F.get(marks, k)), F.transform(s, lambda i: F.get(tokens, i)))))

    def padded(e, s):
        long = (F.size(e) > enc_len) | (F.size(s) + 1 > dec_len)
        fill, rest = F.lit(enc_len) - F.size(e), F.lit(dec_len - 1) - F.size(s)
        out = F.struct(
            F.concat(e, F.array_repeat(F.lit(pad), fill)).cast(_NO_INTS).alias("text_enc"),
            F.concat(F.array(F.lit(bos)), s, F.array_repeat(F.lit(pad), rest)).cast(_NO_INTS).alias("text_dec"),
            F.concat(s, F.array(F.lit(eos)), F.array_repeat(F.lit(-1), rest)).cast(_NO_INTS).alias("labels"),
            F.concat(F.array_repeat(F.lit(1), F.size(s) + 1), F.array_repeat(F.lit(0), rest)).cast(_NO_INTS).alias("loss_mask"),
        )
        wrong = F.when(m > len(sentinels), F.lit("more spans than sentinels")).when(long, F.lit("sample longer than its arrays"))
        return F.when(wrong.isNull(), out).otherwise(F.raise_error(wrong))

    return let(enc, lambda e: let(said, lambda s: padded(e, s)))


def pair_up(sents: Column, key: Column, target: int, cls: int, sep: int, pad: int, max_len: int, seed: int) -> Column:
    """Struct of tokens, types, mask, swapped, truncated: two segments around a drawn pivot, swapped half
    of the time. What is over ``target`` goes from the longer segment until they are even (the second
    first), then from both alike; a drawn share of it from the segment's front."""
    n = F.size(sents)
    d = digest(seed, key)
    pivot = F.when(n > 1, 1 + F.floor(unit(d, 0) * (n - 1)).cast("int")).otherwise(1)
    swapped = unit(d, 1) < 0.5
    head, tail = F.flatten(F.slice(sents, F.lit(1), pivot)), F.flatten(F.slice(sents, pivot + 1, n))

    def build(ab):
        a, b = ab["a"], ab["b"]
        la, lb = F.size(a), F.size(b)
        over = F.greatest(F.lit(0), la + lb - target)
        lead = F.least(over, F.abs(la - lb))
        rest = over - lead
        off_b = F.when(lb >= la, lead).otherwise(0) + F.ceil(rest / 2).cast("int")
        off_a = over - off_b

        def cut(x, off, nth):
            front = F.floor(unit(d, nth) * (off + 1)).cast("int")
            return F.slice(x, front + 1, F.size(x) - off)

        def framed(s, t):
            body = F.concat(F.array(F.lit(cls)), s, F.array(F.lit(sep)), t, F.when(F.size(t) > 0, F.array(F.lit(sep))).otherwise(none()))
            used = F.size(s) + 2 + F.size(t) + F.when(F.size(t) > 0, 1).otherwise(0)
            fill = F.greatest(F.lit(0), F.lit(max_len) - used)
            return F.struct(
                F.concat(body, F.array_repeat(F.lit(pad), fill)).cast(_NO_INTS).alias("tokens"),
                F.concat(F.array_repeat(F.lit(0), F.size(s) + 2), F.array_repeat(F.lit(1), used - F.size(s) - 2), F.array_repeat(F.lit(0), fill)).cast(_NO_INTS).alias("types"),
                F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), fill)).cast(_NO_INTS).alias("mask"),
                swapped.alias("swapped"),
                (over > 0).alias("truncated"),
            )

        return let(cut(a, off_a, 2), lambda s: let(cut(b, off_b, 3), lambda t: framed(s, t)))

    both = F.struct(F.when(swapped, tail).otherwise(head).alias("a"), F.when(swapped, head).otherwise(tail).alias("b"))
    return let(both, build)
