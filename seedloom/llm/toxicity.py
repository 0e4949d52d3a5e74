"""Toxicity of texts after noisy-channel deobfuscation.

A character language model is counted over the words of the whole corpus, n-gram by n-gram. Tokens that may be
disguised (leetspeak, spaced or separated letters, stretched letters) become lattices: every
character can stand for itself, for the letter it imitates, or for nothing. Viterbi finds the path
that language model and channel together find likeliest; the restored words are what the
classifier sees. It is a logistic regression over words and word beginnings, fitted on a bounded
sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import _EDGE, columns_of, in_batches, keep, table, text_or_empty, with_mapped

# Characters of the language model's context and the one it predicts.
ORDER = 4
# N-grams rarer than this share of all n-gram occurrences are left to the shorter contexts. The table of
# the others has at most 1 / RAREST entries of some 20 bytes, whatever the corpus holds.
RAREST = 1 / 4_000_000
# Distinct tokens a task counts before it sends their counts on, and decoded tokens it remembers.
COUNTED, REMEMBERED = 200_000, 120_000
# Labelled rows that the classifier is fitted on, at most: those with the smallest hash of their id.
MOST_LABELLED = 20_000
# A feature is used if chance alone would favour toxic rows as much with this probability at most.
CHANCE = 0.01
RIDGE = 0.3
FOLDS = 5

# What each disguise costs, in nats, and which letters a symbol imitates.
SUBSTITUTED, SEPARATED, SPLIT, STRETCHED = 1.0, 0.3, 1.5, 0.7
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = frozenset(" .-_*~'")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_ENDS = "".join(c for c in _EDGE if c not in "@$|+")
# An exclamation mark ends a word as punctuation, but can stand for its first letter.
_STARTS = _ENDS.replace("!", "")
# What may follow the last letter of a plain word.
_PLAIN_ENDS = ".,;:!?)\"'"
_JUNK_ENDS = re.compile(r"^([@$|+])\1{2,}|([@$|+])\2{2,}$")


def word_counts(docs: DataFrame) -> DataFrame:
    """(text) -> word, n over all rows: lower case, letters only, punctuation stripped."""

    def run(batches):
        held: Counter[str] = Counter()
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

        def summed():
            out: Counter[str] = Counter()
            for t, n in held.items():
                w = t.strip(_EDGE)
                if w.isalpha():
                    out[w] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], schema=schema)

        for (text,) in columns_of(batches):
            held.update(text.lower().split())
            if len(held) > COUNTED:
                yield summed()
        yield summed()

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Counts:
    """n-gram -> count, as one sorted array of n-grams and one of counts."""

    def __init__(self, grams, counts):
        grams, counts = np.asarray(grams, dtype=f"U{ORDER}"), np.asarray(counts, dtype=np.float64)
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[order].astype(np.float32)
        self.total = float(counts.sum())

    def of(self, gram: str) -> float:
        i = int(np.searchsorted(self.grams, np.str_(gram)))
        return float(self.counts[i]) if i < len(self.grams) and self.grams[i] == gram else 0.0


def ngram_counts(words: DataFrame, order: int = ORDER, rarest: float = RAREST) -> Counts:
    """Counts of the n-grams of all words; those that make up a share of ``rarest`` or more reach the driver."""
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    n = F.length("m")
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(order), n - i + 1)), lambda k: F.col("m").substr(i, k)),
        )
    )
    words = keep(words, "words")
    letters = F.length("word") + 2
    # A word of n characters with its marks has k fewer n-grams for each length k + 1.
    held = F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), F.lit(0), lambda a, k: a + F.greatest(F.lit(0), letters - k))
    total = words.agg(F.sum(F.col("n") * held)).first()[0] or 0
    rows = words.select(marked.alias("m"), "n").select(F.explode(grams).alias("g"), "n")
    got = rows.groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.lit(rarest) * total).toPandas()
    return Counts(got["g"].to_numpy(dtype=str), got["n"].to_numpy(dtype=np.float64))


@dataclass
class Decoder:
    """Viterbi decoding of disguised tokens under a character language model."""

    counts: Counts
    order: int = ORDER
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.total = self.counts.total or 1.0

    def _p(self, gram: str) -> float:
        """Probability of the last character after the others, shrunk towards shorter contexts."""
        if len(gram) == 1:
            return (self.counts.of(gram) + 0.01) / (self.total + 1e4) if gram.isalpha() or gram == "$" else 1e-7
        seen, whole = self.counts.of(gram[:-1]), self.counts.of(gram)
        return (whole + 5 * self._p(gram[1:])) / (max(seen, whole) + 5)

    def log_p(self, context: str, char: str) -> float:
        gram = (context + char)[-self.order :]
        got = self.known.get(gram)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[gram] = math.log(self._p(gram))
        return got

    def decode(self, raw: str) -> str:
        """The likeliest plain form of a token or of a run of spaced characters, in lower case."""
        # Context -> (score, chain of what was written). At most a few contexts live at a time.
        states, before = {"^": (0.0, None)}, ""
        for c in raw.lower():
            options = [(c, 0.0)]
            if c in IMITATES:
                options += [(x, SUBSTITUTED) for x in IMITATES[c]]
            elif c in SEPARATORS:
                options = [("", SEPARATED), (" ", SPLIT)]
            if c == before:
                options.append(("", STRETCHED))
            before = c
            new: dict[str, tuple] = {}
            for context, (score, chain) in states.items():
                for char, cost in options:
                    if char == "":
                        after, s, then = context, score - cost, chain
                    elif char == " ":
                        after, s, then = "^", score - cost + self.log_p(context, "$"), (chain, char)
                    else:
                        after, s, then = (context + char)[1 - self.order :], score - cost + self.log_p(context, char), (chain, char)
                    if after not in new or s > new[after][0]:
                        new[after] = s, then
            states = new
        _, chain = max(((s + self.log_p(context, "$"), chain) for context, (s, chain) in states.items()), key=lambda x: x[0])
        out = []
        while chain:
            chain, char = chain
            out.append(char)
        return "".join(reversed(out))


def disguised(token: str) -> str | None:
    """The part of a token that a lattice is built from, or None for a plain token."""
    core = _JUNK_ENDS.sub("", token.lower().rstrip(_ENDS).lstrip(_STARTS))
    if core.isalpha():
        return core if _STRETCHED.search(core) else None
    # A number is no word: there must be a letter or a symbol, and two characters that read as letters.
    letters = sum(c.isalpha() for c in core)
    symbols = sum(c in IMITATES and not c.isdigit() for c in core)
    if letters + symbols < 2 and not (letters and len(core) > 2):
        return None
    return core if any(c in IMITATES or c in SEPARATORS for c in core) or _STRETCHED.search(core) else None


def plain_word(token: str, stretched: bool) -> str | None:
    """The word of a lower-case token that no lattice is needed for; None if one may be.

    ``stretched`` says that the text has a letter three times in a row somewhere.
    """
    if not token[0].isalpha():
        return None
    bare = token.rstrip(_PLAIN_ENDS)
    return bare if bare.isalpha() and not (stretched and _STRETCHED.search(bare)) else None


class Words(dict):
    """token -> its restored words; remembers a bounded number of tokens."""

    def __init__(self, decoder: Decoder):
        super().__init__()
        self.decoder = decoder

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        core = disguised(token)
        plain = token.lower().strip(_EDGE) if core is None else self.decoder.decode(core)
        got = tuple(plain.split())
        if len(token) <= 40:
            self[token] = got
        return got

    def unspaced(self, text: str) -> str:
        return _SPACED.sub(lambda m: self.decoder.decode(m[0]), text)

    def restored(self, text: str) -> str:
        """The text with every disguised token replaced by its plain form; white space stays."""
        plain = lambda m: m[0] if disguised(m[0]) is None else " ".join(self[m[0]])
        return re.sub(r"\S+", plain, self.unspaced(text))

    def of(self, text: str) -> set[str]:
        out: set[str] = set()
        low = self.unspaced(text).lower()
        stretched = _STRETCHED.search(low) is not None
        for token in set(low.split()):
            word = plain_word(token, stretched)
            out.update(self[token] if word is None else (word,))
        return out


def features(word: str) -> list[str]:
    """A word and its beginnings, as the classifier sees them."""
    return [word, *(f"^{word[:k]}" for k in (4, 5, 7) if len(word) > k)]


def restore(docs: DataFrame, counts: Counts, text: str = "text", to: str = "restored") -> DataFrame:
    """``docs`` with the restored text in ``to``; null texts give the empty text."""

    def make():
        words = Words(Decoder(counts))
        return lambda value: words.restored(value or "")

    return with_mapped(docs, text, to, "string", make)


@dataclass
class Model:
    counts: Counts
    weights: dict[str, float]
    bias: float


def held_out(doc_id: str) -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % FOLDS == 0


def _fit(rows: list[tuple[int, list[int]]], size: int, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by Newton steps over the features that rows have.

    Each step is solved by conjugate gradients, so nothing is as large as rows times features.
    """
    y = np.array([r[0] for r in rows], dtype=np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 2.0)
    w = np.zeros(size + 1)
    w[-1] = math.log(prior / (1 - prior))
    if not 0 < y.sum() < len(y):
        return w[:-1], float(w[-1])
    of_row = np.repeat(np.arange(len(rows)), [len(h) + 1 for _, h in rows])
    of_col = np.concatenate([np.r_[np.asarray(h, dtype=np.int64), size] for _, h in rows])
    forward = lambda v: np.bincount(of_row, v[of_col], minlength=len(rows))
    backward = lambda u: np.bincount(of_col, u[of_row], minlength=size + 1)
    cost = np.full(size + 1, ridge)
    cost[-1] = 1e-3

    def loss(w):
        z = forward(w)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * cost @ w**2)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        slope = backward(p - y) + cost * w
        bend = p * (1 - p)
        diagonal = backward(bend) + cost
        step, rest = np.zeros(size + 1), -slope
        towards = near = rest / diagonal
        fit = rest @ near
        for _ in range(200):
            if fit <= 1e-16 * max(1.0, slope @ slope):
                break
            bent = backward(bend * forward(towards)) + cost * towards
            length = fit / (towards @ bent)
            step, rest = step + length * towards, rest - length * bent
            near = rest / diagonal
            fit, before = rest @ near, fit
            towards = near + fit / before * towards
        scale, then = 1.0, loss(w + step)
        while then > now and scale > 1e-6:
            scale /= 2
            then = loss(w + scale * step)
        if now - then <= 1e-9 * max(1.0, abs(now)):
            break
        w, now = w + scale * step, then
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="toxic", most: int = MOST_LABELLED, chance: float = CHANCE) -> Model:
    """Language model from all of ``docs``, classifier from labelled rows outside the held-out fold.

    Of those, the ``most`` with the smallest hash of their id are used. Rows without id or label
    are not; an id with several labels is toxic if any says so. Without rows of both classes the score is
    the same for all texts, and below a half unless most rows are toxic. Every feature that toxic
    rows have more often, by a likelihood ratio test at ``chance``, gets a weight.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    counts = ngram_counts(word_counts(d.select("text")))
    known = labels.select(F.col(doc_id).cast("long").alias("doc"), F.col(label).cast("int").alias("toxic")).filter(
        "doc is not null and toxic is not null"
    )
    known = known.filter(~held_out("doc")).groupBy("doc").agg(F.max("toxic").alias("toxic"))
    # The bound of this table is ``most`` rows of two numbers.
    sample = keep(known.orderBy(F.xxhash64("doc", F.lit(17)), "doc").limit(most), "labelled")
    rows = d.join(F.broadcast(sample), "doc").select("toxic", "text")

    def seen(batches):
        words, schema = Words(Decoder(counts)), pa.schema([("toxic", pa.int32()), ("feature", pa.string()), ("n", pa.int64())])
        held = (Counter(), Counter())

        def out():
            for y in (0, 1):
                yield from in_batches(((y, f, n) for f, n in held[y].items()), schema)
                held[y].clear()

        for toxic, value in columns_of(batches):
            held[toxic].update({f for w in words.of(value) for f in features(w)})
            if len(held[0]) + len(held[1]) > COUNTED:
                yield from out()
        yield from out()

    per = rows.mapInArrow(seen, "toxic int, feature string, n long")
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = float(total.get(1, 0)), float(total.get(0, 0))
    k1, k0 = (F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).cast("double") for y in (1, 0))
    table_ = per.groupBy("feature").agg(k1.alias("k1"), k0.alias("k0")).filter((F.col("k1") >= 2) & (F.col("k1") * n0 > F.col("k0") * n1))
    share = (F.col("k1") + F.col("k0")) / max(1.0, n1 + n0)
    term = lambda seen_, expected: F.when(seen_ > 0, seen_ * F.log(seen_ / expected)).otherwise(0.0)
    gain = term(F.col("k1"), n1 * share) + term(F.col("k0"), n0 * share)
    gain += term(n1 - F.col("k1"), n1 * (1 - share)) + term(n0 - F.col("k0"), n0 * (1 - share))
    # Twice the gain is a square of a normal figure where a feature and the label have nothing in common.
    bound = NormalDist().inv_cdf(1 - chance / 2) ** 2
    names = sorted(r["feature"] for r in table_.filter(2 * gain >= bound).select("feature").collect())
    place = {f: i for i, f in enumerate(names)}

    def vectors(batches):
        words, schema = Words(Decoder(counts)), pa.schema([("toxic", pa.int32()), ("held", pa.list_(pa.int32()))])
        of = lambda value: sorted({place[f] for w in words.of(value) for f in features(w) if f in place})
        return in_batches(((toxic, of(value)) for toxic, value in columns_of(batches)), schema)

    got = rows.mapInArrow(vectors, "toxic int, held array<int>").toArrow().to_pydict()
    weights, bias = _fit(sorted(zip(got["toxic"], got["held"])), len(names))
    return Model(counts, {f: float(w) for f, w in zip(names, weights) if w}, bias)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic label in ``to``, of whole restored texts.

    Null and empty texts have the score of a text without any feature. A column named ``to`` is
    replaced; the others pass through.
    """
    counts, weights, bias = model.counts, model.weights, model.bias
    whole = {f for f in weights if f[0] != "^"}
    # Four letters or fewer that a word with a weighted beginning starts with.
    heads = {f[1:5] for f in weights if f[0] == "^"}

    class Weighed(dict):
        """lower-case token -> features of its words that have a weight, () for most."""

        def __init__(self):
            super().__init__()
            self.words = Words(Decoder(counts))
            # Whether the text at hand has a letter three times in a row.
            self.stretched = False

        def __missing__(self, token):
            if len(self) >= REMEMBERED:
                self.clear()
            bare = token.rstrip(_PLAIN_ENDS)
            if bare.isalpha() and not (self.stretched and _STRETCHED.search(bare)):
                got = self.of_word(bare) if bare in whole or bare[:4] in heads else ()
            else:
                got = tuple(f for w in self.words[token] for f in self.of_word(w))
            if len(token) <= 40:
                self[token] = got
            return got

        def of_word(self, word):
            return tuple(f for f in features(word) if f in weights)

    def make():
        weighed = Weighed()

        def call(value):
            found: set[str] = set()
            low = weighed.words.unspaced(value or "").lower()
            weighed.stretched = _STRETCHED.search(low) is not None
            for token in set(low.split()):
                got = weighed[token]
                if got:
                    found.update(got)
            z = bias + sum(weights[f] for f in sorted(found))
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

        return call

    return with_mapped(docs, text, to, "double", make)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
