"""Column functions on answers and texts."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.operators.base import let


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squeeze(col) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


# Fixed value: punctuation replaced by a space before answers are compared.
PUNCTUATION = r"""[!"#$%&()*+,\-./:;<=>?@\[\]\\^`{|}~_']"""


def normalize_answer(col, drop: bool = False) -> Column:
    """Lower case, no punctuation (spaced out, or dropped), no articles, single spaces."""
    bare = F.regexp_replace(F.lower(_c(col)), PUNCTUATION, "" if drop else " ")
    return squeeze(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def words_of(col) -> Column:
    return F.filter(F.split(_c(col), " "), lambda w: w != "")


def clean_text(col) -> Column:
    """Line breaks and space runs to one space; `` . `` closes up to the left."""
    out = F.regexp_replace(F.replace(_c(col), F.lit("\n"), F.lit(" ")), r"\s+", " ")
    for _ in range(3):
        out = F.replace(out, F.lit(" . "), F.lit(". "))
    return out


# Fixed replacements, applied in this order: (literal or pattern, replacement, is pattern).
DETOKENIZE = {
    "ptb": [
        (" '", "'", False), (" \n", "\n", False), ("\n ", "\n", False), (" n't", "n't", False),
        (" N ", "1 ", False), ("$ 1", "$1", False), ("# 1", "#1", False),
    ],
    "wiki": [
        ("s '", "s'", False), (r"/' [0-9]/", "/'[0-9]/", True),
        (" @-@ ", "-", False), (" @,@ ", ",", False), (" @.@ ", ".", False),
        (" : ", ": ", False), (" ; ", "; ", False), (" . ", ". ", False),
        (" ! ", "! ", False), (" ? ", "? ", False), (" , ", ", ", False),
        (r"\(\s*([^\)]*?)\s*\)", "($1)", True), (r"\[\s*([^\]]*?)\s*\]", "[$1]", True),
        (r"\{\s*([^}]*?)\s*\}", "{$1}", True), (r'"\s*([^"]*?)\s*"', '"$1"', True),
        (r"'\s*([^']*?)\s*'", "'$1'", True),
        ("= = = =", "====", False), ("= = =", "===", False), ("= =", "==", False),
        (" \u00b0 ", "\u00b0", False), (" \n", "\n", False), ("\n ", "\n", False),
        (" N ", " 1 ", False), (" 's", "'s", False),
    ],
    "lambada": [],
}


def detokenize(col, kind: str) -> Column:
    out = _c(col)
    for old, new, is_pattern in DETOKENIZE[kind]:
        out = F.regexp_replace(out, old, new) if is_pattern else F.replace(out, F.lit(old), F.lit(new))
    return out


def words(col, uncased: bool = True) -> Column:
    """Letter/number/mark runs and single other visible signs."""
    found = F.regexp_extract_all(_c(col), F.lit(r"([\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}])"), F.lit(1))
    return F.transform(found, lambda w: F.lower(w)) if uncased else found


def _nfd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFD", s))


def nfd(col) -> Column:
    """Canonical decomposition; Spark has no built-in for it.

    Marked non-deterministic so that the optimizer keeps it out of lambdas, where a Python
    function cannot run.
    """
    return F.pandas_udf(_nfd, "string").asNondeterministic()(_c(col))


def has_answer(df: DataFrame, text: str, answers: str, mode: str = "string", to: str = "has_answer") -> DataFrame:
    """Whether any answer occurs in the text: as a run of whole tokens, or as a regex.

    Both sides are decomposed first; answers travel as one joined text.
    """
    sep, cut = "\u0001", "\u0002"
    rows = df.withColumn("_t", nfd(text)).withColumn("_a", nfd(F.array_join(answers, cut)))
    wanted = F.split("_a", cut)
    if mode == "regex":
        hit = F.exists(wanted, lambda p: F.col("_t").rlike(F.concat(F.lit("(?imu)"), p)))
    else:
        body = F.concat(F.lit(sep), F.array_join(words("_t"), sep), F.lit(sep))
        forms = F.transform(wanted, lambda p: F.concat(F.lit(sep), F.array_join(words(p), sep), F.lit(sep)))
        hit = let(body, lambda b: F.exists(forms, lambda w: F.contains(b, w)))
    return rows.withColumn(to, F.coalesce(hit, F.lit(False))).drop("_t", "_a")


def anls(pred, golds, tau: float = 0.5) -> Column:
    """Best normalised edit similarity over the golds; under the threshold it is zero."""

    def score(gold):
        p, g = squeeze(F.lower(_c(pred))), squeeze(F.lower(gold))
        longest = F.greatest(F.length(p), F.length(g))
        far = F.when(longest == 0, 0.0).otherwise(F.levenshtein(p, g) / longest)
        return F.when(far < tau, 1.0 - far).otherwise(0.0)

    return F.array_max(F.transform(_c(golds), score))


def extract_answer(col, kind: str = "braced") -> Column:
    """The answer part of a model output.

    braced: inside \\answer{} or \\boxed{}; number: the number after "answer is", when the
    text has letters and no "e+".
    """
    c = _c(col)
    if kind == "braced":
        first = F.regexp_extract(c, r"\\answer\{(.*?)\}", 1)
        second = F.regexp_extract(c, r"\\boxed\{(.*?)\}", 1)
        plain = F.replace(c, F.lit("Answer:"), F.lit("Answer: "))
        return F.when(c.rlike(r"\\answer\{.*?\}"), first).when(c.rlike(r"\\boxed\{.*?\}"), second).otherwise(plain)
    if kind == "number":
        found = F.regexp_extract(c, r"answer is (-*\d+\.*\d*)", 1)
        ok = c.rlike("[a-zA-Z]") & ~c.contains("e+") & (found != "")
        return F.when(ok, found).otherwise(c)
    raise ValueError(kind)


def trim_number(col) -> Column:
    """Decimals cut to two places, whole ones dropped; percent signs and a final dot removed."""
    c = _c(col)
    whole = F.regexp_extract(c, r"^(\d+)\.\d+$", 1)
    digits = F.regexp_extract(c, r"^\d+\.(\d+)$", 1)
    short = F.when(digits.rlike("^0+$"), whole).otherwise(F.concat(whole, F.lit("."), F.substring(digits, 1, 2)))
    cut = F.when(whole != "", short).otherwise(c)
    return F.regexp_replace(F.replace(cut, F.lit("%"), F.lit("")), r"\.$", "")


# Signs stripped from the ends of a response, each once, in this order.
RESPONSE_SIGNS = (",", ".", "!", "?", ";", ":", "'")


def choice_letter(text, choices: list[str], options=None) -> Column:
    """Option letter named by a response: the last mention wins, the first option is the default.

    Mentions are read off by pattern, by falling rank: ``(A)``, ``A)``, `` A ``, and in
    responses of more than five words the option texts (a map letter -> text).
    """
    bare = reduce(lambda c, sign: F.btrim(c, F.lit(sign)), RESPONSE_SIGNS, _c(text))
    t = F.concat(F.lit(" "), bare, F.lit(" "))
    letters = F.array(*[F.lit(c) for c in choices])
    any_of = "|".join(re.escape(c) for c in sorted(choices, key=len, reverse=True))
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.lit(-1))
    closed = F.regexp_extract_all(t, F.lit(rf"({any_of})\)"), F.lit(1))
    ranks = [last(rf"\(({any_of})\)"), F.get(F.array_intersect(letters, closed), F.lit(0)), last(rf" ({any_of})(?= )")]
    if options is not None:
        o, low = _c(options), F.lower(t)
        said = F.filter(letters, lambda c: F.contains(low, F.lower(F.try_element_at(o, c))))
        # The text behind an option's last mention: the shortest belongs to the one named last.
        behind = F.transform(said, lambda c: F.struct(F.length(F.call_function("substring_index", low, F.lower(F.try_element_at(o, c)), F.lit(-1))) + F.length(F.try_element_at(o, c)), F.array_position(letters, c), c.alias("c")))
        named = F.array_min(behind)["c"]
        ranks.append(F.when(F.size(F.split(F.trim(bare), r"\s+")) > 5, named))
    return F.coalesce(*ranks, F.lit(choices[0]))


# What counts as a number in an answer: with thousands commas, in scientific
# notation, plain. Scores depend on these forms and on their order.
NUMBER_FORMS = (
    r"(-?\b\d{1,3}(?:,\d{3})+\b)",
    r"(-?\d+(?:\.\d+)?[eE][+-]?\d+)",
    r"(-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d]))",
)


def extract_numbers(col) -> Column:
    """All numbers in a text, form by form."""
    return F.flatten(F.array(*[F.regexp_extract_all(_c(col), F.lit(f), F.lit(1)) for f in NUMBER_FORMS]))


def _truncate(texts: pd.Series, n: int, end: str) -> pd.Series:
    def cut(s):
        if s is None:
            return None
        s = s.replace(end, "") if end else s
        s = s.encode("utf-8")[:n].decode("utf-8", errors="ignore").strip()
        return s or None

    return texts.map(cut)


def truncate_bytes(col, n: int = 20480, end: str = "<|endoftext|>") -> Column:
    """At most ``n`` bytes, cut between characters; the end mark is removed, empty becomes NULL."""
    return F.pandas_udf(lambda s: _truncate(s, n, end), "string")(_c(col))


def join_pieces(col) -> Column:
    """Word pieces to text: ``##`` pieces join their head."""
    return F.replace(F.array_join(_c(col), " "), F.lit(" ##"), F.lit(""))


def masked_mean(emb, mask) -> Column:
    """Mean over the tokens whose mask is set: emb is tokens x dims, mask one flag per token."""
    e, m = _c(emb), _c(mask)
    kept = F.transform(F.filter(F.arrays_zip(e.alias("e"), m.alias("m")), lambda r: r["m"] > 0), lambda r: r["e"])
    zero = F.transform(F.get(kept, F.lit(0)), lambda v: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, r: F.zip_with(a, r, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda v: v / F.size(kept))


def combine_embeddings(arr, mode: str = "mean") -> Column:
    """Embeddings of the sequences of one item, averaged or put end to end."""
    a = _c(arr)
    if mode == "concat":
        return F.flatten(a)
    zero = F.transform(F.get(a, F.lit(0)), lambda v: F.lit(0.0))
    return F.transform(F.aggregate(a, zero, lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double"))), lambda v: v / F.size(a))


def repeat_replace(arr, token: int, counts, new: int) -> Column:
    """The i-th occurrence of ``token`` becomes counts[i] copies of ``new``.

    The array is cut at its occurrences once, so the work is linear in its length.
    """
    c = _c(counts)

    def cut(a, hits):
        def part(k):
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(hits, k - 1) + 1)
            stop = F.when(k == F.size(hits), F.size(a)).otherwise(F.get(hits, k))
            copies = F.when(k < F.size(hits), F.coalesce(F.get(c, k), F.lit(1))).otherwise(0).cast("int")
            return F.concat(F.slice(a, begin + 1, stop - begin), F.array_repeat(F.lit(new), copies))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits)), part))

    places = lambda a: F.array_compact(F.transform(a, lambda v, i: F.when(v == token, i)))
    return let(_c(arr), lambda a: let(places(a), lambda hits: cut(a, hits)))


def class_scores(logits, mode: str = "softmax") -> Column:
    x = _c(logits)
    if mode == "sigmoid":
        return F.transform(x, lambda v: 1.0 / (1.0 + F.exp(-v.cast("double"))))
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp((v - top).cast("double")))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp((v - top).cast("double")))
    return F.transform(e, lambda v: v / total)


def predicted_class(logits, threshold: float | None = None) -> Column:
    """Index of the highest score, or (multi-label) a 0/1 array of scores over the threshold."""
    x = _c(logits)
    if threshold is not None:
        return F.transform(class_scores(x, "sigmoid"), lambda p: (p > threshold).cast("int"))
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def encode_label(col) -> Column:
    """Number of an integer or decimal label; NULL for text (which stays as the raw label)."""
    return F.trim(_c(col)).try_cast("double")


def array_from_json(col) -> Column:
    return F.from_json(_c(col), "array<double>")


def array_to_json(col) -> Column:
    return F.to_json(_c(col))


def answer_field(single, listed, keyed) -> Column:
    """Answers given as one string, a list, or a dictionary of lists, as one list.

    Columns: ``answer`` STRING, ``answers`` ARRAY<STRING>, ``answers`` STRUCT/MAP's text list.
    """
    one = F.when(F.col(single).isNotNull(), F.array(F.col(single)))
    return F.coalesce(one, F.col(listed), F.col(keyed))
