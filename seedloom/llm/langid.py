"""Language of whole texts by hierarchical discrimination.

The family comes first: one linear support vector machine for each family against the others.
Inside the family, languages are told apart one against one, with a machine for each pair; most
victories win, then the greater sum of margins, then the name. A text is the vector of square
roots of the shares of its character n-grams (one to three characters inside words, with a mark for
beginning and end), which has length one.

Machines are fitted on a bounded sample: ``MOST_LABELLED`` texts of each language, those with the
smallest hash of their id. The n-grams found in ``FEWEST`` of these texts or more are the features.
Each machine is a group of a grouped map and sees the sample only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.llm.common import columns_of, in_batches, keep, table

# Labelled texts of each language that machines are fitted on, at most.
MOST_LABELLED = 400
# Texts of the sample that hold a feature, at least.
FEWEST = 5
FOLDS, HELD = 4, 2
# How hard the machines press for a margin.
PENALTY = 10.0
# How steeply a margin turns into a share of the score.
STEEPNESS = 3.0
UNKNOWN = "und"

# Families of languages by their ISO 639-1 codes. Other values are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt ug",
    "indo-aryan": "hi ur bn pa gu mr ne si or as",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv su mg",
    "sino-tibetan": "zh my bo",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def grams(text: str) -> np.ndarray:
    """The n-grams of one to three characters of the lower-cased words of a text, one after another.

    An n-gram is a number, 21 bits a character. A space stands for the beginning and the end of
    a word; no n-gram has one in its middle.
    """
    plain = f" {' '.join(text.lower().split())} "
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1
    space = c == 33
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.concatenate([c[~space], two[~(space[:-1] & space[1:])], three[~space[1:-1]]])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Features:
    """Vectors of texts over known n-grams, which are given in ascending order."""

    def __init__(self, names: np.ndarray):
        self.names = np.asarray(names, dtype=np.int64)

    def of(self, text: str) -> np.ndarray:
        """The vector of a text; zero if it has no known n-gram."""
        size = len(self.names)
        if not size:
            return np.zeros(0)
        held = grams(text)
        at = np.minimum(np.searchsorted(self.names, held), size - 1)
        n = np.bincount(at[self.names[at] == held], minlength=size)
        return np.sqrt(n / max(1, n.sum()))


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge loss), y in {-1, 1}.

    Dual coordinate descent on the matrix of products, both classes with the same total penalty, until
    no multiplier moves by more than a ten-thousandth of the largest. ``rounds`` is a guard; beyond it the machine
    is the best one so far, still a separating plane.
    """
    both = len(set(y.tolist())) == 2
    if not both:
        return np.zeros(x.shape[1]), float(y[0]) if len(y) else 0.0
    x1 = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * penalty
    q = (x1 @ x1.T) * np.outer(y, y)
    slack = 1 / (2 * cost)
    alpha, slope = np.zeros(len(y)), np.full(len(y), -1.0)
    order = np.random.default_rng(1).permutation(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in order:
            new = max(0.0, alpha[i] - (slope[i] + slack[i] * alpha[i]) / (q[i, i] + slack[i]))
            step = new - alpha[i]
            if step:
                slope += step * q[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved <= 1e-4 * alpha.max():
            break
    w = (alpha * y) @ x1
    return w[:-1], float(w[-1])


@dataclass
class Model:
    names: np.ndarray
    families: dict[str, list[str]]
    machines: dict[tuple, tuple[np.ndarray, float]]


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id leaves HELD of FOLDS; false without an id."""
    return F.coalesce(F.crc32(F.encode(F.col(f"`{doc_id}`").cast("string"), "UTF-8")) % FOLDS == HELD, F.lit(False))


def sample(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", most: int = MOST_LABELLED) -> DataFrame:
    """(lang, text) of at most ``most`` labelled texts of each language outside the held-out fold.

    Rows without id, text or language are left out, equal rows count once.
    """
    rows = docs.filter(~held_out(doc_id)).select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.dropna().withColumn("hash", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc", F.lit(11)), "doc", "hash")
    keys = rows.select("doc", "lang", "hash").withColumn("nth", F.row_number().over(order))
    # Only ids and hashes are ordered, and each task passes on ``most`` rows of a language at most.
    keys = keys.filter(F.col("nth") <= most).drop("nth").distinct()
    return keep(rows.join(keys, ["doc", "lang", "hash"]).dropDuplicates(["doc", "lang", "hash"]).select("lang", "text"), "languages")


def train(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", most: int = MOST_LABELLED, fewest: int = FEWEST) -> Model:
    """Machines for families and for pairs of languages within each, from the labelled rows of ``docs``."""
    rows = sample(docs, doc_id, text, lang, most)

    def seen(batches):
        for (value,) in columns_of(batches):
            held = np.unique(grams(value))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["gram"])

    found = rows.select("text").mapInArrow(seen, "gram long").groupBy("gram").count()
    names = np.sort(found.filter(F.col("count") >= fewest).toPandas()["gram"].to_numpy(dtype=np.int64))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for name in langs:
        families.setdefault(family(name), []).append(name)

    def vectors(batches):
        features = Features(names)
        schema = pa.schema([("machine", pa.string()), ("of", pa.string()), ("against", pa.string()), ("y", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

        def each():
            for label, value in columns_of(batches):
                x = features.of(value)
                at = np.flatnonzero(x)
                sparse = at.tolist(), x[at].tolist()
                own = family(label)
                if len(families) > 1:
                    for name in families:
                        yield "family", name, "", 1 if name == own else -1, *sparse
                for other in families[own]:
                    if other != label:
                        yield "pair", min(label, other), max(label, other), 1 if label < other else -1, *sparse

        yield from in_batches(each(), schema, size=lambda row: len(row[4]) + 1, most=200_000)

    size = len(names)

    def fit(key, part):
        # One order for the rows, so that a machine fitted again is the same.
        part = part.assign(_key=[(y, *a, *v) for y, a, v in zip(part["y"], part["at"], part["value"])]).sort_values("_key")
        x = np.zeros((len(part), size), dtype=np.float64)
        for i, (at, value) in enumerate(zip(part["at"], part["value"])):
            x[i, at] = value
        w, bias = fit_machine(x, part["y"].to_numpy(dtype=np.float64))
        return pd.DataFrame([(*key, w.tolist(), bias)], columns=["machine", "of", "against", "w", "bias"])

    cases = rows.mapInArrow(vectors, "machine string, of string, against string, y int, at array<int>, value array<float>")
    fitted = cases.groupBy("machine", "of", "against").applyInPandas(fit, "machine string, of string, against string, w array<double>, bias double")
    machines = {(r["machine"], r["of"], r["against"]): (np.array(r["w"]), r["bias"]) for r in fitted.collect()}
    return Model(names, families, machines)


class Judge:
    """text -> (language, score) by a model."""

    def __init__(self, model: Model):
        self.features = Features(model.names)
        self.families = model.families
        keys = sorted(model.machines)
        self.row = {k: i for i, k in enumerate(keys)}
        self.w = np.array([model.machines[k][0] for k in keys]).reshape(len(keys), len(model.names))
        self.bias = np.array([model.machines[k][1] for k in keys])

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.families or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        margins = self.w @ self.features.of(text) + self.bias
        chosen, score = next(iter(self.families)), 1.0
        if len(self.families) > 1:
            m = {f: float(margins[self.row["family", f, ""]]) for f in self.families}
            chosen = min(m, key=lambda f: (-m[f], f))
            shares = np.exp(STEEPNESS * (np.array(list(m.values())) - m[chosen]))
            score = 1 / float(shares.sum())
        langs = self.families[chosen]
        if len(langs) == 1:
            return langs[0], score
        won, sums, sure = Counter(), Counter(), Counter()
        for i, a in enumerate(langs):
            for b in langs[i + 1 :]:
                m = float(margins[self.row["pair", a, b]])
                won[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
                share = 1 / (1 + np.exp(-np.clip(STEEPNESS * m, -50, 50)))
                sure[a] += share
                sure[b] += 1 - share
        best = min(langs, key=lambda x: (-won[x], -sums[x], x))
        return best, score * float(sure[best]) / (len(langs) - 1)


def predict(docs: DataFrame, model: Model, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text in ``to`` and how sure that is (0 to 1) in ``score``.

    Null texts and texts without a letter are ``und`` with score 0, so are all texts if nothing was
    learned. A text of unknown n-grams only falls to the machines' biases. Repeated rows each have
    their result; columns of the two names are replaced, others pass through.
    """
    own = docs.drop(to, score)
    schema = T.StructType([*own.schema.fields, T.StructField(to, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        judge = Judge(model)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text))
            got = [judge(v.as_py()) for v in values]
            arrays = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, to, score])

    return own.mapInArrow(run, schema)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # The language label goes into training only.
    scored = predict(docs.select("doc_id", "text"), train(docs))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
