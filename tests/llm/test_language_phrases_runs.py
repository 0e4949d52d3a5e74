"""Language identification, phrase collocations and periodic runs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from seedloom.llm import QUERIES, collocations, langid, periodic
from tools.compare import canonical

# Language identification


def test_language_held_out(spark, sf_dir):
    got = QUERIES["op11_language"](spark, sf_dir).collect()
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(want)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_language_labels_are_not_inputs(spark, sf_dir):
    """Languages of the held-out rows change nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    told = langid.predict(docs, langid.train(docs)).select("doc_id", "lang_pred", "score")
    shuffled = docs.withColumn("lang", langid.F.when(langid.held_out("doc_id"), "xx").otherwise(docs["lang"]))
    again = langid.predict(shuffled.select("doc_id", "text"), langid.train(shuffled)).select("doc_id", "lang_pred", "score")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, again.collect()))


def test_language_close_pairs(spark):
    """Three close languages of one family and one of another, told apart by their words."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeilmnoprstu") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    own = {x: [w + e for w in base[:12]] for x, e in (("es", "os"), ("pt", "oz"), ("it", "ij"))}
    own["fi"] = ["".join(rng.choice("yöäkhv") for _ in range(5)) for _ in range(40)]

    def text(x):
        return " ".join(rng.choice(own[x]) if rng.random() < 0.2 or x == "fi" else rng.choice(base) for _ in range(60))

    rows = [(i, text(x), x) for i, x in enumerate(list(own) * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, most=60, fewest=3)
    assert {k[0] for k in model.machines} == {"family", "pair"} and len([k for k in model.machines if k[0] == "pair"]) == 3
    got = langid.predict(docs, model).filter(langid.held_out("doc_id")).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)


def test_machine_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] - 2 * x[:, 3] > 0.1, 1.0, -1.0)
    w, bias = langid.fit_machine(x, y)
    assert ((x @ w + bias > 0) == (y > 0)).mean() > 0.97
    # No small step of weights or bias lowers the loss (both classes weigh the same).
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * langid.PENALTY
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()
    v = np.r_[w, bias]
    for i in range(6):
        for d in (1e-2, -1e-2):
            step = v.copy()
            step[i] += d
            assert loss(step) >= loss(v) - 1e-2
    assert langid.fit_machine(x[:3], np.ones(3))[1] == 1.0


def test_language_edges(edge_docs, no_docs, edge_rows):
    docs = edge_docs.withColumn("lang", langid.F.when(edge_docs["doc_id"] % 2 == 0, "en").when(edge_docs["doc_id"] < 8, "fr").cast("string"))
    model = langid.train(docs, fewest=1)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(edge_rows) and got[0].asDict().keys() >= {"ids", "lang_pred", "score"}
    for r in got:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert r["lang_pred"] in (("en", "fr") if letters else ("und",))
        assert letters or r["score"] == 0
    nothing = langid.train(no_docs.withColumn("lang", langid.F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.predict(no_docs, model).count() == 0
    one = docs.withColumn("lang", langid.F.lit("de"))
    assert {r["lang_pred"] for r in langid.predict(one, langid.train(one)).collect()} == {"de", "und"}


# Phrase collocations


def brute_phrases(rows, longest, fewest, subsumed, best):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in (text or ""))
        total[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: n for k, n in counts.items() if n >= fewest and len(k[1]) > 1}
    out = {}
    for (lang, w), a in found.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(x == lang and len(v) > len(w) and inside(v) and 100 * n >= subsumed * a for (x, v), n in found.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
        for lang, got in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(got)[:best])
    )


@pytest.mark.parametrize("cells, subsumed, together", [(1 << 16, 100, 10**9), (64, 60, 40)])
def test_collocations_brute_force(spark, monkeypatch, cells, subsumed, together):
    """Small tables let nearly all through and small buffers cut every count in parts: same rows."""
    monkeypatch.setattr(collocations, "TOGETHER", together)
    rng = random.Random(7)
    words = ["a", "b", "c", "Dé", "é", "x y", "f\tg", "h.", "i\n", "K", "😀", "q?!", "|"]
    texts = ["  ".join(rng.choice(words[: rng.randint(2, 13)]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [(t, rng.choice(["en", "de", None, "und", ""])) for t in texts] + [(None, "en"), (None, None), ("", "fr"), ("one two", "fr")]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "text string, lang string")
    counts = collocations.phrase_counts(docs, fewest=6, cells=cells)
    got = collocations.best_by_language(collocations.collocations(counts, subsumed), 15)
    got = got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = brute_phrases(rows, 5, 6, subsumed, 15)
    assert sorted(map(tuple, got)) == want and len(want) > 30


def test_collocations_hot_word(spark):
    """A third of all words is one word, in one language; stripes are sliced, counts are whole."""
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(["the", f"w{rng.randrange(300)}", f"v{rng.randrange(9)}"]) for _ in range(400)), "en") for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    counts = collocations.phrase_counts(docs, fewest=20)
    got = collocations.best_by_language(collocations.collocations(counts), 50)
    got = got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 5, 20, 100, 50)


def test_collocations_exchange_is_bounded(spark, monkeypatch):
    """Where all phrases are frequent, or small tables let all through, a word costs the exchanges a few bytes."""
    rng = random.Random(11)
    words = [f"w{i:04d}" for i in range(400)]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=1000)), "en") for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    sent, repartition, F = [], type(docs).repartition, collocations.F

    def counted(df, *by):
        size = sum((F.length(c) if kind == "binary" else F.length(F.to_json(F.struct(c))) for c, kind in df.dtypes), F.lit(0))
        sent.append(df.agg(F.sum(size)).first()[0])
        return repartition(df, *by)

    monkeypatch.setattr(type(docs), "repartition", counted)
    monkeypatch.setattr(collocations, "PARCELS", 16)
    counts = collocations.phrase_counts(docs, fewest=1, cells=64)
    assert sum(sent) < 20 * 60_000
    assert counts.filter("size = 5").agg(F.sum("n")).first()[0] == 60 * 996
    assert counts.filter("size = 2").agg(F.sum("n")).first()[0] == 60 * 999


def test_collocations_exact_beyond_64_bits(spark):
    big = 3 * 10**9
    rows = [("en", 0, "", "", "", 10**13), ("en", 1, "", "a", "a", big), ("en", 1, "", "b", "b", big), ("en", 2, "a", "b", "a b", big - 1)]
    counts = spark.createDataFrame(rows, "lang string, size int, prefix string, next string, phrase string, n long")
    assert collocations.collocations(counts).first()["score"] == 1000 * (big - 1) * 10**13 // big**2


def test_collocations_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    a, b = canonical(QUERIES["op12_collocations"](spark, sf_dir).toPandas()), canonical(con.execute(collocations.OP12_SQL).df())
    assert list(a.columns) == list(b.columns) and a.values.tolist() == b.values.tolist()


def test_collocations_edges(edge_docs, no_docs, edge_rows):
    docs = edge_docs.withColumn("lang", collocations.F.lit(None).cast("string"))
    got = collocations.best_by_language(collocations.collocations(collocations.phrase_counts(docs, fewest=2)), 10**6)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == brute_phrases(
        [(t, None) for _, t in edge_rows], 5, 2, 100, 10**6
    )
    empty = collocations.phrase_counts(no_docs.withColumn("lang", collocations.F.lit("x")))
    assert collocations.best_by_language(collocations.collocations(empty)).count() == 0


# Periodic runs


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        j = q
        while j < n:
            if words[j] != words[j - q]:
                j += 1
                continue
            s = j
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - s + q >= max(6, 4 * q):
                out.setdefault((s - q, j), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def planted_sequence(rng):
    k = rng.choice([1, 2, 2, 3, 4])
    w = [rng.randrange(k) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 3)):
        p, a = rng.randint(1, 14), rng.randint(0, len(w))
        base = [rng.randrange(k) for _ in range(p)]
        length = rng.randint(2 * p, 6 * p + 3)
        w[a:a] = (base * (length // p + 1))[:length]
    return (w + w[: rng.randint(1, 8)]) * rng.randint(1, 5) if rng.random() < 0.3 else w


def test_find_runs_brute_force():
    rng = random.Random(4)
    for _ in range(600):
        w = planted_sequence(rng)
        assert periodic.find_runs(np.array(w, dtype=np.int64)) == brute_runs(w)
    for w in ([1] * 700, [1, 2] * 300, [1, 1, 2] * 200, list(range(90)) * 5, [0] * 5, [0] * 6, []):
        assert periodic.find_runs(np.array(w, dtype=np.int64)) == brute_runs(w)


def test_range_successor():
    rng = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 400):
        values = rng.permutation(n)
        tree = periodic.WaveletTree(values)
        for _ in range(60):
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            bound = int(rng.integers(0, n + 1))
            a = np.array([lo])
            inside = sorted(values[lo:hi].tolist())
            below = int(tree.below(a, np.array([hi]), np.array([bound]))[0])
            assert below == sum(v < bound for v in inside)
            if below < len(inside):
                assert tree.nth(a, np.array([hi]), np.array([below]))[0] == min(v for v in inside if v >= bound)


def brute_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_query(spark, sf_dir, documents):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_runs"](spark, sf_dir).collect()}
    assert len(got) == len(documents)
    short = [d for d in documents if len(d[1] or "") < 6_000]
    assert sum(got[i][1] > 0 for i, _ in short) > 10
    for i, text in short:
        assert got[i] == brute_row(i, text)


def test_runs_edges(spark, edge_docs, no_docs, edge_rows):
    got = periodic.collapse_runs(edge_docs).collect()
    assert len(got) == len(edge_rows) and "ids" in got[0].asDict()
    for r in got:
        words = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        assert r["n_words"] == len(words)
        if len(words) < 2_000:
            assert [tuple(x) for x in r["runs"]] == brute_runs(words)
        assert r["runs"] or r["collapsed"] == " ".join(words)
    assert periodic.collapse_runs(no_docs).count() == 0
    # Other spaces than the six are parts of words.
    docs = spark.createDataFrame([(1, "x y " * 30 + "\x1cz"), (1, "x y " * 30 + "\x1cz")], "doc_id long, text string")
    for r in periodic.collapse_runs(docs).collect():
        assert ([tuple(x) for x in r["runs"]], r["collapsed"]) == ([(0, 30, 1)], "x y \x1cz")
