"""Toxicity, personal data, near duplicates, sharding, decontamination and the pipeline."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seedloom.llm import QUERIES, decontam, jaccard, pii, sharding, toxicity
from seedloom.llm.common import Tokens, WordHashes


def auc(labels, scores):
    y, s = np.asarray(labels), pd.Series(scores).rank().to_numpy()
    n1 = y.sum()
    return (s[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


# Toxicity


def test_toxicity_held_out(spark):
    """Accuracy on the held-out fold."""
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_toxicity"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]] == got["held_out"].tolist()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert auc(held["toxic"], held["score"]) > 0.9
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.05


@pytest.fixture(scope="module")
def small_corpus(spark):
    rng = random.Random(3)
    plain = "the people of this town walk along the river every day and talk about weather bread music gardens".split()
    bad = ["idiot", "moron", "worthless"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randint(0, 29)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_restores(spark, small_corpus, edge_docs, edge_rows, no_docs):
    docs, labels = small_corpus
    model = toxicity.train(docs, labels)
    words = toxicity.Words(toxicity.Decoder(model.counts))
    for raw in ("1d10t", "i d i o t", "i.d.i.o.t", "iiiidiooot", "!d!0t", "M0R0N", "m-o-r-o-n", "w0rthl3$$"):
        assert words.restored(f"the  {raw}\nriver").split() in (["the", "idiot", "river"], ["the", "moron", "river"], ["the", "worthless", "river"]), raw
    assert words.restored("the people\nwalk, along  the river.") == "the people\nwalk, along  the river."
    texts = ["people walk along the river", "people walk 1d10t the river", "you m o r o n talk about bread", "", None, "wooorthlesss music"]
    got = toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert [r["score"] >= 0.5 for r in got] == [False, True, True, False, False, True]
    scored = toxicity.score(edge_docs, model)
    assert sorted(scored.columns) == sorted(edge_docs.columns) and scored.filter("score between 0 and 1").count() == len(edge_rows)
    back = toxicity.restore(edge_docs, model.counts)
    assert back.count() == len(edge_rows)
    assert toxicity.score(no_docs, model).count() == 0
    blank = toxicity.train(no_docs, labels.limit(0))
    assert toxicity.score(edge_docs, blank).agg(F.max("score")).first()[0] < 0.5
    nulls = spark.createDataFrame([(None, 1), (4, None), (8, 1), (8, 0), (6, 0)], "doc_id long, toxic int")
    toxicity.train(docs, nulls)


def test_toxicity_short_and_symbolic(spark, small_corpus):
    """Three spaced letters and words of symbols are read; numbers and prices are left alone."""
    docs, labels = small_corpus
    more = spark.createDataFrame([(1000 + i, "what an ass he is in this town") for i in range(60)], "doc_id long, text string")
    model = toxicity.train(docs.union(more), labels.union(more.selectExpr("doc_id", "1")))
    words = toxicity.Words(toxicity.Decoder(model.counts))
    for raw in ("a s s", "a$$", "4$$", "a.s.s", "asssss"):
        assert words.restored(f"the {raw} walk") == "the ass walk", raw
    for raw in ("455", "$455", "4.55", "1-2-3", "100%", "3+4"):
        assert words.restored(f"the {raw} walk") == f"the {raw} walk", raw
    assert model.weights["ass"] > 0 and len(model.weights) < 60


def test_toxicity_ngrams_are_exact(spark):
    rows = [("abcab",), ("ABC, abc!",), ("ça x1 ça",), ("",)]
    got = toxicity.ngram_counts(toxicity.word_counts(spark.createDataFrame(rows, "text string")), rarest=0.0)
    want = Counter()
    for w, n in (("abcab", 1), ("abc", 2), ("ça", 2)):
        m = f"^{w}$"
        for i in range(len(m)):
            for k in range(1, toxicity.ORDER + 1):
                if i + k <= len(m):
                    want[m[i : i + k]] += n
    assert {g: got.of(g) for g in got.grams.tolist()} == want and got.of("zz") == 0.0 and got.total == sum(want.values())


def test_toxicity_uses_every_telling_word(spark):
    """More telling words than the classifier had room for once: each one is caught alone."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    bad, plain = [word() for _ in range(700)], [word() for _ in range(300)]
    rows, labels = [], []
    for i in range(14_000):
        toxic = i % 2
        rows.append((i, " ".join([rng.choice(plain) for _ in range(8)] + ([bad[i // 2 % 700]] if toxic else []))))
        labels.append((i, toxic))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = spark.createDataFrame([(f"{plain[0]} {b}",) for b in bad], "text string")
    assert toxicity.score(texts, model).filter("score >= 0.5").count() >= 690


def test_viterbi_is_exhaustive_search():
    """The decoder's path is the best of all paths of the lattice."""
    counts = Counter()
    for w, n in (("lit", 9), ("oil", 5), ("toil", 4), ("sit", 7), ("ill", 3)):
        m = f"^{w}$"
        for i in range(len(m)):
            for k in range(1, 5):
                if i + k <= len(m):
                    counts[m[i : i + k]] += n
    d = toxicity.Decoder(toxicity.Counts(list(counts), list(counts.values())))

    def paths(raw, at=0, before=""):
        if at == len(raw):
            yield 0.0, ""
            return
        c = raw[at]
        options = [(c, 0.0)]
        if c in toxicity.IMITATES:
            options += [(x, toxicity.SUBSTITUTED) for x in toxicity.IMITATES[c]]
        elif c in toxicity.SEPARATORS:
            options = [("", toxicity.SEPARATED), (" ", toxicity.SPLIT)]
        if c == before:
            options.append(("", toxicity.STRETCHED))
        for rest_cost, rest in paths(raw, at + 1, c):
            for char, cost in options:
                yield rest_cost + cost, char + rest

    def worth(cost, out):
        total, context = -cost, "^"
        for char in out:
            total += d.log_p(context, "$" if char == " " else char)
            context = "^" if char == " " else (context + char)[1 - toxicity.ORDER :]
        return total + d.log_p(context, "$")

    for raw in ("1l1t", "0i1", "t00il", "s.i.t", "$1t 0il", "i11"):
        best = max(worth(c, o) for c, o in paths(raw))
        got = d.decode(raw)
        assert any(o == got and abs(worth(c, o) - best) < 1e-9 for c, o in paths(raw)), raw


# Personal data

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    worth = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for k, v in enumerate(worth)) % 10 == 0


def spans_of(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in QUERIES["op6_pii"](spark, sf_dir).collect()}
    for i, t in documents:
        spans = spans_of(t)
        shown = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k, _ in KINDS] == [sum(s[3] == k for s in spans) for k, _ in KINDS]
        assert set(filter(None, shown.split(","))) <= set(got[i]["spans"].split(","))


@pytest.mark.parametrize("seed", range(3))
def test_pii_patterns(spark, seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "_", "x.y%z@q-1.de.", "1.2.3.4", ".", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "00012.001.255.0", "é😀", " ", "-", "@", "7" * 30, "5", "\n", "(", "٣"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    for r in found:
        got = [(s["start"], s["rank"] - 1, s["end"], s["kind"]) for s in r["spans"] or [] if s["kind"] != pii.TERM]
        assert got == spans_of(text[r["doc_id"]]), text[r["doc_id"]]


def test_pii_terms_and_edges(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(1)
    filler = [f"{a}{b}" for a in ("ba", "co", "du", "fi", "gu") for b in ("ran", "sel", "tim", "vok", "wup")]
    rows = [(i, " ".join(rng.choice(filler) for _ in range(20))) for i in range(200)]
    rows += [(300 + i, f"{rng.choice(filler)} Zanzibarian ann@mail.org {rng.choice(filler)} {i}th") for i in range(6)]
    rows += [(400, "Zanzibarian ann@mail.org"), (400, "Zanzibarian ann@mail.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(docs)
    kinds = {r["doc_id"]: [(s["kind"], s["match"]) for s in r["spans"] or []] for r in found.collect()}
    for i in (*range(300, 306), 400):
        assert kinds[i] == [("term", "Zanzibarian"), ("email", "ann@mail.org")]
    assert not any(kinds[i] for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, found).collect()}
    assert clean[400] == "[term] [email]" and clean[5] == dict(rows)[5]
    edge = pii.find_personal_data(edge_docs).collect()
    assert len(edge) == len(edge_rows) and not any(r["spans"] for r in edge)
    assert pii.find_personal_data(no_docs).count() == 0


def test_pii_terms_without_entity(spark):
    """A disclosing term is a span in texts that do not have the entity, too."""
    rows = [(i, f"plain words of text {i}") for i in range(500)]
    rows += [(600 + i, f"Zanzibarian ann@mail.org w{i}th") for i in range(6)]
    rows += [(700, "only zanzibarian here, Zanzibarian"), (None, "a ZANZIBARIAN without id"), (701, "Zanzibarians"), (702, "zanzibarian bob@x.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(docs)
    kinds = {r["doc_id"]: [(s["kind"], s["start"], s["match"]) for s in r["spans"] or []] for r in found.collect()}
    assert kinds[700] == [("term", 5, "zanzibarian"), ("term", 23, "Zanzibarian")]
    assert kinds[None] == [("term", 2, "ZANZIBARIAN")] and not kinds[701] and not kinds[1]
    assert kinds[702] == [("term", 0, "zanzibarian"), ("email", 12, "bob@x.org")]
    assert {r["text"] for r in pii.sanitise(docs, found).filter("doc_id = 700").collect()} == {"only [term] here, [term]"}


def test_pii_generalises(spark):
    """A term gives way to the longest beginning that surely discloses less than the threshold, else to [term]."""
    rows = [(i, f"zander fish of text {i}") for i in range(300)] + [(400 + i, f"plain words, number {i}") for i in range(700)]
    rows += [(2000 + i, f"Zanzibarian ann@mail.org Qux ann@mail.org w{i}th") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(docs)
    got = {r["doc_id"]: [(s["match"], s["general"]) for s in r["spans"] or [] if s["kind"] == pii.TERM] for r in found.collect()}
    assert got[2000] == [("Zanzibarian", "zan"), ("Qux", None)] and not got[0] and not got[400]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, found).collect()}
    assert clean[2003] == "[zan*] [email] [term] [email] w3th" and clean[7] == dict(rows)[7]


def test_pii_many_entities_in_a_text(spark):
    """Entities of the same texts count as one: texts with 3,000 addresses and words each are no product of both."""
    letters = "abcdefghijklmnopqrst"
    word = lambda i: "".join(letters[i // 20**k % 20] for k in range(3))
    body = " ".join(f"{word(i)}zz u{i}@mail.org" for i in range(3000))
    rows = [(i, f"plain text number {i}") for i in range(200)] + [(900 + i, f"{body} end{word(i)}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    matches = pii.texts_with_matches(docs.select(F.col("doc_id").alias("doc"), "text"))
    terms = pii.disclosing_terms(docs.select(F.col("doc_id").alias("doc"), "text"), matches, pii.base_spans(matches)).collect()
    assert len({r["entity"] for r in terms}) == 1 and {r["term"] for r in terms} == {f"{word(i)}zz" for i in range(3000)}


def test_pii_long_runs(spark):
    """Long runs of one character class stay linear and do not overflow the stack."""
    text = "a" * 200_000 + " " + "1" * 200_000 + " " + "1 " * 50_000 + "1." * 50_000 + " b@c.de"
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["kind"], s["match"]) for s in r["spans"] if s["kind"] != pii.TERM][-1] == ("email", "b@c.de")


# Near duplicates


def joined_by_brute_force(rows, threshold=0.8):
    words = WordHashes()
    sets = [(i, frozenset(jaccard.shingles(t or "", words).tolist())) for i, t in rows if i is not None]
    first = {}
    for i, s in sets:
        first[s] = min(first.get(s, i), i)
    reps = list(first)
    near = defaultdict(set)
    for a in range(len(reps)):
        for b in range(a):
            if reps[a] and reps[b] and len(reps[a] & reps[b]) * 5 >= 4 * len(reps[a] | reps[b]):
                near[a].add(b)
                near[b].add(a)
    root = {}
    for a in range(len(reps)):
        todo, seen = [a], {a}
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        root[a] = min(first[reps[k]] for k in seen)
    place = {s: k for k, s in enumerate(reps)}
    return sorted((i, root[place[s]], len(near[place[s]]), first[s]) for i, s in sets)


def check_join(docs, rows):
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["set_id"]) for r in jaccard.similarity_join(docs).collect() if r["doc_id"] is not None)
    assert got == joined_by_brute_force(rows)


def test_join_documents(spark, sf_dir, documents):
    got = sorted(map(tuple, QUERIES["op7_jaccard"](spark, sf_dir).select("doc_id", "class_id", "n_links", "set_id").collect()))
    assert got == joined_by_brute_force(documents)


def test_join_large_group(spark, monkeypatch):
    """A group of near copies larger than a block: every link is counted once."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randint(0, 119)] = f"z{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i % 9][1]) for i in range(30)] + [(200 + i, f"unlike {i} " * 9) for i in range(20)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)


def test_join_links_across_blocks(spark, monkeypatch):
    """Single near-duplicate pairs in one candidate cluster, most of them in two blocks, are groups."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 400)
    words = [f"w{i}" for i in range(1000)]
    rows = [(2 * i + j, " ".join(words[20 * i + 3 * j :][:104])) for i in range(40) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_join(docs, rows)
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 for r in jaccard.similarity_join(docs).collect())


def test_join_edges(spark, edge_docs, edge_rows, no_docs):
    check_join(edge_docs, edge_rows)
    out = jaccard.similarity_join(edge_docs)
    assert out.count() == len(edge_rows)
    assert jaccard.similarity_join(no_docs).count() == 0


def test_banding_recall():
    """Share of pairs at the threshold that share a band, over random sets."""
    rng = np.random.default_rng(0)
    bands, rows = jaccard.choose_bands(jaccard.THRESHOLD, jaccard.RECALL)
    a, b = jaccard._permutations(bands * rows)
    hits = 0
    for _ in range(200):
        base = rng.integers(0, 2**63, 180, dtype=np.uint64)
        x, y = np.sort(base[:162]), np.sort(np.concatenate([base[:144], base[162:]]))  # 144 of 180 shared
        hits += any(p == q for p, q in zip(jaccard.band_hashes(x, bands, rows, a, b), jaccard.band_hashes(y, bands, rows, a, b)))
    assert hits >= 197


# Sharding


def check_shards(rows, n):
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(by[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_sharding(spark, sf_dir, documents, edge_docs, edge_rows, no_docs):
    got = QUERIES["op8_shards"](spark, sf_dir).collect()
    check_shards(got, len(documents))
    text, of = dict(documents), defaultdict(set)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        of[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    check_shards(sharding.balanced_shards(edge_docs).collect(), len(edge_rows))
    assert sharding.balanced_shards(no_docs).count() == 0


def test_sharding_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOGETHER", 100)
    rows = [(i, "the same" if i % 3 == 0 else f"pair {i // 7}" if i % 7 < 2 else f"own {i}") for i in range(1603)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    check_shards(got, len(rows))
    text, of = dict(rows), defaultdict(Counter)
    for r in got:
        of[text[r["doc_id"]]][r["shard"]] += 1
    assert len(of["the same"]) <= 9  # 535 copies; a shard takes 100
    pairs = [c for t, c in of.items() if t.startswith("pair") and sum(c.values()) > 1]
    assert sum(len(c) == 1 for c in pairs) >= 0.8 * len(pairs)


# Decontamination


def items_of(spark, sf_dir):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


def test_decontaminate_documents(spark, sf_dir, documents):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontaminate"](spark, sf_dir).collect()}
    plain = lambda t: " ".join((t or "").lower().split())
    held = {(i, k) for k, item in items_of(spark, sf_dir) for i, t in documents if plain(item) in plain(t)}
    assert held <= got
    for i, k in got - held:
        d, _ = decontam.infix_distance(plain(dict(items_of(spark, sf_dir))[k]), plain(dict(documents)[i]))
        assert d <= decontam.MOST_EDITS * len(plain(dict(items_of(spark, sf_dir))[k]))


@pytest.mark.parametrize("share,least", [(0.05, 0.99), (0.1, 0.97), (0.15, 0.9)])
def test_decontamination_recall(spark, sf_dir, share, least):
    """Items with a share of their words changed, dropped or added are found inside longer texts."""
    rng = random.Random(9)
    items = items_of(spark, sf_dir)
    rows = []
    for i, text in items:
        for j in range(5):
            words = text.split()
            for _ in range(max(1, int(len(words) * share))):
                at = rng.randrange(len(words))
                kind = rng.randrange(3)
                words[at : at + 1] = [] if kind == 0 else ["qz"] if kind == 1 else [words[at], "qz"]
            around = [f"n{rng.randint(0, 99)}" for _ in range(40)]
            cut = rng.randint(0, 40)
            rows.append((1000 * i + j, " ".join(around[:cut] + words + around[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda t: " ".join(t.lower().split())
    text = dict(items)
    true = {(d, d // 1000) for d, t in rows if decontam.infix_distance(plain(text[d // 1000]), plain(t))[0] <= decontam.MOST_EDITS * len(plain(text[d // 1000]))}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaked_items(docs, bench).collect()}
    assert len(true & got) >= least * len(true)
    assert not {g for g in got if g[0] // 1000 != g[1]} or len(got - true) <= 0.02 * len(got)


@pytest.mark.parametrize("size,every,least", [(15, 2, 0.9), (15, 3, 0.97), (30, 2, 0.97), (30, 5, 0.99)])
def test_decontamination_typos(spark, sf_dir, documents, size, every, least):
    """One letter changed in every second, third or fifth word: far inside the promised edits."""
    rng = random.Random(size + every)
    tokens = [t.split() for _, t in documents if t and len(t.split()) > 80]
    items, rows = [], []
    while len(items) < 150:
        words = rng.choice(tokens)
        at = rng.randrange(len(words) - size)
        item = words[at : at + size]
        if len(set(item)) < 0.6 * size:
            continue
        typed = [w[: len(w) // 2] + rng.choice("qxz") + w[len(w) // 2 + 1 :] if i % every == 0 else w for i, w in enumerate(item)]
        rows.append((len(items), " ".join(rng.choice(tokens)[:30] + typed + rng.choice(tokens)[:30])))
        items.append((len(items), " ".join(item)))
    # The shares of words come from a whole corpus, of which these texts are a part.
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.createDataFrame([(None, t) for _, t in documents], "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in found for i, _ in rows) >= least * len(rows)


def test_decontaminate_many_short_items(spark):
    """Short items against brute force, and a thousand of them against a long text in little time."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 5)))) for i in range(1000)]
    texts = []
    for i in range(40):
        words = [word() for _ in range(60)]
        for _, item in rng.sample(items, 3):
            at = rng.randrange(len(item))
            edited = item[:at] + rng.choice(["", "z", "zz"]) + item[at + 1 :]
            words.insert(rng.randrange(60), edited)
        texts.append((i, " ".join(words)))
    short = decontam.Short(items, decontam.MOST_EDITS)
    for _, text in texts[:4]:
        want = {i for i, t in items if int(len(t) * 0.2) and decontam.infix_distance(t, text)[0] <= 0.2 * len(t)}
        assert {i for i, _, _ in short.find(text) if int(len(dict(items)[i]) * 0.2)} == want and len(want) >= 2
    long = [(99, " ".join(word() for _ in range(5000)))]
    start = time.time()
    decontam.leaked_items(spark.createDataFrame(texts + long, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert time.time() - start < 60


def test_decontaminate_edges(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "a text of some words"), (4, edge_rows[7][1]), (4, edge_rows[7][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaked_items(edge_docs, bench).collect()}
    assert {(3, 3), (16, 3), (7, 4), (8, 4), (9, 4), (None, None)} == got
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 2)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaked_items(edge_docs, bench).collect()} == got
    assert decontam.leaked_items(no_docs, bench).count() == 0
    assert decontam.leaked_items(edge_docs, bench.limit(0)).count() == 0


def test_decontaminate_symbols_and_short_items(spark):
    """Free-standing symbols count on both sides; short and unspaced items are found with edits."""
    code = " ".join(f"{a} = {b} + {c} -" for a, b, c in zip("abcdefghij", "klmnopqrst", "uvwxyzabcd"))
    items = [(1, code), (2, "short answer"), (3, "数据清洗是训练之前的重要步骤"), (4, "yes")]
    rows = [(1, f"before it {code} after"), (2, "(Short answer)."), (3, "a shart answer!"), (4, "我们说数据清先是训练之前的重要步骤。"), (5, "yesterday"), (6, "(yes)"), (7, "nothing")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.leaked_items(docs, bench).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 2, 1), (4, 3, 1), (6, 4, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_infix_distance(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 14)))
        b = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
        row = [0] * (len(b) + 1)
        for i, c in enumerate(a):
            new = [i + 1]
            for j, e in enumerate(b):
                new.append(min(row[j] + (c != e), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontam.infix_distance(a, b)[0] == min(row)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefg ", "a\u00e9\u6f22\U0001f600x"])
def test_infix_distances_side_by_side(alphabet):
    """Windows verified together have the distance of each alone, as far as the item may be edited."""
    rng = random.Random(3)
    letters = lambda n, more="": "".join(rng.choice(alphabet + more) for _ in range(n))
    items, windows = [], []
    for size in [1, 3, 40, 63, 64, 65, 128, 129, 190, 512, 700] * 30:
        item, window = letters(size), letters(rng.randint(0, 900), "z")
        edited = [c for c in item if rng.random() > 0.1]
        edited = [c if rng.random() > 0.1 else "q" for c in edited]
        at = rng.randint(0, len(window))
        items.append(item)
        windows.append(window[:at] + "".join(edited) * rng.randint(0, 1) + window[at:])
    got = decontam.infix_distances(items, windows, 0.2)
    one = np.array([decontam.infix_distance(a, b)[0] for a, b in zip(items, windows)])
    near = one <= 0.2 * np.array([*map(len, items)])
    assert near.sum() > 100 and (got[near] == one[near]).all() and (got[~near] > 0.2 * np.array([*map(len, items)])[~near]).all()


def test_decontamination_cost(monkeypatch):
    """Windows of many texts are not walked one by one."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(20)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) + f" {items[i % 20][1].upper()}.  " for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["doc", "text"])
    words = WordHashes()
    known = np.unique(np.concatenate([words.of(text) for _, text in items]))
    run = decontam._scan(items, decontam.Shares(known, np.full(len(known), 60), 30_000), decontam.MOST_EDITS)
    calls = Counter()
    alone = decontam.infix_distance
    monkeypatch.setattr(decontam, "infix_distance", lambda *a: calls.update(["walk"]) or alone(*a))
    found = [row for out in run(iter([batch])) for row in zip(*(c.to_pylist() for c in out.columns))]
    assert {(doc, item, d) for doc, item, d, _, _ in found} >= {(i, i % 20, 0) for i in range(400)}
    assert calls["walk"] < 40


def test_tokens_of_texts():
    texts = ["", None, " a  B,\n", "\u3000x\x85Y \x1f(z) --", "One one ONE."]
    got = Tokens(pa.array(texts))
    for i, text in enumerate(texts):
        h = got.hashes()[got.ends[i] : got.ends[i + 1]]
        assert h[h != 0].tolist() == WordHashes().of(text or "").tolist()
        assert [t for t in got.flat.to_pylist()[got.ends[i] : got.ends[i + 1]] if t] == (text or "").split()


# Pipeline


def test_pipeline(spark, sf_dir, documents):
    """Every stage against what its operator's brute-force version says of its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).persist()
        kept[name] = out
        if name != "encoding":
            assert out.columns == docs.columns
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
            assert set(after) <= set(before) and all(n == len(t) for t, n in after.values())
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            clean = {r["doc_id"] for r in labels.filter("toxic = 0").collect()}
            assert len(clean - set(after)) <= 0.03 * len(clean)
        if name == "line_dedup":
            from tests.llm.test_texts import kept_lines

            rows = list(before.items())
            assert {i: t for (i, _), t in zip(rows, kept_lines(rows))} == {i: t for i, (t, _) in after.items()}
        if name == "near_duplicates":
            assert set(after) == {i for i, c, _, _ in joined_by_brute_force(list(before.items())) if i == c}
        if name == "decontamination":
            plain = lambda t: " ".join(t.lower().split())
            items = items_of(spark, sf_dir)
            assert not [i for i, (t, _) in after.items() if any(plain(x) in plain(t) for _, x in items)]
            assert len(set(before) - set(after)) <= len(items)
        docs = out
    assert docs.count() == kept["decontamination"].count()


def test_pipeline_edges(spark, sf_dir, edge_docs, no_docs):
    for rows in (edge_docs, no_docs):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir).persist()  # else every stage runs the ones before again
            out.count()
            assert name == "encoding" or out.columns == docs.columns
            docs = out
        assert docs.count() <= rows.count()


def test_pipeline_judges_rows(spark, sf_dir):
    """Rows without an id and rows that share one: each text is judged for itself."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    prose = lambda k: " ".join(f"{w}{k}" for w in "walk river bread music garden window paper table winter summer".split())
    rows = [(None, f"{prose(1)} {item} {prose(2)}"), (5, f"{prose(3)} {item}"), (5, prose(4)), (None, prose(5)), (6, prose(6)), (None, prose(6)), (None, prose(7)), (None, prose(7) + " end"), (7, None), (None, "")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_leaks(spark, docs, sf_dir).collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert len(left) == 7 and (6, prose(6)) in left and (None, prose(6)) not in left and (7, None) in left and (None, "") not in left
    assert ((None, prose(7)) in left) != ((None, prose(7) + " end") in left)
    assert {(5, prose(4)), (None, prose(5)), (None, rows[0][1]), (5, rows[1][1])} <= set(left)
    # Line dedup and toxicity leave such rows alone.
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_toxic):
        assert stage(spark, docs, sf_dir).count() == len(rows)
