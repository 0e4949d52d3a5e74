"""WARC, BPE, I-Match, line dedup and URL operators."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seedloom.llm import ORACLES, QUERIES, bpe, imatch, linededup, urls, warc
from seedloom.llm.common import WordHashes, choose_bands
from seedloom.plans.registry import TABLES
from seedloom.session import scratch_path
from tools.compare import canonical


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    a, b = canonical(QUERIES[name](spark, sf_dir).toPandas()), canonical(con.execute(ORACLES[name]).df())
    assert list(a.columns) == list(b.columns) and a.values.tolist() == b.values.tolist()


def test_choose_bands():
    bands, rows = choose_bands(0.8, 0.999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999
    assert choose_bands(1.0, 0.99)[0] == 1
    with pytest.raises(ValueError):
        choose_bands(0.01, 0.999999, 4)


# WARC


def archive(spark, pages, size=None):
    folder = scratch_path(spark, "warc-test")
    kw = {"size": size} if size else {}
    manifest = warc.write_archives(warc.chunked(warc.record_table(pages), **kw), folder)
    return manifest, folder


def test_warc_round_trip(spark):
    big = "".join(random.Random(1).choice("abcdef é\r\n") for _ in range(300_000))
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, None), (4, "http://c", ""), (5, "u", "small"), (6, "u", "small"),
            (7, "http://d", "WARC/1.1\r\n\r\n" * 20), (None, "http://e", big), (9, "http://f", "q" * 99), (8, "http://f", "q" * 100), (7, "http://f", "q" * 100)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    manifest, folder = archive(spark, pages, 10_000)
    got = warc.read_archives(manifest, folder, size=7_000).toPandas()
    back = {}
    for (_, _), g in got.groupby(["file", "record_no"]):
        g = g.sort_values("chunk_no")
        data, h, n = b"", hashlib.sha256(), 0
        for r in g.itertuples():
            assert len(r.chunk) <= 7_000
            h.update(r.chunk)
            n += len(r.chunk)
            data += r.chunk
            assert (r.bytes_so_far, r.digest_so_far) == (n, h.hexdigest())
        last = g.iloc[-1]
        assert last.is_last and not g.is_last.iloc[:-1].any()
        back.setdefault((None if np.isnan(last.page_id) else int(last.page_id), last.declared_digest), []).append((last, data))
    assert sum(map(len, back.values())) == len(rows)
    ids = {r.record_id for r in got.itertuples()}
    assert len(ids) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        (last, data) = back[i, sha(body)][0]
        assert last.declared_bytes == len(body)
        assert data == (body if last.record_type == "response" else b"")
    kind = {(k[0], k[1]): v[0][0].record_type for k, v in back.items()}
    assert kind[1, sha(big)] == "response" and kind[2, sha(big)] == "revisit" and kind[None, sha(big)] == "revisit"
    assert kind[5, sha("small")] == kind[6, sha("small")] == "response"
    assert kind[7, sha("q" * 100)] == "response" and kind[8, sha("q" * 100)] == "revisit"
    assert back[2, sha(big)][0][0].refers_to == 1
    assert back[2, sha(big)][0][0].url == "http://b/%0D%0AX:%20y"


def test_warc_rolls_and_empty(spark):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = scratch_path(spark, "warc-roll")
    manifest = warc.write_archives(warc.chunked(warc.record_table(pages)), folder, roll=1_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == 40
    assert warc.read_archives(manifest, folder, payload=False).count() == 40
    empty, folder = archive(spark, pages.limit(0))
    assert warc.read_archives(empty, folder).count() == 0


# BPE


def whole(text):
    encoding, _ = bpe._encoding(bpe.public_tokenizers.path(bpe.RANKS), bpe.public_tokenizers.PATTERN)
    return encoding.encode_ordinary(text)


def test_bpe_on_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in QUERIES["op3_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for i, t in documents:
        ids = whole(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(np.asarray(ids, "<u4").tobytes()))
        assert got[i]["decoded_sha256"] == sha(t or "")


@pytest.mark.parametrize("seed", range(6))
def test_bpe_pieces(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(bpe, "PIECE", 40)
    encoding, ranks = bpe._encoding(bpe.public_tokenizers.path(bpe.RANKS), bpe.public_tokenizers.PATTERN)
    text = "".join(rng.choice(["a", "B", "é", "1", "٣", " ", "  ", "\n", "'s", "'", "ll", "!?", "😀", "the", "\u00a0", "\t\n "]) for _ in range(3000))
    assert "".join(bpe.pieces(text, 40)) == text
    got = np.frombuffer(bpe.encode_text(text, encoding, ranks, bpe.public_tokenizers.PATTERN), "<u4").tolist()
    assert got == whole(text)
    run = "".join(rng.choice("abct") for _ in range(5000))
    got = np.frombuffer(bpe.encode_text(run, encoding, ranks, bpe.public_tokenizers.PATTERN), "<u4").tolist()
    assert got == whole(run)


def test_bpe_edges(spark, edge_docs, edge_rows, no_docs):
    coded = bpe.encode(edge_docs)
    assert sorted(coded.columns) == sorted(edge_docs.columns)
    back = bpe.decode(coded).select("doc_id", "text", "n_tokens", "decoded").collect()
    assert len(back) == len(edge_rows)
    for r in back:
        assert bytes(r["decoded"]).decode() == (r["text"] or "") and r["n_tokens"] == len(whole(r["text"] or ""))
    assert bpe.digests(no_docs).count() == 0
    none = spark.createDataFrame([(1, None)], "id long, ids binary")
    assert bytes(bpe.decode(none).first()["decoded"]) == b""


# I-Match


def check_edited(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", (rows[(k + 1) % len(rows)][1] or "")
        m = len(t) // 2
        want.append((i, len(t), sha(t[: len(t) - m] + n[:m])))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(want, key=key) == sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=key)


def test_imatch_documents(spark, sf_dir, documents):
    got = QUERIES["op4_imatch"](spark, sf_dir).collect()
    check_edited(documents, got)
    text = dict(documents)
    of_text = {}
    for r in got:
        assert of_text.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.7


def test_imatch_edges(edge_docs, edge_rows, no_docs):
    got = imatch.edited_fingerprints(edge_docs).collect()
    check_edited(edge_rows, got)
    assert imatch.edited_fingerprints(no_docs).count() == 0
    one = imatch.edited_fingerprints(edge_docs.filter("doc_id = 7")).collect()
    check_edited([r for r in edge_rows if r[0] == 7], one)
    assert one[0]["near_next"] == 1.0


def test_imatch_lexicon(spark):
    docs = spark.createDataFrame([(f"every w{i % 50} only{i}",) for i in range(1000)], "text string")
    words = WordHashes()
    lex = imatch.lexicon(docs, (0.01, 0.1))
    assert sorted(lex.tolist()) == sorted(words[f"w{i}"] for i in range(50))
    a, b = imatch.fingerprint("x w1 w2 w3 w4", words, lex), imatch.fingerprint("w4 y w3 w2. W1!", words, lex)
    assert (a == b).all() and imatch.likeness(a, b) == 1


# Line dedup


def kept_lines(rows, shortest=20, documents=3):
    space = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(space).translate(low)
    held = {}
    no = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(no(i))
    gone = {k: max(v) for k, v in held.items() if len(k) >= shortest and len(v) >= documents}
    return ["\n".join(x for x in (t or "").split("\n") if gone.get(key(x), no(i)) == no(i)) for i, t in rows]


def check_lines(docs, rows):
    cut = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    want = [(i, k, (t or "").count("\n") + 1) for (i, t), k in zip(rows, kept_lines(rows))]
    got = [(r["doc_id"], r["text"] or "", r["n_lines"]) for r in cut]
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(want, key=key) == sorted(got, key=key)


def test_line_dedup(spark, edge_docs, edge_rows, no_docs):
    check_lines(edge_docs, edge_rows)
    rng = random.Random(2)
    common = [f"A common line, Number {i} ÀÖ" for i in range(12)] + ["short", ""]
    rows = [(rng.choice([None, *range(40)]), "\n".join(rng.choice([" ", "", "\t"]) + rng.choice(common).upper() if rng.random() < 0.5 else rng.choice(common) for _ in range(rng.randint(0, 9)))) for _ in range(120)]
    rows += [(99, "The hottest line of all is here\n" * 3000), *[(100 + i, "the hottest line of ALL is here") for i in range(500)]]
    check_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    assert linededup.keep_bitmaps(no_docs).count() == 0
    assert linededup.apply_bitmaps(no_docs, linededup.keep_bitmaps(no_docs)).count() == 0


def test_line_dedup_without_hot_path(spark, monkeypatch):
    """The range-partitioned path alone gives the same as with hot keys apart."""
    rows = [(i, f"line number {i % 7} is common to all\nline number {i} is of its own kind") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(linededup, "HOT", 1)
    check_lines(docs, rows)


# URLs


def test_urls(spark):
    pages = [(1, "http://A.Example.NET/en/x"), (2, "http://example.net/de/"), (3, "ftp://x.example.com/de/y?z"), (4, "http://z.org/fr/"), (5, None), (6, "no scheme"),
             (7, "http://bad.com?x://y/"), (8, "http://badexample.net/en/"), (9, "http://net/"), (10, "http://net"), (5, None), (None, "http://q.com/#a")]
    pages += [(1000 + i, f"http://spam.com/{i}") for i in range(60)] + [(2000 + i, f"http://h{i}.fine.com/") for i in range(200)]
    labels = [(1000 + i, 1, 1) for i in range(55)] + [(2000 + i, 1, 0) for i in range(200)] + [(2000, None, None), (None, 0, 1)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, host string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, lab).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3] == ("x.example.com", "/de/y", "example.com/de/", "block")
    assert got[4] == ("z.org", "/fr/", "org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("bad.com", "", None, "allow")
    assert got[8] == ("badexample.net", "/en/", "net/", "block")
    assert got[9][2:] == ("net/", "block") and got[10] == ("net", "", None, "allow")
    assert got[1059][3] == "block" and got[2000][3] == "allow" and got[None] == ("q.com", "/", None, "allow")
    assert urls.judge(df, lab).count() == len(pages)
    assert urls.judge(df, lab.limit(0)).filter("page_id = 1000").first()["verdict"] == "allow"
    assert urls.judge(df.limit(0), lab).count() == 0


def test_urls_without_labels(spark):
    """Hosts without outcomes are judged by their domain, else their suffix, else by all."""
    bad = [(i, f"http://a{i % 20}.bad.com/{i}") for i in range(2000)] + [(3000 + i, f"http://b{i}.vile{i}.zz/") for i in range(500)]
    good = [(5000 + i, f"http://c{i % 20}.good.com/{i}") for i in range(2000)] + [(8000 + i, f"http://d{i}.fine{i}.org/") for i in range(900)]
    new = [(1, "http://new.bad.com/"), (2, "http://new.good.com/"), (3, "http://new.zz/"), (4, "http://x.new.nn/"), (5, "http://deep.new.zz/"), (6, None)]
    pages = bad + good + [(10_000 + i, u) for i, u in new]
    labels = [(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good]
    df, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"] - 10_000: r for r in urls.judge(df, lab).filter("page_id > 10000").collect()}
    assert [got[i]["verdict"] for i in range(1, 7)] == ["block", "allow", "block", "allow", "block", "allow"]
    assert got[1]["reputation"] > 0.95 and got[2]["reputation"] < 0.05 and got[6]["reputation"] is None
    assert abs(got[4]["reputation"] - (2500.5 / 5401)) < 1e-9


def judged_by_sql(pages, labels):
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [p for p, _ in pages], "url": [u for _, u in pages]}))
    con.register("labels", pa.table({c: [r[i] for r in labels] for i, c in enumerate(("doc_id", "quality", "toxic"))}))
    return sorted(con.execute(urls.OP10_SQL).fetchall(), key=str)


def test_urls_sql_on_hosts_without_labels(spark):
    """Query and SQL agree where hosts, domains or suffixes have no outcomes, and on ports and addresses."""
    rng = random.Random(4)
    tails = ["bad.com", "good.com", "mixed.co.uk", "vile.zz", "fine.org", "shop.com.au", "new.nn", "co.uk", "lone"]
    share = {"bad.com": 0.95, "vile.zz": 0.9, "mixed.co.uk": 0.5, "shop.com.au": 0.7}
    pages, labels = [], []
    for i in range(1500):
        tail = rng.choice(tails)
        host = rng.choice(["", "a.", f"b{rng.randrange(30)}.", "u:p@c."]) + tail + rng.choice(["", "", ":80", ":"])
        if i % 11 == 0:
            host, tail = f"10.0.0.{rng.randrange(9)}" + rng.choice(["", ":8080"]), "10"
        pages.append((i, f"http://{host}/{i}"))
        if tail not in ("new.nn", "lone") and rng.random() < 0.6:
            labels.append((i, 1, int(rng.random() < share.get(tail, 0.05))))
    pages += [(9001, "http://fresh.bad.com/"), (9002, "http://other.zz/"), (9003, "http://[::1]:80/"), (9004, "http:///"), (9005, None)]
    df, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.judge(df, lab).drop("reputation").collect()
    assert sorted(map(tuple, got), key=str) == judged_by_sql(pages, labels)
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert verdict[9001] == verdict[9002] == "block" and verdict[9005] == "allow"


def test_urls_suffix_table(spark):
    hosts = ["a.b.city.kawasaki.jp", "x.co.uk", "co.uk", "u@w.x.com:81", "1.2.3.4:5", "[::1]", "one", "a.b.c"]
    table = spark.createDataFrame([("city.kawasaki.jp", 1), ("kawasaki.jp", 2), ("Co.uk", 3), ("co.uk", 4)], "suffix string, n int")
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in urls.domain_and_suffix(df, table).collect()}
    assert [got[h] for h in hosts] == [
        ("b.city.kawasaki.jp", "city.kawasaki.jp"), ("x.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.com", "com"), ("1.2.3.4", ""),
        ("[::1]", ""), ("one", "one"), ("b.c", "c"),
    ]
    assert urls.domain_and_suffix(df.limit(0)).count() == 0


# Byte-level BPE in one pass


def test_bpe_round_trip(spark, edge_docs, edge_rows):
    """Encoding and decoding in one pass give what one after the other gives, with one Python step in the plan."""
    once = bpe.round_trip(edge_docs.select("doc_id", "text"))
    twice = bpe.decode(bpe.encode(edge_docs.select("doc_id", "text")))
    rows = lambda df: sorted((str(r["doc_id"]), bytes(r["ids"]), r["n_tokens"], bytes(r["decoded"])) for r in df.collect())
    assert rows(once) == rows(twice) and len(edge_rows) == once.count()
    plan = bpe.digests(edge_docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
