from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seedloom.operators import corpus as co
from seedloom.operators import probes as pb
from seedloom.operators.ordered import ordered_scan, row_index
from seedloom.operators import retrieval as rt
from seedloom.plans.catalog.corpus import CHUNKS, lengths
from seedloom.plans.registry import query
from seedloom.session import scratch_path


def sides(t):
    e = t.embeddings
    return e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding")


KNN = """SELECT query_id, item_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= {k}"""


@query("j08_knn_join", "query_id:l item_id:l score:d rank:l", KNN.format(k=5))
def _(t):
    return rt.knn_join(*sides(t), 5)


@query("j09_knn_join_ivf", "query_id:l item_id:l score:d rank:l")
def _(t):
    return rt.knn_join_ivf(*sides(t), 5, n_lists=8, nprobe=4)


@query("j09_knn_ivf_all_lists", "query_id:l item_id:l score:d rank:l", KNN.format(k=3))
def _(t):
    return rt.knn_join_ivf(*sides(t), 3, n_lists=4, nprobe=4)


@query(
    "j10_drop_same_document",
    "query_id:l neighbours:al",
    f"""WITH n AS ({KNN.format(k=8)}), k AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS j FROM n WHERE query_id // 10 <> item_id // 10)
        SELECT q.query_id, list_resize(coalesce(l, []), 4, -1) AS neighbours FROM (SELECT DISTINCT query_id FROM n) q LEFT JOIN (SELECT query_id, list(item_id ORDER BY j) AS l FROM k WHERE j <= 4 GROUP BY 1) USING (query_id)""",
)
def _(t):
    pairs = rt.knn_join(*sides(t), 8)
    docs = t.embeddings.select(F.col("vec_id").alias("item_id"), F.floor(F.col("vec_id") / 10).alias("doc_id"))
    return rt.drop_same_document(pairs, docs.withColumnRenamed("item_id", "query_id"), docs, 4)


@query(
    "j11_neighbour_continuation",
    "item_id:l step:l chunk_id:l tokens:al",
    f"""WITH c AS (SELECT tokens, row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS chunk_id FROM {CHUNKS}), n AS (SELECT item_id, step, (item_id + step) % (SELECT count(*) FROM c) AS chunk_id FROM (SELECT chunk_id AS item_id, unnest([0, 1]) AS step FROM c))
        SELECT n.item_id, n.step, n.chunk_id, tokens FROM n JOIN c USING (chunk_id)""",
)
def _(t):
    chunks = co.number_chunks(co.chunk_documents(lengths(t), 64))
    near = chunks.select(F.col("chunk_id").alias("item_id"))
    return rt.neighbour_continuation(near, chunks, 1)


@query(
    "t04_top_similar",
    "query_id:l item_id:l place:l",
    f"""WITH n AS ({KNN.format(k=20)}), b AS (SELECT query_id, item_id, score FROM (SELECT n.*, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, item_id) AS k FROM n JOIN embeddings ON vec_id = item_id) WHERE k = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS k FROM b)
        SELECT query_id, item_id, count(*) OVER (PARTITION BY query_id) - k + 1 AS place FROM r WHERE k <= 3""",
)
def _(t):
    pairs = rt.knn_join(*sides(t), 20).join(t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("label").alias("topic")), "item_id")
    return rt.top_similar(pairs, 3, "topic", one_per_topic=True)


def _letter_model():
    """A stand-in embedder: letter shares of a text, doubled for the second layer."""

    def run(texts):
        base = np.array([[s.count(c) / max(1, len(s)) for c in "acgtnes"] for s in texts], dtype="float32")
        return np.stack([base, base * 2])

    return run


SHARES = "list_transform(['a', 'c', 'g', 't', 'n', 'e', 's'], lambda c: CAST((length(text) - length(replace(text, c, ''))) / CAST(greatest(1, length(text)) AS DOUBLE) AS FLOAT))"


@query("m01_embed", "item_id:l layer:l embedding:ad", f"SELECT doc_id AS item_id, layer, list_transform({SHARES}, lambda v: v * CAST(layer + 1 AS FLOAT)) AS embedding FROM documents, (SELECT unnest([0, 1]) AS layer)")
def _(t):
    return pb.embed(t.documents, _letter_model, [0, 1], "text", "doc_id", size=pb.batch_size(64, 4000))


@query("m06_build_vector_table", "item_id:l n:l", "SELECT doc_id AS item_id, 7 AS n FROM documents")
def _(t):
    parts = [pb.embed(t.documents.filter(F.col("doc_id") % 2 == k), _letter_model, [0], "text", "doc_id") for k in (0, 1)]
    return pb.build_vector_table(parts).select("item_id", F.size("embedding").alias("n"))


def splits(t):
    d = t.labels.join(t.documents, "doc_id")
    e = pb.embed(d, _letter_model, [0, 1], "text", "doc_id").join(d.select(F.col("doc_id").alias("item_id"), F.col("quality").alias("label"), "toxic", "n_chars"), "item_id")
    return e.withColumn("split", F.when(F.col("item_id") % 3 == 0, "test").otherwise("train"))


METRIC_ROW = "accuracy:d roc_auc:d precision:d recall:d f1:d mcc:d"


def train_test(t):
    one = splits(t).filter("layer = 0")
    return one.filter("split = 'train'"), one.filter("split = 'test'")


@query("m02_probe_random_forest", METRIC_ROW)
def _(t):
    return pb.probe_random_forest(*train_test(t))


@query("m03_probe_boosted", METRIC_ROW)
def _(t):
    return pb.probe_boosted(*train_test(t), rounds=5, depth=4)


def by_language(t):
    """Both layers; the class is the language, the figure the length of the text."""
    d = t.documents.select("doc_id", "lang", "n_chars", "text")
    kinds = d.filter("lang is not null").select("lang").distinct()
    number = ordered_scan(kinds, None, "lang", label=row_index()).withColumn("label", F.col("label") - 1)
    rows = pb.embed(d, _letter_model, [0, 1], "text", "doc_id")
    rows = rows.join(d.join(number, "lang").select(F.col("doc_id").alias("item_id"), "label", F.log1p("n_chars").alias("size")), "item_id")
    return rows.filter("item_id % 3 <> 0"), rows.filter("item_id % 3 = 0"), kinds.count()


@query("m03_boosted_classes", METRIC_ROW)
def _(t):
    train, test, n = by_language(t)
    return pb.probe_boosted(train, test, n_classes=n, rounds=10, depth=4)


@query("m03_boosted_regression", "n:l mae:d rmse:d r2:d")
def _(t):
    train, test, _ = by_language(t)
    return pb.probe_boosted(train, test, label="size", rounds=10, depth=4, task="regression")


@query("m04_robust_regression", "n:l mae:d rmse:d r2:d")
def _(t):
    train, test, _ = by_language(t)
    return pb.probe_linear(train, test, label="size")


@query("m04_probe_mlp", METRIC_ROW)
def _(t):
    return pb.probe_mlp(*train_test(t), iterations=100)


@query("m05_evaluate_layers", "task:s layer:l " + METRIC_ROW)
def _(t):
    return pb.evaluate_layers(splits(t), None, "quality", lambda a, b: pb.probe_random_forest(a, b))


@query(
    "st2_interval_report",
    "begins:s step:s calls:l min_time:d min_rank:l max_time:d max_rank:l",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS begins, event_type AS step, count(*) AS calls, min(value) AS min_time, arg_min(user_id % 8, (value, user_id % 8)) AS min_rank, max(value) AS max_time, arg_max(user_id % 8, (value, -(user_id % 8))) AS max_rank
       FROM events GROUP BY 1, 2""",
)
def _(t):
    from seedloom.streaming.timing import interval_report

    # Append mode: an interval is written once, when the watermark has passed its end. The last ones
    # close when a beat arrives whose time lies beyond all of them; it has no step and stays open itself.
    spark = t.spark
    out, check, beats = (scratch_path(spark, n) for n in ("report", "report-state", "report-beats"))
    shape = "ts timestamp, step string, rank long, duration double"
    spark.createDataFrame([], shape).write.parquet(beats)

    def run():
        source = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
        rows = source.select(F.col("ts").cast("timestamp"), F.col("event_type").alias("step"), (F.col("user_id") % 8).alias("rank"), F.col("value").alias("duration"))
        rows = rows.unionByName(spark.readStream.schema(shape).parquet(beats))

        def keep(batch, epoch):
            # A batch that is run again replaces its own rows.
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        sink = interval_report(rows).writeStream.outputMode("append").option("checkpointLocation", check).foreachBatch(keep)
        sink.trigger(availableNow=True).start().awaitTermination()

    run()
    last = t.events.agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    last.selectExpr("ts", "cast(null as string) step", "cast(null as long) rank", "cast(null as double) duration").write.mode("append").parquet(beats)
    run()
    return spark.read.parquet(out).withColumn("begins", F.date_format("begins", "yyyy-MM-dd HH:mm:ss"))


@query(
    "st1_ingest_corpus",
    "doc_id:l length:l",
    "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) + 1 AS length FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 0",
)
def _(t):
    from seedloom.streaming.ingest import ingest_corpus

    spark = t.spark
    inbox, out, check = (scratch_path(spark, n) for n in ("inbox", "tokens", "tokens-state"))

    def prepare(rows):
        ids = F.filter(F.split("text", r"\s+"), lambda w: w != "")
        ids = F.transform(ids, lambda w: F.length(w))
        return rows.select("doc_id", F.concat(ids, F.array(F.lit(0))).alias("tokens")).filter(F.size("tokens") > 1).withColumn("length", F.size("tokens"))

    # two arrivals, two runs: the second run sees only the new files
    for k in (0, 1):
        t.documents.filter(F.col("doc_id") % 2 == k).select("doc_id", "text").write.mode("append").json(inbox)
        ingest_corpus(spark, inbox, "doc_id long, text string", out, check, prepare).awaitTermination()
    return spark.read.parquet(out)
