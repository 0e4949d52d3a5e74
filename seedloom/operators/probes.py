"""Embedding jobs and MLlib probes on stored embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.operators import metrics as mt
from seedloom.operators.sets import merge_unique, upsert


def batch_size(base: int, max_length: int, n_seq: int = 1, long: int = 8192, very_long: int = 100_000) -> int:
    """Halved for long sequences, 1 for very long ones, shared by the sequences of an item."""
    if max_length >= very_long:
        return 1
    return max(1, (base // 2 if max_length >= long else base) // n_seq)


def embed(df: DataFrame, make_model: Callable[[], Callable[[list], np.ndarray]], layers: list[int], col: str = "sequence", key: str = "item_id", size: int = 64, done: DataFrame | None = None) -> DataFrame:
    """(item_id, layer, embedding) from a pluggable model, loaded once per Python worker task.

    The model maps a list of texts to an array layers x items x dims. ``done`` has the
    (item_id, layer) rows already written; only items that lack a layer are computed.
    """
    rows = df.select(F.col(key).alias("item_id"), F.col(col).alias("_x"))
    if done is not None:
        full = done.filter(F.col("layer").isin(*layers)).groupBy("item_id").agg(F.count_distinct("layer").alias("_n"))
        rows = rows.join(full.filter(F.col("_n") == len(layers)).select("item_id"), "item_id", "left_anti")
    # neighbours of similar length share a batch, so padding stays small
    rows = rows.sortWithinPartitions(F.length("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            # texts are Python strings one model batch at a time
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                out = model(part.column("_x").to_pylist())
                ids = part.column("item_id").cast(pa.int64())
                for i, layer in enumerate(layers):
                    vectors = pa.array([v.astype("float32") for v in out[i]], pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([layer] * len(ids), pa.int32()), vectors], ["item_id", "layer", "embedding"])

    return rows.mapInArrow(run, "item_id long, layer int, embedding array<float>")


def build_vector_table(shards: list[DataFrame]) -> DataFrame:
    """Vector shards merged into one (item_id, embedding FLOAT) table with unique ids."""
    return merge_unique([s.select("item_id", F.transform("embedding", lambda v: v.cast("float")).alias("embedding")) for s in shards], "item_id")


def _features(df: DataFrame, vec: str, label: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    extra = [c for c in ("item_id",) if c in df.columns]
    return df.select(*extra, array_to_vector(F.transform(vec, lambda v: v.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))


def _scored(model, test: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(test)
    scores = vector_to_array("probability") if "probability" in out.columns else F.array(F.lit(0.0), F.col("prediction"))
    return out.select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"), scores.alias("scores"))


def _classify(estimator, train, test, vec, label, n_classes) -> DataFrame:
    model = estimator.fit(_features(train, vec, label))
    return mt.classification_metrics(_scored(model, _features(test, vec, label)), n_classes=n_classes)


def probe_random_forest(train: DataFrame, test: DataFrame, vec: str = "embedding", label: str = "label", n_classes: int = 2, seed: int = 42, trees: int = 100) -> DataFrame:
    """Random forest trained on one split and scored on the test split (one metric row)."""
    from pyspark.ml.classification import RandomForestClassifier

    return _classify(RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=8), train, test, vec, label, n_classes)


def probe_boosted(train: DataFrame, test: DataFrame, vec: str = "embedding", label: str = "label", n_classes: int = 2, seed: int = 42, rounds: int = 100, lr: float = 0.1, depth: int = 6, task: str = "classification") -> DataFrame:
    """Boosted trees. Several classes have a model each, one against the rest; their probabilities, taken
    from the margins and scaled to a sum of one, are the scores, and the greatest margin is the class.
    For regression the trees are boosted on squared errors.
    """
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.functions import vector_to_array

    if task == "regression":
        from pyspark.ml.regression import GBTRegressor

        return _regress(GBTRegressor(maxIter=rounds, stepSize=lr, maxDepth=depth, seed=seed), train, test, vec, label)
    gbt = GBTClassifier(maxIter=rounds, stepSize=lr, maxDepth=depth, seed=seed)
    if n_classes == 2:
        return _classify(gbt, train, test, vec, label, 2)
    out = _features(test, vec, label)
    models = OneVsRest(classifier=gbt).fit(_features(train, vec, label)).models
    for i, model in enumerate(models):
        model = model.copy({model.predictionCol: f"_c{i}", model.rawPredictionCol: f"_m{i}", model.probabilityCol: f"_p{i}"})
        out = model.transform(out).withColumns({f"_m{i}": vector_to_array(f"_m{i}")[1], f"_p{i}": vector_to_array(f"_p{i}")[1]})
    # A class that no row of the training split has keeps the score 0.
    rest = [F.lit(0.0)] * (n_classes - len(models))
    margins = F.array(*[f"_m{i}" for i in range(len(models))])
    total = sum((F.col(f"_p{i}") for i in range(1, len(models))), F.col("_p0"))
    scores = F.array(*[F.col(f"_p{i}") / total for i in range(len(models))], *rest)
    pred = (F.array_position(margins, F.array_max(margins)) - 1).cast("int")
    return mt.classification_metrics(out.select(F.col("label").cast("int").alias("label"), pred.alias("pred"), scores.alias("scores")), n_classes=n_classes)


def probe_linear(train: DataFrame, test: DataFrame, vec: str = "embedding", label: str = "label", robust: bool = True, ridge: float = 0.0, iterations: int = 100) -> DataFrame:
    """Linear regression; ``robust`` weighs large errors by their size, not its square (Huber)."""
    from pyspark.ml.regression import LinearRegression

    return _regress(LinearRegression(loss="huber" if robust else "squaredError", regParam=ridge, maxIter=iterations), train, test, vec, label)


def _regress(estimator, train, test, vec, label) -> DataFrame:
    out = estimator.fit(_features(train, vec, label)).transform(_features(test, vec, label))
    return mt.regression_metrics(out.select(F.col("prediction").alias("pred"), F.col("label").alias("truth")))


def hidden_widths(d: int) -> list[int]:
    return [max(2, d // 2), max(2, d // 4), max(2, min(d // 8, 128))]


def probe_mlp(train: DataFrame, test: DataFrame, vec: str = "embedding", label: str = "label", task: str = "classification", n_classes: int = 2, seed: int = 42, iterations: int = 100) -> DataFrame:
    """Layered perceptron probe; one binary model per label, boosted trees for regression.

    MLlib has neither dropout nor Adam, so the floor of the metrics is checked, not their value.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    d = len(train.select(vec).first()[0])
    net = lambda n: MultilayerPerceptronClassifier(layers=[d, *hidden_widths(d), n], maxIter=iterations, seed=seed)
    if task == "classification":
        return _classify(net(n_classes), train, test, vec, label, n_classes)
    if task == "multilabel":
        from pyspark.ml.functions import vector_to_array

        n = len(train.select(label).first()[0])
        rows = test.withColumn("item_id", F.col("item_id"))
        joined = None
        for j in range(n):
            model = net(2).fit(_features(train.withColumn("_y", F.col(label)[j]), vec, "_y"))
            one = model.transform(_features(rows.withColumn("_y", F.col(label)[j]), vec, "_y"))
            one = one.select("item_id", F.col("label").cast("int").alias(f"t{j}"), F.col("prediction").cast("int").alias(f"p{j}"), vector_to_array("probability")[1].alias(f"s{j}"))
            joined = one if joined is None else joined.join(one, "item_id")
        packed = joined.select(*[F.array(*[F.col(f"{c}{j}") for j in range(n)]).alias(k) for c, k in (("t", "labels"), ("p", "preds"), ("s", "scores"))])
        return mt.multilabel_metrics(packed)
    if task == "regression":
        return probe_boosted(train, test, vec, label, seed=seed, rounds=iterations, task="regression")
    raise ValueError(task)


def evaluate_layers(data: DataFrame, results: DataFrame | None, task: str, probe: Callable[[DataFrame, DataFrame], DataFrame], split: str = "split") -> DataFrame:
    """Probe every (task, layer) without a complete result row and upsert the new rows.

    ``data`` has (layer, split, embedding, label). A missing eval or test split falls back on
    the other one.
    """
    layers = sorted(r["layer"] for r in data.select("layer").distinct().collect())
    done = set()
    if results is not None:
        full = results.filter(F.col("task") == task).dropna()
        done = {r["layer"] for r in full.select("layer").distinct().collect()}
    out = results
    for layer in layers:
        if layer in done:
            continue
        rows = data.filter(F.col("layer") == layer)
        names = {r[split] for r in rows.select(split).distinct().collect()}
        held = "test" if "test" in names else "eval"
        scored = probe(rows.filter(F.col(split) == "train"), rows.filter(F.col(split) == held))
        row = scored.select(F.lit(task).alias("task"), F.lit(layer).alias("layer"), "*")
        out = row if out is None else upsert(out, row, ["task", "layer"])
    return out
