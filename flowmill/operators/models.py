"""Training, scoring, importance and tuning of classifiers, on pyspark.ml and by softmax boosting; isolation forests with NumPy trees in tasks.

Inputs are always cleaned first: numbers out of text, infinities and missing values to 0 for trees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from hashlib import sha256
from itertools import product
from threading import Lock
from time import time
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.expr import finite_or_zero, number_of
from flowmill.operators.boosting import Binned, SoftmaxBooster, SoftmaxModel
from flowmill.operators.evaluate import class_report, confusion, macro_average, macro_f1_by, named_prediction
from flowmill.operators.sampling import folds, label_codes, map_labels, rank_by_hash
from flowmill.operators.schema import forbid_columns, normalize_columns, require_columns
from flowmill.storage import cut, shared_dir

PREFIX = "__feature_"

#: Labels that a model may have; a column of more isn't one, and is an error.
MAX_CLASSES = 10_000


class Trained(NamedTuple):
    """A fitted model, its features in order, and the labels by code."""

    model: object
    features: list[str]
    labels: list[str]


def encode_text(df: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Text columns as the place of their value in sorted order (missing as ''), and ``label, code`` of each column. Values
    are numbered in sorted parts where they are many, and joined to the rows.
    """
    codes: dict[str, DataFrame] = {}
    order = df.columns
    for n in columns:
        df = df.withColumn(n, F.coalesce(F.col(f"`{n}`"), F.lit("")))
        codes[n] = cut(label_codes(df, n))
        df = map_labels(df, n, codes[n], name="__code").withColumn(n, F.col("__code").cast("double")).drop("__code")
    return df.select(*[F.col(f"`{c}`") for c in order]), codes


def assemble(df: DataFrame, features: list[str], keep: Iterable[str | Column] = (), *, name: str = "features") -> DataFrame:
    """``keep`` and a vector of the features, cleaned."""
    clean = df.select(*keep, *[finite_or_zero(number_of(df, n)).alias(f"{PREFIX}{k}") for k, n in enumerate(features)])
    made = VectorAssembler(inputCols=[f"{PREFIX}{k}" for k in range(len(features))], outputCol=name).transform(clean)
    return made.drop(*[f"{PREFIX}{k}" for k in range(len(features))])


def prepare(df: DataFrame, label: str, features: list[str], keep: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """(``keep``, code, features) of the labelled rows, and the labels by code."""
    codes = label_codes(df, label)
    labels = [r["label"] for r in codes.orderBy("code").limit(MAX_CLASSES + 1).collect()]  # classes, not rows
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    coded = map_labels(df.where(F.col(label).isNotNull()), label, codes, name="__code")
    rows = assemble(coded, features, [*keep, F.col("__code").cast("double").alias("code")])
    return rows, [str(x) for x in labels]


def without_summary(model):
    """A fitted forest without its training summary: that of two classes holds the session, which can't be sent to tasks once
    something in it is observed (a copy has no summary).
    """
    return model.copy() if isinstance(model, RandomForestClassificationModel) else model


def train_forest(df: DataFrame, label: str, features: list[str], *, trees: int = 100, depth: int = 20, subset: str = "sqrt", least: int = 1, seed: int = 42, max_bins: int = 64, max_rows: int | None = None, key: list[str] | None = None) -> Trained:
    """A random forest of Gini trees; with ``max_rows``, on the rows whose ``key`` (columns that tell rows apart) hashes lowest."""
    if max_rows is not None:
        if not key:
            raise ValueError("a sample of rows needs a key that tells them apart")
        df = rank_by_hash(df, [], key, seed=seed, name="__place", most=max_rows).drop("__place")
    rows, labels = prepare(df, label, features)
    model = RandomForestClassifier(labelCol="code", numTrees=trees, maxDepth=min(depth, 30), featureSubsetStrategy=subset, minInstancesPerNode=least, seed=seed, maxBins=max_bins, impurity="gini").fit(rows)
    return Trained(without_summary(model), features, labels)


def train_boosting(df: DataFrame, label: str, features: list[str], *, rounds: int = 100, depth: int = 6, rate: float = 0.3, subsample: float = 1.0, seed: int = 42, max_bins: int = 64) -> Trained:
    """Gradient boosted trees: Spark's for two labels, of all classes at once by softmax for more (:mod:`flowmill.operators.boosting`)."""
    rows, labels = prepare(df, label, features)
    if len(labels) <= 2:
        return Trained(GBTClassifier(labelCol="code", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, maxBins=max_bins).fit(rows), features, labels)
    return Trained(SoftmaxBooster(rounds=rounds, depth=depth, rate=rate, subsample=subsample, seed=seed, bins=max_bins).fit(rows), features, labels)


def score(trained: Trained, df: DataFrame, keep: list[str | Column] | tuple = ()) -> DataFrame:
    """``keep``, ``code``, ``predicted_label`` and ``confidence`` of every row: the winning label's probability."""
    rows = trained.model.transform(assemble(df, trained.features, keep))
    keep = [c for c in rows.columns if c not in ("features", "rawPrediction", "probability", "prediction")][: len(keep)]
    names = F.array(*map(F.lit, trained.labels))
    chance = F.col("probability") if isinstance(trained.model, SoftmaxModel) else vector_to_array("probability")
    return rows.select(*keep, F.col("prediction").cast("int").alias("code"), F.get(names, F.col("prediction").cast("int")).alias("predicted_label"), F.array_max(chance).alias("confidence"))


def score_live(trained: Trained, df: DataFrame, *, aliases: dict[str, str] | None = None, leaks: Iterable[str] = ("label",), least: float = 0.60, keep: Iterable[str] = ()) -> DataFrame:
    """Scores of a capture: names are normalised (repeats are an error), a label or a missing feature is an error, low
    confidence gives the unknown class. Adds IDS_Prediction and IDS_Confidence to ``keep``. Works on streams, too.
    """
    rows = forbid_columns(normalize_columns(df, aliases), leaks)
    require_columns(rows, trained.features)
    scored = score(trained, rows, keep)
    name = named_prediction(F.col("code"), F.col("confidence"), dict(enumerate(trained.labels)), least=least)
    return scored.select(*keep, name.alias("IDS_Prediction"), F.col("confidence").alias("IDS_Confidence"))


def save(trained: Trained, spark, path: str) -> None:
    """The model, and its features and labels as JSON lines beside it. Never overwrites."""
    boosted = isinstance(trained.model, SoftmaxModel)
    if boosted:
        trained.model.table(spark).write.parquet(f"{path}/nodes")
    else:
        PipelineModel([trained.model]).write().save(f"{path}/model")
    spark.createDataFrame([(trained.features, trained.labels, boosted)], "features array<string>, labels array<string>, boosted boolean").coalesce(1).write.json(f"{path}/names")


def load(spark, path: str) -> Trained:
    names = spark.read.schema("features array<string>, labels array<string>, boosted boolean").json(f"{path}/names").first()
    features, labels = list(names["features"]), list(names["labels"])
    model = SoftmaxModel.of_table(spark.read.parquet(f"{path}/nodes"), len(labels), len(features)) if names["boosted"] else PipelineModel.load(f"{path}/model").stages[0]
    return Trained(model, features, labels)


# Importance


def importance(trained: Trained, spark, *, label: str | None = None) -> DataFrame:
    """``feature, percent`` of all importance, highest first; with ``label``, in the trees of this class (of a softmax model)."""
    if isinstance(trained.model, SoftmaxModel):
        mean = trained.model.gains(None if label is None else trained.labels.index(label))
    elif label is None:
        mean = trained.model.featureImportances.toArray()
    else:
        raise ValueError("only a model of all classes at once has importances by label")
    share = 100 * mean / mean.sum() if mean.sum() else mean
    return spark.createDataFrame([(f, float(x)) for f, x in zip(trained.features, share, strict=True)], "feature string, percent double").orderBy(F.desc("percent"), "feature")


def importance_by_label(df: DataFrame, label: str, features: list[str], *, top: int = 10, rounds: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """``label, feature, percent, place``: the strongest features of each label's trees, all from one model of all classes at once."""
    spark = df.sparkSession
    rows, labels = prepare(df, label, features)
    trained = Trained(SoftmaxBooster(rounds=rounds, depth=depth, seed=seed).fit(rows), features, labels)
    out = []
    for x in labels:
        found = importance(trained, spark, label=x).limit(top).collect()
        out += [(x, r["feature"], r["percent"], k) for k, r in enumerate(found, 1)]
    return spark.createDataFrame(out, "label string, feature string, percent double, place int")


def weak_features(importances: DataFrame, least: float) -> list[str]:
    """Features of under ``least`` percent; features are few."""
    return sorted(r["feature"] for r in importances.where(F.col("percent") < least).select("feature").collect())


# Tuning


class MacroF1(Evaluator):
    """The unweighted mean of the classes' F1, 0 where a divisor is 0 (Spark's own f1 weighs by support)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        row = macro_average(class_report(confusion(dataset, "code", "prediction"))).first()
        return float(row["f1"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def grid(**values: Iterable) -> list[dict]:
    """Every combination of the values."""
    return [dict(zip(values, x, strict=True)) for x in product(*values.values())]


#: Options whose smaller values are the beginning of an ensemble of a larger one.
SIZES = ("trees", "rounds")


def first_part(model, size: int):
    """The first ``size`` trees or rounds of a fitted ensemble, as a model."""
    if isinstance(model, SoftmaxModel):
        return model.first(size)
    jvm, java = SparkContext._active_spark_context._jvm, model._java_obj
    if isinstance(model, RandomForestClassificationModel):
        kind, made = jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, jvm.org.apache.spark.ml.classification.RandomForestClassificationModel
    elif isinstance(model, GBTClassificationModel):
        kind, made = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, jvm.org.apache.spark.ml.classification.GBTClassificationModel
    else:
        raise ValueError(f"{type(model).__name__} has no first part")
    gateway, trees = SparkContext._active_spark_context._gateway, java.trees()
    part = gateway.new_array(kind, size)
    for k in range(size):
        part[k] = trees[k]
    if isinstance(model, GBTClassificationModel):
        weights = gateway.new_array(gateway.jvm.double, size)
        for k, w in enumerate(model.treeWeights[:size]):
            weights[k] = float(w)
        return GBTClassificationModel(made(java.uid(), part, weights, java.numFeatures(), 2))
    return RandomForestClassificationModel(made(java.uid(), part, java.numFeatures(), java.numClasses()))


def tune(df: DataFrame, label: str, features: list[str], options: list[dict], make, key: list[str], *, k: int = 3, seed: int = 42, folder: str | None = None, parallel: int = 4) -> DataFrame:
    """``combination, fold, f1, seconds``: macro-F1 of each combination on each stratified fold, and how long its fit took.

    ``make`` gives an estimator for a combination (label column ``code``).  Combinations that differ in ``trees`` or ``rounds`` only
    share one fit of the most of them, whose beginnings are evaluated (those of boosting in one pass, by the task that grows them if it may hold the rows; ``seconds`` is that fit's share); ``parallel`` fits run
    at once, and boosting fits of a fold share its rows in bins (not in ``seconds``).  Results are written to ``folder`` (one of its own in the shared folder, if not given) as soon as a fit is
    evaluated; what is there of the same rows, label, features, folds and seed, from a run that broke off, isn't fitted again.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/tuning-{uuid4().hex}"
    rows = cut(prepare(folds(df.where(F.col(label).isNotNull()), label, k, key, seed=seed, name="__fold"), label, features, ["__fold"])[0])
    state = rows.agg(F.count("*"), F.bit_xor(F.xxhash64("__fold", "code", vector_to_array("features")))).first()
    inputs = sha256(repr((label, features, key, k, seed, *state)).encode()).hexdigest()
    schema = "inputs string, combination string, fold int, f1 double, seconds double"
    past = set()
    if _exists(spark, folder):
        past = {(r["combination"], r["fold"]) for r in _results(spark, folder, schema).where(F.col("inputs") == inputs).select("combination", "fold").distinct().collect()}
    shared: dict[str, list[dict]] = {}
    for option in options:
        shared.setdefault(str({n: v for n, v in option.items() if n not in SIZES}), []).append(option)

    binned: dict[tuple[int, int], tuple[Binned, DataFrame | None]] = {}
    locks = [Lock() for _ in range(k)]

    def learnt_from(estimator: SoftmaxBooster, fold: int) -> tuple[Binned, DataFrame | None]:
        with locks[fold]:
            if (fold, estimator.bins) not in binned:
                learnt = estimator.binned(rows.where(F.col("__fold") != fold))
                binned[fold, estimator.bins] = learnt, estimator.held_blocks(rows.where(F.col("__fold") == fold), learnt) if estimator.fits_task(learnt) else None
            return binned[fold, estimator.bins]

    def fit(alike: list[dict], fold: int) -> None:
        todo = [x for x in alike if (str(x), fold) not in past]
        if not todo:
            return
        size = next((n for n in SIZES if n in todo[0]), None)
        largest = max(todo, key=lambda x: x.get(size, 0))
        estimator = make(largest)
        held = rows.where(F.col("__fold") == fold)
        if isinstance(estimator, SoftmaxBooster):
            learnt, held_blocks = learnt_from(estimator, fold)
            sizes, began = [x[size] if size else estimator.rounds for x in todo], time()
            if estimator.fits_task(learnt):
                said = cut(estimator.held_predictions(learnt, held_blocks, sizes))
            else:
                said = estimator.fit(learnt).beginnings(held.drop("__fold"), sizes)
            took = time() - began
            found = {r["rounds"]: r["f1"] for r in macro_f1_by(said, "rounds", "code", "prediction").collect()}  # a row a size
            scores = [float(found.get(n, 0.0)) for n in sizes]
        else:
            began = time()
            model = without_summary(estimator.fit(rows.where(F.col("__fold") != fold)))
            took = time() - began
            scores = [MacroF1().evaluate((model if x is largest or size is None else first_part(model, x[size])).transform(held)) for x in todo]
        out = [(inputs, str(x), fold, f1, took * (x[size] / largest[size] if size else 1.0)) for x, f1 in zip(todo, scores, strict=True)]
        spark.createDataFrame(out, schema).coalesce(1).write.parquet(f"{folder}/fit-{uuid4().hex}")  # one job's files can't meet another's

    # Those that take longest come first, so that none of them is left alone at the end.
    longest = sorted(shared.values(), key=lambda alike: -max(x.get("depth", 1) * max(x.get(n, 1) for n in SIZES) for x in alike))
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        for done in [pool.submit(fit, alike, fold) for alike in longest for fold in range(k)]:
            done.result()
    return _results(spark, folder, schema).where(F.col("inputs") == inputs).drop("inputs")


def _results(spark, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def _exists(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def refit_best(df: DataFrame, label: str, features: list[str], results: DataFrame, options: list[dict], make) -> tuple[Trained, dict]:
    """The best combination of :func:`tune`'s results, fitted on all labelled rows of ``df``, and that combination."""
    best = tuning_summary(results).first()["combination"]
    option = next(x for x in options if str(x) == best)
    rows, labels = prepare(df, label, features)
    return Trained(without_summary(make(option).fit(rows)), features, labels), option


def search(train: DataFrame, test: DataFrame, label: str, features: list[str], options: list[dict], make, key: list[str], **how) -> tuple[DataFrame, Trained, dict, DataFrame]:
    """The whole search: results by combination (best first), the best one refitted on all of ``train``, what it is, and its report on
    ``test`` (:func:`flowmill.operators.evaluate.class_report`).
    """
    results = cut(tune(train, label, features, options, make, key, **how))
    best, option = refit_best(train, label, features, results, options, make)
    scored = score(best, test.where(F.col(label).isNotNull()), [F.col(label).cast("string").alias("truth")])
    return tuning_summary(results), best, option, class_report(confusion(scored, "truth", "predicted_label"))


def tuning_summary(results: DataFrame) -> DataFrame:
    """``combination, mean_f1, std_f1, mean_seconds``, best first."""
    return results.groupBy("combination").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.avg("seconds").alias("mean_seconds")).orderBy(F.desc("mean_f1"), "combination")


def forest_of(option: dict, seed: int = 42) -> RandomForestClassifier:
    """A forest estimator for a tuning combination (trees, depth, least, subset)."""
    return RandomForestClassifier(labelCol="code", numTrees=option.get("trees", 100), maxDepth=min(option.get("depth", 20), 30), minInstancesPerNode=option.get("least", 1), featureSubsetStrategy=option.get("subset", "sqrt"), seed=seed)


def boosting_of(option: dict, seed: int = 42) -> SoftmaxBooster | GBTClassifier:
    """A boosting estimator for a tuning combination (rounds, depth, rate, subsample; binary: Spark's, of two classes)."""
    rounds, depth, rate, subsample = option.get("rounds", 100), option.get("depth", 5), option.get("rate", 0.1), option.get("subsample", 1.0)
    if option.get("binary"):
        return GBTClassifier(labelCol="code", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed)
    return SoftmaxBooster(rounds=rounds, depth=depth, rate=rate, subsample=subsample, seed=seed)


# Isolation forest (Liu et al., 2008)


def _path_length(n: np.ndarray | float) -> np.ndarray:
    """The mean depth of a search that fails among n rows."""
    n = np.asarray(n, "f8")
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _isolation_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, split, left, right, depth at a leaf)."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + float(_path_length(len(rows)))))
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        usable = np.flatnonzero(low < high)
        if depth < limit and len(rows) > 1 and len(usable):
            f = int(rng.choice(usable))
            split = float(rng.uniform(low[f], high[f]))
            left = x[rows, f] < split
            nodes[at] = (f, split, grow(rows[left], depth + 1), grow(rows[~left], depth + 1), 0.0)
        return at

    grow(np.arange(len(x)), 0)
    return nodes


def train_isolation_forest(df: DataFrame, features: list[str], key: list[str], *, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """``tree, size, nodes``: a row a tree, each grown by a task on a sample of ``sample`` rows drawn by hash.

    The samples are bounded: of the rows whose hashes come first, each of ``trees * sample`` (or all, in turn, if there
    are fewer) goes to one tree.
    """
    values = df.select(*key, *[finite_or_zero(number_of(df, n)).alias(f"{PREFIX}{k}") for k, n in enumerate(features)])
    drawn = cut(rank_by_hash(values, [], key, seed=seed, name="__place", most=trees * sample))
    n = drawn.count()
    x = F.array(*[f"{PREFIX}{k}" for k in range(len(features))]).alias("x")
    size = min(sample, n)
    # Tree t takes the places t * size ... (t + 1) * size - 1, counted around the rows drawn.
    turns = max(1, -(-trees * size // max(n, 1)))
    dealt = drawn.select(x, (F.col("__place") - 1).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    dealt = dealt.select("x", F.floor((F.col("p") + F.col("turn") * n) / max(size, 1)).alias("tree")).where(F.col("tree") < trees)

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = np.array(table.column("x").to_pylist(), "f8")
        rows = rows[np.lexsort(rows.T)]
        rng = np.random.default_rng([seed, int(key[0].as_py())])
        nodes = _isolation_tree(rows, rng, int(np.ceil(np.log2(max(len(rows), 2)))))
        return pa.table({"tree": [int(key[0].as_py())], "size": [len(rows)], "nodes": [[{"f": a, "split": b, "left": c, "right": d, "depth": e} for a, b, c, d, e in nodes]]}, schema=_FOREST)

    return dealt.groupBy("tree").applyInArrow(grow, "tree long, size long, nodes array<struct<f:int,split:double,left:int,right:int,depth:double>>")


_FOREST = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("nodes", pa.list_(pa.struct([("f", pa.int32()), ("split", pa.float64()), ("left", pa.int32()), ("right", pa.int32()), ("depth", pa.float64())])))])


def isolation_scores(df: DataFrame, forest: DataFrame, features: list[str], keep: Iterable[str] = (), *, threshold: float = 0.5) -> DataFrame:
    """``keep, anomaly_score, prediction``: score 2^(-mean depth / c); prediction -1 over the threshold, else 1. A forest has
    at most trees * 2 * sample nodes, so it goes to every task.
    """
    trees = [(r["size"], np.array([(a.f, a.split, a.left, a.right, a.depth) for a in r["nodes"]], "f8")) for r in forest.orderBy("tree").collect()]
    shared = df.sparkSession.sparkContext.broadcast(trees)
    keep = list(keep)
    values = df.select(*keep, F.array(*[finite_or_zero(number_of(df, n)) for n in features]).alias("__x"))
    kinds = [(f.name, f.dataType.simpleString()) for f in values.schema.fields[:-1]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        norm = float(_path_length(max((s for s, _ in own), default=2))) or 1.0
        for batch in batches:
            x = np.array(batch.column(len(kinds)).to_pylist(), "f8").reshape(batch.num_rows, -1)
            depth = np.zeros(len(x))
            for _, nodes in own:
                at = np.zeros(len(x), "i8")
                while (inner := nodes[at, 0] >= 0).any():
                    here = nodes[at[inner]]
                    left = x[inner, here[:, 0].astype("i8")] < here[:, 1]
                    at[inner] = np.where(left, here[:, 2], here[:, 3]).astype("i8")
                depth += nodes[at, 4]
            scores = 2.0 ** (-depth / max(len(own), 1) / norm)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array(np.where(scores > threshold, -1, 1).astype("i4"))], [*[n for n, _ in kinds], "anomaly_score", "prediction"])

    return values.mapInArrow(walk, ", ".join(f"`{n}` {t}" for n, t in [*kinds, ("anomaly_score", "double"), ("prediction", "int")]))


def numeric_features(df: DataFrame, without: Iterable[str] = ()) -> list[str]:
    """The numeric columns but the label and others named: a label never is a feature."""
    gone = {"label", *without}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name.lower() not in gone]
