"""Pair classification with Spark ML.

The reference fine-tunes a pretrained transformer on a GPU; that trainer is
not rebuilt.  Its data path is: a pair of snippets cut to a token budget,
a model fitted on the train split, predictions with a class name and a
confidence, metrics on a held-out split.  Here the model is a distributed
``LogisticRegression`` over pair features computed with SQL functions, chosen
from a grid of candidates by a metric on the validation split; a kept model is
loaded again to predict pair tables, path pairs or two files.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDFModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import scores as S
from pairwright.operators import metrics
from pairwright.operators.compare import bucket_features, fingerprint_features, fit_weights
from pairwright.operators.history import long_log
from pairwright.session import stage
from pairwright.sources.files import read_named_files, read_one

# word runs or single symbols; whitespace separates
TOKEN_RX = r"[\p{L}\p{N}_]+|[^\t\n\x0b\f\r \p{L}\p{N}_]"
MAX_LENGTH = 512   # model input budget per pair
SPECIAL_TOKENS = 3  # start, separator and end markers around a pair


def code_tokens(c) -> Column:
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(TOKEN_RX), 0)


def _kept(n1: Column, n2: Column, budget: int) -> tuple[Column, Column]:
    """Longest-first truncation: drop one token at a time from the longer side
    (the second side on a tie) until the pair fits the budget."""
    excess = n1 + n2 - F.lit(budget)
    first_longer = n1 > n2
    diff = F.abs(n1 - n2)
    r = excess - diff
    short = F.least(n1, n2)
    k1 = (F.when(excess <= 0, n1)
          .when(first_longer & (excess <= diff), n1 - excess)
          .when(~first_longer & (excess <= diff) & (diff > 0), n1)
          .otherwise(short - F.floor(r / 2)))
    k2 = (F.when(excess <= 0, n2)
          .when(first_longer & (excess <= diff), n2)
          .when(~first_longer & (excess <= diff) & (diff > 0), n2 - excess)
          .otherwise(short - F.ceil(r / 2)))
    return k1.cast("int"), k2.cast("int")


def token_budget(df: DataFrame, c1: str = "code1", c2: str = "code2", max_length: int = MAX_LENGTH) -> DataFrame:
    """Tokens of both sides, their counts, the counts a model with a
    ``max_length`` input keeps, and whether the pair exceeds it.

    ``tokens1``/``tokens2`` stay whole; the cut model input is reported
    separately as ``input1``/``input2`` (only a fixed-length encoder needs it).
    """
    out = df.withColumn("tokens1", code_tokens(c1)).withColumn("tokens2", code_tokens(c2))
    n1, n2 = F.size("tokens1"), F.size("tokens2")
    k1, k2 = _kept(n1, n2, max_length - SPECIAL_TOKENS)
    return (out.withColumn("n_tokens1", n1).withColumn("n_tokens2", n2)
            .withColumn("kept1", k1).withColumn("kept2", k2)
            .withColumn("over_budget", (n1 + n2) > F.lit(max_length - SPECIAL_TOKENS))
            .withColumn("input1", F.slice("tokens1", 1, F.col("kept1")))
            .withColumn("input2", F.slice("tokens2", 1, F.col("kept2"))))


def pair_features(df: DataFrame) -> DataFrame:
    """Token-set Jaccard, length ratio and exact equality over the whole texts."""
    a, b = F.array_distinct("tokens1"), F.array_distinct("tokens2")
    union = F.size(F.array_union(a, b))
    n1, n2 = F.size("tokens1"), F.size("tokens2")
    return (df.withColumn("jaccard", F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0)))
            .withColumn("length_ratio", F.when(F.greatest(n1, n2) > 0, F.least(n1, n2) / F.greatest(n1, n2))
                        .otherwise(F.lit(1.0)))
            .withColumn("exact_equal", (F.col("code1") == F.col("code2")).cast("double")))


SCALARS = ("jaccard", "length_ratio", "exact_equal", "prints_jaccard", "prints_held", "idf_cosine")
VECTORS = ("bucket_diff", "tf1", "tf2")
FORMAT = 1
#: An iteration over fewer rows is done sooner than a task begins.
TASK_ROWS = 10_000
#: Candidates for ``select``: every one is a set of LogisticRegression parameters.
GRID = tuple({"regParam": r, "elasticNetParam": e} for r in (0.001, 0.01, 0.1) for e in (0.0, 0.5))


@dataclass
class PairModel:
    """Bucket weights and classifier; ``scalars`` and ``vectors`` name the features it was fitted on."""

    weights: IDFModel
    classifier: LogisticRegressionModel
    num_features: int
    scalars: tuple[str, ...] = SCALARS
    vectors: tuple[str, ...] = VECTORS


def features(pairs: DataFrame, weights: IDFModel, num_features: int = 1 << 12,
             scalars: Sequence[str] = SCALARS, vectors: Sequence[str] = VECTORS) -> DataFrame:
    """The pairs with their token columns and a ``features`` vector."""
    out = bucket_features(fingerprint_features(pair_features(token_budget(pairs))), weights)
    for side in ("1", "2"):
        out = HashingTF(inputCol=f"tokens{side}", outputCol=f"tf{side}", numFeatures=num_features).transform(out)
    return VectorAssembler(inputCols=[*scalars, *vectors], outputCol="features").transform(out)


def _labelled(pairs: DataFrame, label: str, *args, **options) -> DataFrame:
    """Features and label only, written once: every candidate's iterations read them, ``TASK_ROWS`` or more to a task."""
    data = features(pairs.withColumn("label_d", F.col(label).cast("double")), *args, **options)
    data = stage(data.select("features", "label_d"), "pair-features")
    return data.coalesce(max(1, data.count() // TASK_ROWS))


def _train(data: DataFrame, max_iter: int, params: Mapping) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="features", labelCol="label_d", maxIter=max_iter, **params).fit(data)


def fit(train: DataFrame, label: str = "label", params: Mapping | None = None, num_features: int = 1 << 12, max_iter: int = 50,
        scalars: Sequence[str] = SCALARS, vectors: Sequence[str] = VECTORS) -> PairModel:
    """Fit the two-class model on the train split (label "0"/"1")."""
    weights = fit_weights(token_budget(train))
    data = _labelled(train, label, weights, num_features, scalars, vectors)
    return PairModel(weights, _train(data, max_iter, params or {"regParam": 0.01}), num_features, tuple(scalars), tuple(vectors))


def select(train: DataFrame, val: DataFrame, label: str = "label", grid: Sequence[Mapping] = GRID, metric: str = "accuracy",
           greater_is_better: bool = True, num_features: int = 1 << 12, max_iter: int = 50) -> tuple[PairModel, DataFrame]:
    """C3 + A10: one model per candidate of ``grid``, each measured on ``val``; the best one by ``metric`` and the log.

    The log has one record a candidate: step (its place in the grid), its
    parameters, and the metrics on ``val``.  Ties go to the earliest candidate,
    and so does a ``val`` without rows (its metrics are null).  Features are made once for all.
    """
    weights = fit_weights(token_budget(train))
    fitted, held = (_labelled(df, label, weights, num_features) for df in (train, val))
    models, records = [], []
    for step, params in enumerate(grid):
        models.append(_train(fitted, max_iter, params))
        judged = models[-1].transform(held).select(F.col("label_d").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
        records.append({"step": step, **{k: float(v) for k, v in params.items()}, **metrics.binary_metrics(judged).first().asDict()})
    columns = ["step", *dict.fromkeys(k for r in records for k in r if k != "step")]
    log = val.sparkSession.createDataFrame([tuple(r.get(c) for c in columns) for r in records],
                                           ", ".join(f"{c} {'long' if c == 'step' else 'double'}" for c in columns))
    scores = long_log(log.select("step", metric))
    best = metrics.best_record(scores, greater_is_better).first()
    return PairModel(weights, models[best["best_step"] if best else 0], num_features), log


def predict(model: PairModel, pairs: DataFrame) -> DataFrame:
    """C4: predicted class (arg-max), its probability, and the class name."""
    out = model.classifier.transform(features(pairs, model.weights, model.num_features, model.scalars, model.vectors))
    probs = vector_to_array("probability")
    return (out.withColumn("predicted", S.argmax(probs)).withColumn("confidence", S.confidence(probs))
            .withColumn("class_name", S.class_name(F.col("predicted")))
            .drop("tf1", "tf2", "bucket_diff", "prints1", "prints2", "features", "rawPrediction", "probability", "prediction",
                  "input1", "input2"))


def save(model: PairModel, path: str) -> None:
    """Keep the fitted model (overwrites a previous one): weights, classifier, and what features they take."""
    spark = SparkSession.active()
    model.weights.write().overwrite().save(f"{path}/weights")
    model.classifier.write().overwrite().save(f"{path}/classifier")
    about = {"format": FORMAT, "num_features": model.num_features, "scalars": list(model.scalars), "vectors": list(model.vectors)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> PairModel:
    """C4: a kept model.  A folder that is none, another format, or parts that do not fit each other raise ValueError."""
    spark = SparkSession.active()
    try:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        weights, classifier = IDFModel.load(f"{path}/weights"), LogisticRegressionModel.load(f"{path}/classifier")
    except (AnalysisException, Py4JJavaError, TypeError, ValueError) as e:
        raise ValueError(f"{path} holds no pair model") from e
    if about.get("format") != FORMAT:
        raise ValueError(f"{path}: format {about.get('format')}, expected {FORMAT}")
    width = len(about["scalars"]) + sum({"bucket_diff": len(weights.idf)}.get(v, about["num_features"]) for v in about["vectors"])
    if classifier.numFeatures != width:
        raise ValueError(f"{path}: the classifier takes {classifier.numFeatures} features, the description gives {width}")
    return PairModel(weights, classifier, about["num_features"], tuple(about["scalars"]), tuple(about["vectors"]))


def predict_files(model: PairModel, path1: str, path2: str) -> DataFrame:
    """C4 for two files, read whole: one row with class_name, confidence, predicted.  A missing file raises."""
    second = read_one(SparkSession.active(), path2).select("text")
    pair = read_one(SparkSession.active(), path1).select(F.col("text").alias("code1"), second.scalar().alias("code2"))
    return predict(model, stage(pair, "two-files")).select("class_name", "confidence", "predicted")


def predict_paths(model: PairModel, pairs: DataFrame, root: str, base: str | None = None) -> DataFrame:
    """C4 for a table of path pairs (path1, path2, relative to ``base``, default ``root``; other columns stay).

    Only the named files are opened, each once; a file that is not there counts as empty.
    """
    named = pairs.select(F.explode(F.array("path1", "path2")).alias("path"))
    files = read_named_files(pairs.sparkSession, root, named, base=base)
    for n in ("1", "2"):
        side = files.select(F.col("path").alias(f"path{n}"), F.col("text").alias(f"code{n}"))
        pairs = pairs.join(side, f"path{n}", "left").withColumn(f"code{n}", F.coalesce(f"code{n}", F.lit("")))
    return predict(model, pairs)
