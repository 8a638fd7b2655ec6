"""Signal classifiers: windows, trees, balancing, tuning, prediction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from threading import Lock

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.cells import best_matches
from marketloom.operators.labels import class_index
from marketloom.operators.linking import NegativeSquaredDistance
from marketloom.operators.samples import as_vectors, with_shuffle_rank
from marketloom.session import materialize


# ---------------------------------------------------------------- windows

def fit_window_classifier(windows: DataFrame, kind: str = "network", hidden: Sequence[int] = (64,),
                          inputs: int = 91, classes: int = 3, max_iter: int = 100,
                          seed: int = 42) -> PipelineModel:
    """A three-class classifier on flattened windows (``inputs`` = length x features).

    ``network``: a multilayer perceptron, ``logistic``: multinomial regression.
    """
    common = dict(featuresCol="vector", labelCol="label", predictionCol="prediction",
                  probabilityCol="probability", maxIter=max_iter)
    if kind == "network":
        stage = MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], seed=seed, **common)
    elif kind == "logistic":
        stage = LogisticRegression(family="multinomial", **common)
    else:
        raise ValueError("kind must be network or logistic")
    return Pipeline(stages=[stage]).fit(as_vectors(windows).select("vector", "label"))


def predict_windows(model: PipelineModel, windows: DataFrame) -> DataFrame:
    """Windows with ``label``, ``prediction`` (class indexes) and ``probability`` (array)."""
    return (model.transform(as_vectors(windows)).drop("vector", "rawPrediction")
            .withColumn("probability", vector_to_array("probability")))


def training_history(model: PipelineModel) -> DataFrame:
    """(iteration, loss) of the fit, from the last stage's training summary."""
    summary = model.stages[-1].summary
    history = (summary() if callable(summary) else summary).objectiveHistory
    spark = SparkSession.active()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)],
                                 "iteration int, loss double")


# ---------------------------------------------------------------- columns

def one_hot(df: DataFrame, column: str = "Ticker", max_values: int = 5_000) -> DataFrame:
    """0/1 columns ``<column>_<value>`` in place of ``column``."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct()
              .orderBy(column).limit(max_values + 1).collect()]
    if len(values) > max_values:
        raise ValueError(f"{column} has more than {max_values} values: use one_hot_vector")
    return df.select("*", *[F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}_{v}")
                            for v in values]).drop(column)


def one_hot_vector(df: DataFrame, column: str = "Ticker", out: str = "onehot") -> DataFrame:
    """The same as one sparse vector column, for any number of values."""
    stages = [StringIndexer(inputCol=column, outputCol="_index", stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=["_index"], outputCols=[out], dropLast=False)]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_index")


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Training columns in training order: absent ones and missing values become 0."""
    return df.select(*keep, *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns
        else F.lit(0.0).alias(c) for c in columns])


# ---------------------------------------------------------------- balance

def class_counts(df: DataFrame, label: str, most: int = 1_000) -> dict:
    rows = df.groupBy(label).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes in {label}")
    return {r[0]: r[1] for r in rows}


def balanced_weight(df: DataFrame, label: str = "signal_label") -> Column:
    """n / (classes * rows of the class)."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    out = F.lit(None).cast("double")
    for c, m in counts.items():
        out = F.when(F.col(label) == c, n / (len(counts) * m)).otherwise(out)
    return out


def smote(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "signal_label",
          k: int = 5, seed: int = 42, trace: bool = False, **kw) -> DataFrame:
    """Oversample every smaller class to the size of the largest.

    A new row lies between a row and one of its ``k`` nearest rows of the same class. Base rows
    are taken evenly in a seeded shuffled order; neighbour and position come from a seeded hash,
    so a re-run task makes the same rows. All classes are searched in one pass, each in its own cells.
    Output: label and features of old and new rows; with ``trace`` also ``ends``, the base row and its
    neighbour (null for old rows). Rows without a label are kept as they are.
    """
    counts = {c: n for c, n in class_counts(df, label).items() if c is not None}
    target = max(counts.values(), default=0)
    out = df.select(label, *features)
    out = out.withColumn("ends", F.lit(None).cast("array<array<double>>")) if trace else out
    small = {c: n for c, n in counts.items() if n < target}
    if any(n < 2 for n in small.values()):
        raise ValueError(f"class {next(c for c, n in small.items() if n < 2)} has a single row")
    if not small:
        return out
    rows = df.select(label, *keys, F.array(*[F.col(f).cast("double") for f in features]).alias("_v"))
    sides = []
    for c, n in small.items():
        own = with_shuffle_rank(rows.where(F.col(label) == c), keys, seed)
        copies = F.lit((target - n) // n) + (F.col("_rank") < (target - n) % n).cast("int")
        # the id carries the number of copies, so no join is needed to get it back
        sides.append(own.select(F.concat_ws("#", F.concat_ws("|", *keys), copies.cast("string")).alias("id"), "_v",
                                copies.alias("_c"), F.lit(c).alias("part")))
    own = reduce(DataFrame.unionByName, sides)
    own = own.withColumn("id", F.concat_ws("#", F.col("part").cast("string"), "id"))
    near = best_matches(own.where("_c > 0").select(F.col("id").alias("q_id"), F.col("_v").alias("q_value"), "part"),
                        own.select(F.col("id").alias("c_id"), F.col("_v").alias("c_value"), "part"),
                        NegativeSquaredDistance(), min(k, max(small.values()) - 1), exclude_same_id=True, **kw)
    part = F.substring_index("q_id", "#", 1)
    known = F.create_map(*[x for c, n in small.items() for x in (F.lit(str(c)), F.lit(min(k, n - 1)))])
    made = near.withColumn("_i", F.explode(F.sequence(F.lit(1), F.element_at(F.split("q_id", "#"), -1).cast("int"))))
    pick = F.pmod(F.xxhash64("q_id", "_i", F.lit(seed)), F.element_at(known, part)) + 1
    step = F.pmod(F.xxhash64("q_id", "_i", F.lit(seed + 1)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    made = (made.where(F.col("rank") == pick).withColumn("_t", step)
            .withColumn("_v", F.zip_with("q_value", "c_value", lambda a, b: a + F.col("_t") * (b - a))))
    ends = [F.array("q_value", "c_value").alias("ends")] if trace else []
    return out.unionByName(made.select(part.cast(df.schema[label].dataType).alias(label),
                                       *[F.col("_v")[i].alias(f) for i, f in enumerate(features)], *ends))


# ---------------------------------------------------------------- trees

def _tree_pipeline(features: Sequence[str], **kw) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="vector"),
        RandomForestClassifier(featuresCol="vector", labelCol="label", **kw)])


def _labelled(df: DataFrame, features: Sequence[str], label: str, weight: bool) -> DataFrame:
    extra = [balanced_weight(df, label).alias("weight")] if weight else []
    cols = align_columns(df.withColumns({"label": class_index(F.coalesce(F.col(label), F.lit(0)))
                                         .cast("double")}), features, keep=["label", label])
    return cols.select("label", *features, *extra)


def fit_forest(df: DataFrame, features: Sequence[str], label: str = "signal_label",
               trees: int = 400, depth: int = 30, leaf: int = 5, balanced: bool = True,
               seed: int = 42) -> PipelineModel:
    """Random forest with balanced class weights (Spark allows a depth of at most 30)."""
    kw = dict(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    if balanced:
        kw["weightCol"] = "weight"
    return _tree_pipeline(features, **kw).fit(_labelled(df, features, label, balanced))


def tune_forest(df: DataFrame, features: Sequence[str], label: str = "signal_label",
                trees: Sequence[int] = (100, 200, 300), depths: Sequence[int] = (5, 10, 15),
                leaves: Sequence[int] = (1, 3), folds: int = 3, parallelism: int = 4,
                seed: int = 42) -> CrossValidatorModel:
    """Grid search by cross-validated accuracy; the best model is refitted on all rows.

    Spark trees have no minimum split size, so that axis of the reference's grid is absent.
    """
    pipe = _tree_pipeline(features, seed=seed)
    forest = pipe.getStages()[-1]
    grid = (ParamGridBuilder().addGrid(forest.numTrees, list(trees))
            .addGrid(forest.maxDepth, list(depths))
            .addGrid(forest.minInstancesPerNode, list(leaves)).build())
    metric = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=metric,
                        numFolds=folds, parallelism=parallelism, seed=seed)
    return cv.fit(_labelled(df, features, label, weight=False))


def with_folds(df: DataFrame, keys: Sequence[str], folds: int = 3, seed: int = 42, out: str = "fold") -> DataFrame:
    """Add the fold 0 .. folds - 1 of each row, 28 bits of an MD5 of its keys: the same on every run."""
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn(out, F.conv(F.substring(code, 1, 7), 16, 10).cast("int") % folds)


class SmoteForest(Estimator):
    """A random forest that oversamples the rows it is fitted on, and only those: a fitted model, a validation
    fold or new rows are never resampled. Several parameter settings on one set of rows share its oversampling."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth, at most 30", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows a leaf needs", TypeConverters.toInt)

    def __init__(self, keys: Sequence[str], features: Sequence[str], label: str = "signal_label", k: int = 5, seed: int = 42) -> None:
        super().__init__()
        self.keys, self.features, self.label, self.k, self.seed = list(keys), list(features), label, k, seed
        self._setDefault(numTrees=100, maxDepth=5, minInstancesPerNode=1)

    def grown(self, df: DataFrame) -> DataFrame:
        """The rows with every class as large as the largest."""
        rows = smote(df.select(self.label, *self.keys, *self.features), self.keys, self.features, self.label, self.k, self.seed)
        return materialize(_labelled(rows, self.features, self.label, weight=False), "oversampled")

    def _forest(self, grown: DataFrame) -> PipelineModel:
        given = {p.name: self.getOrDefault(p) for p in (self.numTrees, self.maxDepth, self.minInstancesPerNode)}
        return _tree_pipeline(self.features, seed=self.seed, **given).fit(grown)

    def _fit(self, df: DataFrame) -> PipelineModel:
        return self._forest(self.grown(df))

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence):
        grown, settings = self.grown(dataset), [self.copy(m) for m in paramMaps]
        lock, todo = Lock(), iter(range(len(settings)))

        class Models:
            def __iter__(self):
                return self

            def __next__(self):
                with lock:
                    i = next(todo)
                return i, settings[i]._forest(grown)

        return Models()


def tune_balanced_forest(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "signal_label",
                         trees: Sequence[int] = (100, 200, 300), depths: Sequence[int] = (5, 10, 15), leaves: Sequence[int] = (1, 3),
                         folds: int = 3, parallelism: int = 4, seed: int = 42) -> CrossValidatorModel:
    """Grid search by cross-validated accuracy with oversampling inside the training folds; the best setting is
    fitted again on all rows, oversampled. Missing features count as 0."""
    rows = align_columns(df, features, keep=[label, *keys])
    rows = materialize(with_folds(rows, keys, folds, seed).withColumn("label", class_index(F.col(label)).cast("double")), "folds")
    forest = SmoteForest(keys, features, label, seed=seed)
    grid = (ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths))
            .addGrid(forest.minInstancesPerNode, list(leaves)).build())
    metric = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label")
    return CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=metric, numFolds=folds, foldCol="fold",
                          parallelism=parallelism, seed=seed).fit(rows)


def predict_rows(model: PipelineModel, df: DataFrame, features: Sequence[str],
                 keep: Sequence[str] = ()) -> DataFrame:
    """Predict new rows whose columns may differ from the training columns.

    ``prediction`` is a signal (-1, 0, 1); ``probability`` an array by class.
    """
    out = model.transform(align_columns(df, features, keep))
    return out.select(*keep, (F.col("prediction") - 1).cast("int").alias("prediction"),
                      vector_to_array("probability").alias("probability"))
