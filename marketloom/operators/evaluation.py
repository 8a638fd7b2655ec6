"""Classification reports from (label, prediction) tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = (-1, 0, 1)


def prediction_distribution(preds: DataFrame, column: str = "prediction") -> DataFrame:
    """Rows per predicted label and the total, in label order."""
    n = preds.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.select(column, "n", total.alias("total")).orderBy(column)


def confusion_matrix(preds: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """A row for each of ``classes`` as truth, columns ``pred_<class>``; what is absent is 0."""
    counted = preds.groupBy("label").agg(*[
        F.count(F.when(F.col("prediction") == c, 1)).alias(f"pred_{c}") for c in classes])
    rows = preds.sparkSession.createDataFrame([(c,) for c in classes], "label int")
    names = [f"pred_{c}" for c in classes]
    return (rows.withColumn("label", F.col("label").cast(preds.schema["label"].dataType))
            .join(counted, "label", "left").select("label", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
            .orderBy("label"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_report(preds: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    Truth is ``label``; a ratio with an empty denominator is 0.
    """
    cells = preds.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    per = (cells.select("n", "label", "prediction",
                        F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls"))
           .groupBy("cls")
           .agg(F.sum(F.when((F.col("label") == F.col("cls")) & (F.col("prediction") == F.col("cls")),
                             F.col("n")).otherwise(0)).alias("tp"),
                F.sum(F.when(F.col("prediction") == F.col("cls"), F.col("n")).otherwise(0)).alias("pp"),
                F.sum(F.when(F.col("label") == F.col("cls"), F.col("n")).otherwise(0)).alias("support")))
    p, r = _ratio(F.col("tp"), F.col("pp")), _ratio(F.col("tp"), F.col("support"))
    per = (per.withColumns({"precision": p, "recall": r})
           .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                                    F.col("precision") + F.col("recall"))))
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), n)

    total = per.agg(
        n.alias("n"), _ratio(F.sum("tp"), n).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    summary = total.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), a.alias("precision"), b.alias("recall"), c.alias("f1"),
                 F.col("n").alias("support"))
        for name, a, b, c in (
            ("accuracy", F.col("acc"), F.col("acc"), F.col("acc")),
            ("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
            ("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")))])))
    return per.select(F.col("cls").cast("string").alias("name"), "precision", "recall", "f1",
                      "support").unionByName(summary)


def auc_one_vs_one(preds: DataFrame, label: str, scores: Sequence[str],
                   bins: int | None = None) -> DataFrame:
    """ROC-AUC per unordered class pair (both directions averaged) and their mean, ``macro``.

    ``label`` holds the class index into ``scores``. Equal scores share their average rank. Rows
    shrink to counts per distinct score; cumulative counts are taken inside quantile bins of the
    score and shifted by the totals of the earlier bins, so no task ranks a whole class. By
    default there is a bin per two million rows (at least 256).
    """
    k = len(scores)
    bins = bins or min(20_000, max(256, preds.count() // 2_000_000))
    cuts = preds.approxQuantile(list(scores), [i / bins for i in range(1, bins)], 0.25 / bins)
    splits = [[-float("inf"), *sorted(set(c)), float("inf")] for c in cuts]
    binned = Bucketizer(splitsArray=splits, inputCols=list(scores),
                        outputCols=[f"_b{i}" for i in range(k)]).transform(
        preds.select(F.col(label).alias("_y"), *scores))
    long = binned.select("_y", F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(f"_b{i}").alias("b"), F.col(s).alias("score"))
        for i, s in enumerate(scores)])))
    n = [f"n{i}" for i in range(k)]
    cells = long.groupBy("c", "b", "score").agg(
        *[F.count(F.when(F.col("_y") == i, 1)).alias(x) for i, x in enumerate(n)])
    earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    start = (cells.groupBy("c", "b").agg(*[F.sum(x).alias(x) for x in n])
             .select("c", "b", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"s_{x}")
                                 for x in n]))
    lower = Window.partitionBy("c", "b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.select("c", "b", *n, *[
        F.coalesce(F.sum(x).over(lower), F.lit(0)).alias(f"l_{x}") for x in n]).join(start.hint("merge"), ["c", "b"])

    pairs = list(combinations(range(k), 2))

    def wins(a: int, b: int) -> Column:
        """Pairs of an a-row and a b-row in which a scores higher by its own score; ties half."""
        under = F.col(f"l_n{b}") + F.col(f"s_n{b}") + F.col(f"n{b}") / 2
        return F.sum(F.when(F.col("c") == a, F.col(f"n{a}") * under))

    one = ranked.agg(
        *[F.sum(F.when(F.col("c") == 0, F.col(x))).cast("double").alias(f"t{i}")
          for i, x in enumerate(n)],
        *[(wins(a, b) + wins(b, a)).alias(f"w{a}{b}") for a, b in pairs])
    aucs = {f"{a}-{b}": F.col(f"w{a}{b}") / 2 / F.nullif(F.col(f"t{a}") * F.col(f"t{b}"), F.lit(0.0))
            for a, b in pairs}
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("pair"), auc.alias("auc")) for name, auc in aucs.items()])))
    return rows.unionByName(rows.agg(F.lit("macro").alias("pair"), F.avg("auc").alias("auc")))


def row_loss(label: Column, probability: Column) -> Column:
    """Cross-entropy of one row; ``probability`` is an array indexed by the class."""
    return -F.log(F.greatest(F.element_at(probability, label.cast("int") + 1), F.lit(1e-15)))


def batch_metrics(batched: DataFrame) -> DataFrame:
    """Accuracy (percent), mean loss and rows per batch.

    Input: ``batch_id``, ``label`` (class index), ``prediction``, ``probability`` (array).
    """
    hit = (F.col("label") == F.col("prediction")).cast("int")
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"),
        (100 * F.sum(hit) / F.count(F.lit(1))).alias("accuracy"),
        F.avg(row_loss(F.col("label"), F.col("probability"))).alias("loss"))


def evaluation_summary(batches: DataFrame) -> DataFrame:
    """Accuracy over rows; loss averaged over batches (a short last batch weighs as much)."""
    return batches.agg(F.sum("n").alias("n"),
                       (100 * F.sum("correct") / F.sum("n")).alias("accuracy"),
                       F.avg("loss").alias("loss"))
