import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from data import awkward, frame, prose
from marketloom.llm import quality
from marketloom.llm.common import fold


def corpus(r, n=400):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = ". ".join(prose(r, 9).capitalize() for _ in range(6)) + "."
        if not good:
            text = r.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), "word " * 80,
                             " | ".join(text.split())])
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_sparse_rules(spark):
    rows, labels = corpus(random.Random(2))
    docs = frame(spark, rows)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 0 < len(model.weights) < 200
    got = quality.score(docs, model).where(fold(F.col("doc_id"), 5) == 0).collect()
    truth = dict(labels)
    assert sum((x.score >= 0.3) == (truth[x.doc_id] == 1) for x in got) >= 0.97 * len(got)


def test_rules_from_a_tree():
    text = ("  Tree 0 (weight 1.0):\n    If (feature 0 <= 2.5)\n     If (feature 3 <= 1.0)\n      Predict: 0.0\n"
            "     Else (feature 3 > 1.0)\n      Predict: 1.0\n    Else (feature 0 > 2.5)\n     Predict: 1.0\n")
    a, b = quality.STATISTICS[0], quality.STATISTICS[3]
    assert quality.tree_rules(text) == {
        ((a, "<=", 2.5),), ((a, ">", 2.5),), tuple(sorted(((a, "<=", 2.5), (b, "<=", 1.0)))),
        tuple(sorted(((a, "<=", 2.5), (b, ">", 1.0))))}


def test_awkward_rows_and_missing_labels(spark):
    rows = awkward(random.Random(1))
    docs = frame(spark, rows).withColumn("score", F.lit(9.0))
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    model = quality.fit(docs, none)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(x.score == 0.5 for x in got)
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int"))
    assert not one.weights
    assert quality.score(frame(spark, rows[:0]), one).collect() == []


def test_every_labelled_row_is_learned_and_rules_are_one_constant(spark):
    rows = [(i, "a few plain words.") for i in range(26_000)]
    model = quality.fit(frame(spark, rows), spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int"))
    n = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, _ in rows)
    assert n > 20_000 and model.intercept == pytest.approx(math.log((n + 1) / 1))
    rules = {((quality.STATISTICS[k % 14], "<=" if k % 2 else ">", k / 50),): (-1) ** k / 7 for k in range(150)}
    wide = quality.QualityModel(0.25, rules)
    docs = frame(spark, [(1, "One two. THREE 4 5!"), (2, None)])
    for x in quality.score(quality.add_statistics(docs, "text", "s"), wide).collect():
        z = 0.25
        for ((name, sign, v),), w in rules.items():
            z += w if (x.s[name] <= v) == (sign == "<=") else 0.0
        assert x.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-12)
    assert quality.score(docs, wide)._jdf.queryExecution().analyzed().toString().count("CASE WHEN") < 5
