import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import panel_frame, to_spark, walk
from marketloom.operators import bars, classifiers, evaluation
from marketloom.plans.pipeline import evaluate, train_and_evaluate
from marketloom.session import scratch_path
from marketloom.sources import models, prices

PAIRS = [(1, 1), (1, -1), (1, 1), (-1, -1), (-1, 1), (0, 1), (0, 0), (0, 0)]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(PAIRS, "label int, prediction int")


def test_confusion_and_distribution(preds):
    got = [tuple(r) for r in evaluation.confusion_matrix(preds).collect()]
    assert got == [(-1, 1, 0, 1), (0, 0, 2, 1), (1, 1, 0, 2)]
    assert [tuple(r) for r in evaluation.prediction_distribution(preds).collect()] == [
        (-1, 2, 8), (0, 2, 8), (1, 4, 8)]


def test_class_report(preds):
    got = {r["name"]: (r.precision, r.recall, r.f1, r.support) for r in evaluation.class_report(preds).collect()}
    assert got["0"] == pytest.approx((1.0, 2 / 3, 0.8, 3))
    assert got["1"] == pytest.approx((0.5, 2 / 3, 4 / 7, 3))
    assert got["accuracy"][0] == pytest.approx(5 / 8)
    assert got["macro avg"][2] == pytest.approx((0.5 + 0.8 + 4 / 7) / 3)
    assert got["weighted avg"][1] == pytest.approx(5 / 8)


def test_absent_class(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    got = {r["name"]: (r.precision, r.recall, r.f1, r.support) for r in evaluation.class_report(df).collect()}
    assert got["-1"] == (0.0, 0.0, 0.0, 0) and got["1"] == (0.0, 0.0, 0.0, 1)


@pytest.mark.parametrize("bins", [2, 16, 256])
def test_auc(spark, bins):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    s = np.round(rng.random((400, 3)) + 0.3 * np.eye(3)[y], 2)         # many ties
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, s)], "y int, p0 double, p1 double, p2 double")

    def one(a, b):
        x, z = s[y == a, a][:, None], s[y == b, a][None, :]
        return ((x > z) + (x == z) / 2).mean()

    want = {f"{a}-{b}": (one(a, b) + one(b, a)) / 2 for a, b in ((0, 1), (0, 2), (1, 2))}
    want["macro"] = sum(want.values()) / 3
    got = {r.pair: r.auc for r in evaluation.auc_one_vs_one(df, "y", ["p0", "p1", "p2"], bins).collect()}
    assert got == pytest.approx(want)


def test_batch_metrics(spark):
    rows = [(0, 0, 0, [0.5, 0.25, 0.25]), (0, 1, 2, [0.1, 0.2, 0.7]), (1, 2, 2, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "batch_id int, label int, prediction int, probability array<double>")
    b = {r.batch_id: r for r in evaluation.batch_metrics(df).collect()}
    assert b[0].accuracy == 50 and b[0].loss == pytest.approx((math.log(2) + math.log(5)) / 2)
    s = evaluation.evaluation_summary(evaluation.batch_metrics(df)).first()
    assert s.accuracy == pytest.approx(200 / 3) and s.loss == pytest.approx(b[0].loss / 2)


# ---------------------------------------------------------------- classifiers

@pytest.fixture(scope="module")
def panel(spark):
    return to_spark(spark, panel_frame({t: walk(150, i) for i, t in enumerate("ABC")}))


@pytest.mark.parametrize("kind", ["network", "logistic"])
def test_train_save_load_evaluate(spark, panel, kind):
    done = train_and_evaluate(panel, kind=kind, max_iter=20)
    s = done.summary.first()
    assert s.n == done.predictions.count() and 0 <= s.accuracy <= 100 and s.loss > 0
    assert done.batches.count() == -(-s.n // 64)
    assert classifiers.training_history(done.model).count() > 1
    path = scratch_path(spark, "model")
    models.save_model(done.model, path)
    again = evaluate(models.load_model(path), done.predictions.select("Ticker", "Date", "features", "signal_label"))
    assert again.summary.first().accuracy == pytest.approx(s.accuracy)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = [(i, "AB"[i % 2], float(x), float(x + rng.normal()), int(np.sign(x) if abs(x) > 0.9 else 0))
            for i, x in enumerate(rng.normal(size=300))]
    return spark.createDataFrame(data, "id int, Ticker string, x double, z double, signal_label int")


def test_forest_and_prediction(rows):
    model = classifiers.fit_forest(rows, ["x", "z"], trees=10, depth=5)
    out = classifiers.predict_rows(model, rows.drop("z"), ["x", "z"], keep=["id", "signal_label"])
    assert out.columns == ["id", "signal_label", "prediction", "probability"]
    assert out.where("prediction = signal_label").count() > 200


def test_balanced_weight(rows):
    w = rows.select("signal_label", classifiers.balanced_weight(rows).alias("w"))
    per = {r.signal_label: r.s for r in w.groupBy("signal_label").agg(F.sum("w").alias("s")).collect()}
    assert list(per.values()) == pytest.approx([100.0] * 3)


def test_grid_search(rows):
    cv = classifiers.tune_forest(rows, ["x", "z"], trees=[5], depths=[2, 4], leaves=[1])
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.6


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_smote(rows, limit):
    grown = classifiers.smote(rows, ["id"], ["x", "z"], k=5, max_broadcast_bytes=limit, tile_rows=16)
    n = {r.signal_label: r["count"] for r in grown.groupBy("signal_label").count().collect()}
    before = classifiers.class_counts(rows, "signal_label")
    assert set(n.values()) == {max(before.values())}
    again = classifiers.smote(rows, ["id"], ["x", "z"], k=5)
    key = lambda d: sorted((r.signal_label, round(r.x, 9), round(r.z, 9)) for r in d.collect())
    assert key(grown) == key(again)
    # every new row lies on a segment between a row and one of its five nearest of the class
    old = {c: np.array([(r.x, r.z) for r in rows.where(F.col("signal_label") == c).collect()]) for c in before}
    have = {(r.signal_label, r.x, r.z) for r in rows.collect()}
    for r in grown.collect():
        if (r.signal_label, r.x, r.z) in have:
            continue
        pts, p = old[r.signal_label], np.array([r.x, r.z])
        dist = ((pts[:, None] - pts[None]) ** 2).sum(-1)
        near = np.argsort(dist, axis=1)[:, 1:6]
        gap = min(np.linalg.norm(a - p) + np.linalg.norm(p - pts[j]) - np.linalg.norm(a - pts[j])
                  for i, a in enumerate(pts) for j in near[i])
        assert gap < 1e-7


def test_columns(rows):
    hot = classifiers.one_hot(rows.select("Ticker", "x"))
    assert hot.columns == ["x", "Ticker_A", "Ticker_B"]
    assert hot.agg(F.sum("Ticker_A"), F.sum("Ticker_B")).first()[:] == (150, 150)
    assert classifiers.one_hot_vector(rows).first().onehot.size == 2
    a = classifiers.align_columns(rows.select("z", F.lit(None).cast("double").alias("x")), ["x", "y", "z"])
    assert a.columns == ["x", "y", "z"] and a.first()[:2] == (0.0, 0.0)


# ---------------------------------------------------------------- panels

def test_wide_to_long(spark):
    wide = spark.createDataFrame([("d1", 1.0, None, 2.0), ("d2", None, None, None)],
                                 "Date string, `Close|A` double, `Close|B` double, `Volume|A` double")
    got = sorted((r.Date, r.Ticker, r.Close, r.Volume, r.Open) for r in bars.wide_to_long(wide).collect())
    assert got == [("d1", "A", 1.0, 2.0, None), ("d1", "B", None, None, None),
                   ("d2", "A", None, None, None), ("d2", "B", None, None, None)]


def test_csv_and_ranges(spark, panel, tmp_path):
    prices.write_csv(panel, str(tmp_path / "p"))
    back = prices.read_price_csv(spark, str(tmp_path / "p"))
    assert back.exceptAll(panel).count() == 0 and back.count() == panel.count()
    (tmp_path / "n.csv").write_text("Date,Ticker,Close,High,Low,Open,Volume\n2020-01-02,A,NaN,1,,1,5\n")
    r = prices.read_price_csv(spark, str(tmp_path / "n.csv")).first()
    assert r.Close is None and r.Low is None and r.Volume == 5.0
    (tmp_path / "t.csv").write_text("Symbol,GICS Sector,GICS Sub-Industry\nA,Tech,Chips\n")
    assert prices.read_ticker_csv(spark, str(tmp_path / "t.csv")).first()[:] == ("A", "Tech", "Chips")
    prices.write_panel(panel, str(tmp_path / "w"), by_year=True)
    cut = bars.date_range(spark.read.parquet(str(tmp_path / "w")), *bars.TRAIN_RANGE)
    assert cut.count() == panel.count()
    few = bars.only_symbols(panel, spark.createDataFrame([("B",), ("A",), ("Z",)], "symbol string"), limit=2)
    assert sorted(r[0] for r in few.select("Ticker").distinct().collect()) == ["A", "B"]


def test_bars_from_ticks(spark):
    ticks = spark.createDataFrame([("A", 1, 2, 5.0), ("A", 1, 1, 7.0), ("A", 1, 3, 4.0), ("A", 2, 1, 1.0)],
                                  "k string, d int, n int, px double")
    got = {r.Date: (r.Open, r.High, r.Low, r.Close, r.Volume)
           for r in bars.ohlcv(ticks, F.col("k"), F.col("d"), F.col("px"), ["n"]).collect()}
    assert got == {1: (7.0, 7.0, 4.0, 4.0, 3.0), 2: (1.0, 1.0, 1.0, 1.0, 1.0)}


def test_packed_order_of_ticks(spark):
    """Ties in the leading columns, nulls and negative numbers order as a struct would; no sort aggregation."""
    rng = np.random.default_rng(9)
    rows = [("AB"[i % 2], i % 3, *(None if rng.random() < 0.1 else int(v) for v in (rng.integers(-3, 3), rng.integers(-10 ** 12, 10 ** 12), i)),
             float(rng.random())) for i in range(600)]
    ticks = spark.createDataFrame(rows, "k string, d int, a int, b long, c int, px double")
    ticks = ticks.withColumns({"day": F.date_add(F.lit("2020-01-01").cast("date"), F.col("a")),
                               "at": F.timestamp_micros("b"), "price": (F.col("b") / 100).cast("decimal(15,2)")})
    for order in (["a", "b", "c"], ["day", "at", "c"], ["price", "c"], ["c"]):
        got = bars.ohlcv(ticks, F.col("k"), F.col("d"), F.col("px"), order)
        assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
        at = F.struct(*order)
        want = {(r.k, r.d): (r.o, r.c) for r in ticks.groupBy("k", "d").agg(
            F.min_by("px", at).alias("o"), F.max_by("px", at).alias("c")).collect()}
        assert {(r.Ticker, r.Date): (r.Open, r.Close) for r in got.collect()} == want
    assert bars.packed_order(ticks, ["px"]) is None
    wide = spark.createDataFrame([(-(1 << 63) + 1, (1 << 63) - 1), ((1 << 63) - 1, -5)], "a long, b long")
    assert bars.packed_order(wide, ["a", "b"]) is None and bars.packed_order(wide, ["a"]) is not None


def test_oversampling_stays_inside_the_training_folds(rows):
    df = rows.where("signal_label <> -1 or id % 3 = 0")
    folded = classifiers.with_folds(df, ["id"])
    assert {r.fold for r in folded.select("fold").distinct().collect()} == {0, 1, 2}
    assert folded.exceptAll(classifiers.with_folds(df.repartition(5), ["id"])).count() == 0
    forest = classifiers.SmoteForest(["id"], ["x", "z"])
    grown = {r.label: r["count"] for r in forest.grown(folded.where("fold <> 0")).groupBy("label").count().collect()}
    assert len(grown) == 3 and len(set(grown.values())) == 1
    cv = classifiers.tune_balanced_forest(df, ["id"], ["x", "z"], trees=[5], depths=[2, 4], leaves=[1])
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.6
    out = cv.bestModel.transform(df.where("id < 50"))
    assert out.count() == df.where("id < 50").count()  # nothing is resampled in prediction
