import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import collect, panel_frame, to_spark, walk
from marketloom.operators.indicators import add_indicators
from marketloom.operators.labels import Thresholds, add_signal_label, class_index
from marketloom.operators.layout import Series
from marketloom.operators.quantiles import exact_quantiles
from marketloom.operators.samples import (
    as_vectors, complete_rows, shuffled, split_panel, split_point, window_samples, with_batches)
from marketloom.operators.scaling import fit_zscore
from marketloom.plans.pipeline import labelled_features, scaled_splits, split_windows
from marketloom.schemas import FEATURES


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(5.0)), min_size=1, max_size=60),
       st.floats(0, 1))
def test_quantiles_equal_pandas(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, "x", [p], limit=10, error=0.01)[0]
    want = pd.Series(values, dtype=float).quantile(p)
    assert (got is None and np.isnan(want)) or got == pytest.approx(want, rel=1e-12, abs=1e-9)


def test_quantiles_narrow_large_columns(spark):
    df = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.randn(3)).alias("x"))
    x = df.toPandas()["x"]
    for p in (0.0, 0.3, 0.5, 0.7, 0.8, 1.0):
        assert exact_quantiles(df, "x", [p], limit=500, error=0.001)[0] == pytest.approx(x.quantile(p))


def test_labels(spark):
    df = spark.createDataFrame([(2.0,), (1.9,), (-1.0,), (0.0,), (None,)], "future_return double")
    got = [r.signal_label for r in add_signal_label(df, Thresholds(-1.0, 2.0)).collect()]
    assert got == [1, 0, -1, 0, 0]
    same = [r.signal_label for r in add_signal_label(df, Thresholds(0.0, 0.0)).collect()]
    assert same == [1, 1, -1, 1, 0]        # the upper threshold is tested first
    assert [r[0] for r in spark.range(3).select(class_index(F.col("id") - 1)).collect()] == [0, 1, 2]


def test_forward_columns(spark):
    pdf = panel_frame({"A": np.arange(1.0, 11)})
    got = collect(add_indicators(to_spark(spark, pdf), columns=["future_return", "Close_lag1"]), "Date")
    assert got["future_return"].isna().tolist() == [False] * 3 + [True] * 7
    assert got["Close_lag1"].tolist()[:9] == list(range(2, 11)) and np.isnan(got["Close_lag1"][9])


def test_zscore(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    z = fit_zscore(df, ["a", "b"])
    assert z.stds == {"a": 1.0, "b": 1e-7}
    assert [(r.a, r.b) for r in z.transform(df).collect()] == [
        (-1.0, 0.0), (0.0, 0.0), (1.0, 0.0), (None, 0.0)]


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.8, 1.0])
def test_split_is_positional(spark, fraction):
    days = [dt.date(2020, 12, 31), dt.date(2021, 1, 4), dt.date(2021, 1, 5)]
    rows = [(d, t) for d, ts in zip(days, ("ABCD", "ABCDE", "AB")) for t in ts]
    df = spark.createDataFrame(rows[::-1], "Date date, Ticker string")
    train, test = split_panel(df, fraction)
    cut = int(11 * fraction)
    assert sorted(tuple(r) for r in train.collect()) == rows[:cut]
    assert sorted(tuple(r) for r in test.collect()) == rows[cut:]
    assert split_point(df, 0.8) == ("2021-01-04", "E")
    assert split_point(df, 1.0) is None


def test_split_of_timestamps_in_another_zone(spark):
    hours = [dt.datetime(2024, 3, 10) + dt.timedelta(hours=i) for i in range(50)]
    df = spark.createDataFrame([(h, k) for h in hours for k in "AB"], "Date timestamp_ntz, Ticker string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        train, test = split_panel(df, 0.55, Series(grain="hourly"))
        assert (train.count(), test.count()) == (55, 45)
        assert test.orderBy("Date", "Ticker").first()[:] == (hours[27], "B")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("n,windows", [(6, 0), (7, 0), (8, 1), (20, 13)])
def test_window_counts(spark, n, windows):
    rows = [(dt.date(2020, 12, 20) + dt.timedelta(i), "A", float(i), i % 3 - 1) for i in range(n)]
    df = spark.createDataFrame(rows, "Date date, Ticker string, x double, signal_label int")
    got = window_samples(df, features=["x"]).orderBy("Date").collect()
    assert len(got) == windows
    for i, r in enumerate(got):
        assert r.features == [[float(j)] for j in range(i, i + 7)]
        assert r.signal_label == (i + 6) % 3 - 1 and r.Date == rows[i + 6][0]
    assert window_samples(df, features=["x"], include_last=True).count() == max(n - 6, 0)


def test_batches(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(1000)], "i int, k string")
    got = with_batches(df, ["k"], 64)
    sizes = {r.batch_id: r["count"] for r in got.groupBy("batch_id").count().collect()}
    assert sizes == {b: 64 if b < 15 else 40 for b in range(16)}
    again = {r.k: r.batch_id for r in with_batches(df.repartition(5), ["k"], 64).collect()}
    assert again == {r.k: r.batch_id for r in got.collect()}
    other = {r.k: r.batch_id for r in with_batches(df, ["k"], 64, seed=1).collect()}
    assert other != again
    assert shuffled(df).count() == 1000


@pytest.fixture(scope="module")
def features(spark):
    pdf = panel_frame({"A": walk(120, 1), "B": walk(120, 2), "C": walk(90, 3)})
    return labelled_features(to_spark(spark, pdf))


def test_label_shares(features):
    n = {r.signal_label: r["count"] for r in features.features.groupBy("signal_label").count().collect()}
    assert sum(n.values()) == 330
    x = features.features.toPandas()["future_return"]
    assert features.thresholds.lower == pytest.approx(x.quantile(0.3))
    assert features.thresholds.upper == pytest.approx(x.quantile(0.7))


def test_split_windows_match_pandas(features):
    """The whole path after the features, recomputed row by row in pandas."""
    pdf = features.features.toPandas().sort_values(["Date", "Ticker"]).reset_index(drop=True)
    cut = int(len(pdf) * 0.8)
    for side, part in zip(split_windows(features.features), (pdf[:cut].copy(), pdf[cut:].copy())):
        part[FEATURES] = (part[FEATURES] - part[FEATURES].mean()) / part[FEATURES].std()
        part, want = part.dropna(), {}
        for ticker, g in part.groupby("Ticker"):
            x, y, d = g[FEATURES].values, g["signal_label"].values, g["Date"].values
            for i in range(len(g) - 7):
                want[ticker, d[i + 6]] = (x[i:i + 7], y[i + 6])
        rows = side.collect()
        assert {(r.Ticker, r.Date) for r in rows} == set(want) and len(rows) == len(want)
        for r in rows:
            x, y = want[r.Ticker, r.Date]
            np.testing.assert_allclose(np.array(r.features), x, rtol=1e-7, atol=1e-9)
            assert r.signal_label == y


def test_train_statistics_for_both_sides(features):
    own, train = scaled_splits(features.features), scaled_splits(features.features, stats_from="train")
    assert own.train.select("Close").toPandas().equals(train.train.select("Close").toPandas())
    assert abs(own.test.agg(F.avg("Close")).first()[0]) < 1e-9
    assert abs(train.test.agg(F.avg("Close")).first()[0]) > 1e-3
    with pytest.raises(ValueError):
        scaled_splits(features.features, stats_from="both")


def test_complete_rows_looks_at_all_columns(features):
    pdf = features.features.toPandas()
    assert complete_rows(features.features).count() == len(pdf.dropna())
    assert complete_rows(features.features, FEATURES).count() > len(pdf.dropna())


def test_vectors(features):
    v = as_vectors(split_windows(features.features).train).select("vector", "label").first()
    assert v.vector.size == 91 and v.label in (0.0, 1.0, 2.0)
