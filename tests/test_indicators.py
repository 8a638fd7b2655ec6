import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import collect, panel_frame, to_spark, walk
from marketloom.operators import layout
from marketloom.operators.indicators import Params, add_indicators, indicator_states
from marketloom.operators.series import affine
from marketloom.operators.layout import Series, with_blocks, with_positions
from marketloom.schemas import INDICATORS


def gappy():
    c = walk(800, 3)
    c[:3] = np.nan
    c[100:102] = np.nan
    c[300:700] = np.nan            # longer than one calendar group
    c[np.random.default_rng(5).integers(0, 800, 60)] = np.nan
    return c


CLOSES = {"RISE": np.arange(1, 41.0), "FLAT": np.full(300, 7.0), "WALK": walk(900), "LONG": walk(3000, 2),
          "FIVE": walk(5, 4), "THIRTEEN": walk(13, 4), "GAPS": gappy()}


def expected(pdf: pd.DataFrame) -> pd.DataFrame:
    """The public formulas in pandas, one ticker at a time."""
    def one(x):
        c, o = x["Close"], pd.DataFrame(index=x.index)

        def mean(s, n):
            return s.ewm(span=n, min_periods=n, adjust=False).mean()

        def wilder(s):
            return s.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()

        o["ema"], o["sma"] = mean(c, 14), c.rolling(14, min_periods=14).mean()
        d = c.diff()
        up, dn = wilder(d.where(d > 0, 0.0)), wilder(-d.where(d < 0, 0.0))
        o["rsi"] = np.where(dn == 0, 100, 100 - 100 / (1 + up / dn))
        o["macd"] = mean(c, 12) - mean(c, 26)
        o["macd_signal"] = mean(o["macd"], 9)
        o["macd_diff"] = o["macd"] - o["macd_signal"]
        r = c.ffill().pct_change(fill_method=None)
        o["daily_return"] = 100 * r
        o["momentum"] = (c - c.shift(7)) / c.shift(7)
        o["volatility"] = r.rolling(5).std()
        o["future_return"] = 100 * (c.shift(-7) / c - 1)
        o["Close_lag1"], o["Volume_lag1"] = c.shift(-1), x["Volume"].shift(-1)
        return o

    made = pd.concat([one(x) for _, x in pdf.groupby("Ticker")]).sort_index()
    return pd.concat([pdf, made], axis=1).sort_values(["Ticker", "Date"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def both(spark):
    pdf = panel_frame(CLOSES)
    return collect(add_indicators(to_spark(spark, pdf)), "Ticker", "Date"), expected(pdf)


@pytest.mark.parametrize("column", INDICATORS)
def test_equals_pandas(both, column):
    got, want = both[0][column].astype(float), both[1][column].astype(float)
    assert (got.isna() == want.isna()).all()
    np.testing.assert_allclose(got.dropna(), want.dropna(), rtol=1e-9, atol=1e-9)


def test_readiness_and_edges(both):
    got = both[0]
    rise = got[got["Ticker"] == "RISE"].reset_index(drop=True)
    assert rise["ema"].first_valid_index() == 13
    assert rise["macd"].first_valid_index() == 25
    assert rise["macd_signal"].first_valid_index() == 33
    assert (rise["rsi"].dropna() == 100).all()
    flat = got[got["Ticker"] == "FLAT"]
    assert (flat["rsi"].dropna() == 100).all() and (flat["volatility"].dropna() == 0).all()
    assert got[got["Ticker"] == "FIVE"][["ema", "sma", "rsi", "macd"]].isna().all(axis=None)


def test_ema_stays_within_inputs(both):
    long = both[0][both[0]["Ticker"] == "LONG"]
    assert long["ema"].dropna().between(long["Close"].min(), long["Close"].max()).all()


def test_hot_ticker_is_cut_into_bounded_groups(spark):
    rows = to_spark(spark, panel_frame({"HOT": walk(5000), "A": walk(20)}))
    placed = with_blocks(with_positions(rows, Series()), back=13, ahead=7, block_rows=256)
    assert placed.groupBy("Ticker", "_blk").count().agg(F.max("count")).first()[0] <= 256 + 20
    own = placed.where("_own")
    assert own.count() == 5020 and own.select("Ticker", "_pos").distinct().count() == 5020
    assert rows.withColumn("_b", Series().bucket()).groupBy("Ticker", "_b").count().agg(
        F.max("count")).first()[0] <= 366


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_cuts_do_not_change_results(spark, partitions):
    """Every number of range partitions, and batches of few rows, give the pandas result."""
    pdf = panel_frame({"HOT": walk(400), "G": gappy()[:420], "FIVE": walk(5, 4), "NONE": np.full(6, np.nan), "LATE": np.r_[[np.nan] * 30, walk(40)]})
    before = [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
        got = collect(add_indicators(to_spark(spark, pdf)), "Ticker", "Date")
    finally:
        for k, v in zip(("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch"), before):
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = expected(pdf)
    for c in INDICATORS:
        a, b = got[c].astype(float), want[c].astype(float)
        assert (a.isna() == b.isna()).all(), c
        np.testing.assert_allclose(a.dropna(), b.dropna(), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("cut", [3, 14, 30, 250])
def test_saved_states_go_on_without_history(spark, cut):
    pdf = panel_frame({"A": walk(300), "G": gappy()[:320], "S": walk(40, 9)})
    old = pdf[pdf.groupby("Ticker").cumcount() < cut]
    new = pd.concat([pdf.drop(old.index), panel_frame({"NEW": walk(30, 7)})])
    states = indicator_states(to_spark(spark, old))
    columns = [c for c in INDICATORS]
    got = collect(add_indicators(to_spark(spark, new), columns=columns, states=states), "Ticker", "Date")
    full = expected(pd.concat([pdf, panel_frame({"NEW": walk(30, 7)})], ignore_index=True))
    want = full.merge(new[["Ticker", "Date"]], on=["Ticker", "Date"]).sort_values(["Ticker", "Date"]).reset_index(drop=True)
    for c in columns:
        a, b = got[c].astype(float), want[c].astype(float)
        assert (a.isna() == b.isna()).all(), c
        np.testing.assert_allclose(a.dropna(), b.dropna(), rtol=1e-9, atol=1e-9)
    twice = collect(indicator_states(to_spark(spark, new), states=states), "Ticker")
    once = collect(indicator_states(to_spark(spark, pd.concat([pdf, panel_frame({"NEW": walk(30, 7)})]))), "Ticker")
    for a, b in zip(twice["means"], once["means"]):
        np.testing.assert_allclose(a, b, rtol=1e-9)
    assert twice["rows"].tolist() == once["rows"].tolist() and twice["live"].tolist() == once["live"].tolist()


def test_true_lag_and_short_windows(spark):
    pdf = panel_frame({"A": np.arange(1.0, 11)})
    got = collect(add_indicators(to_spark(spark, pdf), p=Params(lag=1), columns=["Close_lag1"]), "Date")
    assert got["Close_lag1"].isna().tolist() == [True] + [False] * 9
    assert got["Close_lag1"].tolist()[1:] == list(range(1, 10))
    with pytest.raises(ValueError):
        add_indicators(to_spark(spark, pdf), p=Params(ema=1))
    with pytest.raises(ValueError):
        add_indicators(to_spark(spark, pdf), columns=["nothing"])


def test_running_products_equal_a_loop():
    r = np.random.default_rng(4)
    a = np.where(r.random(500) < 0.05, r.random(500) * 1e-9, r.random(500))
    b = r.normal(size=500)
    want, y = [], 2.5
    for x, z in zip(a, b):
        y = x * y + z
        want.append(y)
    np.testing.assert_allclose(affine(a, b, 2.5), want, rtol=1e-9, atol=1e-12)


def test_plan_moves_the_rows_once(spark):
    """One scan of the sorted parts, one exchange, no window."""
    df = add_indicators(to_spark(spark, panel_frame({"A": walk(50)})))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1 and "Window" not in plan


def test_hourly_grain(spark):
    c = walk(1500, 8)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "H", float(v)) for i, v in enumerate(c)]
    panel = spark.createDataFrame(rows, "Date timestamp_ntz, Ticker string, Close double")
    got = collect(add_indicators(panel, Series(grain="hourly"), columns=["ema", "rsi"]), "Date")
    want = pd.Series(c).ewm(span=14, min_periods=14, adjust=False).mean()
    np.testing.assert_allclose(got["ema"].dropna(), want.dropna(), rtol=1e-9)
