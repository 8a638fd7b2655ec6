import datetime as dt

import numpy as np
import pandas as pd

from marketloom.schemas import PRICE_PANEL


def panel_frame(closes: dict, start=dt.date(2020, 1, 1), seed=0) -> pd.DataFrame:
    """A pandas price panel, one row per weekday, from {ticker: closes}."""
    rng = np.random.default_rng(seed)
    parts = []
    for ticker, c in closes.items():
        c = np.asarray(c, dtype=float)
        days = pd.bdate_range(start, periods=len(c)).date
        parts.append(pd.DataFrame({
            "Date": days, "Ticker": ticker, "Close": c, "High": np.nan_to_num(c) + 1,
            "Low": np.nan_to_num(c) - 1, "Open": np.nan_to_num(c),
            "Volume": np.round(rng.random(len(c)) * 1e5)}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame):
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return spark.createDataFrame(rows, PRICE_PANEL)


def collect(df, *keys) -> pd.DataFrame:
    out = df.toPandas().sort_values(list(keys)).reset_index(drop=True)
    return out


def walk(n, seed=1):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))
