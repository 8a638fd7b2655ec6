"""Declared schemas of every input and output record."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


PRICE_PANEL = T.StructType(
    [T.StructField("Date", T.DateType()), T.StructField("Ticker", _S)]
    + [T.StructField(n, _D) for n in ("Close", "High", "Low", "Open", "Volume")])

TICKER_DIM = _strings("Symbol", "GICS Sector", "GICS Sub-Industry")

ARTICLE_META = _strings("title", "author", "url", "symbol")

PROCESSED_ARTICLE = _strings(
    "title", "url", "author", "scraped_content", "status", "error_details", "symbol")

NEWS_PAYLOAD = T.StructType([
    T.StructField("status", _S),
    T.StructField("totalResults", T.LongType()),
    T.StructField("articles", T.ArrayType(_strings(
        "author", "title", "description", "url", "urlToImage", "publishedAt", "content"))),
])

SYMBOL_NEWS_PAYLOAD = T.MapType(_S, T.ArrayType(T.StructType([
    T.StructField("content", T.StructType([
        T.StructField("title", _S),
        T.StructField("canonicalUrl", _strings("url")),
        T.StructField("provider", _strings("displayName")),
    ])),
])))

SENTIMENT = T.StructType([
    T.StructField("label", _S), T.StructField("score", _D), T.StructField("details", _S)])

# fixed values: column names that must equal the reference's
FIELDS = ["Close", "High", "Low", "Open", "Volume"]
INDICATORS = ["ema", "sma", "rsi", "macd", "macd_diff", "macd_signal", "daily_return",
              "momentum", "volatility", "future_return", "Close_lag1", "Volume_lag1"]
FEATURES = ["Close", "Volume", "ema", "sma", "rsi", "macd", "macd_signal", "macd_diff",
            "daily_return", "momentum", "volatility", "Close_lag1", "Volume_lag1"]
