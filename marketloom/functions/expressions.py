"""Small column expressions shared by the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing whitespace of any kind (``trim`` only drops spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column, so that aggregates skip missing values."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def symbol_or_default(c: Column, default: str = "unknown") -> Column:
    return F.coalesce(c, F.lit(default))


def fetch_status(http_status: Column, error_kind: Column) -> Column:
    """Outcome of a page fetch.

    ``error_kind``: null, ``timeout``, ``http``, ``network`` or anything else for an exception.
    Unlike the reference, which loses the code of every 4xx and 5xx answer, a known code is kept.
    """
    code = F.coalesce(http_status.cast("string"), F.lit("unknown"))
    return (F.when(error_kind == "timeout", "timeout_error")
            .when((error_kind == "http") | (http_status >= 400), F.concat(F.lit("http_error_"), code))
            .when(error_kind == "network", "network_error")
            .when(error_kind.isNotNull(), "unexpected_exception")
            .otherwise("success"))


def analysis_text(status: Column, content: Column, title: Column) -> Column:
    """The article text, or its title when the page was not fetched."""
    return F.when(status == "success", content).otherwise(title)


def ticker_text(symbol: Column, sector: Column, sub_industry: Column) -> Column:
    """Text embedded for a ticker: the three fields without separators."""
    return F.concat(symbol, sector, sub_industry)


def day_string(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def days_before(now: dt.date | Column, days: int) -> Column:
    """``yyyy-MM-dd`` of ``days`` before ``now``; pass a date to get repeatable results."""
    base = now if isinstance(now, Column) else F.lit(now)
    return day_string(F.date_sub(base, days))
