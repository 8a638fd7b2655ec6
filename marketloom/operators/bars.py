"""Bars from ticks, reshaping of wide panels, date ranges and symbol restriction."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.schemas import FIELDS


WIDE_TICKERS = 5_000


def packed_order(rows: DataFrame, order: Sequence[str]) -> Column | None:
    """One number that orders as the columns ``order`` do one after the other, nulls first: a long, or a decimal
    of 38 digits; None for columns that are not whole numbers, dates or times, or whose ranges do not fit.

    The ranges come from one aggregation over these columns alone."""
    whole = {"tinyint": F.col, "smallint": F.col, "int": F.col, "bigint": F.col, "date": F.unix_date, "timestamp": F.unix_micros}
    if rows.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC":  # elsewhere clock changes would reorder them
        whole["timestamp_ntz"] = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kinds = dict(rows.dtypes)
    numbers = []
    for c in order:
        fixed = re.fullmatch(r"decimal\((\d+),(\d+)\)", kinds[c])
        if fixed and int(fixed[1]) <= 18:
            numbers.append((F.col(c) * F.lit(10 ** int(fixed[2]))).cast("bigint"))
        elif kinds[c] in whole:
            numbers.append(whole[kinds[c]](c).cast("bigint"))
        else:
            return None
    found = rows.agg(*[f(n).alias(f"{f.__name__}{i}") for i, n in enumerate(numbers) for f in (F.min, F.max)]).first()
    least = [found[f"min{i}"] or 0 for i in range(len(order))]
    sizes = [(found[f"max{i}"] or 0) - low + 2 for i, low in enumerate(least)]  # 0 stands for null
    if math.prod(sizes) >= 10 ** 38:
        return None
    kind = "bigint" if math.prod(sizes) < 1 << 62 else "decimal(38,0)"
    out = F.lit(0).cast(kind)
    for n, low, size in zip(numbers, least, sizes):
        place = F.coalesce(n.cast(kind) - F.lit(str(low - 1)).cast(kind), F.lit(0).cast(kind))
        out = (out * F.lit(str(size)).cast(kind) + place).cast(kind)
    return out


def ohlcv(ticks: DataFrame, key: Column, time: Column, price: Column, order: Sequence[str],
          volume: Column | None = None) -> DataFrame:
    """One bar per (key, time). ``order`` must order the ticks of a bar uniquely.

    Every aggregate merges partial results, so ticks of a busy key shrink to one row per bar
    before the shuffle. Where the order columns fit one number all buffers have a fixed width and
    Spark aggregates by hash, without sorting ticks; else it sorts. ``volume`` defaults to the number of ticks.
    """
    at = packed_order(ticks, order)
    at = F.struct(*order) if at is None else at
    px = ticks.select(key.alias("Ticker"), time.alias("Date"), price.alias("_px"), at.alias("_at"),
                      (F.lit(1.0) if volume is None else volume.cast("double")).alias("_vol"))
    return (px.where(F.col("Ticker").isNotNull() & F.col("Date").isNotNull())
            .groupBy("Date", "Ticker")
            .agg(F.max_by("_px", "_at").alias("Close"), F.max("_px").alias("High"),
                 F.min("_px").alias("Low"), F.min_by("_px", "_at").alias("Open"),
                 F.sum("_vol").alias("Volume")))


def wide_to_long(wide: DataFrame, time: str = "Date", sep: str = "|",
                 fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """Columns named ``field<sep>ticker`` -> one row per (time, ticker); all-null rows are kept.

    A row is exploded to one struct per ticker, so nothing is shuffled.
    """
    have = {tuple(c.split(sep, 1)): c for c in wide.columns if sep in c}
    tickers = sorted({t for _, t in have})

    def row(t: str) -> Column:
        return F.struct(F.lit(t).alias("Ticker"), *[
            (F.col(f"`{have[f, t]}`") if (f, t) in have else F.lit(None)).cast("double").alias(f)
            for f in fields])

    return wide.select(time, F.inline(F.array(*[row(t) for t in tickers])))


def long_to_wide(panel: DataFrame, tickers: Sequence[str], time: str = "Date", sep: str = "|",
                 fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """The inverse of ``wide_to_long``, for an explicit ticker list of at most ``WIDE_TICKERS``
    (``ValueError`` above: a plan can't hold as many columns)."""
    if len(tickers) > WIDE_TICKERS:
        raise ValueError(f"more than {WIDE_TICKERS} tickers don't fit one row; keep the long layout")
    return panel.groupBy(time).agg(*[
        F.max(F.when(F.col("Ticker") == t, F.col(f))).alias(f"{f}{sep}{t}")
        for t in tickers for f in fields])


def date_range(panel: DataFrame, start, end, time: str = "Date") -> DataFrame:
    """start <= time < end (a filter the file scan can use)."""
    return panel.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def recent_range(now: dt.date) -> tuple[dt.date, dt.date]:
    """The eight weeks before ``now`` up to, excluding, yesterday."""
    return now - dt.timedelta(weeks=8), now - dt.timedelta(days=1)


TRAIN_RANGE = (dt.date(2020, 1, 1), dt.date(2023, 12, 31))


def only_symbols(panel: DataFrame, symbols: DataFrame, limit: int = 100) -> DataFrame:
    """Keep tickers among the first ``limit`` distinct symbols (at most ``limit`` rows broadcast)."""
    kept = symbols.select(F.col("symbol").alias("Ticker")).distinct().orderBy("Ticker").limit(limit)
    return panel.join(F.broadcast(kept), "Ticker", "left_semi")
