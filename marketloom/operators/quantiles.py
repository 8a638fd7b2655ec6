"""Exact quantiles of a distributed column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float],
                    limit: int = 200_000, error: float = 1e-4) -> list[float | None]:
    """Linear-interpolation quantiles, nulls and NaN skipped (as pandas ``quantile``).

    A quantile sketch brackets each wanted rank; one counting pass proves the bracket and gives
    the rank inside it; only the values strictly inside are looked at again, so repeated values at
    its ends never hold it up. Brackets narrow to a few ten-thousandths of the rows per round, and no
    task sorts more than about ``limit`` values. Give a materialized ``df``: it is read several times.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = v.count()
    if n == 0:
        return [None] * len(probs)
    out = []
    for p in probs:
        pos = p * (n - 1)
        k = math.floor(pos)
        below, above = _order_statistics(v, n, [k, min(k + 1, n - 1)], limit, error)
        out.append(below + (above - below) * (pos - k))
    return out


def _order_statistics(v: DataFrame, n: int, ranks: list[int], limit: int, error: float) -> list[float]:
    """The values at two neighbouring 0-based ranks."""
    if n <= limit:
        values = v.groupBy("v").count()
        upto = values.select("v", F.sum("count").over(Window.orderBy("v")).alias("upto"))
        return list(upto.agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))) for r in ranks]).first())
    lo, hi = v.approxQuantile("v", [max(0.0, ranks[0] / n - 2 * error),
                                    min(1.0, (ranks[1] + 1) / n + 2 * error)], error)
    x = F.col("v")
    under, at_lo, between, at_hi = v.agg(*[F.count(F.when(c, 1)) for c in (
        x < lo, x == lo, (x > lo) & (x < hi), (x == hi) & (x > lo))]).first()
    found: list[float | None] = []
    for r in ranks:
        if under <= r < under + at_lo:
            found.append(lo)
        elif under + at_lo + between <= r < under + at_lo + between + at_hi:
            found.append(hi)
        elif under <= r < under + at_lo + between:
            found.append(None)
        else:
            raise RuntimeError("the quantile sketch missed its error bound")
    if None in found:
        start = under + at_lo
        inner = [min(max(r - start, 0), between - 1) for r in ranks]
        again = _order_statistics(v.where((x > lo) & (x < hi)), between, inner, limit, error)
        found = [a if f is None else f for f, a in zip(found, again)]
    return found
