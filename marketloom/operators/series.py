"""Row-wise scans over long series: one sorted range partitioning, states carried across its cuts.

A table is range-partitioned by (key, time), so a series of any length is spread evenly and a part
holds whole or cut series in order. Three streams run over the parts: the first writes them, with their number;
the second reduces each run at a cut to a few numbers; the last computes. What a run needs from
the parts before and after it is joined on the driver, two rows a part. All streams hold one batch of rows and the reach of the frames, never a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

PART = "_part"


def sorted_parts(df: DataFrame, key: str, time: str) -> DataFrame:
    """``df`` written in (key, time) order with the number of its range partition as ``_part``."""
    order = [F.col(key).asc_nulls_first(), F.col(time).asc_nulls_first()]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn(PART, F.spark_partition_id()), "series")


def streamed(parts: DataFrame, key: str, time: str) -> DataFrame:
    """The parts again as sorted streams, several to a task."""
    return parts.repartition(PART).sortWithinPartitions(PART, F.col(key).asc_nulls_first(), F.col(time).asc_nulls_first())


@dataclass
class Run:
    """Consecutive rows of one series in one part. ``ahead`` are rows of the series behind them in the part."""

    rows: pa.Table
    key: Any
    part: int
    first: bool     # the series has no earlier row in this part
    ends_part: bool  # no other series follows in the part, and all its rows are read
    opens_part: bool  # the part begins with this series
    ahead: pa.Table


def runs(batches: Iterator[pa.RecordBatch], key: str, ahead: int) -> Iterator[Run]:
    """The series of sorted streams, piece by piece; a piece is held back until ``ahead`` rows behind it are known."""
    held: pa.Table | None = None
    seen: tuple | None = None       # (part, key) of the last piece
    opened: int | None = None       # the part whose first series is at hand

    def pieces(t: pa.Table, more: bool) -> Iterator[Run]:
        nonlocal held, seen, opened
        part = t[PART].to_numpy()
        code = t[key].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(code) != 0)) + 1).tolist(), t.num_rows]
        for at, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            last = hi == t.num_rows
            upto = max(lo, hi - ahead) if last and more else hi
            name, number = t[key][lo].as_py(), int(part[lo])
            if upto > lo:
                first = seen != (number, name)
                if first:
                    opens = opened != number
                    opened = number
                    state["opens"] = opens
                seen = (number, name)
                closes = upto == hi and (last or part[hi] != number)
                yield Run(t.slice(lo, upto - lo), name, number, first, closes, state["opens"], t.slice(upto, hi - upto))
            if last:
                held = t.slice(upto) if more else None

    state = {"opens": False}
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows > ahead:
            yield from pieces(held, True)
    if held is not None and held.num_rows:
        yield from pieces(held, False)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles, NaN for nulls."""
    return column.cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False).astype(float)


def affine(a: np.ndarray, b: np.ndarray, start: float = 0.0) -> np.ndarray:
    """y[t] = a[t] * y[t - 1] + b[t] from ``start``, by running products over short stretches."""
    out = np.empty(len(a))
    cuts = np.unique(np.concatenate([np.arange(0, len(a), 64), np.flatnonzero(a < 1e-3)])).tolist()
    y = start
    for lo, hi in zip(cuts, [*cuts[1:], len(a)]):
        out[lo] = y = a[lo] * y + b[lo]
        if hi > lo + 1:
            p = np.cumprod(a[lo + 1:hi])
            out[lo + 1:hi] = p * (y + np.cumsum(b[lo + 1:hi] / p))
            y = out[hi - 1]
    return out


def windows(x: np.ndarray, before: np.ndarray, n: int, use: Callable[..., np.ndarray]) -> np.ndarray:
    """``use`` over each row and the n - 1 rows before it; NaN where one of them is missing."""
    full = np.concatenate([np.full(max(0, n - 1 - len(before)), np.nan), before[len(before) - min(len(before), n - 1):], x])
    return use(np.lib.stride_tricks.sliding_window_view(full, n))


def joined(tail: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` values of ``tail`` followed by ``x``."""
    both = np.concatenate([tail, x])
    return both[max(0, len(both) - n):]
