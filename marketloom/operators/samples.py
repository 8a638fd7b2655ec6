"""Positional split, incomplete rows, sliding-window samples, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.labels import class_index
from marketloom.operators.layout import Series, in_block, with_blocks, with_positions
from marketloom.schemas import FEATURES


def split_point(panel: DataFrame, fraction: float = 0.8,
                s: Series = Series()) -> tuple[str, str] | None:
    """(time, key) of the first test row, as text, when the first int(n * fraction) rows in
    (time, key) order are the training rows; None if no row is left for the test side.

    Counts narrow the search to one calendar unit, then one time, whose rows are at most one per
    key; the rows themselves are never sorted together.
    """
    n = panel.count()
    rank = int(n * fraction)
    if rank >= n:
        return None
    slot = panel.select(s.time, s.key, s.bucket().alias("_bucket"))
    at = ""
    for col in ("_bucket", s.time):
        counts = slot.groupBy(col).count()
        upto = F.sum("count").over(Window.orderBy(col))
        at, before = (counts.select(F.col(col).cast("string"), (upto - F.col("count")).alias("before"),
                                    upto.alias("upto"))
                      .where(F.col("upto") > rank).orderBy("upto").select(F.col(col), "before").first())
        slot, rank = slot.where(F.col(col) == _moment(slot, col, at)), rank - before
    keys = slot.select(s.key, F.row_number().over(Window.orderBy(s.key)).alias("_r"))
    return at, keys.where(F.col("_r") == rank + 1).first()[0]


def _moment(df: DataFrame, column: str, text: str) -> Column:
    return F.lit(text).cast(dict(df.dtypes)[column])


def split_panel(panel: DataFrame, fraction: float = 0.8, s: Series = Series()):
    """(train, test) by position: two filters on (time, key), nothing is shuffled."""
    point = split_point(panel, fraction, s)
    if point is None:
        return panel, panel.where(F.lit(False))
    t, k = _moment(panel, s.time, point[0]), F.lit(point[1])
    early = (F.col(s.time) < t) | ((F.col(s.time) == t) & (F.col(s.key) < k))
    return panel.where(early), panel.where(~early)


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value, by default over all columns (not only the features)."""
    return df.dropna("any", subset=list(columns) if columns else None)


def window_samples(df: DataFrame, s: Series = Series(), length: int = 7,
                   features: Sequence[str] = tuple(FEATURES), label: str = "signal_label",
                   include_last: bool = False) -> DataFrame:
    """Sliding windows per ticker: ``features`` (length x n) and the label of the last row.

    As in the reference the last possible window is left out (n - length windows) unless
    ``include_last``. Every window carries the (key, time) of its last row.
    """
    rows = with_positions(df.select(s.key, s.time, *features, label), s)
    rows = with_blocks(rows, back=length - 1, ahead=1)
    w = in_block(s)
    made = rows.select(
        s.key, s.time, "_pos", "_own",
        F.collect_list(F.array(*features)).over(w.rowsBetween(1 - length, 0)).alias("features"),
        F.col(label).alias("signal_label"), F.lead("_pos").over(w).alias("_next"))
    keep = F.col("_own") & (F.col("_pos") >= length - 1)
    if not include_last:
        keep = keep & F.col("_next").isNotNull()
    return made.where(keep).drop("_pos", "_own", "_next")


def as_vectors(windows: DataFrame) -> DataFrame:
    """Windows flattened for Spark ML: ``vector`` and 0-based ``label``."""
    return windows.withColumns({"vector": array_to_vector(F.flatten("features")),
                                "label": class_index(F.col("signal_label")).cast("double")})


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Random row order."""
    return df.orderBy(F.rand(seed))


def with_shuffle_rank(df: DataFrame, keys: Sequence[str | Column], seed: int = 42) -> DataFrame:
    """Add ``_rank``: 0-based position in a reproducible shuffled order.

    The order is an MD5 of the row's unique ``keys``. Its first digits spread rows evenly over up
    to 65,536 groups; ranking happens inside a group and group offsets come from a count table.
    """
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)))
    rows = rows.withColumn("_g", F.substring("_h", 1, 4))
    counts = rows.groupBy("_g").count()
    start = counts.select("_g", (F.sum("count").over(Window.orderBy("_g")) - F.col("count"))
                          .alias("_start"))
    within = F.row_number().over(Window.partitionBy("_g").orderBy("_h")) - 1
    return (rows.withColumn("_rank", within).join(start.hint("merge"), "_g")
            .withColumn("_rank", F.col("_start") + F.col("_rank")).drop("_h", "_g", "_start"))


def with_batches(df: DataFrame, keys: Sequence[str | Column], size: int = 64,
                 seed: int = 42) -> DataFrame:
    """Add ``batch_id``: consecutive runs of ``size`` rows in a reproducible shuffled order."""
    return (with_shuffle_rank(df, keys, seed)
            .withColumn("batch_id", F.floor(F.col("_rank") / size)).drop("_rank"))
