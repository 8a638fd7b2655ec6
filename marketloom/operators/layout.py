"""Row positions and overlapping blocks for row-based frames over long series.

A plain ``Window.partitionBy(ticker)`` puts a whole series into one task. A ticker may hold a
third of all rows, so the series operators work on bounded pieces instead:

* ``with_positions`` ranks rows inside (ticker, calendar unit) groups, whose size the bar grain
  bounds, and adds the offset of the earlier groups from a per-group summary table.
  The join is a merge join: the rows are already partitioned and sorted by its keys, and keep
  that for the windows that follow;
* ``with_blocks`` cuts a series into runs of consecutive rows and copies only the rows next to a
  cut into the neighbouring run, so a row-based frame never needs rows from another task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# calendar unit -> most bars a series can have in one unit, by bar grain
_GRAINS = {"daily": ("year", 366), "hourly": ("month", 744), "minute": ("day", 1440)}


@dataclass(frozen=True)
class Series:
    """Names of the key and time columns, and the bar grain; (key, time) is unique."""

    key: str = "Ticker"
    time: str = "Date"
    grain: str = "daily"

    @property
    def unit(self) -> str:
        return _GRAINS[self.grain][0]

    @property
    def unit_rows(self) -> int:
        return _GRAINS[self.grain][1]

    def bucket(self) -> Column:
        return F.date_trunc(self.unit, F.col(self.time)).cast("timestamp_ntz")

    def in_bucket(self):
        return Window.partitionBy(self.key, "_bucket").orderBy(self.time)


def with_positions(df: DataFrame, s: Series, value: str | None = None) -> DataFrame:
    """Add ``_bucket``, ``_rn`` (1-based row in the bucket) and ``_pos`` (0-based row in the series).

    With ``value`` also add what a gap-aware scan needs: ``_prev`` (value of the previous row),
    ``_fill`` / ``_fill_prev`` (last non-null value up to / before this row), ``_nobs`` (non-null
    values so far) and ``_gap`` (null rows since the previous non-null one).
    """
    w = s.in_bucket()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_bucket", s.bucket()).withColumn("_rn", F.row_number().over(w))
    keys = [s.key, "_bucket"]
    if value is None:
        per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(s.key).orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, -1)
        start = per.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_row0"))
        return (rows.join(start.hint("merge"), keys)
                .withColumn("_pos", F.col("_row0") + F.col("_rn") - 1).drop("_row0"))

    x = F.col(value)
    obs_rn = F.when(x.isNotNull(), F.col("_rn"))
    per = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count(x).alias("_o"), F.max_by(x, "_rn").alias("_x"),
        F.max(obs_rn).alias("_last_rn"), F.max_by(x, obs_rn).alias("_last_x"))
    order = Window.partitionBy(s.key).orderBy("_bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = (per.withColumn("_row0", F.coalesce(F.sum("_n").over(before), F.lit(0)))
             .select(*keys, "_row0",
                     F.coalesce(F.sum("_o").over(before), F.lit(0)).alias("_obs0"),
                     F.lag("_x").over(order).alias("_x0"),
                     F.last("_last_x", True).over(before).alias("_fill0"),
                     F.last(F.col("_row0") + F.col("_last_rn") - 1, True).over(before)
                     .alias("_lastpos0")))
    pos = F.col("_row0") + F.col("_rn") - 1
    last_pos = F.coalesce(F.last(F.when(x.isNotNull(), pos), True).over(earlier),
                          F.col("_lastpos0"))
    return (rows.join(start.hint("merge"), keys)
            .withColumns({
                "_pos": pos,
                "_prev": F.when(F.col("_rn") == 1, F.col("_x0")).otherwise(F.lag(x).over(w)),
                "_fill": F.coalesce(F.last(x, True).over(upto), F.col("_fill0")),
                "_fill_prev": F.coalesce(F.last(x, True).over(earlier), F.col("_fill0")),
                "_nobs": F.col("_obs0") + F.count(x).over(upto),
                "_gap": pos - last_pos - 1})
            .drop("_row0", "_obs0", "_x0", "_fill0", "_lastpos0"))


def with_blocks(df: DataFrame, back: int, ahead: int, block_rows: int = 4096) -> DataFrame:
    """Assign rows to blocks of ``block_rows`` consecutive positions, adding ``_blk`` and ``_own``.

    Rows within ``back`` of a block's end are copied to the next block and rows within ``ahead``
    of its start to the previous one (``_own`` false on copies): (back + ahead) / block_rows more
    rows, and no block larger than block_rows + back + ahead.
    """
    if max(back, ahead) > block_rows:
        raise ValueError("block_rows must be at least the frame reach")
    blk = F.floor(F.col("_pos") / block_rows)
    off = F.col("_pos") % block_rows
    places = F.array(
        F.struct(blk.alias("_blk"), F.lit(True).alias("_own")),
        F.when(off >= block_rows - back,
               F.struct((blk + 1).alias("_blk"), F.lit(False).alias("_own"))),
        F.when((off < ahead) & (blk > 0),
               F.struct((blk - 1).alias("_blk"), F.lit(False).alias("_own"))))
    return df.select("*", F.inline(F.filter(places, lambda p: p.isNotNull())))


def in_block(s: Series):
    return Window.partitionBy(s.key, "_blk").orderBy("_pos")
