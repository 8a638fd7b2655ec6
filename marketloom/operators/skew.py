"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                rows_per_task: int = 1_000_000) -> DataFrame:
    """Join many ``left`` rows per key to one ``right`` row per key, spreading hot keys.

    A key with more than ``rows_per_task`` left rows is split into as many sub-keys as it has that
    many rows, and its right row is copied to each; what is held of such keys is two numbers each
    (one key per ``rows_per_task`` rows at most). Equal rows spread by the partition they are in,
    which a task that runs again finds unchanged. Without hot keys this is a plain join.
    ``how``: inner, left or left_semi.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("how must be inner, left or left_semi")
    on = list(on)
    code = F.xxhash64(*on)
    counts = left.groupBy(code.alias("_code")).count().where(F.col("count") > rows_per_task)
    hot = [(r[0], -(-r[1] // rows_per_task)) for r in counts.collect()]
    if not hot:
        return left.join(right, on, how)
    table = F.broadcast(left.sparkSession.createDataFrame(hot, "_code long, _salts long"))
    spot = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.col("_salts"))
    many = (left.withColumn("_code", code).join(table, "_code", "left")
            .withColumn("_salt", F.coalesce(spot, F.lit(0).cast("long"))).drop("_code", "_salts"))
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    one = (right.withColumn("_code", code).join(table, "_code", "left")
           .withColumn("_salt", F.explode(copies)).drop("_code", "_salts"))
    return many.join(one, [*on, "_salt"], how).drop("_salt")


def join_dimension(left: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner",
                   max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Join to a dimension: broadcast when its rows and bytes are counted to be small, else
    ``spread_join``."""
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    rows, volume = dim.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    if rows <= max_rows and volume <= max_bytes:
        return left.join(F.broadcast(dim), list(on), how)
    return spread_join(left, dim, on, how)
