"""Z-score normalization."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.schemas import FEATURES

# fixed value: replaces a zero standard deviation
ZERO_STD = 1e-7


@dataclass(frozen=True)
class ZScore:
    means: dict[str, float | None]
    stds: dict[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.stds[c])
                               for c in self.means})


def fit_zscore(df: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> ZScore:
    """Mean and sample deviation of each column, nulls skipped, in one aggregation.

    Run it before incomplete rows are dropped. The reference scales each split by its own
    statistics; fit on the training split and transform both to avoid that.
    """
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first()
    stds = {c: ZERO_STD if row[f"s_{c}"] == 0 else row[f"s_{c}"] for c in columns}
    return ZScore({c: row[f"m_{c}"] for c in columns}, stds)
