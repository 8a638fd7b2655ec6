"""Price panels, ticker dimensions and feature tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.expressions import nan_to_null
from marketloom.schemas import PRICE_PANEL, TICKER_DIM


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Date, Ticker, Close, High, Low, Open, Volume; NaN and empty fields become NULL."""
    df = (spark.read.schema(PRICE_PANEL)
          .options(header=True, dateFormat="yyyy-MM-dd", nanValue="NaN", enforceSchema=False)
          .csv(path))
    return nan_to_null(df)


def read_ticker_csv(spark: SparkSession, path: str) -> DataFrame:
    """Symbol, sector and sub-industry of the listed companies."""
    return spark.read.schema(TICKER_DIM).options(header=True, enforceSchema=False).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One header per file; written by all tasks in parallel, without an index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_panel(df: DataFrame, path: str, mode: str = "overwrite", by_year: bool = False) -> None:
    """Parquet, optionally in one directory per year so that date ranges skip files."""
    writer = df.withColumn("year", F.year("Date")).write.partitionBy("year") if by_year else df.write
    writer.mode(mode).parquet(path)
