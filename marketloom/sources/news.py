"""News payloads and article JSON lines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.schemas import NEWS_PAYLOAD, SYMBOL_NEWS_PAYLOAD


def bad_payloads(payloads: DataFrame, schema: T.DataType, payload: str = "payload") -> DataFrame:
    """The payloads that are no JSON record of ``schema``, to be kept aside; a null one is none."""
    p = F.col(payload)
    return payloads.where(p.isNotNull() & (F.from_json(p, schema).isNull() | ~p.rlike(r"^\s*\{")
                                           | F.get_json_object(p, "$").isNull()))


def flatten_news(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row (title, author, url) per non-empty article of the general news payloads (JSON).

    Payloads that do not parse yield nothing here; ``bad_payloads`` returns them."""
    a = F.col("article")
    empty = a.isNull() | (F.to_json(a) == "{}")
    return (payloads.select(F.explode(F.from_json(payload, NEWS_PAYLOAD)["articles"]).alias("article"))
            .where(~empty).select("article.title", "article.author", "article.url"))


def flatten_symbol_news(payloads: DataFrame, payload: str = "payload", mode: str = "all") -> DataFrame:
    """One row (title, author, url, symbol) per item of the per-symbol payloads (JSON).

    ``mode="last"`` keeps only the last item of each symbol, which is what the reference writes;
    a symbol without items yields nothing in either mode.
    """
    if mode not in ("all", "last"):
        raise ValueError("mode must be all or last")
    by_symbol = payloads.select(
        F.explode(F.from_json(payload, SYMBOL_NEWS_PAYLOAD)).alias("symbol", "items"))
    items: Column = F.col("items")
    if mode == "last":
        items = F.slice(items, F.greatest(F.size(items), F.lit(1)), 1)
    return (by_symbol.select("symbol", F.explode(items).alias("item"))
            .select(F.col("item.content.title").alias("title"),
                    F.col("item.content.provider.displayName").alias("author"),
                    F.col("item.content.canonicalUrl.url").alias("url"), "symbol"))


class JsonLines(NamedTuple):
    good: DataFrame
    bad: DataFrame      # the lines that are not records, as ``line``


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> JsonLines:
    """Records and quarantined lines. Blank lines are skipped; optional keys become NULL."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.col("line").rlike(r"\S"))
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    record = F.from_json("line", full, {"mode": "PERMISSIVE",
                                        "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.withColumn("_r", record)
    ok = F.col("_r").isNotNull() & F.col("_r._corrupt_record").isNull() & F.col("line").rlike(r"^\s*\{")
    return JsonLines(parsed.where(ok).select("_r.*").drop("_corrupt_record"),
                     parsed.where(~ok).select("line"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text in a ``value`` column."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
