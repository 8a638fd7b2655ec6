"""Article metadata, stored pages and fetch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.expressions import (
    analysis_text, fetch_status, symbol_or_default)
from marketloom.functions.html_text import html_main_text
from marketloom.operators.skew import spread_join


def valid_articles(meta: DataFrame) -> DataFrame:
    """Articles with a URL; a missing symbol becomes ``unknown``."""
    if "symbol" not in meta.columns:
        meta = meta.withColumn("symbol", F.lit(None).cast("string"))
    return (meta.where(F.col("url").isNotNull() & (F.col("url") != ""))
            .withColumn("symbol", symbol_or_default(F.col("symbol"))))


def outcome_columns(pages: DataFrame) -> DataFrame:
    """(url, http_status, error_kind, error_message, html); what ``pages`` lacks is null."""
    for name, kind in (("http_status", "int"), ("error_kind", "string"), ("error_message", "string")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return pages.select("url", "http_status", "error_kind", "error_message", "html")


def fetch_from_table(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Look every article's page up by URL instead of fetching it.

    ``pages``: one row per url with ``html`` and optionally ``http_status``, ``error_kind``,
    ``error_message``. An article without a page gets ``network_error``. A URL shared by a large
    part of the articles is spread over tasks.
    """
    page = outcome_columns(pages).withColumn("_known", F.lit(True))
    got = spread_join(articles, page, ["url"])
    kind = F.when(F.col("_known").isNull(), "network").otherwise(F.col("error_kind"))
    return got.withColumn("status", fetch_status(F.col("http_status"), kind)).drop("_known")


def processed_articles(fetched: DataFrame) -> DataFrame:
    """Fetched articles as output records: main text of successful pages, error details."""
    ok = F.col("status") == "success"
    return _records(fetched, F.when(ok, html_main_text(F.when(ok, F.col("html")))))


def _records(fetched: DataFrame, content: Column) -> DataFrame:
    return fetched.select(
        "title", "url", "author", F.coalesce(content, F.lit("")).alias("scraped_content"),
        "status",
        F.when(F.col("status") == "unexpected_exception", F.coalesce("error_message", F.lit("")))
        .otherwise("").alias("error_details"),
        "symbol")


def scrape(meta: DataFrame, pages: DataFrame) -> DataFrame:
    """Metadata -> processed articles. Texts are taken once per page some article names, before they meet
    the articles."""
    status = fetch_status(F.col("http_status"), F.col("error_kind"))
    asked = outcome_columns(pages).join(meta.select("url").distinct(), "url", "left_semi")
    texts = asked.withColumn("html", F.when(status == "success", html_main_text(
        F.when(status == "success", F.col("html")))))
    return _records(fetch_from_table(valid_articles(meta), texts), F.col("html"))


def with_analysis_text(processed: DataFrame) -> DataFrame:
    """Add ``text``: the scraped content, or the title when the status is not ``success``."""
    return processed.withColumn(
        "text", analysis_text(F.col("status"), F.col("scraped_content"), F.col("title")))


def article_symbols(processed: DataFrame) -> DataFrame:
    """Distinct symbols."""
    return processed.select(F.col("symbol").cast("string")).distinct()
