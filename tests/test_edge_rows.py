"""Rows that the driver's tables do not hold: zero prices, NaN, null texts, malformed input."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import panel_frame, to_spark
from marketloom.operators import entities, evaluation, sentiment
from marketloom.operators.indicators import add_indicators
from marketloom.operators.quantiles import exact_quantiles
from marketloom.operators.skew import spread_join
from marketloom.schemas import NEWS_PAYLOAD
from marketloom.sources import news
from marketloom.streaming import articles as stream


def test_zero_and_nan_prices(spark):
    closes = [10.0, 0.0, 5.0, math.nan, *range(6, 26)]
    panel = to_spark(spark, panel_frame({"A": closes}))
    panel = panel.withColumn("Close", F.coalesce("Close", F.lit(math.nan)))
    rows = add_indicators(panel, columns=["daily_return", "momentum", "volatility", "future_return", "sma"]).orderBy("Date").collect()
    assert rows[1].daily_return == -100.0 and rows[2].daily_return is None
    assert rows[1].future_return is None and rows[0].future_return is not None
    assert all(x is None or not math.isnan(x) for r in rows for x in r[7:])


@pytest.mark.parametrize("limit", [20, 100, 200_000])
def test_quantiles_with_nan_and_ties(spark, limit):
    values = [math.nan] * 300 + [1.0] * 400 + [float(i % 97) for i in range(500)] + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "x double").cache()
    clean = pd.Series([v for v in values if v is not None and not math.isnan(v)])
    for p in (0.0, 0.3, 0.5, 0.7, 1.0):
        assert exact_quantiles(df, "x", [p], limit=limit, error=0.01)[0] == pytest.approx(clean.quantile(p))


def test_confusion_matrix_has_every_class(spark):
    preds = spark.createDataFrame([(0, 1), (1, 1), (1, 0)], "label int, prediction int")
    assert [tuple(r) for r in evaluation.confusion_matrix(preds).collect()] == [(-1, 0, 0, 0), (0, 0, 0, 1), (1, 0, 1, 1)]


def test_null_text_has_one_answer(spark):
    docs = spark.createDataFrame([(1, None), (2, "gain")], "doc_id long, text string")
    for batched in (False, True):
        got = {r.doc_id: r for r in sentiment.document_sentiment(docs, batched=batched).collect()}
        assert tuple(got[1])[2:] == ("Neutral", 0.0, "default")


def test_every_label_and_spelling_of_a_phrase(spark):
    docs = spark.createDataFrame([(1, "They met Amazon there.")], "doc_id long, text string")
    known = spark.createDataFrame([("Amazon", "ORG"), ("Amazon", "GPE"), ("amazon", "ORG"),
                                   ("a b c d e f g h i j", "ORG")], "entity string, label string")
    got = sorted((r.entity, r.label) for r in entities.gazetteer_mentions(docs, known).collect())
    assert got == [("Amazon", "GPE"), ("Amazon", "ORG"), ("amazon", "ORG")]


def test_malformed_payloads_are_returned(spark):
    good = json.dumps({"articles": [{"title": "t", "url": "u"}]})
    df = spark.createDataFrame([(good,), ('{"articles": [{"ti',), ("[1]",), ("null",), (None,)], "payload string")
    assert [r.title for r in news.flatten_news(df).collect()] == ["t"]
    assert sorted(r.payload for r in news.bad_payloads(df, NEWS_PAYLOAD).collect()) == ["[1]", "null", '{"articles": [{"ti']


def test_stream_statuses_and_quarantine(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [json.dumps({"title": u, "url": u}) for u in "abcde"] + ["", '{"title": "cut', "null"]
    (src / "x.json").write_text("\n".join(lines))
    pages = spark.createDataFrame([("a", 200, None, "<article><p>x</p></article>"), ("b", 404, "http", ""), ("c", None, "timeout", ""),
                                   ("d", None, "boom", "")], "url string, http_status int, error_kind string, html string")
    s = stream.processed_stream(stream.article_stream(spark, str(src)), pages)
    stream.run_incremental(s, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.schema("url string, status string, error_details string, scraped_content string").json(str(tmp_path / "out")).collect()
    assert sorted((r.url or "", r.status) for r in got) == sorted([
        ("a", "success"), ("b", "http_error_404"), ("c", "timeout_error"), ("d", "unexpected_exception"),
        ("e", "network_error"), ("", "malformed_line"), ("", "malformed_line")])
    assert {r.error_details for r in got if r.status == "malformed_line"} == {'{"title": "cut', "null"}
    assert [r.scraped_content for r in got if r.url == "a"] == ["x"]


def test_equal_rows_of_a_hot_key_spread(spark):
    left = spark.range(10_000, numPartitions=16).select(F.lit("k").alias("k"), F.lit("same").alias("v"))
    right = spark.createDataFrame([("k", 1)], "k string, n int")
    got = spread_join(left, right, ["k"], rows_per_task=1_000)
    assert got.count() == 10_000 and got.columns == ["k", "v", "n"]
