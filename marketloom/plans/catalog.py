"""Registered queries: name -> function of (session, folder of Parquet tables).

Two price panels are built from the tables: daily bars of ``lineitem`` (ticker = brand, price =
extended price per unit) and hourly bars of ``events`` (ticker = event type). News inputs (fetch
results, payloads, JSON lines) are derived row by row from ``documents`` and ``pages``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import chunking, lexicon
from marketloom.functions.expressions import (
    analysis_text, day_string, days_before, strip, ticker_text)
from marketloom.functions.html_text import html_main_text
from marketloom.operators import (
    articles, bars, classifiers, entities, evaluation, linking, samples, sentiment, training)
from marketloom.operators.indicators import add_indicators, indicator_states
from marketloom.operators.labels import add_signal_label, class_index, fit_thresholds
from marketloom.operators.layout import Series
from marketloom.operators.skew import join_dimension
from marketloom.plans import pipeline
from marketloom.schemas import (
    ARTICLE_META, FEATURES, FIELDS, INDICATORS, NEWS_PAYLOAD, SYMBOL_NEWS_PAYLOAD)
from marketloom.session import materialize, scratch_path
from marketloom.sources import models, news, prices
from marketloom.streaming import articles as stream

Query = Callable[[SparkSession, str], DataFrame]

DAILY = Series()
HOURLY = Series(grain="hourly")

# Frequent words of the synthetic documents, standing in for a tone lexicon and for keywords
# (the bundled finance words hardly occur in invented prose).
TONE = lexicon.LexiconScorer(positive=("the", "de", "to", "der", "la"),
                             negative=("of", "and", "en", "die", "que"))
KEYWORDS = [*lexicon.FINANCE_KEYWORDS, "with", "avec", "und", "from"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


# ---------------------------------------------------------------- panels

def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, folder, "lineitem").withColumn("l_price", F.col("l_extendedprice").cast("decimal(15,2)"))
    ticks = join_dimension(lines, part, ["l_partkey"])
    return bars.ohlcv(
        ticks, F.col("p_brand"), F.to_date("l_shipdate"),
        F.col("l_extendedprice") / F.col("l_quantity"),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_price"],
        F.col("l_quantity"))


def hourly_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars.ohlcv(table(spark, folder, "events"), F.col("event_type"),
                      F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts")),
                      F.col("value"),
                      ["ts", "event_id"])


def daily_panel(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(daily_bars(spark, folder), "bars")


def bars_query(build: Query, spark: SparkSession, folder: str) -> DataFrame:
    return rounded(build(spark, folder).select("Date", "Ticker", *FIELDS), 8)


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "prices")
    prices.write_csv(daily_bars(spark, folder).select("Date", "Ticker", *FIELDS), path)
    return rounded(prices.read_price_csv(spark, path), 8)


def wide_to_long(spark: SparkSession, folder: str) -> DataFrame:
    panel = hourly_bars(spark, folder)
    names = sorted(r[0] for r in panel.select("Ticker").distinct().limit(bars.WIDE_TICKERS + 1).collect())
    return rounded(bars.wide_to_long(bars.long_to_wide(panel, names)), 8)


def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    panel = materialize(hourly_bars(spark, folder), "bars")
    return rounded(classifiers.one_hot(panel.select("Date", "Ticker", "Close")), 8)


def date_range(spark: SparkSession, folder: str) -> DataFrame:
    start, end = bars.recent_range(dt.date(1998, 12, 1))
    return rounded(bars.date_range(daily_bars(spark, folder), start, end)
                   .select("Date", "Ticker", "Close"), 8)


def ticker_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    symbols = articles.article_symbols(docs.select(
        F.concat(F.lit("Brand#"), F.substring("source", 4, 10)).alias("symbol")))
    return rounded(bars.only_symbols(daily_bars(spark, folder), symbols)
                   .select("Date", "Ticker", "Close"), 8)


# ---------------------------------------------------------------- indicators and labels

def indicator_query(columns: list[str], digits: int, spark: SparkSession, folder: str) -> DataFrame:
    made = add_indicators(daily_panel(spark, folder), DAILY, columns=columns)
    return rounded(made.select("Date", "Ticker", *columns), digits)


def indicators_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators of the later half of the days, from states saved after the earlier half."""
    panel = daily_panel(spark, folder)
    cut = F.lit(dt.date(1995, 6, 17))
    states = materialize(indicator_states(panel.where(F.col("Date") < cut), DAILY), "states")
    columns = ["ema", "sma", "rsi", "macd", "macd_signal", "macd_diff", "daily_return", "volatility"]
    made = add_indicators(panel.where(F.col("Date") >= cut), DAILY, columns=columns, states=states)
    return rounded(made.select("Date", "Ticker", *columns), 4)


def indicators_hourly(spark: SparkSession, folder: str) -> DataFrame:
    panel = materialize(hourly_bars(spark, folder), "bars")
    return rounded(add_indicators(panel, HOURLY).select("Date", "Ticker", *INDICATORS), 4)


def features(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.labelled_features(daily_panel(spark, folder), DAILY).features


def signal_labels(spark: SparkSession, folder: str) -> DataFrame:
    # only the forward return is needed, not the other indicators
    panel = materialize(add_indicators(daily_panel(spark, folder), DAILY,
                                       columns=["future_return"]), "returns")
    return rounded(add_signal_label(panel, fit_thresholds(panel))
                   .select("Date", "Ticker", "future_return", "signal_label"))


def thresholds(spark: SparkSession, folder: str) -> DataFrame:
    panel = materialize(add_indicators(daily_panel(spark, folder), DAILY,
                                       columns=["future_return"]), "returns")
    t = fit_thresholds(panel)
    return panel.agg(F.round(F.lit(t.lower), 6).alias("lower"), F.round(F.lit(t.upper), 6).alias("upper"),
                     F.count("future_return").alias("n"))


def zscore(stats_from: str, spark: SparkSession, folder: str) -> DataFrame:
    sides = pipeline.scaled_splits(features(spark, folder), DAILY, stats_from=stats_from)
    both = (sides.train.withColumn("side", F.lit("train"))
            .unionByName(sides.test.withColumn("side", F.lit("test"))))
    return rounded(both.select("Date", "Ticker", "side", *FEATURES), 4)


def time_split(spark: SparkSession, folder: str) -> DataFrame:
    train, test = samples.split_panel(daily_panel(spark, folder), 0.8, DAILY)
    return (train.select("Date", "Ticker", F.lit("train").alias("side"))
            .unionByName(test.select("Date", "Ticker", F.lit("test").alias("side"))))


def complete(spark: SparkSession, folder: str) -> DataFrame:
    return samples.complete_rows(features(spark, folder)).select("Date", "Ticker", "signal_label")


def window_samples(spark: SparkSession, folder: str) -> DataFrame:
    sides = pipeline.split_windows(features(spark, folder), DAILY)
    both = (sides.train.withColumn("side", F.lit("train"))
            .unionByName(sides.test.withColumn("side", F.lit("test"))))
    flat = F.flatten("features")
    return rounded(both.select(
        "Date", "Ticker", "side", "signal_label", F.size(flat).alias("n_values"),
        flat[0].alias("first_close"), flat[78].alias("last_close"),
        F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


# ---------------------------------------------------------------- evaluation

def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Truth = signal label; class scores = softmax of (-m, 0, m) for momentum m."""
    panel = materialize(add_indicators(daily_panel(spark, folder), DAILY,
                                       columns=["future_return", "momentum"]), "returns")
    m = F.col("momentum")
    # softmax shifted by its largest term; rounded so that equal scores stay equal in every engine
    top, mid, low = F.lit(1.0), F.exp(-F.abs(m)), F.exp(-2 * F.abs(m))
    total = top + mid + low
    return materialize(
        add_signal_label(panel, fit_thresholds(panel)).where(m.isNotNull())
        .select("Date", "Ticker", F.col("signal_label").alias("label"),
                F.signum(m).cast("int").alias("prediction"),
                F.round(F.when(m < 0, top).otherwise(low) / total, 9).alias("p0"),
                F.round(mid / total, 9).alias("p1"),
                F.round(F.when(m < 0, low).otherwise(top) / total, 9).alias("p2")), "predictions")


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.prediction_distribution(predictions(spark, folder))


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion_matrix(predictions(spark, folder)).select(
        "label", F.col("pred_-1").alias("pred_down"), F.col("pred_0").alias("pred_flat"),
        F.col("pred_1").alias("pred_up"))


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluation.class_report(predictions(spark, folder)))


def auc_ovo(spark: SparkSession, folder: str) -> DataFrame:
    p = predictions(spark, folder).withColumn("y", class_index(F.col("label")))
    return rounded(evaluation.auc_one_vs_one(p, "y", ["p0", "p1", "p2"]))


def eval_batches(spark: SparkSession, folder: str) -> DataFrame:
    p = predictions(spark, folder).select(
        "Date", "Ticker", class_index(F.col("label")).alias("label"),
        class_index(F.col("prediction")).alias("prediction"),
        F.array("p0", "p1", "p2").alias("probability"))
    return evaluation.batch_metrics(samples.with_batches(p, ["Ticker", "Date"]))


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluation.evaluation_summary(eval_batches(spark, folder)))


# ---------------------------------------------------------------- classifiers

FOREST_INPUTS = [*FEATURES, "High", "Low"]


def _train_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """All rows of both sides with the forest's inputs (missing values 0, tickers as 0/1 columns), and their names."""
    keep = ["signal_label", "Ticker", "Date"]
    train, test = [classifiers.one_hot(classifiers.align_columns(x, FOREST_INPUTS, keep=keep).withColumn("_t", F.col("Ticker")), "_t")
                   for x in samples.split_panel(features(spark, folder), 0.8, DAILY)]
    train = materialize(train, "train")
    return train, test, [c for c in train.columns if c not in keep]


def train_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Fit on training windows, save, load, evaluate on test windows."""
    done = pipeline.train_and_evaluate(daily_panel(spark, folder), DAILY, stats_from="train",
                                       kind="logistic", max_iter=30)
    path = scratch_path(spark, "model")
    models.save_model(done.model, path)
    again = pipeline.evaluate(models.load_model(path), done.predictions.select(
        "Date", "Ticker", "features", "signal_label"), DAILY)
    return rounded(again.summary)


def _train_shards(spark: SparkSession, folder: str) -> DataFrame:
    sides = pipeline.split_windows(features(spark, folder), DAILY, stats_from="train")
    return training.pack(materialize(sides.train, "windows"), ["Ticker", "Date"])


NETWORK = training.Network((91, 64, 3))


def train_network(spark: SparkSession, folder: str) -> DataFrame:
    """Loss and accuracy of every epoch of the perceptron on the training windows."""
    done = training.train_network(_train_shards(spark, folder), NETWORK)
    return rounded(spark.createDataFrame(done.history, "epoch int, loss double, accuracy double"))


def train_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Four epochs at once against two and, from the saved state, two more: epochs, parameters that differ,
    training rows, and whether the loss fell."""
    shards = _train_shards(spark, folder)
    path = scratch_path(spark, "network")
    once = training.train_network(shards, NETWORK, epochs=4)
    training.train_network(shards, NETWORK, epochs=2, path=path)
    again = training.train_network(shards, NETWORK, epochs=4, path=path)
    differ = int((once.weights != again.weights).sum() + (once.second != again.second).sum())
    falls = all(a[1] > b[1] for a, b in zip(again.history, again.history[1:]))
    rows = shards.agg(F.sum(F.length("y") / 8).cast("long").alias("rows"))
    return rows.select(F.lit(len(again.history)).alias("epochs"), F.lit(differ).alias("differ"), "rows", F.lit(falls).alias("falls"))


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows of each label, and how many a reloaded model predicts otherwise than the fitted one."""
    done = pipeline.train_and_evaluate(daily_panel(spark, folder), DAILY, stats_from="train", kind="logistic")
    path = scratch_path(spark, "model")
    models.save_model(done.model, path)
    first = materialize(done.predictions, "predictions")
    again = classifiers.predict_windows(models.load_model(path), first.select("Date", "Ticker", "features", "signal_label"))
    again = again.select("Date", "Ticker", F.col("prediction").alias("other"), F.col("probability").alias("others"))
    far = F.exists(F.zip_with("probability", "others", lambda a, b: F.abs(a - b)), lambda d: d > 1e-12)
    return first.join(again, ["Date", "Ticker"], "left").groupBy("signal_label").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.coalesce((F.col("prediction") != F.col("other")) | far, F.lit(True)), 1)).alias("mismatches"))


def train_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced forest on single rows; report on the test rows."""
    train, test, inputs = _train_rows(spark, folder)
    model = classifiers.fit_forest(train, inputs, trees=20, depth=8)
    preds = classifiers.predict_rows(model, test, inputs, keep=["signal_label"])
    return rounded(evaluation.class_report(preds.withColumnRenamed("signal_label", "label")))


def forest_support(spark: SparkSession, folder: str) -> DataFrame:
    """Rows predicted for each true label of the test side, and the columns the forest was given; a model that is
    saved and loaded, and new rows without some of the columns, go through the same path."""
    train, test, inputs = _train_rows(spark, folder)
    path = scratch_path(spark, "forest")
    models.save_model(classifiers.fit_forest(train, inputs, trees=10, depth=5), path)
    model = models.load_model(path)
    preds = classifiers.predict_rows(model, test.drop("High", inputs[-1]), inputs, keep=["signal_label"])
    ok = F.col("prediction").isin(-1, 0, 1) & (F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9)
    return preds.groupBy("signal_label").agg(F.count(F.lit(1)).alias("support"), F.count(F.when(ok, 1)).alias("valid")).withColumn(
        "inputs", F.lit(len(inputs)))


def tune_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-validated accuracy of each grid point (a small grid)."""
    train, _, inputs = _train_rows(spark, folder)
    cv = classifiers.tune_forest(train, inputs, trees=[10], depths=[3, 5], leaves=[1, 3])
    rows = [(i, float(x)) for i, x in enumerate(cv.avgMetrics)]
    return rounded(spark.createDataFrame(rows, "grid_point int, accuracy double"))


def smote(spark: SparkSession, folder: str) -> DataFrame:
    """Class sizes after oversampling, and how many new rows lie off the segment of a row and its neighbour."""
    train, _, _ = _train_rows(spark, folder)
    grown = classifiers.smote(train, ["Ticker", "Date"], FEATURES, trace=True)
    a, b, v = F.col("ends")[0], F.col("ends")[1], F.array(*FEATURES)
    # a point of the segment has equal shares of every coordinate's difference
    off = F.exists(F.arrays_zip(a.alias("a"), b.alias("b"), v.alias("v")), lambda x: (
        (x["v"] < F.least(x["a"], x["b"]) - 1e-9 * F.abs(x["a"])) | (x["v"] > F.greatest(x["a"], x["b"]) + 1e-9 * F.abs(x["a"]))))
    return grown.groupBy("signal_label").agg(
        F.count(F.lit(1)).alias("n"), F.count("ends").alias("made"),
        F.count(F.when(off, 1)).alias("outside"))


def smote_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each class that a cross-validated forest is fitted on in each of three folds, after oversampling,
    and the rows it is judged on. All rows take part: missing features count as 0."""
    sides = samples.split_panel(features(spark, folder), 0.8, DAILY)
    keys = ["Ticker", "Date"]
    rows = classifiers.align_columns(sides[0], FEATURES, keep=["signal_label", *keys])
    rows = materialize(classifiers.with_folds(rows, keys), "folds")
    forest, out = classifiers.SmoteForest(keys, FEATURES), []
    for fold in range(3):
        grown = forest.grown(rows.where(F.col("fold") != fold)).groupBy((F.col("label") - 1).cast("int").alias("signal_label")).agg(
            F.count(F.lit(1)).alias("fitted"))
        held = rows.where(F.col("fold") == fold).groupBy("signal_label").agg(F.count(F.lit(1)).alias("judged"))
        out.append(grown.join(held, "signal_label", "left").select(F.lit(fold).alias("fold"), "signal_label", "fitted", "judged"))
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---------------------------------------------------------------- news

def document_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an article: title = first line, author = source, the url of a page.

    The urls of very short documents are blank, those of one source missing, and those of one
    language belong to no stored page.
    """
    docs = table(spark, folder, "documents")
    pages = table(spark, folder, "pages")
    n = pages.count()
    url = pages.select(F.col("page_id").alias("_page"), "url")
    return (join_dimension(docs.withColumn("_page", F.col("doc_id") % F.lit(n)), url, ["_page"], "left")
            .select("doc_id", F.substring_index("text", "\n", 1).alias("title"),
                    F.col("source").alias("author"),
                    F.when(F.col("n_chars") < 150, "").when(F.col("source") == "src7", None)
                    .when(F.col("lang") == "es", F.concat("url", F.lit("&unknown")))
                    .otherwise(F.col("url")).alias("url"),
                    F.when(F.col("lang") != "en", F.col("lang")).alias("symbol")))


def fetch_results(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pages with a fetch outcome read off their url."""
    u = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", "url", "html",
        F.when(u.contains("#"), None).when(u.contains("page="), 404).when(u.contains("//m."), 503)
        .otherwise(200).cast("int").alias("http_status"),
        F.when(u.contains("#"), "timeout").when(u.contains("page="), "http")
        .when(u.contains("//m."), None).when(u.contains("//blog."), "network")
        .when(u.contains(".org/"), "other").alias("error_kind"),
        F.concat(F.lit("error on page "), F.col("page_id").cast("string")).alias("error_message"))


def _with_bad(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Records and quarantined payloads (as title) told apart by ``kind``."""
    return good.withColumn("kind", F.lit("good")).unionByName(
        bad.select(F.col("payload").alias("title"), F.lit("bad").alias("kind")), allowMissingColumns=True)


def news_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """One payload per document holding the article, a null element and an empty one, and one that is
    cut off."""
    a = document_articles(spark, folder)
    article = F.to_json(F.struct("title", "author", "url"), {"ignoreNullFields": "false"})
    payload = F.concat(F.lit('{"status":"ok","totalResults":3,"articles":['), article,
                       F.lit(",null,{}]}"))
    cut = F.concat(F.lit('{"status":"ok","articles":[{"title": "'), F.col("doc_id").cast("string"))
    both = a.select(F.explode(F.array(payload, cut)).alias("payload"))
    return _with_bad(news.flatten_news(both), news.bad_payloads(both, NEWS_PAYLOAD))


def symbol_news(mode: str, spark: SparkSession, folder: str) -> DataFrame:
    """One payload per document: its source with one item per sentence, and a symbol without any;
    and one payload that is cut off."""
    docs = table(spark, folder, "documents")
    item = F.transform(lexicon.sentences(F.col("text")), lambda s: F.struct(F.struct(
        s.alias("title"),
        F.struct(F.concat(F.lit("http://news.example.com/"), F.col("doc_id").cast("string")).alias("url"))
        .alias("canonicalUrl"),
        F.struct(F.col("lang").alias("displayName")).alias("provider")).alias("content")))
    payload = F.to_json(F.map_from_arrays(
        F.array(F.col("source"), F.lit("none")), F.array(item, F.filter(item, lambda i: F.lit(False)))))
    cut = F.concat(F.lit('{"none": [{"content": {"title": "'), F.col("doc_id").cast("string"))
    both = docs.select(F.explode(F.array(payload, cut)).alias("payload"))
    return _with_bad(news.flatten_symbol_news(both, mode=mode), news.bad_payloads(both, SYMBOL_NEWS_PAYLOAD))


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Articles written as JSON lines among blank, null and cut-off lines, and read back."""
    a = document_articles(spark, folder).drop("doc_id")
    record = F.to_json(F.struct(*ARTICLE_META.names))
    lines = F.array(record, F.lit(""), F.lit("null"), F.concat(F.lit('{"title": '), F.col("author")))
    path = scratch_path(spark, "lines")
    a.select(F.explode(lines).alias("value")).write.text(path)
    good, bad = news.read_json_lines(spark, path, ARTICLE_META)
    return good.select("title", "author", "url", "symbol", F.lit("good").alias("kind")).unionByName(
        bad.select(F.col("line").alias("title"), F.lit(None).cast("string").alias("author"),
                   F.lit(None).cast("string").alias("url"),
                   F.lit(None).cast("string").alias("symbol"), F.lit("bad").alias("kind")))


def article_status(spark: SparkSession, folder: str) -> DataFrame:
    a = articles.valid_articles(document_articles(spark, folder))
    return articles.fetch_from_table(a, fetch_results(spark, folder)).select(
        "doc_id", "url", "symbol", "status")


def article_text(spark: SparkSession, folder: str) -> DataFrame:
    a = articles.valid_articles(document_articles(spark, folder))
    f = articles.fetch_from_table(a, fetch_results(spark, folder))
    return f.select("doc_id", analysis_text(F.col("status"), F.col("html"), F.col("title")).alias("text"))


def scraped_articles(spark: SparkSession, folder: str) -> DataFrame:
    return articles.scrape(document_articles(spark, folder).drop("doc_id"),
                           fetch_results(spark, folder))


def news_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    report = pipeline.news_report(document_articles(spark, folder).drop("doc_id"),
                                  fetch_results(spark, folder), TONE)
    return rounded(report.sentiment)


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", html_main_text("html").alias("content"))


def incremental_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of files through one checkpoint, with a rerun that must add nothing."""
    meta = document_articles(spark, folder).drop("doc_id")
    pages = stream.extract_pages(fetch_results(spark, folder), scratch_path(spark, "page-texts"))
    src, out, ckpt = (scratch_path(spark, n) for n in ("incoming", "processed", "progress"))
    for _ in range(2):
        news.write_json_lines(meta, src, mode="append")
        meta.select(F.concat(F.lit('{"title": '), F.col("author")).alias("value")).write.mode(
            "append").text(src)
        for _ in range(2):
            s = stream.processed_stream(stream.article_stream(spark, src), pages)
            stream.run_incremental(s, out, ckpt).awaitTermination()
    done = spark.read.schema("url string, status string, symbol string").json(out)
    return done.groupBy("status", "symbol").agg(F.count(F.lit(1)).alias("n"))


def incremental_state(spark: SparkSession, folder: str) -> DataFrame:
    """The same articles delivered three times in different files: each comes out once."""
    meta = document_articles(spark, folder).drop("doc_id")
    pages = stream.extract_pages(fetch_results(spark, folder), scratch_path(spark, "page-texts"))
    src, out, ckpt = (scratch_path(spark, n) for n in ("incoming", "processed", "progress"))
    for _ in range(3):
        news.write_json_lines(meta, src, mode="append")
        s = stream.processed_stream(stream.once(stream.article_stream(spark, src)), pages)
        stream.run_incremental(s, out, ckpt).awaitTermination()
    done = spark.read.schema("title string, url string, author string, status string, symbol string, scraped_content string").json(out)
    return done.select("title", "url", "author", "status", "symbol", F.length("scraped_content").alias("size"))


# ---------------------------------------------------------------- text

def chunks_fixed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", chunking.is_long(F.col("text")).alias("is_long"),
                       F.posexplode(chunking.fixed_chunks(F.col("text"))).alias("pos", "chunk"))


def chunks_recursive(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.posexplode(chunking.recursive_chunks()(F.col("text")))
                       .alias("pos", "chunk"))


def chunk_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What recursive chunks must obey, by document: none too long, all pieces of the text in order, and the text's
    beginning and end among them."""
    docs = table(spark, folder, "documents").select("doc_id", "text", chunking.recursive_chunks()(F.col("text")).alias("c"))
    own = strip(F.col("text"))
    places = F.transform("c", lambda x: F.call_function("instr", F.col("text"), x))
    return docs.select(
        "doc_id", F.size(F.filter("c", lambda x: F.length(x) > chunking.CHUNK_SIZE)).alias("too_long"),
        F.size(F.filter(places, lambda p: p == 0)).alias("foreign"),
        (F.size("c") == 0).alias("none"),
        F.coalesce(own.startswith(F.get("c", F.lit(0))), F.lit(True)).alias("starts"),
        F.coalesce(own.endswith(F.get("c", F.size("c") - 1)), F.lit(True)).alias("ends"))


def doc_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    scored = sentiment.document_sentiment(table(spark, folder, "documents"), scorer=TONE,
                                          splitter=chunking.fixed_chunks)
    return rounded(scored.select("doc_id", "label", "score", "details"))


def doc_sentiment_recursive(spark: SparkSession, folder: str) -> DataFrame:
    scored = sentiment.document_sentiment(table(spark, folder, "documents"), scorer=TONE)
    return rounded(scored.select("doc_id", "label", "score", "details"))


def chunk_rows_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as a chunk of its conversation."""
    turns = table(spark, folder, "conversations").select("conv_id", TONE(F.col("text")).alias("_s"))
    return rounded(sentiment.aggregate_chunk_rows(turns.select("conv_id", "_s.*"), "conv_id"))


def finance_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return entities.finance_sentences(table(spark, folder, "documents"), keywords=KEYWORDS)


# ---------------------------------------------------------------- entities and links

def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct word and pair of neighbouring words in ``benchmark``, labelled by its length."""
    label = F.array(*[F.lit(x) for x in [*entities.ENTITY_LABELS, "DATE", "NORP"]])
    own = lexicon.words(F.col("text"))
    pairs = F.zip_with(own, F.slice(own, F.lit(2), F.size(own)), lambda a, b: F.concat(a, F.lit(" "), b))
    return (table(spark, folder, "benchmark").select(F.explode(F.concat(own, pairs)).alias("entity"))
            .where("entity is not null").distinct()
            .withColumn("label", F.element_at(label, F.length("entity") % 7 + 1)))


def mentions(spark: SparkSession, folder: str, find=entities.gazetteer_mentions) -> DataFrame:
    g = materialize(gazetteer(spark, folder), "gazetteer")
    return find(table(spark, folder, "documents"), g)


def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return entities.financial_mentions(mentions(spark, folder)).select(
        "doc_id", "pos", "entity", "label")


def org_entities(spark: SparkSession, folder: str) -> DataFrame:
    return entities.org_entities(mentions(spark, folder))


def entity_sentences(spark: SparkSession, folder: str) -> DataFrame:
    found = mentions(spark, folder, entities.mentioned_documents)
    made = entities.entity_sentences(entities.financial_mentions(found))
    return made.select("doc_id", "entity", F.size("sentences").alias("n"),
                       F.array_join("sentences", "\n").alias("sentences"))


def entity_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    found = mentions(spark, folder, entities.mentioned_documents)
    return rounded(entities.entity_sentiment(entities.financial_mentions(found), TONE))


def ticker_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each label, one row per dimension."""
    made = entities.mean_embedding(table(spark, folder, "embeddings"), "label")
    return rounded(made.select("label", F.posexplode("embedding").alias("pos", "value")))


def nearest_ticker(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector linked to the nearest of the label means."""
    vectors = table(spark, folder, "embeddings")
    tickers = entities.mean_embedding(vectors, "label").select(
        F.col("label").alias("c_id"), F.col("embedding").alias("c_value"))
    queries = vectors.select(F.col("vec_id").alias("q_id"),
                             F.transform("embedding", lambda x: x.cast("double")).alias("q_value"))
    return rounded(linking.link_vectors(queries, tickers, k=1).select(
        F.col("q_id").alias("vec_id"), F.col("c_id").alias("ticker"), "score"))


def fuzzy_names(spark: SparkSession, folder: str) -> DataFrame:
    """Part names against titles of another word order: '<type> <noun>, <adjective>'."""
    part = table(spark, folder, "part")
    names = part.select(F.col("p_name").alias("name")).distinct()
    word = F.split("p_name", " ")
    titles = part.select(F.concat(F.lower("p_type"), F.lit(" "), word[1], F.lit(", "), word[0])
                         .alias("title")).distinct()
    return linking.link_names(names, titles, k=5).select("name", "title", "score", "rank")


def doc_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the mean chunk vector of each document that are not zero."""
    made = entities.embed_documents(table(spark, folder, "documents"), dim=64)
    return rounded(made.select("doc_id", F.posexplode("embedding").alias("pos", "value"))).where("value <> 0")


def learned_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each language, and those with a vector of unit length, by word vectors learned from all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    made = entities.word_vectors(docs, dim=32)(docs)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return made.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(norm - 1) < 1e-6, 1)).alias("unit"),
                                    F.count(F.when(norm == 0, 1)).alias("zero"), F.max(F.size("embedding")).alias("dim"))


def entity_tickers(spark: SparkSession, folder: str) -> DataFrame:
    """Organisations linked to the nearest ticker of a ticker CSV, made of the parts."""
    path = scratch_path(spark, "tickers")
    prices.write_csv(table(spark, folder, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("Symbol"), F.col("p_type").alias("GICS Sector"),
        F.col("p_name").alias("GICS Sub-Industry")), path)
    m = materialize(entities.financial_mentions(mentions(spark, folder)).select("doc_id", "entity", "label"), "mentions")
    links = entities.link_tickers(m, prices.read_ticker_csv(spark, path))
    return rounded(entities.entity_records(m, materialize(links, "links")), 9)


def ticker_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The ticker CSV as read: one row per part, with missing and quoted fields."""
    path = scratch_path(spark, "tickers")
    prices.write_csv(table(spark, folder, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("Symbol"),
        F.when(F.col("p_partkey") % 7 > 0, F.concat(F.col("p_type"), F.lit(', "'), F.col("p_brand"), F.lit('"'))).alias("GICS Sector"),
        F.col("p_name").alias("GICS Sub-Industry")), path)
    return prices.read_ticker_csv(spark, path).toDF("symbol", "sector", "sub_industry")


def ticker_texts(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(ticker_text(F.col("p_brand"), F.col("p_type"), F.col("p_name"))
                       .alias("ticker_text")).distinct()


def date_strings(spark: SparkSession, folder: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey", day_string(day).alias("day"), days_before(day, 56).alias("start"),
        days_before(day, 1).alias("end"))


def stripped_texts(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit(" \t\n"), F.col("text"), F.lit(" \n "))
    return table(spark, folder, "conversations").select("conv_id", "turn", strip(padded).alias("text"))


QUERIES: dict[str, Query] = {
    "bars_daily": partial(bars_query, daily_bars),
    "bars_hourly": partial(bars_query, hourly_bars),
    "csv_roundtrip": csv_roundtrip,
    "wide_to_long": wide_to_long,
    "one_hot": one_hot,
    "date_range": date_range,
    "ticker_semi_join": ticker_semi_join,
    "sma": partial(indicator_query, ["sma"], 6),
    "ema": partial(indicator_query, ["ema"], 4),
    "rsi": partial(indicator_query, ["rsi"], 4),
    "macd": partial(indicator_query, ["macd", "macd_signal", "macd_diff"], 4),
    "daily_return": partial(indicator_query, ["daily_return"], 6),
    "momentum": partial(indicator_query, ["momentum"], 6),
    "volatility": partial(indicator_query, ["volatility"], 6),
    "future_return": partial(indicator_query, ["future_return"], 6),
    "next_values": partial(indicator_query, ["Close_lag1", "Volume_lag1"], 8),
    "indicators_hourly": indicators_hourly,
    "indicators_resumed": indicators_resumed,
    "thresholds": thresholds,
    "signal_labels": signal_labels,
    "zscore_self": partial(zscore, "self"),
    "zscore_train": partial(zscore, "train"),
    "time_split": time_split,
    "complete_rows": complete,
    "window_samples": window_samples,
    "label_distribution": label_distribution,
    "confusion_matrix": confusion_matrix,
    "class_report": class_report,
    "auc_ovo": auc_ovo,
    "eval_batches": lambda s, f: rounded(eval_batches(s, f)),
    "eval_metrics": eval_metrics,
    "train_classifier": train_classifier,
    "train_network": train_network,
    "train_forest": train_forest,
    "forest_support": forest_support,
    "tune_forest": tune_forest,
    "train_resumed": train_resumed,
    "model_roundtrip": model_roundtrip,
    "smote": smote,
    "smote_folds": smote_folds,
    "news_flatten": news_flatten,
    "symbol_news_all": partial(symbol_news, "all"),
    "symbol_news_last": partial(symbol_news, "last"),
    "json_lines": json_lines,
    "article_status": article_status,
    "article_text": article_text,
    "scraped_articles": scraped_articles,
    "html_main_text": html_text,
    "news_sentiment": news_sentiment,
    "incremental_articles": incremental_articles,
    "incremental_state": incremental_state,
    "chunks_fixed": chunks_fixed,
    "chunks_recursive": chunks_recursive,
    "chunk_checks": chunk_checks,
    "doc_sentiment": doc_sentiment,
    "doc_sentiment_recursive": doc_sentiment_recursive,
    "chunk_rows_sentiment": chunk_rows_sentiment,
    "finance_sentences": finance_sentences,
    "entity_mentions": entity_mentions,
    "org_entities": org_entities,
    "entity_sentences": entity_sentences,
    "entity_sentiment": entity_sentiment,
    "ticker_vectors": ticker_vectors,
    "nearest_ticker": nearest_ticker,
    "fuzzy_names": fuzzy_names,
    "doc_embedding": doc_embedding,
    "learned_vectors": learned_vectors,
    "entity_tickers": entity_tickers,
    "ticker_rows": ticker_rows,
    "ticker_texts": ticker_texts,
    "date_strings": date_strings,
    "stripped_texts": stripped_texts,
}
