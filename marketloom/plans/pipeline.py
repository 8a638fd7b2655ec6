"""The two pipelines: market features to evaluation, and news to sentiment."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from marketloom.functions.lexicon import Scorer
from marketloom.operators.articles import article_symbols, scrape, with_analysis_text
from marketloom.operators.classifiers import fit_window_classifier, predict_windows
from marketloom.operators.evaluation import batch_metrics, evaluation_summary
from marketloom.operators.indicators import Params, add_indicators
from marketloom.operators.labels import Thresholds, add_signal_label, fit_thresholds
from marketloom.operators.layout import Series
from marketloom.operators.samples import complete_rows, split_panel, window_samples, with_batches
from marketloom.operators.scaling import fit_zscore
from marketloom.operators.sentiment import document_sentiment
from marketloom.session import materialize


class Labelled(NamedTuple):
    features: DataFrame
    thresholds: Thresholds


def labelled_features(panel: DataFrame, s: Series = Series(), p: Params = Params()) -> Labelled:
    """Panel -> the 20-column feature table with signal labels.

    The features are written once: thresholds, statistics and windows all read them.
    """
    features = materialize(add_indicators(panel, s, p), "features")
    t = fit_thresholds(features)
    return Labelled(add_signal_label(features, t), t)


class Splits(NamedTuple):
    train: DataFrame
    test: DataFrame


def scaled_splits(features: DataFrame, s: Series = Series(), fraction: float = 0.8,
                  stats_from: str = "self") -> Splits:
    """Positional split, then z-scores. ``stats_from="self"`` scales each side by its own
    statistics (what the reference runs), ``"train"`` both by the training side's (what it says)."""
    if stats_from not in ("self", "train"):
        raise ValueError("stats_from must be self or train")
    train, test = split_panel(features, fraction, s)
    fitted = fit_zscore(train)
    return Splits(fitted.transform(train),
                  (fitted if stats_from == "train" else fit_zscore(test)).transform(test))


def split_windows(features: DataFrame, s: Series = Series(), fraction: float = 0.8,
                  stats_from: str = "self", length: int = 7) -> Splits:
    """Scaled window samples of both sides; rows with any missing value are dropped first."""
    sides = scaled_splits(features, s, fraction, stats_from)
    return Splits(*[window_samples(complete_rows(x), s, length) for x in sides])


class Evaluation(NamedTuple):
    model: PipelineModel
    predictions: DataFrame
    batches: DataFrame
    summary: DataFrame


def evaluate(model: PipelineModel, windows: DataFrame, s: Series = Series(), size: int = 64,
             seed: int = 42) -> Evaluation:
    """Predictions, per-batch metrics and the summary of a (loaded) model on test windows."""
    preds = predict_windows(model, windows)
    batches = batch_metrics(with_batches(preds, [s.key, s.time], size, seed))
    return Evaluation(model, preds, batches, evaluation_summary(batches))


def train_and_evaluate(panel: DataFrame, s: Series = Series(), p: Params = Params(),
                       stats_from: str = "self", kind: str = "network", max_iter: int = 100,
                       seed: int = 42) -> Evaluation:
    """The whole market path."""
    features, _ = labelled_features(panel, s, p)
    sides = split_windows(features, s, stats_from=stats_from)
    train = materialize(sides.train, "windows")
    model = fit_window_classifier(train, kind, max_iter=max_iter, seed=seed)
    return evaluate(model, sides.test, s, seed=seed)


class NewsReport(NamedTuple):
    processed: DataFrame
    sentiment: DataFrame
    symbols: DataFrame


def news_report(meta: DataFrame, pages: DataFrame, scorer: Scorer | None = None,
                cut: bool = True) -> NewsReport:
    """Metadata + stored pages -> processed articles, their sentiment, and the symbols seen."""
    processed = scrape(meta, pages)
    if cut:
        processed = materialize(processed, "articles")
    scored = document_sentiment(with_analysis_text(processed), scorer=scorer)
    return NewsReport(processed, scored.select("label", "score", "details", "symbol"),
                      article_symbols(processed))
