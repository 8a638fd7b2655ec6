"""Sentences, words, finance keywords and the bundled lexicon scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the finance keyword set
FINANCE_KEYWORDS = [
    "profit", "loss", "revenue", "earnings", "dividend", "merger", "acquisition", "default", "bankruptcy", "downgrade",
    "upgrade", "regulation", "compliance", "fine", "lawsuit", "fraud", "volatility", "inflation", "interest", "credit",
    "loan", "debt", "equity", "bond", "stock", "shareholder", "investment", "portfolio", "risk", "return", "yield",
    "growth", "decline", "forecast", "outlook", "capital", "market", "economy", "trade", "shares", "assets",
    "liabilities", "valuation", "fund", "index"]

# A scorer maps a text column to struct<label string, score double>.
Scorer = Callable[[Column], Column]


def sentences(text: Column) -> Column:
    """Array of sentences: cut at whitespace after ``.``, ``!`` or ``?``."""
    return F.split(text, r"(?<=[.!?])\s+")


def words(text: Column) -> Column:
    """Lower-case words (letters and digits) in order."""
    return F.filter(_tokens(text), lambda w: w != "")


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def mentions_finance(text: Column, keywords: Iterable[str] = FINANCE_KEYWORDS) -> Column:
    return F.arrays_overlap(words(text), F.array(*[F.lit(k) for k in keywords]))


@dataclass(frozen=True)
class LexiconScorer:
    """Deterministic scorer of built-in expressions: the majority of positive and negative words.

    The score is the smoothed share of the winning side; without a majority the label is Neutral.
    """

    positive: tuple[str, ...] = ("gain", "gains", "growth", "profit", "profits", "strong", "surge",
                                 "upgrade", "beat", "record", "rise", "rises", "rally")
    negative: tuple[str, ...] = ("loss", "losses", "decline", "weak", "fraud", "lawsuit", "default",
                                 "downgrade", "miss", "fall", "falls", "bankruptcy", "plunge")

    def __call__(self, text: Column) -> Column:
        # one look-up per word; counting only touches the listed words
        def listed(w: Column, vocabulary: Iterable[str]) -> Column:
            return F.array_contains(F.array(*[F.lit(v) for v in vocabulary]), w)

        known = F.filter(_tokens(text), lambda w: listed(w, [*self.positive, *self.negative]))

        def result(acc: Column) -> Column:
            p, n = acc["p"], acc["n"]
            label = F.when(p > n, "Positive").when(n > p, "Negative").otherwise("Neutral")
            return F.struct(label.alias("label"),
                            ((F.greatest(p, n) + 1) / (p + n + 2)).alias("score"))

        return F.aggregate(
            known, F.struct(F.lit(0).alias("p"), F.lit(0).alias("n")),
            lambda acc, w: F.struct((acc["p"] + listed(w, self.positive).cast("int")).alias("p"),
                                    (acc["n"] + listed(w, self.negative).cast("int")).alias("n")),
            result)


def model_scorer(load: Callable[[], Callable[[pd.Series], pd.DataFrame]]) -> Scorer:
    """Wrap a trained model: ``load()`` runs once per worker and returns a batch function
    from texts to a frame with ``label`` and ``score``."""

    @F.pandas_udf("label string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            yield model(texts)[["label", "score"]]

    return score
