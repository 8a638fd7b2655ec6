"""Document sentiment: chunk long texts, score, aggregate. No shuffle: a document stays one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.chunking import is_long, recursive_chunks
from marketloom.functions.lexicon import LexiconScorer, Scorer

# fixed value: weight of a Neutral chunk's score
NEUTRAL_WEIGHT = 1 - 0.8


def majority_label(positive: Column, negative: Column, neutral: Column) -> Column:
    """Most frequent label; a tie goes to the first of Positive, Negative, Neutral."""
    return (F.when((positive >= negative) & (positive >= neutral) & (positive > 0), "Positive")
            .when((negative >= neutral) & (negative > 0), "Negative").otherwise("Neutral"))


def aggregate_scores(results: Column) -> Column:
    """array<struct<label, score>> -> struct<label, score, details> of the whole text."""
    names = ("Positive", "Negative", "Neutral")

    def add(acc: Column, r: Column) -> Column:
        weighted = F.when(r["label"] == "Neutral", NEUTRAL_WEIGHT * r["score"]).otherwise(r["score"])
        return F.struct((acc["total"] + weighted).alias("total"),
                        *[(acc[x] + (r["label"] == x).cast("int")).alias(x) for x in names])

    def result(acc: Column) -> Column:
        n = acc["Positive"] + acc["Negative"] + acc["Neutral"]
        some = n > 0
        return F.struct(
            majority_label(*[acc[x] for x in names]).alias("label"),
            F.when(some, acc["total"] / n).otherwise(0.0).alias("score"),
            F.when(some, "aggregated").otherwise("default").alias("details"))

    zero = F.struct(F.lit(0.0).alias("total"), *[F.lit(0).alias(x) for x in names])
    return F.aggregate(results, zero, add, result)


def aggregate_chunk_rows(chunks: DataFrame, by: str) -> DataFrame:
    """The same aggregation for chunk results held as rows (``label``, ``score``)."""
    neutral = F.col("label") == "Neutral"
    n = {x: F.count(F.when(F.col("label") == x, 1)) for x in ("Positive", "Negative", "Neutral")}
    return chunks.groupBy(by).agg(
        majority_label(n["Positive"], n["Negative"], n["Neutral"]).alias("label"),
        (F.sum(F.when(neutral, NEUTRAL_WEIGHT * F.col("score")).otherwise(F.col("score")))
         / F.count(F.lit(1))).alias("score"),
        F.lit("aggregated").alias("details"))


def document_sentiment(docs: DataFrame, text: str = "text", scorer: Scorer | None = None,
                       splitter: Callable[[Column], Column] | None = None,
                       batched: bool = False) -> DataFrame:
    """Add ``label``, ``score`` and ``details``.

    A text of at most 1,792 characters is scored whole (``details`` null). A longer one is cut by
    ``splitter``, blank chunks are left out, and the chunk results are aggregated. ``scorer`` maps
    a text column to struct<label, score>. A scorer made of built-in expressions is applied inside
    the chunk array; pass ``batched=True`` for an Arrow scorer, which gets exploded chunks and
    whose results are grouped by the row's ``doc_id``.
    """
    scorer = scorer or LexiconScorer()
    splitter = splitter or recursive_chunks()
    t = F.col(text)
    # the splitter only sees long texts; a short text is its own single piece
    parts = F.when(is_long(t), splitter(F.when(is_long(t), t)))
    if not batched:
        results = F.transform(F.filter(F.col("_parts"), lambda c: c.rlike(r"\S")), scorer)
        done = docs.withColumn("_parts", parts).withColumn(
            "_r", F.when(F.col("_parts").isNotNull(), aggregate_scores(results))
            .otherwise(F.when(t.isNull(), _nothing()).otherwise(_whole(scorer(t)))))
        return done.select(*docs.columns, "_r.*")

    kept = F.filter(parts, lambda c: c.rlike(r"\S"))
    pieces = (docs.select("doc_id", is_long(t).alias("_long"),
                          F.explode(F.when(is_long(t), kept).otherwise(F.array(t))).alias("_piece"))
              .where(F.col("_piece").isNotNull()).withColumn("_s", scorer(F.col("_piece"))))
    done = (pieces.groupBy("doc_id").agg(F.collect_list("_s").alias("_results"),
                                         F.first("_long").alias("_long"))
            .select("doc_id", F.when(F.col("_long"), aggregate_scores(F.col("_results")))
                    .otherwise(_whole(F.col("_results")[0])).alias("_r")))
    return (docs.join(done, "doc_id", "left").withColumn("_r", F.coalesce("_r", _nothing()))
            .select(*docs.columns, "_r.*"))


def _nothing() -> Column:
    """The result of a row without text."""
    return F.struct(F.lit("Neutral").alias("label"), F.lit(0.0).alias("score"),
                    F.lit("default").alias("details"))


def _whole(result: Column) -> Column:
    return F.struct(result["label"].alias("label"), result["score"].alias("score"),
                    F.lit(None).cast("string").alias("details"))
