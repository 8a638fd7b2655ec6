"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Each stage works on all rows its predecessor kept: rejected documents go (quality), one document of
each near-duplicate group stays, documents holding benchmark items go, secrets are replaced in the
text, and sources are mixed to their targets. The last stage returns the documents the mix takes
with its columns (size, source_size, target, taken), the others the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, mixing, near_dedup, quality, secrets
from marketloom.llm.common import own, table
from marketloom.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = own("score")
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group and of each doc_id."""
    return near_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and n_chars following it."""
    path = "source" if "source" in docs.columns else None
    model = secrets.fit(secrets.findings(docs))
    return secrets.redact(docs, secrets.scan(docs, model, path=path))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with the words it takes of them, repeats counted."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality classifier", quality_stage), ("near-dedup", dedup_stage),
          ("benchmark decontamination", decontamination_stage), ("secret scans", secret_stage),
          ("source mixing", mixing_stage)]

# Fitted models and MinHash have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
