"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What one executor may hold as a broadcast side: rows, and characters of their texts and lists.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 64 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` puts it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def own(name: str) -> str:
    """A column name no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and what glibc, if that is the C library, keeps between blocks in use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and about ``size`` bytes (one row at least). A
    worker that waits for its next task gives back what it no longer needs."""
    for b in batches:
        each = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for i in range(0, b.num_rows, each):
            yield b.slice(i, each)
        del b
    give_back()


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def fits_broadcast(narrow: DataFrame, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> bool:
    """Whether rows and bytes, both counted, are small enough for a broadcast."""
    wide = [c for c, kind in narrow.dtypes if kind in ("string", "binary") or "<" in kind]
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct(*wide)))), F.lit(0)) if wide else F.lit(0)
    rows, chars = narrow.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and chars <= max_chars


def join_narrow(docs: DataFrame, narrow: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join whole documents to a narrow side (ids and numbers): broadcast, so that texts stay
    where they are, when it is counted to be small; else a shuffled join."""
    return docs.join(F.broadcast(narrow) if fits_broadcast(narrow) else narrow, on, how)


def fold_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label double) outside fold 0 of 5. Null ids or labels are left out; several labels of
    one id count as the largest."""
    return (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()
                         & (fold(F.col("doc_id"), 5) != 0))
            .groupBy("doc_id").agg(F.max(label).cast("double").alias("label")))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label double) of all labelled documents outside fold 0 of 5."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return join_narrow(texts, fold_labels(labels, label), ["doc_id"], "inner")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` of the ``labelled_rows``: those with the smallest hashes of doc_id, so a re-run
    takes the same rows."""
    rows = fold_labels(labels, label).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(bound)
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(rows), "doc_id"))


def text_sample(docs: DataFrame, texts: int) -> DataFrame:
    """(text): about ``texts`` different non-empty texts of ``docs``, those whose hash falls below a
    share set by the row count; copies fall in or out together, and a re-run takes the same."""
    n = max(1, docs.count())
    share = min(1_000_000, -(-1_000_000 * texts // n))
    return (docs.where("length(text) > 0")
            .where(F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1_000_000)) < share).select("text").distinct())
