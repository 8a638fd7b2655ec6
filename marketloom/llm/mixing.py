"""Mixing sources to target weights by exponential keys, with built-in functions only.

Every document draws the key -ln(u) / weight, u a seeded hash of its id, so a higher weight tends
to an earlier place in its source. Each source takes whole epochs of its documents and then the
documents with the smallest keys up to the rest of its word budget. The prefix sums are taken over
key bins first and row by row only inside the one bin where the budget ends; what a row takes then
follows from comparing its key with its source's cut, so no text is moved and no source is
gathered in one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import join_narrow, own
from marketloom.session import materialize

BINS = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space ones; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Quality weight from 0.5 to 1: half of it is the share of letters and blanks."""
    n = F.length(text)
    clean = n - F.length(F.regexp_replace(text, r"[\p{L} ]+", ""))
    return F.coalesce(0.5 + 0.5 * clean / F.greatest(n, F.lit(1)), F.lit(0.5))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``: 0, 1, ... by code point, null last.

    Sources are dealt by range and written; each range is numbered by itself after the counts of the
    ranges before it, so many sources don't meet in one task."""
    part = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last())
                       .withColumn("_part", F.spark_partition_id()), "sources")
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return (part.join(F.broadcast(before.drop("_n")), "_part")
            .withColumn("place", inside + F.col("_before") - 1).drop("_part", "_before"))


def targets(sources: DataFrame, share: float = 1.0, most: float = 3.0,
            weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target``.

    Weights repeat by place. ``share`` of all words is dealt by weight; a source above ``most`` times
    its size stops there and what it leaves is dealt again among the others, until none is above."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialize(ranked(sources).withColumn("w", weight)
                    .withColumn("cap", most * F.col("source_size")), "sources")
    total = float(s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("w")
        n, left, w = s.agg(F.count(F.when(full, 1)), F.lit(total) - F.coalesce(F.sum(
            F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("w")))).first()
        if n == capped or not w:
            level = level if w else float("inf")
            break
        level, capped = left / w, n
    return s.withColumn("target", F.least("cap", F.lit(level) * F.col("w"))).drop("w", "cap", "place")


def mix(docs: DataFrame, weight: Column | None = None, share: float = 1.0, most: float = 3.0,
        seed: int = 7) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    Every row stays; null texts and texts without words have size 0 and take 0. A null source is a
    source of its own, the last one. Rows that repeat a doc_id share a key: their source takes
    them together. Taken words miss a source's target by at most half the document (or
    group of rows with one id) at the cut. Input columns with these names are replaced.
    """
    made = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*made)
    key, cut_key, cut_id, times, fit = own("key"), own("cut"), own("id"), own("times"), own("fit")
    weight = letter_share(F.col("text")) if weight is None else weight
    keyed = docs.withColumn("size", word_count(F.col("text"))).withColumn(
        key, exponential_key(F.col("doc_id"), weight, seed))
    rows = materialize(keyed.select("doc_id", "source", "size", F.col(key).alias("key")), "keys")
    sums = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    sums = materialize(sums.withColumn("epochs", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12))
        .otherwise(0).cast("long")).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))), "targets")
    code = F.least(F.lit(BINS - 1), F.floor((1 - F.exp(-F.col("key"))) * BINS)).cast("int")
    binned = rows.withColumn("bin", code)
    by_source = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = (binned.groupBy("source", "bin").agg(F.sum("size").alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(by_source), F.lit(0)))
            .alias("x").join(F.broadcast(sums.alias("s")) if sums.count() <= 100_000 else sums.alias("s"),
                             F.expr("x.source <=> s.source"))
            .where("before <= rest and rest < before + n")
            .select(F.col("x.source").alias("source"), "bin", "before", "rest"))
    ends = materialize(ends, "ends")
    inside = (binned.alias("x").join(F.broadcast(ends.alias("e")) if ends.count() <= 100_000
                                     else ends.alias("e"),
                                     F.expr("x.source <=> e.source and x.bin = e.bin"))
              .groupBy(F.col("x.source").alias("source"), "before", "rest", "key", "doc_id")
              .agg(F.sum("size").alias("size")))
    order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cuts = (inside.withColumn("end", F.col("before") + F.sum("size").over(order))
            .groupBy("source").agg(
                F.min("before").alias("before"), F.min("rest").alias("rest"),
                F.min(F.struct("key", "doc_id")).alias("low"),
                F.max(F.when(F.col("end") - F.col("size") / 2 <= F.col("rest"),
                             F.struct("key", "doc_id"))).alias("last")))
    final = materialize(sums.alias("s").join(cuts.alias("c"), F.expr("s.source <=> c.source"), "left").select(
        F.col("s.source").alias("source"), "source_size", "target", F.col("epochs").alias(times),
        # no row of the bin fits: everything below the bin
        F.coalesce(F.col("last.key"), F.col("low.key")).alias(cut_key),
        F.when(F.col("last").isNotNull(), F.col("last.doc_id")).alias(cut_id),
        F.col("last").isNotNull().alias(fit)), "cuts")
    kind = own("source")
    final = final.withColumnRenamed("source", kind)
    small = final.count() <= 100_000
    out = keyed.join(F.broadcast(final) if small else final, keyed["source"].eqNullSafe(final[kind]), "left")
    fits = (F.col(key) < F.col(cut_key)) | ((F.col(key) == F.col(cut_key)) & F.col(fit) & (
        F.coalesce(F.col("doc_id") <= F.col(cut_id), F.lit(True))))
    return out.withColumn("taken", F.col("size") * (F.col(times) + F.coalesce(fits, F.lit(False)).cast("long"))).drop(
        key, cut_key, cut_id, times, kind, fit)
