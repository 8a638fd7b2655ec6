"""Near-duplicate classes: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every text becomes its word sequence (ASCII case folded), the set of 64-bit hashes of its
   5-word shingles, and 300 MinHash values of 16 bits. Texts with equal word sequences form one
   class before anything is compared; only its smallest id goes on.
2. 50 bands of 6 values are the candidate keys: a pair of similarity 0.75 shares none with
   probability 6e-5, one of 0.8 with 3e-7. Each bucket links its members to its smallest member
   only. The documents of buckets that still hold several components are then joined by exact
   prefix and position filters over their whole sets, between components only, so no candidate
   is left out while copies never meet each other in pairs.
3. Candidates are compared by batches of 20 values. A pair is dropped as soon as the posterior
   probability (uniform prior) of similarity >= 0.75 falls below ``miss``.
4. Survivors are confirmed on the full shingle sets of their whole texts.
5. Components by alternating large-star and small-star steps; minima are aggregated before the
   shuffle and joined back, so no neighbourhood is collected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import join_narrow, slices
from marketloom.session import materialize

K = 5
BANDS, ROWS = 50, 6
PERMS = BANDS * ROWS
BATCH = 20
SEGMENT = 1 << 20
PRIME, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(
        [np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Shingler:
    """Word sequences, shingle sets and MinHash values of texts."""

    def __init__(self) -> None:
        self.byte = _random(256, 1)
        self.up, self.down = _powers(PRIME, SEGMENT), _powers(INVERSE, SEGMENT)
        self.a, self.b = _random(PERMS, 2) | np.uint64(1), _random(PERMS, 3)

    @staticmethod
    def words(text: str | None) -> bytes:
        """The words joined by one space; bytes are split at the same six ASCII characters."""
        return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def _word_hashes(self, data: bytes) -> np.ndarray:
        """Polynomial hash of each word, by running sums over segments that end between words."""
        parts, at = [], 0
        while at < len(data):
            end = len(data)
            if end - at > SEGMENT:
                cut = data.rfind(b" ", at, at + SEGMENT)
                if cut <= at:  # one word longer than a segment
                    cut = data.find(b" ", at)
                    cut = len(data) if cut < 0 else cut
                    parts.append(np.frombuffer(hashlib.blake2b(
                        data[at:cut], digest_size=8).digest(), np.uint64))
                    at = cut + 1
                    continue
                end = cut
            a = np.frombuffer(data, np.uint8, end - at, at)
            gaps = np.flatnonzero(a == 32)
            starts, ends = np.append(0, gaps + 1), np.append(gaps, len(a))
            total = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(self.byte[a] * self.up[:len(a)], out=total[1:])
            h = (total[ends] - total[starts]) * self.down[starts]
            parts.append(self._mix(h + (ends - starts).astype(np.uint64)))
            at = end + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def shingles(self, data: bytes) -> np.ndarray:
        """Sorted distinct shingle hashes; fewer than K words make one shingle, none make none."""
        w = self._word_hashes(data)
        if not len(w):
            return w
        k = min(K, len(w))
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(PRIME) + w[j:j + n]
        return np.unique(self._mix(h))

    def signature(self, s: np.ndarray) -> bytes:
        low = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 256):
            np.minimum(low, (s[i:i + 256, None] * self.a + self.b).min(axis=0), out=low)
        return (low >> np.uint64(48)).astype(np.uint16).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key binary, sig binary): key is the digest of the word sequence."""
    def run(batches):
        s = Shingler()
        for b in slices(batches):
            sizes, keys, sigs = [], [], []
            for text in b.column(1).to_pylist():
                words = s.words(text)
                found = s.shingles(words)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(words, digest_size=16).digest() if words else None)
                sigs.append(s.signature(found) if words else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "key", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, key binary, sig binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, words binary): the shingle set of each whole text as sorted 8-byte hashes."""
    def run(batches):
        s = Shingler()
        for b in slices(batches):
            sets = [s.shingles(s.words(t)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())],
                                             ["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words binary")


def least_matches(threshold: float, miss: float, n: int = PERMS, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest matches at which P(similarity >= threshold) is >= ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= threshold
    out = []
    for seen in range(batch, n + 1, batch):
        m = np.arange(seen + 1)[:, None]
        log = m * np.log(grid) + (seen - m) * np.log1p(-grid)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = p[:, high].sum(axis=1) / p.sum(axis=1)
        out.append(int(np.argmax(posterior >= miss)))
    return out


def bayes_prune(pairs: DataFrame, nodes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures do not rule out the threshold."""
    least = least_matches(threshold, miss)
    side = nodes.select("doc_id", "sig", "n_shingles")
    both = (pairs.join(side.toDF("b", "sig_b", "n_b"), "b")
            .join(side.toDF("a", "sig_a", "n_a"), "a")
            .where((F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
            .select("a", "b", "sig_a", "sig_b"))

    def run(batches):
        for b in slices(batches, 4096):
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, PERMS)
                    for i in (2, 3))
            alive = np.arange(len(x))
            seen = np.zeros(len(x), np.int64)
            for i, need in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                seen[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[seen[alive] >= need]
            yield b.take(pa.array(alive)).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * |A & B| >= percent * |A | B| on full sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(shingle_sets(join_narrow(docs, ids, ["doc_id"], "left_semi")
                                    .select("doc_id", "text")), "sets")
    both = (pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
            .select("a", "b", "set_a", "set_b"))

    def run(batches):
        for b in slices(batches, 256):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` (a, b) can reach."""
    e = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        two = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = materialize(small.where("u <> v").distinct(), name)
        after = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return e.unionByName(e.select(F.col("v").alias("u"), "v")).distinct().toDF(
                "node", "component")
        before = after


def between_components(mixed: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``mixed`` (b, c: document and component) in different components that may be
    alike, by prefix and position filters over whole sets; no pair that is alike is missing.

    A document's shingles stand in one common order, rare ones first. Alike documents share one of
    the first n - ceil(n * percent / 100) + 1, at a place that leaves enough shingles behind it. Copies
    with many edits of their own start with shingles nobody shares, so they meet nobody."""
    def run(batches):
        s = Shingler()
        for b in slices(batches, 128):
            sets = [s.shingles(s.words(t)) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if ends[-1] else np.zeros(0, np.int64)
            tag = [int(x[len(x) // 2] >> np.uint64(1)) if len(x) else 0 for x in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(tag, pa.int64()), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "tag", "words"])

    ids = mixed.select(F.col("b").alias("doc_id")).distinct()
    sets = materialize(join_narrow(docs.select("doc_id", "text"), ids, ["doc_id"], "left_semi")
                       .select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, tag long, words array<bigint>"), "sets")
    each = sets.select("doc_id", "tag", F.size("words").alias("n"), F.explode("words").alias("w"))
    often = each.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = (each.join(often, "w").groupBy("doc_id", "tag", "n")
               .agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("known"))
               .select("doc_id", "tag", "n", F.size("known").alias("m"), F.posexplode("known").alias("i", "k"))
               .withColumn("at", F.col("n") - F.col("m") + F.col("i"))
               .where((F.col("n") - F.col("at")) * 100 >= percent * F.col("n")))
    rows = materialize(ordered.join(mixed.withColumnRenamed("b", "doc_id"), "doc_id")
                       .select("k.w", "doc_id", "c", "n", "at"), "prefixes")
    counts = rows.groupBy("w", "c").agg(F.count(F.lit(1)).alias("docs"))
    major = (counts.groupBy("w").agg(F.max(F.struct("docs", "c")).alias("top"), F.count(F.lit(1)).alias("kinds"))
             .where("kinds > 1").select("w", F.col("top.c").alias("major")))
    shared = materialize(rows.join(major, "w"), "shared")
    return (shared.where("c <> major").alias("x").join(shared.alias("y"), "w")
            .where("x.c <> y.c and (y.c = y.major or x.doc_id < y.doc_id)")
            .where((F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at")) * (100 + percent)
                    >= percent * F.expr("x.n + y.n")))
            .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
            .distinct())


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Null, empty and blank texts have no shingles and stay alone. A row without doc_id is linked
    with nothing: component_id null, kept. Rows repeating a doc_id are one document: linked to
    whatever any of its texts is linked with, each returned. Other columns are ignored.
    """
    sig = materialize(signatures(docs), "signatures")
    filled = sig.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("key").agg(F.min("doc_id").alias("rep"))
    members = materialize(filled.select("doc_id", "key").join(classes, "key")
                          .select("doc_id", "rep").distinct(), "members")
    nodes = materialize(
        filled.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi")
        .select("doc_id", "sig", "n_shingles").dropDuplicates(["doc_id", "sig"]), "nodes")
    at = 2 * ROWS
    bands = nodes.select(
        F.col("doc_id").alias("b"), F.explode(F.expr(
            f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(substring(sig, i * {at} + 1, {at}), i))"
        )).alias("bucket"))
    first = (bands.groupBy("bucket").agg(F.min("b").alias("a"), F.max("b").alias("last"))
             .where("a <> last").select("bucket", "a"))
    shared = materialize(bands.join(first, "bucket"), "buckets")
    stars = shared.where("a <> b").select("a", "b").distinct()
    found = materialize(verify(materialize(bayes_prune(stars, nodes, percent / 100, miss), "pairs"),
                               docs, percent), "links")
    part = components(found)
    rows = (shared.join(part.withColumnRenamed("node", "b"), "b", "left")
            .select("bucket", "b", F.coalesce("component", "b").alias("c")))
    kinds = rows.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    mixed = materialize(rows.join(kinds.where("least <> most"), "bucket", "left_semi")
                        .select("b", "c").distinct(), "mixed")
    rest = between_components(mixed, docs, percent)
    more = verify(materialize(bayes_prune(rest, nodes, percent / 100, miss), "pairs"), docs, percent)
    links = found.unionByName(more).unionByName(members.where("doc_id <> rep").toDF("b", "a"))
    part = components(links)
    return (sig.select("doc_id", "n_shingles")
            .join(part.toDF("doc_id", "component"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with the document of smallest doc_id of each near-duplicate group; rows without
    doc_id stay. Rows that repeat a kept doc_id are one document: that with the smallest text
    hash stays (equal texts: one of the equal rows)."""
    found = materialize(near_duplicates(docs, **limits).where("doc_id is not null"), "groups")
    gone = found.where("not kept").select("doc_id").distinct()
    kept = join_narrow(docs, gone, ["doc_id"], "left_anti").select(docs.columns)
    again = materialize(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    single = join_narrow(kept, again, ["doc_id"], "left_anti").select(docs.columns)
    least = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns)))
    twice = join_narrow(kept, again, ["doc_id"], "left_semi").select(docs.columns).groupBy("doc_id").agg(least.alias("row"))
    return single.unionByName(twice.select("row.*"))
