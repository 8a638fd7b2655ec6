"""Prefix trie of conversations in minimal-perfect-hash node tables.

1. Each turn becomes a 127-bit number x (digest of role and text) and its word count; texts go no
   further. The prefix of d turns has the digest sum(x_i * BASE^i) mod PRIME, which can be
   cut and joined: turns are range-partitioned by (conversation, turn), each partition scans its
   own rows, and a conversation lying over several partitions gets the sums of the earlier ones.
2. A rebuilt conversation is a head of another one and its own tail; its prefix digests follow
   from both sums. There is one row per conversation and depth (0: the root).
3. Rows are dealt to shards by conversation and band of ``BAND`` depths, so a shard is bounded
   whatever first turn, copy or conversation is hot. A shard enumerates its distinct digests,
   builds a minimal perfect hash over them, checks digest, parent and turn behind every slot, scatters
   counts into flat arrays and adds them to parent slots, deepest first. A conversation longer than the
   band counts once at the last row of each band. Nodes that several shards hold are summed.
4. Counts of members come first; then each node's saving and leaf belong to its smallest member,
   and a second round of the same tables sums them over subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.skew import spread_join
from marketloom.session import materialize

PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D2B7E151628AED2A6ABF7159
BAND = 16_384           # depths a shard holds of one conversation
SHARD_ROWS = 65_536     # rows a shard holds on average
CHUNK = 4_096           # ids hashed at once
SEGMENT = 4_096         # turns of one conversation that meet its head in one join key
NODE = ["hi", "lo"]
PARENT = ["parent_hi", "parent_lo"]


@cache
def _power(n: int) -> int:
    return pow(BASE, n, PRIME)


def power(n: int) -> int:
    """BASE^n mod PRIME; a negative n is the inverse."""
    return _power(n) if n < 2 * BAND else pow(BASE, n, PRIME)


def halves(values: list[int]) -> tuple[pa.Array, pa.Array]:
    """127-bit numbers as two signed 64-bit columns."""
    raw = np.frombuffer(b"".join(v.to_bytes(16, "big") for v in values), ">i8").reshape(-1, 2).astype(np.int64)
    return pa.array(raw[:, 0]), pa.array(raw[:, 1])


def whole(hi, lo) -> int:
    return (hi << 64) | (lo & 0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- prefixes

def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x_hi, x_lo, words) of every row with a conv_id; null role or text is empty."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, words = [], []
                for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    role, text = (s.encode("utf-8", "surrogatepass") for s in (role, text))
                    h = hashlib.blake2b(len(role).to_bytes(8, "big") + role + text, digest_size=16)
                    x.append(int.from_bytes(h.digest(), "big") % PRIME)
                    words.append(len(text.split()))  # splits at the six ASCII blanks
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *halves(x), pa.array(words, pa.int64())],
                                                 ["conv_id", "turn", "x_hi", "x_lo", "words"])

    empty = F.lit("")
    return (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty), F.coalesce("text", empty))
            .mapInArrow(run, "conv_id long, turn long, x_hi long, x_lo long, words long"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, x_hi, x_lo, words, hi, lo): place of each turn in its conversation, from 0, and
    the digest of the turns up to it."""
    turns = materialize(turn_digests(conversations), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "x_hi", "x_lo"]

    def scan(batches):
        last, at, d, p = None, 0, 0, 1
        for b in batches:
            if not b.num_rows:
                continue
            conv, x_hi, x_lo = (b.column(c).to_pylist() for c in ("conv_id", "x_hi", "x_lo"))
            places, digests = [], []
            for c, hi, lo in zip(conv, x_hi, x_lo):
                if c != last:
                    last, at, d, p = c, 0, 0, 1
                d = (d + whole(hi, lo) * p) % PRIME
                places.append(at), digests.append(d)
                at, p = at + 1, p * BASE % PRIME
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("part"), pa.array(places, pa.int64()), b.column("x_hi"), b.column("x_lo"),
                 b.column("words"), *halves(digests)], ["conv_id", "part", "at", "x_hi", "x_lo", "words", "hi", "lo"])

    out = "conv_id long, part int, at long, x_hi long, x_lo long, words long, hi long, lo long"
    parts = materialize(turns.repartitionByRange(*order).sortWithinPartitions(*order)
                        .select("conv_id", F.spark_partition_id().alias("part"), "x_hi", "x_lo", "words")
                        .mapInArrow(scan, out), "scanned")
    cut = (parts.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b"))
           .where("a <> b").select("conv_id"))  # fewer than there are partitions
    pieces = (parts.join(F.broadcast(cut), "conv_id").groupBy("conv_id", "part")
              .agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("hi", "lo"), "at").alias("d"))
              .orderBy("conv_id", "part").collect())
    before: dict[tuple[int, int], tuple[int, int]] = {}
    last, n, d = None, 0, 0
    for r in pieces:
        if r.conv_id != last:
            last, n, d = r.conv_id, 0, 0
        before[r.conv_id, r.part] = n, d
        d = (d + power(n) * whole(r.d.hi, r.d.lo)) % PRIME
        n += r.n
    if not before:
        return parts.drop("part")

    def join(batches):
        for b in batches:
            conv, part, at, hi, lo = (b.column(c).to_pylist() for c in ("conv_id", "part", "at", "hi", "lo"))
            places, digests = [], []
            for c, p, i, h, l in zip(conv, part, at, hi, lo):
                n, d = before.get((c, p), (0, 0))
                places.append(i + n)
                digests.append((d + power(n) * whole(h, l)) % PRIME if n else whole(h, l))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array(places, pa.int64()), b.column("x_hi"), b.column("x_lo"), b.column("words"),
                 *halves(digests)], ["conv_id", "at", "x_hi", "x_lo", "words", "hi", "lo"])

    return materialize(parts.mapInArrow(join, out.replace("part int, ", "")), "prefixes")


def rebuilt(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, depth, hi, lo, parent_hi, parent_lo, x, words, ends), one row per rebuilt
    conversation and depth, from the root (depth 0, parent -1): conversation c has the first
    crc32(c) % ``heads`` turns of c - c % ``family``, then its own turns after as many."""
    own = prefixes(conversations)
    turn = F.struct("at", "hi", "lo", "x_hi", "x_lo", "words")
    convs = materialize(own.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("at") < heads - 1, turn))).alias("head")), "conversations")
    source = convs.select(F.col("conv_id").alias("from"), F.col("head").alias("source"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    info = (convs.withColumn("from", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
            .join(source, "from", "left")
            .withColumn("source", F.slice(F.coalesce("source", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("h")))
            .withColumn("hp", F.size("source"))
            .withColumn("end", F.col("hp") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    info = materialize(info, "heads")

    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")  # no prefix has a negative hi
    start = F.array(F.struct(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), none.alias("parent_hi"), none.alias("parent_lo"),  zero.alias("x"), zero.alias("words")))
    above = F.transform("source", lambda t, i: F.struct(
        (i + 1).cast("long").alias("depth"), t.hi.alias("hi"), t.lo.alias("lo"),
        F.when(i == 0, 0).otherwise(F.get("source", i - 1)["hi"]).cast("long").alias("parent_hi"),
        F.when(i == 0, 0).otherwise(F.get("source", i - 1)["lo"]).cast("long").alias("parent_lo"),
        t.x_lo.alias("x"), t.words.alias("words")))
    top = (info.select("conv_id", "end", F.inline(F.concat(start, above)))
           .select("conv_id", "depth", *NODE, *PARENT, "x", "words", (F.col("depth") == F.col("end")).alias("ends")))

    def value(name: str, place):
        return F.coalesce(F.get(F.col(name), place), F.lit(None))

    tail = info.where("n > h").select(
        "conv_id", "h", "hp", "end", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SEGMENT).cast("int"))).alias("segment"),
        *[F.coalesce(value("source", F.col("hp") - 1)[c], zero).alias("p_" + c) for c in NODE],
        *[F.coalesce(value("head", F.col("h") - 1)[c], zero).alias("h_" + c) for c in NODE])

    def move(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = {c: b.column(c).to_pylist() for c in b.schema.names if c not in ("conv_id", "words", "end")}
            nodes, parents, depths = [], [], []
            for i in range(b.num_rows):
                v = {c: col[c][i] for c in col}
                d = (whole(v["p_hi"], v["p_lo"]) + power(v["hp"] - v["h"])
                     * (whole(v["hi"], v["lo"]) - whole(v["h_hi"], v["h_lo"]))) % PRIME
                depth = v["hp"] + v["at"] - v["h"] + 1
                nodes.append(d), depths.append(depth)
                parents.append((d - whole(v["x_hi"], v["x_lo"]) * power(depth - 1)) % PRIME)
            end = b.column("end").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array(depths, pa.int64()), *halves(nodes), *halves(parents), b.column("x_lo"),
                 b.column("words"), pa.array([x == y for x, y in zip(depths, end)])],
                ["conv_id", "depth", *NODE, *PARENT, "x", "words", "ends"])

    rest = (own.withColumn("segment", F.floor(F.col("at") / SEGMENT).cast("int")).join(tail, ["conv_id", "segment"])
            .where("at >= h").drop("segment").mapInArrow(
        move, "conv_id long, depth long, hi long, lo long, parent_hi long, parent_lo long, x long, words long, ends boolean"))
    return top.unionByName(rest)


# ---------------------------------------------------------------- node tables

class Slots:
    """A minimal perfect hash of distinct keys (n x 2): level by level, keys alone at their place
    keep it, and a slot is the rank of the place among all kept ones. The keys stand in their slots."""

    def __init__(self, keys: np.ndarray) -> None:
        self.levels, self.n, rest = [], 0, keys
        self.keys = np.zeros_like(keys)
        while len(rest):
            size = max(2, len(rest) + len(rest) // 2)
            place = self._place(rest, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = self.n + np.cumsum(alone) - 1
            kept = alone[place]
            self.keys[rank[place[kept]]] = rest[kept]
            self.levels.append((size, alone, rank))
            self.n += int(alone.sum())
            rest = rest[~kept]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        k = keys.view(np.uint64)
        x = (k[:, 0] ^ (k[:, 1] * np.uint64(0x9E3779B97F4A7C15))) + np.uint64((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, verified against the key that stands there; -1 if it is another."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            place = self._place(keys[todo], level, size)
            hit = alone[place]
            out[todo[hit]] = rank[place[hit]]
            todo = todo[~hit]
        out[todo] = -1
        fine = out >= 0
        fine[fine] = (self.keys[out[fine]] == keys[fine]).all(axis=1)
        return np.where(fine, out, -1)


class NodeTable:
    """The distinct nodes of a shard's rows in slots, with parent slots and depths."""

    def __init__(self, rows: pd.DataFrame, band: int) -> None:
        keys = np.ascontiguousarray(rows[NODE].to_numpy(np.int64))
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.r_[True, (keys[order][1:] != keys[order][:-1]).any(axis=1)]
        one = order[new]
        self.slots = Slots(keys[one])
        self.of_row = self.slots.find(keys)
        self.row = np.zeros(self.slots.n, np.int64)
        self.row[self.slots.find(keys[one])] = one
        told = rows[[*PARENT, "x", "depth"]].to_numpy(np.int64)
        if (self.of_row < 0).any() or (told != told[self.row[self.of_row]]).any():
            raise ValueError("two different prefixes have one digest")
        self.depth = rows["depth"].to_numpy(np.int64)[self.row]
        parent = np.ascontiguousarray(told[self.row][:, :2])
        self.parent = np.where(self.depth % band == 0, -1, self.slots.find(parent))

    def scatter(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.slots.n, np.int64)
        np.add.at(out, self.of_row, values)
        return out

    def accumulate(self, *arrays: tuple[np.ufunc, np.ndarray]) -> None:
        """Combine every node into its parent, deepest nodes first, in place."""
        order = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order], prepend=-2, append=-2))
        for lo, hi in zip(cuts, cuts[1:]):
            nodes = order[lo:hi]
            nodes = nodes[self.parent[nodes] >= 0]
            for by, values in arrays:
                by.at(values, self.parent[nodes], values[nodes])


def _sharded(rows: DataFrame, band: int, shard_rows: int) -> DataFrame:
    spark = rows.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard_rows))
    return rows.withColumn("shard", F.pmod(F.xxhash64("conv_id", F.floor(F.col("depth") / band)), F.lit(shards)))


def member_nodes(rows: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(hi, lo, parent_hi, parent_lo, depth, words, n_convs, n_ends, conv_id): every node with its
    members, those that end there, and the smallest member."""
    def table(rows: pd.DataFrame) -> pd.DataFrame:
        t = NodeTable(rows, band)
        ends = rows["ends"].to_numpy(bool)
        last = ends | (rows["depth"].to_numpy() % band == band - 1)
        n = t.scatter(last.astype(np.int64))
        least = np.full(t.slots.n, np.iinfo(np.int64).max)
        np.minimum.at(least, t.of_row[last], rows["conv_id"].to_numpy()[last])
        t.accumulate((np.add, n), (np.minimum, least))
        out = rows[[*NODE, *PARENT, "depth", "x", "words"]].iloc[t.row].copy()
        return out.assign(n_convs=n, n_ends=t.scatter(ends.astype(np.int64)), conv_id=least)

    parts = _sharded(rows, band, shard_rows).groupBy("shard").applyInPandas(
        table, "hi long, lo long, parent_hi long, parent_lo long, depth long, x long, words long, n_convs long, n_ends long, conv_id long")
    same = F.lit(True)
    for c in (*PARENT, "depth", "x"):
        same = same & (F.min(c) == F.max(c))
    return (parts.groupBy(*NODE).agg(
        *[F.min(c).alias(c) for c in (*PARENT, "depth", "words")], F.sum("n_convs").alias("n_convs"),
        F.sum("n_ends").alias("n_ends"), F.min("conv_id").alias("conv_id"), same.alias("same"))
        .withColumn("n_convs", F.when(F.col("same"), F.col("n_convs")).otherwise(
            F.raise_error(F.lit("two different prefixes have one digest")).cast("long"))).drop("same"))


def subtree_sums(rows: DataFrame, nodes: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(hi, lo, n_children, n_leaves, saved_tokens): sums over the nodes below. A node's own share is put at
    the row of its smallest member."""
    share = nodes.select("conv_id", "depth", F.lit(1).cast("long").alias("new"),
                         (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"),
                         ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    parts = ["new", "leaf", "saved"]
    full = materialize(rows.drop("ends", "words").join(share, ["conv_id", "depth"], "left")
                       .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in parts})
                       .withColumn("child", F.lit(0).cast("long")), "shares")
    if not full.where(F.col("depth") >= band).isEmpty():
        # what lies in deeper bands of a conversation is added at its last row of each band
        below = (full.withColumn("band", F.floor(F.col("depth") / band)).groupBy("conv_id", "band")
                 .agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"),
                      F.max(F.when(F.col("depth") % band == 0, F.col("new"))).alias("more_child")))
        deeper = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, 0)
        below = (below.withColumns({c: F.sum(c).over(deeper) for c in ("more_leaf", "more_saved")})
                 .where("band > 0").withColumn("depth", F.col("band") * band - 1).drop("band"))
        full = materialize(full.join(below, ["conv_id", "depth"], "left").withColumns(
            {c: F.col(c) + F.coalesce("more_" + c, F.lit(0).cast("long")) for c in ("leaf", "saved", "child")})
            .drop("more_leaf", "more_saved", "more_child"), "shares")

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        t = NodeTable(rows, band)
        value = {c: t.scatter(rows[c].to_numpy(np.int64)) for c in ("leaf", "saved", "child", "new")}
        inner = t.parent >= 0
        np.add.at(value["child"], t.parent[inner], value["new"][inner])
        t.accumulate((np.add, value["leaf"]), (np.add, value["saved"]))
        out = rows[NODE].iloc[t.row].copy()
        return out.assign(n_children=value["child"], n_leaves=value["leaf"], saved_tokens=value["saved"])

    sums = ["n_children", "n_leaves", "saved_tokens"]
    return (_sharded(full, band, shard_rows).groupBy("shard").applyInPandas(
        table, "hi long, lo long, n_children long, n_leaves long, saved_tokens long")
        .groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in sums]))


def end_hashes(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(hi, lo, ends_sha256): SHA-256 of the ascending, comma-joined ids that end at a node. Ids are
    written in chunks by range, and the chunks of a node run through its hash one after the other."""
    def runs(batches):
        node, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((*node, ids[0], ",".join(map(str, ids))),
                                                  (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["hi", "lo", "first", "ids"])

        for b in batches:
            made = []
            for hi, lo, conv in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "conv_id"))):
                if ids and ((hi, lo) != node or len(ids) >= chunk):
                    made.append(out())
                    ids = []
                node = hi, lo
                ids.append(conv)
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if ids:
            yield out()

    def digests(batches):
        node, h = None, None
        for b in batches:
            made = []
            for hi, lo, ids in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "ids"))):
                if (hi, lo) == node:
                    h.update(b"," + ids.encode())
                    continue
                if node:
                    made.append((*node, h.hexdigest()))
                node, h = (hi, lo), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pandas(pd.DataFrame(made, columns=["hi", "lo", "ends_sha256"]).astype(
                {"hi": "int64", "lo": "int64", "ends_sha256": "object"}), schema=schema, preserve_index=False)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, h.hexdigest()), schema)], schema=schema)

    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())])
    ends = rows.where("ends").select(*NODE, "conv_id")
    chunks = (ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
              .mapInArrow(runs, "hi long, lo long, first long, ids string"))
    return (chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first")
            .mapInArrow(digests, "hi long, lo long, ends_sha256 string"))


def trie(conversations: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row
    per node of the rebuilt conversations.

    Turns are ordered by turn, null first; equal turns by the digest of role and text; repeated rows
    are turns of their own. Rows without conv_id are ignored, as are other columns; an empty table has
    no nodes, not even a root."""
    rows = materialize(rebuilt(conversations), "rows")
    nodes = materialize(member_nodes(rows, band, shard_rows), "nodes")
    sums = subtree_sums(rows, nodes, band, shard_rows)
    parents = nodes.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (spread_join(nodes, parents, PARENT).join(sums, NODE).join(end_hashes(rows), NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))
