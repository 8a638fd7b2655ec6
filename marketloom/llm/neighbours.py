"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

1. The tree is fitted on a bounded sample (by hash): every node splits its vectors by k-means on
   unit vectors until a leaf stands for few rows. Dense regions get more leaves, as they have more of
   the sample. Tree and leaf counts are bounded by the sample, so they travel with the functions.
2. Every row goes down the tree to its leaf. Copies of one vector stay together: only their k + 1
   smallest ids can be among any k nearest, so a task hands on no more of them. Leaves above
   ``BLOCK`` rows are cut into blocks by hash.
3. A query walks the tree with a priority queue over the distances to the centres of all children seen
   so far and gets its leaves best bin first. How many it visits is calibrated: for a bounded set of
   queries the true neighbours are found by brute force in blocks, and visits widen until the
   recall among them reaches ``recall``. A query goes on while its leaves hold too few rows.
4. Queries meet the blocks of their leaves in bounded groups; the cosine is taken in double precision
   on the original vectors, and the k best of each group leave it. The early leaves come first: what
   the others hand on must reach the k-th score found there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize

SAMPLE = 20_000         # vectors the tree is fitted on
BRANCHES = 8
LEAF_ROWS = 256         # rows a leaf should stand for
BLOCK = 2048            # rows, and queries, that meet in one task step
CALIBRATION = 256       # queries whose true neighbours set the number of visits
_SLACK = 1e-9           # the block product and the exact cosine differ by less


@dataclass
class Tree:
    """Centres of all nodes; ``children[i]`` is empty for a leaf, ``leaf[i]`` its number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre), self.children.append([]), self.leaf.append(-1)
        return len(self.centres) - 1

    def pack(self) -> None:
        """One matrix of child centres for each inner node."""
        self.matrix = {i: np.stack([self.centres[c] for c in kids]).astype(np.float32)
                       for i, kids in enumerate(self.children) if kids}

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf number of each row, down the nearest child at every node."""
        out = np.zeros(len(unit), np.int64)
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            best = _nearest(unit[rows], self.matrix[node])
            todo += [(kid, rows[best == c]) for c, kid in enumerate(self.children[node])]
        return out

    def best_first(self, unit: np.ndarray) -> Iterator[int]:
        """Leaf numbers for one query, the nearest open bin first."""
        queue, row = [(0.0, 0)], unit.astype(np.float32)
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
                continue
            far = ((self.matrix[node] - row) ** 2).sum(axis=1).tolist()
            for kid, d in zip(self.children[node], far):
                heapq.heappush(queue, (d, kid))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T * 2 - (centres ** 2).sum(axis=1)).argmax(axis=1)


def _kmeans(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Labels of ``x`` after k-means with k-means++ seeds; fewer groups if vectors coincide."""
    centres = x[r.integers(len(x))][None]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.sum() > 1e-9:
        centres = np.vstack([centres, x[r.choice(len(x), p=far / far.sum())]])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    label = _nearest(x, centres)
    for _ in range(rounds):
        centres = np.stack([x[label == c].mean(axis=0) for c in np.unique(label)])
        label = _nearest(x, centres)
    return label


def build_tree(unit: np.ndarray, rows: int, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS,
               least: int = 4, seed: int = 5) -> Tree:
    """A tree over sample vectors ``unit`` that stand for ``rows`` rows. A node is split while it
    stands for more than ``leaf_rows`` rows and has ``least`` sample vectors per branch."""
    tree, r = Tree(), np.random.default_rng(seed)
    share = rows / max(1, len(unit))
    todo = [(tree.add(unit.mean(axis=0)), np.arange(len(unit)))]
    while todo:
        node, at = todo.pop()
        label = (_kmeans(unit[at], branches, r) if len(at) * share > leaf_rows and len(at) >= least * branches
                 else np.zeros(len(at), np.int64))
        kinds = np.unique(label)
        if len(kinds) < 2:
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
            continue
        for c in kinds:
            part = at[label == c]
            kid = tree.add(unit[part].mean(axis=0))
            tree.children[node].append(kid)
            todo.append((kid, part))
    tree.pack()
    return tree


def _matrix(values, width: int) -> np.ndarray:
    """Rows of doubles from binary vectors."""
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v binary of doubles) of the rows that take part, and the length of their vectors.

    Left out are null ids and vectors that are null, empty, zero or hold a null or non-finite
    component. Only vectors of one length can be compared: the commonest (ties: the longest). Of
    rows that repeat an id the smallest vector stands."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    fine = (F.col("vec_id").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists("e", lambda x: x != 0))
    rows = rows.where(fine)
    first = rows.groupBy(F.size("e").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if first is None:
        return rows.select("vec_id", F.lit(None).cast("binary").alias("v")).limit(0), 0
    width = first["w"]

    def run(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            data, size = flat.tobytes(), 8 * width
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([data[i:i + size] for i in range(0, len(data), size)], pa.binary())],
                ["vec_id", "v"])

    made = rows.where(F.size("e") == width).mapInArrow(run, "vec_id long, v binary")
    again = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if again.isEmpty():
        return made, width
    twice = made.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return made.join(again, "vec_id", "left_anti").unionByName(twice), width


def _hash_share(n: int, bound: int, seed: int) -> Column:
    """A condition on vec_id that about ``bound`` of ``n`` rows meet, the same on every run."""
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40)) < min(1 << 40, -(-(bound << 40) // max(1, n)))


def true_neighbours(queries: pd.DataFrame, rows: DataFrame, width: int, k: int) -> pd.DataFrame:
    """(query_id, vec_id, leaf, score) of the exact k nearest of a bounded set of queries: every
    block of rows keeps its k best."""
    ids, unit = queries["vec_id"].to_numpy(), _unit(_matrix(queries["v"], width))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                own = part.column("vec_id").to_numpy()
                s = unit @ _unit(_matrix(part.column("v").to_pylist(), width)).T
                s[ids[:, None] == own[None, :]] = -2
                top = np.argpartition(-s, min(k, len(own)) - 1, axis=1)[:, :k]
                q, c = np.repeat(np.arange(len(ids)), top.shape[1]), top.ravel()
                fine = s[q, c] > -2
                q, c = q[fine], c[fine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[q]), pa.array(own[c]), pa.array(part.column("leaf").to_numpy()[c]), pa.array(s[q, c])],
                    ["query_id", "vec_id", "leaf", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.select("vec_id", "leaf", "v").mapInArrow(run, "query_id long, vec_id long, leaf long, score double")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toPandas())


def calibrate(tree: Tree, truth: pd.DataFrame, queries: pd.DataFrame, width: int, recall: float) -> int:
    """The number of leaves to visit: widened by half until the share of true neighbours in
    them reaches ``recall``."""
    unit = dict(zip(queries["vec_id"], _unit(_matrix(queries["v"], width))))
    at = np.concatenate([
        pd.Series({leaf: i for i, leaf in enumerate(tree.best_first(unit[q]))}).loc[part["leaf"]].to_numpy()
        for q, part in truth.groupby("query_id")] or [np.zeros(1)])
    visits = 1
    while visits < tree.leaves and (at < visits).mean() < recall:
        visits += max(1, visits // 2)
    return min(visits, tree.leaves)


@dataclass
class Index:
    """Rows in their leaves, and what a search needs of them."""

    tree: Tree
    rows: DataFrame         # vec_id, v, leaf: all rows
    distinct: DataFrame     # the same without the surplus copies of a vector
    sizes: np.ndarray       # distinct rows of each leaf
    width: int
    k: int


def build_index(table: DataFrame, k: int = 5, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS,
                vec_id: str = "vec_id", embedding: str = "embedding") -> Index | None:
    """The index of every row of ``table``; None if no row takes part."""
    made, width = vectors(table, vec_id, embedding)
    if not width:
        return None
    made = materialize(made, "vectors")
    n = made.count()
    some = made.where(_hash_share(n, sample, 7)).toPandas().sort_values("vec_id")  # about ``sample`` rows
    if some.empty:
        some = made.orderBy("vec_id").limit(1).toPandas()
    tree = build_tree(_unit(_matrix(some["v"], width)), n, leaf_rows=leaf_rows)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                leaf = tree.assign(_unit(_matrix(part.column("v").to_pylist(), width)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], ["vec_id", "v", "leaf"])

    rows = materialize(made.mapInArrow(run, "vec_id long, v binary, leaf long"), "leaves")
    copy = Window.partitionBy("v").orderBy("vec_id")
    distinct = materialize(rows.withColumn("_copy", F.row_number().over(copy)).where(F.col("_copy") <= k + 1)
                           .drop("_copy"), "distinct")
    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, count in distinct.groupBy("leaf").count().collect():  # bounded by the sample
        sizes[leaf] = count
    return Index(tree, rows, distinct, sizes, width, k)


def visits_of(index: Index, queries: DataFrame, visits: int) -> DataFrame:
    """(query_id, v, leaf, early): the leaves of each query (vec_id, v), best bin first; more than
    ``visits`` while they hold too few rows for k neighbours. The first eighth is ``early``."""
    tree, sizes, width, k = index.tree, index.sizes, index.width, index.k

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids, leaves, early = [], [], []
                for q, unit in enumerate(_unit(_matrix(part.column("v").to_pylist(), width))):
                    held = 0
                    for seen, leaf in enumerate(tree.best_first(unit)):
                        if seen >= visits and held > k:
                            break
                        early.append(seen < max(1, visits // 8) or held <= k)
                        held += sizes[leaf]
                        ids.append(q), leaves.append(leaf)
                at = pa.array(ids, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(at), part.column("v").take(at), pa.array(leaves, pa.int64()), pa.array(early)],
                    ["query_id", "v", "leaf", "early"])

    return queries.select("vec_id", "v").mapInArrow(run, "query_id long, v binary, leaf long, early boolean")


def in_leaves(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): for ``asked`` (query_id, v, leaf, bound) the rows of each leaf block
    that are among its k nearest and not below the query's bound."""
    width, k = index.width, index.k
    counts = {leaf: n for leaf, n in asked.groupBy("leaf").count().collect()}  # bounded by the sample
    deal = F.broadcast(asked.sparkSession.createDataFrame(
        [(leaf, max(1, -(-int(index.sizes[leaf]) // BLOCK)), max(1, -(-n // BLOCK))) for leaf, n in counts.items()],
        "leaf long, row_blocks long, query_blocks long"))

    def cut(df: DataFrame, by: str, own: str, mine: str, other: str, others: str) -> DataFrame:
        return (df.join(deal, "leaf").withColumn(own, F.pmod(F.xxhash64(by), F.col(mine)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
                .drop("row_blocks", "query_blocks"))

    def meet(_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        c = c.sort_values("vec_id")
        ids, own, bound = q["query_id"].to_numpy(), c["vec_id"].to_numpy(), q["bound"].to_numpy()
        x, y = _matrix(q["v"], width), _matrix(c["v"], width)
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        out = []
        for lo in range(0, len(ids), 256):
            s = (x[lo:lo + 256] @ y.T) / nx[lo:lo + 256, None] / ny
            s[ids[lo:lo + 256, None] == own[None, :]] = -2
            kth = -np.partition(-s, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1]
            i, j = np.nonzero((s >= np.maximum(kth, bound[lo:lo + 256])[:, None] - _SLACK) & (s > -2))
            exact = (x[lo + i] * y[j]).sum(axis=1) / (nx[lo + i] * ny[j])
            order = np.lexsort((own[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pd.DataFrame({"query_id": ids[lo + i[best]], "vec_id": own[j[best]], "score": exact[best]}))
        return pd.concat(out)

    keys = ["leaf", "row_block", "query_block"]
    return (cut(asked, "query_id", "query_block", "query_blocks", "row_block", "row_blocks").groupBy(*keys)
            .cogroup(cut(index.distinct, "vec_id", "row_block", "row_blocks", "query_block", "query_blocks").groupBy(*keys))
            .applyInPandas(meet, "query_id long, vec_id long, score double"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, visits: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows in the visited leaves of each query. The k-th score of
    the early leaves bounds what the others hand on."""
    k, columns = index.k, ["query_id", "rank", "vec_id", "score"]
    asked = materialize(visits_of(index, queries, visits), "visits")
    early = _best(in_leaves(index, asked.where("early").withColumn("bound", F.lit(-2.0))), k).select(*columns)
    late = asked.where("not early")
    if late.isEmpty():
        return early
    early = materialize(early, "early")
    bounds = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    late = late.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    return _best(early.drop("rank").unionByName(in_leaves(index, late)), k).select(*columns)


def nearest(table: DataFrame, every: int = 50, k: int = 5, recall: float = 0.97, vec_id: str = "vec_id",
            embedding: str = "embedding", calibration: int = CALIBRATION, **fit) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows whose id is divisible by ``every``, the ``k`` rows of
    largest cosine found, nearest first, ties to the smaller id; the query's own row is no candidate.

    Which rows take part, and repeated ids: see ``vectors``. With fewer than ``k`` other rows all of
    them are returned; an empty table, or one without a query, gives no rows. Other columns are ignored."""
    index = build_index(table, k, vec_id=vec_id, embedding=embedding, **fit)
    if index is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.rows.where(F.col("vec_id") % every == 0)
    n = queries.count()
    some = (queries.where(_hash_share(n, calibration, 9)).select("vec_id", "v").toPandas()
            if n else pd.DataFrame({"vec_id": [], "v": []}))
    visits = index.tree.leaves
    if len(some):
        visits = calibrate(index.tree, true_neighbours(some, index.rows, index.width, k), some, index.width, recall)
    return search(index, queries, visits)
