"""Exact k best matches through cells: an inverted file with bounds, for any metric that has them.

The reference rows are dealt to cells around centres (seeded k-means on a bounded sample of their
features); of each cell the centre, the radius and the row count are kept. A query takes its best
cell first; the k-th score found there is a floor, and by the triangle inequality a cell
whose bound lies below the floor can hold no better row. Only the remaining cells are searched, so
the result equals that of comparing everything with everything.

A reference set counted to be small is broadcast and searched in place. Otherwise queries
meet the blocks of their cells in an equi-join on (cell, row block, query block); blocks are bounded, and
only the k best rows above the floor leave one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize

SAMPLE = 20_000         # reference rows the centres are fitted on
MAX_CELLS = 1_024       # in each part
_PAIRS = 1 << 22        # features compared at once by a task
_SLICE = 2_048          # (query, cell) rows a task hands on at once: each carries the query's value


@dataclass
class Cells:
    """Centres with their part, and per cell the largest distance, feature totals and rows."""

    parts: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray


class Metric(Protocol):
    def features(self, values: Sequence[Any]) -> np.ndarray:
        """One row of doubles for each value."""

    def distance(self, x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Distance of each row to its centre (rows of equal shape), in the metric of ``bound``."""

    def bound(self, q: np.ndarray, cells: Cells) -> np.ndarray:
        """queries x cells: no row of the cell scores higher."""

    def top(self, q: "Side", c: "Side", k: int, floor: np.ndarray, same: bool
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, reference row, score): for each query at least its k best rows not below its
        floor, ties by reference row; with ``same``, rows of the query's own id are left out."""


@dataclass
class Side:
    ids: np.ndarray
    values: Sequence[Any]
    features: np.ndarray

    def take(self, rows: np.ndarray) -> "Side":
        return Side(self.ids[rows], [self.values[i] for i in rows.tolist()], self.features[rows])


def best_of(q: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query row, ties by reference row, with their rank from 1."""
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    fine = rank <= k
    return q[fine], c[fine], score[fine], rank[fine]


# ---------------------------------------------------------------- cells

def _centres(x: np.ndarray, cells: int, seed: int = 3, rounds: int = 6) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = np.unique(x[np.sort(r.choice(len(x), min(cells, len(x)), replace=False))], axis=0)
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        centres = np.stack([x[near == i].mean(axis=0) for i in np.unique(near)])
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, _PAIRS // len(centres))
    half = (centres ** 2).sum(axis=1) / 2
    return np.concatenate([(x[i:i + step] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), step)]
                          or [np.zeros(0, np.int64)])


def _fit(sample: dict[str, np.ndarray], rows: dict[str, int], cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, centre) of every cell: about the square root of a part's rows, fewer for a small sample."""
    parts, centres = [], []
    for part, n in sorted(rows.items()):
        x = sample[part]
        cells = max(1, min(MAX_CELLS, int(n ** 0.5), n // cell_rows, len(x) // 8))
        made = _centres(x, cells)
        parts += [part] * len(made)
        centres.append(made)
    return np.array(parts, object), np.concatenate(centres)


def _assign(x: np.ndarray, part: np.ndarray, parts: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for p in pd.unique(part):
        rows, cells = np.flatnonzero(part == p), np.flatnonzero(parts == p)
        out[rows] = cells[nearest_centre(x[rows], centres[cells])]
    return out


def bounds(metric: Metric, cells: Cells, q: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries x cells bounds, -inf in other parts; home cell of each query): home is the cell with
    the highest bound about its centre among those with more than k rows, if there is one."""
    bound = metric.bound(q, cells)
    bound[part[:, None] != cells.parts[None, :]] = -np.inf
    centre = Cells(cells.parts, cells.centres, np.zeros_like(cells.radius), cells.least, cells.most, cells.rows)
    near = metric.bound(q, centre)
    near[bound == -np.inf] = -np.inf
    full = np.where(cells.rows[None, :] > k, near, np.where(near > -np.inf, -1e300, -np.inf))
    return bound, full.argmax(axis=1)


def slices(queries: pd.DataFrame, q: np.ndarray, cell: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row for each query row ``q`` and its cell, ``_SLICE`` at a time: a query may ask every cell."""
    for lo in range(0, len(q), _SLICE):
        yield queries.iloc[q[lo:lo + _SLICE]].assign(cell=cell[lo:lo + _SLICE])


# ---------------------------------------------------------------- matches

def best_matches(queries: DataFrame, corpus: DataFrame, metric: Metric, k: int = 1, exclude_same_id: bool = False,
                 max_broadcast_bytes: int = 64 << 20, tile_rows: int = 4096, cell_rows: int = 64) -> DataFrame:
    """The ``k`` best corpus rows of every query: (q_id, q_value, c_id, c_value, score, rank), ties by c_id.

    ``queries`` (q_id, q_value) and ``corpus`` (c_id, c_value), ids unique; with a column ``part`` on
    both sides (a text or number of few values) a query meets only rows of its part. Rows without id or value
    take no part. A query has fewer than ``k`` matches only if the corpus (or part) has."""
    by_part = "part" in queries.columns and "part" in corpus.columns
    part = F.col("part").cast("string") if by_part else F.lit("")
    queries = queries.select("q_id", "q_value", part.alias("part")).dropna()
    corpus = corpus.select("c_id", "c_value", part.alias("part")).dropna()
    types = {**dict(queries.dtypes), **dict(corpus.dtypes)}
    schema = f"q_id {types['q_id']}, q_value {types['q_value']}, c_id {types['c_id']}, c_value {types['c_value']}, score double, rank int"

    wide = [F.size("c_value") * 8 if types["c_value"].startswith("array") else F.length("c_value") * 4,
            F.length(F.col("c_id").cast("string")) * 2 + 32]
    counted = {r["part"]: (r["n"], r["size"]) for r in corpus.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(wide[0] + wide[1]).alias("size")).collect()}
    rows = {p: n for p, (n, _) in counted.items()}
    if not rows:
        return queries.sparkSession.createDataFrame([], schema)

    def side(pdf: pd.DataFrame, own: str) -> Side:
        values = list(pdf[f"{own}_value"])
        return Side(pdf[f"{own}_id"].to_numpy(), values, metric.features(values))

    def frame(q: Side, c: Side, qi, ci, score, rank) -> pd.DataFrame:
        return pd.DataFrame({"q_id": q.ids[qi], "q_value": pd.Series([q.values[i] for i in qi], dtype=object), "c_id": c.ids[ci],
                             "c_value": pd.Series([c.values[i] for i in ci], dtype=object), "score": score, "rank": rank})

    if sum(size for _, size in counted.values()) <= max_broadcast_bytes:
        table = corpus.toPandas().sort_values("c_id", ignore_index=True)
        whole, of = side(table, "c"), table["part"].to_numpy()
        few = np.sort(np.random.default_rng(1).permutation(len(of))[:SAMPLE])
        sample = {p: whole.features[few[of[few] == p]] if (of[few] == p).any() else whole.features[of == p][:1] for p in rows}
        parts, centres = _fit(sample, rows, cell_rows)
        cell = _assign(whole.features, of, parts, centres)
        shared = queries.sparkSession.sparkContext.broadcast((
            whole, _statistics(metric, whole.features, cell, parts, centres),
            [np.flatnonzero(cell == i) for i in range(len(centres))]))

        def in_place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c, cells, members = shared.value
            sides = [c.take(m) for m in members]
            for batch in batches:
                for lo in range(0, len(batch), 1024):
                    q = side(pdf := batch.iloc[lo:lo + 1024], "q")
                    found = _search(metric, cells, members, sides, q, pdf["part"].to_numpy(), k, exclude_same_id)
                    yield frame(q, c, *found)

        return queries.mapInPandas(in_place, schema)

    share = F.pmod(F.xxhash64("c_id", F.lit(13)), F.lit(1 << 30)) < -(-(SAMPLE << 30) // sum(rows.values()))
    some = corpus.where(share).toPandas()  # about SAMPLE rows
    lost = [p for p in rows if not (some["part"] == p).any()]
    if lost:  # a first row for each part the sample has none of
        some = pd.concat([some, corpus.where(F.col("part").isin(lost)).groupBy("part").agg(
            F.min_by("c_value", "c_id").alias("c_value")).toPandas()])
    parts, centres = _fit({p: metric.features(list(x["c_value"])) for p, x in some.groupby("part")}, rows, cell_rows)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = metric.features(list(pdf["c_value"]))
                cell = _assign(x, pdf["part"].to_numpy(), parts, centres)
                yield pdf[["c_id", "c_value"]].assign(cell=cell, far=metric.distance(x, centres[cell]), total=x.sum(axis=1))

    dealt = materialize(corpus.mapInPandas(
        assign, f"c_id {types['c_id']}, c_value {types['c_value']}, cell long, far double, total double"), "cells")
    cells = Cells(parts, centres, *np.zeros((4, len(centres))))
    for r in dealt.groupBy("cell").agg(F.max("far"), F.min("total"), F.max("total"), F.count(F.lit(1))).collect():
        cells.radius[r[0]], cells.least[r[0]], cells.most[r[0]], cells.rows[r[0]] = r[1:]

    def probe(early: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), 1024):
                    some = pdf.iloc[lo:lo + 1024]
                    bound, home = bounds(metric, cells, metric.features(list(some["q_value"])), some["part"].to_numpy(), k)
                    if early:
                        q, cell = np.arange(len(some)), home
                        fine = bound[q, home] > -np.inf
                        q, cell = q[fine], cell[fine]
                    else:
                        bound[np.arange(len(some)), home] = -np.inf
                        floor = some["floor"].to_numpy()
                        q, cell = np.nonzero((bound > -np.inf) & (bound >= (floor - _slack(floor))[:, None]))
                    yield from slices(some.drop(columns="part"), q, cell)
        return run

    def meet(asked: DataFrame) -> DataFrame:
        wanted = {r[0]: r[1] for r in asked.groupBy("cell").count().collect()}  # at most the cells
        deal = F.broadcast(asked.sparkSession.createDataFrame(
            [(i, max(1, -(-int(cells.rows[i]) // tile_rows)), -(-n // tile_rows)) for i, n in wanted.items()],
            "cell long, c_blocks long, q_blocks long"))

        def cut(df: DataFrame, own: str, other: str) -> DataFrame:
            return (df.join(deal, "cell").withColumn(f"{own}_block", F.pmod(F.xxhash64(f"{own}_id"), F.col(f"{own}_blocks")))
                    .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)))
                    .drop("c_blocks", "q_blocks"))

        def pair(_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if q.empty or c.empty:
                return pd.DataFrame(columns=["q_id", "q_value", "c_id", "c_value", "score", "rank"], dtype=object)
            one, other = side(q, "q"), side(c.sort_values("c_id", ignore_index=True), "c")
            found = metric.top(one, other, k, q["floor"].to_numpy(), exclude_same_id)
            return frame(one, other, *best_of(*found, k))

        keys = ["cell", "q_block", "c_block"]
        return (cut(asked, "q", "c").groupBy(*keys).cogroup(cut(dealt.drop("far", "total"), "c", "q").groupBy(*keys))
                .applyInPandas(pair, schema))

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q_id").orderBy(F.desc("score"), "c_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = f"q_id {types['q_id']}, q_value {types['q_value']}, floor double, cell long"
    lowest = queries.withColumn("floor", F.lit(float("-inf")))
    first = materialize(best(meet(materialize(lowest.mapInPandas(probe(True), asked), "asked"))), "first")
    floors = first.where(F.col("rank") == k).select("q_id", F.col("score").alias("floor"))
    rest = (queries.join(floors, "q_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
            .select("q_id", "q_value", "part", "floor").mapInPandas(probe(False), asked))
    rest = materialize(rest, "asked")
    if rest.isEmpty():
        return first
    return best(first.unionByName(meet(rest)))


def _slack(score: np.ndarray) -> np.ndarray:
    """What rounding may take from a bound."""
    return np.where(np.isfinite(score), 1e-9 * (1 + np.abs(score)), 0.0)


def _statistics(metric: Metric, x: np.ndarray, cell: np.ndarray, parts: np.ndarray, centres: np.ndarray) -> Cells:
    n = len(centres)
    far, total = metric.distance(x, centres[cell]), x.sum(axis=1)
    radius, least, most = np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)
    np.maximum.at(radius, cell, far), np.minimum.at(least, cell, total), np.maximum.at(most, cell, total)
    return Cells(parts, centres, radius, least, most, np.bincount(cell, minlength=n))


def _search(metric: Metric, cells: Cells, members: list[np.ndarray], sides: list[Side], q: Side, part: np.ndarray,
            k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best reference rows (numbers of the whole table) of each query, cell by cell."""
    bound, home = bounds(metric, cells, q.features, part, k)
    floor = np.full(len(q.ids), -np.inf)
    found = []

    def ask(cell: int, rows: np.ndarray) -> None:
        if len(rows) and len(members[cell]):
            i, j, score = metric.top(q.take(rows), sides[cell], k, floor[rows], same)
            found.append((rows[i], members[cell][j], score))

    for cell in np.unique(home).tolist():
        ask(cell, np.flatnonzero((home == cell) & (bound[:, cell] > -np.inf)))
    if found:
        i, _, score, rank = best_of(*map(np.concatenate, zip(*found)), k)
        floor[i[rank == k]] = score[rank == k]
    bound[np.arange(len(home)), home] = -np.inf
    open_ = (bound > -np.inf) & (bound >= (floor - _slack(floor))[:, None])
    for cell in np.flatnonzero(open_.any(axis=0)).tolist():
        ask(cell, np.flatnonzero(open_[:, cell]))
    none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    return best_of(*map(np.concatenate, zip(*(found or none))), k)
