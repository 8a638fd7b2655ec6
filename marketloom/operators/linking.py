"""Exact links of vectors and names to a reference set, through the cells of ``cells``."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.cells import Cells, Side, best_matches

_PAIRS = 1 << 22
# fixed values: the characters of a normalised name
NAME_LETTERS = " abcdefghijklmnopqrstuvwxyz0123456789_"


class _Vectors:
    """Scores of vectors: a fast block product finds those that matter, exact sums decide."""

    def features(self, values: Sequence) -> np.ndarray:
        return np.array([np.asarray(v, dtype=float) for v in values])

    def distance(self, x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(((x - centre) ** 2).sum(axis=1))

    def top(self, q: Side, c: Side, k: int, floor: np.ndarray, same: bool):
        rows, cols, scores = [], [], []
        step = max(1, _PAIRS // max(1, len(c.ids)))
        for lo in range(0, len(q.ids), step):
            x = q.features[lo:lo + step]
            s, slack = self._product(x, c.features)
            if same:
                s[q.ids[lo:lo + step, None] == c.ids[None, :]] = -np.inf
            n = min(k, len(c.ids))
            kth = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            i, j = np.nonzero((s >= np.maximum(kth, floor[lo:lo + step])[:, None] - slack) & (s > -np.inf))
            rows.append(lo + i), cols.append(j), scores.append(self._exact(x[i], c.features[j]))
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


@dataclass(frozen=True)
class InnerProduct(_Vectors):
    def _product(self, x, y):
        s = x @ y.T
        return s, 1e-9 * (1 + np.abs(s).max(initial=0))

    def _exact(self, x, y):
        return (x * y).sum(axis=1)

    def bound(self, q: np.ndarray, cells: Cells) -> np.ndarray:
        return q @ cells.centres.T + np.linalg.norm(q, axis=1)[:, None] * cells.radius * (1 + 1e-9)


@dataclass(frozen=True)
class NegativeSquaredDistance(_Vectors):
    def _product(self, x, y):
        middle = y.mean(axis=0)
        x, y = x - middle, y - middle
        a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
        return 2 * x @ y.T - b - a[:, None], 1e-9 * (1 + a.max(initial=0) + b.max(initial=0))

    def _exact(self, x, y):
        return -((x - y) ** 2).sum(axis=1)

    def bound(self, q: np.ndarray, cells: Cells) -> np.ndarray:
        s, slack = self._product(q, cells.centres)
        gap = np.sqrt(np.maximum(0.0, -s)) - cells.radius * (1 + 1e-9)
        return slack - np.maximum(0.0, gap) ** 2


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, all places of ``a`` at once as bits."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for ch in b:
        m = at.get(ch)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass(frozen=True)
class NameRatio:
    """Similarity in percent of two names given as sorted tokens: 2 * (longest common
    subsequence) / (sum of lengths), rounded; 0 if either is empty.

    No common subsequence has more letters than the names share, so letter counts bound the score: it is
    at most 100 - 100 * (sum of count differences) / (sum of lengths). These differences obey the
    triangle inequality, which bounds a whole cell; only pairs that pass are aligned."""

    def features(self, values: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(values), len(NAME_LETTERS)))
        for i, v in enumerate(values):
            out[i] = [v.count(ch) for ch in NAME_LETTERS]
        return out

    def distance(self, x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.abs(x - centre).sum(axis=1)

    @staticmethod
    def _differences(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(c)))
        for letter in range(q.shape[1]):
            out += np.abs(q[:, letter, None] - c[None, :, letter])
        return out

    def bound(self, q: np.ndarray, cells: Cells) -> np.ndarray:
        n = q.sum(axis=1)[:, None]
        least = np.maximum(self._differences(q, cells.centres) - cells.radius * (1 + 1e-9),
                           np.maximum(n - cells.most, cells.least - n))
        return np.rint(100 - 100 * np.maximum(least, 0.0) / np.maximum(n + cells.most, 1) + 1e-6)

    def top(self, q: Side, c: Side, k: int, floor: np.ndarray, same: bool):
        found: list[tuple[int, int, float]] = []
        step = max(1, _PAIRS // max(1, len(c.ids)))
        sizes = c.features.sum(axis=1)
        for lo in range(0, len(q.ids), step):
            x = q.features[lo:lo + step]
            total = x.sum(axis=1)[:, None] + sizes
            most = np.rint(100 * (total - self._differences(x, c.features)) / np.maximum(total, 1) + 1e-9)
            for i, name in enumerate(q.values[lo:lo + step], lo):
                best: list[float] = []
                for j in np.argsort(-most[i - lo], kind="stable").tolist():
                    reach = most[i - lo, j]
                    if reach < floor[i] or (len(best) == k and reach < best[0]):
                        break
                    if same and q.ids[i] == c.ids[j]:
                        continue
                    other = c.values[j]
                    score = float(np.rint(200.0 * lcs_length(name, other) / (len(name) + len(other)))) if name and other else 0.0
                    found.append((i, j, score))
                    heapq.heappush(best, score) if len(best) < k else heapq.heappushpop(best, score)
        i, j, score = zip(*found) if found else ((), (), ())
        return np.array(i, np.int64), np.array(j, np.int64), np.array(score, float)


def sorted_tokens(name: Column) -> Column:
    """ASCII letters, digits and underscores in lower case, tokens sorted."""
    ascii_ = F.regexp_replace(name, r"[^\x00-\x7F]", "")
    tokens = F.split(F.lower(F.regexp_replace(ascii_, "[^A-Za-z0-9_]", " ")), " +")
    return F.array_join(F.array_sort(F.filter(tokens, lambda w: w != "")), " ")


def link_vectors(entities: DataFrame, tickers: DataFrame, k: int = 1, **kw) -> DataFrame:
    """Nearest ticker vectors by inner product: (q_id, c_id, score, rank)."""
    return best_matches(entities, tickers, InnerProduct(), k, **kw).select("q_id", "c_id", "score", "rank")


def link_names(names: DataFrame, titles: DataFrame, k: int = 5, **kw) -> DataFrame:
    """Best ``k`` titles for each distinct name by token-sort ratio: (name, title, score, rank)."""
    q = names.select(F.col("name").alias("q_id"), sorted_tokens(F.col("name")).alias("q_value"))
    c = titles.select(F.col("title").alias("c_id"), sorted_tokens(F.col("title")).alias("c_value"))
    return best_matches(q.dropDuplicates(["q_id"]), c.dropDuplicates(["c_id"]), NameRatio(), k, **kw).select(
        F.col("q_id").alias("name"), F.col("c_id").alias("title"), "score", "rank")
