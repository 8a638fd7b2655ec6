import math

import numpy as np
import pytest

from marketloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, v int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "a", 1, 2)
                                  for i, v in rows], SCHEMA)


def brute(rows, every, k):
    rows = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v)
            and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in rows:
        if q % every == 0:
            near = sorted((-float(rows[q] @ v / np.linalg.norm(rows[q]) / np.linalg.norm(v)), i)
                          for i, v in rows.items() if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def clustered(n, seed=1, width=16):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, width)) * 3
    return [(i, centres[min(11, int(r.exponential(3)))] + r.standard_normal(width)) for i in range(n)]


def test_recall_and_order(spark):
    rows = clustered(6_000)
    got, want = found(neighbours.nearest(frame(spark, rows), every=20, leaf_rows=64)), brute(rows, 20, 5)
    assert got.keys() == want.keys()
    assert all(len(v) == 5 and v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) / (5 * len(want)) >= 0.93
    values = dict(rows)
    for q, v in got.items():
        a = values[q].astype(np.float32).astype(float)
        for i, s in v:
            b = values[i].astype(np.float32).astype(float)
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_visits_widen_until_the_recall(spark):
    rows = frame(spark, clustered(3_000))
    index = neighbours.build_index(rows, leaf_rows=32)
    queries = index.rows.where("vec_id % 10 = 0").toPandas()
    truth = neighbours.true_neighbours(queries, index.rows, index.width, 5)
    visits = [neighbours.calibrate(index.tree, truth, queries, index.width, x) for x in (0.3, 0.8, 0.99, 1.0)]
    assert visits == sorted(visits) and visits[0] < visits[2] <= index.tree.leaves
    every_leaf = list(index.tree.best_first(np.ones(16)))
    assert sorted(every_leaf) == list(range(index.tree.leaves))


def test_copies_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rows = [(i, [1, 2, 3, 4]) for i in range(0, 300, 2)] + [(i, x) for i, x in clustered(900, 3, 4) if i % 2]
    got, want = found(neighbours.nearest(frame(spark, rows), every=10, recall=1.0, leaf_rows=64)), brute(rows, 10, 5)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0, 0]), (1, [1, 1, 0]), (2, None), (3, []), (4, [0, 0, 0]), (50, [nan, 1, 1]), (6, [inf, 1, 1]),
            (7, [None, 1, 1]), (None, [1, 0, 0]), (100, [0, 1, 0]), (-50, [0, 0, -1]), (9, [1, 2])]
    want = brute([x for x in rows if x[0] != 9], 50, 5)
    got = found(neighbours.nearest(frame(spark, rows)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert found(neighbours.nearest(frame(spark, rows[:0]))) == {}
    assert found(neighbours.nearest(frame(spark, rows[1:5]))) == {}
    assert found(neighbours.nearest(frame(spark, rows[:1]))) == {}
    twice = [(0, [1, 0]), (0, [1, 0]), (1, [1, 1]), (1, [0, 1])]
    assert len(found(neighbours.nearest(frame(spark, twice)))[0]) == 1
