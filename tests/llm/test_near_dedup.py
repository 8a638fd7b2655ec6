import random

import numpy as np

from data import awkward, frame, prose
from marketloom.llm import near_dedup


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        sets.setdefault(i, []).append(s)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "q" + str(r.randint(0, 999))
    return " ".join(w)


def test_components_equal_brute_force(spark):
    r = random.Random(3)
    rows, i = [], 0
    common = prose(r, 60)
    for group in range(25):
        base = prose(r, r.randint(3, 160)) + (" " + common if group % 3 == 0 else "")
        for _ in range(r.randint(1, 8)):
            rows.append((i, edited(r, base, r.randint(0, max(1, len(base.split()) // 25)))))
            i += 1
    rows += [(i + 1, "ONE Two"), (i + 2, "one\ntwo"), (i + 3, "one two three"), (i + 4, None), (i + 5, " ")]
    got = {x.doc_id: x for x in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert {k: v.component_id for k, v in got.items()} == want
    assert all(v.kept == (k == v.component_id) for k, v in got.items())
    assert got[i + 4].n_shingles == 0 and got[i + 1].n_shingles == 1


def test_awkward_rows(spark):
    rows = awkward(random.Random(1))
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(x.component_id == x.doc_id and x.kept for x in got)
    assert near_dedup.near_duplicates(frame(spark, rows[:0])).collect() == []


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(160, 159)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 161)}}


def test_pruning_keeps_the_threshold():
    least = near_dedup.least_matches(0.75, 1e-5)
    assert least == sorted(least) and least[-1] < 0.75 * near_dedup.PERMS
    lost = 0
    for seed in range(2_000):
        m = np.cumsum(np.random.default_rng(seed).random(near_dedup.PERMS) < 0.75)[near_dedup.BATCH - 1::near_dedup.BATCH]
        lost += bool((m < least).any())
    assert lost <= 2


def test_long_words_and_segments(monkeypatch):
    s = near_dedup.Shingler()
    data = s.words(" ".join(["alpha", "b" * 50, "gamma", "delta", "eps", "zeta", "eta"] * 3))
    whole = s.shingles(data)
    monkeypatch.setattr(near_dedup, "SEGMENT", 40)
    parts = s.shingles(data)
    assert len(parts) == len(whole) == 7
