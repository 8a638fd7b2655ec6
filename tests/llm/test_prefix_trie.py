import hashlib
import random
import zlib

import numpy as np
import pytest

from marketloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, hi long, depth int, n int, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made = (*convs.get(c - int(np.fmod(c, 20)), [])[:h], *own[h:])
        for d in range(len(made) + 1):
            members.setdefault(made[:d], []).append(c)
        ends.setdefault(made, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids.get(p, [])]
        words = len((p[-1][1] if p else "").encode().split())
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below),
                  sum(b[5] for b in below) if below else 1,
                  (len(members[p]) - 1) * words + sum(b[6] for b in below), hashlib.sha256(ids.encode()).hexdigest())
    return sorted(out.values(), key=lambda x: x[:2])


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda x: x[:2])


def talks(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hello there", "one", "a b c", None, " "])))
    same = [(1000 + i, t, "user", f"turn {t}") for i in range(60) for t in range(5)]
    r.shuffle(rows)
    return rows + same


@pytest.mark.parametrize("band, shard_rows", [(16_384, 65_536), (3, 20)])
def test_trie_equals_brute_force(spark, band, shard_rows):
    rows = talks(4)
    assert got(prefix_trie.trie(frame(spark, rows), band, shard_rows)) == brute(rows)


def test_one_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 50)
    rows = [(40, t, "user", f"w{t % 7} x") for t in range(600)] + [(41, t, "user", f"w{t % 7} x") for t in range(300)]
    rows += [(i, 0, "user", "hi") for i in range(20)]
    assert got(prefix_trie.trie(frame(spark, rows), 64, 100)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (None, 0, "user", "lost"), (3, 5, "user", "x y"), (7, 1, "a", "bc"),
            (8, 1, "ab", "c"), (-3, 0, "user", "neg"), (21, 0, "user", "only"), (20, 0, "user", "z " * 30_000), (9, 2, "u", "t"), (9, 2, "u", "t")]
    assert got(prefix_trie.trie(frame(spark, rows))) == brute(rows)
    assert got(prefix_trie.trie(frame(spark, rows[:0]))) == []


def test_ids_of_one_end_are_hashed_in_order(spark):
    ids = random.Random(1).sample(range(-500, 5_000), 900)
    df = spark.createDataFrame([(1, 2, i, True) for i in ids] + [(0, 5, 3, True), (7, 7, 7, False)],
                               "hi long, lo long, conv_id long, ends boolean")
    found = {(r.hi, r.lo): r.ends_sha256 for r in prefix_trie.end_hashes(df, 64).collect()}
    assert found == {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(),
                     (0, 5): hashlib.sha256(b"3").hexdigest()}


def test_slots_are_minimal_and_verified():
    keys = np.random.default_rng(1).integers(0, 1 << 62, (5_000, 2))
    slots = prefix_trie.Slots(keys)
    assert slots.n == 5_000 and sorted(slots.find(keys)) == list(range(5_000))
    assert (slots.find(keys + 1) == -1).all()
