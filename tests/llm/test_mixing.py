import random

import pytest

from data import awkward, frame, prose
from marketloom.llm import mixing


def targets(sizes):
    """Targets by plain water filling, sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, out = sum(sizes.values()), {}
    left = set(order)
    while left:
        rest = total - sum(out.values())
        level = rest / sum(weight[s] for s in left)
        full = {s for s in left if 3 * sizes[s] <= level * weight[s]}
        if not full:
            return {**out, **{s: level * weight[s] for s in left}}
        out.update({s: 3.0 * sizes[s] for s in full})
        left -= full
    return out


def test_mix_against_plain_python(spark):
    r = random.Random(5)
    rows = [(i, prose(r, r.randint(1, 40)), "en", r.choice(["a", "a", "a", "a", "b", "c", "é", None]))
            for i in range(600)] + [(900, None, "en", "z"), (901, "", "en", "a")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    total = {}
    for i, _, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    want = targets(total)
    taken = {}
    for x in got:
        assert x.size == size[x.doc_id] and x.source_size == total[x.source]
        assert x.target == pytest.approx(want[x.source])
        assert x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 20 + 1e-6 for s in want)  # half the longest document
    assert sorted(got, key=str) == sorted(mixing.mix(docs).select(*got[0].__fields__).collect(), key=str)


def test_keys_order_the_cut_and_follow_weights(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, "en", "a" if i < 2000 else "b") for i in range(4000)]
    rows += [(i, "w " * 10, "en", "c") for i in range(4000, 4400)]
    docs = frame(spark, rows)
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    keyed = mixing.mix(docs, weight).withColumn("key", mixing.exponential_key(F.col("doc_id"), weight, 7)).collect()
    a = sorted((x for x in keyed if x.source == "a"), key=lambda x: (x.key, x.doc_id))
    counts = [x.taken for x in a]
    assert counts == sorted(counts, reverse=True) and len(set(counts)) == 2
    more = [x for x in a if x.taken == max(counts)]
    assert sum(x.doc_id % 2 == 0 for x in more) > 0.55 * len(more)


def test_awkward_rows(spark):
    rows = awkward(random.Random(1))
    docs = frame(spark, rows)
    got = mixing.mix(docs.withColumnRenamed("n_chars", "size"))
    assert got.count() == len(rows) and got.columns.count("size") == 1
    assert mixing.mix(frame(spark, rows[:0])).collect() == []
    assert all(x.taken == 0 for x in mixing.mix(frame(spark, [(1, None), (2, "")])).collect())
