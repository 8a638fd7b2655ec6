import hashlib
import random

from pyspark.sql import functions as F

from data import awkward, frame, prose
from marketloom.llm import fingerprint


def parts(text):
    """The paragraphs, cut by hand: pieces of twelve characters up to a blank in the first 96, then runs of 96
    characters that go on for at most 128 up to the end of a sentence."""
    found, i, head = set(), 0, text[:96]
    while i < len(head):
        j = i + 12
        if j > len(head):
            j = len(head)
        else:
            while j < len(head) and not head[j].isspace():
                j += 1
            while j < len(head) and head[j].isspace():
                j += 1
        found.add(head[i:j])
        i = j
    rest, i = text[96:], 0
    while i < len(rest):
        j = i + 96
        if j > len(rest):
            j = len(rest)
        else:
            last = j + 128
            while j < len(rest) and j < last and rest[j] not in ".!?\n":
                j += 1
            while j < len(rest) and rest[j] in ".!?\n":
                j += 1
        found.add(rest[i:j])
        i = j
    return found


def test_short_texts_keep_the_likeness_of_their_unchanged_half(spark):
    r = random.Random(9)
    rows = [(i, prose(r, n)) for i, n in enumerate([14, 15, 16, 20, 30, 40, 60] * 3)]
    got = fingerprint.fingerprints(frame(spark, rows)).collect()
    assert all(x.near_edited > 0 for x in got if x.n_chars >= 40)
    assert all(x.near_edited >= 0.2 for x in got if x.n_chars >= 100)
    assert max(x.near_next for x in got) == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_plain_python(spark):
    r = random.Random(6)
    rows = [(i * r.choice([1, 7]) + 1000 * (i % 3), ". ".join(prose(r, r.randint(5, 20)) for _ in range(r.randint(1, 40))))
            for i in range(120)]
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(100_000, None), (100_001, ""), (100_002, rows[0][1]), (100_003, ". ".join(prose(r, 12) for _ in range(1500)))]
    got = {x.doc_id: x for x in fingerprint.fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows)
    prints = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        x = got[i]
        assert x.n_chars == len(text)
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(x.near_edited - jaccard(parts(text), parts(edited))) < 1e-12
        assert abs(x.near_next - jaccard(parts(text), parts(after))) < 1e-12
        for t, f in ((text, x.fingerprint), (edited, x.edited_fingerprint)):
            assert prints.setdefault(t, f) == f
    assert len(set(prints.values())) == len(prints)


def test_peeling_recovers_the_difference(spark):
    row = spark.createDataFrame([([1, 2, 3, 4, 5], [3, 4, 5, 6])], "a array<long>, b array<long>")
    h = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    state = fingerprint.peel(fingerprint.subtract(fingerprint.cells(h("a")), fingerprint.cells(h("b"))))
    out = row.select(state.alias("s"), fingerprint.peeled(state).alias("ok"), h("a").alias("a"), h("b").alias("b")).first()
    assert out.ok and {(x.h, x.s) for x in out.s.found} == {(out.a[0], 1), (out.a[1], 1), (out.b[3], -1)}


def test_awkward_rows(spark):
    rows = awkward(random.Random(1))
    got = fingerprint.fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert fingerprint.fingerprints(frame(spark, rows[:0])).collect() == []
    one = fingerprint.fingerprints(frame(spark, [(5, "alone")])).first()
    assert one.near_next == 1.0
