import random

from data import awkward, frame, prose
from marketloom.llm import decontaminate


def items(spark, r, n=20):
    rows = [(i, prose(r, r.randint(14, 60), "abcdefghijklmnop") + ".") for i in range(n)]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_finds_copies_and_paraphrases_only(spark):
    r = random.Random(4)
    bench, table = items(spark, r)
    rows, want = [], set()
    for i in range(200):
        words = prose(r, r.randint(20, 300), "abcdefghijklmnop").split()
        if i % 4 == 0:
            k = r.randrange(len(bench))
            passage = bench[k][1].upper().split() if i % 8 == 0 else bench[k][1].split()
            if i % 3 == 0:  # a paraphrase: every sixth word another, one left out
                passage = [w if j % 6 else "zz" + w for j, w in enumerate(passage)]
                del passage[len(passage) // 2]
            at = r.randint(0, len(words))
            words[at:at] = passage
            want.add((i, k))
        elif i % 4 == 1:  # half of an item is no copy
            k = r.randrange(len(bench))
            words[3:3] = bench[k][1].split()[:len(bench[k][1].split()) * 2 // 5]
        rows.append((i, " ".join(words)))
    docs = frame(spark, rows)
    got = decontaminate.contaminated(docs, table)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    clean = decontaminate.decontaminate(docs, table)
    assert {x.doc_id for x in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert clean.columns == docs.columns


def test_longest_common_subsequence():
    import numpy as np

    r = random.Random(1)
    for _ in range(50):
        a = [r.randint(1, 6) for _ in range(r.randint(1, 70))]
        b = [r.randint(0, 6) for _ in range(r.randint(0, 90))]
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        assert decontaminate.lcs(np.array(a), np.array(b, np.int64)) == row[-1]


def test_awkward_rows(spark):
    rows = awkward(random.Random(1))
    docs = frame(spark, rows)
    empty = spark.createDataFrame([], "item_id long, text string")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "one of the items in the list here"),
                                 (4, "one of the items in the list here")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, empty).count() == len(rows)
    assert decontaminate.decontaminate(docs, odd).count() == len(rows)
    assert decontaminate.contaminated(frame(spark, rows[:0]), odd).collect() == []


def test_short_and_light_items_among_foreign_and_common_words(spark):
    r = random.Random(8)
    common = [prose(r, 1, "abcd") + "q" + str(i) for i in range(40)]
    texts = [" ".join(r.sample(common, n)) for n in (1, 2, 3, 4, 5, 6, 8, 12, 20)]
    texts += [" ".join(prose(r, 30, "ijklm").split()) for _ in range(20)]  # heavy, rare words
    table = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, " ".join([*(f"zz{r.random()}" for _ in range(21 + i)), t, *(f"zz{r.random()}" for _ in range(40))]))
            for i, t in enumerate(texts[:9])]
    rows += [(100 + i, " ".join([*r.choices(common, k=25), t, *r.choices(common, k=25)]))
             for i, t in enumerate(texts[:9])]
    rows += [(1_000 + i, " ".join(r.choices(common, k=60))) for i in range(400)]
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(frame(spark, rows), table).collect()}
    words = {i: t.split() for i, t in rows}

    def holds(w, item):
        return any(w[j:j + len(item)] == item for j in range(len(w)))

    want = {(d, k) for d, w in words.items() for k, t in enumerate(texts) if holds(w, t.split())}
    assert {(i, i) for i in range(9)} | {(100 + i, i) for i in range(9)} <= want <= got
    assert {(d, k) for d, k in got if k < 4} == {(d, k) for d, k in want if k < 4}  # short: word for word only


def test_postings_lose_no_pair_and_cosine_few(spark):
    """Against every window and item by brute force: equal without the cosine, recall 0.9 with it."""
    r = random.Random(11)
    words = prose(r, 120, "abcde").split()
    bench = [" ".join(r.choices(words, k=r.randint(5, 50))) for _ in range(15)]
    rows = []
    for i in range(60):
        text = r.choices(words, k=r.randint(1, 250))
        if i % 2:
            item = [w for w in r.choice(bench).split() if r.random() < 0.8]
            at = r.randint(0, len(text))
            text[at:at] = [x for w in item for x in ([w, "foreign"] if r.random() < 0.3 else [w])]
        rows.append((i, " ".join(text)))
    want = set()
    sides = [decontaminate.tokens(t) for t in bench]
    for doc, text in rows:
        w = decontaminate.tokens(text)
        for k, item in enumerate(sides):
            tail = item[-max(2, len(item) // 3):]
            for start in range(0, max(1, len(w) - 16), 16):
                around = w[max(0, start - len(item)):start + 32 + len(item)]
                if common(item, around) >= 0.6 * len(item) - 1e-9 and common(tail, around) >= 0.4 * len(tail):
                    want.add((doc, k))
    table = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    docs = frame(spark, rows)
    every = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, table, cosine=-2.0).collect()}
    assert every == want and len(want) > 20
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, table).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_a_large_benchmark_is_searched_in_parts(spark, monkeypatch):
    r = random.Random(6)
    bench, table = items(spark, r, 30)
    rows = [(i, " ".join([prose(r, 30), t, prose(r, 30)])) for i, t in bench]
    monkeypatch.setattr(decontaminate, "parts_of", lambda b, of=decontaminate.parts_of: of(b, 1_500))
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(frame(spark, rows), table).collect()}
    assert len(decontaminate.parts_of(table)) > 3
    assert got == {(i, i) for i, _ in bench}


def test_the_latent_space_sums_every_passage_of_every_document(spark, monkeypatch):
    import numpy as np

    r = random.Random(9)
    bench, table = items(spark, r, 6)
    known = decontaminate.read_items(table)
    vocabulary = [w.decode() for w in known.vocabulary]
    rows = [(i, " ".join(r.choice([*vocabulary, "zz", "yy"]) for _ in range(r.randint(0, 150)))) for i in range(40)]
    rows.append((40, " ".join(r.choice(vocabulary) for _ in range(40_000))))
    coded = decontaminate.encode(frame(spark, rows), known)
    known = decontaminate.fit(known, coded)
    size = len(known.idf)
    want = np.zeros((size, size))
    for w in [*known.words, *[np.array([known.vocabulary.get(x, 0) for x in decontaminate.tokens(t)]) for _, t in rows]]:
        for i in range(0, len(w), known.window):
            c = np.bincount(w[i:i + known.window].astype(int), minlength=size) * known.idf
            c[0] = 0
            if c.any():
                c /= np.linalg.norm(c)
                want += np.outer(c, c)
    for pairs in (decontaminate.PAIRS, 8_192):  # all sums held, or handed on
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        assert (size * size > 2 * pairs) == (pairs == 8_192)
        got = np.zeros((size, size))
        for x in decontaminate.products(coded, known).collect():
            got[x.a, x.b] += x.v
        assert np.allclose(got, want)


def test_pairs_are_summed_once_and_in_bounded_memory():
    """Pipeline and op6 of round 3: a task held half a gigabyte and made every pair twice."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    key, value = decontaminate.meetings(np.arange(1, 33), np.zeros(32, int), np.ones(40), 32)
    assert len(set(key.tolist())) == len(key) == 32 * 33 // 2 and np.allclose(value, 1 / 32)
    for size in (3_500, 12_000):  # all sums held, or handed on
        words = r.integers(0, size, (600, 1_000)).astype(np.uint16)
        batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([w.tobytes() for w in words], pa.binary())],
                                           ["doc_id", "words"])
        rows = total = 0
        tracemalloc.start()
        for x in decontaminate.sums(iter([batch]), np.uint16, np.ones(size), 32):
            a, b, v = (c.to_numpy() for c in x.columns)
            assert (1 <= a).all() and (a <= b).all() and (b < size).all()
            rows += len(a)
            total += float(v[a == b].sum())
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
        tracemalloc.stop()
        assert rows > 3_000_000
        assert abs(total - 600 * 32) < 1e-6 * total  # the squares of a passage's shares sum to one


def test_a_task_holds_its_sums_once():
    """Pipeline of round 3: keys and values of all sums stood beside the sums themselves."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r, size = np.random.default_rng(5), 3_500
    words = r.integers(0, size, (300, 1_000)).astype(np.uint16)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([w.tobytes() for w in words], pa.binary())],
                                       ["doc_id", "words"])
    tracemalloc.start()
    rows = sum(x.num_rows for x in decontaminate.sums(iter([batch]), np.uint16, np.ones(size), 32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 2_000_000 and peak < size * (size + 1) // 2 * 8 + (20 << 20)


def test_items_need_no_python_workers_of_their_own(spark):
    """Pipeline of round 3: rows of a list went through a second set of workers beside those of the sums."""
    import numpy as np

    _, table = items(spark, random.Random(3), 5)
    known = decontaminate.read_items(table)
    known.idf = np.ones(len(known.vocabulary) + 1)
    plan = decontaminate.products(decontaminate.encode(frame(spark, [(1, "abc")]), known), known)
    parts = plan._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
    assert sum("LocalRelation [doc_id" in x for x in parts) == 1 and len(parts) == 4


def test_a_worker_gives_back_freed_blocks():
    """Pipeline of round 3: workers kept what earlier tasks had freed, beside the sums."""
    import platform
    from pathlib import Path

    import pytest

    from marketloom.llm.common import slices

    if platform.libc_ver()[0] != "glibc":
        pytest.skip("blocks are kept by glibc")

    def held():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    blocks = [bytes(2_000) for _ in range(50_000)]
    top = blocks[-1]  # keeps the heap from shrinking at its end
    blocks.clear()
    before = held()
    assert list(slices(iter([]))) == [] and len(top) == 2_000
    assert before - held() > 50_000_000
