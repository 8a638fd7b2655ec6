import random

from pyspark.sql import functions as F

from data import awkward, frame, prose
from marketloom.llm import toxicity
from marketloom.llm.common import fold

BAD = ["grumblefink", "snotzel", "dreckwurm", "blorfo"]


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain(word, terms, stems):
    """The best (kind, term) by distances to all terms and to all beginnings for stems."""
    found = []
    for t in terms:
        d = distance(word, t)
        if d <= toxicity.allowed(t):
            found.append(("exact" if d == 0 else "short" if len(t) < 5 else ("near", "far")[d - 1], t))
    for s in stems:
        d = min(distance(word[:n], s) for n in range(len(word) + 1))
        if d <= 1:
            found.append((("stem", "stem_near")[d], s))
    return min(((toxicity.KINDS.index(k), t) for k, t in found), default=None)


def test_automaton_equals_edit_distance():
    r = random.Random(1)
    terms, stems = ["abcde", "abcdeabcd", "bad", "cabab", "dadax", "eeabbaceda"], ["dada", "eca", "bbcad"]
    machine = toxicity.Automaton(terms, stems)
    kinds = set()
    for _ in range(6_000):
        base = list(r.choice(terms + ["dadaX", "ecabe"]))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(base))
            if r.random() < 0.3 and k:
                base[k - 1], base[k] = base[k], base[k - 1]
            else:
                base[k:k + r.randint(0, 1)] = r.choice(["", "a", "b", "e"])
            base = base or ["a"]
        word = "".join(base)
        got, want = machine.match(word), plain(word, terms, stems)
        known = {}
        machine.find_all([word, "zzz" + word, "q"], known)
        assert known[word] == got, word
        assert got == (want and (toxicity.KINDS[want[0]], want[1])), word
        kinds.add(got and got[0])
    assert kinds == {*toxicity.KINDS, None}


def test_misspellings_that_were_cut_away():
    machine = toxicity.Automaton(["idiot"], ["blorf"])
    for word, kind in (("diot", "near"), ("xdiot", "near"), ("idoit", "near"), ("id1ot", "near"), ("blrfo", "stem_near"), ("blorfing", "stem")):
        assert machine.match(word)[0] == kind
    machine = toxicity.Automaton(["idiot", "moron"], [])
    for text in ("what an id1ot he is", "m0ron!", "you m*ron", "the idi0t.", "1diot"):
        assert toxicity.counts(text, {}, machine)[toxicity.FEATURES.index("near")] > 0, text
    assert not any(toxicity.counts("a1b2 c-d e.f 10x", {}, machine))
    assert not any(toxicity.counts("x" * 200_000 + " " + "x1" * 100_000 + "7" * 100_000, {}, machine))


def corpus(r, n=500):
    rows, labels = [], []
    for i in range(n):
        words = prose(r, r.randint(30, 90)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_misspelled_and_quoted(spark):
    rows, labels = corpus(random.Random(3))
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).where(fold(F.col("doc_id"), 5) == 0).collect()
    truth = dict(labels)
    assert sum((x.score >= 0.5) == (truth[x.doc_id] == 1) for x in got) >= 0.97 * len(got)
    clean = prose(random.Random(4), 40)
    probe = {x.doc_id: x.score for x in toxicity.score(frame(spark, [
        (1, clean), (2, clean + " you grumblefunk dreckwrm snotzeI"), (3, clean + ' he said the word "snotzel" ')]), model).collect()}
    assert probe[1] < 0.5 < probe[2] and probe[3] < probe[2]


def test_awkward_rows_and_missing_labels(spark):
    rows = awkward(random.Random(1))
    docs = frame(spark, rows)
    none = spark.createDataFrame([(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    got = toxicity.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == len(rows) and all(x.score == 0.5 for x in got)
    assert toxicity.score(frame(spark, rows[:0]), model).collect() == []
