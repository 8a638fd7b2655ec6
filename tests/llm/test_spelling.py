import random
import re
import zlib
from collections import Counter

import pytest

from data import awkward, frame, prose
from marketloom.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = sorted(w for w in n if len(w) >= 5 and n[w] >= 3)
    out, form = {}, {}
    for w in words:
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [n[w], len(close), n[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def texts(seed, letters="abÀ", n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(80)]
        rows.append((i, " ".join(w.title() if r.random() < 0.2 else w for w in words)))
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_variants_equal_brute_force(spark, block):
    rows = texts(5) + [(i, "the window windows windov Window windo " * (i % 5)) for i in range(40)]
    found = got(spelling.variants(frame(spark, rows), block=block))
    want = brute(rows)
    assert found == want
    assert any(v[0] for v in want.values()) and max(v[3] for v in want.values()) > 5


def test_chains_reach_their_end(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert dict(spelling.roots(forms).collect()) == {w: "bbbbb" for w in chain[:-1]}


def test_awkward_rows(spark):
    r = random.Random(2)
    rows = [x[:2] for x in awkward(r)] + [(8, "Zürich×Zürich÷ " * 4), (None, "slips slips slips" * 3), (9, "y" * 300 + " "
            + "y" * 299 + " " + ("y" * 300 + " ") * 3 + ("y" * 299 + " ") * 2)]
    df = frame(spark, rows).withColumnsRenamed({"lang": "word", "source": "key", "n_chars": "n"})
    assert got(spelling.variants(df)) == brute(rows)
    assert got(spelling.variants(frame(spark, rows[:0]))) == {}


def test_long_texts_are_read_whole(monkeypatch):
    text = prose(random.Random(1), 200)
    whole = list(spelling.runs(text))
    monkeypatch.setattr(spelling, "_LONG", 10)
    assert list(spelling.runs(text)) == whole
