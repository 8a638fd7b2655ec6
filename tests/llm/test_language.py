import itertools
import random

import numpy as np

from data import awkward, frame
from marketloom.llm import language

WORDS = {"aa": "the of and that with from house river green water", "bb": "der die und nicht haus fluss wasser schule wenn",
         "cc": "que para los las casa agua verde pueblo cuando"}


def corpus(r, n=300):
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(3, 40))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1))
    docs = frame(spark, rows)
    got = language.identify(docs.drop("lang"), language.fit(docs, each=50)).where(
        language.held_out(docs["doc_id"])).collect()
    truth = {i: lang for i, _, lang in rows}
    assert got and sum(x.lang_pred == truth[x.doc_id] for x in got) >= 0.98 * len(got)
    assert all(0 <= x.score <= 1 for x in got)


def test_forward_sums_all_segmentations():
    index = {"▁": 1, "a": 2, "b": 3, "▁a": 4, "ab": 5, "▁ab": 6, "ba": 7}
    prob = np.random.default_rng(1).random((8, 2)) / 8
    words = ["▁aba", "▁abba", "▁b", "▁aqb"]
    model = language.LanguageModel(["x", "y"], np.log(prob))
    got = np.exp(model.word_scores(words, language.Lattice(index)))
    for k, w in enumerate(words):
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(w[at:i])
                    at = i
            parts.append(w[at:])
            if all(p in index or len(p) == 1 for p in parts):
                want += np.prod([prob[index.get(p, 0)] for p in parts], axis=0)
        assert np.allclose(got[k], want)


def test_runs_of_any_length_are_summed_whole():
    index = {"▁": 1, "a": 2, "b": 3, "▁a": 4, "ab": 5, "▁ab": 6, "ba": 7, "abba": 8}
    prob = np.random.default_rng(1).random((9, 2)) / 9
    model, lattice = language.LanguageModel(["x", "y"], np.log(prob)), language.Lattice(index)
    for n in (3, 47, 49, 60, 400, 3_000):
        word = "".join(np.random.default_rng(n).choice(list("abq"), n))
        alpha, scale = [np.ones(2)], np.zeros(2)
        full = "▁" + word
        for j in range(1, len(full) + 1):
            now = sum(alpha[i] * prob[index.get(full[i:j], 0)] for i in range(max(0, j - 4), j)
                      if full[i:j] in index or j - i == 1)
            scale += np.log(now)
            alpha = [a / now for a in alpha] + [np.ones(2)]
        assert np.allclose(model.scores([word], lattice)[0], scale)
        if n < 48:
            assert np.allclose(model.long_score(full, lattice), scale)


def test_awkward_rows(spark):
    rows = awkward(random.Random(1)) + [(30, "12345 ?!"), (31, "q" * 5_000)]
    docs = frame(spark, rows)
    fitted = language.fit(frame(spark, corpus(random.Random(2), 60)), each=20)
    got = {x.doc_id: x for x in language.identify(docs, fitted).collect()}
    assert {got[i].lang_pred for i in (1, 2, 3, 30)} == {"und"} and got[1].score == 0.0
    assert got[31].lang_pred in WORDS
    assert language.identify(docs, None).count() == len(rows)
    assert language.fit(docs.where("doc_id = 1")) is None
    assert language.identify(frame(spark, rows[:0]), fitted).collect() == []
