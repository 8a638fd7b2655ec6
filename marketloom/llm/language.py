"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has its own piece probabilities,
fitted by expectation maximisation on the word counts of a bounded labelled sample: the forward
and backward sums over every segmentation of a word give the expected piece counts. A text is
scored by the forward sums of its words; a word's sums are made once per batch of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import fold, own
from marketloom.session import materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
WORD_PART = 48  # longer runs of letters are summed on their own, and fitted in parts of this length
CACHE = 500_000  # words a task keeps the sums of


def pieces(path: str) -> dict[str, int]:
    """Piece -> index; index 0 stands for a single character outside the vocabulary. Pieces are
    folded to lower case like the texts; the mark of a word's start is kept."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {p.id_to_piece(i).lower() for i in range(p.get_piece_size())}
    names = sorted(n for n in names if re.fullmatch(r"▁?[^\W\d_]+|▁", n))
    if len(names) >= 1 << 16:
        raise ValueError("a vocabulary of at most 65,535 pieces is needed")
    return {n: i + 1 for i, n in enumerate(names)}


def parts(word: str) -> list[str]:
    """The word with the mark of its start, in pieces of at most WORD_PART letters (for the fit only)."""
    return ["▁" + word[:WORD_PART], *(word[i:i + WORD_PART] for i in range(WORD_PART, len(word), WORD_PART))]


def text_words(text: str | None) -> Counter:
    """Counts of the parts of the lower-cased runs of letters."""
    out: Counter = Counter()
    for w, n in Counter(LETTERS.findall((text or "").lower())).items():
        for x in parts(w):
            out[x] += n
    return out


class Lattice:
    """All segmentations of words as edges (word, from, to, piece)."""

    def __init__(self, index: dict[str, int]) -> None:
        # every beginning of a piece, with the piece's number if it is one itself
        self.known = {p[:i]: -1 for p in index for i in range(1, len(p) + 1)} | index
        self.longest = max(map(len, index), default=1)

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        get, out = self.known.get, []
        add = out.append
        for k, w in enumerate(words):
            n = len(w)
            for i in range(n):
                at = k << 28 | i << 22
                p = get(w[i])
                add(at | i + 1 << 16 | (p if p and p > 0 else 0))
                if p is None:
                    continue
                for j in range(i + 2, n + 1):
                    p = get(w[i:j])
                    if p is None:
                        break
                    if p > 0:
                        add(at | j << 16 | p)
        code = np.array(out, np.int64)
        return code >> 28, code >> 22 & 63, code >> 16 & 63, code & 65_535


def _forward(words: list[str], edges, prob: np.ndarray) -> np.ndarray:
    """alpha[word, position, language], summed over all segmentations of each prefix."""
    word, begin, end, piece = edges
    width = max(map(len, words), default=0) + 1
    alpha = np.zeros((len(words), width, prob.shape[1]))
    alpha[:, 0] = 1.0
    order = np.argsort(end, kind="stable")
    cuts = np.searchsorted(end[order], np.arange(1, width + 1))
    for j in range(1, width):
        at = order[cuts[j - 1]:cuts[j]]
        np.add.at(alpha[:, j], word[at], alpha[word[at], begin[at]] * prob[piece[at]])
    return alpha


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # piece x language
    vocabulary: str = VOCABULARY

    def word_scores(self, words: list[str], lattice: Lattice) -> np.ndarray:
        """Log probability of each word in each language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        alpha = _forward(words, lattice.edges(words), np.exp(self.log_prob))
        last = alpha[np.arange(len(words)), [len(w) for w in words]]
        return np.log(np.maximum(last, 1e-300))

    def scores(self, words: list[str], lattice: Lattice) -> np.ndarray:
        """Log probability of each run of letters, summed over all its segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= WORD_PART]
        out[short] = self.word_scores(["▁" + words[i] for i in short], lattice)
        for i, w in enumerate(words):
            if len(w) > WORD_PART:
                out[i] = self.long_score("▁" + w, lattice)
        return out

    def long_score(self, word: str, lattice: Lattice) -> np.ndarray:
        """The same for one run of any length: the sums are kept for the length of the longest piece, and
        scaled where they become small."""
        prob, get, n, reach = np.exp(self.log_prob), lattice.known.get, len(word), lattice.longest
        ring = np.zeros((reach + 1, prob.shape[1]))
        ring[0] = 1.0
        scale = np.zeros(prob.shape[1])
        ends: dict[int, list[tuple[int, int]]] = {}
        for i in range(n):
            p = get(word[i])
            ends.setdefault(i + 1, []).append((i, p if p and p > 0 else 0))
            if p is not None:
                for j in range(i + 2, min(n, i + reach) + 1):
                    p = get(word[i:j])
                    if p is None:
                        break
                    if p > 0:
                        ends.setdefault(j, []).append((i, p))
            here = ends.pop(i + 1)
            ring[(i + 1) % (reach + 1)] = sum(ring[k % (reach + 1)] * prob[piece] for k, piece in here)
            small = ring[(i + 1) % (reach + 1)] < 1e-100
            if small.any():
                ring[:, small] *= 1e100
                scale[small] -= 100 * np.log(10)
        return np.log(np.maximum(ring[n % (reach + 1)], 1e-300)) + scale


def fit(docs: DataFrame, each: int = 400, chars: int = 20_000_000, rounds: int = 3,
        add: float = 0.05, vocabulary: str = VOCABULARY) -> LanguageModel | None:
    """Fit on documents with a language whose crc32(doc_id) mod 3 is not 1.

    About ``each`` documents per language are taken by a hash of doc_id, none with more than
    ``chars`` characters. None when no row has a language and letters."""
    rows = docs.select("doc_id", "lang", "text").where((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull()
                      & F.col("text").isNotNull() & (F.length("text") <= chars))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    some = rows.join(F.broadcast(counts), "lang").where(share * F.col("n") <= each)
    index = pieces(vocabulary)

    def count(batches):
        for b in batches:
            total: dict[str, Counter] = {}
            for lang, text in zip(b["lang"], b["text"]):
                total.setdefault(lang, Counter()).update(text_words(text))
            out = [(k, w, n) for k, c in total.items() for w, n in c.items()]
            yield pd.DataFrame(out, columns=["lang", "word", "n"])

    words = materialize(some.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    if not languages:
        return None
    size, place = len(index) + 1, {k: i for i, k in enumerate(languages)}
    prob = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds):
        def expect(batches, prob=prob):
            lattice, total = Lattice(index), np.zeros((size, len(languages)))
            for b in batches:
                for at in range(0, len(b), 4096):
                    part = b[at:at + 4096]
                    w = part["word"].tolist()
                    edges = word, begin, end, piece = lattice.edges(w)
                    n = np.array([len(x) for x in w])
                    flip = (word, n[word] - end, n[word] - begin, piece)
                    ahead, back = _forward(w, edges, prob), _forward(w, flip, prob)
                    lang = part["lang"].map(place).to_numpy()[word]
                    whole = ahead[word, n[word], lang]
                    share = (ahead[word, begin, lang] * prob[piece, lang]
                             * back[word, n[word] - end, lang] / np.maximum(whole, 1e-300))
                    np.add.at(total, (piece, lang), share * part["n"].to_numpy()[word])
            p, k = np.nonzero(total)
            yield pd.DataFrame({"piece": p, "lang": k, "n": total[p, k]})

        found = (words.mapInPandas(expect, "piece long, lang long, n double")
                 .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas())  # pieces x languages at most
        total = np.full((size, len(languages)), add)
        total[found["piece"], found["lang"]] += found["n"]
        total[0] = add  # a foreign character says nothing about the language
        prob = total / total.sum(axis=0)
        prob[0] = 1.0 / size
    return LanguageModel(languages, np.log(prob), vocabulary)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score, the posterior of that language under equal priors.

    Null texts and texts without a letter, and all texts without a model, get ``und`` and 0. Ties go
    to the first language by name. Input columns of these names are replaced; all rows stay."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    languages, index = model.languages, pieces(model.vocabulary)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lattice, known, table = Lattice(index), {}, np.zeros((0, len(languages)))
        for series in batches:
            out = []
            for at in range(0, len(series), 256):
                counted = [Counter(LETTERS.findall(t.lower())) if t else Counter()
                           for t in series.iloc[at:at + 256]]
                fresh = set().union(*counted) - known.keys()
                if len(known) + len(fresh) > CACHE:
                    known, table = {}, table[:0]
                    fresh = set().union(*counted)
                if fresh:
                    words = list(fresh)
                    known.update(zip(words, range(len(known), len(known) + len(words))))
                    table = np.concatenate([table, *(
                        model.scores(words[i:i + 8192], lattice) for i in range(0, len(words), 8192))])
                for c in counted:
                    if not c:
                        out.append(("und", 0.0))
                        continue
                    rows = np.fromiter(map(known.__getitem__, c), np.int64, len(c))
                    total = np.fromiter(c.values(), float, len(c)) @ table[rows]
                    k = int(total.argmax())
                    out.append((languages[k], float(1 / np.exp(total - total[k]).sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    call = F.pandas_udf(run, "lang_pred string, score double")
    said = own("said")
    return docs.withColumn(said, call(F.col(text))).select(*docs.columns, f"{said}.lang_pred", f"{said}.score")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1
