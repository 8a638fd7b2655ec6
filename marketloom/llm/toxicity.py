"""Toxicity: a learned lexicon, Levenshtein automata over its trie, context windows.

Terms and stems (beginnings shared by several toxic words) are learned from a bounded labelled
sample. All stand in one trie; the automaton that accepts every word within a term's edit distance
(letters left out, added, replaced, or two neighbours swapped, anywhere in the word) walks the trie with an
error count, and its states are made once and kept. Terms below nine letters and stems allow one
edit, longer terms two. Hits with edits on short terms and on stems are counted apart, so that the fit
decides what they are worth. Words with digits or signs inside (``id1ot``) are read as a whole as well as
in their letter runs. Each hit is weighed by the words around it: quotation marks, reporting verbs and
naming ("the word ...") mark quotation, second persons and commands mark abuse. A logistic regression
turns the counts of a text into its score.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import labelled_sample, own
from marketloom.session import materialize

TOKEN = re.compile(r"[^\W\d_]+")
#: Words with digits or signs inside, before or behind them; nothing is tried twice, however long a run is.
MIXED = re.compile(r"(?<![^\W_])(?:\d*+[^\W\d_]++(?:[\d@$!|*+_.'’-]{1,2}[^\W\d_]++)++|\d++[^\W\d_]++"
                   r"|[^\W\d_]++[\d@$!|]{1,2}(?![^\W_]))")
QUOTES = frozenset("\"'“”„«»‘’`>")
REPORT = frozenset("""said says wrote called quoted quote word words term reported alleged claims slur
insult insults dit disait mot mots selon sagte schrieb wort laut dijo dice palabra según""".split())
DIRECT = frozenset("""you your youre u are tu te vous ton ta du dich ihr dein eres tú usted shut go""".split())
WINDOW = 5
KINDS = ["exact", "stem", "near", "far", "stem_near", "short"]
FEATURES = [*KINDS, "quoted", "direct", "per_word", "terms"]
SHORT = 5               # edits of shorter terms are a kind of their own


ANY = "any"             # whatever follows


def allowed(term: str) -> int:
    """Edits a term may have."""
    return 1 if len(term) < 9 else 2


def left_out(word: str) -> Iterator[str]:
    """The word without one of its letters."""
    for i in range(len(word)):
        yield word[:i] + word[i + 1:]


_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Deletions:
    """Strings that terms and stems become when letters are left out, to dismiss words in bulk.

    Two words k edits (or swaps) apart become one string when at most k letters of each are left out. The
    strings of many words with one letter left out are compared as running polynomial hashes, all at once; what
    passes by chance is settled by the automaton."""

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        far = [t for t in terms if allowed(t) > 1]
        self.one = self._hashes({x for t in terms for x in (t, *left_out(t))})
        self.stems = self._hashes({x for s in stems for x in (s, *left_out(s))})
        self.sizes = sorted({len(s) for s in stems})
        self.two = self._hashes({y for t in far for x in (t, *left_out(t)) for y in (x, *left_out(x))})
        self.letters = np.unique([sum({1 << ord(c) % 64 for c in t}) for t in far]).astype(np.uint64)
        self.reach = (min(map(len, far), default=0) - 2, max(map(len, far), default=-3) + 2)

    @staticmethod
    def _hashes(words) -> np.ndarray:
        return np.unique(np.array([sum(ord(c) * pow(_BASE, i, 1 << 64) for i, c in enumerate(w)) % (1 << 64) for w in words], np.uint64))

    @staticmethod
    def _known(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(x), bool)
        return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x

    def may(self, words: list[str]) -> np.ndarray:
        """Whether each word (none empty) may have so few edits that a term or stem allows them."""
        size = np.array([len(w) for w in words])
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(flat)
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n + 1, _BACK, np.uint64)])
        total = np.r_[np.uint64(0), np.cumsum(flat * up[:n])]
        end = np.cumsum(size)
        start = end - size
        word = np.repeat(np.arange(len(words)), size)
        at, begin = np.arange(n), start[word]
        out = self._known((total[end] - total[start]) * down[start], self.one)

        def without(stop: np.ndarray, known: np.ndarray, rows: np.ndarray) -> None:
            """Words that, cut at ``stop`` and without the letter at ``rows``, are known."""
            w, i, s = word[rows], at[rows], begin[rows]
            h = (total[i] - total[s]) * down[s] + (total[stop[w]] - total[i + 1]) * down[s + 1]
            out[w[self._known(h, known)]] = True

        without(end, self.one, at)
        for k in self.sizes:
            for head in (k, k - 1):
                stop = np.minimum(end, start + head)
                out |= self._known((total[stop] - total[start]) * down[start], self.stems)
            for head in (k, k + 1):
                stop = np.minimum(end, start + head)
                without(stop, self.stems, np.flatnonzero(at - begin < head))
        if len(self.letters):
            masks = np.bitwise_or.reduceat(np.uint64(1) << flat % np.uint64(64), start)
            long = np.flatnonzero(~out & (size >= self.reach[0]) & (size <= self.reach[1]))
            near = np.zeros(len(long), bool)
            for m in self.letters:
                near |= np.bitwise_count(m & ~masks[long]) <= 2
            long = long[near]
            out[long] = self._known((total[end[long]] - total[start[long]]) * down[start[long]], self.two)
            without(end, self.two, np.flatnonzero(np.isin(word, long)))
            for n in np.unique(size[long]).tolist():
                w = long[size[long] == n]
                i, j = np.triu_indices(n, 1)
                s = start[w][:, None]
                h = ((total[s + i] - total[s]) * down[s] + (total[s + j] - total[s + i + 1]) * down[s + 1]
                     + (total[s + n] - total[s + j + 1]) * down[s + 2])
                out[w] |= self._known(h.ravel(), self.two).reshape(h.shape).any(axis=1)
        return out


class Automaton:
    """Words within the edit distance of a trie's terms; a stem also accepts any continuation.

    A state is the set of ((trie node, need), errors) reached, need being the letter that must follow to end
    a swap, or ANY after a stem; states and steps are made when first met.
    """

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.words = list(terms), list(stems)
        self.next: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        for word in terms:
            self.term[self._add(word)] = word
        for word in stems:
            self.stem[self._add(word)] = word
        self.near = Deletions(terms, stems)
        self.most = max(map(allowed, terms), default=1 if stems else 0)
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[str, str] | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._close({(0, ""): 0}))

    def _add(self, word: str) -> int:
        node = 0
        for c in word:
            if c not in self.next[node]:
                self.next.append({})
                self.next[node][c] = len(self.next) - 1
            node = self.next[node][c]
        return node

    def _close(self, least: dict[tuple[int, str], int]) -> frozenset:
        """Add what is reached by leaving out term letters."""
        todo = [at for at in least if not at[1]]
        while todo:
            at = todo.pop()
            e = least[at] + 1
            if e <= self.most:
                for child in self.next[at[0]].values():
                    if least.get((child, ""), 9) > e:
                        least[child, ""] = e
                        todo.append((child, ""))
        return frozenset(least.items())

    def _state(self, s: frozenset) -> int:
        if s not in self.number:
            self.number[s] = len(self.states)
            self.states.append(s)
            self.steps.append({})
            found = []
            for (node, need), e in s:
                if not need and node in self.term and e <= allowed(self.term[node]):
                    word = self.term[node]
                    kind = "exact" if e == 0 else "short" if len(word) < SHORT else ("near", "far")[e - 1]
                    found.append((KINDS.index(kind), word))
                if need in ("", ANY) and node in self.stem and e <= 1:
                    found.append((KINDS.index(("stem", "stem_near")[e]), self.stem[node]))
            self.ends.append((KINDS[min(found)[0]], min(found)[1]) if found else None)
        return self.number[s]

    def _step(self, state: int, c: str) -> int:
        least: dict[tuple[int, str], int] = {}

        def put(node: int, need: str, e: int) -> None:
            if e <= self.most and e < least.get((node, need), 9):
                least[node, need] = e

        for (node, need), e in self.states[state]:
            if need:
                if need == ANY or c == need:
                    put(node, need if need == ANY else "", e)
                continue
            if node in self.stem:
                put(node, ANY, e)
            put(node, "", e + 1)  # one letter too many
            for letter, child in self.next[node].items():
                put(child, "", e if letter == c else e + 1)
                if letter != c and c in self.next[child]:
                    put(self.next[child][c], letter, e + 1)  # two letters swapped
        return self._state(self._close(least))

    def find_all(self, words: Iterable[str], known: dict[str, tuple[str, str] | None]) -> None:
        """Put ``match`` of the words into ``known``; those with more edits than any term or stem allows are
        dismissed in bulk, without a walk."""
        fresh = [w for w in words if w not in known]
        if fresh:
            for w, may in zip(fresh, self.near.may(fresh).tolist()):
                known[w] = self.match(w) if may else None

    def match(self, word: str) -> tuple[str, str] | None:
        """(kind, term), the kind first in KINDS, or None."""
        if len(self.states) > 100_000:  # bounded memory: begin again
            self.__init__(*self.words)
        state = self.start
        for c in word:
            step = self.steps[state]
            to = step.get(c)
            if to is None:
                to = step[c] = self._step(state, c)
            if to == self.dead:
                return None
            state = to
        return self.ends[state]


@dataclass
class ToxicityModel:
    terms: list[str]
    stems: list[str]
    weights: list[float]
    intercept: float


def learn_lexicon(sample: DataFrame, least: int = 5, share: float = 0.85,
                  stem_lengths: tuple[int, ...] = (4, 5, 6)) -> tuple[list[str], list[str]]:
    """Words and stems that at least ``least`` toxic documents of ``sample`` (text, label) hold, and
    of whose documents at least ``share`` are toxic. Counts are made in Spark; what comes back is
    bounded by the sample."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1)))
    heads = F.array_distinct(F.flatten(F.array(*[
        F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(
            F.substring(w, 1, n), F.lit("*"))) for n in stem_lengths])))
    rows = sample.select("label", F.explode(F.concat(words, heads)).alias("term"))
    found = (rows.groupBy("term").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
             .where((F.col("bad") >= least) & (F.col("bad") >= share * F.col("n"))).collect())
    heads_ = {r.term[:-1]: r.bad for r in found if r.term.endswith("*")}
    words_ = {r.term for r in found if not r.term.endswith("*")}
    stems: list[str] = []
    for s in sorted(heads_, key=lambda x: (len(x), x)):
        family = [w for w in words_ if w.startswith(s)]
        if not any(s.startswith(x) for x in stems) and len(family) != 1:
            stems.append(s)
    return sorted(words_), stems


def tokens(text: str) -> tuple[str, list[str], list[str]]:
    """The text in lower case, its letter runs, and its words with digits or signs."""
    low = text.lower()
    return low, TOKEN.findall(low), MIXED.findall(low)


def counts(text: str, seen: dict, automaton: Automaton) -> list[float]:
    """The FEATURES of a text; ``seen`` keeps the matches of words."""
    low, words, mixed = tokens(text)
    automaton.find_all({*words, *mixed}, seen)
    return counted(low, words, mixed, seen)


def counted(low: str, words: list[str], mixed: list[str], seen: dict) -> list[float]:
    """The same from the tokens, whose matches are known."""
    out = dict.fromkeys(FEATURES, 0.0)
    if not any(map(seen.__getitem__, {*words, *mixed})):
        return list(out.values())

    def matched(m: re.Match) -> tuple[str, str] | None:
        return seen[m[0]]

    places = list(TOKEN.finditer(low))
    whole = [m for m in MIXED.finditer(low) if matched(m)] if mixed else []
    inside = {i for m in whole for i in range(m.start(), m.end())}
    starts = [p.start() for p in places]
    names = set()
    for m in [*whole, *(p for p in places if p.start() not in inside)]:
        hit = matched(m)
        if hit is None:
            continue
        i = bisect.bisect_left(starts, m.start())
        around = {p[0] for p in places[max(0, i - WINDOW):i + WINDOW + 1]}
        left, right = low[max(0, m.start() - 40):m.start()], low[m.end():m.end() + 40]
        quoted = bool(QUOTES & set(left[-2:])) and bool(QUOTES & set(right[:2])) or bool(REPORT & around)
        out["quoted" if quoted else hit[0]] += 1.0
        if hit[0] != "short":
            names.add(hit[1])
            out["direct"] += float(not quoted and bool(DIRECT & around))
    found = sum(out[k] for k in KINDS if k != "short")
    per = found / max(1, len(words))
    out = {k: math.log1p(v) for k, v in out.items()}
    out["per_word"], out["terms"] = min(1.0, 20 * per), math.log1p(len(names))
    return list(out.values())


@lru_cache(maxsize=1)
def machine(terms: tuple[str, ...], stems: tuple[str, ...]) -> tuple[Automaton, dict]:
    """The automaton and the matches known so far, kept from task to task of a worker."""
    return Automaton(list(terms), list(stems)), {}


def add_counts(docs: DataFrame, terms: list[str], stems: list[str], into: str) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, seen = machine(tuple(terms), tuple(stems))
        for series in batches:
            out = []
            for at in range(0, len(series), 256):
                texts = [tokens(t or "") for t in series.iloc[at:at + 256]]
                if len(seen) > 500_000:
                    seen.clear()
                automaton.find_all(set().union(*(x for _, *both in texts for x in both)), seen)
                out += [counted(*t, seen) for t in texts]
            yield pd.Series(out)

    call = F.pandas_udf(run, "array<double>")
    return docs.withColumn(into, call(F.col("text")))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> ToxicityModel:
    """Fit on at most ``bound`` labelled documents outside fold 0. With one class only (or none)
    the score is its smoothed share."""
    sample = materialize(labelled_sample(docs, labels, "toxic", bound).select("text", "label"), "sample")
    n, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = math.log((bad + 1) / (n - bad + 1))
    if bad in (0, n):
        return ToxicityModel([], [], [0.0] * len(FEATURES), prior)
    terms, stems = learn_lexicon(sample)
    rows = materialize(add_counts(sample, terms, stems, "counts").select(
        "label", array_to_vector("counts").alias("vector")).repartition(6), "counts")
    fitted = LogisticRegression(featuresCol="vector", labelCol="label", regParam=1e-3,
                                maxIter=100).fit(rows)
    return ToxicityModel(terms, stems, [float(x) for x in fitted.coefficients.toArray()],
                         float(fitted.intercept))


def score(docs: DataFrame, model: ToxicityModel, into: str = "score") -> DataFrame:
    """``docs`` plus ``into``; null text is scored as empty. All rows and columns stay."""
    found = own("counts")
    counted = add_counts(docs, model.terms, model.stems, found)
    z = F.lit(model.intercept)
    for i, w in enumerate(model.weights):
        z = z + F.col(found)[i] * w
    return counted.withColumn(into, 1 / (1 + F.exp(-z))).drop(found)
