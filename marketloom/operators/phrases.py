"""Many phrases at once in the words of sentences: an Aho-Corasick automaton over word numbers.

The automaton reads every word once, whatever the number and length of the phrases, and reports
overlapping and nested phrases. Words that no phrase holds are recognised in bulk and never reach it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa


class PhraseAutomaton:
    """``find`` gives the places of ``phrases`` (sequences of words, none empty)."""

    def __init__(self, phrases: Sequence[Sequence[str]]) -> None:
        self.word: dict[str, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]       # phrases that end in a state
        self.size = np.array([len(p) for p in phrases], np.int64)
        for k, phrase in enumerate(phrases):
            state = 0
            for w in phrase:
                number = self.word.setdefault(w, len(self.word) + 1)
                if number not in self.step[state]:
                    self.step[state][number] = len(self.step)
                    self.step.append({}), self.ends.append([])
                state = self.step[state][number]
            self.ends[state].append(k)
        self.back = [0] * len(self.step)        # the longest proper ending that is a beginning
        todo = deque(self.step[0].values())
        while todo:
            state = todo.popleft()
            for number, child in self.step[state].items():
                at = self.back[state]
                while at and number not in self.step[at]:
                    at = self.back[at]
                to = self.step[at].get(number, 0)
                self.back[child] = to if to != child else 0
                self.ends[child] = self.ends[child] + self.ends[self.back[child]]
                todo.append(child)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word, 0 for words of no phrase."""
        coded = words.dictionary_encode()
        known = np.array([self.word.get(w, 0) for w in coded.dictionary.to_pylist()] or [0], np.int64)
        return known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)

    def find(self, numbers: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, phrase) of every occurrence inside one sentence."""
        at, found, state = [], [], 0
        places = np.flatnonzero(numbers)
        joined = np.r_[False, (np.diff(places) == 1) & (np.diff(sentence[places]) == 0)] if len(places) else []
        for place, number, goes_on in zip(places.tolist(), numbers[places].tolist(), joined):
            if not goes_on:
                state = 0
            while state and number not in self.step[state]:
                state = self.back[state]
            state = self.step[state].get(number, 0)
            for k in self.ends[state]:
                at.append(place), found.append(k)
        found = np.array(found, np.int64)
        return np.array(at, np.int64) - (self.size[found] - 1 if len(found) else 0), found
