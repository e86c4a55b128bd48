"""Counts of fixed phrases by one automaton over a batch of texts.

All phrases together make one table of states (a trie whose missing edges lead
to where the longest proper suffix goes on), so the cost of a text does not
depend on how many phrases there are.  A batch of texts is one array of code
points, cut into segments that are worked on side by side: each step moves all
segments by one character.  A segment begins as many characters early as the
longest phrase has, less one, and counts only what ends inside it.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

SEGMENT = 512
#: Characters of a batch that are worked on at once.
GROUP = 1 << 21


class Automaton:
    """Tables of the states of some phrases; phrases are not empty and differ."""

    def __init__(self, phrases: tuple[str, ...]) -> None:
        self.phrases = phrases
        self.letters = np.array(sorted({ord(c) for p in phrases for c in p}), np.uint32)
        code = {int(c): k + 1 for k, c in enumerate(self.letters)}  # 0: in no phrase
        trie: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, p in enumerate(phrases):
            state = 0
            for c in p:
                state = trie[state].setdefault(code[ord(c)], len(trie))
                if state == len(trie):
                    trie.append({})
                    ends.append([])
            ends[state].append(k)
        self.next = np.zeros((len(trie), len(self.letters) + 1), np.int32)
        suffix = [0] * len(trie)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            if state:
                self.next[state] = self.next[suffix[state]]
                ends[state] = ends[state] + ends[suffix[state]]
            for c, child in trie[state].items():
                suffix[child] = int(self.next[suffix[state], c]) if state else 0
                queue.append(child)
            for c, child in trie[state].items():
                self.next[state, c] = child
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
        self.found = np.array([k for e in ends for k in e], np.int64)
        self.longest = max(map(len, phrases), default=1)
        # phrases of which one occurrence can begin inside another
        self.lapping = [k for k, p in enumerate(phrases) if any(p[:n] == p[-n:] for n in range(1, len(p)))]

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, phrase, end in the joined texts) of all occurrences, those inside others included."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.letters, points).clip(max=max(len(self.letters) - 1, 0))
        codes = np.where(self.letters[at] == points, at + 1, 0) if len(self.letters) and len(points) else np.zeros(len(points), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[text] + nth * SEGMENT
        end = np.minimum(begin + SEGMENT, starts[text + 1])
        early = np.maximum(begin - (self.longest - 1), starts[text])
        order = np.argsort(early - end, kind="stable")  # longest first, so that the open ones are always the first ones
        text, begin, end, early = text[order], begin[order], end[order], early[order]
        length = end - early
        state = np.zeros(len(text), np.int32)
        several = np.diff(self.first)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(int(length[0]) if len(length) else 0):
            open_ = int(np.searchsorted(-length, -step, "left"))
            where = early[:open_] + step
            state[:open_] = self.next[state[:open_], codes[where]]
            hit = np.flatnonzero((several[state[:open_]] > 0) & (where >= begin[:open_]))
            if len(hit):
                own = state[hit]
                n = several[own]
                ids = np.repeat(self.first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append((np.repeat(text[hit], n), self.found[ids], np.repeat(where[hit] + 1, n)))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Occurrences (texts x phrases); those of one phrase do not overlap and are taken from the left."""
        # memory follows a group of texts (or the longest text), not the batch
        out = np.empty((len(texts), len(self.phrases)), np.int64)
        start = size = 0
        for k, t in enumerate(texts):
            if size and size + len(t) > GROUP:
                out[start:k] = self._counts(texts[start:k])
                start, size = k, 0
            size += len(t)
        out[start:] = self._counts(texts[start:])
        return out

    def _counts(self, texts: list[str]) -> np.ndarray:
        text, phrase, end = self.matches(texts)
        out = np.bincount(text * len(self.phrases) + phrase, minlength=len(texts) * len(self.phrases)).reshape(len(texts), len(self.phrases))
        for k in self.lapping:
            own = np.flatnonzero(phrase == k)
            last: dict[int, int] = {}
            fresh = np.zeros(len(texts), np.int64)
            for t, e in sorted(zip(text[own].tolist(), end[own].tolist())):
                if e - len(self.phrases[k]) >= last.get(t, -1):
                    fresh[t] += 1
                    last[t] = e
            out[:, k] = fresh
        return out


@lru_cache(8)
def automaton(phrases: tuple[str, ...]) -> Automaton:
    return Automaton(phrases)


def phrase_totals(text: Column, lists: list[list[str]], present: bool = False) -> Column:
    """For each list the occurrences of its phrases in the text, or with ``present`` how many of them occur; a null text has none.

    A phrase that a list names twice counts twice.  Arrow batches; the table of
    states is made once per worker.
    """
    phrases = tuple(dict.fromkeys(p for each in lists for p in each))
    weights = np.zeros((len(phrases), len(lists)), np.int64)
    for j, each in enumerate(lists):
        for p in each:
            weights[phrases.index(p), j] += 1

    @F.pandas_udf(ArrayType(LongType()))
    def totals(texts: pd.Series) -> pd.Series:
        counts = automaton(phrases).counts([t or "" for t in texts])
        return pd.Series(list(((counts > 0) if present else counts).astype(np.int64) @ weights))

    return totals(text)
