"""A run-length index in numpy: run-compressed BWT with sampled run ends.

The text is a concatenation of segments, each closed by a separator of its own,
so suffixes are ordered by their content up to the end of their segment.  Only
the run structure is kept: for every run of equal BWT symbols the text position
at its head and the position at the end of the run before it.  Between two
sampled positions in text order the matching statistics fall by one per step,
so the samples alone give, for every position, the longest match with another
position of the text.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240131)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", MULTIPLIER), ("down", _INVERSE)):
                table = np.ones(size, np.uint64)
                table[1:] = base
                _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """h[i] such that span_hash() compares spans of symbol codes by content."""
    up, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling, refining only classes that are not yet single."""
    n = len(symbols)
    base = int(symbols.max()) + 2
    packed = 1
    while base ** (packed * 2) < 1 << 62 and packed < 4:
        packed *= 2
    key, width = symbols.astype(np.int64) + 1, 1
    while width < packed:
        shifted = np.zeros(n, np.int64)
        shifted[: n - width] = key[width:]
        key = key * base**width + shifted
        width *= 2
    order = np.argsort(key, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(key[order[1:]], key[order[:-1]], out=fresh[1:])
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = first
    single = fresh & np.append(fresh[1:], True)
    slots = np.flatnonzero(~single)  # where in the order the unresolved suffixes stand
    while len(slots):
        pos = order[slots]
        nxt = pos + width
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        own = rank[pos]
        by = np.argsort(own * (n + 2) + second, kind="stable")
        pos, own, second = pos[by], own[by], second[by]
        order[slots] = pos
        fresh = np.empty(len(slots), bool)
        fresh[0] = True
        fresh[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
        rank[pos] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        single = fresh & np.append(fresh[1:], True)
        slots = slots[~single]
        width *= 2
    return order


class RunIndex:
    """Run heads of the BWT in text order, the run ends before them, and the match length at each head."""

    def __init__(self, segments: list[bytes]):
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        ends = self.starts + lengths
        raw = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
        symbols = raw.astype(np.int64)
        symbols[ends] = 256 + np.arange(len(segments))
        codes = BYTE_CODE[raw]
        codes[ends] = (np.arange(1, len(segments) + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(12345)
        self.size, self.lengths = len(raw), lengths
        self.prefix = prefix_hashes(codes)
        order = suffix_array(symbols)
        bwt = symbols[order - 1]
        heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.runs = len(heads) + 1
        sampled, run_end = order[heads], order[heads - 1]
        by = np.argsort(sampled)
        self.sampled, self.run_end = sampled[by], run_end[by]
        self.match = self._common(self.sampled, self.run_end, int(lengths.max(initial=0)) + 1)

    def _common(self, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at p and q."""
        done = np.zeros(len(p), np.int64)
        step = 1 << max(0, int(most).bit_length() - 1)
        limit = self.size
        while step:
            a, b = p + done, q + done
            fits = (a + step <= limit) & (b + step <= limit)
            a, b = np.where(fits, a, 0), np.where(fits, b, 0)
            same = fits & (span_hash(self.prefix, a, a + step * fits) == span_hash(self.prefix, b, b + step * fits))
            done += step * same
            step >>= 1
        return done

    def long_matches(self, length: int) -> np.ndarray:
        """Which positions start a string of ``length`` symbols that also starts somewhere else in the text."""
        use = self.match >= length
        p, q = self.sampled, self.run_end
        until = np.append(p[1:], self.size)
        reach = np.minimum(self.match - length + 1, until - p)[use]
        p, q = p[use], q[use]
        change = np.zeros(self.size + 1, np.int64)
        for at in (p, q):
            np.add.at(change, at, 1)
            np.add.at(change, at + reach, -1)
        return np.cumsum(change[:-1]) > 0
