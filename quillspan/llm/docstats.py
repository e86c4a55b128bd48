"""Word statistics of whole texts, shared by the quality operators.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is what
``bytes.split`` cuts out; counting on UTF-8 bytes gives the same words as
counting on code points.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


def texts_as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


#: Texts of a batch that are Python objects at a time.
PIECE_ROWS = 256


def each_text(column):
    """The texts of texts_as_bytes(), without all of a batch in memory once more."""
    for k in range(0, len(column), PIECE_ROWS):
        yield from texts_as_bytes(column.slice(k, PIECE_ROWS))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Words as small integers, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in some window of ``width`` words found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = word_ids(words)
    distinct = int(ids.max()) + 1
    key = ids[:n].copy()
    for k in range(1, width):
        if distinct ** (k + 1) >= 1 << 62:  # keep keys exact: renumber before they overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * distinct + ids[k : n + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= hit
    return int(covered.sum())


def rule_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    words = text.split()
    word_bytes = text.translate(None, SPACES)
    chars = len(word_bytes.translate(None, _CONTINUATION))
    symbols = len(word_bytes) - len(word_bytes.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)] if b"\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_window_words(words)
