"""Words of many texts at once as 64-bit hashes (NumPy, no loop over words).

Texts become one array of code points; words are runs of one character class;
a word's hash is the difference of two prefix sums of a polynomial modulo 2^64,
brought to position 0 by the inverse power.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

SPACE, LETTER, DIGIT, OTHER = range(4)
_BASE = 0x9E3779B97F4A7C15                    # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: letters are \\p{L}, digits \\p{N}, spaces str.isspace()."""
    kind = {"L": LETTER, "N": DIGIT}
    return np.fromiter((SPACE if chr(i).isspace() else kind.get(unicodedata.category(chr(i))[0], OTHER)
                        for i in range(sys.maxunicode + 1)), np.uint8)


@lru_cache(1)
def lower() -> np.ndarray:
    """Lower-case code point, where that is a single one."""
    return np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(sys.maxunicode + 1)), np.uint32)


@lru_cache(2)
def _values(fold: bool) -> np.ndarray:
    code = lower().astype(np.uint64) if fold else np.arange(sys.maxunicode + 1, dtype=np.uint64)
    return mix64(code + np.uint64(1))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, a line feed after each; first position of each text and the end)."""
    points = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)


def word_spans(points: np.ndarray, kinds: np.ndarray):
    """First and past-the-last positions of the runs of one class (0 is no word)."""
    edge = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1]))) if len(kinds) else np.zeros(0, np.int64)
    word = kinds[edge] != 0
    return edge[word], np.append(edge[1:], len(kinds))[word]


def span_hasher(points: np.ndarray, fold: bool):
    """Hashes of spans (first, end) of these points."""
    up, down = _powers(len(points) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_values(fold)[points] * up[:-1])))
    return lambda first, end: mix64((sums[end] - sums[first]) * down[first])


def span_hashes(points: np.ndarray, first: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    return span_hasher(points, fold)(first, end)


def folded_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the lower-case runs of letters and digits of each text."""
    points, at = code_points(texts)
    kinds = classes()[points]
    first, end = word_spans(points, ((kinds == LETTER) | (kinds == DIGIT)).view(np.uint8))
    return span_hashes(points, first, end, True), np.searchsorted(first, at)


def text_slices(batch, column: int, rows: int = 1024, chars: int = 1 << 20):
    """(first row, texts) of a batch, a limited number of rows and characters at a time."""
    texts, at = batch.column(column), 0
    while at < len(texts):
        some, size = [], 0
        while at + len(some) < len(texts) and len(some) < rows and size < chars:
            some.append(texts[at + len(some)].as_py() or "")
            size += len(some[-1])
        yield at, some
        at += len(some)
