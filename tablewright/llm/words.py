"""Words of many texts as arrays: 64-bit hashes of all words of a batch without a loop over words.

A word's hash is a polynomial of its bytes modulo 2**64, taken as a difference of prefix sums and put
through a mixer. Texts are handled in slices of about ``SLICE`` bytes, so memory follows the slice and not
the batch; one longer text makes one longer slice.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
#: Odd multipliers of the words of a shingle.
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Kinds of bytes: white space 0, all else 1.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0
#: The same, ASCII punctuation apart as 2.
WORDS_AND_MARKS = WORDS.copy()
WORDS_AND_MARKS[list(string.punctuation.encode())] = 2
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 65_536)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"") + 1
        if held >= SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hash_words(
    texts: list[bytes | None], kinds: np.ndarray = WORDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice, A-Z as a-z: word hashes, the row of each word, and its first and past-last byte in its text.

    A word is a run of bytes of one kind other than 0.
    """
    parts = [t.lower() if t else b"" for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    kind = kinds[data]
    edge = np.r_[0, np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(data)]
    solid = kind[edge[:-1]] > 0
    first, past = edge[:-1][solid], edge[1:][solid]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    value = (total[past] - total[first]) * down[first]
    length = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    begins = np.cumsum(length) - length
    row = np.searchsorted(begins, first, "right") - 1
    return mix(value + (past - first).astype(np.uint64)), row, first - begins[row], past - begins[row]


def shingles(words: np.ndarray, rows: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a row, and their rows; a row of fewer words is one run."""
    if not len(words):
        return words, rows
    size = np.bincount(rows)
    out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= n:
        full = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
        value = np.zeros(len(full), np.uint64)
        for k in range(n):
            value += words[full + k] * PLACES[k]
        out, at = mix(value), rows[full]
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        start = np.searchsorted(rows, few)
        value = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = size[few] > k
            value[has] += words[start[has] + k] * PLACES[k]
        value = mix(value + size[few].astype(np.uint64))
        where = np.searchsorted(at, few)
        out, at = np.insert(out, where, value), np.insert(at, where, few)
    return out, at


def sorted_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    return [np.unique(hashes[a:b]) if b - a > 1 else hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
