"""Word hashes of Arrow string batches, vectorised: no Python loop over words.

A word's hash is a polynomial over its UTF-8 bytes modulo 2**64, then mixed. Two different words share a hash with
probability about 2**-64.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
GRAM = np.uint64(0xD1342543DE82EF95)
BLOCK_BYTES = 1 << 20
#: Where a Python worker keeps what one operator uses again in its next task.
KEPT = "edgeloom_worker"

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """0 for a byte that separates words, else the byte (A-Z lowered if asked) plus one."""
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    codes += np.uint64(1)
    codes[np.frombuffer(separators, np.uint8)] = 0
    return codes


SPACES = b" \t\n\x0b\x0c\r"
SPACED = byte_table(SPACES, lower=False)
SPACED_LOWER = byte_table(SPACES, lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def forget() -> None:
    """Spark uses a Python worker again for other operators; what the last one kept there would count against them."""
    sys.modules.pop(KEPT, None)


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) for runs of rows with about BLOCK_BYTES bytes."""
    forget()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def hashed_words(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: word hashes, each row's first word (with the end), and the words' first and end bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = codes[data]
    inside = coded != 0
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | breaks[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | breaks[1:n]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(coded * up[:n], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first])
    return hashes, np.searchsorted(first, offsets), first, last


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i + k - 1, for every i that leaves k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= GRAM
        out += hashes[j : j + n]
    return mix(out)
