"""Locally consistent parsing of word sequences by recompression: runs and pairs of equal names get equal names.

A name is a hash of what it stands for, so it is the same wherever it is given: no dictionary has to be shared. In each
round a pair of neighbours is named when a bit of the left name is 0 and that bit of the right one is 1. Beside the
words that a symbol covers, a parse knows the words that decided it, its context; where a text repeats the context, it
repeats the symbol. So two texts that share a window share all symbols whose context lies in the window.
"""

from __future__ import annotations

import numpy as np

from .words import GRAM, grams, mix

#: Levels of pairs. The first also joins runs of equal words.
LEVELS = 3
#: Bits of a rank that hold the symbol's bytes.
_LENGTH = np.uint64(7)


class Symbols:
    """Names, contexts [low, high) and first words of the symbols of one level, in order; `text` tells texts apart."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, text: np.ndarray) -> None:
        self.name, self.low, self.high, self.first, self.text = name, low, high, first, text

    @staticmethod
    def of_runs(words: np.ndarray, text: np.ndarray, outside: int) -> Symbols:
        """Maximal runs of equal words. The neighbours, or their absence, decide where a run ends."""
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(words))
        name = words[first]
        long = last - first > 1
        name[long] = mix(name[long] * GRAM + (last - first)[long].astype(np.uint64))
        low, high = first - 1, last + 1
        at_start = np.append(True, text[first[1:]] != text[first[1:] - 1])
        at_end = np.append(at_start[1:], True)
        low[at_start] -= outside
        high[at_end] += outside
        return Symbols(name, low, high, first, text[first])

    def paired(self, level: int, outside: int) -> tuple[Symbols, np.ndarray]:
        """The next level, and which of its symbols are pairs."""
        n = len(self.name)
        bit = (mix(self.name + np.uint64(level * int(GRAM) % 2**64)) & np.uint64(1)).astype(bool)
        pair = np.zeros(n, bool)
        pair[:-1] = ~bit[:-1] & bit[1:] & (self.text[:-1] == self.text[1:])
        low, high = self.low.copy(), self.high.copy()
        same = self.text[:-1] == self.text[1:]
        # an undecided neighbour's context counts too: left ones look right, right ones look left
        right, left = np.append(self.high[1:], 0), np.append(0, self.low[:-1])
        right = np.where(np.append(same, False), right, self.high + outside)
        left = np.where(np.append(False, same), left, self.low - outside)
        low[bit] = np.minimum(low, left)[bit]
        high[~bit] = np.maximum(high, right)[~bit]
        name = self.name.copy()
        at = np.flatnonzero(pair)
        name[at] = mix(mix(self.name[at]) * GRAM + self.name[at + 1] + np.uint64(level))
        low[at] = np.minimum(self.low[at], self.low[at + 1])
        high[at] = np.maximum(self.high[at], self.high[at + 1])
        keep = np.ones(n, bool)
        keep[at + 1] = False
        return Symbols(name[keep], low[keep], high[keep], self.first[keep], self.text[keep]), pair[keep]


def window_starts(first: np.ndarray, window: int) -> np.ndarray:
    """The words at which a window of one text begins, in a block of texts whose words begin at `first`."""
    n = int(first[-1])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.flatnonzero(text[: n - window + 1] == text[window - 1 :]) if n >= window else np.zeros(0, np.int64)


def least_runs(words: np.ndarray, window: int) -> np.ndarray:
    """For every run of `window` words the smallest hash of the runs of half as many in it."""
    runs = grams(words, (window + 1) // 2)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = runs[:n].copy()
    for k in range(1, len(runs) - n + 1):
        np.minimum(out, runs[k : k + n], out=out)
    return out


def anchored(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, anchor, hash) of every run of `window` words of one text in a block of texts whose words begin at
    `first` and have `sizes` bytes. The anchor is the name of a symbol whose context lies in the window: of the one
    with most bytes, which is the rarest as a rule, and of those the one of greatest name. A window without any is its
    own anchor. Equal windows have equal anchors."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = window_starts(first, window)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = grams(words, window)
    best = np.zeros(n, np.uint64)
    symbols = Symbols.of_runs(words, text, 2 * window)
    bytes_before = np.concatenate([[0], np.cumsum(sizes)])
    for level in range(1, LEVELS + 1):
        symbols, pair = symbols.paired(level, 2 * window)
        long = np.diff(bytes_before[np.append(symbols.first, n)])[pair]
        low, width = symbols.low[pair], (symbols.high - symbols.low)[pair]
        rank = (symbols.name[pair] >> _LENGTH) | (np.minimum(long, 127).astype(np.uint64) << np.uint64(57))
        for shift in range(window):
            fits = width + shift <= window
            if not fits.any():
                break
            at = low[fits] - shift
            np.maximum.at(best, at[at >= 0], rank[fits][at >= 0])
    best, hashes = best[starts], hashes[starts]
    return starts, np.where(best == 0, hashes >> _LENGTH, best), hashes
