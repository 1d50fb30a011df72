"""Elias-Fano coded monotone sequences, and an n-gram trie made of them, kept in memory-mapped files.

A sequence of n numbers below u keeps the low log2(u/n) bits of each in a packed array and the high bits in unary. A trie
level holds, for every node of the level above, its children's word ids, made monotone by adding the last sum of the node
before, and pointers to where each node's children begin, which are monotone already. Looking up a word under a context is
a successor search in the range of that context's children.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np

#: Log10 probabilities are kept in steps of 1/STEPS, as unsigned 16-bit numbers.
STEPS = 1024
#: Numbers coded at a time, which bounds the work space.
AT_ONCE = 1 << 17


def _mapped(values: np.ndarray, folder: str, name: str) -> np.ndarray:
    path = os.path.join(folder, name)
    values.tofile(path)
    return np.memmap(path, values.dtype, "r", shape=values.shape) if len(values) else values


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers."""

    def __init__(self, values: np.ndarray, folder: str, name: str) -> None:
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.bits = max(0, ((top + 1) // max(self.n, 1)).bit_length() - 1)
        width = np.uint64(self.bits)
        self.highs = (top >> self.bits) + 1  # number of different high parts
        upper = np.zeros(self.n + self.highs + 1, np.uint8)
        # Low bits, packed into 64-bit words; a number may span two.
        words = np.zeros(self.n * self.bits // 64 + 2, np.uint64)
        for a in range(0, self.n, AT_ONCE):
            part = values[a : a + AT_ONCE]
            upper[(part >> width).astype(np.int64) + np.arange(a, a + len(part))] = 1
            if self.bits:
                low = part & np.uint64((1 << self.bits) - 1)
                at = np.arange(a, a + len(part), dtype=np.uint64) * width
                word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
                np.bitwise_or.at(words, word, low << shift)
                over = shift + width > 64
                np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        self.upper = _mapped(np.packbits(upper), folder, name + ".upper")
        del upper
        self.words = _mapped(words, folder, name + ".low")
        self._select()

    def _select(self) -> None:
        """Directory over the unary part: where each high part's numbers begin."""
        upper = np.unpackbits(self.upper, count=self.n + self.highs + 1)
        zeros = np.flatnonzero(upper == 0)[: self.highs + 1]
        self.begin = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.int64)
        self.most = int(np.diff(self.begin).max()) if self.n else 0

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = np.asarray(self.words[word]) >> shift
        over = shift > 0
        out[over] |= np.asarray(self.words[word[over] + 1]) << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        high = np.searchsorted(self.begin, i, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self.low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number not below each x; n if there is none."""
        x = np.asarray(x, np.uint64)
        high = x >> np.uint64(self.bits)
        beyond = high >= self.highs
        h = np.where(beyond, 0, high).astype(np.int64)
        at, end = self.begin[h].copy(), self.begin[h + 1]
        low = x & np.uint64((1 << self.bits) - 1) if self.bits else np.zeros(len(x), np.uint64)
        open_ = np.flatnonzero(at < end)
        while len(open_):  # binary search among the numbers that share the high part
            if self.most > 8:
                lo, hi = at[open_], end[open_]
                while len(lo) and (lo < hi).any():
                    mid = (lo + hi) // 2
                    less = (self.low(np.minimum(mid, self.n - 1)) < low[open_]) & (lo < hi)
                    lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
                at[open_] = lo
                break
            less = self.low(at[open_]) < low[open_]
            open_ = open_[less]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        at[beyond] = self.n
        return at

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number equal to each x, or -1."""
        at = self.successor(x)
        inside = np.flatnonzero(at < self.n)
        same = self.get(at[inside]) == np.asarray(x, np.uint64)[inside]
        out = np.full(len(at), -1, np.int64)
        out[inside[same]] = at[inside[same]]
        return out


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype(np.uint16)


@dataclass
class Level:
    pointers: EliasFano
    children: EliasFano
    probabilities: np.ndarray


class Trie:
    """N-grams with quantised log10 probabilities.

    words: sorted 64-bit hashes, whose places are the word ids. levels: for each order from 2 on, the places of the
    contexts (in the level above), the ids of the last words, and log10 probabilities, sorted by context and word.
    """

    def __init__(self, words: np.ndarray, log10: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], folder: str) -> None:
        self.folder = folder
        self.words = EliasFano(words, self.folder, "words")
        self.probabilities = _mapped(quantised(log10), self.folder, "1.p")
        self.levels: list[Level] = []
        above = len(words)
        for k, (context, word, logs) in enumerate(levels):
            counts = np.bincount(context, minlength=above) if above else np.zeros(0, np.int64)
            pointers = np.zeros(above + 1, np.int64)
            np.cumsum(counts, out=pointers[1:])
            # Context-relative ids: sums go on from node to node, so that all children form one monotone sequence.
            width = np.uint64(len(words) + 1)
            children = context.astype(np.uint64) * width + word.astype(np.uint64)
            name = str(k + 2)
            self.levels.append(Level(EliasFano(pointers, self.folder, name + ".pointers"), EliasFano(children, self.folder, name + ".children"), _mapped(quantised(logs), self.folder, name + ".p")))
            above = len(context)
        self.width = np.uint64(len(words) + 1)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        return self.words.find(hashes)

    def child(self, order: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place in level `order` of each word under each context; -1 where there is none (or no such context)."""
        level = self.levels[order - 2]
        out = np.full(len(context), -1, np.int64)
        able = np.flatnonzero((context >= 0) & (word >= 0))
        # A context that stands there several times in a row is looked up once.
        new = np.flatnonzero(np.diff(context[able], prepend=-1))
        asked, times = context[able][new], np.diff(np.append(new, len(able)))
        begin, end = (np.repeat(level.pointers.get(a).astype(np.int64), times) for a in (asked, asked + 1))
        able, begin, end = able[begin < end], begin[begin < end], end[begin < end]
        if len(able):
            x = context[able].astype(np.uint64) * self.width + word[able].astype(np.uint64)
            at = level.children.successor(x)
            inside = (at >= begin) & (at < end)
            good = np.flatnonzero(inside)
            good = good[level.children.get(at[good]) == x[good]]
            out[able[good]] = at[good]
        return out

    def steps(self, order: int, place: np.ndarray) -> np.ndarray:
        """Log10 probabilities as quantised: non-negative steps of -1/STEPS."""
        p = self.probabilities if order == 1 else self.levels[order - 2].probabilities
        return np.asarray(p[place]).astype(np.int64) if len(p) else np.zeros(len(place), np.int64)

    def log10(self, order: int, place: np.ndarray) -> np.ndarray:
        return self.steps(order, place) / -STEPS

    def close(self) -> None:
        """Lets go of the files, which whoever made the folder deletes."""
        self.words = self.levels = self.probabilities = None
