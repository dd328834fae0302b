"""An FM-index over a sequence of words, with numpy throughout.

Suffixes are sorted by prefix doubling; the transform is kept in a wavelet
matrix, whose ranks answer backward search for many patterns at once; sampled
suffix positions locate the occurrences.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the end of the text is smaller than any word."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    """Index of `text`, words numbered from 0; `starts` are positions that the locating walk must not pass."""

    def __init__(self, text: np.ndarray, order: np.ndarray, sigma: int, starts: np.ndarray) -> None:
        n = len(text)
        self.n = n
        last = text[order - 1]  # the text is read as a circle
        self.bits = max(1, int(sigma - 1).bit_length())
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.before[1:])
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))
        kept = np.zeros(n, bool)
        kept[::SAMPLE] = True
        kept[starts] = True
        marked = kept[order]
        self.marked = np.concatenate([[0], np.cumsum(marked)])
        self.sampled = order[marked]

    def _descend(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ones[at]
            at = np.where((word >> (self.bits - 1 - level)) & 1, zeros + one, at - one)
        return at

    def rank(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each word in the transform before each place."""
        return self._descend(word, at) - self.begin[word]

    def access(self, at: np.ndarray) -> np.ndarray:
        word = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at]
            bit = ones[at + 1] - one
            word = word << 1 | bit
            at = np.where(bit == 1, zeros + one, at - one)
        return word

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search for the first lengths[i] words of each row: the intervals of suffixes."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > step]
            word = patterns[live, lengths[live] - 1 - step]
            low[live] = self.before[word] + self.rank(word, low[live])
            high[live] = self.before[word] + self.rank(word, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        out = np.zeros(len(at), np.int64)
        live, steps, now = np.arange(len(at)), 0, at
        while len(live):
            here = self.marked[now + 1] > self.marked[now]
            out[live[here]] = self.sampled[self.marked[now[here]]] + steps
            live, now = live[~here], now[~here]
            word = self.access(now)
            now = self.before[word] + self.rank(word, now)
            steps += 1
        return out
