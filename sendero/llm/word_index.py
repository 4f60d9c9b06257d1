"""A bidirectional FM-index over word ids.

``order_of`` sorts the suffixes of an id sequence by their first DEPTH ids
(prefix doubling); the id before each sorted suffix is its Burrows-Wheeler
transform.  With the transform of the sequence and that of its reverse, the
phrases are intervals in both orders, and a phrase is extended by a word to
the left or to the right from what stands in its interval.  Id 0 separates
pieces and is no word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sendero.llm.rolling import BASES, mixed, powers

# Ids by which suffixes are sorted; phrases of up to as many words have their
# interval.
DEPTH = 6
_BASE = BASES[0]


def order_of(ids: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in the order of their first DEPTH ids."""
    bits = max(int(ids.max(initial=0)).bit_length(), 1)
    width = min(max(62 // bits, 1), DEPTH)  # as many ids as one number holds
    key = np.zeros(len(ids), np.int64)
    for i in range(width):
        key <<= bits
        key[:len(ids) - i] |= ids[i:]
    while True:
        order = np.argsort(key)
        if width >= DEPTH:
            return order
        new = np.zeros(len(key), np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(new)
        key = rank * (rank.max(initial=0) + 1)
        key[:-width] += rank[width:]
        width *= 2


def transform(ids: np.ndarray) -> np.ndarray:
    """What stands before each sorted suffix."""
    return ids[order_of(ids) - 1] if len(ids) else ids


@dataclass
class Phrases:
    """Phrases of one length: their words, where their intervals begin in both
    orders, how often they occur, and the polynomial hash of their words."""

    words: np.ndarray
    at: np.ndarray
    reverse_at: np.ndarray
    count: np.ndarray
    hash: np.ndarray

    def take(self, chosen: np.ndarray) -> Phrases:
        return Phrases(self.words[chosen], self.at[chosen], self.reverse_at[chosen], self.count[chosen], self.hash[chosen])

    @property
    def keys(self) -> np.ndarray:
        return keys_of(self.hash, self.words.shape[1])


def keys_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """What a phrase of ``n`` words is called in every shard."""
    return mixed(hashes + np.uint64(n)).view(np.int64)


class WordIndex:
    """``counts`` by id, ``hashes`` of the words by id, and both transforms
    (the reverse one only where phrases grow to the right)."""

    def __init__(self, counts: np.ndarray, hashes: np.ndarray, forward: np.ndarray | None = None, reverse: np.ndarray | None = None):
        self.counts, self.hashes, self.bwt = counts, hashes, (forward, reverse)
        self.first = np.cumsum(counts) - counts

    def _step(self, side: int, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the suffix that begins with ``word``, one id longer than the
        one at ``at``, stands in the order."""
        wanted = np.zeros(len(self.counts), bool)
        wanted[word] = True
        stands = np.flatnonzero(wanted[self.bwt[side]])
        size = len(self.bwt[side])
        stands = np.sort(self.bwt[side][stands].astype(np.int64) * size + stands)
        before = word.astype(np.int64) * size
        return self.first[word] + np.searchsorted(stands, before + at) - np.searchsorted(stands, before)

    def single(self) -> Phrases:
        ids = np.arange(1, len(self.counts))
        return Phrases(ids[:, None].astype(np.int32), self.first[1:], self.first[1:], self.counts[1:], self.hashes[1:])

    def extended(self, phrases: Phrases, left: bool, keep=None, intervals: bool = True) -> Phrases:
        """The extensions by one word to the left (right) that ``keep`` takes
        (phrases to booleans).  Without ``intervals`` only their words, counts
        and hashes."""
        side = 0 if left else 1
        begin = phrases.at if left else phrases.reverse_at
        offset = np.cumsum(phrases.count) - phrases.count
        node = np.repeat(np.arange(len(phrases.count)), phrases.count)
        at = np.arange(len(node)) + (begin - offset)[node]
        key = node * len(self.counts) + self.bwt[side][at]
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.flatnonzero(new)
        count = np.diff(np.append(group, len(key)))
        parent, word = np.divmod(key[group], len(self.counts))
        real = np.flatnonzero(word)
        parent, word, group, count = parent[real], word[real], group[real], count[real]
        n = phrases.words.shape[1]
        if left:
            words = np.column_stack([word.astype(np.int32), phrases.words[parent]])
            hashed = phrases.hash[parent] + self.hashes[word] * powers(_BASE, n + 1)[0][n]
        else:
            words = np.column_stack([phrases.words[parent], word.astype(np.int32)])
            hashed = phrases.hash[parent] * np.uint64(_BASE) + self.hashes[word]
        found = Phrases(words, np.zeros(len(real), np.int64), np.zeros(len(real), np.int64), count, hashed)
        if keep is not None:
            chosen = np.flatnonzero(keep(found))
            found, parent, word, group = found.take(chosen), parent[chosen], word[chosen], group[chosen]
        if intervals:
            # No such word before the first place in the interval, and in the
            # other order the part with smaller neighbours comes before.
            own = self._step(side, word, begin[parent])
            other = (phrases.reverse_at if left else phrases.at)[parent] + group - offset[parent]
            found.at, found.reverse_at = (own, other) if left else (other, own)
        return found

    def without_end(self, phrases: Phrases, left: bool) -> np.ndarray:
        """Keys of the phrases without their first (last) word."""
        n = phrases.words.shape[1]
        up, down = powers(_BASE, n)
        if left:
            return keys_of(phrases.hash - self.hashes[phrases.words[:, 0]] * up[n - 1], n - 1)
        return keys_of((phrases.hash - self.hashes[phrases.words[:, -1]]) * down[1], n - 1)
