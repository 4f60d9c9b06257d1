"""Prefix polynomial hashes of byte strings, modulo 2^64.

With P[i] = sum of (byte_j + 1) * base^j over j < i, the hash of any substring
is (P[end] - P[start]) * base^-start: one subtraction and one product, the
same wherever the substring stands.  Two substrings of one length are equal if
their bytes are; equal hashes are verified by whoever relies on them.
"""

from __future__ import annotations

import numpy as np

# Odd multipliers; a later one is tried where an earlier one has collided.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(base: int) -> int:
    x = base
    for _ in range(6):  # each step doubles the number of right bits
        x = x * (2 - base * x) % (1 << 64)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n-1) and their inverses."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, _inverse(base), np.uint64)
        up[0] = down[0] = 1
        held = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return held[0][:n], held[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The same numbers with all bits stirred; a bijection."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the substrings at ``start`` of ``length`` (one or each)."""
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, in order."""
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:n]) * self.down[:n]
