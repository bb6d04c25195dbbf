"""Hashes of byte ranges and words in arrays."""

import numpy as np

#: Odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_TABLES: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 for 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    held = _TABLES.get(which)
    if held is None or len(held[0]) < n:
        base = BASES[which]
        row = lambda b: np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n, b, dtype=np.uint64))])
        held = _TABLES[which] = (row(base), row(pow(base, -1, 1 << 64)))
    return held


class Hashes:
    """Prefix polynomial hashes of a byte array: the hash of any range in constant time.

    The prefix sums weigh byte j by base^-j; multiplied by base^i, a difference of two sums depends on the bytes of its
    range only.
    """

    def __init__(self, data: np.ndarray, which: int = 0, bits: int = 64):
        self.power, inverse = _powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[: len(data)], out=self.sums[1:])
        self.mask = np.uint64((1 << bits) - 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        found = (self.sums[start + length] - self.sums[start]) * self.power[start]
        return found if self.mask == np.uint64(2**64 - 1) else found & self.mask


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of all texts with A-Z in lower case, the number of its text, and its byte offset there.

    Words are separated by space, tab, line feed, vertical tab, form feed and carriage return.
    """
    none = np.zeros(0, dtype=np.int64)
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    if not len(data):
        return none.astype(np.uint64), none, none
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    visible = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    change = np.flatnonzero(visible[1:] != visible[:-1])
    start, size = change[::2], change[1::2] - change[::2]
    own = np.searchsorted(edges, start, side="right") - 1
    return mix(Hashes(data).of(start, size) + size.astype(np.uint64)), own, start - edges[own]
