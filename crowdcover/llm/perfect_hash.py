"""A minimal perfect hash: n distinct keys of 128 bits to the numbers 0 to n - 1, in 3 to 4 bits a key.

Keys fall into a table of twice their number. Who falls alone sets the bit there and is done; the
others go on to a next, smaller table. A key's number is the rank of its bit. A key that was never
put in may also find a bit: the caller compares what the slot holds.
"""

from __future__ import annotations

import numpy as np

_ROOM = 2.0
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = _mix(np.array([level + 1], dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[0]
        return (_mix(_mix(keys[:, 0] ^ salt) + keys[:, 1]) % _U(size)).astype(np.int64)


def keys_of(digests: list[bytes]) -> np.ndarray:
    """The first 16 bytes of every digest as a row of two numbers."""
    return np.frombuffer(b"".join(d[:16] for d in digests), dtype="<u8").reshape(-1, 2)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - 1)
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: rows of two numbers, all different."""
        levels, rest = [], keys
        while len(rest):
            size = max(1, int(_ROOM * len(rest)))
            at = _places(rest, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            rest = rest[~bits[at]]
            if len(levels) > 200:
                raise ValueError("the keys are not all different")
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; -1 for some of those that were never put in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = _places(keys[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.ranks[level][at[hit]]
            todo = todo[~hit]
        return out

    def packed(self) -> list[tuple[int, bytes]]:
        return [(len(bits), np.packbits(bits).tobytes()) for bits in self.levels]

    @classmethod
    def unpacked(cls, levels: list[tuple[int, bytes]]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n].astype(bool)
                    for n, b in levels])
