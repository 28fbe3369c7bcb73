"""Minimal perfect hashing of 32-byte digests: n distinct digests get the slots 0 to n - 1.

A cascade of bit arrays: a level has two bits a key still to be placed, and a key that alone hashes to a bit
of its level is placed there; the others go on to the next level. A key's slot is the number of set
bits before its own, over all levels. Keys that share a bit down to the last level are kept
in order and looked up. A digest that wasn't built in either falls through all levels (slot -1) or
gets some other key's slot: callers keep the digests by slot and compare them (``found``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LEVELS = 48
_STEP = 0x9E3779B97F4A7C15


def words(digests: Sequence[bytes] | bytes) -> np.ndarray:
    """One row of four 64-bit words for each digest."""
    raw = digests if isinstance(digests, (bytes, bytearray, memoryview)) else b"".join(digests)
    return np.frombuffer(raw, "<u8").reshape(-1, 4)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _base(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    for k in range(4):
        out = _stir(out ^ keys[:, k])
    return out


def _places(base: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_stir(base + np.uint64((level + 1) * _STEP & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Built from distinct digests; ``to_bytes`` and ``from_bytes`` store it."""

    def __init__(self, levels: list[np.ndarray], rest: list[bytes]):
        self.levels = levels  # bits of each level, as bytes of 0 and 1
        self.rest = rest  # digests that no level placed, sorted
        placed = [0, *np.cumsum([int(bits.sum()) for bits in levels]).tolist()]
        self.ranks = [np.cumsum(bits, dtype=np.int64) - 1 + before for bits, before in zip(levels, placed)]
        self.placed = placed[-1]

    def __len__(self) -> int:
        return self.placed + len(self.rest)

    @classmethod
    def build(cls, keys: np.ndarray, levels: int = LEVELS) -> PerfectHash:
        """``keys``: what ``words`` makes. Raises ValueError where two are equal."""
        base, left, made = _base(keys), np.arange(len(keys)), []
        while len(left) and len(made) < levels:
            at = _places(base[left], len(made), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            made.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        rest = sorted(k.tobytes() for k in keys[left])
        if len(set(rest)) < len(rest):
            raise ValueError("equal digests")
        return cls(made, rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where it is no member for certain."""
        out, base, left = np.full(len(keys), -1, np.int64), _base(keys), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _places(base[left], level, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
        if self.rest:
            after = {k: self.placed + i for i, k in enumerate(self.rest)}
            out[left] = [after.get(k.tobytes(), -1) for k in keys[left]]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(bits).tobytes() for bits in self.levels) + b"".join(self.rest)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, rest = np.frombuffer(raw, "<i8", 2).tolist()
        sizes, at, levels = np.frombuffer(raw, "<i8", n, 16).tolist(), 16 + 8 * n, []
        for size in sizes:
            octets = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, octets, at), count=size))
            at += octets
        return cls(levels, [bytes(raw[at + 32 * i : at + 32 * i + 32]) for i in range(rest)])


def assign(keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
    """A perfect hash of ``keys`` and their slots, verified to be 0 to n - 1, each once."""
    made = PerfectHash.build(keys)
    slots = made.slots(keys)
    if not (np.bincount(slots, minlength=len(keys)) == 1).all():
        raise ValueError("slots collide")
    return made, slots


def found(made: PerfectHash, by_slot: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot of each key whose digest is the one kept there, byte for byte; else -1. ``by_slot``: the members' words in slot order."""
    slots = made.slots(keys)
    some = np.flatnonzero(slots >= 0)
    other = (by_slot[slots[some]] != keys[some]).any(axis=1)
    slots[some[other]] = -1
    return slots
