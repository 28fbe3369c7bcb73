"""Word shingles of whole texts as sorted arrays of 64-bit hashes.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case. A document's set
holds the hashes of its distinct runs of ``k`` words; with fewer words, of the whole sequence
as one; without words it is empty. Two different shingles share a hash with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
_LETTER = _rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_STEP = _rng.integers(0, 1 << 64, 64, dtype=np.uint64, endpoint=False) | np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a fixed permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """1, b, b**2, ... modulo 2**64."""
    out = np.full(n, _STEP[0], np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text."""
    begin = size = 0
    raws = [(t or "").encode() for t in texts]
    for i, raw in enumerate(raws):
        size += len(raw)
        if size >= SLICE_BYTES:
            yield from _sets(raws[begin : i + 1], k)
            begin, size = i + 1, 0
    yield from _sets(raws[begin:], k)


def _sets(raws: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not raws:
        return
    octets = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    firsts = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
    inside = _IS_WORD[octets]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        yield from (np.zeros(0, np.uint64) for _ in raws)
        return
    letters = octets[inside]
    heads = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(heads, lengths)
    word = np.add.reduceat(_LETTER[letters] * _powers(int(lengths.max()))[place], heads)
    word = mix(word + lengths.astype(np.uint64) * _STEP[1])
    bounds = np.append(np.searchsorted(starts, firsts), len(starts)).tolist()
    run = np.zeros(max(len(word) - k + 1, 0), np.uint64)
    for j in range(k):
        run += mix(word[j : j + len(run)] + _STEP[2 + j]) * _STEP[32 + j]
    run = mix(run)
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= k:
            yield np.unique(run[a : b - k + 1])
        elif b > a:
            few = np.uint64(b - a)
            for j in range(b - a):
                few = few + mix(word[a + j : a + j + 1] + _STEP[2 + j]) * _STEP[33 + j]
            yield mix(few)
        else:
            yield np.zeros(0, np.uint64)
