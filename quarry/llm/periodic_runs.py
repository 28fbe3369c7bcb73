"""Periodic runs of words: recursive frequency splitting, then a scan of the lags that surviving segments repeat at.

A run of period q has at least ``REPEATS`` * q words and at least ``LEAST`` of them, each word equal to the one q
before it, and no smaller period; it can't be extended on either side. Every word of a run occurs in it at least
``REPEATS`` times. So

1. a segment (at first the whole text) is split at the words that occur in it less often than that, and what
   is left is split again until every word of every segment occurs often enough. No run is cut by
   this, and prose rarely leaves anything;
2. in a surviving segment, windows of 1, 2, 4 ... words get names (equal names for equal windows, made from
   the names of their halves), and each window's lag is the distance to the next window of its name. In a
   run of period q the windows of the least power of two that is q or more all have the lag q: if one came
   again sooner, the run would have a smaller period. A stretch of windows with one lag is therefore a run, its first
   window the run's first word, its last window's next occurrence the run's end. Windows that don't come again
   leave the scan, as longer ones can't either.

All texts of a slice are worked on together in flat arrays; a long text is a slice of its own, whole. Words are
the stretches without the ASCII white space (case kept). Defined results: null or empty text or one without words has no
words and no runs; rows are judged each on their own, repeated ones too; an empty table gives no rows; other columns
are not read; a null doc_id is passed on.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import sliced, table

REPEATS = 4
LEAST = 6


def _split(seg: np.ndarray, word: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places that survive and their segments' numbers, from each place's first segment (ascending) and word."""
    at, seg, done, numbered = np.arange(len(word)), seg.astype(np.int64), [], 0
    many = int(word.max()) + 1 if len(word) else 1
    while len(at):
        sizes = np.bincount(seg)
        long = sizes[seg] >= least
        at, seg = at[long], seg[long]
        if not len(at):
            break
        _, where, often = np.unique(seg * many + word[at], return_inverse=True, return_counts=True)
        enough = often[where] >= repeats
        stable = np.bincount(seg, ~enough) == 0
        keep = stable[seg]
        if keep.any():
            done.append((at[keep], seg[keep] + numbered))
            numbered += int(seg.max()) + 1
        go = enough & ~keep
        at, seg = at[go], seg[go]
        if len(at):
            seg = np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(seg) != 0))])
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, seg = (np.concatenate(part) for part in zip(*done))
    order = np.argsort(at)
    return at[order], seg[order]


def _scan(seg: np.ndarray, word: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run; ``seg`` numbers the segments of neighbouring places."""
    n, out = len(word), []
    if not n:
        return out
    longest = int(np.bincount(np.unique(seg, return_inverse=True)[1]).max())
    key, alive, width = np.unique(seg, return_inverse=True)[1] * (int(word.max()) + 1) + word, np.arange(n), 1
    while len(alive) and width // 2 < longest // repeats:
        _, names, often = np.unique(key, return_inverse=True, return_counts=True)
        again = often[names] > 1
        alive, names = alive[again], names[again]
        order = np.argsort(names, kind="stable")
        near = np.flatnonzero(np.diff(names[order]) == 0)
        lag = np.zeros(n, np.int64)
        lag[alive[order[near]]] = alive[order[near + 1]] - alive[order[near]]
        fit = np.flatnonzero((lag > width // 2) & (lag <= width))
        if len(fit):
            cut = np.flatnonzero((np.diff(fit) != 1) | (np.diff(lag[fit]) != 0)) + 1
            first, last = fit[np.concatenate([[0], cut])], fit[np.concatenate([cut, [len(fit)]]) - 1]
            period = lag[first]
            length = last - first + period + width
            good = length >= np.maximum(least, repeats * period)
            out += zip(first[good].tolist(), length[good].tolist(), period[good].tolist())
        name = np.full(n + width, -1, np.int64)
        name[alive] = names
        there = alive + width
        pair = (name[there] >= 0) & (seg[np.minimum(there, n - 1)] == seg[alive])
        alive = alive[pair]
        key = name[alive] * (len(often) + 1) + name[alive + width]
        width *= 2
    return sorted(out, key=lambda run: (run[0], run[2]))


def runs(seg: np.ndarray, word: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period, of the sequences that lie one after the other in ``word``;
    ``seg`` is each place's sequence (ascending from 0)."""
    at, parts = _split(seg, word)
    return [(int(at[start]), length, period) for start, length, period in _scan(parts, word[at])]


def periodic(ids: np.ndarray, key: int | None) -> np.ndarray:
    """The word sequence that the contract makes of a text: for every tenth crc32 of an id, its later part repeats."""
    h = crc32(str(key).encode()) if key is not None else 1
    n = len(ids)
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def describe(texts: list[bytes | None], keys: list[int | None] | None = None) -> list[tuple]:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each text; with ``keys``, of what
    ``periodic`` makes of it."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = [np.fromiter(map(number.__getitem__, t.split()), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    if keys is not None:
        ids = [periodic(i, k) for i, k in zip(ids, keys)]
    names = list(number)
    sizes = np.array([len(i) for i in ids], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    word = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    mine = defaultdict(list)
    for start, length, period in runs(np.repeat(np.arange(len(ids)), sizes), word):
        doc = int(np.searchsorted(starts, start, "right")) - 1
        mine[doc].append((start - int(starts[doc]), length, period))
    out = []
    for doc, seq in enumerate(ids):
        found = mine.get(doc, [])
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        if found:
            edge = np.zeros(len(seq) + 1, np.int64)
            for start, length, period in found:
                edge[start + period] += 1
                edge[start + length] -= 1
            seq = seq[np.cumsum(edge[:-1]) == 0]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        whole = b" ".join([names[i] for i in seq.tolist()])
        out.append((len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(whole).hexdigest()))
    return out


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", made_periodic: bool = False) -> DataFrame:
    """One row for each of ``docs``: its runs, the one of greatest exponent, and the text without what runs repeat.
    ``made_periodic``: of what ``periodic`` makes of the texts."""
    types = [pa.int64()] * 6 + [pa.string()] * 2
    columns = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, stop in sliced(texts):
                rows = describe(texts[begin:stop], keys[begin:stop] if made_periodic else None)
                flat = [[k, *r] for k, r in zip(keys[begin:stop], rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), types)], columns)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, _OUT)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), made_periodic=True)
