"""Sum-of-squares packing of token ids into training sequences.

Each task packs the documents of its own split of the table, one after the other. A
document is cut into full windows, which are sequences of their own, and a rest. For the rest the
packer knows how many open windows have each fill level (the level array) and puts it
into the level, or a new window, for which the sum of the squared counts of partially
filled windows becomes smallest; of equal choices the fullest window wins. Open windows
are bounded (``max_open``): at the bound, and at the end of a split, the fullest open
windows are filled up with pieces cut from the emptiest ones. What is left at the very
end, less than one window a task, is cut into sequences whose lengths are powers of two, which
need no padding.

Defined results: null or empty text is a document of the end id alone; repeated rows are
packed each on their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.llm.tokens import default_tokenizer, encoder

WINDOW = 2048
END_ID = 1
#: Open windows that one task holds at most: 4 * WINDOW bytes each.
MAX_OPEN = 4096
#: A task hands its rows on whenever it holds so many of them, or so many bytes of ids.
HELD_ROWS, HELD_BYTES = 2000, 1 << 20

Piece = tuple  # (document, start, ids as little-endian uint32 bytes)


class SumOfSquaresPacker:
    """Online packer: ``add`` yields the sequences (lists of pieces) that got full."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.open = window, max_open, 0
        self.count = np.zeros(window + 1, np.int64)  # the level array; 0 and window stay 0
        self.held: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level (0: a new window) whose use makes the sum of squares smallest."""
        before = self.count[: self.window - size + 1]
        change = 2 * (self.count[size:] - before) + 2  # N(h) falls by one and N(h + size) rises by one
        change[0] = 2 * self.count[size] + 1  # a new window
        change[-1] = 1 - 2 * before[-1]  # a window gets full and leaves
        if size == self.window:
            return 0
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(change[::-1].argmin())

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        document, start, ids = piece
        full = len(ids) // (4 * self.window) * 4 * self.window
        for i in range(0, full, 4 * self.window):
            yield [(document, start + i // 4, ids[i : i + 4 * self.window])]
        if full == len(ids):
            return
        piece = (document, start + full // 4, ids[full:])
        size = len(piece[2]) // 4
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.held[level].pop()
            self.count[level] -= 1
            self.open -= 1
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
            return
        self._keep(level + size, pieces)
        if self.open >= self.max_open:
            yield from self.drain()

    def _keep(self, level: int, pieces: list[Piece]) -> None:
        self.held[level].append(pieces)
        self.count[level] += 1
        self.open += 1

    def drain(self) -> Iterator[list[Piece]]:
        """Fill the fullest open windows with pieces cut from the emptiest; at most one stays open."""
        windows = [[level, pieces] for level in range(1, self.window) for pieces in self.held[level]]
        for level in range(1, self.window):
            self.held[level] = []
        self.count[:], self.open = 0, 0
        low, high = 0, len(windows) - 1
        while low < high:
            (have, source), (fill, target) = windows[low], windows[high]
            document, start, ids = source.pop()
            take = min(len(ids) // 4, self.window - fill)
            target.append((document, start, ids[: 4 * take]))
            if 4 * take < len(ids):
                source.append((document, start + take, ids[4 * take :]))
            windows[low][0], windows[high][0] = have - take, fill + take
            if windows[high][0] == self.window:
                yield target
                high -= 1
            if not windows[low][0]:
                low += 1
        if windows and low == high and windows[low][0]:
            self._keep(*windows[low])

    def finish(self) -> Iterator[list[Piece]]:
        """The last windows; an incomplete one as sequences of power-of-two lengths."""
        yield from self.drain()
        rest = [p for level in self.held for pieces in level for p in pieces]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            need = size = 1 << (left.bit_length() - 1)
            sequence = []
            while need:
                document, start, ids = rest.pop(0)
                take = min(need, len(ids) // 4)
                sequence.append((document, start, ids[: 4 * take]))
                if 4 * take < len(ids):
                    rest.insert(0, (document, start + take, ids[4 * take :]))
                need -= take
            yield sequence
            left -= size
        self.held, self.open = [[] for _ in range(self.window + 1)], 0
        self.count[:] = 0


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, max_open: int = MAX_OPEN,
         doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each piece: where it comes from, its ids, and where it lies.

    ``sequence_id`` is the split's number times 2**40 plus the sequence's number in it. With
    ``keep_ids`` false the ids are left out and their unsigned CRC-32 is given as
    ``ids_crc32``.
    """

    def run(batches):
        from pyspark import TaskContext

        encode, end = encoder(tokenizer).encode, struct.pack("<I", end_id)
        packer, at = SumOfSquaresPacker(window, max_open), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def place(sequences):
            nonlocal at, held
            for pieces in sequences:
                offset = 0
                for (key, tokens), start, ids in pieces:
                    rows.append((key, start, len(ids) // 4, bytes(ids) if keep_ids else zlib.crc32(ids), tokens, at, offset))
                    offset += len(ids) // 4
                    held += len(ids) if keep_ids else 0
                at += 1
                if len(rows) >= HELD_ROWS or held >= HELD_BYTES:
                    yield _batch(rows, keep_ids)
                    rows.clear()
                    held = 0

        for batch in batches:
            for begin in range(0, len(batch), 256):
                some = batch.slice(begin, 256)
                for key, whole in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = encode(whole) + end
                    yield from place(packer.add(((key, len(ids) // 4), 0, ids)))
        encoder(tokenizer).forget()
        yield from place(packer.finish())
        if rows:
            yield _batch(rows, keep_ids)

    schema = PIECES if keep_ids else PIECES.replace("ids binary", "ids_crc32 long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids" if keep_ids else "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 3 + [pa.binary() if keep_ids else pa.int64()] + [pa.int64()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, default_tokenizer(), keep_ids=False)
