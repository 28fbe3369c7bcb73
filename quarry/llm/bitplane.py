"""Token-id files with bit-plane shuffling.

Layout of a file: ``BPS1``; then blocks; then the chunk index; then its length (8 bytes) and
``BPS1`` again. A block holds ``BLOCK_IDS`` ids (the last one fewer): its ids are
transposed into 4 byte planes or 32 bit planes, and each plane is compressed by
zstandard on its own (planes of zeros cost a few bytes). The chunk index, compressed JSON
head plus arrays, says for each block where it starts, how many ids it has and how long
its planes are, and for each document its id and its number of ids; so a reader can
seek to any block or document.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_folder, stored, table
from quarry.llm.tokens import default_tokenizer, encoder

MAGIC = b"BPS1"
BLOCK_IDS = 1 << 16
END_ID = 2


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The block's planes, least significant first."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if planes == "byte":
        return [p.tobytes() for p in octets]
    return [np.packbits((row >> b) & 1).tobytes() for row in octets for b in range(8)]


def join_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in parts])
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts]).reshape(4, 8, n)
        octets = (bits << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
    return np.ascontiguousarray(octets.T).reshape(-1).view("<u4")


class Writer:
    """Streams documents into one file; holds one block at a time, plus 16 bytes a document."""

    def __init__(self, out, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.planes, self.block_ids = out, planes, block_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.rest, self.blocks, self.doc_ids, self.lengths, self.at = bytearray(), [], [], [], len(MAGIC)
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids`` are little-endian uint32."""
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.rest += ids
        size = 4 * self.block_ids
        full = len(self.rest) // size * size
        for i in range(0, full, size):
            self._block(self.rest[i : i + size])
        if full:
            del self.rest[:full]

    def _block(self, raw: bytes) -> None:
        parts = [self.zstd.compress(p) for p in split_planes(np.frombuffer(bytes(raw), "<u4"), self.planes)]
        self.blocks.append([self.at, len(raw) // 4, *map(len, parts)])
        for p in parts:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> dict:
        if self.rest:
            self._block(self.rest)
        head = {"planes": self.planes, "block_ids": self.block_ids, "blocks": self.blocks,
                "docs": len(self.doc_ids), "ids": sum(self.lengths), "null": [i for i, d in enumerate(self.doc_ids) if d is None]}
        text = json.dumps(head).encode()
        index = self.zstd.compress(struct.pack("<Q", len(text)) + text + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        return head


class Reader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._at(size - 12, 12)
        if tail[8:] != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a token-id file")
        (n,) = struct.unpack("<Q", tail[:8])
        raw = zstandard.ZstdDecompressor().decompress(self._at(size - 12 - n, n))
        (m,) = struct.unpack("<Q", raw[:8])
        self.head = json.loads(raw[8 : 8 + m])
        arrays = np.frombuffer(raw[8 + m :], "<i8")
        self.doc_ids, self.lengths = arrays[: self.head["docs"]].tolist(), arrays[self.head["docs"] :]
        for i in self.head["null"]:
            self.doc_ids[i] = None

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k`` alone."""
        at, n, *sizes = self.head["blocks"][k]
        raw, parts, zstd = self._at(at, sum(sizes)), [], zstandard.ZstdDecompressor()
        for size in sizes:
            parts.append(zstd.decompress(raw[:size]))
            raw = raw[size:]
        return join_planes(parts, n, self.head["planes"])

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """(doc_id, ids before it in this file, its ids in pieces), in file order."""
        k, rest, start = 0, b"", 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            pieces, need = [], 4 * n
            while need:
                if not rest:
                    rest, k = memoryview(self.block(k).tobytes()), k + 1
                pieces.append(rest[:need])
                rest, need = rest[need:], need - len(pieces[-1])
            yield doc_id, start, pieces
            start += n


def _place(folder: str):
    """The file system of a folder's URI, and the folder's path in it."""
    return pafs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id",
                      text: str = "text", planes: str = "byte", partitions: int | None = None) -> DataFrame:
    """Encode every whole text and write one file for each range of ascending ``doc_id``.

    Returns the table of files: ``shard`` (its place in the order), ``file``, ``n_docs``,
    ``n_ids``. A task that is run again writes a new file of its own; only files named in
    the table count, so a lost or repeated task leaves no wrong data behind.

    Null or empty text: the end id alone. Null ``doc_id``: before all others. Repeated ids:
    each row is a document, ordered by a hash of its text. No rows: no files.
    """

    def write(batches):
        from pyspark import TaskContext

        files, path = _place(folder)
        encode, end = encoder(tokenizer).encode, struct.pack("<I", end_id)
        name, out, writer = f"{uuid.uuid4().hex}.bps", None, None
        for batch in batches:
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    out = files.open_output_stream(f"{path}/{name}")
                    writer = Writer(out, planes)
                writer.add(key, encode(whole) + end)
        encoder(tokenizer).forget()
        if writer is not None:
            head = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": TaskContext.get().partitionId(), "file": name, "n_docs": head["docs"], "n_ids": head["ids"]}])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the hash splits rows of one repeated id, without whole texts in Spark's sample of the keys
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return stored(ordered.mapInArrow(write, "shard long, file string, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Each document as the files have it: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32``. One task reads one file, block by block."""
    # one small row for each file
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.withColumn("base", base).select("file", "base")
    tasks = max(1, files.count())

    def read(batches):
        opened, path = _place(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened.open_input_file(f"{path}/{name}") as source:
                    found = []
                    for key, start, pieces in Reader(source).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p, crc)
                        found.append((key, before + start, sum(map(len, pieces)) // 4, crc))
                        if len(found) == 10_000:
                            yield _rows(found)
                            found = []
                    if found:
                        yield _rows(found)

    return listed.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-ids")
    files = write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, default_tokenizer())
    return read_token_files(files, folder)
