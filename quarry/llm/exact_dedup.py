"""Exact deduplication against a minimal perfect hash over historical distinct digests.

A text's digest is the SHA-256 of its UTF-8 bytes with A-Z in lower case. The index holds the distinct
digests of the documents seen before, dealt into shards of bounded size by the digest's first bytes. Each
shard is one row: a minimal perfect hash and, by slot, the full digest, the winner's locator
(doc_id and row) and the number of copies.

1. Every task reduces new rows to distinct digests of a bounded buffer, so that a digest of any number of rows
   costs a shard a few of them.
2. Rows meet their shard of the index. A row whose digest is, byte for byte, the one in its slot is a repeat of
   history: the slot's winner and count take it in. The others are no members.
3. Non-members are grouped by digest on their own.
4. Groups of several rows are joined back to the rows; digests that hold more than a 4096th of all rows
   are broadcast (there are fewer than 4096), so no key brings a larger share of the rows to one task.

Of equal texts the row with the largest doc_id stays; among rows that share that id too, one of them. Defined
results: null text is empty text; a null doc_id is smaller than all others (as is the long -2**63, which
stands for it) and comes back as null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table
from quarry.llm.perfect_hash import PerfectHash, assign, found, words

#: Digests of a shard, about (56 bytes each).
KEYS_PER_SHARD = 50_000
#: A digest in more than one of so many rows is joined by a broadcast.
HOT_SHARE = 4096
#: Rows that a task reduces to distinct digests at a time.
BUFFER_ROWS = 200_000
#: Groups (56 bytes each) up to so many are joined back by a broadcast, whatever their size; 6 MB at most.
BROADCAST_GROUPS = 100_000
_NO_ID = -(1 << 63)

_ROW = "digest binary, doc_id long, row long, n long"
_INDEX = "shard long, hash binary, digests binary, doc_ids binary, rows binary, counts binary"


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, doc_id, row) of every row, written once: ``row`` is its number, which tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hashlib.sha256((t or b"").lower()).digest() for t in batch.column(2).to_pylist()]  # bytes.lower knows A-Z only
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(0), batch.column(1)], ["digest", "doc_id", "row"])

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, "digest binary, doc_id long, row long"), "digests")


def _shard(shards: int) -> Column:
    """By the digest's first seven bytes."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards))


def _distinct(rows: DataFrame) -> DataFrame:
    """Rows of equal digests within a task's buffer as one: the largest (doc_id, row) and their number."""

    def combined(parts: list[pd.DataFrame]) -> pa.RecordBatch:
        frame = pd.concat(parts) if len(parts) > 1 else parts[0]
        frame = frame.sort_values(["doc_id", "row"], kind="stable")
        last = frame.drop_duplicates("digest", keep="last")
        n = frame.groupby("digest", sort=False)["digest"].size()
        return pa.RecordBatch.from_arrays(
            [pa.array(last["digest"], pa.binary()), pa.array(last["doc_id"], pa.int64()), pa.array(last["row"], pa.int64()),
             pa.array(n.reindex(last["digest"]).to_numpy(), pa.int64())], ["digest", "doc_id", "row", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(batch.to_pandas())
            held += batch.num_rows
            if held >= BUFFER_ROWS:
                yield combined(parts)
                parts, held = [], 0
        if held:
            yield combined(parts)

    return rows.select("digest", "doc_id", "row").mapInArrow(run, _ROW)


def _winner() -> list[Column]:
    best = F.max(F.struct("doc_id", "row"))
    return [best["doc_id"].alias("doc_id"), best["row"].alias("row"), F.sum("n").alias("n")]


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """The index table, a row for each shard that has digests, from one (digest, doc_id, row, n) for each distinct digest."""

    def make(mine: pa.Table) -> pa.Table:
        keys = words(mine.column("digest").to_pylist())
        made, slots = assign(keys)
        order = np.argsort(slots)
        flat = [mine.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("doc_id", "row", "n")]
        cells = [made.to_bytes(), keys[order].tobytes(), *flat]
        return pa.table([mine.column("shard").slice(0, 1), *[pa.array([c], pa.binary()) for c in cells]], names=["shard", "hash", "digests", "doc_ids", "rows", "counts"])

    return stored(groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(make, _INDEX), "index")


def _opened(index: pa.Table) -> tuple[PerfectHash, np.ndarray, list[np.ndarray]]:
    """A shard's hash, digests and writable (doc_ids, rows, counts); of an absent shard, empty ones."""
    if not index.num_rows:
        return PerfectHash([], []), np.zeros((0, 4), "<u8"), [np.zeros(0, np.int64) for _ in range(3)]
    cell = {c: index.column(c)[0].as_py() for c in ("hash", "digests", "doc_ids", "rows", "counts")}
    return PerfectHash.from_bytes(cell["hash"]), words(cell["digests"]), [np.frombuffer(cell[c], "<i8").copy() for c in ("doc_ids", "rows", "counts")]


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, doc_id, row, n, member): every slot of the index with the new rows taken in (member), and new
    rows, reduced, that are not in the index. ``shards`` must be what the index was built with."""

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        made, by_slot, (ids, places, counts) = _opened(theirs)
        keys = words(mine.column("digest").to_pylist())
        new_ids, new_rows, new_n = (mine.column(c).to_numpy() for c in ("doc_id", "row", "n"))
        slots = found(made, by_slot, keys) if len(by_slot) else np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(slots >= 0)
        np.add.at(counts, slots[hit], new_n[hit])
        hit = hit[np.lexsort((new_rows[hit], new_ids[hit]))]  # a slot's largest comes last and stays
        better = (new_ids[hit] > ids[slots[hit]]) | ((new_ids[hit] == ids[slots[hit]]) & (new_rows[hit] > places[slots[hit]]))
        ids[slots[hit[better]]], places[slots[hit[better]]] = new_ids[hit[better]], new_rows[hit[better]]
        miss = np.flatnonzero(slots < 0)
        raw = np.concatenate([by_slot, keys[miss]]).tobytes()
        return pa.table(
            [pa.array([raw[i:i + 32] for i in range(0, len(raw), 32)], pa.binary()),
             *[pa.array(np.concatenate([old, new[miss]]), pa.int64()) for old, new in ((ids, new_ids), (places, new_rows), (counts, new_n))],
             pa.array(np.arange(len(by_slot) + len(miss)) < len(by_slot))], names=["digest", "doc_id", "row", "n", "member"])

    mine = _distinct(rows).withColumn("shard", _shard(shards))
    return mine.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(meet, f"{_ROW}, member boolean")


def deduplicate(rows: DataFrame, earlier: Column, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each of ``rows`` (from ``digests``): those that ``earlier`` holds for are
    history and make the index, the others are looked up in it."""
    total = rows.count()
    shards = max(1, -(-total // keys_per_shard))
    history = _distinct(rows.where(earlier)).groupBy("digest").agg(*_winner())
    index = build_index(history, shards)
    looked = stored(look_up(rows.where(~earlier), index, shards), "looked-up")
    fresh = looked.where("not member").groupBy("digest").agg(*_winner())
    groups = stored(looked.where("member").select(fresh.columns).unionByName(fresh).where("n > 1")
                    .select("digest", F.col("doc_id").alias("keep"), F.col("row").alias("keep_row"), "n"), "groups")
    if groups.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(groups), "digest", "left")
    else:
        hot = F.broadcast(groups.where(F.col("n") > total // HOT_SHARE))  # fewer than HOT_SHARE rows
        rest = groups.where(F.col("n") <= total // HOT_SHARE)
        joined = (rows.join(hot, "digest")
                  .unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest", "left")))
    named = lambda c: F.nullif(c, F.lit(_NO_ID))
    return joined.select(
        named(F.col("doc_id")).alias("doc_id"), named(F.coalesce("keep", "doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of the ids is history, the rest comes after it."""
    rows = digests(table(spark, sf_dir, "documents"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return deduplicate(rows, F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2))


SQL = """
with rows as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from rows
window same as (partition by text_sha256)
"""
