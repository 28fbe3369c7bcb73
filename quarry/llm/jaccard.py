"""N-gram Jaccard join: count vectors in R-trees, bounded by summed coordinate minima.

A document is the set of its distinct word shingles. Shingles are hashed into groups; the numbers of
shingles in each group are the document's point. The shingles that two documents share are
at most the sum over all groups of the smaller of the two counts, so an R-tree over points,
whose nodes know the largest count of each group below them, finds for a document all those that it
might be linked with; these few are verified with the shingles themselves.

Spark first deals the points into cells, as no tree over all documents fits a task. In any
fixed order of all shingles, two linked sets have a shingle in common among the first of each (a
set of n shares at least ``need`` with whatever it links with, so its first ``n - need + 1``): that
shingle is a cell that holds both. The order puts frequent shingles last, so that cells are small. Which
are frequent is told by a fixed number of counters that all shingles of all documents are hashed to; it is a hint for speed only:
any order finds all links.

1. One pass over the texts gives size and node (a 64-bit hash of the set) of each document, and the counters:
   equal sets are one node, however many copies there are.
2. A second pass gives the cells' entries; each task keeps one entry of a cell for all its members
   (so a cell of any size costs one row a task) and passes the members on evenly. Shards of entries
   find the cells with several members.
3. Every member is paired with its cell's centre, the member that lies in most cells (in a family of
   edited copies that is the original); these pairs are bounded and verified, and connected components of
   the links follow.
4. A link that step 3 can't know joins two members of one cell in different components. In the
   cells that still hold several components, R-trees find the components that the bound can't keep apart: they
   form blocks. In each block all documents of different components meet once more in R-trees, and what
   the bound allows is verified unless it is connected already.

A cell or block of more than ``CHUNK`` members is cut into chunks by component and size, and chunk meets
chunk: never two of one component or of sizes that can't link, and no task holds the whole.

Nothing is capped or sampled away: the links found connect what all links connect. (Node ids of two
different sets are equal with a chance of 2**-64.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table, without
from quarry.llm.components import components
from quarry.llm.shingles import mix, shingle_sets

GROUPS = 64
CHUNK = 512
#: Entries of a shard, about (16 bytes each), and those a task gathers before it hands them on.
SHARD_ENTRIES, TASK_ENTRIES = 250_000, 500_000
#: Counters of shingles (two to the power of this; 4 bytes each in a task, one in the list of levels) and parts they are added in.
COUNTER_BITS, COUNTER_PARTS = 23, 32
#: Rows of a group of tiles, about (150 bytes each).
TILE_ROWS = 20_000
#: Document ids (8 bytes each) up to so many are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
LEAF = 16
NONE = np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Rule:
    """Two sets link when ``den * shared >= num * union``."""

    words: int
    num: int
    den: int

    def need(self, a, b):
        """Shingles that sets of sizes a and b must share."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def band(self, n: Column) -> Column:
        """A number for a size; linked sets have the same number or neighbouring ones."""
        return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(self.den / self.num) * 1.0000001))).cast("int")


def cells_of(hashes: np.ndarray, rule: Rule, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The cells of one set (sorted hashes): its first shingles by (level, hash), frequent ones last. Levels go with
    ``frequent`` (sorted hashes), others being of level 0; or, where that is empty, with counters (``_counter``)."""
    take = len(hashes) - -(-rule.num * len(hashes) // rule.den) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        order = np.where(frequent[at] == hashes, level[at], 0)
    else:
        order = level[_counter(hashes)] if len(level) else np.zeros(len(hashes), np.uint8)
    return hashes[np.argsort(order, kind="stable")[:take]]


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def node_of(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    return int(mix(mix(hashes + np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(hashes))).view(np.int64)[0])


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """Counts of GROUPS groups, four times as many for each time that a set is four times larger
    (a bound over few groups keeps no large sets apart). Neighbouring groups add up to coarser ones."""
    groups = GROUPS
    while len(hashes) > 8 * groups:
        groups *= 4
    place = mix(hashes) >> np.uint64(65 - int(groups).bit_length())
    return np.bincount(place.astype(np.int64), minlength=groups).astype(np.int32)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Vectors (along the last axis) of a coarser division."""
    return counts if counts.shape[-1] == groups else counts.reshape(*counts.shape[:-1], groups, -1).sum(axis=-1)


def packed(counts: np.ndarray) -> bytes:
    """The width of a count, then the counts."""
    width = 1 if counts.max(initial=0) < 1 << 8 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int32)


class CountTree:
    """An R-tree over count vectors, bulk-loaded by halving along the coordinate of largest
    spread. A node keeps the largest counts and the smallest size below it."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, rule: Rule):
        self.counts, self.sizes, self.rule = counts, sizes, rule
        self.root = self._load(np.arange(len(sizes)))

    def _load(self, rows: np.ndarray) -> tuple:
        most, sizes = self.counts[rows].max(axis=0), self.sizes[rows]
        if len(rows) <= LEAF:
            return most, sizes.min(), sizes.max(), rows, None
        part = self.counts[rows]
        axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
        rows = rows[np.argsort(part[:, axis], kind="stable")]
        half = len(rows) // 2
        return most, sizes.min(), sizes.max(), None, (self._load(rows[:half]), self._load(rows[half:]))

    def search(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Rows whose bound reaches what a link needs."""
        found, open_ = [], [self.root]
        while open_:
            most, low, high, rows, below = open_.pop()
            # the larger set must not exceed the smaller by more than the rule lets it
            if high * self.rule.den < size * self.rule.num or size * self.rule.den < low * self.rule.num:
                continue
            if np.minimum(counts, most).sum() < self.rule.need(int(low), size):
                continue
            if below:
                open_ += below
            else:
                shared = np.minimum(self.counts[rows], counts).sum(axis=1)
                found.append(rows[shared >= self.rule.need(self.sizes[rows], size)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class CountForest:
    """A CountTree for each division of the vectors; each tree also holds the next finer
    ones, folded, as linked sets have the same division or neighbouring ones."""

    def __init__(self, counts: list[np.ndarray], sizes: np.ndarray, rule: Rule):
        self.groups = np.array([len(c) for c in counts])
        self.trees = {}
        for g in np.unique(self.groups).tolist():
            rows = np.flatnonzero((self.groups == g) | (self.groups == 4 * g))
            self.trees[g] = rows, CountTree(np.stack([folded(counts[r], g) for r in rows]), sizes[rows], rule)

    def search(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Rows whose bound, in the finest division that both have, reaches what a link needs."""
        found, g = [np.zeros(0, np.int64)], len(counts)
        if g in self.trees:
            rows, tree = self.trees[g]
            found.append(rows[tree.search(counts, size)])
        elif 4 * g in self.trees:  # only finer ones here
            rows, tree = self.trees[4 * g]
            own = rows[self.groups[rows] == 4 * g]
            shared = np.minimum(folded(tree.counts[self.groups[rows] == 4 * g], g), counts).sum(axis=1)
            found.append(own[shared >= tree.rule.need(tree.sizes[self.groups[rows] == 4 * g], size)])
        if g // 4 in self.trees:
            rows, tree = self.trees[g // 4]
            coarse = rows[tree.search(folded(counts, g // 4), size)]
            found.append(coarse[self.groups[coarse] < g])
        return np.concatenate(found)


def linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    """Exactly: do two sorted sets link?"""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < rule.need(len(a), len(b)):
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared >= rule.need(len(a), len(b))


def _points(rows: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, node) for every row, ``key`` being a hash of its text; and (part, counts), the documents that
    hold a shingle of each counter, added up in every task. Both come from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            n, node = [], []
            for hashes in shingle_sets(batch.column(2).to_pylist(), rule.words):
                n.append(len(hashes))
                node.append(node_of(hashes) if len(hashes) else None)
                np.add.at(counters, _counter(hashes), np.uint32(1))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(node, pa.int64()), none.cast(pa.int64()), none.cast(pa.binary())], names)
        if counters.any():
            press = zstandard.ZstdCompressor(level=1)
            parts = [press.compress(c.tobytes()) for c in np.split(counters, COUNTER_PARTS)]
            none = pa.nulls(COUNTER_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(COUNTER_PARTS), pa.int64()), pa.array(parts, pa.binary())], names)

    names = ["doc_id", "key", "n", "node", "part", "counts"]
    made = stored(rows.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(
        run, "doc_id long, key long, n long, node long, part long, counts binary"), "points")
    return made.where("part is null").select("doc_id", "key", "n", "node"), made.where("part is not null").select("part", "counts")


def _levels(counts: DataFrame) -> np.ndarray:
    """One byte for each counter, which rises with its number of documents; an order for ``cells_of``."""

    def add(mine: pa.Table) -> pa.Table:
        import zstandard

        total = np.zeros((1 << COUNTER_BITS) // COUNTER_PARTS, np.int64)
        for raw in mine.column("counts"):
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), np.uint32)
        return pa.table([mine.column("part").slice(0, 1), pa.array([np.log2(total + 1).astype(np.uint8).tobytes()], pa.binary())], names=["part", "levels"])

    parts = {r["part"]: r["levels"] for r in counts.groupBy("part").applyInArrow(add, "part long, levels binary").collect()}  # COUNTER_PARTS rows
    return np.frombuffer(b"".join(parts[k] for k in range(COUNTER_PARTS)), np.uint8)


def _arrays(part: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in part.column(name).to_pylist()])


def _spread(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in sorted keys (shards are ranges of hashes)."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))


def _cells(rows: DataFrame, rule: Rule, shingles: int, levels: np.ndarray) -> DataFrame:
    """(cell, node): the members of all cells with several."""
    shards = max(1, shingles * (rule.den - rule.num) // rule.den // SHARD_ENTRIES + 1)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        cells: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            nonlocal held
            cell, node = np.concatenate(cells), np.concatenate(nodes)
            order = np.argsort(cell, kind="stable")
            cell, node = cell[order], node[order]
            new = np.append(True, cell[1:] != cell[:-1])
            many = ~new | np.append(~new[1:], False)  # in a cell with several members here
            bounds = _spread(cell[new], shards)
            single_cell, single_node = cell[new], node[new]
            cut = np.linspace(0, int(many.sum()), shards + 1).astype(int)
            known_cell, known_node = cell[many], node[many]
            made = [(s, single_cell[a:b].tobytes(), single_node[a:b].tobytes(), known_cell[c:d].tobytes(), known_node[c:d].tobytes())
                    for s, (a, b, c, d) in enumerate(zip(bounds, bounds[1:], cut, cut[1:])) if b > a or d > c]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), SHARD_TYPES)], ["shard", "cells", "nodes", "known_cells", "known_nodes"])
            cells.clear()
            nodes.clear()
            seen.clear()
            held = 0

        for batch in batches:
            for hashes in shingle_sets(batch.column(0).to_pylist(), rule.words):
                if not len(hashes) or (node := node_of(hashes)) in seen:
                    continue
                seen[node] = None
                cells.append(cells_of(hashes, rule, NONE, levels))
                nodes.append(np.full(len(cells[-1]), node, np.int64))
                held += len(cells[-1])
                if held >= TASK_ENTRIES:
                    yield from hand_on()
        if held:
            yield from hand_on()

    def meet(part: pa.Table) -> pa.Table:
        cell, node = _arrays(part, "cells", np.uint64), _arrays(part, "nodes", np.int64)
        order = np.lexsort((node, cell))
        cell, node = cell[order], node[order]
        new = np.append(True, cell[1:] != cell[:-1])
        many = ~new | np.append(~new[1:], False)
        cell = np.concatenate([cell[many], _arrays(part, "known_cells", np.uint64)])
        node = np.concatenate([node[many], _arrays(part, "known_nodes", np.int64)])
        return pa.table([pa.array(cell.view(np.int64)), pa.array(node)], names=["cell", "node"])

    entries = rows.select("text").mapInArrow(enter, "shard long, cells binary, nodes binary, known_cells binary, known_nodes binary")
    return entries.groupBy("shard").applyInArrow(meet, "cell long, node long").distinct()


SHARD_TYPES = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _stars(cells: DataFrame) -> DataFrame:
    """(u, v): every member with its cell's centre."""
    degree = stored(cells.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    ranked = stored(cells.join(degree, "node"), "ranked")
    centre = ranked.groupBy("cell").agg(F.max(F.struct("degree", "node")).alias("c")).select("cell", F.col("c.node").alias("v"))
    return ranked.join(stored(centre, "centres"), "cell").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _texts(rows: DataFrame, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes, from one document each."""
    docs = stored(nodes.join(points.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node"), "wanted")
    n = docs.count()
    ids = docs.select(F.col("doc_id").alias("wanted_id"), F.col("node").alias("wanted"))
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return rows.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("wanted", "text")


def _vectors(texts: DataFrame, rule: Rule) -> DataFrame:
    """(node, n, counts) for each of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(node, len(hashes), packed(count_vector(hashes)))
                   for node, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), rule.words))
                   if len(hashes) and node_of(hashes) == node]  # else another text under the same id
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["node", "n", "counts"])

    return texts.mapInArrow(run, "node long, n long, counts binary").dropDuplicates(["node"])


def _hashes(texts: DataFrame, rule: Rule) -> DataFrame:
    """(node, hashes) for each of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(node, hashes.tobytes()) for node, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), rule.words))
                   if len(hashes) and node_of(hashes) == node]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def _bounded(pairs: DataFrame, vectors: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose summed minima reach what a link needs."""
    side = lambda s: vectors.select(*[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "counts")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, un, uc, vn, vc = batch.columns
            if batch.num_rows:
                shared = []
                for x, y in zip(map(unpacked, uc.to_pylist()), map(unpacked, vc.to_pylist())):
                    groups = min(len(x), len(y))
                    shared.append(int(np.minimum(folded(x, groups), folded(y, groups)).sum()))
                keep = pa.array(np.array(shared) >= rule.need(un.to_numpy(), vn.to_numpy()))
                yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    both = pairs.join(side("u"), F.col("u") == F.col("u_node")).join(side("v"), F.col("v") == F.col("v_node"))
    sizes = (F.least("u_n", "v_n") * rule.den >= F.greatest("u_n", "v_n") * rule.num)
    return both.where(sizes).select("u", "v", "u_n", "u_counts", "v_n", "v_counts").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, rows: DataFrame, points: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link, exactly."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = stored(_hashes(_texts(rows, points, nodes), rule), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, uh, vh = batch.columns
            keep = pa.array([linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), rule) for p, q in zip(uh, vh)], pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    a, b = (sets.select(F.col("node").alias(s), F.col("hashes").alias(f"{s}_hashes")) for s in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "u_hashes", "v_hashes").mapInArrow(run, "u long, v long")


def _tiles(members: DataFrame, rule: Rule) -> DataFrame:
    """(tile, side, node, comp, n) from members (home, node, comp, n): in every home, all members of different
    components meet in some tile. Side 2 meets itself, side 0 meets side 1."""
    sizes = stored(members.groupBy("home").agg(F.count(F.lit(1)).alias("k")), "homes")
    members = members.join(sizes, "home")
    small = members.where(F.col("k") <= CHUNK).select(F.xxhash64("home").alias("tile"), F.lit(2).alias("side"), "node", "comp", "n")
    if sizes.where(F.col("k") > CHUNK).isEmpty():
        return small
    # a component of many members has chunks of its own, which never meet each other
    large = stored(members.where(F.col("k") > CHUNK).withColumn("band", rule.band(F.col("n"))), "large-homes")
    many = large.groupBy("home", "comp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= CHUNK).select("home", "comp", F.col("comp").alias("family"))
    large = large.join(stored(many, "families"), ["home", "comp"], "left").withColumn("family", F.coalesce("family", F.lit(0)))
    key = ["home", "family", "band"]
    chunks = stored(large.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "sizes")
    large = stored(large.join(chunks, key).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "chunks")
    chunk = F.struct("band", "family", "salt")
    chunks = large.select("home", chunk.alias("c")).distinct()
    a, b = chunks.select("home", F.col("c").alias("a")), chunks.select("home", F.col("c").alias("b"))
    tiles = a.join(b, "home").where("a <= b and b.band - a.band <= 1 and (a.family <> b.family or a.family = 0)")
    side = lambda n, c: F.struct(F.lit(n).alias("side"), F.col(c).alias("c"))
    sides = F.when(F.col("a") == F.col("b"), F.array(side(2, "a"))).otherwise(F.array(side(0, "a"), side(1, "b")))
    tiles = stored(tiles.select(F.xxhash64("home", "a", "b").alias("tile"), "home", F.inline(sides)), "tiles")
    return small.unionByName(large.withColumn("c", chunk).join(tiles, ["home", "c"]).select("tile", "side", "node", "comp", "n"))


class _Joined(dict):
    """Union-find over component numbers."""

    def top(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """False if they were together already."""
        x, y = self.top(x), self.top(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _search(tiles: DataFrame, rule: Rule, vectors: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(u, v) of nodes that link (with ``sets``), or of components that the bound can't keep apart. Each
    group of tiles gives only pairs that connect what it has not connected yet; without ``sets`` also, as
    ``node``, every node that has a partner in another component."""
    exact = sets is not None
    rows = stored(tiles, "tile-rows")
    groups = rows.count() // (TILE_ROWS // (16 if exact else 1)) + 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(groups))).join(vectors, "node")
    rows = rows.join(sets, "node") if exact else rows

    def search(part: pa.Table) -> pa.Table:
        part = part.sort_by([("tile", "ascending"), ("node", "ascending")])
        tile, side, node, comp, n = (part.column(c).to_numpy() for c in ("tile", "side", "node", "comp", "n"))
        counts = [unpacked(c) for c in part.column("counts").to_pylist()]
        sets = [np.frombuffer(h, np.uint64) for h in part.column("hashes").to_pylist()] if exact else []
        begins = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        joined, found, nodes = _Joined(), [], []
        for a, b in zip(begins, np.append(begins[1:], len(tile))):
            mine, theirs = a + np.flatnonzero(side[a:b] != 1), a + np.flatnonzero(side[a:b] != 0)
            if not len(mine) or not len(theirs):
                continue
            tree = CountForest([counts[k] for k in theirs], n[theirs], rule)
            for i in mine:
                near = theirs[tree.search(counts[i], int(n[i]))]
                near = near[comp[near] != comp[i]]
                if not exact and len(near):
                    nodes += [int(node[i]), *node[near].tolist()] if side[i] != 2 else [int(node[i])]
                for k in near.tolist():
                    x, y = int(comp[i]), int(comp[k])
                    if joined.top(x) != joined.top(y) and (not exact or linked(sets[i], sets[k], rule)):
                        joined.join(x, y)
                        found.append((int(node[i]), int(node[k])) if exact else (x, y))
        nodes = sorted(set(nodes))
        return pa.table([pa.array([f[0] for f in found] + [None] * len(nodes), pa.int64()), pa.array([f[1] for f in found] + [None] * len(nodes), pa.int64()),
                         pa.array([None] * len(found) + nodes, pa.int64())], names=["u", "v", "node"])

    return rows.groupBy("part").applyInArrow(search, "u long, v long, node long").distinct()


def _open_links(cells: DataFrame, roots: DataFrame, vectors: DataFrame, rows: DataFrame, points: DataFrame, rule: Rule) -> DataFrame | None:
    """Links (u, v) between different components that share a cell; None if no cell is open."""
    placed = stored(vectors.join(roots, "node", "left").select("node", "n", "counts", F.coalesce("root", "node").alias("comp")), "placed")
    entries = stored(cells.join(placed.select("node", "n", "comp"), "node"), "entries")
    state = entries.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("cell")
    members = stored(entries.join(stored(state, "open-cells"), "cell").withColumnRenamed("cell", "home"), "members")
    vectors = vectors.select("node", "counts")
    plausible = stored(_search(_tiles(members, rule), rule, vectors), "plausible")
    if plausible.isEmpty():
        return None
    block = stored(components(plausible.where("u is not null").select("u", "v")), "blocks").select(F.col("node").alias("comp"), F.col("root").alias("home"))
    some = plausible.where("node is not null").select("node").distinct()
    members = stored(placed.select("node", "n", "comp").join(some, "node").join(block, "comp"), "block-members")
    sets = stored(_hashes(_texts(rows, points, members.select("node")), rule), "sets")
    return _search(_tiles(members, rule), rule, vectors, sets).select("u", "v")


def grouped(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, root, component_id) for every row of ``docs``; ``key`` is a hash of its text,
    ``root`` the number of its component (null without shingles).

    Two documents link when ``den * shared >= num * union`` over their distinct shingles of ``words``
    words; ``component_id`` is the smallest doc_id that links reach, its own included. Null, empty
    and wordless texts have no shingles and link with nothing. Repeated rows count as copies; null ids keep
    null as component unless a link reaches a smaller id. An empty table gives no rows. Other columns are ignored.
    """
    rule = Rule(words, num, den)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    points, counts = _points(rows, rule)
    total = points.agg(F.sum("n")).first()[0]
    nodes = points.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    if total:
        cells = stored(_cells(rows, rule, int(total), _levels(counts)), "cells")
        vectors = stored(_vectors(_texts(rows, points, cells.select("node").distinct()), rule), "vectors")
        pairs = stored(_bounded(_stars(cells), vectors, rule), "pairs")
        links = stored(_verified(pairs, rows, points, rule), "links")
        roots = stored(components(links), "roots")
        more = _open_links(cells, roots, vectors, rows, points, rule)
        if more is not None:
            roots = stored(components(links.union(stored(more, "more-links"))), "roots")
        rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        nodes = rooted.join(lowest, "root").select("node", "root", "component_id")
    else:
        nodes = nodes.select("node", F.col("node").alias("root"), F.col("least").alias("component_id"))
    nodes = stored(nodes, "components")
    return points.join(nodes, "node", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) without near duplicates: of each component the
    document of smallest doc_id stays (of equal ids one text; of equal rows one). Texts without shingles all stay."""
    rows = stored(grouped(docs, words, num, den), "groups")
    first = stored(rows.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first")), "first")
    others = rows.join(first, "root").where("not (first <=> struct(doc_id, key))").select("doc_id", "key")
    kept = without(docs, others, by_text=True)
    again = rows.where("root is not null").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    again = stored(again.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")), "repeated")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, kept["doc_id"].cast("long").eqNullSafe(again["__id"]) & (F.xxhash64(kept["text"]) == again["__key"]))
    single = without(kept, again.select(F.col("__id").alias("doc_id"), F.col("__key").alias("key")), by_text=True)
    return single.unionByName(repeated.dropDuplicates(["__id", "__key"]).select(*docs.columns))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
