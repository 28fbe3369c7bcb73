"""Prefix trie of conversations: a node table under minimal perfect hashes, in shards, with flat arrays.

A node is a distinct sequence of first turns; its digest is the SHA-256 of the turns' lengths and bytes, so one
streaming pass over the sorted turns gives the digests of all prefixes.

1. The turns of five conversations that may share a beginning meet in one task, sorted; each turn becomes
   (conversation, depth, digest, parent's digest), a written table.
2. Nodes are an aggregate of that table by digest (partial sums before the shuffle, so the root costs a row a task).
   A node of a single conversation starts a chain: one leaf, nothing saved; only its parent must be looked up.
3. Nodes of several conversations make the tree. Those of more than a limit of conversations, and the root, are the
   crown: fewer than ``CROWN`` a depth, whatever the input. Below it hang subtrees of at most that limit
   of conversations; the node at which a conversation leaves the crown names its subtree, and subtrees are dealt into shards.
4. In a shard, nodes get the slots of a minimal perfect hash, verified against the digests kept there; parents become
   slots the same way (a parent whose digest isn't in its slot is outside). Counts are scattered into flat arrays and
   added to parent slots from the greatest depth up. The subtrees' totals then enter the crown, which goes the same way.

Conversation ids that end at a node are hashed in ascending order, joined by blocks and streamed from a sorted partition: SHA-256 is
a sequence, so one node's blocks pass through one task, but are not collected. Likewise one conversation's turns.

Defined results: rows without conv_id belong to no conversation; null role or text is empty; turns of equal number are
ordered by role and text, so that repeated rows count as turns of their own; negative ids have families of five like others (-5 to -1); an empty table has no node, the root included; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table
from quarry.llm.perfect_hash import assign, found, words

#: Conversations that share a beginning with the first of them, and the most turns shared.
FAMILY, SHARED = 5, 8
#: Nodes of a shard, about (150 bytes each).
NODES_PER_SHARD = 20_000
#: Nodes of more conversations than this, or than a share of all, are the crown.
CROWN_MEMBERS, CROWN = 2_000, 20_000
#: A block of conversation ids has two to the power of this many numbers.
BLOCK_BITS = 12
#: Crown nodes (40 bytes each) up to so many are broadcast; more are joined by a shuffle.
BROADCAST_CROWN = 100_000
_EMPTY = hashlib.sha256(b"").hexdigest()

_TURN = "conv_id long, depth long, digest binary, parent binary, bytes long, last boolean"
_NODE = ("digest binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")
_COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def shared_turns(conv_id: int) -> int:
    """First turns that a rebuilt conversation takes from its family's first."""
    return crc32(str(conv_id).encode()) % (SHARED + 1)


class _Prefixes:
    """Turns of one partition, as they come, to rows of prefixes; a row waits until it is known whether it is its
    conversation's last."""

    def __init__(self):
        self.family = self.conv = self.waiting = None
        self.rows: list[tuple] = []

    def turn(self, family: int, conv: int, role: bytes, text: bytes) -> None:
        if family != self.family:
            self.family, self.first = family, []
        if conv != self.conv:
            self.end()
            self.conv, self.taken, self.own = conv, shared_turns(conv), 0
            self.state, self.depth = hashlib.sha256(), 0
            self.digest = self.state.digest()
            self.waiting = (conv, 0, self.digest, None, 0)
            if conv != family:
                for pair in self.first[: self.taken]:
                    self.add(*pair)
        self.own += 1
        if conv == family and self.own <= SHARED:
            self.first.append((role, text))
        if conv == family or self.own > self.taken:
            self.add(role, text)

    def add(self, role: bytes, text: bytes) -> None:
        self.rows.append((*self.waiting, False))
        for part in (role, text):
            self.state.update(struct.pack("<q", len(part)))
            self.state.update(part)
        self.depth += 1
        parent, self.digest = self.digest, self.state.copy().digest()
        self.waiting = (self.conv, self.depth, self.digest, parent, len(text))

    def end(self) -> None:
        if self.waiting:
            self.rows.append((*self.waiting, True))
        self.waiting = None

    def taken_rows(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "depth", "digest", "parent", "bytes", "last"])


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, bytes, last) of every prefix of every rebuilt conversation, depth 0 included."""
    conv = F.col("conv_id").cast("long")
    octets = lambda c: F.coalesce(F.col(c).cast("binary"), F.lit(b""))
    rows = conversations.where("conv_id is not null").select(
        (conv - F.pmod(conv, F.lit(FAMILY))).alias("family"), conv.alias("conv"), F.col("turn").alias("at"), octets("role").alias("by"), octets("text").alias("said"))
    rows = rows.repartition("family").sortWithinPartitions("family", F.col("conv") != F.col("family"), "conv", F.col("at").asc_nulls_first(), "by", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Prefixes()
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                made.turn(*row)
            if made.rows:
                yield made.taken_rows()
        made.end()
        if made.rows:
            yield made.taken_rows()

    return rows.select("family", "conv", "by", "said").mapInArrow(run, _TURN)


def _ends(turns: DataFrame) -> DataFrame:
    """(digest, ends) for every node at which a conversation ends: the hash of their ids. Ids of one block
    are written out and joined first, so a node that many end at is a row a block."""
    rows = (turns.where("last").groupBy("digest", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
            .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))
    rows = rows.repartition("digest").sortWithinPartitions("digest", "block").select("digest", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], ["digest", "ends"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends"])

    return rows.mapInArrow(run, "digest binary, ends string")


def accumulate(mine: pa.Table) -> pa.Table:
    """Totals of one shard's nodes (digest, parent, conv_id, depth, n_convs, bytes, children, leaves, saved, ends), the last
    four but one being what nodes outside the shard have already added."""
    keys = words(mine.column("digest").to_pylist())
    made, slots = assign(keys)
    n = len(keys)

    def flat(name: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[slots] = mine.column(name).to_numpy()
        return out

    by_slot = np.zeros((n, 4), "<u8")
    by_slot[slots] = keys
    above = np.full(n, -1, np.int64)  # the root's, and where the parent is outside
    parents = mine.column("parent").to_pylist()
    inner = np.array([i for i, p in enumerate(parents) if p is not None], np.int64)
    if len(inner):
        above[slots[inner]] = found(made, by_slot, words([parents[i] for i in inner]))
    conv, depth, members, size = (flat(c) for c in ("conv_id", "depth", "n_convs", "bytes"))
    children, leaves, saved = (flat(c) for c in ("children", "leaves", "saved"))
    has = above >= 0
    np.add.at(children, above[has], 1)
    leaves[children == 0] = 1
    saved += (members - 1) * size
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[has[level]]
        np.add.at(leaves, above[level], leaves[level])
        np.add.at(saved, above[level], saved[level])
    parent_conv = pa.array(np.where(has, conv[above], 0)[slots], mask=~has[slots])
    return pa.table(
        [mine.column("digest"), mine.column("parent"), mine.column("conv_id"), mine.column("depth"), parent_conv, mine.column("n_convs"),
         *[pa.array(c[slots]) for c in (children, leaves, saved)], mine.column("ends")],
        names=["digest", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


def trie(conversations: DataFrame, crown_members: int = CROWN_MEMBERS, nodes_per_shard: int = NODES_PER_SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    turns = stored(prefixes(conversations), "prefixes")
    nodes = stored(turns.groupBy("digest", "parent", "depth", "bytes").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("last").alias("ended")), "nodes")
    top = nodes.where("depth = 0").agg(F.max("n_convs")).first()[0] or 0
    limit = max(crown_members, top // CROWN)
    is_crown = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    tree = nodes.where("n_convs > 1").join(_ends(turns), "digest", "left").withColumn("ends", F.coalesce("ends", F.lit(_EMPTY))).drop("ended")
    tree = stored(tree, "tree")
    crown = tree.where(is_crown)
    sizes = tree.agg(F.count(F.when(is_crown, 1)).alias("crown"), F.count(F.lit(1)).alias("all")).first()
    small = (lambda df: F.broadcast(df)) if sizes["crown"] <= BROADCAST_CROWN else (lambda df: df)
    crown_names = crown.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv"))

    # chains: the first node of each has a parent in the tree, in the crown (by a broadcast, as many may) or below it
    chains = nodes.where("n_convs = 1").drop("n_convs", "bytes")
    below = tree.where(~is_crown)
    starts = (chains.join(small(crown_names), "parent").unionByName(
        chains.join(small(crown_names.select("parent")), "parent", "left_anti")
        .join(below.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv")), "parent", "left")))
    chains = stored(starts, "chains")
    tails = chains.select(
        "conv_id", "depth", F.coalesce("parent_conv", F.when(F.col("parent").isNotNull(), F.col("conv_id"))).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (1 - F.col("ended").cast("long")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("ended"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(_EMPTY).alias("ends_sha256"))
    started = chains.where("parent_conv is not null").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("started"))

    # the node at which a conversation leaves the crown names the subtree that holds the rest of it
    leaves_crown = (turns.join(small(crown_names.select("parent")), "parent", "left_semi")
                    .join(small(crown.select("digest")), "digest", "left_anti").select("conv_id", F.col("digest").alias("cut")))
    shards = max(1, -(-(sizes["all"] - sizes["crown"]) // nodes_per_shard))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ready = "digest", "parent", "conv_id", "depth", "n_convs", "bytes", "children", "leaves", "saved", "ends"
    dealt = (below.join(leaves_crown, "conv_id").join(started, "digest", "left")
             .select(F.pmod(F.xxhash64("cut"), F.lit(shards)).alias("shard"), "*", number(F.col("started")).alias("children"),
                     number(F.col("started")).alias("leaves"), F.lit(0).cast("long").alias("saved")))
    subtrees = stored(dealt.select("shard", *ready).groupBy("shard").applyInArrow(accumulate, _NODE), "subtrees")

    hung = (subtrees.where("parent_conv_id is null").groupBy(F.col("parent").alias("digest"))
            .agg(F.count(F.lit(1)).alias("h"), F.sum("n_leaves").alias("hung_leaves"), F.sum("saved_tokens").alias("hung_saved")))
    crowned = crown.join(started, "digest", "left").join(hung, "digest", "left").select(
        F.lit(0).alias("shard"), "*", (number(F.col("started")) + number(F.col("h"))).alias("children"),
        (number(F.col("started")) + number(F.col("hung_leaves"))).alias("leaves"), number(F.col("hung_saved")).alias("saved"))
    crowned = crowned.select("shard", *ready).groupBy("shard").applyInArrow(accumulate, _NODE)
    under = subtrees.join(small(crown_names), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_conv"))
    return crowned.select(*_COLUMNS).unionByName(under.select(*_COLUMNS)).unionByName(tails)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = """
with ids as (
  select distinct conv_id as c, xor(list_reduce(
    list_transform(string_split(conv_id::varchar, ''), lambda digit: ord(digit)::ubigint),
    lambda crc, octet: list_reduce(
      list_transform(range(0, 8), lambda bit: 0::ubigint), lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)),
      xor(crc, octet)),
    4294967295::ubigint), 4294967295::ubigint) % 9 as h
  from conversations where conv_id is not null),
turns as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as t,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null),
rebuilt as (
  select i.c, k, r, t from ids i join turns on turns.c = i.c - (i.c % 5 + 5) % 5 and k <= h
  union all
  select i.c, k, r, t from ids i join turns on turns.c = i.c and k > h),
paths as (
  select c, row_number() over w as d, strlen(t) as octets,
    sha256(string_agg(length(r) || ':' || r || length(t) || ':' || t, '') over w) as name
  from rebuilt window w as (partition by c order by k)
  union all
  select c, 0, 0, '' from ids),
marked as (select *, d = max(d) over (partition by c) as ended from paths),
nodes as (
  select d, name, min(c) as m, count(*) as n, max(octets) as octets,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ended), '')) as ends
  from marked group by d, name),
parents as (
  select x.d, x.name, p.d as pd, p.name as pname
  from nodes x join paths p on p.c = x.m and p.d = x.d - 1),
children as (select pd as d, pname as name, count(*) as n from parents group by 1, 2),
sums as (
  select a.d, a.name, sum((x.n - 1) * x.octets) as saved, count(*) filter (where k.n is null) as leaves
  from nodes x join paths a on a.c = x.m and a.d <= x.d left join children k on k.d = x.d and k.name = x.name
  group by 1, 2)
select x.m::bigint as conv_id, x.d::bigint as depth, pn.m::bigint as parent_conv_id, x.n::bigint as n_convs, coalesce(k.n, 0)::bigint as n_children,
  s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, x.ends as ends_sha256
from nodes x
join sums s on s.d = x.d and s.name = x.name
left join children k on k.d = x.d and k.name = x.name
left join parents p on p.d = x.d and p.name = x.name
left join nodes pn on pn.d = p.pd and pn.name = p.pname
"""
