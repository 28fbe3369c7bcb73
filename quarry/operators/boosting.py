"""Histogram gradient boosting (M2, M3) for squared loss.

Features become small integers once: a value's bin is the number of cut points below it, bin 0
holds missing values. A tree then grows from histograms. One job takes every row to its node and adds up gradient and
row count by (node, feature, bin), in each task first and then by a group-by of those sums; the driver picks
splits. A node's larger child is not counted: its histogram is its parent's less its sibling's.

Growth is best first: of all leaves the one whose split gains most is split, until ``max_leaves`` or ``max_depth`` is
reached or nothing gains. Without a limit of leaves that is the tree that level-wise growth gives. A job prepares all
leaves that may be next, so that a tree costs about as many jobs as it has levels, not one for each split.

Rows (label, prediction so far, bins) are kept in memory or on disk as blocks: one record holds the arrays of up to ``BLOCK`` rows,
so that a job costs what its numpy work costs, not a conversion of each row. A tree's first job adds the one before it to the
predictions, and every ``RENEW`` rounds the blocks are checkpointed. The driver holds the histograms of one tree: at most leaves x features x bins x
16 bytes (31 leaves, 100 features and 255 bins: 13 MB). Trees are a few arrays and are sent with the tasks.

Missing values take the side of a split that gains more. A row without a label is not used.

``fit_side_by_side`` fits several boosters at once, on parts of the same rows: each job counts for all of them, so that a search costs
about as many jobs as its longest fit. A block then holds each fit's predictions of its part of the rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Generator, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import c as col
from quarry.session import materialize

#: Rounds whose trees tasks add up before the predictions are written anew.
RENEW = 20
#: Rows of a block, at most (a task's Arrow batch makes at least one).
BLOCK = 1 << 16
#: Different values that a feature may have to be counted exactly, as a multiple of its bins (the count is a sketch's).
NEAR = 1.2


@dataclass
class Settings:
    """One booster's parameters; ``None`` leaves a limit out."""

    rounds: int = 100
    rate: float = 0.3
    max_depth: int | None = 6
    max_leaves: int | None = None
    l2: float = 1.0
    l1: float = 0.0
    min_gain: float = 0.0
    min_weight: float = 1.0  # hessian sum of a child; of squared loss its rows
    rows: float = 1.0  # share of rows drawn for each tree
    columns: float = 1.0  # share of features drawn for each tree
    bins: int = 255
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number; the root is 0, a leaf has left = -1. A row goes left if its value is at most
    ``cut`` (its bin at most ``at``), or is missing and ``missing_left``."""

    feature: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, cover: float, value: float) -> int:
        for name, v in (("feature", -1), ("at", -1), ("cut", 0.0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value),
                        ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.left) - 1

    def place(self, x: np.ndarray, raw: bool = True) -> np.ndarray:
        """The leaf of each row of ``x``: values (missing is NaN) or bins (missing is 0)."""
        feature, left, right = (np.array(v, np.int64) for v in (self.feature, self.left, self.right))
        cut, missing_left = np.array(self.cut if raw else self.at), np.array(self.missing_left, bool)
        node = np.zeros(len(x), np.int64)
        todo = [(0, slice(None))]  # nodes with their rows: each node's split is one comparison of one column
        while todo:
            of, rows = todo.pop()
            if left[of] < 0:
                node[rows] = of
                continue
            v = x[rows, feature[of]]
            goes_left = v <= cut[of]
            if raw or not missing_left[of]:  # a missing bin is 0, which is below every cut
                missing = np.isnan(v) if raw else v == 0
                goes_left = goes_left | missing if missing_left[of] else goes_left & ~missing
            if isinstance(rows, slice):
                rows = np.arange(len(x))
            for child, mine in ((left[of], rows[goes_left]), (right[of], rows[~goes_left])):
                if len(mine):
                    todo.append((child, mine))
        return node

    def predict(self, x: np.ndarray, raw: bool = True) -> np.ndarray:
        return np.array(self.value)[self.place(x, raw)]


# ---------------------------------------------------------------- bins

def feature_array(df: DataFrame, features: list[str]) -> Column:
    """The features of a row as an array of doubles, from their columns or from an assembled vector."""
    if all(f in df.columns for f in features):
        return F.array(*[col(f).cast("double") for f in features])
    return vector_to_array(F.col("features"))


def cut_points(rows: DataFrame, n_features: int, bins: int) -> list[list[float]]:
    """For each feature of ``rows`` (x: array of doubles) at most ``bins`` - 1 cut points: halfway between
    neighbouring values where these are few, else between neighbouring quantiles."""
    x = [F.nanvl(F.col("x")[i], F.lit(None).cast("double")) for i in range(n_features)]
    shares = [k / bins for k in range(bins + 1)]
    near = rows.agg(*[F.approx_count_distinct(v, 0.02).alias(f"f{i}") for i, v in enumerate(x)]).first()
    few = [i for i in range(n_features) if near[f"f{i}"] <= NEAR * bins]
    values: dict[int, list[float]] = {}
    if few:  # at most NEAR x bins values each, about
        pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x[i].alias("v")) for i in few])).alias("p")).select("p.*").where("v is not null").distinct()
        exact: dict[int, list[float]] = {i: [] for i in few}
        for r in pairs.collect():
            exact[r["i"]].append(r["v"])
        values.update({i: v for i, v in exact.items() if len(v) <= bins})
    many = [i for i in range(n_features) if i not in values]
    if many:
        found = rows.agg(*[F.percentile_approx(x[i], shares, 8 * bins).alias(f"f{i}") for i in many]).first()
        values.update({i: found[f"f{i}"] or [] for i in many})
    out = []
    for i in range(n_features):
        v = np.unique(np.array(values[i], np.float64))
        out.append((v[:-1] + (v[1:] - v[:-1]) / 2).tolist())
    return out


def _width(cuts: list[list[float]]) -> str:
    return "u1" if max(map(len, cuts), default=0) < 255 else "<u2"


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """1 + the number of cut points below each value; 0 where it is missing."""
    out = np.zeros(x.shape, _width(cuts))
    for i, c in enumerate(cuts):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, np.searchsorted(np.array(c), x[:, i], "left") + 1)
    return out


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """An Arrow array of equally long lists of doubles as rows (nulls as NaN)."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), n)


def with_bins(rows: DataFrame, cuts: list[list[float]], keep: list[str]) -> DataFrame:
    """``keep`` and ``bins`` (one number for each feature) of rows with ``x``, written once."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = binned(_matrix(batch.column(len(keep)), len(cuts)), cuts)
            ends = np.arange(len(made) + 1, dtype=np.int32) * (made.shape[1] * made.itemsize)
            cells = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(made))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], cells], [*keep, "bins"])

    return materialize(rows.select(*keep, "x").mapInArrow(run, f"{fields}, bins binary"))


def _with_features(df: DataFrame, features: list[str], label: str, keep: list[str] = ()) -> DataFrame:
    """(``keep``, label, x) of the rows that have a label."""
    return df.where(col(label).isNotNull()).select(*keep, col(label).cast("double").alias(label), feature_array(df, features).alias("x"))


def prepare(df: DataFrame, features: list[str], label: str, bins: int, keep: list[str] = ()) -> tuple[DataFrame, list[list[float]]]:
    """(``keep``, label, bins) of the rows that have a label, and the cut points."""
    rows = _with_features(df, features, label, keep)
    cuts = cut_points(rows, len(features), bins)
    return with_bins(rows, cuts, [*keep, label]), cuts


# ---------------------------------------------------------------- growth

def _score(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """The loss that a node's best value saves, twice."""
    t = np.sign(g) * np.maximum(np.abs(g) - s.l1, 0)
    return np.divide(t * t, h + s.l2, out=np.zeros_like(t), where=h + s.l2 > 0)


def leaf_value(g: float, h: float, s: Settings) -> float:
    return float(-np.sign(g) * max(abs(g) - s.l1, 0) / (h + s.l2)) if h + s.l2 > 0 else 0.0


def best_split(hist: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple | None:
    """(gain, feature, bin, missing goes left, left's gradient and rows) of the best split of a node with sums ``hist``
    (feature, bin, gradient and rows); of equal gains the first feature's and bin's."""
    g, h = hist[:, :, 0], hist[:, :, 1]
    total_g, total_h = g[0].sum(), h[0].sum()
    best = None
    for missing_left in (False, True):
        left_g, left_h = np.cumsum(g[:, 1:], axis=1), np.cumsum(h[:, 1:], axis=1)
        if missing_left:
            if not h[:, 0].any():
                continue
            left_g, left_h = left_g + g[:, :1], left_h + h[:, :1]
        right_h = total_h - left_h
        gain = _score(left_g, left_h, s) + _score(total_g - left_g, right_h, s) - _score(np.float64(total_g), np.float64(total_h), s)
        ok = (left_h >= max(s.min_weight, 1)) & (right_h >= max(s.min_weight, 1)) & allowed[:, None]
        gain = np.where(ok, gain, -np.inf)
        at = int(gain.argmax())
        f, b = divmod(at, gain.shape[1])
        if gain[f, b] > max(s.min_gain, 1e-12 * max(1.0, abs(total_g))) and (best is None or gain[f, b] > best[0]):
            best = (float(gain[f, b]), f, b + 1, missing_left, float(left_g[f, b]), float(left_h[f, b]))
    return best


def _drawn(rows: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Rows that a tree is grown from, by a hash of their numbers."""
    x = (rows.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


def _rows_of_bins(column: pa.Array, kind: str) -> np.ndarray:
    """A column of binary cells of one width as (row, feature)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


_BLOCKS = "y binary, pred binary, row binary, bins binary"


def blocks(rows: DataFrame, base: float, kind: str, n_features: int, numbered: bool, cuts: list[list[float]] | None = None) -> DataFrame:
    """Rows (y, row, and bins, or x where ``cuts`` are given) as blocks: each column's values side by side, predictions ``base``,
    bins by feature. Row numbers are kept only if ``numbered``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            y, row, bins = (np.concatenate([h[i] for h in held]) for i in range(3))
            cells = (y.tobytes(), np.full(len(y), base).tobytes(), row.tobytes() if numbered else b"", np.ascontiguousarray(bins.T).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["y", "pred", "row", "bins"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(2)
            if cuts is not None:
                bins = binned(_matrix(last, n_features), cuts)
            else:
                bins = _rows_of_bins(last, kind)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), bins))
            n += batch.num_rows
            if n >= BLOCK:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    return rows.select("y", "row", "bins" if cuts is None else "x").mapInArrow(run, _BLOCKS)


def _unpacked(batch: pa.RecordBatch, kind: str, n_features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(y, pred, row, bins) of each block of a batch; bins are (row, feature), stored by feature."""
    for y, pred, row, bins in zip(*batch.columns):
        bins = np.frombuffer(bins.as_buffer(), kind).reshape(n_features, -1).T
        row = np.frombuffer(row.as_buffer(), np.int64) if row.as_buffer().size else np.zeros(0, np.int64)
        yield np.frombuffer(y.as_buffer()), np.frombuffer(pred.as_buffer()), row, bins


def histograms(state: DataFrame, kind: str, n_features: int, width: int, tree: Tree, wanted: list[int], draw: tuple[float, int]) -> dict[int, np.ndarray]:
    """Sums (feature, bin, gradient and rows) of the ``wanted`` nodes of ``tree``, in one job."""
    slot = np.full(len(tree.left), -1, np.int64)
    slot[wanted] = np.arange(len(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for y, pred, row, bins in (block for batch in batches for block in _unpacked(batch, kind, n_features)):
            mine = slot[tree.place(bins, raw=False)]
            use = mine >= 0
            if draw[0] < 1:
                use &= _drawn(row, *draw)
            gradient, every = pred - y, use.all()
            if not every:
                use = np.flatnonzero(use)
                mine, gradient = mine[use], gradient[use]
            sums = np.zeros((len(wanted), n_features, width, 2)) if sums is None else sums
            _add(sums, mine, gradient, bins if every else bins[use])
        if sums is not None:
            yield from _cells(sums, 0)

    cells = state.mapInArrow(count, _CELLS).groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
    if not cells.num_rows:
        return {}
    flat = np.zeros((len(wanted) * n_features * width, 2))
    flat[cells.column("cell").to_numpy()] = np.column_stack([cells.column("g").to_numpy(), cells.column("n").to_numpy()])
    return dict(zip(wanted, flat.reshape(len(wanted), n_features, width, 2)))


_CELLS = "cell long, g double, n long"


def _add(sums: np.ndarray, mine: np.ndarray, gradient: np.ndarray, bins: np.ndarray) -> None:
    """Add rows, their node's place in ``sums`` being ``mine``."""
    nodes, n_features, width, _ = sums.shape
    mine = mine * width
    for f in range(n_features):
        key = mine + bins[:, f]
        sums[:, f, :, 0] += np.bincount(key, gradient, nodes * width).reshape(-1, width)
        sums[:, f, :, 1] += np.bincount(key, minlength=nodes * width).reshape(-1, width)


def _cells(sums: np.ndarray, start: int) -> Iterator[pa.RecordBatch]:
    """The cells that have rows, numbered from ``start``."""
    at = np.flatnonzero(sums[..., 1])
    if len(at):
        g, n = sums[..., 0].ravel()[at], sums[..., 1].ravel()[at].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at + start), pa.array(g), pa.array(n)], ["cell", "g", "n"])


def grow(count, cuts: list[list[float]], s: Settings, allowed: np.ndarray) -> Tree | None:
    """One tree; ``count(tree, nodes)`` gives the histograms of nodes. None where there are no rows."""
    steps = growth(cuts, s, allowed)
    try:
        asked = next(steps)
        while True:
            asked = steps.send(count(*asked))
    except StopIteration as end:
        return end.value


def growth(cuts: list[list[float]], s: Settings, allowed: np.ndarray) -> Generator[tuple[Tree, list[int]], dict[int, np.ndarray], Tree | None]:
    """The steps of ``grow``: yields (tree, nodes) and is sent the histograms of these nodes."""
    tree = Tree()
    tree.add(0.0, 0.0)
    first = yield tree, [0]
    if not first:
        return None
    hist, depth, split, ready, heap = {0: first[0]}, {0: 0}, {}, set(), []

    def open_(node: int, g: float, h: float) -> None:
        tree.cover[node], tree.value[node] = h, s.rate * leaf_value(g, h, s)
        split[node] = best_split(hist[node], allowed, s) if node in hist and (s.max_depth is None or depth[node] < s.max_depth) else None
        if split[node]:
            heapq.heappush(heap, (-split[node][0], node))

    def children(nodes: list[int], last: bool = False) -> Generator[tuple[Tree, list[int]], dict[int, np.ndarray], None]:
        """Add both children of each node, with the histograms of those that may be split; they become part of the tree when the node is split."""
        small, made = [], {}
        for node in nodes:
            gain, f, b, missing_left, left_g, left_h = split[node]
            total = hist[node][0].sum(axis=0)
            kids = [tree.add(0.0, 0.0), tree.add(0.0, 0.0)]
            tree.feature[node], tree.at[node], tree.cut[node], tree.missing_left[node] = f, b, cuts[f][b - 1] if b <= len(cuts[f]) else float("inf"), missing_left
            tree.left[node], tree.right[node], tree.gain[node] = *kids, gain
            sums = ((left_g, left_h), (total[0] - left_g, total[1] - left_h))
            less = int(sums[1][1] < sums[0][1])
            if not last and (s.max_depth is None or depth[node] + 1 < s.max_depth):
                small.append(kids[less])
            made[node] = (kids, sums, less)
        got = (yield tree, small) if small else {}
        for node, (kids, sums, less) in made.items():
            if kids[less] in got:
                hist[kids[less]] = got[kids[less]]
                hist[kids[1 - less]] = hist[node] - got[kids[less]]
            for kid, (g, h) in zip(kids, sums):
                depth[kid] = depth[node] + 1
                waiting[kid] = (g, h)
            ready.add(node)

    waiting: dict[int, tuple[float, float]] = {}
    open_(0, *hist[0][0].sum(axis=0))

    def part(node: int) -> None:
        for kid in (tree.left[node], tree.right[node]):
            open_(kid, *waiting.pop(kid))
        del hist[node]

    while heap and s.max_leaves is None:  # the order of splits makes no difference: level by level
        level = sorted(node for _, node in heap)
        heap.clear()
        yield from children(level)
        for node in level:
            part(node)
    leaves = 1
    while heap and leaves < s.max_leaves:
        if heap[0][1] not in ready:
            spare = s.max_leaves - leaves
            yield from children([node for _, node in heapq.nsmallest(spare, heap) if node not in ready], last=spare == 1)
        leaves += 1
        part(heapq.heappop(heap)[1])
    for _, node in heap:  # prepared, but not split
        tree.left[node] = tree.right[node] = tree.feature[node] = -1
        tree.gain[node] = 0.0
    return _compact(tree)


def _compact(tree: Tree) -> Tree:
    """The nodes that the root reaches, renumbered."""
    out, todo = Tree(), [(0, -1, "")]
    while todo:
        node, parent, side = todo.pop(0)
        new = out.add(tree.cover[node], tree.value[node])
        for name in ("feature", "at", "cut", "missing_left", "gain"):
            getattr(out, name)[new] = getattr(tree, name)[node]
        if parent >= 0:
            getattr(out, side)[parent] = new
        if tree.left[node] >= 0:
            todo += [(tree.left[node], new, "left"), (tree.right[node], new, "right")]
    return out


# ---------------------------------------------------------------- the model

@dataclass
class BoostedModel:
    """Trees over raw feature values; ``transform`` adds ``prediction``."""

    features: list[str]
    base: float
    trees: list[Tree]
    settings: Settings = field(default_factory=Settings)

    def predict_rows(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def transform(self, df: DataFrame) -> DataFrame:
        n, predict = len(self.features), self.predict_rows
        if n and all(f in df.columns for f in self.features):
            @F.pandas_udf("double")
            def of_columns(*x: pd.Series) -> pd.Series:
                return pd.Series(predict(np.column_stack([v.to_numpy(np.float64, na_value=np.nan) for v in x])))

            return df.withColumn("prediction", of_columns(*[col(f).cast("double") for f in self.features]))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(predict(np.stack(x.to_list()).astype(np.float64) if len(x) else np.zeros((0, n))))

        return df.withColumn("prediction", score(feature_array(df, self.features)))

    def gains(self) -> list[float]:
        """Each feature's share of the gain of all splits."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            split = np.array(t.left) >= 0
            np.add.at(total, np.array(t.feature, np.int64)[split], np.array(t.gain)[split])
        return (total / total.sum() if total.sum() else total).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, json.dumps(asdict(t))) for k, t in enumerate(self.trees)]
        meta = json.dumps({"features": self.features, "base": self.base, "settings": asdict(self.settings)})
        spark.createDataFrame([(-1, meta), *rows], "tree int, content string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        rows = {r["tree"]: json.loads(r["content"]) for r in spark.read.parquet(path).collect()}  # a row a tree
        meta = rows.pop(-1)
        return cls(meta["features"], meta["base"], [Tree(**rows[k]) for k in sorted(rows)], Settings(**meta["settings"]))


def _allowed(s: Settings, k: int, n_features: int) -> np.ndarray:
    """The features that tree ``k`` may split."""
    allowed = np.ones(n_features, bool)
    if s.columns < 1:
        allowed[:] = False
        allowed[np.random.default_rng([s.seed, k]).choice(n_features, max(1, round(s.columns * n_features)), replace=False)] = True
    return allowed


def fit(train: DataFrame, features: list[str], label: str, settings: Settings, cuts: list[list[float]] | None = None) -> BoostedModel:
    """Fit on rows with the features, or with ``bins`` that ``prepare`` made with ``cuts``."""
    s, made = settings, cuts is not None
    if not made:
        train = _with_features(train, features, label)
        cuts = cut_points(train, len(features), s.bins)
    kind, width = _width(cuts), max(map(len, cuts), default=0) + 2
    base = train.agg(F.avg(col(label))).first()[0]
    if base is None:
        raise ValueError("no row has a label")
    rows = train.select(col(label).alias("y"), F.monotonically_increasing_id().alias("row"), "bins" if made else "x")
    state = blocks(rows, float(base), kind, len(features), s.rows < 1, None if made else cuts)
    if s.rows < 1:  # row numbers must not change with the next reading
        state = materialize(state)
    state = state.persist(StorageLevel.MEMORY_AND_DISK)  # read once a level of each tree
    old, trees = None, []
    for k in range(s.rounds):
        allowed = _allowed(s, k, len(features))
        tree = grow(lambda t, nodes: histograms(state, kind, len(features), width, t, nodes, (s.rows, s.seed * 100_003 + k)), cuts, s, allowed)  # noqa: B023
        if old is not None:  # the new rows are there
            old.unpersist()
        if tree is None:
            break
        trees.append(tree)
        if tree.left[0] < 0 and s.rows >= 1 and s.columns >= 1:  # nothing gains any more
            break
        if k + 1 < s.rounds:
            old, state = state, _renewed(state, kind, len(features), tree)
            state = (materialize(state) if len(trees) % RENEW == 0 else state).persist(StorageLevel.MEMORY_AND_DISK)
    state.unpersist()
    return BoostedModel(list(features), float(base), trees, s)


def _renewed(state: DataFrame, kind: str, n_features: int, tree: Tree) -> DataFrame:
    """The blocks with a tree's values added to their predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [(pred + tree.predict(bins, raw=False)).tobytes() for _, pred, _, bins in _unpacked(batch, kind, n_features)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.binary()), batch.column(2), batch.column(3)], batch.schema.names)

    return state.mapInArrow(run, _BLOCKS)


# ---------------------------------------------------------------- several fits at once

#: Fits that run side by side, at most (a row has a prediction of 8 bytes for each), and what their histograms may take in a task.
AT_ONCE, HISTOGRAM_BYTES = 12, 64 << 20


@dataclass
class Part:
    """A part of rows, told from one of their columns: as a condition, and for an array of its values (null is NaN)."""

    condition: Column
    holds: Callable[[np.ndarray], np.ndarray]


def at_once(settings: list[Settings], cuts: list[list[float]]) -> int:
    """How many of such fits to run side by side."""
    nodes = max((1 << min(s.max_depth - 1, 16) if s.max_leaves is None and s.max_depth else s.max_leaves or 1 << 16 for s in settings), default=1)
    each = nodes * len(cuts) * (max(map(len, cuts), default=0) + 2) * 16
    return max(1, min(AT_ONCE, HISTOGRAM_BYTES // max(1, each)))


def fit_side_by_side(rows: DataFrame, features: list[str], label: str, place: str, jobs: list[tuple[Settings, Part]],
                     cuts: list[list[float]]) -> list[BoostedModel | Exception]:
    """Each job's model, fitted on its part of the rows that ``prepare`` made with ``cuts`` (every row of the part: shares of rows are for ``fit``);
    ``place`` is the column that parts are told from. Where a part has no rows, the exception that ``fit`` would raise."""
    kind, n, width = _width(cuts), len(features), max(map(len, cuts), default=0) + 2
    found = rows.agg(*[F.avg(F.when(part.condition, col(label))).alias(f"b{j}") for j, (_, part) in enumerate(jobs)]).first()
    out: list[BoostedModel | Exception] = [
        ValueError("no row has a label") if found[j] is None else BoostedModel(list(features), float(found[j]), [], s) for j, (s, _) in enumerate(jobs)]
    parts = {j: part.holds for j, (_, part) in enumerate(jobs)}
    held = [j for j, m in enumerate(out) if isinstance(m, BoostedModel) and m.settings.rounds > 0]
    if not held:
        return out
    state = _shared_blocks(rows.select(col(label).alias("y"), col(place).cast("double").alias("place"), "bins"), {j: out[j].base for j in held}, parts, kind)
    state, old = state.persist(StorageLevel.MEMORY_AND_DISK), None
    for k in range(max(out[j].settings.rounds for j in held)):
        steps = {j: growth(cuts, out[j].settings, _allowed(out[j].settings, k, n)) for j in held}
        asked, made = {j: next(g) for j, g in steps.items()}, {}
        while asked:
            got, more = _shared_histograms(state, held, parts, asked, kind, n, width), {}
            for j in asked:
                try:
                    more[j] = steps[j].send(got[j])
                except StopIteration as end:
                    made[j] = end.value
            asked = more
            if old is not None:  # the new rows are there
                old.unpersist()
                old = None
        for j, tree in made.items():
            out[j].trees += [tree] if tree is not None else []
        going = [j for j in held if made[j] is not None and (made[j].left[0] >= 0 or out[j].settings.columns < 1) and k + 1 < out[j].settings.rounds]
        if not going:
            break
        old, state = state, _shared_renewed(state, held, parts, {j: made[j] for j in going}, kind, n)
        state = (materialize(state) if (k + 1) % RENEW == 0 else state).persist(StorageLevel.MEMORY_AND_DISK)
        held = going
    state.unpersist()
    return out


_SHARED = "y binary, place binary, pred binary, bins binary"


def _shared_blocks(rows: DataFrame, bases: dict[int, float], parts: dict[int, Callable], kind: str) -> DataFrame:
    """Rows (y, place, bins) as blocks for several fits: ``pred`` holds the predictions of each fit's part, one fit after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            y, place, bins = (np.concatenate([h[i] for h in held]) for i in range(3))
            pred = b"".join(np.full(int(parts[j](place).sum()), base).tobytes() for j, base in bases.items())
            cells = (y.tobytes(), place.tobytes(), pred, np.ascontiguousarray(bins.T).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["y", "place", "pred", "bins"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), place, _rows_of_bins(batch.column(2), kind)))
            n += batch.num_rows
            if n >= BLOCK:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    return rows.select("y", "place", "bins").mapInArrow(run, _SHARED)


def _shared_unpacked(batch: pa.RecordBatch, held: list[int], parts: dict[int, Callable], kind: str, n_features: int, wanted) -> Iterator[dict[int, tuple]]:
    """{fit: (y, pred, bins) of its part} of each block, for the ``wanted`` fits that have rows in it."""
    for y, place, pred, bins in zip(*batch.columns):
        y, place, pred = (np.frombuffer(v.as_buffer()) for v in (y, place, pred))
        bins, at, out = np.frombuffer(bins.as_buffer(), kind).reshape(n_features, -1), 0, {}
        for j in held:
            mine = parts[j](place)
            m = int(mine.sum())
            if m and j in wanted:
                out[j] = (y, pred[at : at + m], bins.T) if m == len(y) else (y[mine], pred[at : at + m], bins[:, mine].T)
            at += m
        yield out


def _shared_histograms(state: DataFrame, held: list[int], parts: dict[int, Callable], asked: dict[int, tuple[Tree, list[int]]], kind: str, n_features: int,
                       width: int) -> dict[int, dict[int, np.ndarray]]:
    """What ``histograms`` gives, for the tree and nodes that each fit asks for, in one job."""
    slots, starts, size = {}, {}, 0
    for j, (tree, nodes) in asked.items():
        slots[j] = np.full(len(tree.left), -1, np.int64)
        slots[j][nodes] = np.arange(len(nodes))
        starts[j], size = size, size + len(nodes) * n_features * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for block in (block for batch in batches for block in _shared_unpacked(batch, held, parts, kind, n_features, asked)):
            for j, (y, pred, bins) in block.items():
                tree, nodes = asked[j]
                mine, gradient = slots[j][tree.place(bins, raw=False)], pred - y
                use = mine >= 0
                if not use.all():
                    mine, gradient, bins = mine[use], gradient[use], bins.T[:, use].T
                if j not in sums:
                    sums[j] = np.zeros((len(nodes), n_features, width, 2))
                _add(sums[j], mine, gradient, bins)
        for j, found in sums.items():
            yield from _cells(found, starts[j])

    cells = state.mapInArrow(count, _CELLS).groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
    flat = np.zeros((size, 2))
    if cells.num_rows:
        flat[cells.column("cell").to_numpy()] = np.column_stack([cells.column("g").to_numpy(), cells.column("n").to_numpy()])
    out = {}
    for j, (_, nodes) in asked.items():
        mine = flat[starts[j] : starts[j] + len(nodes) * n_features * width].reshape(len(nodes), n_features, width, 2)
        out[j] = dict(zip(nodes, mine)) if mine[..., 1].any() else {}
    return out


def _shared_renewed(state: DataFrame, held: list[int], parts: dict[int, Callable], trees: dict[int, Tree], kind: str, n_features: int) -> DataFrame:
    """The blocks with each tree's values added to its fit's predictions; fits without a tree have ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [b"".join((block[j][1] + t.predict(block[j][2], raw=False)).tobytes() for j, t in trees.items() if j in block)
                   for block in _shared_unpacked(batch, held, parts, kind, n_features, trees)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.binary()), batch.column(3)], batch.schema.names)

    return state.mapInArrow(run, _SHARED)


def predicted(rows: DataFrame, label: str, place: str, models: list[list[BoostedModel | None]], parts: list[Part], cuts: list[list[float]]) -> DataFrame:
    """(part, y, p0, p1, ...): the rows of each part (a row of several parts comes several times) with what its models, ``models[part]``, predict;
    without a model null. ``rows`` are those that ``prepare`` made with ``cuts``."""
    kind, several, wide = _width(cuts), [p.holds for p in parts], max(map(len, models))
    names = ["part", "y", *[f"p{i}" for i in range(wide)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, place = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for i in range(2))
            bins = np.asfortranarray(_rows_of_bins(batch.column(2), kind))
            for k, holds in enumerate(several):
                mine = holds(place)
                m = int(mine.sum())
                if m:
                    x = bins if m == len(y) else bins.T[:, mine].T
                    values = [pa.nulls(m, pa.float64()) if model is None else pa.array(model.base + sum((t.predict(x, raw=False) for t in model.trees), np.zeros(m)))
                              for model in models[k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, k, np.int32)), pa.array(y[mine]), *values], names)

    chosen = rows.select(col(label).alias("y"), col(place).cast("double").alias("place"), "bins")
    return chosen.mapInArrow(run, "part int, y double, " + ", ".join(f"p{i} double" for i in range(wide)))
