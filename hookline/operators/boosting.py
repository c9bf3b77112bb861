"""Boosted trees of second order for labels 0 and 1: splits by gradient and Hessian sums, with an L2 term on the leaves.

Features are binned once and written. A tree draws its rows and columns once and keeps them, with their gradients, for its
levels. A level is one aggregate over the bins: every task sums the gradients and Hessians of its rows by (feature, node,
bin), the sums of some features meet in one task, which finds the best cut of each node, and one line for each node comes
back to the driver from each of these tasks. No row leaves its task.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, scratch_path, shared_dir

_BLOCK = 1 << 16  # rows that a task holds at once
_TASK = 1 << 26  # cells, of which four times as many are one task's work
_FEW = 1 << 11  # rows so few that the sums of all features are taken at once
_UNIT = float(1 << 24)  # gradients are summed as whole multiples of 2^-24, so sums do not depend on their order
_ADVANCE = 25  # trees after which margins are written anew; ten times as many where one task grows them
_LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boosting:
    """Settings. ``rows`` and ``columns`` are the shares drawn for each tree, ``child_weight`` the least Hessian of a child."""

    trees: int = 500
    depth: int = 8
    step: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    child_weight: float = 1.0
    bins: int = 256
    seed: int = 42


@dataclass
class Tree:
    """Nodes in order of their making, children after parents. ``feature`` is -1 in leaves; a row with a bin of at most
    ``cut`` goes to ``low``. ``value`` is a leaf's share of the margin, ``gain`` what a split gained."""

    feature: list[int]
    cut: list[int]
    low: list[int]
    value: list[float]
    gain: list[float]

    @classmethod
    def root(cls) -> "Tree":
        return cls([-1], [0], [0], [0.0], [0.0])

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row of ``bins`` ends. The high child follows the low one."""
        feature, cut, low = (np.array(x) for x in (self.feature, self.cut, self.low))
        node = np.zeros(len(bins), np.int64)
        going = np.arange(len(bins)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(going):
            at = node[going]
            node[going] = low[at] + (bins[going, feature[at]] > cut[at])
            going = going[feature[node[going]] >= 0]
        return node


def _blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of up to 65,536 rows, with the cells of their first column."""
    for batch in batches:
        for begin in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(begin, _BLOCK)
            yield part, part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def feature_cuts(df: DataFrame, features: str, width: int, bins: int) -> list[np.ndarray]:
    """For each feature the ascending values at which it is cut: its quantiles, ``bins`` - 1 at most.

    A task sorts some 65,536 rows at a time by each feature and hands on the middle of each run of k, with k so small that
    ranks are off by 1 / (100 ``bins``) of the rows at most, and not at all where there are few; what is handed on of one
    feature meets in one task.
    """

    def runs(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(held).T
        kept, lengths = [], []
        for own in cells:
            own = np.sort(own[~np.isnan(own)])
            k = max(1, 2 * len(own) // (100 * bins))
            starts = np.arange(0, len(own), k)
            length = np.diff(starts, append=len(own))
            kept.append(own[starts + (length - 1) // 2].tobytes())
            lengths.append(length.astype(np.int32).tobytes())
        columns = [pa.array(np.arange(width), pa.int32()), pa.array(kept, pa.binary()), pa.array(lengths, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["feature", "kept", "lengths"])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, cells in _blocks_of(batches, width):
            held.append(cells)
            n += len(cells)
            if n >= _BLOCK:
                yield runs(held)
                held, n = [], 0
        if n:
            yield runs(held)

    def quantiles(table: pa.Table) -> pa.Table:
        kept, lengths = (np.concatenate([np.frombuffer(v.as_py(), t) for v in table.column(c)]) for c, t in (("kept", float), ("lengths", np.int32)))
        order = np.argsort(kept, kind="stable")
        ranks = lengths[order].cumsum()
        wanted = np.ceil(np.arange(1, bins) / bins * ranks[-1]) if len(ranks) else []
        cuts = np.unique(kept[order][np.searchsorted(ranks, wanted)]) if len(ranks) else kept
        return pa.table({"feature": table.column("feature")[:1], "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    rows = df.select(F.col(features).cast("array<double>"))
    parts = rows.mapInArrow(summaries, "feature int, kept binary, lengths binary")
    found = {r["feature"]: r["cuts"] for r in parts.groupBy("feature").applyInArrow(quantiles, "feature int, cuts array<double>").collect()}
    return [np.array(found.get(j, []), float) for j in range(width)]


def _binned(df: DataFrame, features: str, label: str, cuts: list[np.ndarray], scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Written table of blocks (n, bins, labels, places): the bins of up to 65,536 rows as bytes, a row after the other; the
    number of rows; and that of the tasks that grow trees: one up to 256 million cells, beyond that one for 16 million, or for
    more where there are too few cores for that. Sums of all tasks meet at each level, so what is moved hangs on the cores and
    not on the rows."""

    def block(held: list[tuple]) -> pa.RecordBatch:
        bins, labels, places = (np.concatenate(x) for x in zip(*held))
        columns = [pa.array([len(bins)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (bins, labels, places))]
        return pa.RecordBatch.from_arrays(columns, names=["n", "bins", "labels", "places"])

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for part, cells in _blocks_of(batches, len(cuts)):
            if n + part.num_rows > _BLOCK and held:
                yield block(held)
                held, n = [], 0
            bins = np.stack([np.searchsorted(c, cells[:, j]) for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
            held.append((bins, part.column(1).to_numpy().astype(np.int8), part.column(2).to_numpy().astype(np.int64)))
            n += part.num_rows
        if held:
            yield block(held)

    n = df.count()
    cells = n * len(cuts)
    tasks = 1 if cells <= 4 * _TASK else min(-(-cells // max(1, _TASK // 4)), df.sparkSession.sparkContext.defaultParallelism)
    rows = df.select(features, F.col(label).cast("int"), F.monotonically_increasing_id().alias("place"))
    if tasks > 1:
        rows = rows.repartitionById(tasks, F.pmod(F.xxhash64("place"), F.lit(tasks)).cast("int"))
    return scratch.table(rows.mapInArrow(run, "n int, bins binary, labels binary, places binary")), n, tasks


def _drawn(places: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree sees, by a hash of the row's place and the tree."""
    if share >= 1:
        return np.ones(len(places), bool)
    with np.errstate(over="ignore"):
        h = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xD1B54A32D192ED03 + seed) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _margins(bins: np.ndarray, margins: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    for tree in trees:
        margins = margins + np.array(tree.value)[tree.leaves(bins)]
    return margins


def best_cuts(sums: np.ndarray, l2: float, child_weight: float) -> tuple[np.ndarray, ...]:
    """``best_cut`` of many (…, 2, bins) at once: an array for each number."""
    running = sums.cumsum(axis=-1) / _UNIT
    g, h = running[..., 0, :], running[..., 1, :]
    all_g, all_h = g[..., -1:], h[..., -1:]
    right_g, right_h = all_g - g, all_h - h
    fair = (h >= child_weight) & (right_h >= child_weight)
    gains = np.where(fair, g * g / (h + l2) + right_g * right_g / (right_h + l2) - all_g * all_g / (all_h + l2), -1.0)
    at = gains.argmax(axis=-1)[..., None]
    gain, low_g, low_h = (np.take_along_axis(x, at, -1)[..., 0] for x in (gains, g, h))
    return gain, at[..., 0], low_g, low_h, all_g[..., 0], all_h[..., 0]


def best_cut(sums: np.ndarray, l2: float, child_weight: float) -> tuple[float, int, float, float, float, float]:
    """(gain, cut, gradient and Hessian at or below it, gradient and Hessian in all) of the sums (2, bins) of a node; the
    first of equal cuts, gain -1 if none leaves ``child_weight`` on both sides."""
    gain, at, *rest = best_cuts(sums, l2, child_weight)
    return (float(gain), int(at), *(float(x) for x in rest))


def _drawn_blocks(blocks: RDD, trees: list[Tree], number: int, columns: np.ndarray, s: Boosting) -> RDD:
    """What a tree sees, once for all its levels: (bins of the drawn columns, a column after the other, gradients, Hessians)
    of the drawn rows."""

    def draw(block: tuple) -> tuple:
        bins, labels, places, margins = block
        use = np.nonzero(_drawn(places, number, s.rows, s.seed))[0]
        bins = bins[use]
        p = 1.0 / (1.0 + np.exp(-_margins(bins, margins[use], trees)))
        g, h = np.rint((p - labels[use]) * _UNIT).astype(np.int32), np.rint(p * (1 - p) * _UNIT).astype(np.int32)
        return np.ascontiguousarray(bins[:, columns].T), g, h

    return blocks.map(draw).persist(StorageLevel.MEMORY_AND_DISK)


def _level(drawn: RDD, tree: Tree, nodes: list[int], columns: np.ndarray, s: Boosting, parts: int) -> dict:
    """Node to the (gain, feature, cut, …) of its best split; the smallest feature of equal ones."""
    position = {int(j): i for i, j in enumerate(columns)}
    own = Tree([position.get(f, -1) for f in tree.feature], tree.cut, tree.low, tree.value, tree.gain)
    groups = np.array_split(np.arange(len(columns)), min(parts, len(columns)))  # columns whose sums meet in one task

    def sums(held: Iterator[tuple]):
        total: np.ndarray | None = None
        place = np.full(len(own.feature), -1)
        place[nodes] = np.arange(len(nodes))
        for bins, g, h in held:
            node = place[own.leaves(bins.T)]
            use = np.nonzero(node >= 0)[0]
            if not len(use):
                continue
            if total is None:
                total = np.zeros((len(columns), len(nodes), 2, 256), np.int64)
            base, weights = node[use] * 256, (g[use].astype(np.float64), h[use].astype(np.float64))
            for j in range(len(columns)):
                cell = base + bins[j][use]
                for k, w in enumerate(weights):
                    total[j, :, k] += np.bincount(cell, w, 256 * len(nodes)).astype(np.int64).reshape(-1, 256)
        if total is not None:
            for i, group in enumerate(groups):
                yield i, _packed(total[group])

    def best(item: tuple):
        i, packed = item
        gain, *rest = best_cuts(_unpacked(packed), s.l2, s.child_weight)
        first = gain.argmax(axis=0)  # the first of equal columns
        for k in range(len(nodes)):
            yield k, (float(gain[first[k], k]), int(columns[groups[i][first[k]]]), int(rest[0][first[k], k]), *(float(x[first[k], k]) for x in rest[1:]))

    added = drawn.mapPartitions(sums)
    if drawn.getNumPartitions() > 1:  # the sums of a single task are whole
        added = added.reduceByKey(lambda a, b: _packed(_unpacked(a) + _unpacked(b)), len(groups))
    found: dict[int, tuple] = {}
    for k, split in added.flatMap(best).collect():
        held = found.get(nodes[k])
        if held is None or (split[0], -split[1]) > (held[0], -held[1]):
            found[nodes[k]] = split
    return found


def _packed(sums: np.ndarray) -> tuple:
    """Sums without their zeros where most are zero, as they are in nodes of few rows."""
    flat = sums.reshape(-1)
    at = np.flatnonzero(flat)
    return (sums.shape, at.astype(np.int32), flat[at]) if 2 * len(at) < len(flat) else (sums.shape, None, flat)


def _unpacked(packed: tuple) -> np.ndarray:
    shape, at, values = packed
    if at is None:
        return values.reshape(shape)
    flat = np.zeros(math.prod(shape), np.int64)
    flat[at] = values
    return flat.reshape(shape)


def _tree(splits_of: Callable[[Tree, list[int]], dict], s: Boosting) -> Tree:
    """A tree from the best splits of the nodes of each level."""
    tree, nodes = Tree.root(), [0]
    for level in range(s.depth):
        splits = splits_of(tree, nodes)
        nodes_after: list[int] = []
        for node in nodes:
            if node not in splits:
                continue
            gain, feature, cut, g, h, all_g, all_h = splits[node]
            if level == 0:
                tree.value[0] = -s.step * all_g / (all_h + s.l2)
            if gain <= _LEAST_GAIN:
                continue
            low = len(tree.feature)
            tree.feature[node], tree.cut[node], tree.low[node], tree.gain[node], tree.value[node] = feature, cut, low, gain, 0.0
            for own_g, own_h in ((g, h), (all_g - g, all_h - h)):
                tree.feature.append(-1)
                tree.cut.append(0)
                tree.low.append(0)
                tree.gain.append(0.0)
                tree.value.append(-s.step * own_g / (own_h + s.l2))
                if own_h >= 2 * s.child_weight:  # with less no cut leaves the least weight on both sides
                    nodes_after.append(len(tree.feature) - 1)
        nodes = nodes_after
        if not nodes:
            break
    return tree


def _trees_of_one_task(held: Iterator[tuple], n: int, width: int, first: int, drawn_columns: list[np.ndarray], s: Boosting) -> Iterator[Tree]:
    """The next trees where all ``n`` rows are in this task. Of two children the sums of the smaller are taken, the other's are
    what is left of the parent's; they are whole numbers, so this is exact. Features that never vary are passed over, and
    rows too light for two children are not summed by feature."""
    turned, labels, places, margins = np.empty((width, n), np.uint8), np.empty(n, np.int8), np.empty(n, np.int64), np.empty(n)
    filled = 0
    for bins, *own in held:  # block by block, so the bins are here once
        some = slice(filled, filled + len(bins))
        turned[:, some] = bins.T
        for whole, part in zip((labels, places, margins), own):
            whole[some] = part
        filled += len(bins)
    if not filled:
        return
    varies, places_of = turned.min(axis=1) < turned.max(axis=1), 256 * np.arange(width)[:, None]
    for number, columns in enumerate(drawn_columns, first):
        columns = columns[varies[columns]] if varies[columns].any() else columns[:1]
        drawn = _drawn(places, number, s.rows, s.seed)
        use = np.flatnonzero(drawn)
        p = 1.0 / (1.0 + np.exp(-margins[use]))
        g, h = np.zeros(n), np.zeros(n)
        g[use], h[use] = np.rint((p - labels[use]) * _UNIT), np.rint(p * (1 - p) * _UNIT)
        rows, sums = {0: np.arange(n)}, {}  # rows of the leaves so far, drawn or not

        def summed(own: np.ndarray) -> np.ndarray:
            out, weights = np.empty((len(columns), 2, 256), np.int64), (g, h) if len(own) == n else (g[own], h[own])
            if len(own) <= _FEW:
                cells = (turned[columns[:, None], own] + places_of[: len(columns)]).ravel()
                for k, w in enumerate(weights):
                    out[:, k] = np.bincount(cells, np.tile(w, len(columns)), 256 * len(columns)).reshape(-1, 256)
                return out
            for j, column in enumerate(columns):
                cell = (turned[column] if len(own) == n else turned[column][own]).astype(np.intp)
                for k, w in enumerate(weights):
                    out[j, k] = np.bincount(cell, w, 256)
            return out

        def parted(tree: Tree, parent: int) -> None:
            own, low = rows.pop(parent), tree.low[parent]
            over = turned[tree.feature[parent]][own] > tree.cut[parent]
            rows[low], rows[low + 1] = own[~over], own[over]

        def splits_of(tree: Tree, nodes: list[int]) -> dict:
            if nodes == [0]:
                if not len(use):
                    return {}
                all_g, all_h = float(g.sum()) / _UNIT, float(h.sum()) / _UNIT
                if all_h < 2 * s.child_weight:  # no cut leaves the least weight on both sides
                    return {0: (-1.0, 0, 0, 0.0, 0.0, all_g, all_h)}
                sums[0] = summed(use)
            else:
                alive = set(nodes)
                for parent in list(sums):
                    whole, low = sums.pop(parent), tree.low[parent]
                    if tree.feature[parent] < 0 or not alive & {low, low + 1}:
                        continue
                    parted(tree, parent)
                    small = low if len(rows[low]) <= len(rows[low + 1]) else low + 1
                    own = rows[small]
                    sums[small] = summed(own[drawn[own]])
                    sums[2 * low + 1 - small] = whole - sums[small]
                for node in set(sums) - alive:
                    del sums[node]
            found = {}
            for node in nodes:
                gain, *rest = best_cuts(sums[node], s.l2, s.child_weight)
                k = int(gain.argmax())  # the first of equal columns
                found[node] = (float(gain[k]), int(columns[k]), int(rest[0][k]), *(float(x[k]) for x in rest[1:]))
            return found

        tree = _tree(splits_of, s)
        for node, feature in enumerate(tree.feature):  # parents come before their children
            if feature >= 0 and node in rows:
                parted(tree, node)
        for node, own in rows.items():
            margins[own] += tree.value[node]
        yield tree


def grow(df: DataFrame, features: str, label: str, cuts: list[np.ndarray], settings: Boosting, scratch: Scratch) -> list[Tree]:
    """The trees for the array column ``features`` and ``label``.

    Margins of the trees so far are worked out where the rows are, once a tree; every 25 trees they are checkpointed, so a
    lost executor costs the trees since then. The driver holds the trees, whose size the settings bound. A table of up to
    256 million cells is grown by one task, 250 trees in a job, after many have binned it; a larger one takes a job a level.
    """
    spark, s = df.sparkSession, settings
    shared_dir(spark)
    table, n, parts = _binned(df, features, label, cuts, scratch)
    width = len(cuts)

    def unpack(rows):
        for r in rows:
            bins = np.frombuffer(r["bins"], np.uint8).reshape(r["n"], width)
            yield bins, np.frombuffer(r["labels"], np.int8), np.frombuffer(r["places"], np.int64), np.zeros(r["n"])

    blocks = table.rdd.mapPartitions(unpack)
    blocks = (blocks.coalesce(1) if parts == 1 else blocks).persist(StorageLevel.DISK_ONLY)
    rng = np.random.default_rng(s.seed)
    trees: list[Tree] = []
    while len(trees) < s.trees:
        done = len(trees)
        some = min(_ADVANCE * (10 if parts == 1 else 1), s.trees - done)
        draws = [np.sort(rng.choice(width, max(1, round(s.columns * width)), replace=False)) for _ in range(some)]
        if parts == 1:
            recent = blocks.mapPartitions(lambda held: _trees_of_one_task(held, n, width, done, draws, s)).collect()
            trees += recent or [Tree.root() for _ in draws]  # no rows
        else:
            for number, columns in enumerate(draws, done):
                drawn = _drawn_blocks(blocks, trees[done:], number, columns, s)
                trees.append(_tree(lambda tree, nodes: _level(drawn, tree, nodes, columns, s, parts), s))
                drawn.unpersist()
        if len(trees) < s.trees:
            recent = trees[done:]
            after = blocks.map(lambda b, recent=recent: (*b[:3], _margins(b[0], b[3], recent))).persist(StorageLevel.DISK_ONLY)
            after.checkpoint()
            after.count()
            blocks.unpersist()
            blocks = after
    blocks.unpersist()
    return trees


def as_model(spark: SparkSession, trees: list[Tree], cuts: list[np.ndarray]) -> GBTClassificationModel:
    """The trees as a model of Spark's own, by its saved form: so they are scored, saved and loaded like any other. Its
    probability is the logistic function of twice its sum, hence half of each value."""
    path = scratch_path(spark, "boosted")
    stamp = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "paramMap": {"impurity": "variance"}, "defaultParamMap": {}}
    whole = stamp | {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": "GBTClassifier_boosted", "numFeatures": len(cuts), "numTrees": len(trees)}
    single = stamp | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel"}
    nodes = []
    for t, tree in enumerate(trees):
        for k, feature in enumerate(tree.feature):
            inner = feature >= 0
            split = (feature, [float(cuts[feature][tree.cut[k]])], -1) if inner else (-1, [], -1)
            children = (tree.low[k], tree.low[k] + 1) if inner else (-1, -1)
            nodes.append((t, (k, tree.value[k] / 2, 0.0, [1.0, 0.0, 0.0], 1, tree.gain[k] if inner else -1.0, *children, split)))
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(t, json.dumps(single | {"uid": f"dtr_{t}"}), 1.0) for t in range(len(trees))], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    schema = (
        "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
        "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
    )
    spark.createDataFrame(nodes, schema).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit_boosted(df: DataFrame, features: str, width: int, label: str = "label", settings: Boosting = Boosting()) -> GBTClassificationModel:
    """The model learned from an array column of ``width`` finite numbers and a label of 0 or 1. Runs over the same rows in
    the same order agree. A table without rows, or of one class, gives trees that are single leaves."""
    scratch = Scratch(df.sparkSession, "boosting")
    rows = scratch.table(df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")))
    cuts = feature_cuts(rows, "x", width, settings.bins)
    trees = grow(rows, "x", "y", cuts, settings, scratch)
    model = as_model(df.sparkSession, trees, cuts)
    scratch.close()
    return model
