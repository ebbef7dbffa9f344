"""Gradient-boosted trees for grids with deep trees.

The trees are those of MLlib's ``GBTRegressor`` and ``GBTClassifier``: features in bins, split by the gain
in variance, the first of equal splits. MLlib sends sums for each feature and bin of every node from
each task at every level. Here only nodes of many rows are split that way. The rows of a smaller node go
to one task, which grows the rest of its branch; so a round shuffles each row once at most, however deep
the tree. A node is small up to the number of rows over twice the cores, at least 8,192 and at most 65,536.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from wordtrail.session import removed, shared_path

CELLS, PIECE, AT_ONCE = 1 << 16, 1 << 12, 256  # cells and rows that are summed at once; nodes split in one job
SMALL_ROWS = (8_192, 65_536)
SAMPLE = 10_000  # rows that the bins are found on, as in MLlib; at least the square of the number of bins
ROW = "row long, y double, bins binary, total double, reached array<double>"
TREE = ("feature", "split", "child", "value")


def bin_edges(values: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each column of a sample at most ``bins - 1`` edges at about equal numbers of rows."""
    edges = []
    for column in values.T:
        found, counts = np.unique(column, return_counts=True)
        middle = (found[:-1] + found[1:]) / 2
        if len(middle) >= bins:
            stride = target = len(column) / bins
            chosen = []
            for i, (before, after) in enumerate(zip(np.cumsum(counts)[:-1], np.cumsum(counts)[1:])):
                if abs(before - target) < abs(after - target):
                    chosen.append(i)
                    target += stride
            middle = middle[chosen]
        edges.append(middle)
    return edges


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of edges below each value."""
    kind = np.min_scalar_type(max(map(len, edges), default=0))
    return np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, values.T)], axis=1).astype(kind)


def matrix(column, width: int) -> np.ndarray:
    """The rows of a list column side by side."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths != width).any() or not np.isfinite(values).all():
        raise ValueError(f"Vectors MUST have {width} entries and MUST NOT contain NaN or Infinity")
    return values.reshape(-1, width)


def bin_matrix(column, kind: np.dtype, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.binary(width * kind.itemsize))
    flat = np.frombuffer(column.buffers()[1], kind) if len(column) else np.zeros(0, kind)
    return flat[column.offset * width:(column.offset + len(column)) * width].reshape(-1, width)


def targets(y: np.ndarray, total: np.ndarray, first: bool, classes: bool) -> np.ndarray:
    """What a round's tree is fitted to: the label, later minus the gradient of MLlib's loss."""
    if first:
        return y
    if not classes:
        return 2.0 * (y - total)
    with np.errstate(over="ignore"):
        return 4.0 * y / (1.0 + np.exp(2.0 * y * total))


def summed(slot: np.ndarray, bins: np.ndarray, target: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """``[number, sum, sum of squares] x node x feature x bin``"""
    width = bins.shape[1]
    out = np.zeros((3, nodes * width * size))
    for a in range(0, len(slot), PIECE):
        s, b, t = slot[a:a + PIECE], bins[a:a + PIECE], np.repeat(target[a:a + PIECE], width)
        cell = ((s[:, None] * width + np.arange(width)) * size + b).ravel()
        out[0] += np.bincount(cell, minlength=out.shape[1])
        out[1] += np.bincount(cell, t, out.shape[1])
        out[2] += np.bincount(cell, t * t, out.shape[1])
    return out.reshape(3, nodes, width, size)


def variance(sums: np.ndarray) -> np.ndarray:
    n = np.maximum(sums[0], 1.0)
    return (sums[2] - sums[1] * sums[1] / n) / n


def best_splits(sums: np.ndarray, whole: np.ndarray | None, least: int, gain: float) -> dict[str, np.ndarray]:
    """Of each node the feature and bin of the largest gain, the first of equal ones; its sums, and those of both sides."""
    left = np.cumsum(sums, axis=3)
    right = left[..., -1:] - left[..., :-1]
    left = left[..., :-1]
    nodes, _, splits = left.shape[1:]
    used = np.flatnonzero((right[0] > 0).any(axis=(0, 2)) & (left[0] > 0).any(axis=(0, 2)))
    if whole is None:  # a root, whose sums no parent has found
        whole = left[:, :, used[0], 0] + right[:, :, used[0], 0] if len(used) else sums[:, :, 0].sum(axis=2)
    n = np.maximum(left[0] + right[0], 1.0)
    gains = variance(whole)[:, None, None] - left[0] / n * variance(left) - right[0] / n * variance(right)
    gains[(left[0] < least) | (right[0] < least) | (gains < gain)] = -np.inf
    flat = gains.reshape(nodes, -1)
    best = flat.argmax(axis=1) if flat.shape[1] else np.zeros(nodes, int)
    each = np.arange(nodes)
    side = lambda x: x.reshape(3, nodes, -1)[:, each, best] if flat.shape[1] else whole
    return {"feature": best // max(splits, 1), "split": best % max(splits, 1), "gain": flat[each, best] if flat.shape[1] else np.full(nodes, -np.inf),
            "whole": whole, "left": side(left), "right": side(right)}


class Tree:
    """Nodes by number; ``child`` is the left one's, the right one follows it, 0 stands for a leaf."""

    def __init__(self, whole: np.ndarray | None = None):
        self.feature, self.split, self.child = (np.zeros(1, np.int32) for _ in range(3))
        self.value = np.zeros(1)
        if whole is not None:
            self.value[0] = whole[1] / whole[0]

    def divide(self, nodes: np.ndarray, found: dict[str, np.ndarray], deepest: bool) -> tuple[np.ndarray, np.ndarray]:
        """Two children for each node that gains by its split. The children that may be divided in turn, and their sums."""
        if nodes[0] == 0:
            self.value[0] = found["whole"][1, 0] / found["whole"][0, 0]
        good = found["gain"] > 0
        nodes, first = nodes[good], len(self.value)
        self.feature[nodes], self.split[nodes] = found["feature"][good], found["split"][good]
        self.child[nodes] = first + 2 * np.arange(len(nodes))
        sums = np.stack([found["left"][:, good], found["right"][:, good]], axis=2).reshape(3, -1)
        more = np.zeros(sums.shape[1], np.int32)
        self.feature, self.split, self.child = (np.concatenate([x, more]) for x in (self.feature, self.split, self.child))
        self.value = np.concatenate([self.value, sums[1] / np.maximum(sums[0], 1.0)])
        going = (np.abs(variance(sums)) >= np.finfo(float).eps) & (not deepest)
        return first + np.flatnonzero(going), sums[:, going]

    def step(self, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The next node of each row, or the same where that is a leaf."""
        child = self.child[at]
        return np.where(child > 0, child + (bins[np.arange(len(at)), self.feature[at]] > self.split[at]), at)

    def walk(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        while len(at) and not np.array_equal(after := self.step(at, bins), at):
            at = after
        return at

    def packed(self) -> bytes:
        return b"".join(getattr(self, name).tobytes() for name in TREE)

    def attach(self, node: int, branch: bytes) -> None:
        """A packed tree takes the place of a leaf."""
        n, first = len(branch) // 20, len(self.value)
        feature, split, child = (np.frombuffer(branch, np.int32, n, 4 * n * i) for i in range(3))
        child = np.where(child > 0, child + first - 1, 0).astype(np.int32)
        for name, of in zip(TREE, (feature, split, child, np.frombuffer(branch, np.float64, n, 12 * n))):
            mine = getattr(self, name)
            mine[node] = of[0]
            setattr(self, name, np.concatenate([mine, of[1:]]))


def branch(bins: np.ndarray, target: np.ndarray, whole: np.ndarray | None, depth: int, size: int, least: int, gain: float) -> tuple[Tree, np.ndarray]:
    """A tree of at most ``depth`` levels over rows of one task, and the leaf of each row."""
    tree, at = Tree(whole), np.zeros(len(target), np.int64)
    open_, sums = np.zeros(1, np.int64), None if whole is None else whole[:, None]
    most = max(1, CELLS // (bins.shape[1] * size))
    for level in range(depth):
        if not len(open_):
            break
        order = np.argsort(at, kind="stable")  # rows keep their order within a node
        bounds = np.searchsorted(at[order], [open_, open_ + 1])
        found = []
        for a in range(0, len(open_), most):
            (low, high), nodes = bounds[:, a:a + most], open_[a:a + most]
            mine = np.concatenate([order[x:y] for x, y in zip(low, high)])
            cells = summed(np.repeat(np.arange(len(nodes)), high - low), bins[mine], target[mine], len(nodes), size)
            found.append(best_splits(cells, sums if sums is None else sums[:, a:a + most], least, gain))
        every = {k: np.concatenate([f[k] for f in found], axis=-1) for k in found[0]}
        open_, sums = tree.divide(open_, every, level + 1 == depth)
        at = tree.step(at, bins)
    return tree, at


class Boosted:
    """A boosted ensemble: bin edges, trees and their weights. ``fitted`` holds for the rows of the fit the
    label and an array of the predictions at the sizes asked for; it lies in the shared folder until ``forget``."""

    def __init__(self, edges: list[np.ndarray], rate: float, classes: bool, features: str):
        self.edges, self.rate, self.classes, self.features = edges, rate, classes, features
        self.trees: list[Tree] = []
        self.fitted: DataFrame | None = None
        self.path = ""

    def predicted(self, total: Column) -> Column:
        return F.when(total > 0, 1.0).otherwise(0.0) if self.classes else total

    def forget(self) -> None:
        removed(self.fitted.sparkSession, self.path)

    def beginnings(self, df: DataFrame, sizes: Sequence[int]) -> DataFrame:
        """``df`` with an array ``_predictions``, one for the first trees of each size."""
        trees, edges, rate, sizes = self.trees, self.edges, self.rate, [min(n, len(self.trees)) for n in sizes]

        @F.arrow_udf("array<double>")
        def score(values: pa.Array) -> pa.Array:
            bins = binned(matrix(values, len(edges)), edges)
            total, reached = np.zeros(len(bins)), {}
            for i, tree in enumerate(trees[:max(sizes)]):
                total = total + (rate if i else 1.0) * tree.value[tree.walk(bins)]
                reached[i + 1] = total
            ends = np.arange(len(bins) + 1, dtype=np.int32) * len(sizes)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack([reached[n] for n in sizes], axis=1).ravel()))

        return df.withColumn("_predictions", F.transform(score(vector_to_array(self.features)), self.predicted))


def checked(df: DataFrame, features: str, label: str, classes: bool) -> DataFrame:
    """Row number, label (-1 and 1 for classes) and values; what MLlib does not take is an error."""
    y, wrong = F.col(label).cast("double"), "Labels MUST NOT be Null or NaN"
    bad = y.isNull() | F.isnan(y)
    if classes:
        bad, wrong = bad | ~y.isin(0.0, 1.0), "Labels MUST be in {0, 1}"
    refused = F.raise_error(F.lit("Vectors MUST NOT be Null")).cast("array<double>")
    values = F.when(F.col(features).isNull(), refused).otherwise(vector_to_array(features))
    y = F.when(bad, F.raise_error(F.lit(wrong)).cast("double")).otherwise(2 * y - 1 if classes else y)
    return df.select(F.monotonically_increasing_id().alias("row"), y.alias("y"), values.alias("values"))


def fit(estimator: GBTRegressor | GBTClassifier, df: DataFrame, sizes: Sequence[int] = ()) -> Boosted:
    """The ensemble of an MLlib estimator's parameters. Row subsets, feature subsets, weights and validation are not taken."""
    if (estimator.getSubsamplingRate() != 1 or estimator.getFeatureSubsetStrategy() != "all" or estimator.getMinWeightFractionPerNode()
            or estimator.isSet("weightCol") or estimator.isSet("validationIndicatorCol")):
        raise ValueError("a grid of boosted trees takes all rows and features, without weights")
    spark, classes = df.sparkSession, isinstance(estimator, GBTClassifier)
    depth, least, gain = estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain()
    values = vector_to_array(estimator.getFeaturesCol()).alias("values")
    n = df.count()
    if not n:
        raise ValueError("boosted trees need rows")
    size = min(estimator.getMaxBins(), n)
    part = max(size * size, SAMPLE) / n
    sample = (df if part >= 1 else df.sample(False, part, estimator.getSeed())).filter(F.col(estimator.getFeaturesCol()).isNotNull()).select(values).toArrow()["values"].combine_chunks()
    width = len(sample[0]) if len(sample) else 0
    if not width:
        raise ValueError("boosted trees need features")
    edges = bin_edges(matrix(sample, width), size)
    kind = binned(np.zeros((0, width)), edges).dtype
    model = Boosted(edges, estimator.getStepSize(), classes, estimator.getFeaturesCol())
    cores = spark.sparkContext.defaultParallelism
    small_rows = min(max(n // (2 * cores), SMALL_ROWS[0]), SMALL_ROWS[1])

    def begin(batches):
        for batch in batches:
            bins = binned(matrix(batch.column("values"), width), edges)
            row, y = batch.column("row"), batch.column("y")
            flat = pa.array([x.tobytes() for x in bins], pa.binary())
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(row) + 1, np.int32)), pa.array([], pa.float64()))
            yield pa.RecordBatch.from_arrays([row, y, flat, pa.array(np.zeros(len(row))), empty], ["row", "y", "bins", "total", "reached"])

    def stored(rows: DataFrame, name: str) -> str:
        path = shared_path(spark, name)
        rows.write.parquet(path)
        return path

    model.path = stored(checked(df, model.features, estimator.getLabelCol(), classes).mapInArrow(begin, ROW), "boosted")
    for turn in range(estimator.getMaxIter()):  # each round's functions go to the tasks before the next round begins
        rate = model.rate if turn else 1.0
        rows = spark.read.schema(f"{ROW}, tree binary").parquet(model.path).filter("tree IS NULL").drop("tree")
        read = partial(_read, kind=kind, width=width, first=not turn, classes=classes)
        tree, small = _upper_levels(rows, read, n, small_rows, depth, width, size, least, gain)

        def settled(batches):
            """Rows whose leaf is known already."""
            leaf = ~np.isin(np.arange(len(tree.value)), list(small))
            for batch in batches:
                at = tree.walk(read(batch)[0])
                yield _with_totals(batch, tree.value[at], rate).filter(pa.array(leaf[at]))

        def placed(batches):
            """Rows of small nodes, with the node."""
            open_ = np.isin(np.arange(len(tree.value)), list(small))
            for batch in batches:
                at = tree.walk(read(batch)[0])
                yield batch.append_column("node", pa.array(at.astype(np.int32))).filter(pa.array(open_[at]))

        def finished(key, table):
            """The rest of a branch: its rows with their new totals, and a row that holds its nodes."""
            node = key[0].as_py()
            level, whole = small[node]
            table = table.drop_columns(["node"]).sort_by("row").combine_chunks()
            bins, target = read(table)
            grown, at = branch(bins, target, whole, depth - level, size, least, gain)
            rows = _with_totals(table, grown.value[at], rate)
            rows = rows.append_column("tree", pa.nulls(len(rows), pa.binary()))
            nodes = pa.table([[node], [None], [None], [None], [None], [grown.packed()]], schema=rows.schema)
            return pa.concat_tables([rows, nodes])

        after = []
        if len(small) < np.count_nonzero(tree.child == 0):
            after.append(rows.mapInArrow(settled, ROW).withColumn("tree", F.lit(None).cast("binary")))
        if small:
            dealt = rows.mapInArrow(placed, f"{ROW}, node int").repartition(min(len(small), 4 * cores), "node")
            after.append(dealt.groupBy("node").applyInArrow(finished, f"{ROW}, tree binary"))
        whole = after[0] if len(after) == 1 else after[0].unionByName(after[1])
        if turn + 1 in sizes:
            whole = whole.withColumn("reached", F.when(F.col("tree").isNull(), F.concat("reached", F.array("total"))))
        before, model.path = model.path, stored(whole, "boosted")
        if small:
            grown = spark.read.schema("row long, tree binary").parquet(model.path).filter("tree IS NOT NULL")
            for node, nodes in sorted(grown.collect()):  # at most 2 ** (depth + 1) nodes of 20 bytes in all
                tree.attach(node, bytes(nodes))
        model.trees.append(tree)
        removed(spark, before)
    rows = spark.read.schema(f"{ROW}, tree binary").parquet(model.path).filter("tree IS NULL")
    label = (F.col("y") + 1) / 2 if classes else F.col("y")
    order = sorted({n for n in sizes if n <= len(model.trees)})
    reached = F.array(*[model.predicted(F.get("reached", F.lit(order.index(n)))) for n in sizes]) if sizes else F.array().cast("array<double>")
    model.fitted = rows.select(label.alias(estimator.getLabelCol()), reached.alias("_predictions"))
    return model


def _read(batch, kind: np.dtype, width: int, first: bool, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bins and targets of stored rows."""
    y, total = (batch.column(c).to_numpy() if isinstance(batch, pa.Table) else batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "total"))
    return bin_matrix(batch.column("bins"), kind, width), targets(y, total, first, classes)


def _with_totals(rows, values: np.ndarray, rate: float):
    at = rows.schema.get_field_index("total")
    return rows.set_column(at, "total", pa.array(rows.column("total").to_numpy() + values * rate))


def _upper_levels(rows: DataFrame, read, n: int, small_rows: int, depth: int, width: int, size: int, least: int, gain: float) -> tuple[Tree, dict]:
    """A tree down to its small nodes, and of these the level and the sums that the parent's split gave."""
    tree = Tree()
    if n <= small_rows or not depth:
        return tree, {0: (0, None)}
    open_, sums, small = np.zeros(1, np.int64), None, {}
    for level in range(depth):
        if not len(open_):
            break
        found = []
        for a in range(0, len(open_), AT_ONCE):
            nodes, whole = open_[a:a + AT_ONCE], sums if sums is None else sums[:, a:a + AT_ONCE]

            def partial_sums(batches):
                slot = np.full(len(tree.value), -1)
                slot[nodes] = np.arange(len(nodes))
                out = np.zeros((3, len(nodes), width, size))
                lowest = None
                for batch in batches:
                    bins, target = read(batch)
                    mine = slot[tree.walk(bins)]
                    kept = mine >= 0
                    out += summed(mine[kept], bins[kept], target[kept], len(nodes), size)
                    lowest = batch.column("row")[0].as_py() if lowest is None and len(bins) else lowest
                for i in np.flatnonzero(out[0].any(axis=(1, 2))):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([lowest]), pa.array([out[:, i].tobytes()], pa.binary())], ["slot", "task", "sums"])

            def split(key, table):
                slot = key[0].as_py()
                out = np.zeros((3, 1, width, size))
                for one in table.sort_by("task").column("sums"):
                    out += np.frombuffer(one.as_py()).reshape(out.shape)
                best = best_splits(out, whole if whole is None else whole[:, [slot]], least, gain)
                return pa.table({"slot": pa.array([slot], pa.int32()), **{k: pa.array([float(best[k][0])]) for k in ("feature", "split", "gain")},
                                 **{k: pa.array([best[k][:, 0].tolist()]) for k in ("whole", "left", "right")}})

            # bounded: a row for each node, of which there are at most AT_ONCE
            best = sorted(rows.mapInArrow(partial_sums, "slot int, task long, sums binary").groupBy("slot")
                    .applyInArrow(split, "slot int, feature double, split double, gain double, whole array<double>, left array<double>, right array<double>").collect())
            found.append({k: np.array([r[k] for r in best]).T for k in ("feature", "split", "gain", "whole", "left", "right")})
        every = {k: np.concatenate([f[k] for f in found], axis=-1) for k in found[0]}
        open_, sums = tree.divide(open_, every, level + 1 == depth)
        few = sums[0] <= small_rows
        small |= {int(i): (level + 1, sums[:, k]) for i, k in zip(open_[few], np.flatnonzero(few))}
        open_, sums = open_[~few], sums[:, ~few]
    return tree, small
