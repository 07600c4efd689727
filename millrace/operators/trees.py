"""A regression forest grown on all rows of a table.

Values are put in at most 32 bins by cuts at quantiles of all rows (to a quarter of a thousandth of them), and rows with the same bins and label
become one with a number.  How often a tree draws a row is Poisson-distributed and follows from a hash of the row, not from its partition.
A node with more rows than ``LOCAL`` allows is split by sums over all tasks; the rows of a smaller one go to one task, which grows the whole
branch.  The driver sees sums of the split that each large node gets, and the trees, which depth bounds, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a feature; under 255, as a leaf's cut is one that no bin exceeds.
BINS = 32
#: Values (rows times features) of a branch that one task grows; sums that a task makes in one pass over the rows; rows dealt with at once.
LOCAL, SUMS, BLOCK = 1 << 21, 1 << 22, 1 << 16
#: Quantiles from which cuts are chosen. A gain under so small a share of a node's squares is rounding.
GRID, ROUNDING = 1024, 1e-12

_LEAF = 255
_SPLIT = "node int, rows long, gain double, feature int, cut int, left_rows long, left_weight double, left_total double, right_weight double, right_total double"
_BRANCH = "root int, feature binary, cut binary, child binary, value binary, gains binary"


@dataclass
class Tree:
    """Nodes by number, the root first: a row goes from a node to ``child``, or to the one after it if its bin is above ``cut``; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray


@dataclass
class Forest:
    """Cuts of each feature's bins, the trees, and the features' shares of what splits have gained."""

    cuts: list[np.ndarray]
    trees: list[Tree]
    shares: np.ndarray
    depth: int
    _sent: dict = field(default_factory=dict, repr=False)

    def column(self, df: DataFrame, features: Sequence[str]) -> Column:
        """The mean of what the trees say of a row of ``df``."""
        context = df.sparkSession.sparkContext
        if context.applicationId not in self._sent:
            self._sent[context.applicationId] = context.broadcast((self.cuts, self.trees))
        sent, depth, names = self._sent[context.applicationId], self.depth, list(features)

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            cuts, trees = sent.value
            binned = _binned([c.to_numpy(np.float64, na_value=np.nan) for c in columns], cuts, names)
            total = np.zeros(binned.shape[1])
            for tree in trees:
                total += tree.value[_reached(tree, binned, depth)]
            return pd.Series(total / len(trees))

        return predicted(*[F.col(f"`{c}`").cast("double") for c in names])


def _binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray], names: Sequence[str]) -> np.ndarray:
    """(features, rows) of bins: how many cuts lie below the value."""
    out = np.empty((len(columns), len(columns[0])), np.uint8)
    for k, x in enumerate(columns):
        if np.isnan(x).any():
            raise ValueError(f"null or NaN in {names[k]}")
        out[k] = np.searchsorted(cuts[k], x)
    return out


def _reached(tree: Tree, binned: np.ndarray, steps: int) -> np.ndarray:
    """The node that each row has come to after so many steps."""
    n = binned.shape[1]
    at, rows, flat = np.zeros(n, np.int64), np.arange(n), binned.ravel()
    if len(tree.child) > 1:
        for _ in range(steps):
            at = tree.child[at] + (flat[tree.feature[at].astype(np.int64) * n + rows] > tree.cut[at])
    return at


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(binned: np.ndarray, y: np.ndarray) -> np.ndarray:
    """64 bits for each row."""
    h = _mixed((y + 0.0).view(np.uint64))
    for column in binned:
        h = _mixed(h * np.uint64(31) + column)
    return h


@lru_cache(maxsize=4096)
def _poisson(n: int) -> np.ndarray:
    """(first number, cumulative chances): of the draws of n equal rows, where these aren't zero in doubles."""
    least, most = max(0, int(n - 40 * n**0.5 - 40)), int(n + 40 * n**0.5 + 40)
    logs = np.concatenate([[0.0], np.cumsum(np.log(n / np.arange(least + 1, most + 1)))])
    chances = np.exp(logs - logs.max())
    return least, np.cumsum(chances / chances.sum())


def _drawn(hashes: np.ndarray, n: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row, of which there are n: the sum of n draws with mean one."""
    u = (_mixed(hashes + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) * 2.0**-53
    out = np.empty(len(u), np.int64)
    for k in np.unique(n):
        own = n == k
        least, chances = _poisson(int(k))
        out[own] = least + np.minimum(np.searchsorted(chances, u[own], "right"), len(chances) - 1)
    return out


def _best(weights: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, last bin to the left) of the best split of each node by a feature, from (nodes, bins) of weights and of weighted labels; -inf without one."""
    w, s = np.cumsum(weights, axis=1), np.cumsum(totals, axis=1)
    whole, total = w[:, -1:], s[:, -1:]
    w, s = w[:, :-1], s[:, :-1]
    rest = whole - w
    gain = np.where((w > 0) & (rest > 0), s * s / np.maximum(w, 1) + (total - s) ** 2 / np.maximum(rest, 1), -np.inf)
    cut = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), cut] - (total * total / whole)[:, 0], cut


def grown(binned: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
    """A tree over rows drawn w times, and what splits gain by feature; all nodes of a level at once."""
    kind = np.uint8 if len(binned) <= 256 else np.uint16
    gains, levels, first, nodes = np.zeros(len(binned)), [], 0, 1
    w = w.astype(np.float64)
    wy, at = w * y, np.zeros(len(y), np.int64)
    for level in range(depth + 1):
        weight, total, squares = np.bincount(at, w, nodes), np.bincount(at, wy, nodes), np.bincount(at, wy * y, nodes)
        tree = Tree(np.zeros(nodes, kind), np.full(nodes, _LEAF, np.uint8), np.arange(first, first + nodes, dtype=np.int32), total / weight)
        levels.append(tree)
        first += nodes
        open_ = squares - total * total / weight > ROUNDING * squares
        if level == depth or not open_.any():
            break
        # rows of finished nodes go
        at, binned, y, w, wy = _only(open_, at, binned, y, w, wy)
        numbers = np.flatnonzero(open_)
        gain, feature, cut = np.full(len(numbers), -np.inf), np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for k, column in enumerate(binned):
            cells = at * BINS + column
            weights, totals = (np.bincount(cells, x, len(numbers) * BINS).reshape(-1, BINS) for x in (w, wy))
            for low in range(0, len(numbers), 2048):  # what fits a core's cache
                some = slice(low, low + 2048)
                own, last = _best(weights[some], totals[some])
                better = own > gain[some]
                gain[some][better], feature[some][better], cut[some][better] = own[better], k, last[better]
        split = gain > ROUNDING * squares[numbers]
        if not split.any():
            break
        at, binned, y, w, wy = _only(split, at, binned, y, w, wy)
        gain, feature, cut, numbers = gain[split], feature[split], cut[split], numbers[split]
        gains += np.bincount(feature, gain, len(gains))
        nodes = 2 * len(numbers)
        tree.feature[numbers], tree.cut[numbers], tree.child[numbers] = feature, cut, first + np.arange(0, nodes, 2)
        at = 2 * at + (binned[feature[at], np.arange(len(at))] > cut[at])
    return Tree(*[np.concatenate([getattr(t, x) for t in levels]) for x in ("feature", "cut", "child", "value")]), gains


def _only(kept: np.ndarray, at: np.ndarray, binned: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """The rows of the nodes that are kept, with these numbered anew."""
    rows, new = kept[at], np.cumsum(kept) - 1
    if kept.all():
        return [at, binned, *columns]
    return [new[at[rows]], binned[:, rows], *[x[rows] for x in columns]]


def _cuts(rows: DataFrame, n: int) -> tuple[list[np.ndarray], float]:
    """(cuts of each of n features, a number near the labels' mean, the same in whatever order they are summed)."""
    own = [x for k in range(n) for x in (F.max(f"x{k}").alias(f"m{k}"), F.approx_count_distinct(f"x{k}").alias(f"d{k}"))]
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), *own).first()
    if not found.n:
        raise ValueError("no rows to fit")
    few = [f"x{k}" for k in range(n) if found[f"d{k}"] <= 2 * BINS]
    values = rows.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in few]).first().asDict() if few else {}
    many = [f"x{k}" for k in range(n) if not 0 < len(values.get(f"x{k}", [])) <= BINS]
    grids = {}
    if many:
        shares = F.array(*[F.lit(k / GRID) for k in range(1, GRID)])
        grids = rows.agg(*[F.percentile_approx(c, shares, 4 * GRID).alias(c) for c in many]).first().asDict()
    out = []
    for k in range(n):
        exact = np.array(values.get(f"x{k}", []), np.float64)
        if 0 < len(exact) <= BINS:
            low, high = exact[:-1], exact[1:]
            middle = low / 2 + high / 2
            out.append(np.where((middle >= low) & (middle < high), middle, low))
        else:
            out.append(_chosen(np.array(grids[f"x{k}"] or [], np.float64), found[f"m{k}"], BINS - 1))
    return out, float(f"{found.mean:.6g}") if found.mean is not None else 0.0


def _chosen(grid: np.ndarray, largest: float, most: int) -> np.ndarray:
    """At most so many cuts: values that fill a bin are cuts, and those between are taken evenly."""
    values, times = np.unique(grid[grid < largest] if largest is not None else grid, return_counts=True)
    if len(values) <= most:
        return values
    full = times * (most + 1) > len(grid)
    light, left = np.repeat(values[~full], times[~full]), most - int(full.sum())
    return np.union1d(values[full], light[np.arange(1, left + 1) * len(light) // (left + 1)])


def _distinct(rows: DataFrame, cuts: list[np.ndarray], names: Sequence[str]) -> DataFrame:
    """(bins, y, n): distinct rows and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = [c.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
                binned = _binned(x[:-1], cuts, names)
                if np.isnan(x[-1]).any():
                    raise ValueError(f"null or NaN in {names[-1]}")
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(binned)).buffers()[1]
                bins = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(np.ascontiguousarray(binned.T).tobytes())])
                yield pa.RecordBatch.from_arrays([bins, pa.array(x[-1])], ["bins", "y"])

    return rows.mapInArrow(run, "bins binary, y double").groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n"))


def _blocks(batches: Iterator[pa.RecordBatch], n: int, mean: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bins by feature, labels less the mean, numbers, hashes) of blocks of rows."""
    held, rows = [], 0

    def block():
        table = pa.Table.from_batches(held)
        binned = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(-1, n).T.copy()
        y = table["y"].to_numpy()
        return binned, y - mean, table["n"].to_numpy(), _hashed(binned, y)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK:
            yield block()
            held, rows = [], 0
    if rows:
        yield block()


def _places(wanted: Sequence[tuple[int, int]], trees: Sequence[Tree]) -> dict[int, np.ndarray]:
    """By tree, the place among those wanted of each of its nodes, or -1."""
    out = {}
    for place, (tree, node) in enumerate(wanted):
        out.setdefault(tree, np.full(len(trees[tree].child), -1))[node] = place
    return out


def _splits(rows: DataFrame, wanted: Sequence[tuple[int, int]], trees: list[Tree], steps: int, n: int, mean: float, seed: int) -> list:
    """The best split of each node that is wanted, given as (tree, node): sums are made in every task and meet by node."""
    places = _places(wanted, trees)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(wanted), 3, n, BINS))
        squares = np.zeros(len(wanted))
        for binned, y, number, hashes in _blocks(batches, n, mean):
            for tree, place in places.items():
                w, at = _drawn(hashes, number, tree, seed), place[_reached(trees[tree], binned, steps)]
                own = np.flatnonzero((w > 0) & (at >= 0))
                first = at[own].min() if len(own) else 0
                at, some = at[own] - first, w[own].astype(np.float64)
                k = int(at.max()) + 1 if len(own) else 0
                for j in range(n if k else 0):
                    cell = at * BINS + binned[j, own]
                    for i, x in enumerate((None, some, some * y[own])):
                        cells[first : first + k, i, j] += np.bincount(cell, x, k * BINS).reshape(k, BINS)
                if k:
                    squares[first : first + k] += np.bincount(at, some * y[own] ** 2, k)
        for low in range(0, len(wanted), 256):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, min(low + 256, len(wanted))), pa.int32()), pa.array([x.tobytes() for x in cells[low : low + 256]], pa.binary()), pa.array(squares[low : low + 256])], ["node", "sums", "squares"])

    def best(group: pd.DataFrame) -> pd.DataFrame:
        number, weights, totals = sum(np.frombuffer(x).reshape(3, n, BINS) for x in group["sums"])
        gain, last = _best(weights, totals)
        k = int(gain.argmax())
        left = slice(0, int(last[k]) + 1)
        w, s = weights[k], totals[k]
        real = gain[k] > ROUNDING * group["squares"].sum()
        return pd.DataFrame([(group["node"].iloc[0], number[k].sum(), gain[k] if real else -1.0, k, last[k], number[k][left].sum(), w[left].sum(), s[left].sum(), w.sum() - w[left].sum(), s.sum() - s[left].sum())], columns=[x.split()[0] for x in _SPLIT.split(", ")])

    return rows.mapInArrow(sums, "node int, sums binary, squares double").groupBy("node").applyInPandas(best, _SPLIT).collect()


def _branches(rows: DataFrame, roots: Sequence[tuple[int, int, int]], trees: list[Tree], steps: int, n: int, mean: float, seed: int, depth: int) -> DataFrame:
    """The branch that grows from each root, given as (tree, node, level), over the rows that come to it."""
    places, levels = _places([r[:2] for r in roots], trees), [r[2] for r in roots]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for binned, y, number, hashes in _blocks(batches, n, mean):
            for tree, place in places.items():
                w, at = _drawn(hashes, number, tree, seed), place[_reached(trees[tree], binned, steps)]
                own = np.flatnonzero((w > 0) & (at >= 0))
                own = own[np.argsort(at[own], kind="stable")]
                found, first = np.unique(at[own], return_index=True)
                parts = np.split(own, first[1:]) if len(found) else []
                rows_ = [[binned[:, p].T.tobytes() for p in parts], [y[p].tobytes() for p in parts], [w[p].astype(np.int32).tobytes() for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *[pa.array(x, pa.binary()) for x in rows_]], ["root", "bins", "y", "w"])

    def branch(group: pd.DataFrame) -> pd.DataFrame:
        root = int(group["root"].iloc[0])
        binned, y, w = (np.frombuffer(b"".join(group[c]), kind) for c, kind in (("bins", np.uint8), ("y", np.float64), ("w", np.int32)))
        binned = binned.reshape(-1, n).T
        # in an order of their own, as sums depend on it
        order = np.argsort(_hashed(binned, y), kind="stable")
        tree, gains = grown(binned[:, order], y[order], w[order], depth - levels[root])
        return pd.DataFrame([(root, *[getattr(tree, x).tobytes() for x in ("feature", "cut", "child", "value")], gains.tobytes())], columns=[x.split()[0] for x in _BRANCH.split(", ")])

    return rows.mapInArrow(dealt, "root int, bins binary, y binary, w binary").repartition(min(len(roots), 2000), "root").groupBy("root").applyInPandas(branch, _BRANCH)


def fit(df: DataFrame, features: Sequence[str], target: str, trees: int, depth: int, seed: int) -> Forest:
    """Every tree sees all features at each split, on as many draws as there are rows in the mean."""
    if not features:
        raise ValueError("no features")
    n, names = len(features), [*features, target]
    kind = np.uint8 if n <= 256 else np.uint16
    source = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(features)], F.col(f"`{target}`").cast("double").alias("y")).cache()
    rows = None
    try:
        cuts, mean = _cuts(source, n)
        context = df.sparkSession.sparkContext
        # the work of a row grows with the trees, so the rows are dealt out however few their bytes are
        rows = _distinct(source, cuts, names).repartition(max(context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cache()
        count = rows.count()
        tops = [Tree(np.zeros(1, kind), np.full(1, _LEAF, np.uint8), np.zeros(1, np.int32), np.zeros(1)) for _ in range(trees)]
        gains, roots, level = np.zeros((trees, n)), [], 0
        large = [(k, 0) for k in range(trees)] if count * n > LOCAL and depth else []
        if not large:
            roots = [(k, 0, 0) for k in range(trees)]
        while large:
            following: list[tuple[int, int]] = []
            pass_ = max(1, SUMS // (3 * n * BINS))
            for low in range(0, len(large), pass_):
                some = large[low : low + pass_]
                for s in sorted(_splits(rows, some, tops, level, n, mean, seed), key=lambda s: s.node):
                    tree, node = some[s.node]
                    if not s.rows:
                        continue
                    top = tops[tree]
                    top.value[node] = (s.left_total + s.right_total) / (s.left_weight + s.right_weight)
                    if s.gain <= 0:
                        continue
                    child = len(top.child)
                    gains[tree, s.feature] += s.gain
                    top.feature[node], top.cut[node], top.child[node] = s.feature, s.cut, child
                    ends = [s.left_total / s.left_weight, s.right_total / s.right_weight]
                    tops[tree] = Tree(np.append(top.feature, np.zeros(2, kind)), np.append(top.cut, np.full(2, _LEAF, np.uint8)), np.append(top.child, np.arange(child, child + 2, dtype=np.int32)), np.append(top.value, ends))
                    if level + 1 < depth:
                        for at, number in ((child, s.left_rows), (child + 1, s.rows - s.left_rows)):
                            if number * n > LOCAL:
                                following.append((tree, at))
                            else:
                                roots.append((tree, at, level + 1))
            large, level = following, level + 1
        branches = _branches(rows, roots, tops, level, n, mean, seed, depth).collect() if roots else []
        while branches:  # each goes as soon as its tree has it
            b = branches.pop()
            tree, node, _ = roots[b.root]
            tops[tree] = _grafted(tops[tree], node, Tree(*[np.frombuffer(x, t) for x, t in ((b.feature, kind), (b.cut, np.uint8), (b.child, np.int32), (b.value, np.float64))]))
            gains[tree] += np.frombuffer(b.gains)
    finally:
        source.unpersist()
        if rows is not None:
            rows.unpersist()
    for tree in tops:
        tree.value += mean
    whole = gains.sum(axis=1, keepdims=True)
    shares = (gains / np.where(whole > 0, whole, 1)).sum(axis=0)
    return Forest(cuts, tops, shares / (shares.sum() or 1), depth)


def _grafted(tree: Tree, node: int, branch: Tree) -> Tree:
    """The tree with a branch in a leaf's place."""
    size = len(tree.child)
    number = np.concatenate([[node], size + np.arange(len(branch.child) - 1)]).astype(np.int32)
    out = Tree(*[np.concatenate([getattr(tree, x), getattr(branch, x)[1:]]) for x in ("feature", "cut", "child", "value")])
    out.child[number] = number[branch.child]
    for x in ("feature", "cut", "value"):
        getattr(out, x)[node] = getattr(branch, x)[0]
    return out
