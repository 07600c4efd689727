"""Hard negatives for contrastive training, by exact search in STR-packed R-trees of integer vectors.

Rows are packed into trees of bounded size: ranges of (label, the coordinate that varies most) become trees, and within a tree each
label's rows are sorted and tiled by one coordinate after the other into leaves (Leutenegger, Lopez and Edgington, STR, 1997), whose
minimum bounding boxes have boxes of their own above them.  For an anchor, the sum over coordinates of the least and of the largest
product with a box's two ends bounds every inner product in it.  A queue opens the box with the highest bound first, and leaves out
boxes outside the score windows or strictly below the k-th best score found so far.

Anchors are a stated set of queries.  They meet the trees in cells of one part of the anchors and one tree, each of bounded size; what
a cell finds for an anchor is a few rows, and those of all cells are ranked together.  First come the positives of all anchors, then
the negatives in the windows that these give.  Of rows with one label and one vector only as many as an answer can hold are kept, those
with the smallest ids, so a group of copies is small in every tree; no others can be among the answers.

Defined cases: rows with a null label, a null vector or a component that is null or not finite take no part, nor do those whose squared
length in integers is 2^62 or more, as scores must fit 64 bits; missing components of shorter vectors are 0; rows equal in id, label and
vector are one row; rows that share only an id are rows of their own; a null id is never an anchor and comes last in a tie; anchors
without positives, and positives without negatives in their window, give no rows; other columns are not read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.scratch import partitions, stored

POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score between which a negative's lies, ends included.
LOW, HIGH = 50, 95
#: Rows of a tree (bounds), rows of a leaf, boxes below a box, anchors of a cell.
TREE, LEAF, FANOUT, ANCHORS = (1024, 32_768), 512, 8, 8192
_LIMIT = float(1 << 62)


def integers(vectors: DataFrame, scale: int = 256, id: str = "vec_id", label: str | Column = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, vec) of the rows that take part: each component times ``scale``, rounded down."""
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.filter(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(F.floor(v * scale).cast("double"), F.lit(2.0))) < _LIMIT)
    return rows.select("id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("vec"))


@dataclass
class Tree:
    """Rows in the order of the leaves; ``first`` has each leaf's first row, and the end; ``levels`` the boxes, leaves first."""

    ids: np.ndarray
    known: np.ndarray
    vecs: np.ndarray
    first: np.ndarray
    labels: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]


def _tiled(vecs: np.ndarray, rows: np.ndarray, axes: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Runs of at most ``leaf`` of the rows: sorted by the first axis and cut into slabs, and those by the other axes."""
    leaves = -(-len(rows) // leaf)
    if leaves <= 1:
        return [rows]
    rows = rows[np.argsort(vecs[rows, axes[0]], kind="stable")]
    slabs = leaves if len(axes) == 1 else int(np.ceil(leaves ** (1 / len(axes))))
    width = leaf * -(-leaves // slabs)
    return [run for at in range(0, len(rows), width) for run in _tiled(vecs, rows[at : at + width], axes[1:] if len(axes) > 1 else axes, leaf)]


def packed_order(vecs: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(the rows in the order of leaves, the first row of each leaf and the end); a leaf has rows of one label."""
    runs = []
    order = np.argsort(labels, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        many = max(1, min(vecs.shape[1], int(np.log2(max(2, len(rows) / leaf)))))
        axes = np.argsort(-vecs[rows].astype(np.float64).var(axis=0), kind="stable")[:many] if vecs.shape[1] else np.zeros(1, np.int64)
        runs += _tiled(vecs, rows, axes, leaf) if vecs.shape[1] else [rows]
    return np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])


def tree_of(ids: np.ndarray, known: np.ndarray, vecs: np.ndarray, first: np.ndarray, labels: np.ndarray, fanout: int = FANOUT) -> Tree:
    """The tree above leaves in order; ``labels`` are those of the leaves."""
    levels = [(np.minimum.reduceat(vecs, first[:-1], axis=0), np.maximum.reduceat(vecs, first[:-1], axis=0))]
    while len(levels[-1][0]) > 1:
        low, high = levels[-1]
        at = np.arange(0, len(low), fanout)
        levels.append((np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0)))
    return Tree(ids, known, vecs, first, labels, levels)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) inner product of each query with any point of each box, as doubles that are never too narrow."""
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    most = up @ high.T + down @ low.T
    least = up @ low.T + down @ high.T
    size = (up - down) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size < 2.0**53, 0.0, size * 1e-12)  # whole numbers below 2^53 are exact
    return least - slack, most + slack


class _Best:
    """The best ``k`` rows of a score window: the highest scores, the smallest ids in a tie, unknown ids last."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high, self.rows = k, low, high, []

    @property
    def floor(self) -> float:
        """Scores below it can't be among the best any more."""
        own = -self.rows[-1][0] if len(self.rows) == self.k else None
        return -np.inf if own is None and self.low is None else max(x for x in (own, self.low) if x is not None)

    def add(self, rows: list[tuple[int, bool, int]]) -> None:
        """Takes (-score, unknown, id) of rows, those that don't fit left out."""
        floor, high = self.floor, self.high
        self.rows = sorted([*self.rows, *(r for r in rows if -r[0] >= floor and (high is None or -r[0] <= high))])[: self.k]


def search(tree: Tree, query: np.ndarray, least: list[np.ndarray], most: list[np.ndarray], own: bool, label: int, windows: list[_Best], exact: bool, but: tuple[int, np.ndarray] | None = None) -> int:
    """Fills the windows with the rows of the label (``own``), or of the others, and returns the number of leaves that it opened.

    least, most: the query's bounds for the boxes of each level; but: id and vector of a row that is left out.
    """
    top, opened = len(tree.levels) - 1, 0
    queue = [(-most[top][0], top, 0)]
    high = None if any(w.high is None for w in windows) else max(w.high for w in windows)
    floors = [w.floor for w in windows]
    floor = min(floors)
    while queue:
        bound, level, box = heapq.heappop(queue)
        if -bound < floor:
            break  # no box left reaches any window
        if level:
            first, last = box * FANOUT, min((box + 1) * FANOUT, len(most[level - 1]))
            for child, reach in enumerate(most[level - 1][first:last].tolist(), first):
                if reach >= floor:
                    heapq.heappush(queue, (-reach, level - 1, child))
        elif (tree.labels[box] == label) == own and any(-bound >= f and (w.high is None or least[0][box] <= w.high) for f, w in zip(floors, windows)):
            opened += 1
            start = tree.first[box]
            rows = tree.vecs[start : tree.first[box + 1]]
            scores = rows @ query if exact else rows.astype(np.int64) @ query.astype(np.int64)
            fit = scores >= floor
            if high is not None:
                fit &= scores <= high
            found = [(-int(scores[k]), not tree.known[start + k], int(tree.ids[start + k])) for k in np.flatnonzero(fit).tolist() if but is None or not (tree.known[start + k] and tree.ids[start + k] == but[0] and np.array_equal(rows[k], but[1]))]
            if found:
                for w in windows:
                    w.add(found)
                floors = [w.floor for w in windows]
                floor = min(floors)
    return opened


_TREE = "tree long, labels array<long>, first array<int>, ids array<long>, vecs binary, least long, most long"


def trees(rows: DataFrame, width: int, sizes: tuple[int, int] = TREE, leaf: int = LEAF, keep: int = max(POSITIVES + 1, NEGATIVES)) -> DataFrame:
    """A row for each tree over the (id, label, vec) rows: its leaves' labels and first rows, its ids, its vectors, its range of labels."""
    copies = Window.partitionBy("label", "vec").orderBy(F.asc_nulls_last("id"))
    kept = stored(rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= keep).drop("copy"), "vectors")
    spread = kept.select(F.posexplode("vec").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("v")).orderBy(F.desc("v"), "axis").first()
    n = kept.count()
    size = int(min(max(n / partitions(kept.sparkSession), sizes[0]), sizes[1]))
    order = ["label", *([F.col("vec")[spread["axis"]]] if spread else []), F.xxhash64("id", "vec"), "id"]

    def tree(at: int, table: pa.Table) -> pa.RecordBatch:
        labels = table.column("label").to_numpy()
        vecs = np.frombuffer(np.array(table.column("vec").combine_chunks().flatten()), np.int64).reshape(len(labels), width)
        rows, first = packed_order(vecs, labels, leaf)
        ids = table.column("id").take(pa.array(rows)).to_pylist()
        small = np.int32 if np.abs(vecs).max(initial=0) < 1 << 31 else np.int64
        values = [[at], [labels[rows[first[:-1]]].tolist()], [first.tolist()], [ids], [vecs[rows].astype(small).tobytes()], [int(labels.min())], [int(labels.max())]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["tree", "labels", "first", "ids", "vecs", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, waiting = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            waiting = part if waiting is None else pa.concat_tables([waiting, part])
            while waiting.num_rows >= 2 * size:
                yield tree(at, waiting.slice(0, size))
                at, waiting = at + 1, waiting.slice(size)
        if waiting is not None and waiting.num_rows:
            yield tree(at, waiting)
        blocks.give_back()

    return stored(kept.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order).mapInArrow(run, _TREE), "trees")


def _cells(anchors: DataFrame, forest: DataFrame, parts: int, own: bool, run, schema: str) -> DataFrame:
    """What ``run`` finds in each cell of one part of the anchors and one tree that can hold rows of their label, or of others."""
    fit = F.col("label").between(F.col("least"), F.col("most")) if own else (F.col("least") != F.col("label")) | (F.col("most") != F.col("label"))
    # three numbers for each tree, and so at most 32 bytes for each thousand rows
    heads = forest.select("tree", "least", "most").groupBy().agg(F.collect_list(F.struct("tree", "least", "most")).alias("heads"))
    met = anchors.join(F.broadcast(heads)).withColumn("h", F.explode("heads")).drop("heads").select("*", "h.*").drop("h").filter(fit).drop("least", "most")
    copies = forest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    n = max(partitions(forest.sparkSession), 1)
    return met.repartition(n, "part", "tree").groupBy("part", "tree").cogroup(copies.repartition(n, "part", "tree").groupBy("part", "tree")).applyInArrow(run, schema)


def _loaded(table: pa.Table, width: int) -> Tree:
    ids, first = table.column("ids").combine_chunks().flatten(), np.array(table.column("first")[0].as_py())
    raw = table.column("vecs")[0].as_py()
    vecs = np.frombuffer(raw, np.int64 if len(raw) == 8 * width * len(ids) and width else np.int32).reshape(len(ids), width)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return tree_of(ids.fill_null(0).to_numpy(), known, vecs, first, np.array(table.column("labels")[0].as_py()))


def _searched(queries: pa.Table, table: pa.Table, width: int, own: bool, windows_of) -> Iterator[tuple[int, list[_Best]]]:
    """(row of ``queries``, its windows filled from the tree)."""
    if not queries.num_rows or not table.num_rows:
        return
    tree = _loaded(table, width)
    vecs = np.array(queries.column("vec").combine_chunks().flatten()).astype(np.int64).reshape(queries.num_rows, width)
    labels, ids = queries.column("label").to_numpy(), queries.column("id").to_numpy()
    exact = width * float(np.abs(vecs).max(initial=0)) * float(np.abs(tree.vecs.astype(np.float64)).max(initial=0)) < 2.0**53
    if exact:
        tree.vecs = tree.vecs.astype(np.float64)
    step = max(1, (8 << 20) // max(1, 16 * len(tree.first)))  # queries whose bounds are worked out together
    for at in range(0, len(vecs), step):
        both = [bounds(vecs[at : at + step], low, high) for low, high in tree.levels]
        for k in range(at, min(at + step, len(vecs))):
            query = vecs[k].astype(np.float64) if exact else vecs[k]
            windows = windows_of(k)
            search(tree, query, [x[0][k - at] for x in both], [x[1][k - at] for x in both], own, labels[k], windows, exact, (ids[k], query) if own else None)
            yield k, windows


def _result(found: list[tuple], names: list[str]) -> pa.Table:
    columns = [list(c) for c in zip(*found)] or [[] for _ in names]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sizes: tuple[int, int] = TREE, per_cell: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the (id, label, vec) rows.

    An anchor is a row for which ``is_anchor`` holds.  Its positives are the best other rows of its label, and its negatives for each
    of them the best rows of other labels whose score is between ``low`` and ``high`` percent of the positive's.
    """
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    wide = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec")))
    rows = stored(rows.withColumn("vec", wide).distinct(), "rows")
    forest = trees(rows, width, sizes, keep=max(positives + 1, negatives))
    chosen = stored(rows.filter(is_anchor & F.col("id").isNotNull()).withColumn("key", F.monotonically_increasing_id()), "anchors")
    parts = max(1, -(-chosen.count() // per_cell))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))

    def beside(_, queries: pa.Table, table: pa.Table) -> pa.Table:
        keys = queries.column("key").to_numpy() if queries.num_rows else []
        found = [(keys[k], None if unknown else i, -score) for k, (best,) in _searched(queries, table, width, True, lambda k: [_Best(positives)]) for score, unknown, i in best.rows]
        return _result(found, ["key", "id", "score"])

    def between(_, queries: pa.Table, table: pa.Table) -> pa.Table:
        keys = queries.column("key").to_numpy() if queries.num_rows else []
        wanted = queries.column("scores").to_pylist() if queries.num_rows else []
        windows = lambda k: [_Best(negatives, -(-low * p // 100), high * p // 100) for p in wanted[k]]  # noqa: E731  whole numbers of any size
        found = [(keys[k], j, None if unknown else i, -score) for k, own in _searched(queries, table, width, False, windows) for j, best in enumerate(own) for score, unknown, i in best.rows]
        return _result(found, ["key", "place", "id", "score"])

    order = [F.desc("score"), F.asc_nulls_last("id")]
    near = _cells(chosen, forest, parts, True, beside, "key long, id long, score long")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("place") <= positives)
    near = stored(near.select("key", (F.col("place") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most ``positives`` scores of an anchor, in order of place; of scores below 0 the window is empty
    scores = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("s")).select("key", F.col("s.positive_score").alias("scores"))
    asked = chosen.join(scores, "key").filter(F.exists("scores", lambda s: s >= 0))
    far = _cells(asked, forest, parts, False, between, "key long, place long, id long, score long")
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("key", "place").orderBy(*order))).filter(F.col("rank") <= negatives)
    out = far.join(near, ["key", "place"]).join(chosen.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the anchors, rows whose id is divisible by 50; where it is divisible by 7, the label is the next one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mined(integers(vectors, label=moved), F.col("id") % 50 == 0)


#: The same in SQL, every anchor against every row.
SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), TRUE)),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS own, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
ranked AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN pairs USING (anchor_id) WHERE NOT own AND 100 * score BETWEEN {LOW} * positive_score AND {HIGH} * positive_score)
SELECT * FROM ranked WHERE rank <= {NEGATIVES}
"""
