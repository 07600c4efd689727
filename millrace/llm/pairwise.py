"""Bradley-Terry weights over all pairs of a good and a bad row, without making a pair.

The loss is the mean over all pairs of log(1 + exp(score of the bad row - score of the good row)), with scores linear in the features,
and a small ridge on the weights of features scaled by their mean square difference over all pairs.  It is minimised by Newton steps
of two passes each.  The first counts the rows of either kind in bins of the score, of which the driver makes, for each bin, the sum of
the logistic over all rows of the other kind and its slope.  The second goes over all rows with these sums: a row's part in the
gradient is its own sum, taken at its own score, times its features.

A bin is ``WIDTH`` wide and counts at the mean of its scores, so the mean chance of a row against the rows of a bin is off by less than
1e-5.  Where scores lie so far apart that more than ``BINS`` bins hold rows, bins are widened and this is coarser; all rows are counted still.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, BINS = 1 / 128, 8192
#: Groups of bins by which the curvature is summed; it decides how fast the steps arrive, not where.
GROUPS = 128
RIDGE, STEPS, ENOUGH = 1e-4, 60, 1e-10
GOOD, BAD = 1, 0


@dataclass
class Bins:
    """Bins with rows, by score; of either kind the number of rows and their mean score."""

    width: float
    index: np.ndarray
    n: dict[int, np.ndarray]
    mean: dict[int, np.ndarray]

    @property
    def middle(self) -> np.ndarray:
        return (self.index + 0.5) * self.width

    def sums(self):
        """(loss, {kind: sum of its lost chances and the slope, at each bin's middle}, group of each bin, curvature between groups)."""
        pairs = float(self.n[GOOD].sum()) * float(self.n[BAD].sum())
        size = len(self.index)
        group = np.arange(size) * min(size, GROUPS) // size
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        loss, curve = 0.0, np.zeros((len(starts), len(starts)))
        lost = {kind: np.zeros((2, size)) for kind in (GOOD, BAD)}
        for k in range(0, size, 256):
            part = slice(k, k + 256)
            gap = self.mean[BAD][None, :] - self.mean[GOOD][part, None]
            loss += float(self.n[GOOD][part] @ np.logaddexp(0, gap) @ self.n[BAD]) / pairs
            for kind, other, sign in ((GOOD, BAD, 1), (BAD, GOOD, -1)):
                chance = _logistic(sign * (self.mean[other][None, :] - self.middle[part, None]))
                slope = chance * (1 - chance)
                lost[kind][0, part] = chance @ self.n[other] / pairs
                lost[kind][1, part] = -sign * (slope @ self.n[other]) / pairs
                if kind == GOOD:
                    np.add.at(curve, group[part], np.add.reduceat(slope * self.n[BAD], starts, axis=1) * (self.n[GOOD][part, None] / pairs))
        return loss, lost, group, curve


def _logistic(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1, e) / (1 + e)


def _scaled(batch: pa.RecordBatch, centre: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(centre))
    return (x - centre) * inverse, batch.column("label").to_numpy(zero_copy_only=False)


def _bins(rows: DataFrame, centre: np.ndarray, inverse: np.ndarray, weights: np.ndarray) -> Bins:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, label = _scaled(batch, centre, inverse)
            scores = u @ weights
            index, which = np.unique(np.floor(scores / WIDTH).astype(np.int64), return_inverse=True)
            out = [index]
            for kind in (GOOD, BAD):
                own = label == kind
                out += [np.bincount(which[own], minlength=len(index)), np.bincount(which[own], scores[own], minlength=len(index))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["bin", "n1", "s1", "n0", "s0"])

    counted = rows.mapInArrow(run, "bin long, n1 long, s1 double, n0 long, s0 double")
    wider = 1
    while True:
        bins = counted.groupBy(F.floor(F.col("bin") / wider).alias("bin")).agg(*[F.sum(c).alias(c) for c in ("n1", "s1", "n0", "s0")])
        found = bins.limit(BINS + 1).collect()
        if len(found) <= BINS:
            break
        wider *= 8
    found = np.array(sorted(map(tuple, found)), float)
    out = Bins(wider * WIDTH, found[:, 0].astype(np.int64), {GOOD: found[:, 1], BAD: found[:, 3]}, {})
    for kind, total in ((GOOD, found[:, 2]), (BAD, found[:, 4])):
        out.mean[kind] = np.where(out.n[kind] > 0, total / np.maximum(out.n[kind], 1), out.middle)
    return out


def _slopes(rows: DataFrame, centre: np.ndarray, inverse: np.ndarray, weights: np.ndarray, bins: Bins, lost, group, curve) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean loss."""
    d, size = len(weights), curve.shape[0]
    middle, width, index = bins.middle, bins.width, bins.index
    own = {kind: np.maximum(np.bincount(group, bins.n[kind], minlength=size), 1) for kind in (GOOD, BAD)}
    bend = {GOOD: curve.sum(1) / own[GOOD], BAD: curve.sum(0) / own[BAD]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1 + d + 2 * size, d))
        for batch in batches:
            u, label = _scaled(batch, centre, inverse)
            scores = u @ weights
            at = np.minimum(np.searchsorted(index, np.floor(scores / width).astype(np.int64)), len(index) - 1)
            off = np.clip(scores - middle[at], -width / 2, width / 2)
            for kind, sign in ((GOOD, -1), (BAD, 1)):
                these = np.flatnonzero(label == kind)
                these = these[np.argsort(group[at[these]], kind="stable")]
                if len(these):
                    v, b = u[these], at[these]
                    out[0] += sign * (lost[kind][0, b] + lost[kind][1, b] * off[these]) @ v
                    out[1 : 1 + d] += (v * bend[kind][group[b], None]).T @ v
                    first = np.flatnonzero(np.concatenate([[True], group[b[1:]] != group[b[:-1]]]))
                    out[1 + d + kind * size + group[b[first]]] += np.add.reduceat(v, first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(list(out), pa.list_(pa.float64()))], names=["row", "x"])

    found = rows.mapInArrow(run, "row int, x array<double>").groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("x")).collect()
    total = np.array([r["x"] for r in sorted(found, key=lambda r: r["row"])])
    mean = {kind: total[1 + d + kind * size : 1 + d + (kind + 1) * size] / own[kind][:, None] for kind in (GOOD, BAD)}
    cross = mean[GOOD].T @ curve @ mean[BAD]
    return total[0], total[1 : 1 + d] - cross - cross.T


def fit(rows: DataFrame) -> np.ndarray:
    """Weights of the features ``x`` (arrays of one length) of rows with ``label`` 1 (good) or 0 (bad), of which there are both."""
    found = rows.groupBy("label").agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("m")).collect()
    kinds = {r["label"]: r["m"] for r in found}
    mean = {k: kinds[k]["mean"].toArray() for k in (GOOD, BAD)}
    spread = {k: kinds[k]["variance"].toArray() * (1 - 1 / kinds[k]["count"]) for k in (GOOD, BAD)}
    centre = (mean[GOOD] + mean[BAD]) / 2
    scale = np.sqrt(spread[GOOD] + spread[BAD] + (mean[GOOD] - mean[BAD]) ** 2)
    # a feature that is the same on all rows has no weight
    inverse = np.where(scale > 1e-9 * np.abs(centre), 1 / np.maximum(scale, 1e-300), 0)
    rows = rows.filter(F.col("label").isin(GOOD, BAD))
    weights = np.zeros(len(centre))
    bins = _bins(rows, centre, inverse, weights)
    loss, *sums = bins.sums()
    for _ in range(STEPS):
        gradient, curvature = _slopes(rows, centre, inverse, weights, bins, *sums)
        gradient = gradient + RIDGE * weights
        step = np.linalg.solve(curvature + RIDGE * np.eye(len(weights)), gradient)
        gain = float(gradient @ step) / 2
        if gain < ENOUGH:
            weights = weights - step
            break
        part, before = 1.0, loss + RIDGE / 2 * float(weights @ weights)
        while True:
            tried = weights - part * step
            bins = _bins(rows, centre, inverse, tried)
            loss, *sums = bins.sums()
            if loss + RIDGE / 2 * float(tried @ tried) <= before + 1e-7 or part < 1e-4:
                break
            part /= 2
        weights = tried
    return weights * inverse
