"""Quality classifier by Bradley-Terry ranking of document pairs.

Each preference pair holds a good and a bad document; the chance that the first wins is the logistic of the difference of
their scores, and scores are linear in features, so weights are a logistic regression without intercept on feature
differences.  The threshold is the quantile of the scores that leaves as many documents below as bear the bad label; scores
are moved so that this quantile is ``at`` on the logistic scale.

Fitting sees every labelled document and counts every pair of a good and a bad one (``pairwise``, which needs no row for a
pair).  Cuts of the features and the threshold are exact quantiles of all labelled documents.

Defined cases: null and empty texts are scored as a text of no words; texts of any length are counted whole; without labels
or with one kind only every score is ``at``; equal texts have equal scores, whatever their ids; null ids stay and are never
held out; equal rows are separate documents; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import pairwise
from millrace.llm.quantiles import quantiles
from millrace.llm.scratch import stored
from millrace.llm.statistics import COUNTS, ratios, with_counts

#: Where the ratios of the labelled documents are cut.
QUANTILES = (0.5, 0.75, 0.9, 0.97)


def cuts_of(rows: DataFrame) -> dict[str, list[float]]:
    """The distinct QUANTILES of each ratio over ``rows``."""
    return {k: sorted(set(v)) for k, v in quantiles(rows.select(*[c.cast("double").alias(k) for k, c in ratios().items()]), QUANTILES).items()}


def features(cuts: dict[str, list[float]]) -> list[Column]:
    """Each ratio on a scale where large amounts don't dominate, and how far and whether it is above each of its cuts."""
    out = []
    for name, r in ratios().items():
        out.append(F.log1p(r if name in ("words", "mean_word_length") else 20 * r))
        for cut in cuts[name]:
            out += [F.greatest(r - F.lit(cut), F.lit(0.0)), r > F.lit(cut)]
    return [c.cast("double") for c in out]


class Ranking:
    def __init__(self, cuts: dict[str, list[float]], weights: list[float], threshold: float):
        self.cuts, self.weights, self.threshold = cuts, weights, threshold

    def raw(self) -> Column:
        """One sum over arrays: as a chain of additions it would be too long to compile."""
        return F.aggregate(F.zip_with(F.array(*features(self.cuts)), F.array(*map(F.lit, self.weights)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)

    def score(self, at: float) -> Column:
        return 1 / (1 + F.exp(-(self.raw() - F.lit(self.threshold)) - F.lit(math.log(at / (1 - at)))))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, hash of the text, counts) of all documents, stored: fitting and scoring read these and no texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return stored(with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash")), "doc_id", "hash"), "counted")


def labelled(counts: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(counts, label int) of every id with a label, stored.

    A document with several labels takes the largest, and of several documents with one id the one whose text has the least
    hash counts, so an id on very many rows is one row here.  Null ids and labels are left out.
    """
    given = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    own = counts.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("hash", *COUNTS)).alias("x"))
    return stored(own.join(given, "doc_id").select(*[F.col("x")[c].alias(c) for c in COUNTS], "label"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    return fit_counted(counted(docs), labels, label)


def fit_counted(counts: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    rows = labelled(counts, labels, label)
    cuts = cuts_of(rows)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    if not good or not bad:
        return Ranking(cuts, [0.0] * len(features(cuts)), 0.0)
    weights = pairwise.fit(rows.select("label", F.array(*features(cuts)).alias("x"))).tolist()
    scores = stored(rows.select(Ranking(cuts, weights, 0.0).raw().alias("s")), "scores")
    # between the classes' neighbours at that quantile: the cut itself lies between two scores
    share = bad / (good + bad)
    return Ranking(cuts, weights, float(np.mean(quantiles(scores, [max(0.0, share - 0.5 / (good + bad)), min(1.0, share + 0.5 / (good + bad))])["s"])))


def apply(docs: DataFrame, ranking: Ranking, at: float = 0.7) -> DataFrame:
    """(doc_id, raw, score): the Bradley-Terry score, and moved to the logistic scale with the threshold at ``at``."""
    return apply_counted(with_counts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id"), ranking, at)


def apply_counted(counts: DataFrame, ranking: Ranking, at: float = 0.7) -> DataFrame:
    return counts.select("doc_id", ranking.raw().alias("raw"), ranking.score(at).alias("score"))
