"""Quality rules as a learned decision list.

Sequential covering, as in RIPPER: a rule is a conjunction of thresholds on the ratios of ``statistics``; it grows on two
thirds of the labelled documents by the literal of largest FOIL gain until it covers no good document, is pruned on the
other third to its best prefix, and joins the list if it still holds there; what it covers is taken away and the next
rule is grown, until one doesn't hold.  The list becomes an ordered conditional expression that Spark evaluates on its own;
each rule reads as text.  What bounds a fit are its parameters: ``most`` labelled documents (chosen by hash, as rows of eleven
numbers), ``cuts`` thresholds tried for each ratio and class, and ``literals`` in a rule, so that it can be read.

Defined cases: null and empty texts have no words and fail the base rule; texts of any length are counted whole; without
labels, or with one kind only, the list is empty and keeps what the base rule keeps; of literals with equal gain the first in
the order of ratios and thresholds is taken, so equal rows and ties always give the same list; null ids stay; equal rows are
separate documents with equal results; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.labelled import sample
from millrace.llm.statistics import ratios, with_counts

#: Labelled documents that a fit may read, thresholds that are tried for each ratio, and literals of a rule.
MOST, CUTS, LITERALS = 16_384, 48, 4


def base_failed() -> Column:
    """Under ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    ratio: str
    above: bool
    cut: float

    def holds(self, column: np.ndarray) -> np.ndarray:
        return column >= self.cut if self.above else column < self.cut

    def __str__(self) -> str:
        return f"{self.ratio} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]

    def covers(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), bool)
        for x in self.literals:
            out &= x.holds(table[x.ratio])
        return out

    def condition(self) -> Column:
        out = F.lit(True)
        for x in self.literals:
            column = ratios()[x.ratio]
            out = out & ((column >= F.lit(x.cut)) if x.above else (column < F.lit(x.cut)))
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.literals)) + " -> drop"


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, cuts: int, most: int) -> Rule:
    inside, literals = np.ones(len(bad), bool), []
    while len(literals) < most and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, gain = None, 1e-9
        for name, column in table.items():
            values = np.unique(np.quantile(column[inside & bad], np.linspace(0, 1, cuts)))
            others = np.unique(np.quantile(column[inside & ~bad], np.linspace(0, 1, cuts)))
            for cut in np.unique(np.concatenate([values, (others[1:] + others[:-1]) / 2 if len(others) > 1 else others])):
                for above in (True, False):
                    x = Literal(name, above, float(cut))
                    on = x.holds(column) & inside
                    p, n = int((on & bad).sum()), int((on & ~bad).sum())
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = x, g
        if best is None:
            break
        literals.append(best)
        inside &= best.holds(table[best.ratio])
    return Rule(tuple(literals))


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        on = r.covers(table)
        p, n = int((on & bad).sum()), int((on & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    prefixes = [Rule(rule.literals[: k + 1]) for k in range(len(rule.literals))]
    return max(prefixes, key=lambda r: (worth(r), -len(r.literals)))


def learn(table: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, precision: float = 0.8, cuts: int = CUTS, literals: int = LITERALS) -> list[Rule]:
    """Rules for ``bad`` rows, in the order in which they apply; ``prune`` marks the rows that pruning is done on."""
    rules, left = [], np.ones(len(bad), bool)
    part = lambda where: ({k: v[where] for k, v in table.items()}, bad[where])
    while True:
        grown, pruned = part(left & ~prune), part(left & prune)
        if not grown[1].any():
            break
        rule = _grow(*grown, cuts, literals)
        if not rule.literals:
            break
        if len(pruned[1]):
            rule = _prune(rule, *pruned)
        on = rule.covers(table) & left
        hit = on & prune if (on & prune & bad).any() else on
        if not (on & bad).any() or (hit & bad).sum() < precision * hit.sum() or (on & bad).sum() < 2:
            break
        rules.append(rule)
        left &= ~on
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST, cuts: int = CUTS, literals: int = LITERALS) -> list[Rule]:
    """Rules for documents whose label is 0, from those that pass the base rule."""
    rows = with_counts(sample(docs, labels, label, most), "doc_id", "label").filter(~base_failed())
    names = list(ratios())
    # ``most`` rows of a dozen numbers
    held = rows.select("label", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), "doc_id", *[c.cast("double").alias(k) for k, c in ratios().items()]).toPandas().sort_values("doc_id", kind="stable")
    if held["label"].nunique() < 2:
        return []
    return learn({k: held[k].to_numpy() for k in names}, held["label"].to_numpy() == 0, held["fold"].to_numpy() == 0, cuts=cuts, literals=literals)


def kept(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: the first rule that holds decides, the default is to keep."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.condition(), F.lit(False))
    return out.otherwise(F.lit(True))


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, counts, base_failed, kept, rule): ``rule`` is the number of the rule that dropped the document."""
    reason = F.when(base_failed(), F.lit(0))
    for k, rule in enumerate(rules):
        reason = reason.when(rule.condition(), F.lit(k + 1))
    rows = with_counts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return rows.withColumns({"base_failed": base_failed(), "kept": kept(rules), "rule": reason})
