"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are lower-cased words and the beginnings of longer words (stems that take endings).  Those whose presence depends
on the label beyond chance, by a chi-squared test over the sample's distinct texts, make up the space, however many they
are; of a word and its beginnings that stand in the same documents only the longest counts.  Weights are (1 + ln tf) * idf
with the document frequency over all documents, vectors have length one.  The examples' postings stand in blocks of
``BLOCK`` examples, with the largest weight of each term in each block.  A text's sum of its weights times those maxima
bounds its cosine with all examples of a block; blocks whose bound is below the k-th best cosine found so far are never
opened, so the k nearest examples are exact.  They, and all others as near as the k-th, vote with the square of their
cosine, against a prior of ``PRIOR`` votes at the base rate.  The share of votes becomes a chance by a logistic curve, fitted
to the shares that the examples have when each is left out of its own vote.

The sample holds ``most`` labelled documents or nearly so, chosen by hash.  That bound is a parameter of the fit alone:
scoring covers all words of all texts.

Defined cases: null and empty texts, and texts without any of the terms, get the rate among the examples without any;
with labels of one kind only, every score is the smoothed rate, without any it is 0; neighbours that tie for the last place all vote, and of
those that tie for a place in the evidence the smaller doc_ids are named; texts of any length are scored whole; null ids
stay; equal rows are separate documents; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.labelled import sample
from millrace.llm.scratch import stored

MOST, NEAREST, BLOCK = 16_384, 15, 64
#: Occurrences that are bounded at once.
_AT_ONCE = 1 << 14
#: Bytes of text that are looked at together.
_BLOCK = 3 << 20
#: Cosines that differ by less are equal.
_TIE = np.float32(2e-6)
#: Weight of the shares as they are in the fit of the curve.
_PULL = 1.0
#: Examples whose votes are counted at once in the fit.
_EXAMPLES = 256
#: Texts with a block each that are opened at once: what they hold is bounded by the postings of so many blocks.
_PAIRS = 1024
#: Votes that the base rate has.
PRIOR = 0.3
#: Lengths, in characters, of the beginnings of words that count as terms; such a term ends in "*".
_STEMS = range(3, 9)
_EVIDENCE = "array<struct<doc_id: bigint, similarity: double, label: int>>"
#: ASCII characters that are no part of a word at its ends.
_EDGES = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


def _terms_of(word: bytes) -> list[bytes]:
    text = word.decode()
    return [word, *(text[:k].encode() + b"*" for k in _STEMS if k < len(text))]


def _all_terms(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word, term) of all terms of the words, by word, and the terms."""
    number: dict[bytes, int] = {}
    found, n = [], np.zeros(len(words), np.int64)
    for k, word in enumerate(words.cast(pa.binary()).to_pylist()):
        own = [number.setdefault(t, len(number)) for t in _terms_of(word)] if word else []
        found += own
        n[k] = len(own)
    return np.repeat(np.arange(len(words)), n), np.array(found, np.int64), list(number)


def _known_terms(words: pa.Array, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, term) of the known terms of the words, by word: words and beginnings of one length are looked up together."""
    length, rows, terms = pc.utf8_length(words), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in (None, *_STEMS):
        # a word that ends in * itself isn't a beginning: edges are taken off
        names = [t for t in known if t.endswith(b"*") and len(t.decode()) == k + 1] if k else [t for t in known if not t.endswith(b"*")]
        if not names:
            continue
        cut = words if k is None else pc.if_else(pc.greater(length, k), pc.utf8_slice_codeunits(words, 0, k), None)
        place = pc.index_in(cut, pa.array([t.decode().removesuffix("*") for t in names], pa.string()), skip_nulls=True)
        hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        rows.append(hit)
        terms.append(np.array([known[t] for t in names], np.int64)[place.take(pa.array(hit)).to_numpy(zero_copy_only=False)])
    row, term = np.concatenate(rows), np.concatenate(terms)
    order = np.argsort(row, kind="stable")
    return row[order], term[order]


def _occurrences(texts: pa.Array, known: dict[bytes, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, term, times) of all terms of all texts by text and term, and the terms; only ``known`` ones if given."""
    words = blocks.split(texts, blocks.NON_SPACE, blocks.LOWER)
    which, distinct = words.encoded()
    bare = pc.utf8_trim(distinct.cast(pa.string()), characters=_EDGES)
    row, of_word, terms = _all_terms(bare) if known is None else (*_known_terms(bare, known), list(known))
    n = np.bincount(row, minlength=len(distinct))
    first = np.cumsum(n) - n
    term = of_word[blocks.ragged(first[which], n[which])]
    pairs = np.sort(np.repeat(words.text_of_word(), n[which]) * max(len(terms), 1) + term)
    fresh = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    times = np.diff(np.append(fresh, len(pairs)))
    return pairs[fresh] // max(len(terms), 1), pairs[fresh] % max(len(terms), 1), times, terms


def longest(counts: dict[bytes, tuple]) -> list[bytes]:
    """The terms without beginnings whose documents are those of a longer term; as these hold the longer term's, equal counts tell."""
    gone = set()
    for term, n in counts.items():
        text = term.removesuffix(b"*").decode()
        gone.update(b for k in _STEMS if k < len(text) and counts.get(b := text[:k].encode() + b"*") == n)
    return [t for t in counts if t not in gone]


def choose_terms(examples: DataFrame) -> list[bytes]:
    """The terms that tell the labels apart, over examples (text, label)."""
    n1, n0 = (int(x or 0) for x in examples.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not n1 or not n0:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", _BLOCK):
            text, term, _, terms = _occurrences(batch.column(0), None)
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[text]
            both = [pa.array(np.bincount(term[label == k], minlength=len(terms))) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *both], names=["term", "a", "b"])

    counts = examples.select("text", "label").mapInArrow(count, "term binary, a long, b long").groupBy("term").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    n = n1 + n0
    rest = F.col("a") + F.col("b")
    chi = n * F.pow(F.col("a") * n0 - F.col("b") * n1, 2) / (rest * (n - rest) * n1 * n0)
    tested = stored(counts.filter(rest >= 2), "terms")
    # a level at which chance alone passes less than one term in all
    level = 2.5 * math.log(max(tested.count(), 2))
    best = tested.filter(rest < n).withColumn("chi", chi).filter(F.col("chi") >= level).orderBy(F.desc("chi"), "term").collect()
    return longest({bytes(r["term"]): (r["a"], r["b"]) for r in best})


def weighted(docs: DataFrame, terms: list[bytes]) -> list[tuple[bytes, float]]:
    """(term, idf) by the document frequency of each term over all rows of ``docs``."""
    if not terms:
        return []
    number = {t: k for k, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(number) + 1, np.int64)  # the last is that of all rows
        for batch in blocks.slices(batches, "text", _BLOCK):
            n[:-1] += np.bincount(_occurrences(batch.column(0), number)[1], minlength=len(number))
            n[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r["term"]: r["n"] for r in rows}
    return [(t, math.log((1 + n.get(len(terms), 0)) / (1 + n.get(k, 0))) + 1) for t, k in number.items()]


class Index:
    """Block-max inverted index of the examples; all examples without any term are left as a rate."""

    def __init__(self, terms: list[tuple[bytes, float]], rows: list[tuple[int, int, list[int], list[int]]]):
        """rows: (doc_id, label, terms, times) of each example."""
        self.number = {t: k for k, (t, _) in enumerate(terms)}
        self.idf = np.array([w for _, w in terms], np.float64)
        full = [r for r in rows if r[2]]
        bare = [r[1] for r in rows if not r[2]]
        self.rate = (sum(r[1] for r in rows) + 0.5) / (len(rows) + 1) if rows else 0.0
        self.bare = (sum(bare) + self.rate) / (len(bare) + 1)
        weights = [self._unit(np.array(t), np.array(n)) for _, _, t, n in full]
        # like stands by like, so that a block's maxima say something about its examples
        order = sorted(range(len(full)), key=lambda k: (full[k][2][int(np.argmax(weights[k]))], full[k][2], full[k][0]))
        self.ids = np.array([full[k][0] for k in order], np.int64)
        self.labels = np.array([full[k][1] for k in order], np.int64)
        n_blocks = -(-len(full) // BLOCK)
        term = np.array([t for k in order for t in full[k][2]], np.int64)
        weight = np.concatenate([weights[k] for k in order]).astype(np.float32) if full else np.zeros(0, np.float32)
        spot = np.repeat(np.arange(len(full)), [len(full[k][2]) for k in order])
        #: The examples' occurrences: example, term, times.
        self.rows = spot, term, np.array([x for k in order for x in full[k][3]], np.int64)
        self.slope, self.shift = 1.0, 0.0
        cell = term * n_blocks + spot // BLOCK
        by_cell = np.argsort(cell, kind="stable")
        #: The postings of term t in block b stand at first[t * n_blocks + b] up to the next.
        self.first = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(terms) * n_blocks))]).astype(np.int32)
        self.spot, self.weight = (spot[by_cell] % BLOCK).astype(np.uint8), weight[by_cell]
        self.most = np.zeros((len(terms), n_blocks), np.float32)
        np.maximum.at(self.most.reshape(-1), cell, weight)

    @property
    def postings(self) -> np.ndarray:
        """The postings as a dense array (term, block, example), for tests."""
        out = np.zeros((self.most.size, BLOCK), np.float32)
        out[np.repeat(np.arange(self.most.size), np.diff(self.first)), self.spot] = self.weight
        return out.reshape(*self.most.shape, BLOCK)

    def _unit(self, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.idf[term]
        return w / np.sqrt((w * w).sum())

    def nearest(self, owner: np.ndarray, term: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(texts with any term, their k best cosines, the examples, votes), from sorted occurrences; -1 where there are fewer."""
        w = (1 + np.log(times)) * self.idf[term]
        texts, first, n = np.unique(owner, return_index=True, return_counts=True)
        w = (w / np.repeat(np.sqrt(np.add.reduceat(w * w, first)), n)).astype(np.float32) if len(texts) else w
        n_blocks = self.most.shape[1]
        best = np.full((len(texts), k), -1.0, np.float32)
        which = np.full((len(texts), k), -1, np.int64)
        if not len(texts) or not n_blocks:
            return texts, best, which, np.zeros((len(texts), 2))
        bound, at = np.empty((len(texts), n_blocks), np.float32), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(first, first[at] + _AT_ONCE)))
            end = first[to] if to < len(texts) else len(term)
            bound[at:to] = np.add.reduceat(w[first[at] : end, None] * self.most[term[first[at] : end]], first[at:to] - first[at], axis=0) + np.float32(1e-5)
            at = to
        order = np.argsort(-bound, axis=1, kind="stable")
        for step in range(n_blocks):
            block = order[:, step]
            reach = bound[np.arange(len(texts)), block]
            open_ = np.flatnonzero((reach >= best[:, -1]) & (reach > 2e-5))
            if not len(open_):
                break
            for at in range(0, len(open_), _PAIRS):
                rows = open_[at : at + _PAIRS]
                score, example = self._opened(block[rows], term, w, first[rows], n[rows])
                both, names = np.concatenate([best[rows], score], axis=1), np.concatenate([which[rows], np.where(score > 0, example, -1)], axis=1)
                # which of equal ones is named makes no difference to the votes
                tie = np.where(names >= 0, self.ids[names], np.iinfo(np.int64).max)
                take = np.lexsort((tie, -both), axis=1)[:, :k]
                best[rows], which[rows] = np.take_along_axis(both, take, 1), np.take_along_axis(names, take, 1)
        return texts, best, which, self._votes(bound, best[:, -1], term, w, first, n)

    def _opened(self, block: np.ndarray, term: np.ndarray, w: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosine of each text with each example of its block, -1 without a term in common; the examples)."""
        spots = blocks.ragged(first, n)
        cell = term[spots] * self.most.shape[1] + np.repeat(block, n)
        size = self.first[cell + 1] - self.first[cell]
        found = blocks.ragged(self.first[cell].astype(np.int64), size.astype(np.int64))
        place = np.repeat(np.repeat(np.arange(len(block)) * BLOCK, n), size) + self.spot[found]
        score = np.bincount(place, np.repeat(w[spots], size) * self.weight[found], len(block) * BLOCK).reshape(-1, BLOCK).astype(np.float32)
        example = block[:, None] * BLOCK + np.arange(BLOCK)
        score[(score <= 0) | (example >= len(self.ids))] = -1
        return score, np.minimum(example, len(self.ids) - 1)

    def _votes(self, bound: np.ndarray, least: np.ndarray, term: np.ndarray, w: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(votes for label 1, votes in all) of each text: of all examples as near as its k-th, so that ties all count."""
        votes = np.zeros((len(least), 2))
        rows, block = np.nonzero((bound >= least[:, None] - _TIE) & (bound > 2e-5))
        for at in range(0, len(rows), _PAIRS):
            own, opened = rows[at : at + _PAIRS], block[at : at + _PAIRS]
            score, example = self._opened(opened, term, w, first[own], n[own])
            vote = np.where((score > 0) & (score >= least[own][:, None] - _TIE), score.astype(np.float64) ** 2, 0.0)
            np.add.at(votes, own, np.stack([(vote * self.labels[example]).sum(axis=1), vote.sum(axis=1)], axis=1))
        return votes

    def _share(self, votes: np.ndarray) -> np.ndarray:
        return (votes[:, 0] + PRIOR * self.rate) / (votes[:, 1] + PRIOR)

    def _chance(self, votes: np.ndarray) -> np.ndarray:
        share = self._share(votes)
        return 1 / (1 + np.exp(-(self.slope * np.log(share / (1 - share)) + self.shift)))

    def calibrate(self, k: int) -> None:
        """Fits the curve from shares of votes to chances, on the examples, each without its own vote."""
        if not len(self.ids) or self.labels.min() == self.labels.max():
            return
        owner, term, times = self.rows
        votes = np.zeros((len(self.ids), 2))
        for at in range(0, len(votes), _EXAMPLES):  # all at once would take some 400 MB
            a, b = np.searchsorted(owner, [at, at + _EXAMPLES])
            votes[at : at + _EXAMPLES] = self.nearest(owner[a:b] - at, term[a:b], times[a:b], k + 1)[3]
        left = np.maximum(votes - np.stack([self.labels, np.ones(len(self.labels))], axis=1), 0)
        share = self._share(left)
        x, n1 = np.log(share / (1 - share)), self.labels.sum()
        # labels drawn in from 0 and 1 as by Platt, and a slight pull toward the shares as they are
        y = np.where(self.labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(self.labels) - n1 + 2))
        design, at = np.stack([x, np.ones(len(x))], axis=1), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ at))
            gradient = design.T @ (p - y) + _PULL * (at - (1, 0))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + _PULL * np.eye(2), gradient)
            at = at - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(float(at[0]), 0.1), float(at[1])

    def score(self, texts: pa.Array, k: int) -> tuple[np.ndarray, list[list[dict]]]:
        """(score of each text, its three nearest examples)."""
        out, evidence = np.full(len(texts), self.bare), [[] for _ in range(len(texts))]
        owner, term, times, _ = _occurrences(texts, self.number)
        rows, best, which, votes = self.nearest(owner, term, times, k)
        if len(rows):
            out[rows] = self._chance(votes)
            for r, b, e in zip(rows.tolist(), best[:, :3].tolist(), which[:, :3].tolist()):
                evidence[r] = [{"doc_id": int(self.ids[x]), "similarity": float(s), "label": int(self.labels[x])} for s, x in zip(b, e) if x >= 0]
        return out, evidence


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST, k: int = NEAREST) -> Index:
    every = sample(docs, labels, label, most)
    # copies count once, else a group of copies makes its own words look telling
    examples = stored(every.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).drop("h"), "examples")
    terms = weighted(docs, choose_terms(examples))
    number = {t: k for k, (t, _) in enumerate(terms)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", _BLOCK):
            owner, term, times, _ = _occurrences(batch.column(0), number)
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(first, pa.array(x.astype(np.int32))) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *lists], names=["doc_id", "label", "terms", "times"])

    rows = examples.select("text", "doc_id", "label").mapInArrow(vectors, "doc_id long, label int, terms array<int>, times array<int>").collect()  # ``most`` rows of the chosen terms in each
    index = Index(terms, sorted((r["doc_id"], r["label"], list(r["terms"]), list(r["times"])) for r in rows))
    index.calibrate(k)
    blocks.give_back()
    return index


def apply(docs: DataFrame, index: Index, k: int = NEAREST) -> DataFrame:
    """(doc_id, score, evidence) of each row: the chance of label 1, and the three nearest examples."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        for batch in blocks.slices(batches, "text", _BLOCK):
            scores, evidence = sent.value.score(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, score double, evidence {_EVIDENCE}")


def without_toxic(docs: DataFrame, index: Index, cut: float = 0.5, k: int = NEAREST) -> DataFrame:
    """The rows of ``docs`` (column ``text`` and any others) whose score is below ``cut``."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", _BLOCK):
            scores, _ = sent.value.score(batch.column(batch.schema.get_field_index("text")), k)
            yield batch.filter(pa.array(scores < cut))

    return docs.mapInArrow(run, docs.schema)
