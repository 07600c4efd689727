"""The ranking's fit takes every labelled document and every pair, against plain forms."""

import numpy as np
import pytest

import brute
from millrace.llm import pairwise, ranking, statistics
from millrace.llm.quantiles import quantiles


def logistic(x):
    return 1 / (1 + np.exp(-x))


def pull(x, good, weights):
    """Gradient of the mean loss over all pairs, ridge included, by the pairs themselves; in units of the features' differences."""
    a, b = x[good], x[~good]
    scale = np.sqrt(a.var(0) + b.var(0) + (a.mean(0) - b.mean(0)) ** 2)
    varies = scale > 0
    scale = np.where(varies, scale, 1)
    first, second = a @ weights, b @ weights
    lost_a, lost_b = np.zeros(len(a)), np.zeros(len(b))
    for k in range(0, len(a), 500):
        chance = logistic(second[None, :] - first[k : k + 500, None])
        lost_a[k : k + 500] = chance.sum(1)
        lost_b += chance.sum(0)
    return ((lost_b @ b - lost_a @ a) / (len(a) * len(b)) / scale + pairwise.RIDGE * weights * scale) * varies


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    ties = rng.integers(-3, 3, 5000).astype(float)
    wide = np.exp(rng.normal(0, 60, 5000)) * rng.choice([-1, 1], 5000)
    shares = [0, 0.031, 0.5, 0.75, 0.97, 1]
    df = spark.createDataFrame([(float(t), float(w), 2.5) for t, w in zip(ties, wide)], "ties double, wide double, same double").repartition(5)
    got = quantiles(df, shares)
    for name, values in (("ties", ties), ("wide", wide), ("same", np.full(5000, 2.5))):
        assert got[name] == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-9), name
    # 0.57 * 100 is computed as a little less than 57
    assert quantiles(spark.range(101).selectExpr("double(id) / 7 as x"), [0.57]) == {"x": [57 / 7]}
    assert quantiles(df.limit(0), shares) == {"ties": [], "wide": [], "same": []}


@pytest.mark.parametrize("far", [1, 3000])
def test_weights_of_all_pairs(spark, monkeypatch, far):
    """Also with more bins than allowed, with one feature that is constant, and with labels of neither kind."""
    if far > 1:
        monkeypatch.setattr(pairwise, "BINS", 900)
    rng = np.random.default_rng(far)
    x = rng.normal(0, 1, (3000, 4)) * [1, 50, 1e-3, 0] + [0, 1000, 0, 7]
    x[:5, 1] *= far
    good = rng.random(3000) < logistic(x @ [2, 0.02, 500, 0] - 20)
    rows = [(int(g), v) for g, v in zip(good, x.tolist())] + [(5, [9.0] * 4)] * 20
    weights = pairwise.fit(spark.createDataFrame(rows, "label int, x array<double>").repartition(3))
    assert weights[3] == 0 and np.abs(pull(x, good, weights)).max() < 1e-5


def test_fit_takes_every_labelled_document(spark):
    """20,000 labelled documents and all their pairs; every one moves cuts, weights and threshold."""
    rng = np.random.default_rng(8)
    words = np.array(["the", "Cats", "run,", "home.", "7", "#", "so!", "far"])
    texts = [" ".join(words[rng.integers(0, rng.integers(2, 9), rng.integers(1, 30))]) for _ in range(20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    counts = statistics.with_counts(docs, "doc_id").toPandas().sort_values("doc_id")
    ratios = brute.ratios({c: counts[c].to_numpy() for c in statistics.COUNTS})
    good = rng.random(20_000) < logistic(3 - 6 * ratios["symbols_per_word"] - 0.1 * ratios["words"] + rng.normal(0, 1, 20_000))
    labels = spark.createDataFrame([(k, int(g)) for k, g in enumerate(good)], "doc_id long, quality int")
    model = ranking.fit(docs, labels)
    features = []
    for name in statistics.ratios():
        r = ratios[name]
        cuts = np.unique(np.quantile(r, ranking.QUANTILES))
        assert model.cuts[name] == pytest.approx(cuts.tolist(), rel=1e-12), name
        features.append(np.log1p(r if name in ("words", "mean_word_length") else 20 * r))
        for cut in model.cuts[name]:
            features += [np.maximum(r - cut, 0), (r > cut).astype(float)]
    x = np.array(features).T
    assert np.abs(pull(x, good, np.array(model.weights))).max() < 1e-5
    raw, share, half = x @ model.weights, 1 - good.mean(), 0.5 / len(good)
    assert model.threshold == pytest.approx(np.quantile(raw, [share - half, share + half]).mean(), rel=1e-7)
