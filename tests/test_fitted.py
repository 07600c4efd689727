"""Encoders on rows and streams they were not fitted on, phrases, correlations and a connection."""

import collections
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import sources
from millrace.operators import correlation, encoders, phrases, prefix, sentiment, stats


@pytest.fixture(scope="module")
def train(spark):
    rows = [("b", 2, 10.0), ("a", 10, 20.0), ("a", 2, 30.0), (None, 3, None), ("c", None, 50.0), ("a", 3, 50.0)]
    return spark.createDataFrame(rows, "k string, n int, v double").repartition(3)


@pytest.fixture(scope="module")
def other(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "new", 4), (3, None, None), (4, "c", 2), (5, "also", 3)], "id int, k string, n int")


def by_id(df, *names):
    return {r["id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_codes_of_other_rows(train, other):
    codes = encoders.fit_codes(train, ["k", "n"])
    assert {(r["column"], r["value"]): r["code"] for r in codes.collect()} == {("k", "a"): 0, ("k", "b"): 1, ("k", "c"): 2, ("n", "2"): 0, ("n", "3"): 1, ("n", "10"): 2}
    null = encoders.encode(other, codes, {"k": "kc", "n": "nc"})
    assert null.columns == ["id", "k", "n", "kc", "nc"]
    assert by_id(null, "kc", "nc") == {1: (0, 2), 2: (None, None), 3: (None, None), 4: (2, 0), 5: (None, 1)}
    kept = encoders.encode(other, codes, {"k": "kc", "n": "nc"}, unseen="keep")
    assert by_id(kept, "kc", "nc") == {1: (0, 2), 2: (3, 3), 3: (None, None), 4: (2, 0), 5: (3, 1)}
    nothing = encoders.fit_codes(train.limit(0), ["k"])
    assert by_id(encoders.encode(other, nothing, {"k": "kc"}, unseen="keep"), "kc") == {1: (0,), 2: (0,), 3: (None,), 4: (0,), 5: (0,)}
    with pytest.raises(ValueError):
        encoders.encode(other, codes, {"k": "kc"}, unseen="x")


def test_codes_of_many_values(spark):
    """Numbers run on over ranges, whatever their number."""
    df = spark.range(5000).select((F.col("id") * 7919 % 3001).alias("v")).repartition(7)
    got = {int(r["value"]): r["code"] for r in encoders.fit_codes(df, ["v"]).collect()}
    assert got == {k: k for k in range(3001)}


def test_bounds_of_other_rows(spark, train):
    bounds = encoders.fit_bounds(train.withColumn("same", F.lit(4)), ["v", "same"])
    df = spark.createDataFrame([(1, 30.0, 4), (2, 100.0, 9), (3, -10.0, None), (4, None, 4)], "id int, v double, same int")
    assert by_id(encoders.scale(df, bounds, {"v": "a", "same": "b"}), "a", "b") == {1: (0.5, 0.0), 2: (2.25, 0.0), 3: (-0.5, None), 4: (None, 0.0)}
    assert by_id(encoders.scale(df, bounds, {"v": "a"}, clip=True), "a") == {1: (0.5,), 2: (1.0,), 3: (0.0,), 4: (None,)}
    assert by_id(encoders.scale(df, encoders.fit_bounds(train.limit(0), ["v"]), {"v": "a"}), "a") == {k: (None,) for k in range(1, 5)}


def test_names_of_other_rows(train, other):
    names = encoders.fit_names(train, "k", "v", 30, 2)
    assert [(r["name"], r["n"]) for r in names.collect()] == [("a", 3)]
    assert by_id(encoders.top_or_other(other, names, "k"), "group_name") == {1: ("a",), 2: ("other",), 3: ("other",), 4: ("other",), 5: ("other",)}


def test_stored_encoders_on_a_stream(spark, train, other, tmp_path):
    """What was fitted and stored encodes the rows of a stream as it does those of a table."""
    for name, encoder in (("codes", encoders.fit_codes(train, ["k"])), ("bounds", encoders.fit_bounds(train, ["n"]))):
        encoders.save(encoder, f"file://{tmp_path}/{name}")
    codes, bounds = (encoders.load(spark, f"file://{tmp_path}/{name}") for name in ("codes", "bounds"))
    other.repartition(2).write.parquet(f"file://{tmp_path}/in")
    encoded = lambda df: encoders.scale(encoders.encode(df, codes, {"k": "kc"}, unseen="keep"), bounds, {"n": "s"})
    stream = encoded(spark.readStream.schema(other.schema).parquet(f"file://{tmp_path}/in"))
    name = f"s{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert by_id(spark.table(name), "kc", "s") == by_id(encoded(other), "kc", "s")


# sums before


def test_sums_before(spark):
    rng = random.Random(6)
    rows = [(g, k, rng.randrange(5)) for g, n in (("hot", 3000), ("b", 3), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = {(r.g, r.k): r.s for r in prefix.before(df, ["g"], ["k"], "v", "s").collect()}
    sums = collections.Counter()
    for g, k, v in sorted(rows):
        assert got[g, k] == sums[g]
        sums[g] += v


# correlation


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(400, 6)) * 3)
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=400)
    x[:, 4], x[:200, 5] = 7.25, np.nan
    gaps = rng.random((400, 6)) < 0.3
    gaps[:, 4] = False
    rows = [[None if g else float(v) for v, g in zip(r, gap)] for r, gap in zip(x, gaps)]
    names = [f"c{k}" for k in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    x[gaps] = np.nan

    def ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    for got, change in ((correlation.pearson(df, names), lambda v: v), (correlation.pearson(df, names, most=7), lambda v: v), (correlation.spearman(df, names), ranks)):
        found = {(r.col_i, r.col_j): (r.n, r.r) for r in got.collect()}
        assert len(found) == 15
        for (i, j), (n, r) in found.items():
            a, b = x[:, int(i[1])], x[:, int(j[1])]
            both = ~np.isnan(a) & ~np.isnan(b)
            assert n == both.sum() and int(i[1]) > int(j[1])
            if "c4" in (i, j):
                assert r is None
            else:
                assert abs(r - np.corrcoef(change(a[both]), change(b[both]))[0, 1]) < 1e-5
    assert correlation.pearson(df, names[:1]).count() == 0 == correlation.spearman(df, names[:1]).count()
    assert {r.n for r in correlation.pearson(df.limit(0), names).collect()} == {0} == {r.n for r in correlation.spearman(df.limit(0), names).collect()}


def test_large_and_shifted_values(spark):
    """A mean far from zero and huge scales cost no digits."""
    df = spark.range(1000).select((F.col("id") + 1e12).alias("a"), (F.col("id") * 1e200).alias("b"), (F.col("id") * -1e-200).alias("c"))
    assert {(r.col_i, r.col_j): r.r for r in correlation.pearson(df, ["a", "b", "c"]).collect()} == {("b", "a"): 1.0, ("c", "a"): -1.0, ("c", "b"): -1.0}


def test_many_columns_take_the_gramian(spark):
    df = spark.range(50).select(*[(F.col("id") * (k + 1) % 17).alias(f"c{k}") for k in range(stats.MANY + 1)])
    few = {(r.col_i, r.col_j): r.r for r in stats.pearson(df, ["c0", "c1", "c5"]).collect()}
    many = {(r.col_i, r.col_j): r.r for r in stats.pearson(df, df.columns).collect()}
    assert len(many) == 31 * 30 // 2 and all(abs(many[p] - r) < 2e-6 for p, r in few.items())


# phrases

LEXICON = [("a", 1.0), ("b", -2.0), ("a b", 3.0), ("A, c", 0.0), ("b c", -0.5), ("a b a", 4.0), ("c c c", 5.0), ("...", 9.0), ("b  c", -0.25)]


def plain_matches(text, lexicon):
    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
    known = {}
    for entry, v in lexicon:
        own = tuple(w for w in re.split(r"[\W\d_]+", entry.lower()) if w)
        if own:
            known[own] = max(v, known.get(own, v))
    out, k = [], 0
    while k < len(words):
        n = max((n for n in range(1, 5) if tuple(words[k : k + n]) in known and len(words[k : k + n]) == n), default=0)
        if n:
            out.append((k, n, known[tuple(words[k : k + n])]))
        k += n or 1
    return len(words), out


@pytest.mark.parametrize("few", [10_000, 2])
def test_phrases_that_overlap(spark, monkeypatch, few):
    monkeypatch.setattr(phrases, "FEW", few)  # in the plan or in a table
    rng = random.Random(8)
    texts = ["a b a b c", "a b c", "c c c c", "A-b. A", "", None, "d d", "b c a c"] + [" ".join(rng.choice("abcd") for _ in range(rng.choice([1, 4, 30]))) for _ in range(200)]
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    df = spark.createDataFrame([*enumerate(texts), (None, "a b"), (0, "c a")], "k int, t string").repartition(3)
    got = [(r.k, r.n, tuple(map(tuple, r.taken))) for r in phrases.matches(df, "k", "t", lexicon).collect()]
    want = [(k, n, tuple(m)) for k, t in [*enumerate(texts), (None, "a b"), (0, "c a")] for n, m in [plain_matches(t or "", LEXICON)] if m]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_phrase_scores(spark):
    lexicon = spark.createDataFrame([("not bad", 1.0), ("bad", -2.0), ("very", 0.0)], "token string, valence double")
    df = spark.createDataFrame([(1, "Not bad, very not bad day"), (2, "bad")], "k int, t string")
    got = {r.k: r for r in phrases.score(df, "k", "t", lexicon).collect()}
    # four units: two phrases, and "very" and "day" without valence
    assert (got[1].n_hits, got[1].total, got[1].pos, got[1].neu, got[1].neg) == (3, 2.0, round(4 / 6, 3), round(2 / 6, 3), 0.0)
    assert (got[2].total, got[2].neg) == (-2.0, 1.0)
    probed = {r.phrase: r.total for r in phrases.probe(df, "t", lexicon).collect()}
    assert probed == {"not bad, very not bad day": 2.0, "bad": -2.0}


def test_single_words_score_as_before(spark):
    lexicon = spark.createDataFrame([("a", 1.5), ("b", -1.0)], "token string, valence double")
    df = spark.createDataFrame([(1, "a b c a"), (2, "b"), (None, "a a")], "k int, t string")
    same = [sorted(map(repr, f(df, "k", "t", lexicon).collect())) for f in (phrases.score, sentiment.lexicon_score)]
    assert same[0] == same[1]


# connection


def test_ranges_from_the_data(spark):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    url = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true"
    spark.range(1000, 1200).select("id", (F.col("id") * 2).alias("v")).coalesce(1).write.jdbc(url, "numbers", properties={"driver": driver})
    table = sources.read_jdbc_by_range(spark, url, "numbers", "id", 4, driver=driver)
    assert [len(p) for p in table.rdd.glom().collect()] == [50] * 4 and table.count() == 200
    spark.range(0).select("id").write.jdbc(url, "nothing", properties={"driver": driver})
    assert sources.read_jdbc_by_range(spark, url, "nothing", "id", 4, driver=driver).count() == 0
