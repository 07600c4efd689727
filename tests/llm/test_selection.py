"""Resampling, sharding and hard negatives beyond their queries."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from millrace.llm import negatives, resampling, sharding
from millrace.llm.scratch import new_path
from test_operators import pairs, same

# resampling


def test_xxh64_of_ranges():
    rng = random.Random(3)
    texts = [rng.randbytes(n) for n in [*range(40), *range(40), 100, 1000]]
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    lengths = np.array([len(t) for t in texts])
    assert resampling.xxh64(data, np.cumsum(lengths) - lengths, lengths).tolist() == [xxhash.xxh64_intdigest(t) for t in texts]


@pytest.mark.parametrize("collide", [False, True])
def test_table_interns_by_bytes(monkeypatch, collide):
    """Slots stand for byte strings, also where all keys collide and only bytes tell them apart."""
    if collide:
        monkeypatch.setattr(resampling, "xxh64", lambda data, starts, lengths: np.full(len(starts), 7, np.uint64))
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 2, 3, 8, 9, 17, 70, 200]))) for _ in range(400)]
    texts += [t[:-1] + b"c" for t in texts if len(t) > 60]
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    lengths = np.array([len(t) for t in texts])
    table = resampling.interned(data, np.cumsum(lengths) - lengths, lengths, 1000)
    by_slot = {}
    for t, s in zip(texts, table.slot.tolist()):
        assert by_slot.setdefault(s, t) == t
    assert len(by_slot) == len(set(texts)) == (table.owner >= 0).sum()
    assert all(table.count[s] == texts.count(t) for s, t in by_slot.items())


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling_with_runs(spark, docs, runs):
    target = spark.createDataFrame([("the quick naïve fox",), (None,), ("",)], "text string")
    gain = resampling.gains(resampling.bucket_counts(docs, runs=runs, buckets=500), resampling.bucket_counts(target, runs=runs, buckets=500), 500)
    got = resampling.ranked(resampling.scores(docs, gain, runs, 7), 33, 5).select("doc_id", "n_features", "weight", "score", "rank").collect()
    same([tuple(r) for r in got], brute.resampled(pairs(docs), [r["text"] for r in target.collect()], runs, 500, 33, 5, 7))


def test_resampled_rows(spark, docs):
    target = spark.createDataFrame([("the quick fox",)], "text string")
    drawn = {r[0] for r in brute.resampled(pairs(docs), ["the quick fox"], percent=50) if r[4]}
    got = resampling.resampled(docs, target, percent=50)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == drawn
    assert resampling.resampled(docs.limit(0), target).count() == 0


# sharding


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_moves_by_one_step(spark, n, bits):
    points = spark.range(1 << n * bits).select(*[F.expr(f"shiftright(id, {bits * k}) & {(1 << bits) - 1}").alias(f"c{k}") for k in range(n)])
    rows = points.select(sharding.hilbert([F.col(c) for c in points.columns], bits).alias("place"), "*").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:])) == 1 for x, y in zip(rows, rows[1:]))


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_laws_and_manifest(spark, docs, law):
    files = sharding.write(docs, new_path(spark, "t"), 5, law)
    same([tuple(r) for r in files.select("row.*").collect()], [tuple(r) for r in docs.collect()])
    rows = files.select("shard", "slot", "curve", "row").collect()
    keyed = [r for r in rows if r["row"]["doc_id"] is not None]
    if law == "rows":
        counts = [sum(r["shard"] == k for r in rows) for k in range(5)]
        repeated = 2  # rows equal in id and text stay together
        assert max(counts) - min(counts) <= 1 + repeated
    ordered = sorted(keyed, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in ordered)
    found = sharding.manifest(files, ("source", "n_chars"))
    for wanted in ({"source": ("src3", "src3")}, {"n_chars": (100, 300), "source": ("src1", "src2")}, {"n_chars": (10**6, 10**7)}):
        hit = {r["shard"] for r in rows if all(r["row"][d] is not None and a <= r["row"][d] <= b for d, (a, b) in wanted.items())}
        assert hit <= {r["shard"] for r in sharding.touched(found, wanted).collect()}


def test_rows_law_is_exact(spark):
    table = spark.range(103).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), (F.col("id") % 3).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(float("nan")).alias("n_chars"))
    files = sharding.write(table, new_path(spark, "t"), 16, "rows")
    counts = [r["count"] for r in files.groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) == 1 and sum(counts) == 103


def test_more_shards_than_rows_and_no_rows(spark, docs):
    few = docs.filter("doc_id < 5")
    assert sharding.report(few).select("doc_id").distinct().count() == 5
    assert sharding.report(docs.limit(0)).count() == 0


def test_files_leave_out_most(spark):
    """With three independent dimensions, a range of any of them touches well under all shards."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)).alias(d) for k, d in enumerate(("a", "b", "c"))])
    found = sharding.manifest(sharding.write(rows, new_path(spark, "t"), 64, "rows", ("a", "b", "c")), ("a", "b", "c"))
    for d in ("a", "b", "c"):
        assert sharding.touched(found, {d: (100, 150)}).count() <= 24


# hard negatives


def vectors(rng, n, d, labels, spread=3.0):
    return [(k, int(rng.integers(labels)), [int(x) for x in np.round(rng.normal(size=d) * spread)]) for k in range(n)]


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, "id long, label long, vec array<long>").repartition(3)
    return [tuple(r) for r in negatives.mined(table, F.col("id") % 50 == 0, **options).collect()]


@pytest.mark.parametrize(("n", "d", "labels", "spread"), [(700, 8, 3, 3.0), (500, 2, 2, 1.0), (300, 1, 40, 2.0), (120, 5, 1, 2.0)])
def test_negatives_against_all_rows(spark, n, d, labels, spread):
    """Ties by the hundred, labels of a few rows, and trees small enough to have many."""
    rows = vectors(np.random.default_rng(n), n, d, labels, spread)
    same(mined(spark, rows, sizes=(64, 64), per_cell=5), brute.negatives(rows))


def test_negatives_of_odd_rows(spark):
    """Repeated rows, copies under other ids, null ids, one id twice, vectors of several lengths, and numbers up to 2^30."""
    rng = np.random.default_rng(8)
    rows = vectors(rng, 200, 3, 3)
    copies = [(1000 + k, k % 2, [2, 2, 2]) for k in range(300)]
    odd = [(50, 1, [9, 9, 9]), (50, 2, [9, 9, 9]), (50, 1, [9, 9, 9]), (None, 1, [8, 8, 8]), (None, 2, [3, 3, 3]), (7, 0, [1]), (8, 2, []), (100, 1, [1 << 30, 0, -(1 << 29)]), (101, 1, [1 << 30, 5, 7]), (102, 2, [1 << 29, 5, 7]), (103, 0, [(1 << 30) - 1, 1, 1])]
    padded = [(i, l, v + [0] * (3 - len(v))) for i, l, v in [*rows, *copies, *odd]]
    same(mined(spark, [*rows, *copies, *odd, *rows[:20]], sizes=(64, 64)), brute.negatives(padded))


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [nan, 0.0], 1), (2, [inf, 0.0], 1), (3, [None, 0.0], 1), (4, None, 1), (5, [1.0, 1.0], None), (6, [1e12, 0.0], 1), (8, [-0.001, 0.999], 1), (9, [], 2)]
    got = negatives.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    same([(r["id"], r["label"], tuple(r["vec"])) for r in got], [(0, 1, (256, 128)), (8, 1, (-1, 255)), (9, 2, ())])


def test_bounds_hold_and_are_met():
    rng = np.random.default_rng(9)
    rows, queries = rng.integers(-9, 9, (50, 4)), rng.integers(-9, 9, (20, 4))
    low, high = rows.min(axis=0, keepdims=True), rows.max(axis=0, keepdims=True)
    least, most = negatives.bounds(queries, low, high)
    corners = np.array(np.meshgrid(*zip(low[0], high[0]))).reshape(4, -1).T
    assert (least[:, 0] == (queries @ corners.T).min(axis=1)).all() and (most[:, 0] == (queries @ corners.T).max(axis=1)).all()


def test_search_opens_few_boxes():
    """On clustered vectors the queue leaves most leaves closed."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(64, 6)) * 400
    vecs = np.round(np.repeat(centres, 200, axis=0) + rng.normal(size=(12_800, 6)) * 5).astype(np.int64)
    order, first = negatives.packed_order(vecs, np.zeros(len(vecs), np.int64), leaf=128)
    tree = negatives.tree_of(order, np.ones(len(vecs), bool), vecs[order], first, np.zeros(len(first) - 1, np.int64))
    both = [negatives.bounds(vecs[:1], low, high) for low, high in tree.levels]
    best = negatives._Best(5)
    opened = negatives.search(tree, vecs[0], [x[0][0] for x in both], [x[1][0] for x in both], True, 0, [best], False)
    scores = vecs @ vecs[0]
    assert [-r[0] for r in best.rows] == sorted(scores.tolist(), reverse=True)[:5]
    assert opened <= 0.2 * (len(first) - 1)
    # windows below what any box can reach, or above it, open none
    for low, high in ((int(scores.max()) + 10**8, 1 << 40), (-(1 << 40), int(scores.min()) - 10**8)):
        assert negatives.search(tree, vecs[0], [x[0][0] for x in both], [x[1][0] for x in both], True, 0, [negatives._Best(3, low, high)], False) == 0
