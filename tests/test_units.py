"""Edge rows that the driver's tables don't have."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace import sources, streaming
from millrace.functions import html, numbers, predicates, strings
from millrace.operators import features, model, profile, relational, sentiment, stats


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first().y


@pytest.mark.parametrize(
    "tags, want",
    [
        ("[' Business trip ', ' Solo traveler ', ' Twin Room ', ' Stayed 3 nights ']", dict(leisure=0, party=1, nights=3.0, room_tag="Twin Room")),
        ("[' Leisure trip ', ' Couple ']", dict(leisure=1, party=2, nights=0.0, room_tag="Couple")),
        ("[' Couple ']", dict(party=2, room_tag="")),
        ("[' Suite, Sea View ']", dict(room_tag="Suite")),
        ("[' Couple ', ' Group ']", dict(party=6)),
        ("[' Stayed 1 night ']", dict(nights=1.0)),
        ("[' Submitted from a mobile device ', ' With a pet ']", dict(mobile=1, pet=1, leisure=1, party=0)),
    ],
)
def test_tags(spark, tags, want):
    row = spark.createDataFrame([(tags,)], "tags string").select(*[c.alias(k) for k, c in features.tag_features(F.col("tags")).items()]).first().asDict()
    assert {k: row[k] for k in want} == want


@pytest.mark.parametrize("tag, want", [("Superior Double Room", "Superior"), ("Twin Room", "Double"), ("Loft", "Other"), ("Room without Window", "without Window")])
def test_room_type(spark, tag, want):
    assert one(spark, tag, features.room_type(F.col("x"))) == want


def test_view(spark):
    assert one(spark, "Panoramic Suite", features.has_view(F.col("x"))) == 1 and one(spark, "Suite", features.has_view(F.col("x"))) == 0


def test_address_words(spark):
    address = "1 Some Street London SW1 United Kingdom"
    assert one(spark, address, strings.word_from_end(F.col("x"), 1)) == "Kingdom"
    assert one(spark, address, strings.word_from_end(F.col("x"), 2)) == "United"
    assert one(spark, "Paris", strings.word_from_end(F.col("x"), 2)) is None
    assert one(spark, "Kingdom", strings.repaired(F.col("x"), {"Kingdom": "United Kingdom"})) == "United Kingdom"


def test_items(spark):
    assert one(spark, "", strings.item_count(F.col("x"), "\t")) == 1
    assert one(spark, "", strings.item_count(F.col("x"), "\t", empty_is_none=True)) == 0
    assert one(spark, None, strings.item_count(F.col("x"), "\t")) is None
    assert one(spark, "a\tb c\td", strings.item_count(F.col("x"), "\t")) == 3


def test_ratios(spark):
    assert one(spark, 0.0, numbers.safe_ratio(F.col("x"), F.col("x")), "double") == 0.5
    assert one(spark, None, predicates.flag(F.col("x") > 1), "double") == 0
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "a double, p double")
    assert stats.mape(df, "a", "p").first() == Row(mape=37.5, n_used=2, n_zero=1)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(25.0,), (25.1,), (0.0,), (-3.0,), (350.0,), (351.0,), (None,)], "v double")
    bins = {r.bin: r.n for r in profile.histogram(df, "v", 25, 14).collect()}
    assert len(bins) == 14 and (bins[1], bins[2], bins[14]) == (1, 1, 1) and sum(bins.values()) == 3


def test_total_of_nothing(spark):
    df = spark.createDataFrame([], "k string")
    assert relational.with_total(df, "k").count() == 0
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    assert {(r.k, r.n) for r in relational.with_total(df, "k").collect()} == {("a", 2), ("b", 1), ("Total", 3)}


def test_places_with_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "k string, n int")
    assert [(r.k, r.place) for r in relational.places(df, [1, 3], "n", "k").orderBy("place").collect()] == [("a", 1), ("c", 3)]


def test_constant_columns(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0)], "a double, b double")
    assert {r.a_scaled for r in features.min_max(df, ["a"]).collect()} == {0.0}
    assert stats.pearson(df, ["a", "b"]).first().r is None
    assert stats.spearman(df, ["a", "b"]).first().r is None


def test_scaling_and_one_hot_bounds(spark):
    df = spark.range(50).selectExpr("id", "cast(id % 4 as string) k", "(id * 7919) % 31 v")
    for n in (1, 16):
        rows = features.one_hot(features.min_max(df.repartition(n), ["v"]), "k").collect()
        assert all(sum(r[f"k_{x}"] for x in range(4)) == 1 and 0 <= r.v_scaled <= 1 for r in rows)
    with pytest.raises(ValueError):
        features.one_hot(df, "id", most=10)


def test_codes_of_many_values(spark):
    df = spark.range(500).selectExpr("id", "nullif(concat('v', cast(id * 7919 % 101 as string)), 'v13') as k")
    few, many = ({r.id: r.code for r in features.ordinal_code(df, "k", "code", most=n).collect()} for n in (1000, 5))
    assert few == many and set(few.values()) == {None, *range(100)}


def test_means_over_time(spark):
    rows = [("a", "2024-01-03", 1.0), ("a", "2024-01-30", 3.0), ("a", "2024-03-01", 5.0), ("b", "2024-03-02", None)]
    df = spark.createDataFrame(rows, "k string, d string, v double").withColumn("d", F.col("d").cast("timestamp"))
    got = [(r.k, r.period.month, r.n, r.mean, r.change) for r in relational.mean_by_period(df, ["k"], "d", "month", F.col("v")).orderBy("k", "period").collect()]
    assert got == [("a", 1, 2, 2.0, None), ("a", 3, 1, 5.0, 3.0), ("b", 3, 0, None, None)]


def test_names(spark):
    df = spark.createDataFrame([("Grand", "1 A London UK"), ("Grand", "2 B Paris FR"), ("Solo", "3 C Rome IT"), ("Solo", "3 C Rome IT")], "n string, a string")
    assert sorted(r.full_name for r in features.distinct_names(df, "n", "a").collect()) == ["Grand London", "Grand Paris", "Solo", "Solo"]


def test_split_is_stable(spark):
    df = spark.range(2000)
    a = {r.id for r in df.filter(model.in_training("id")).collect()}
    assert a == {r.id for r in df.repartition(7).filter(model.in_training("id")).collect()} and 0.75 < len(a) / 2000 < 0.85


def test_context_rules(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    texts = ["good", "not good", "very good", "GOOD thing", "bad but good", "good!!", "plain words", "slightly good", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {texts[r.id]: r for r in sentiment.context_score(df, "id", "text", lexicon, ["not"], {"very": 1, "slightly": -1}).collect()}
    c = lambda s: round(s / (s * s + 15) ** 0.5, 4)
    assert got["good"].compound == c(1.9)
    assert got["not good"].compound == c(1.9 * -0.74)
    assert got["very good"].compound == c(1.9 + 0.293)
    assert got["slightly good"].compound == c(1.9 - 0.293)
    assert got["GOOD thing"].compound == c(1.9 + 0.733)
    assert got["bad but good"].compound == c(-2.5 * 0.5 + 1.9 * 1.5)
    assert got["good!!"].compound == c(1.9 + 2 * 0.292)
    assert got["plain words"].compound == 0 and got["plain words"].neu == 1
    assert got["good"].pos == 1


def test_shares_of_words(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0), ("flat", 0.0)], "token string, valence double")
    df = spark.createDataFrame([(1, "Good, good bad thing"), (2, "nothing"), (3, "flat BAD"), (4, None), (5, "")], "id int, text string")
    got = {r.id: r for r in sentiment.lexicon_score(df, "id", "text", lexicon).collect()}
    assert set(got) == {1, 3}
    assert (got[1].n_hits, got[1].total, got[1].neg, got[1].neu, got[1].pos) == (3, 3.0, round(2 / 9, 3), round(1 / 9, 3), round(6 / 9, 3))
    assert (got[3].n_hits, got[3].neg, got[3].neu, got[3].pos) == (2, round(2 / 3, 3), round(1 / 3, 3), 0.0)
    probe = {r.phrase: r.compound for r in sentiment.word_scores(df, "text", lexicon).collect()}
    assert set(probe) == {"good, good bad thing", "flat bad"}


def test_context_has_no_texts_beside_words(spark):
    """What is exploded, joined and shuffled for each word holds no text, and no window runs over a text's words."""
    df = spark.createDataFrame([(1, "good word " * 50)], "id int, text string")
    lexicon = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    plan = sentiment.context_score(df, "id", "text", lexicon, ["not"], {"very": 1})._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :].splitlines()[1]  # what every word's row repeats comes from here
    assert "Window" not in plan and "Project" in below and below.split("forall")[0].count("text#") == 0


def test_table_links(spark):
    page = """<table class=other><tr><td><a>no</a></td></tr></table><TABLE id="t" class="wide standard">
    <tr><th>Name</th></tr><tr class="r"><td> <a href="/x" title='y'>\n <b>One</b> company </a></td><td><a>second</a></td></tr>
    <tr><td>none</td></tr><tr><td><a>Two</a></td></tr></table><table class="standard"><tr><td><a>later</a></td></tr></table>"""
    assert one(spark, page, html.table_links(F.col("x"), "standard")) == ["One company", "Two"]
    assert one(spark, "<p>", html.table_links(F.col("x"), "standard")) == []
    assert one(spark, page, html.table_links(F.col("x"), "stand")) == []


def test_jdbc(spark, tmp_path):
    """Over the database that Spark brings along."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(200).selectExpr("id", "cast(id * 7 % 10 as int) as v")
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows.repartition(1).write.jdbc(url, "numbers", properties={"driver": driver})
    table = sources.read_jdbc(spark, url, "numbers", "id", 0, 200, 4, driver=driver)
    assert table.rdd.getNumPartitions() == 4
    few = table.filter("v = 7")
    assert "PushedFilters: [*IsNotNull(v), *EqualTo(v,7)]" in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in few.collect()) == [k for k in range(200) if k * 7 % 10 == 7]


def test_box_from_a_sketch(spark):
    exact, near = (profile.box(spark.range(10_001).selectExpr("cast(id as double) v"), "v", a).first() for a in (None, 1000))
    assert (exact.q1, exact.median, exact.q3) == (2500, 5000, 7500) and all(abs(a - b) <= 10 for a, b in zip(exact[:3], near[:3]))


def test_lexicon_override(spark):
    lexicon = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "token string, valence double")
    changes = spark.createDataFrame([("b", -9.0), ("c", 3.0)], "token string, valence double")
    assert {tuple(r) for r in sentiment.overridden(lexicon, changes).collect()} == {("a", 1.0), ("b", -9.0), ("c", 3.0)}


def test_csv_keeps_nulls_and_quotes(spark, tmp_path):
    rows = [(1, 'say "x",\nand more'), (2, ""), (3, None), (4, "  padded ")]
    df = spark.createDataFrame(rows, "k int, v string")
    sources.write_csv(df, f"{tmp_path}/c")
    assert sorted(tuple(r) for r in sources.read_csv(spark, f"{tmp_path}/c", df.schema).collect()) == rows


def test_forest_beats_the_mean(spark, sf_dir):
    part = sources.table(spark, sf_dir, "part")
    train, valid = part.filter(model.in_training("p_partkey")), part.filter(~model.in_training("p_partkey"))
    forest = model.fit(train, ["p_partkey", "p_size"], "p_retailprice", trees=10, depth=8)
    mean = train.agg(F.avg("p_retailprice")).first()[0]
    own = stats.mape(model.predict(valid, forest, ["p_partkey", "p_size"]), "p_retailprice", "prediction").first().mape
    assert own < stats.mape(valid.withColumn("m", F.lit(mean)), "p_retailprice", "m").first().mape


def test_stream_has_the_features_of_a_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "[' Couple ', ' Loft ']"), (2, "[' Group ']")], "id int, tags string")
    df.write.parquet(f"{tmp_path}/in")
    columns = features.tag_features(F.col("tags"))
    streaming.run_available(streaming.stream(spark, f"{tmp_path}/in", df.schema), columns, f"{tmp_path}/out", f"{tmp_path}/state")
    streaming.run_available(streaming.stream(spark, f"{tmp_path}/in", df.schema), columns, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, df.withColumns(columns).collect()))


def test_views(spark, sf_dir):
    sources.register(spark, sf_dir, ["orders"])
    assert spark.sql("SELECT count(*) FROM orders").first()[0] > 0


def test_context_of_a_null_key(spark):
    lexicon = spark.createDataFrame([("good", 2.0)], "token string, valence double")
    df = spark.createDataFrame([(None, "a good day"), (1, "a good day"), (2, "a day")], "k int, text string")
    got = {r.k: r.compound for r in sentiment.context_score(df, "k", "text", lexicon, ["not"], {"very": 1}).collect()}
    assert got == {None: 0.4588, 1: 0.4588, 2: 0.0}


def test_context_with_large_lexicons(spark, monkeypatch):
    """The same whether the lexicon's tokens stand in the plan or in a table, with repeated and null keys and texts without a hit."""
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.5), ("so", 0.0)], "token string, valence double")
    texts = ["a GOOD day, not bad!", "so so", "but good? bad?? ok", "nothing here!!", None, "", "good but very bad", "VERY GOOD"]
    df = spark.createDataFrame([*enumerate(texts), (None, "good!"), (0, "not good"), (None, "none of it")], "k int, text string").repartition(3)
    score = lambda: sorted(map(repr, sentiment.context_score(df, "k", "text", lexicon, ["not"], {"very": 1}).collect()))
    few = score()
    monkeypatch.setattr(sentiment, "FEW", 1)
    assert score() == few and len(few) == 7
