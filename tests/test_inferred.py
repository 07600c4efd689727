"""Types of CSV columns from all rows, and bad records."""

import pytest
from pyspark.sql import functions as F

from millrace import sources
from millrace.sources import inferred


def written(tmp_path, *files):
    folder = tmp_path / "csv"
    folder.mkdir()
    for k, text in enumerate(files):
        (folder / f"{k}.csv").write_text(text)
    return f"file://{folder}"


@pytest.mark.parametrize(
    "values, want",
    [
        (["1", "-2", "+3", "007"], "bigint"),
        (["1", "2.5", ".5", "10."], "decimal(3,1)"),
        (["123456789012345678901", "1"], "decimal(21,0)"),
        (["1" * 39, "1"], "double"),
        (["1" * 30, "0." + "1" * 20], "double"),
        (["1", "2.5", "1e3"], "double"),
        (["1", "NaN", "-inf"], "double"),
        (["2024-02-29", "2023-01-01"], "date"),
        (["2024-02-29", "2023-01-01 10:00:00"], "timestamp"),
        (["2024-02-30"], "string"),
        (["true", "FALSE"], "boolean"),
        (["true", "1"], "string"),
        (["2024-02-29", "1"], "string"),
        (["1 ", "2"], "string"),
        ([None, ""], "string"),
        (["", None, "5"], "bigint"),
    ],
)
def test_types(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "c string").repartition(3)
    assert inferred.types_of(df, ["c"]) == {"c": want}


def test_types_do_not_depend_on_files(spark, tmp_path):
    """A value that widens a type may stand in the last row of the last file."""
    text = "a,b\n" + "".join(f"{k},{k}\n" for k in range(500))
    got = inferred.read_csv(spark, written(tmp_path, text, text, "a,b\n1,0.25\n"))
    assert got.types == {"a": "bigint", "b": "decimal(5,2)"}
    assert got.rows.count() == 1001 and got.bad.count() == 0 and got.rows.schema.simpleString() == "struct<a:bigint,b:decimal(5,2)>"


def test_bad_records(spark, tmp_path):
    text = 'id,day,note\n1,2024-01-01,"a ""b"",\nc"\n2,2024-01-02\n3,2024-01-03,x,y\n4,soon,z\n5,2024-01-05,\\N\n' + "".join(f"{k},2024-02-01,n\n" for k in range(6, 30))
    got = inferred.read_csv(spark, written(tmp_path, text), bad_share=0.1)
    assert got.types == {"id": "bigint", "day": "date", "note": "string"}
    rows = {r.id: r for r in got.rows.collect()}
    assert sorted(rows) == [1, 5, *range(6, 30)] and rows[1].note == 'a "b",\nc' and rows[5].note is None
    bad = sorted((r.record, r.reason) for r in got.bad.collect())
    assert [r for _, r in bad] == ["fields", "fields", "day: not date"] and [b[0][0] for b in bad] == ["2", "3", "4"]
    strict = inferred.read_csv(spark, f"file://{tmp_path}/csv")
    assert strict.types["day"] == "string" and strict.rows.count() == 27


def test_special_doubles(spark, tmp_path):
    got = inferred.read_csv(spark, written(tmp_path, "v\n1e2\nNaN\n-inf\nInfinity\n"))
    assert got.types == {"v": "double"} and [str(r.v) for r in got.rows.collect()] == ["100.0", "nan", "-inf", "inf"] and got.bad.count() == 0


def test_odd_names_and_no_rows(spark, tmp_path):
    got = inferred.read_csv(spark, written(tmp_path, "a b,c`d\n"))
    assert got.types == {"a b": "string", "c`d": "string"} and got.rows.columns == ["a b", "c`d"]
    assert got.rows.count() == 0 and got.bad.count() == 0


def test_round_trip(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") / 7 * 1e9).alias("d"), F.concat(F.lit('x,"\n'), F.col("id").cast("string")).alias("s"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("some"), F.expr("timestamp_seconds(id)").alias("t"))
    path = f"file://{tmp_path}/out"
    sources.write_csv(df.withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss")), path)
    got = inferred.read_csv(spark, path)
    assert {k: v.partition("(")[0] for k, v in got.types.items()} == {"id": "bigint", "d": "double", "s": "string", "some": "bigint", "t": "timestamp"}
    assert sorted(map(tuple, got.rows.collect())) == sorted(map(tuple, df.collect()))
