"""Queries from bounded summaries: distinct counts, quantiles and frequent values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import frequent, sketches
from millrace.plans.catalog import SCORED, query


def _stored(t, df: DataFrame, name: str, *parts: str) -> DataFrame:
    """``df`` as a table in the shared folder, partitioned."""
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return t.spark.read.parquet(path)


def _near(estimate: str, exact: str, lg_k: int = sketches.LG_K):
    """Within four standard errors."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.ceil(4 * F.col(exact) / (2 ** (lg_k / 2)))


@query("SELECT strftime(o_orderdate, '%Y') AS year, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderkey) AS n_orders, TRUE AS near FROM orders GROUP BY 1")
def sketch_distinct_by_year(t):
    """Sketches of days are stored by month, and the years come from them; beside them exact counts, from the rows."""
    days = t.orders.withColumns({"day": F.to_date("o_orderdate"), "month": F.date_format("o_orderdate", "yyyy-MM"), "year": F.date_format("o_orderdate", "yyyy")})
    columns = ["o_custkey", "o_orderkey"]
    kept = _stored(t, sketches.distinct_sketches(days, ["year", "month", "day"], columns), "distinct", "month")
    years = sketches.distinct_estimates(sketches.merged(kept, ["year"], columns), ["year"], columns)
    exact = sketches.distinct_counts(days, ["year"], columns, exact=columns).select("year", F.col("n_o_custkey").alias("n_customers"), F.col("n_o_orderkey").alias("n_orders"))
    both = years.join(exact, "year")
    return both.select("year", "n_customers", "n_orders", (_near("n_o_custkey", "n_customers") & _near("n_o_orderkey", "n_orders")).alias("near"))


@query("""WITH c AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')), k AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS a, bool_or(o_orderpriority = '5-LOW') AS b FROM c GROUP BY 1)
SELECT count(*) FILTER (a) AS n_first, count(*) FILTER (b) AS n_second, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a AND NOT b) AS n_only_first, TRUE AS near FROM k""")
def sketch_shared_customers(t):
    kept = _stored(t, sketches.distinct_sketches(t.orders, ["o_orderpriority"], ["o_custkey"]), "distinct", "o_orderpriority")
    found = sketches.in_both(kept, "o_orderpriority", "1-URGENT", "5-LOW", "o_custkey")
    flags = t.orders.groupBy("o_custkey").agg(F.max(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.max(F.col("o_orderpriority") == "5-LOW").alias("b"))
    exact = flags.agg(F.count_if("a").alias("e_first"), F.count_if("b").alias("e_second"), F.count_if(F.col("a") & F.col("b")).alias("e_both"), F.count_if(F.col("a") & ~F.col("b")).alias("e_only_first"))
    # errors of a part of a union are those of the union
    names, whole = ["first", "second", "both", "only_first"], F.col("e_first") + F.col("e_second")
    near = F.lit(True)
    for n in names:
        near = near & (F.abs(F.col(f"n_{n}") - F.col(f"e_{n}")) <= F.ceil(4 * whole / 2 ** (sketches.LG_K / 2)))
    return found.join(F.broadcast(exact)).select(*[F.col(f"e_{n}").alias(f"n_{n}") for n in names], near.alias("near"))


@query("SELECT p_brand, count(DISTINCT p_name) AS n_p_name, count(DISTINCT p_type) AS n_p_type, count(DISTINCT p_size) AS n_p_size, count(DISTINCT p_partkey) AS n_p_partkey FROM part GROUP BY p_brand")
def sketch_distinct_per_group(t):
    # groups have fewer values than a sketch has entries, where estimates are exact; ids are counted exactly at any size
    return sketches.distinct_counts(t.part, ["p_brand"], ["p_name", "p_type", "p_size", "p_partkey"], exact=["p_partkey"])


_QUARTERS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


@query("SELECT source, lang, count(n_chars) AS n, CAST(min(n_chars) AS DOUBLE) AS least, CAST(max(n_chars) AS DOUBLE) AS most, TRUE AS q1, TRUE AS median, TRUE AS q3 FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
def sketch_quartiles(t):
    """Quartiles by source, by language and of all, merged from the stored sketches of both; true where the rank is right."""
    kept = _stored(t, sketches.quantile_sketches(t.documents, ["lang", "source"], "n_chars"), "quantiles", "lang")
    out = None
    for keys in (["source"], ["lang"], []):
        found = sketches.quantiles(sketches.merged_quantiles(kept, keys), keys, {"least": 0, "most": 1} | _QUARTERS)
        errors = sketches.rank_errors(t.documents, keys, "n_chars", found, _QUARTERS)
        rows = (found.select(*keys, "n", "least", "most").join(errors.drop("n"), keys) if keys else found.select("n", "least", "most").join(F.broadcast(errors.drop("n"))))
        part = rows.select(*[F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in ("source", "lang")], "n", "least", "most", *[(F.col(q) <= sketches.RANK_ERROR).alias(q) for q in _QUARTERS])
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH b AS (SELECT source, quantile_disc(n_chars, 0.25) AS q1, quantile_disc(n_chars, 0.75) AS q3, count(*) AS n FROM documents GROUP BY source) SELECT source, n, TRUE AS near FROM b")
def sketch_box_by_group(t):
    """The box of each source; its quartiles lie between the exact values a rank error below and above."""
    found = sketches.boxes(t.documents, ["source"], "n_chars")
    e = sketches.RANK_ERROR
    exact = t.documents.groupBy("source").agg(F.percentile("n_chars", F.array(*[F.lit(x) for x in (0.25 - e, 0.25 + e, 0.75 - e, 0.75 + e)])).alias("q"))
    near = F.col("q1").between(F.floor(F.col("q")[0]), F.ceil(F.col("q")[1])) & F.col("q3").between(F.floor(F.col("q")[2]), F.ceil(F.col("q")[3])) & (F.col("low") <= F.col("q1")) & (F.col("high") >= F.col("q3"))
    return found.join(exact, "source").select("source", "n", near.alias("near"))


@query(SCORED + "x AS (SELECT 1) SELECT token, count(*) AS n FROM words WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 100")
def text_frequent_tokens(t):
    return frequent.frequent_tokens(t.documents, "text", 100)


@query("""WITH words AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS token FROM documents), n AS (SELECT lang, token, count(*) AS n FROM words WHERE token <> '' GROUP BY ALL)
SELECT lang, token, n FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) <= 20""")
def text_frequent_tokens_by_lang(t):
    return frequent.frequent_tokens(t.documents, "text", 20, ["lang"])
