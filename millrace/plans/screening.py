"""Queries for correlation of many columns and of ranks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import correlation
from millrace.plans.catalog import query

#: Columns with gaps, as SQL that both engines read.
_GAPS = {
    "quantity": "CASE WHEN l_returnflag <> 'R' THEN l_quantity END",
    "price": "CASE WHEN l_linestatus <> 'O' OR l_partkey % 3 = 0 THEN l_extendedprice END",
    "tax": "CASE WHEN l_partkey % 7 <> 0 THEN l_tax END",
    "discount": "CAST(l_discount AS DOUBLE)",
}
_WITH = "WITH g AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _GAPS.items()) + " FROM lineitem) "


def _gaps(t) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(e).alias(c) for c, e in _GAPS.items()])


def _pair_sql(i: str, j: str) -> str:
    return f"SELECT '{i}' AS col_i, '{j}' AS col_j, count(CASE WHEN {i} IS NOT NULL THEN {j} END) AS n, round(corr({i}, {j}), 6) AS r FROM g"


@query(_WITH + " UNION ALL ".join(_pair_sql(b, a) for a, b in combinations(_GAPS, 2)))
def stat_corr_pairwise(t):
    return correlation.pearson(_gaps(t), list(_GAPS))


@query(_WITH + ", w AS (SELECT *, 3 * quantity - 100 * discount AS c7, price * tax AS c123 FROM g) " + " UNION ALL ".join(_pair_sql(i, j).replace("FROM g", "FROM w") for i, j in (("c7", "quantity"), ("c123", "c7"), ("c123", "price"))))
def stat_corr_wide(t):
    """Three hundred columns, three of whose pairs are looked at."""
    more = {f"c{k}": F.col("quantity") * (k % 5 + 1) - F.col("discount") * (k * 10 + 30) for k in range(296) if k not in (7, 123)}
    rows = _gaps(t).withColumns({"c7": 3 * F.col("quantity") - 100 * F.col("discount"), "c123": F.col("price") * F.col("tax")} | more)
    names = [*_GAPS, "c7", "c123", *more]
    found = correlation.pearson(rows, names)
    wanted = F.struct(F.greatest("col_i", "col_j"), F.least("col_i", "col_j"))
    pairs = {("quantity", "c7"): ("c7", "quantity"), ("c7", "c123"): ("c123", "c7"), ("price", "c123"): ("c123", "price")}
    name = F.create_map(*[x for k, v in pairs.items() for x in (F.struct(*[F.lit(s) for s in sorted(k, reverse=True)]), F.struct(*[F.lit(s) for s in v]))])
    named = found.withColumn("p", name[wanted]).filter(F.col("p").isNotNull())
    return named.select(F.col("p")["col1"].alias("col_i"), F.col("p")["col2"].alias("col_j"), "n", "r")


def _rank_sql(i: str, j: str) -> str:
    place = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
    return f"SELECT '{i}' AS col_i, '{j}' AS col_j, count(*) AS n, round(corr(CAST({i} AS DOUBLE), CAST({j} AS DOUBLE)), 6) AS r FROM (SELECT {place(i)}, {place(j)} FROM g WHERE {i} IS NOT NULL AND {j} IS NOT NULL)"


@query(_WITH + " UNION ALL ".join(_rank_sql(b, a) for a, b in combinations(_GAPS, 2)))
def stat_rank_corr_pairwise(t):
    return correlation.spearman(_gaps(t), list(_GAPS))
