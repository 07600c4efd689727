"""Queries for tables on pages and for CSV of unknown types."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import sources
from millrace.functions import html, strings
from millrace.plans.catalog import query
from millrace.sources import inferred

# Pages -----------------------------------------------------------------------------------------------------------------

_HEAD = '<table class="plain"><tr><td><a>other</a></td></tr></table><table border="1>0" class=\'wide standard\'><thead><tr><td><a>head</a></td></tr></thead><tbody><tr><th>name</th><th>more</th></tr>'
_ROW = "<tr class='x'><td>n &gt; 1<!-- <td><a>no</a></td> --><table class=standard><tr><td><a>inner</a></td></tr></table><td>\n"
#: A page's links with their tags gone and its commonest references decoded.
_LINKS = "list_transform(regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '<a[^>]*>([^<]*)</a>', 1), lambda x: trim(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')))"


def _nested(t) -> DataFrame:
    """The pages, whose lists have become tables with a header, and a table and a comment in the first cell of every row."""
    changes = {"<ul>": _HEAD, "</ul>": "</table>", "<li>": _ROW, "</li>": "</td></tr>"}
    return t.pages.select("page_id", strings.replace_each(F.col("html"), changes).alias("html"))


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, a[pos] AS link, 'n > 1' AS first_cell, CAST(2 AS INTEGER) AS n_cells FROM (SELECT *, generate_subscripts(a, 1) AS pos FROM (SELECT page_id, {_LINKS} AS a FROM pages))")
def html_table_rows(t):
    numbered = _nested(t).select("page_id", F.posexplode(F.filter(html.table_rows(F.col("html"), "standard"), lambda r: ~r["header"])).alias("pos", "r"))
    return numbered.select("page_id", (F.col("pos") + 1).alias("pos"), F.col("r.link").alias("link"), F.col("r.cells")[0]["text"].alias("first_cell"), F.size("r.cells").alias("n_cells"))


_BARE = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g')"


@query(f"SELECT name, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, lower(unnest(regexp_extract_all({_BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS name FROM pages) GROUP BY name")
def html_tag_counts(t):
    tags = t.pages.select("page_id", F.explode(F.filter(html.parts(F.col("html")), lambda p: (p["name"] != "") & ~p["close"])["name"]).alias("name"))
    per_page = tags.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_pages"))


# CSV -------------------------------------------------------------------------------------------------------------------

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_clerk_note"]
_NOTE = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'said \"' || o_orderpriority || '\",' || chr(10) || 'twice' END"
#: Planted bad rows: records that end early, and prices that are no numbers.
_SHORT, _NO_PRICE = "o_orderkey % 97 = 0", "o_orderkey % 89 = 0"


def _planted(t) -> str:
    """The path of CSV files without header of the orders, some of them bad."""
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/csv-{uuid.uuid4().hex}"
    price = F.when(F.expr(_NO_PRICE), "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    note = F.when(F.col("o_orderkey") % 5 == 0, sources.NULL).otherwise(F.concat(F.lit('"said ""'), F.col("o_orderpriority"), F.lit('"",\ntwice"')))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    whole = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", price, day, note)
    t.orders.select(F.when(F.expr(_SHORT), F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus")).otherwise(whole).alias("value")).write.text(path)
    return path


def _orders(t) -> inferred.Read:
    return inferred.read_csv(t.spark, _planted(t), _ORDERS, bad_share=0.05)


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, {_NOTE} AS o_clerk_note FROM orders WHERE NOT ({_SHORT}) AND NOT ({_NO_PRICE})")
def src_csv_inferred(t):
    rows = _orders(t).rows
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_clerk_note")


@query(f"SELECT CASE WHEN {_SHORT} THEN 'fields' ELSE 'o_totalprice: not decimal' END AS reason, o_orderkey FROM orders WHERE {_SHORT} OR {_NO_PRICE}")
def src_csv_bad_rows(t):
    bad = _orders(t).bad
    return bad.select(F.regexp_replace("reason", r"\([0-9,]+\)", "").alias("reason"), F.split("record", ",")[0].cast("long").alias("o_orderkey"))


@query("SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'seen', 'day', 'ratio', 'open', 'none']) AS \"column\", unnest(['bigint', 'string', 'decimal', 'timestamp', 'date', 'double', 'boolean', 'string']) AS type, unnest([count(*), count(*), count(*), count(*), count(*), count(*), count(*), 0]) AS n FROM orders")
def src_csv_types(t):
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/csv-{uuid.uuid4().hex}"
    price = F.col("o_totalprice").cast("decimal(18,2)")
    seen = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    ratio = F.when(F.col("o_orderkey") % 3 == 0, "1e-3").otherwise(F.col("o_orderkey").cast("string"))
    rows = t.orders.select("o_orderkey", "o_orderstatus", price.alias("o_totalprice"), seen.alias("seen"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), ratio.alias("ratio"), (F.col("o_orderstatus") == "O").alias("open"), F.lit(None).cast("string").alias("none"))
    sources.write_csv(rows, path)
    found = inferred.read_csv(t.spark, path)
    types = F.create_map(*[F.lit(x) for c, k in found.types.items() for x in (c, k.partition("(")[0])])
    counts = found.rows.agg(*[F.count(c).alias(c) for c in found.types])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in found.types])).alias("x")).select("x.*")
    return long.select("column", types[F.col("column")].alias("type"), "n")
