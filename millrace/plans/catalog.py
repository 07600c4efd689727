"""Queries of the relational and review operators over the driver's tables, and the SQL that each must equal.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sources
from millrace.functions import html, numbers, predicates, strings
from millrace.operators import correlation, features, model, profile, relational, sentiment, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return sources.table(self.spark, self.folder, name)

    @property
    def jobs(self) -> DataFrame:
        """Orders with bounds of pay that are often missing: for one priority both always are."""
        paid = F.col("o_orderpriority") != "5-LOW"
        low = F.when(F.col("o_orderstatus").isin("F", "O") & paid, F.col("o_totalprice"))
        high = F.when(F.col("o_orderstatus").isin("F", "P") & paid & (F.col("o_orderkey") % 2 == 0), 1.5 * F.col("o_totalprice"))
        return self.orders.withColumns({"lo": low, "hi": high})

    @property
    def tagged(self) -> DataFrame:
        """Line items with a list of tags written as text, put together from their columns."""
        party = F.element_at(F.array(*[F.lit(p) for p in features.PARTY_CODES]), (F.col("l_partkey") % 6 + 1).cast("int"))
        room = F.element_at(F.array(*[F.lit(r) for r in ROOMS]), (F.col("l_suppkey") % len(ROOMS) + 1).cast("int"))
        trip = F.when(F.col("l_returnflag") == "A", "Business trip").otherwise("Leisure trip")
        nights = F.concat(F.lit("Stayed "), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 1, " night").otherwise(" nights"))
        parts = F.array_compact(F.array(trip, party, F.when(F.col("l_quantity") > 10, room), nights, F.when(F.col("l_tax") > 0.04, F.lit(features.MOBILE_TAG)), F.when(F.col("l_discount") > 0.08, F.lit(features.PET_TAG))))
        text = F.concat(F.lit("["), F.array_join(F.transform(parts, lambda x: F.concat(F.lit("' "), x, F.lit(" '"))), ", "), F.lit("]"))
        return self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", text.alias("tags"))


ROOMS = ["Superior Double Room", "Twin Room", "Suite with Sea View", "Loft", "Deluxe King Room", "Room without Window"]
LEXICON = [("the", 0.5), ("of", -1.0), ("and", 1.5), ("that", -0.3)]

JOBS = """WITH jobs AS (SELECT *, CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' THEN o_totalprice END AS lo,
  CASE WHEN o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW' AND o_orderkey % 2 = 0 THEN CAST(1.5 AS DOUBLE) * o_totalprice END AS hi FROM orders) """
_LIST = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
TAGGED = f"""WITH parts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
  CASE WHEN l_returnflag = 'A' THEN 'Business trip' ELSE 'Leisure trip' END AS trip,
  {_LIST(features.PARTY_CODES)}[l_partkey % 6 + 1] AS party, CASE WHEN l_quantity > 10 THEN {_LIST(ROOMS)}[l_suppkey % {len(ROOMS)} + 1] END AS room,
  l_linenumber AS nights, l_tax > 0.04 AS mobile, l_discount > 0.08 AS pet FROM lineitem) """
SCORED = """WITH words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS token FROM documents), """


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Joins, groups, places ------------------------------------------------------------------------------------------------


@query("SELECT n_name, count(o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name")
def join_inner_group(t):
    # the small dimension joins first; how each join is done is left to the planner, which knows the sizes
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return relational.count_by(t.orders.join(people, F.col("o_custkey") == F.col("c_custkey")), "n_name", of="o_orderkey")


@query("SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10")
def topk_groups(t):
    return join_inner_group(t).limit(10)


@query("WITH g AS (SELECT c_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, c_name) AS place FROM g) SELECT c_name, n, CAST(place AS INTEGER) AS place FROM r WHERE place IN (1, 5)")
def rank_first_and_nth(t):
    counts = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_name").agg(F.count(F.lit(1)).alias("n"))
    return relational.places(counts, [1, 5], "n", "c_name")


@query("SELECT c_name, count(DISTINCT o_orderpriority) AS n_priorities FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name ORDER BY n_priorities DESC, c_name")
def agg_distinct_per_group(t):
    joined = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    return relational.distinct_by(joined, ["c_name"], "n_priorities", "o_orderpriority").orderBy(F.desc("n_priorities"), "c_name")


@query("WITH d AS (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3')) SELECT n_name, count(*) AS n FROM d GROUP BY n_name UNION ALL SELECT total AS n_name, count(*) AS n FROM (SELECT 'Total' AS total FROM d) GROUP BY total")
def union_with_total(t):
    named = t.nation.filter(predicates.in_list("n_name", ["NATION_1", "NATION_2", "NATION_3"]))
    rows = t.customer.filter(F.col("c_mktsegment") == "BUILDING").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    return relational.with_total(rows, "n_name").orderBy(F.desc("n"), "n_name")


@query("SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(p_partkey) = 4 ORDER BY l_orderkey LIMIT 1 OFFSET 2")
def agg_having_eq_nth(t):
    rows = relational.having_count(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), ["l_orderkey"], 4)
    return rows.select("l_orderkey").orderBy("l_orderkey").limit(3).offset(2)


@query("SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#4'")
def filter_eq_join_count(t):
    brand = t.part.filter(F.col("p_brand") == "Brand#4").select("p_partkey")
    rows = t.lineitem.join(brand, F.col("l_partkey") == F.col("p_partkey")).join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_count(t):
    return relational.with_counts(t.customer.select("c_custkey"), t.orders.filter(F.col("o_orderpriority") == "1-URGENT"), "c_custkey", "o_custkey", "n")


@query("SELECT count(*) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey WHERE o_custkey IS NULL")
def join_anti_count(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return relational.without_match(t.customer, urgent, "c_custkey", "o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(DISTINCT c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 3000) ON s_nationkey = n_nationkey WHERE s_suppkey IS NULL GROUP BY n_nationkey, n_name ORDER BY n DESC, n_name LIMIT 1")
def join_anti_left_top1(t):
    bare = relational.without_match(t.nation, t.supplier.filter(F.col("s_acctbal") > 3000), "n_nationkey", "s_nationkey")
    return relational.top(relational.with_counts(bare, t.customer, "n_nationkey", "c_nationkey", "n").select("n_name", "n"), 1, "n", "n_name")


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def join_semi_list(t):
    names = t.customer.filter(F.col("c_acctbal") > 9000).select(F.col("c_custkey").alias("o_custkey"))
    return relational.in_table(t.orders, names, "o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share FROM orders GROUP BY o_orderpriority")
def agg_share_by_group(t):
    return relational.share_by(t.orders, ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("SELECT * FROM (SELECT event_id, value FROM events WHERE value = (SELECT max(value) FROM events) ORDER BY event_id LIMIT 2)")
def filter_at_max(t):
    return relational.at_max(t.events.select("event_id", "value"), "value").orderBy("event_id").limit(2)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_preview(t):
    return relational.top(t.orders.select("o_orderkey", "o_totalprice"), 10, "o_totalprice", "o_orderkey")


# Filters and columns --------------------------------------------------------------------------------------------------


@query('SELECT o_orderkey AS "Номер заказа", o_totalprice AS price FROM orders')
def proj_alias(t):
    return t.orders.select(F.col("o_orderkey").alias("Номер заказа"), F.col("o_totalprice").alias("price"))


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def proj_drop(t):
    return t.part.drop("p_type", "p_retailprice")


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def proj_numeric_only(t):
    return profile.numeric_only(t.part)


@query(JOBS + "SELECT count(o_orderkey) AS n FROM jobs WHERE lo IS NOT NULL OR hi IS NOT NULL")
def filter_any_not_null(t):
    return t.jobs.filter(predicates.any_not_null("lo", "hi")).agg(F.count("o_orderkey").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_name ILIKE '%hot%'")
def filter_ilike_any(t):
    return t.part.filter(predicates.any_ilike("p_name", ["%RED%", "%hot%"])).select("p_partkey", "p_name")


_TOPIC = dict(column="p_name", patterns=["%RED%", "%s_a%ring%"], guarded="%OR%", unless=["%gear%"])
_TOPIC_SQL = "(p_name ILIKE '%RED%' OR p_name ILIKE '%s_a%ring%' OR p_name {like} '%OR%' AND p_name NOT ILIKE '%gear%')"


@query("SELECT p_partkey FROM part WHERE " + _TOPIC_SQL.format(like="ILIKE"))
def filter_topic(t):
    return t.part.filter(predicates.topic(**_TOPIC)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE " + _TOPIC_SQL.format(like="LIKE"))
def filter_topic_cased(t):
    return t.part.filter(predicates.topic(**_TOPIC, case_sensitive=True)).select("p_partkey")


@query("SELECT count(*) AS n FROM part WHERE " + _TOPIC_SQL.format(like="ILIKE") + " AND (p_type ILIKE 'economy' OR p_brand ILIKE '%#1%')")
def filter_junior(t):
    young = predicates.same_text("p_type", "economy") | predicates.any_ilike("p_brand", ["%#1%"])
    return t.part.filter(predicates.topic(**_TOPIC) & young).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM part WHERE " + _TOPIC_SQL.format(like="ILIKE") + " AND (p_brand ILIKE '%2%' OR p_brand ILIKE '%5%')")
def filter_topic_skill(t):
    return t.part.filter(predicates.topic(**_TOPIC) & predicates.any_ilike("p_brand", ["%2%", "%5%"])).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in_list(t):
    return t.customer.filter(predicates.in_list("c_mktsegment", ["BUILDING", "MACHINERY"])).select("c_custkey")


@query("SELECT c_custkey, CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS INTEGER) AS listed FROM customer")
def flag_in_list(t):
    return t.customer.select("c_custkey", predicates.flag(predicates.in_list("c_mktsegment", ["BUILDING", "MACHINERY"])).alias("listed"))


@query("SELECT s_suppkey, c_custkey, CAST(CASE WHEN nullif(s_nationkey, 3) = nullif(c_nationkey, 3) THEN 1 ELSE 0 END AS INTEGER) AS home FROM supplier JOIN customer ON s_suppkey = c_custkey")
def flag_columns_equal(t):
    both = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey")).withColumns({"a": F.nullif("s_nationkey", F.lit(3)), "b": F.nullif("c_nationkey", F.lit(3))})
    return both.select("s_suppkey", "c_custkey", predicates.equal_flag("a", "b").alias("home"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*[gt]$')")
def filter_regex(t):
    return t.part.filter(F.col("p_name").rlike("^(red|blue) .*[gt]$")).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, CAST(l_linestatus = 'F' AS INTEGER) AS sample FROM lineitem WHERE l_linestatus = 'F'")
def ml_split_by_flag(t):
    return t.lineitem.withColumn("sample", (F.col("l_linestatus") == "F").cast("int")).filter(F.col("sample") == 1).select("l_orderkey", "l_linenumber", "sample")


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 1 AS sample FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'none', 0 FROM supplier")
def union_with_source_flag(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return sources.union_with_flag({1: a, 0: b}, "sample", segment="none")


# Aggregates -----------------------------------------------------------------------------------------------------------


@query(JOBS + "SELECT count(lo) AS n FROM jobs")
def agg_count(t):
    return t.jobs.agg(F.count("lo").alias("n"))


@query("SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT trim(o_orderpriority)) AS n_priorities FROM orders")
def agg_count_distinct(t):
    return t.orders.agg(F.countDistinct("o_custkey").alias("n"), F.countDistinct(F.trim("o_orderpriority")).alias("n_priorities"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC")
def agg_group_two_keys(t):
    return relational.count_by(t.orders, "o_orderstatus", "o_orderpriority")


@query(JOBS + "SELECT round(avg(lo)) AS low, round(avg(hi)) AS high FROM jobs")
def agg_avg_round(t):
    return t.jobs.agg(F.round(F.avg("lo")).alias("low"), F.round(F.avg("hi")).alias("high"))


@query("SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*)")
def agg_order_by_hidden(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "o_orderpriority").select("o_orderpriority")


@query(JOBS + "SELECT o_orderpriority, round(avg(coalesce((lo + hi) / 2, lo, hi)), 0) AS pay FROM jobs GROUP BY 1")
def agg_midpoint_by_group(t):
    return t.jobs.groupBy("o_orderpriority").agg(F.round(F.avg(numbers.midpoint(F.col("lo"), F.col("hi"))), 0).alias("pay")).orderBy(F.col("pay").asc_nulls_last())


@query(
    JOBS
    + """, m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS period, count(coalesce((lo + hi) / 2, lo, hi)) AS n, avg(coalesce((lo + hi) / 2, lo, hi)) AS pay FROM jobs GROUP BY 1, 2)
SELECT o_orderpriority, strftime(period, '%Y-%m') AS period, n, round(pay, 0) AS pay, round(pay - lag(pay) OVER (PARTITION BY o_orderpriority ORDER BY period), 0) AS change FROM m"""
)
def agg_midpoint_over_time(t):
    means = relational.mean_by_period(t.jobs, ["o_orderpriority"], "o_orderdate", "month", numbers.midpoint(F.col("lo"), F.col("hi")), "pay", 0)
    return means.withColumn("period", F.date_format("period", "yyyy-MM"))


@query("SELECT round(avg(length(text) - length(replace(text, ' ', '')) + 1), 2) AS items FROM documents")
def agg_avg_list_len(t):
    return t.documents.agg(F.round(F.avg(strings.item_count(F.col("text"), " ")), 2).alias("items"))


@query("SELECT p_name, count(DISTINCT p_brand) AS n_p_brand, count(DISTINCT p_type) AS n_p_type, count(DISTINCT p_size) AS n_p_size FROM part GROUP BY p_name")
def agg_nunique_per_group(t):
    return profile.distinct_per_group(t.part, "p_name", ["p_brand", "p_type", "p_size"])


@query("SELECT unnest(['p_name', 'p_brand', 'p_type']) AS \"column\", unnest([count(DISTINCT p_name), count(DISTINCT p_brand), count(DISTINCT p_type)]) AS n_distinct FROM part")
def profile_nunique(t):
    return profile.distinct_counts(t.part, ["p_name", "p_brand", "p_type"])


@query("SELECT p_type, round(avg(p_retailprice), 6) AS mean, count(*) AS n FROM part GROUP BY p_type")
def agg_mean_count(t):
    return t.part.groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING avg(p_retailprice) >= 950 AND count(*) >= 12")
def agg_having_mean_count(t):
    groups = t.part.groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    return groups.filter((F.col("mean") >= 950) & (F.col("n") >= 12)).drop("mean")


@query("WITH f AS (SELECT l_quantity AS v, unnest(['returned', 'open', 'taxed']) AS flag, unnest([CAST(l_returnflag = 'R' AS INTEGER), CAST(l_linestatus = 'O' AS INTEGER), CAST(l_tax > 0.04 AS INTEGER)]) AS yes FROM lineitem) SELECT flag, round(avg(CASE WHEN yes = 0 THEN v END), 6) AS mean_0, round(avg(CASE WHEN yes = 1 THEN v END), 6) AS mean_1 FROM f GROUP BY flag")
def agg_flag_means_pivot(t):
    flagged = t.lineitem.withColumns({"returned": (F.col("l_returnflag") == "R").cast("int"), "open": (F.col("l_linestatus") == "O").cast("int"), "taxed": (F.col("l_tax") > 0.04).cast("int")})
    return relational.flag_means(flagged, ["returned", "open", "taxed"], "l_quantity")


@query("SELECT nullif(o_orderstatus, 'P') AS s, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def agg_value_counts(t):
    return profile.value_counts(t.orders.withColumn("s", F.nullif("o_orderstatus", F.lit("P"))), "s", "o_orderpriority")


@query("SELECT p_brand, count(*) AS n FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part) GROUP BY p_brand")
def agg_over_distinct(t):
    return t.part.select("p_brand", "p_type", "p_size").distinct().groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(b AS INTEGER) AS bin, count(value) AS n FROM range(1, 15) AS r(b) LEFT JOIN events ON value > 25 * (b - 1) AND value <= 25 * b GROUP BY b")
def agg_histogram_right_closed(t):
    return profile.histogram(t.events, "value", 25, 14)


@query(JOBS + "SELECT * FROM (SELECT unnest(['o_orderkey', 'lo', 'hi']) AS \"column\", unnest([count(*) - count(o_orderkey), count(*) - count(lo), count(*) - count(hi)]) AS n_null FROM jobs) WHERE n_null > 0")
def profile_null_counts(t):
    return profile.null_counts(t.jobs.select("o_orderkey", "lo", "hi"))


@query(JOBS + "SELECT unnest(['o_orderkey', 'lo', 'o_orderstatus']) AS \"column\", unnest(['bigint', 'double', 'string']) AS type, unnest([count(o_orderkey), count(lo), count(o_orderstatus)]) AS n_not_null FROM jobs")
def profile_table(t):
    return profile.overview(t.jobs.select("o_orderkey", "lo", "o_orderstatus"))


@query("WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3 FROM documents), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q) SELECT CAST(q1 AS DOUBLE) AS q1, CAST(median AS DOUBLE) AS median, CAST(q3 AS DOUBLE) AS q3, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, (SELECT count(*) FROM documents WHERE n_chars < low OR n_chars > high) AS n_outside FROM f")
def stat_boxplot(t):
    return profile.box(t.documents, "n_chars")


@query(SCORED + "x AS (SELECT 1) SELECT token, count(*) AS n FROM words WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 100")
def text_top_tokens(t):
    return profile.token_counts(t.documents, "text", 100)


@query("WITH d AS (SELECT DISTINCT text, n_chars FROM documents), q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM d) SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM d, q WHERE n_chars BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def clean_dedupe_nulls_outliers(t):
    kept = profile.cleaned(t.documents.select("text", "n_chars"), ["text"], ["text"], "n_chars")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# Text and numbers -----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, string_split_regex(a, '\\s+')[-1] AS country, string_split_regex(a, '\\s+')[-2] AS city, string_split_regex(a, '\\s+')[-9] AS far FROM (SELECT p_partkey, p_brand || ' ' || p_type || ' ' || CASE WHEN p_size > 25 THEN 'London SW1 United Kingdom' ELSE p_name END AS a FROM part)")
def str_last_tokens(t):
    address = F.concat_ws(" ", "p_brand", "p_type", F.when(F.col("p_size") > 25, "London SW1 United Kingdom").otherwise(F.col("p_name")))
    return t.part.select("p_partkey", *[strings.word_from_end(address, n).alias(name) for n, name in ((1, "country"), (2, "city"), (9, "far"))])


@query("SELECT p_partkey, CASE w WHEN 'ring' THEN 'large ring' WHEN 'gear' THEN 'cog' ELSE w END AS kind FROM (SELECT p_partkey, string_split(p_name, ' ')[-1] AS w FROM part)")
def str_repair(t):
    return t.part.select("p_partkey", strings.repaired(strings.word_from_end(F.col("p_name"), 1), {"ring": "large ring", "gear": "cog"}).alias("kind"))


@query("SELECT p_partkey, p_name AS name FROM part")
def str_trim_ws(t):
    padded = F.concat(F.lit(" \t\n"), F.col("p_name"), F.lit("\r\n "))
    return t.part.select("p_partkey", strings.trim_space(padded).alias("name"))


@query("SELECT p_partkey, replace(replace(p_name, 'red', 'crimson'), ' ', '_') AS name FROM part")
def str_replace(t):
    return t.part.select("p_partkey", strings.replace_each(F.col("p_name"), {"red": "crimson", " ": "_"}).alias("name"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS items FROM documents")
def arr_split_size(t):
    return t.documents.select("doc_id", F.size(F.split("text", " ")).alias("items"))


@query("SELECT p_partkey, CASE WHEN regexp_full_match(p_brand, 'Brand#\\d') THEN CAST(regexp_extract(p_brand, '\\d+') AS DOUBLE) END AS number FROM part")
def str_regex_number(t):
    return t.part.select("p_partkey", strings.number_in(F.col("p_brand"), r"Brand#\d").alias("number"))


@query("SELECT event_id, round(ln(value + 1), 6) AS x FROM events WHERE value > -1")
def math_log1p(t):
    return t.events.filter(F.col("value") > -1).select("event_id", F.round(F.log1p("value"), 6).alias("x"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax + l_discount = 0 THEN 0.5 ELSE l_tax / (l_tax + l_discount) END, 6) AS share FROM lineitem")
def math_safe_ratio(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(numbers.safe_ratio(F.col("l_tax"), F.col("l_tax") + F.col("l_discount")), 6).alias("share"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'Sea_View Twin_Room' ELSE p_brand END AS tags FROM lineitem JOIN part ON l_partkey = p_partkey")
def arr_normalise_join(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    items = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("Sea View"), F.lit("Twin Room"))).otherwise(F.array("p_brand"))
    return rows.select("l_orderkey", "l_linenumber", strings.joined_items(items).alias("tags"))


@query("WITH l AS (SELECT page_id, regexp_extract_all(html, '<(?:li|td)[^>]*><a[^>]*>([^<]*)</a>', 1) AS a FROM pages) SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, a[pos] AS link FROM (SELECT *, generate_subscripts(a, 1) AS pos FROM l) WHERE pos > 1")
def html_link_extract(t):
    links = t.pages.select("page_id", F.posexplode(strings.link_texts(F.col("html"))).alias("pos", "link"))
    return links.filter(F.col("pos") > 0)


@query("WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '<a[^>]*>([^<]*)</a>', 1) AS a FROM pages) SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, a[pos] AS link FROM (SELECT *, generate_subscripts(a, 1) AS pos FROM l)")
def html_table_links(t):
    # the pages have lists and no tables: each list becomes a table of one class, each item a row
    table = strings.replace_each(F.col("html"), {"<ul>": '<table border="1" class="wide standard">', "</ul>": "</table>", "<li>": "<tr class='x'>\n <td>", "</li>": "</td> </tr>"})
    return t.pages.select("page_id", F.posexplode(html.table_links(table, "standard")).alias("pos", "link"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text FROM documents")
def src_csv_roundtrip(t):
    import uuid

    folder = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/csv-{uuid.uuid4().hex}"
    rows = t.documents.select("doc_id", "lang", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("text"))
    sources.write_csv(rows, path)
    return sources.read_csv(t.spark, path, rows.schema)


# Features -------------------------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT p_name AS k FROM part GROUP BY p_name HAVING count(DISTINCT p_brand || ' ' || p_type) <> 1) SELECT p_partkey, CASE WHEN k IS NULL THEN p_name ELSE p_name || ' ' || p_brand END AS full_name FROM part LEFT JOIN s ON p_name = k")
def feat_dedupe_name(t):
    rows = t.part.withColumn("address", F.concat_ws(" ", "p_brand", "p_type"))
    return features.distinct_names(rows, "p_name", "address").select("p_partkey", "full_name")


@query("WITH b AS (SELECT p_name AS k FROM part GROUP BY p_name HAVING avg(p_retailprice) >= 950 AND count(*) >= 35) SELECT p_partkey, coalesce(k, 'other') AS group_name FROM part LEFT JOIN b ON p_name = k")
def feat_top_or_other(t):
    return features.top_or_other(t.part, "p_name", "p_retailprice", 950, 35).select("p_partkey", "group_name")


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM part")
def feat_ordinal_code(t):
    return features.ordinal_code(t.part, "p_brand", "code").select("p_partkey", "code")


@query(
    TAGGED
    + f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(mobile AS INTEGER) AS mobile, CAST(pet AS INTEGER) AS pet, CAST(trip <> 'Business trip' AS INTEGER) AS leisure,
  CAST(list_position({_LIST(features.PARTY_CODES)}, party) AS INTEGER) AS party, CAST(nights AS DOUBLE) AS nights,
  coalesce(room, CASE WHEN pet THEN '{features.PET_TAG}' WHEN mobile THEN '{features.MOBILE_TAG}' ELSE 'Stayed ' || nights || CASE WHEN nights = 1 THEN ' night' ELSE ' nights' END END) AS room_tag FROM parts"""
)
def feat_tags(t):
    return features.with_tag_features(t.tagged, "tags").drop("tags", "l_quantity")


@query(
    TAGGED
    + """SELECT l_orderkey, l_linenumber, l_partkey, CASE room WHEN 'Superior Double Room' THEN 'Superior' WHEN 'Twin Room' THEN 'Double' WHEN 'Suite with Sea View' THEN 'Suite' WHEN 'Loft' THEN 'Other'
  WHEN 'Deluxe King Room' THEN 'Deluxe' WHEN 'Room without Window' THEN 'without Window' ELSE 'Other' END AS room_type, CAST(coalesce(room = 'Suite with Sea View', FALSE) AS INTEGER) AS has_view FROM parts"""
)
def feat_first_match_class(t):
    tag = F.col("room_tag")
    return features.with_tag_features(t.tagged, "tags").select("l_orderkey", "l_linenumber", "l_partkey", features.room_type(tag).alias("room_type"), features.has_view(tag).alias("has_view"))


@query(
    "SELECT p_partkey, "
    + ", ".join(f"CAST(p_type = '{v}' AS INTEGER) AS p_type_{v}" for v in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " FROM part"
)
def feat_one_hot(t):
    return features.one_hot(t.part.select("p_partkey", "p_type"), "p_type").drop("p_type")


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS a, (l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(a - b, 6) AS gap, CAST(a - b >= 0 AS INTEGER) AS up FROM s")
def feat_minmax_diff(t):
    scaled = features.min_max(t.lineitem, ["l_quantity", "l_extendedprice"])
    gap = F.col("l_quantity_scaled") - F.col("l_extendedprice_scaled")
    return scaled.select("l_orderkey", "l_linenumber", "l_partkey", F.round(gap, 6).alias("gap"), predicates.flag(gap >= 0).alias("up"))


@query(
    TAGGED
    + f"""SELECT tag, count(*) AS n FROM (SELECT unnest([trip, party, room, 'Stayed ' || nights || CASE WHEN nights = 1 THEN ' night' ELSE ' nights' END, CASE WHEN mobile THEN '{features.MOBILE_TAG}' END, CASE WHEN pet THEN '{features.PET_TAG}' END]) AS tag FROM parts)
  WHERE tag IS NOT NULL GROUP BY tag ORDER BY n DESC, tag LIMIT 100"""
)
def feat_top_tags(t):
    return relational.count_by(t.tagged.select(F.explode(strings.quoted_items(F.col("tags"))).alias("tag")), "tag").limit(100)


# Polarity -------------------------------------------------------------------------------------------------------------

_VALUES = "(VALUES " + ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in LEXICON) + ") AS v(token, valence)"
_SCORE = """n AS (SELECT doc_id, count(*) AS n FROM words WHERE token <> '' GROUP BY doc_id),
h AS (SELECT doc_id, count(*) AS n_hits, sum(valence) AS total, sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0 END) AS p, sum(CASE WHEN valence < 0 THEN 1 - valence ELSE 0 END) AS m, count(*) FILTER (valence <> 0) AS k
  FROM words JOIN lexicon USING (token) GROUP BY doc_id)
SELECT doc_id, n_hits, round(total, 6) AS total, round(m / (p + m + n - k), 3) AS neg, round(CAST(n - k AS DOUBLE) / (p + m + n - k), 3) AS neu, round(p / (p + m + n - k), 3) AS pos, round(total / sqrt(total * total + 15), 4) AS compound FROM h JOIN n USING (doc_id)"""


def _lexicon(t) -> DataFrame:
    return t.spark.createDataFrame(LEXICON, "token string, valence double")


@query(SCORED + f"lexicon AS (SELECT * FROM {_VALUES}), " + _SCORE)
def text_lexicon_score(t):
    return sentiment.lexicon_score(t.documents, "doc_id", "text", _lexicon(t))


@query(SCORED + f"lexicon AS (SELECT token, CASE WHEN token = 'of' THEN CAST(10 AS DOUBLE) ELSE valence END AS valence FROM {_VALUES} UNION ALL SELECT 'to', CAST(-10 AS DOUBLE)), " + _SCORE)
def text_lexicon_override(t):
    changes = t.spark.createDataFrame([("of", 10.0), ("to", -10.0)], "token string, valence double")
    return sentiment.lexicon_score(t.documents, "doc_id", "text", sentiment.overridden(_lexicon(t), changes))


@query(
    f"""WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS token FROM documents)
SELECT token AS phrase, CAST(1 AS BIGINT) AS n_hits, valence AS total, CASE WHEN valence < 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS neg, CAST(0 AS DOUBLE) AS neu, CASE WHEN valence > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS pos,
  round(valence / sqrt(valence * valence + 15), 4) AS compound FROM words JOIN {_VALUES} USING (token)"""
)
def text_word_probe(t):
    words = t.documents.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    return sentiment.word_scores(words, "word", _lexicon(t))


@query("SELECT doc_id, replace(replace(text, 'The ', 'Positive '), 'And ', '') AS text FROM documents")
def text_placeholders(t):
    return t.documents.select("doc_id", strings.replace_each(F.col("text"), {"The ": "Positive ", "And ": ""}).alias("text"))


_BOOST = " + ".join(f"coalesce(CASE b{k} WHEN 'in' THEN 1 WHEN 'for' THEN -1 END, 0) * CAST({sentiment.STEP * left} AS DOUBLE) * sign(v)" for k, left in sentiment.DAMPED.items())
_NEGATED = " OR ".join(f"coalesce(b{k} IN ('not', 'is'), FALSE)" for k in sentiment.DAMPED)


@query(
    f"""WITH lexicon AS (SELECT * FROM {_VALUES}),
d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^[^\\p{{L}}'']+|[^\\p{{L}}'']+$', '', 'g'), '[^\\p{{L}}'']+') AS w,
  least(length(text) - length(replace(text, '!', '')), {sentiment.MOST_EXCLAMATIONS}) AS bangs, length(text) - length(replace(text, '?', '')) AS asks FROM documents),
words AS (SELECT doc_id, bangs, asks, unnest(w) AS raw, generate_subscripts(w, 1) AS pos FROM d),
f AS (SELECT *, lower(raw) AS token, upper(raw) = raw AND lower(raw) <> raw AND length(raw) > 1 AS caps FROM words WHERE raw <> ''),
x AS (SELECT f.*, coalesce(valence, 0) AS v, {", ".join(f"lag(token, {k}) OVER p AS b{k}" for k in sentiment.DAMPED)},
  max(CASE WHEN token = 'but' THEN pos END) OVER q AS but, bool_and(caps) OVER q AS all_caps
  FROM f LEFT JOIN lexicon USING (token) WINDOW p AS (PARTITION BY doc_id ORDER BY pos), q AS (PARTITION BY doc_id)),
y AS (SELECT *, (v + CASE WHEN caps AND NOT all_caps THEN sign(v) * CAST({sentiment.CAPITALS} AS DOUBLE) ELSE 0 END + {_BOOST}) * CASE WHEN {_NEGATED} THEN CAST({sentiment.NEGATED} AS DOUBLE) ELSE 1 END
  * CASE WHEN pos < but THEN {sentiment.BEFORE_BUT} WHEN pos > but THEN {sentiment.AFTER_BUT} ELSE 1 END AS r FROM x),
z AS (SELECT *, CASE WHEN v = 0 THEN CAST(0 AS DOUBLE) ELSE r END AS s FROM y),
g AS (SELECT doc_id, sum(s) AS total, sum(CASE WHEN s > 0 THEN s + 1 ELSE 0 END) AS p, sum(CASE WHEN s < 0 THEN 1 - s ELSE 0 END) AS m, CAST(count(*) FILTER (s = 0) AS DOUBLE) AS u,
  max(bangs) * CAST({sentiment.EXCLAMATION} AS DOUBLE) + CASE WHEN max(asks) > 3 THEN CAST({sentiment.MANY_QUESTIONS} AS DOUBLE) WHEN max(asks) > 1 THEN max(asks) * CAST({sentiment.QUESTION} AS DOUBLE) ELSE 0 END AS e FROM z GROUP BY doc_id),
h AS (SELECT doc_id, total + sign(total) * e AS t, CASE WHEN p > m THEN p + e ELSE p END AS p, CASE WHEN m > p THEN m + e ELSE m END AS m, u FROM g)
SELECT doc_id, round(m / (p + m + u), 3) AS neg, round(u / (p + m + u), 3) AS neu, round(p / (p + m + u), 3) AS pos, round(t / sqrt(t * t + {sentiment.ALPHA}), 4) AS compound FROM h"""
)
def text_lexicon_context(t):
    return sentiment.context_score(t.documents, "doc_id", "text", _lexicon(t), ["not", "is"], {"in": 1, "for": -1})


# Statistics and model -------------------------------------------------------------------------------------------------

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]
_PAIRS = [(b, a) for k, b in enumerate(_NUMERIC) for a in _NUMERIC[:k]]


@query(" UNION ALL ".join(f"SELECT '{i}' AS col_i, '{j}' AS col_j, round(corr({i}, {j}), 6) AS r FROM lineitem" for i, j in _PAIRS))
def stat_corr_pearson(t):
    return stats.pearson(t.lineitem, _NUMERIC)


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT 'l_extendedprice' AS col_i, 'l_quantity' AS col_j, round(corr(a, b), 6) AS r FROM r")
def stat_corr_spearman(t):
    return stats.spearman(t.lineitem, ["l_quantity", "l_extendedprice"])


@query("SELECT 'twice' AS \"column\"")
def stat_corr_drop(t):
    rows = t.lineitem.withColumn("twice", 2 * F.col("l_quantity") + F.col("l_tax"))
    return stats.collinear(stats.pearson(rows, ["l_quantity", "l_discount", "twice"]), 0.9)


def _anova_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, round(((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY l_tax)"


@query(f"{_anova_sql('l_quantity')} UNION ALL {_anova_sql('l_discount')}")
def stat_anova_f(t):
    return stats.anova_f(t.lineitem, "l_tax", ["l_quantity", "l_discount"]).orderBy("f")


@query(f"SELECT * FROM ({_anova_sql('l_quantity')} UNION ALL {_anova_sql('l_discount')}) WHERE f >= 1")
def stat_select_features(t):
    return stats.selected(stats.anova_f(t.lineitem, "l_tax", ["l_quantity", "l_discount"]), 1.0)


@query("SELECT round(100 * avg(abs((l_tax - l_discount) / nullif(l_tax, 0))), 6) AS mape, count(*) FILTER (l_tax <> 0) AS n_used, count(*) FILTER (l_tax = 0) AS n_zero FROM lineitem")
def stat_mape(t):
    return stats.mape(t.lineitem, "l_tax", "l_discount")


@query("SELECT CASE WHEN substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 2) < 'cd' THEN 'train' ELSE 'valid' END AS split, count(*) AS n FROM lineitem GROUP BY 1")
def ml_split_counts(t):
    return model.split_counts(t.lineitem, "l_orderkey")


_CANDIDATES = ["p_size", "brand", "kind", "lines", "quantity", "discount", "tax", "returned"]
_TARGET = "total"


def _parts(t) -> DataFrame:
    """Parts with codes of their categories, what their line items say, and what these cost in all."""
    lines = t.lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"),
        F.sum("l_extendedprice").alias(_TARGET),
    )
    coded = features.ordinal_code(features.ordinal_code(t.part, "p_brand", "brand"), "p_type", "kind")
    return coded.join(lines, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "p_brand", *_CANDIDATES, _TARGET)


#: The last forest, by application and folder of tables: the queries of a session share one fit. Others go, as each fills some of the driver's memory.
_FORESTS: dict[tuple[str, str], tuple] = {}


def _fitted(t):
    """(the parts, the features that are left after screening, a forest fitted to the training part of them)."""
    parts, own = _parts(t), (t.spark.sparkContext.applicationId, t.folder)
    if own not in _FORESTS:
        train = parts.filter(model.in_training("p_partkey")).select(*_CANDIDATES, _TARGET).cache()
        try:
            # from one Gramian: the sums of 28 pairs are too long a plan to be compiled
            drop = {r[0] for r in stats.collinear(correlation.pearson(train, _CANDIDATES), 0.9).collect()}
            names = [c for c in _CANDIDATES if c not in drop]
            _FORESTS.clear()
            _FORESTS[own] = names, model.fit(train, names, _TARGET)
        finally:
            train.unpersist()
    return parts, *_FORESTS[own]


@query()
def ml_rf_eval(t):
    parts, names, forest = _fitted(t)
    return stats.mape(model.predict(parts.filter(~model.in_training("p_partkey")), forest, names), _TARGET, "prediction")


@query()
def ml_predict_join(t):
    parts, names, forest = _fitted(t)
    predicted = model.predict(parts, forest, names).select("p_partkey", "prediction")
    return t.part.join(predicted, "p_partkey").select("p_partkey", "p_name", "prediction")


@query()
def ml_importances(t):
    parts, names, forest = _fitted(t)
    return model.importances(parts, forest, names)


@query()
def ml_residual_rank(t):
    parts, names, forest = _fitted(t)
    return model.residual_rank(model.predict(parts, forest, names), "p_brand", _TARGET, "prediction", 10)
