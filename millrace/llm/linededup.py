"""Line dedup by distinct-site spread, in DataFrame operations only.

Each line's hash gets a HyperLogLog sketch of the sites that it stands on; sketches merge by aggregation, so a line on
a third of all documents is no more work for a task than another.  Lines whose estimate is clear of the threshold are
decided by it, lines near it get an exact distinct count.  A line on at least ``sites`` sites is boilerplate: it stays in
its first document (the smallest doc_id that has it) and goes from all others.

A line is known by 64 bits of a hash.  Lines that share one count as one line: among 10^9 distinct lines the odds that any two do
are 1 in 37, among 10^11 some 270 pairs are to be expected, and a pair matters only where their sites together reach the threshold.

Defined cases: a null text stays null; a null site is no site; lines are compared as they are, and those with fewer than
``min_words`` words (counted by blanks) and fewer than ``min_chars`` characters besides blanks (for scripts that don't use
them) are never boilerplate; a line that stands several times in its first document stays there as often; texts of any length
and number of lines are worked on whole; equal rows are separate documents with the same result, so all of them keep a line
whose first document they are; null ids are never first unless all are null; other columns, whatever their names, stay as they
are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import packed, stored, unpacked, wide_key

SITES, MIN_WORDS, MIN_CHARS = 5, 3, 20
#: Sketches of 2 ** LG_K registers; three standard errors of the estimate near ``sites`` are below MARGIN * sites + 1.
LG_K, MARGIN = 10, 0.1
#: Lines (two numbers each) that are sent to every executor at most.
SENT = 500_000


def _counts(line: Column, min_words: int, min_chars: int) -> Column:
    solid = F.length(F.replace(line, F.lit(" "), F.lit("")))
    return (F.length(line) - solid >= min_words - 1) | (solid >= min_chars)


def _beside(lines: DataFrame, n: int) -> DataFrame:
    """A table of at most ``n`` lines for a join: sent to every executor if that is few enough, else left to the planner."""
    return F.broadcast(lines) if n <= SENT else lines


def boilerplate(lines: DataFrame, sites: int = SITES) -> tuple[DataFrame, int]:
    """(line) of the line hashes that stand on at least ``sites`` distinct sites, from (line, site), and a bound of their number."""
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    estimates = stored(sketches.select("line", F.hll_sketch_estimate("sketch").alias("n")).filter(F.col("n") >= F.lit(sites * (1 - MARGIN) - 1)), "spread")
    most = estimates.count()
    high = sites * (1 + MARGIN) + 1
    near = estimates.filter(F.col("n") <= F.lit(high)).select("line")
    exact = lines.join(_beside(near, most), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("site").alias("n")).filter(F.col("n") >= sites)
    return stored(estimates.filter(F.col("n") > F.lit(high)).select("line").unionByName(exact.select("line")), "boilerplate"), most


def marked(docs: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, n_lines, left): each whole row of ``docs``, the number of its lines, and the lines that stay if any goes, else null.

    What goes depends on a row's id and text alone, so rows meet what goes from them by the hash of both.
    """
    cut = docs.select(wide_key().alias("key"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("site"), F.explode(F.split(F.col("text"), "\n")).alias("l"))
    lines = stored(cut.filter(_counts(F.col("l"), min_words, min_chars)).select("key", "id", "site", F.xxhash64("l").alias("line")), "lines")
    spread, most = boilerplate(lines, sites)
    held = stored(lines.join(_beside(spread, most), "line", "left_semi").select("key", "id", "line").distinct(), "held")
    first = held.groupBy("line").agg(F.min("id").alias("first"))
    gone = held.join(_beside(first, most), "line").filter(~F.col("id").eqNullSafe(F.col("first"))).groupBy("key").agg(F.collect_set("line").alias("gone"))
    # in groups as many as the root of their number, so that a long text doesn't compare each line with all that go
    many = F.ceil(F.sqrt(F.size("gone"))).cast("int")
    gone = gone.select("key", F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.filter("gone", lambda x: F.pmod(x, many) == b)).alias("gone"))
    parts = F.split(F.col("row.text"), "\n")
    group = lambda h: F.get(F.col("gone"), F.pmod(h, F.size("gone")).cast("int"))
    left = F.filter(parts, lambda l: ~(F.array_contains(group(F.xxhash64(l)), F.xxhash64(l)) & _counts(l, min_words, min_chars)))
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    return packed(docs).join(gone, "key", "left").select("row", n_lines.alias("n_lines"), F.when(F.col("gone").isNotNull(), left).alias("left"))


def _text() -> Column:
    return F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))


def remove(docs: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, keep_emptied: bool = True) -> DataFrame:
    """The rows of ``docs`` with boilerplate taken out of ``text``; ``n_chars``, where it is, follows the text.

    Without ``keep_emptied``, rows of which nothing but white space is left go; those that had no line taken stay.
    """
    rows = marked(docs, sites, min_words, min_chars)
    if not keep_emptied:
        rows = rows.filter(F.col("left").isNull() | _text().rlike(r"\S"))
    n_chars = F.when(F.col("left").isNull(), F.col("row")["n_chars"]).otherwise(F.length(_text())).cast("long") if "n_chars" in docs.columns else F.lit(None)
    return unpacked(rows, docs.columns, text=_text(), n_chars=n_chars)


#: The same in SQL, with exact counts for all lines.
SQL = f"""
WITH cut AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
lines AS (SELECT *, length(l) - length(replace(l, ' ', '')) >= {MIN_WORDS - 1} OR length(replace(l, ' ', '')) >= {MIN_CHARS} AS counts FROM cut),
spread AS (SELECT l, min(doc_id) AS first FROM lines WHERE counts GROUP BY l HAVING count(DISTINCT source) >= {SITES}),
marked AS (SELECT a.doc_id, a.l, a.pos, coalesce(b.first <> a.doc_id, FALSE) AS gone FROM lines a LEFT JOIN spread b ON a.l = b.l AND a.counts)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text_sha256) of each document."""
    removed = F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("left")).cast("long")
    return marked(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", removed.alias("n_removed"), F.sha2(_text().cast("binary"), 256).alias("text_sha256"))
