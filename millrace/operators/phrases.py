"""Polarity with entries of several words: at each place the longest entry that begins there counts, from the left, and takes its words.

An entry of several words has its own valence instead of those of its words.  Entries meet a text by their first word, so only places
where one can begin are looked at, and of a text only the places that match are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import sentiment

#: Entries of a lexicon that may stand in the plan and be sent to every task.
FEW = 10_000


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.split(F.lower(text), pattern), lambda x: x != "")


def entries(lexicon: DataFrame, pattern: str = r"[^\p{L}]+") -> DataFrame:
    """(head, rest, valence) of (token, valence) rows: an entry's first word and the others; entries without a word are left out.

    Entries that are the same words are one; it has the largest of their valences.
    """
    words = lexicon.select(_split(F.col("token"), pattern).alias("w"), "valence").filter(F.size("w") > 0)
    return words.groupBy("w").agg(F.max("valence").alias("valence")).select(F.col("w")[0].alias("head"), F.slice("w", F.lit(2), F.size("w")).alias("rest"), "valence")


def leftmost_longest(matches: Column) -> Column:
    """Of (at, length, valence) structs in the order of ``at``, one for each place, those that begin after the last one taken ends."""
    free = F.lit(0)
    start = F.struct(free.alias("free"), F.array().cast("array<struct<at: int, length: int, valence: double>>").alias("taken"))

    def step(s: Column, m: Column) -> Column:
        taken = F.struct((m["at"] + m["length"]).alias("free"), F.array_append(s["taken"], m).alias("taken"))
        return F.when(m["at"] >= s["free"], taken).otherwise(s)

    return F.aggregate(matches, start, step, lambda s: s["taken"])


def matches(df: DataFrame, key: str, text: str, lexicon: DataFrame, pattern: str = r"[^\p{L}]+") -> DataFrame:
    """(key, n, taken): of each text with an entry the number of its words and its entries in order, structs (at, length, valence)."""
    known = entries(lexicon, pattern)
    few = known.limit(FEW + 1).collect()
    longest = known.agg(F.max(F.size("rest"))).first()[0] or 0
    rows = df.select(key, F.monotonically_increasing_id().alias("__row"), _split(F.col(text), pattern).alias("__w"))
    following = lambda i: F.slice("__w", i + 2, F.lit(longest)) if longest else F.array().cast("array<string>")
    place = lambda i: F.struct(F.get("__w", i).alias("head"), i.alias("at"), following(i).alias("next"))
    if len(few) <= FEW:
        # only places where an entry can begin become rows, and the entries go to all tasks
        known = F.broadcast(df.sparkSession.createDataFrame(few, known.schema))
        heads = sorted({r["head"] for r in few})
        at = F.filter(F.transform("__w", lambda w, i: F.when(w.isin(heads), i)), lambda i: i.isNotNull()) if heads else F.array().cast("array<int>")
        places = F.transform(at, place)
    else:
        places = F.transform("__w", lambda _, i: place(i))
    words = rows.select(key, "__row", F.size("__w").alias("__n"), F.explode(places).alias("p")).select(key, "__row", "__n", "p.*")
    met = words.join(known, "head").filter(F.slice("next", F.lit(1), F.size("rest")) == F.col("rest"))
    best = F.max(F.struct((F.size("rest") + 1).alias("length"), F.col("valence").cast("double").alias("valence"))).alias("m")
    at_places = met.groupBy("__row", "at").agg(best, F.first(key).alias(key), F.first("__n").alias("__n"))
    m = F.struct("at", F.col("m.length").alias("length"), F.col("m.valence").alias("valence"))
    # as many matches as a text has words at most
    texts = at_places.groupBy("__row").agg(F.first(key).alias(key), F.first("__n").alias("n"), F.array_sort(F.collect_list(m)).alias("found"))
    return texts.select(key, "n", leftmost_longest(F.col("found")).alias("taken"))


def score(df: DataFrame, key: str, text: str, lexicon: DataFrame, pattern: str = r"[^\p{L}]+") -> DataFrame:
    """(key, n_hits, total, neg, neu, pos, compound) of the rows with an entry, as ``sentiment.lexicon_score``; a key may stand on several rows.

    A matched entry is one unit of the text, whatever its number of words.
    """
    found = matches(df, key, text, lexicon, pattern)
    sum_of = lambda f: F.aggregate("taken", F.lit(0.0), lambda a, m: a + f(m["valence"]))
    units = F.aggregate("taken", F.col("n"), lambda a, m: a - m["length"] + 1)
    marked = F.size(F.filter("taken", lambda m: m["valence"] != 0))
    parts = found.select(
        key,
        F.size("taken").cast("long").alias("n_hits"),
        sum_of(lambda v: v).alias("total"),
        sum_of(lambda v: F.when(v > 0, v + 1).otherwise(0.0)).alias("p"),
        sum_of(lambda v: F.when(v < 0, v - 1).otherwise(0.0)).alias("m"),
        (units - marked).cast("double").alias("z"),
    )
    shares = sentiment._shares(F.col("p"), F.col("m"), F.col("z"))
    return parts.select(key, "n_hits", F.round("total", 6).alias("total"), *[c.alias(k) for k, c in shares.items()], F.round(sentiment.compound(F.col("total")), 4).alias("compound"))


def probe(df: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """(phrase, n_hits, total, neg, neu, pos, compound) of each distinct word or phrase of a column on its own; an entry of several words counts as one."""
    texts = df.select(F.lower(F.col(column)).alias("phrase")).filter(F.col("phrase") != "").distinct()
    return score(texts, "phrase", "phrase", lexicon)
