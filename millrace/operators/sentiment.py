"""Lexicon-based polarity of texts, after the published rules of Hutto and Gilbert (ICWSM 2014).

The lexicon is a table (token, valence) of the caller.  A key names one text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Published constants: normalisation, scale of a negated valence, step of an intensifier and what is left of it two and
#: three words on, step of a word in capitals, weights before and after "but", steps for ! and ?.
ALPHA, NEGATED, STEP, DAMPED = 15.0, -0.74, 0.293, {1: 1.0, 2: 0.95, 3: 0.9}
CAPITALS, BEFORE_BUT, AFTER_BUT = 0.733, 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
#: Tokens of a lexicon that may stand in the plan.
FEW = 10_000


def overridden(lexicon: DataFrame, changes: DataFrame) -> DataFrame:
    """The lexicon with other valences for some tokens, and new tokens."""
    new = changes.select("token", F.col("valence").alias("__new"))
    return lexicon.join(new, "token", "full").select("token", F.coalesce("__new", "valence").alias("valence"))


def compound(total: Column) -> Column:
    return total / F.sqrt(total * total + ALPHA)


def _few_tokens(lexicon: DataFrame) -> list[str] | None:
    """The tokens of a lexicon that has few, each once; else None."""
    tokens = [r[0] for r in lexicon.select("token").limit(FEW + 1).collect()]
    return tokens if len(tokens) <= FEW and len(set(tokens)) == len(tokens) and None not in tokens else None


def _words(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def _shares(positive: Column, negative: Column, zeros: Column) -> dict[str, Column]:
    """The shares neg, neu and pos of a text; a word counts with its valence and one more, one without valence with one."""
    whole = F.nullif(positive + F.abs(negative) + zeros, F.lit(0.0))
    return {"neg": F.round(F.abs(negative / whole), 3), "neu": F.round(zeros / whole, 3), "pos": F.round(positive / whole, 3)}


def lexicon_score(df: DataFrame, key: str, text: str, lexicon: DataFrame, pattern: str = r"[^\p{L}]+") -> DataFrame:
    """(key, n_hits, total, neg, neu, pos, compound) of the texts that have a word of the lexicon.

    Words meet the lexicon before anything is grouped, so that only hits are shuffled where the lexicon is small.
    """
    words = df.select(key, _words(F.lower(F.col(text)), pattern).alias("__w"))
    tokens = words.select(key, F.size("__w").alias("__n"), F.explode("__w").alias("token"))
    v = F.col("valence")
    hits = tokens.join(lexicon, "token").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.sum(v).alias("total"),
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("__p"),
        F.sum(F.when(v < 0, v - 1).otherwise(0.0)).alias("__m"),
        (F.first("__n") - F.count_if(v != 0)).cast("double").alias("__z"),
    )
    shares = _shares(F.col("__p"), F.col("__m"), F.col("__z"))
    return hits.select(key, "n_hits", F.round("total", 6).alias("total"), *[c.alias(k) for k, c in shares.items()], F.round(compound(F.col("total")), 4).alias("compound"))


def context_score(df: DataFrame, key: str, text: str, lexicon: DataFrame, negators: Sequence[str], boosters: dict[str, int]) -> DataFrame:
    """(key, neg, neu, pos, compound) of every text with a word.

    A valence changes with the three words before it (negators; boosters, +1 or -1, toward the word's sign), with capitals in
    a text that isn't all capitals, and with its side of the last "but"; ! and ? add emphasis to the whole.  Each word takes
    what the rules need of its neighbours along before it becomes a row, so no row holds a text and nothing needs a window;
    only words of the lexicon are grouped.  With a lexicon of up to ``FEW`` tokens only these become rows, and texts are read once.
    """
    marks = lambda c: F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))
    parts = F.split(F.regexp_replace(F.col(text), r"^[^\p{L}']+|[^\p{L}']+$", ""), r"[^\p{L}']+")
    caps = lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 1)
    words = df.select(key, F.filter(parts, lambda x: x != "").alias("w"), marks("!").alias("bangs"), marks("?").alias("asks"))
    words = words.filter(F.size("w") > 0).withColumn("t", F.transform("w", lambda x: F.lower(x)))
    n = F.size("w")
    last_but = F.when(F.array_contains("t", "but"), n - F.array_position(F.reverse("t"), "but"))
    whole = words.withColumns({"n": n, "but": last_but, "all_caps": F.forall("w", caps)})
    near = lambda i, k: F.get(F.col("t"), i - k).alias(f"b{k}")
    beside = lambda w, i: F.struct(F.get(F.col("t"), i).alias("token"), i.alias("pos"), caps(w).alias("caps"), *[near(i, k) for k in DAMPED])
    tokens = _few_tokens(lexicon)
    if tokens is None:
        rows = whole.select(key, "but", "all_caps", F.explode(F.transform("w", beside)).alias("x")).select(key, "but", "all_caps", "x.*").join(lexicon, "token")
    else:
        # only words of the lexicon become rows; the first of a text, or a row without a word, stands for the text itself
        at = F.filter(F.transform("t", lambda x, i: F.when(x.isin(tokens), i)), lambda i: i.isNotNull())
        hits = F.transform(at, lambda i: beside(F.get("w", i), i))
        texts = whole.select(key, "but", "all_caps", "n", "bangs", "asks", F.posexplode_outer(hits).alias("__k", "x"))
        rows = texts.select(key, "but", "all_caps", "n", "bangs", "asks", "__k", "x.*").join(F.broadcast(lexicon), "token", "left")
    s = F.col("valence")
    sign = F.signum(s)
    s = s + F.when(F.col("caps") & ~F.col("all_caps"), sign * CAPITALS).otherwise(0.0)
    boost = F.create_map(*[F.lit(x) for k, v in boosters.items() for x in (k, float(v))]) if boosters else None
    negated = F.lit(False)
    for k, left in DAMPED.items():
        if boost is not None:
            s = s + F.coalesce(boost[F.col(f"b{k}")], F.lit(0.0)) * STEP * left * sign
        negated = negated | F.coalesce(F.col(f"b{k}").isin(list(negators)), F.lit(False))
    s = F.when(negated, s * NEGATED).otherwise(s)
    s = F.when(F.col("pos") < F.col("but"), s * BEFORE_BUT).when(F.col("pos") > F.col("but"), s * AFTER_BUT).otherwise(s)
    scored = rows.withColumn("s", F.when(F.col("valence") == 0, 0.0).otherwise(s))
    sums = [
        F.sum("s").alias("total"),
        F.sum(F.when(F.col("s") > 0, F.col("s") + 1).otherwise(0.0)).alias("p"),
        F.sum(F.when(F.col("s") < 0, F.col("s") - 1).otherwise(0.0)).alias("m"),
        F.count_if(F.col("s") != 0).alias("hits"),
    ]
    if tokens is None:
        every = words.groupBy(key).agg(F.sum(n).alias("n"), F.max("bangs").alias("bangs"), F.max("asks").alias("asks"))
        # a null key is a text like any other
        every = every.join(scored.groupBy(key).agg(*sums).withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
    else:
        once = F.when(F.coalesce("__k", F.lit(0)) == 0, F.col("n")).otherwise(0)
        every = scored.groupBy(key).agg(F.sum(once).alias("n"), F.max("bangs").alias("bangs"), F.max("asks").alias("asks"), *sums)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    emphasis = F.least("bangs", F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + F.when(F.col("asks") > 3, MANY_QUESTIONS).when(F.col("asks") > 1, F.col("asks") * QUESTION).otherwise(0.0)
    out = every.withColumns({"total": zero("total"), "p": zero("p"), "m": zero("m"), "u": F.col("n") - F.coalesce("hits", F.lit(0)), "e": emphasis})
    p = F.when(F.col("p") > F.abs("m"), F.col("p") + F.col("e")).otherwise(F.col("p"))
    m = F.when(F.abs("m") > F.col("p"), F.col("m") - F.col("e")).otherwise(F.col("m"))
    shares = _shares(p, m, F.col("u").cast("double"))
    return out.select(key, *[c.alias(k) for k, c in shares.items()], F.round(compound(F.col("total") + F.signum("total") * F.col("e")), 4).alias("compound"))


def word_scores(df: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """(phrase, n_hits, total, neg, neu, pos, compound) of each distinct word or phrase of a column on its own."""
    phrases = df.select(F.lower(F.col(column)).alias("phrase")).filter(F.col("phrase") != "").distinct()
    return lexicon_score(phrases, "phrase", "phrase", lexicon)
