"""Queries of encoders that are fitted on some rows and applied to the rest, and of phrases in a lexicon."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import encoders, phrases, sentiment
from millrace.plans import catalog
from millrace.plans.catalog import query

# Encoders --------------------------------------------------------------------------------------------------------------

#: Four fifths of the parts are there to fit on; the others have a type that these don't.
_PARTS = "WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice, p_partkey % 5 <> 0 AS seen, CASE WHEN p_partkey % 5 = 0 AND p_size > 45 THEN 'NEW' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS kind FROM part) "


def _parts(t) -> tuple[DataFrame, DataFrame]:
    """(parts to fit on, the rest)."""
    kind = F.when((F.col("p_partkey") % 5 == 0) & (F.col("p_size") > 45), "NEW").when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(F.col("p_type"))
    rows = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice", kind.alias("kind"))
    return rows.filter(F.col("p_partkey") % 5 != 0), rows.filter(F.col("p_partkey") % 5 == 0)


def _kept(t, encoder: DataFrame) -> DataFrame:
    """The encoder as another run would find it: from where it was stored."""
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/encoder-{uuid.uuid4().hex}"
    encoders.save(encoder, path)
    return encoders.load(t.spark, path)


_CODE = "(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM p WHERE seen AND {c} IS NOT NULL))"


@query(_PARTS + f", k AS {_CODE.format(c='kind')}, s AS {_CODE.format(c='p_size')} SELECT p_partkey, CASE WHEN kind IS NOT NULL THEN coalesce(k.code, (SELECT count(*) FROM k)) END AS kind_code, coalesce(s.code, (SELECT count(*) FROM s)) AS size_code FROM p LEFT JOIN k ON kind = k.v LEFT JOIN s ON p_size = s.v WHERE NOT seen")
def feat_codes_fitted(t):
    train, rest = _parts(t)
    codes = _kept(t, encoders.fit_codes(train, ["kind", "p_size"]))
    return encoders.encode(rest, codes, {"kind": "kind_code", "p_size": "size_code"}, unseen="keep").select("p_partkey", "kind_code", "size_code")


@query(_PARTS + "SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM p WHERE seen)) / (SELECT CAST(max(p_size) - min(p_size) AS DOUBLE) FROM p WHERE seen), 6) AS size_scaled, round(greatest(least((p_retailprice - (SELECT min(p_retailprice) FROM p WHERE seen)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM p WHERE seen), 1), 0), 6) AS price_scaled FROM p WHERE NOT seen")
def feat_scale_fitted(t):
    train, rest = _parts(t)
    bounds = _kept(t, encoders.fit_bounds(train, ["p_size", "p_retailprice"]))
    scaled = encoders.scale(encoders.scale(rest, bounds, {"p_size": "a"}), bounds, {"p_retailprice": "b"}, clip=True)
    return scaled.select("p_partkey", F.round("a", 6).alias("size_scaled"), F.round("b", 6).alias("price_scaled"))


@query(_PARTS + ", b AS (SELECT kind AS k FROM p WHERE seen GROUP BY kind HAVING avg(p_retailprice) >= 950 AND count(*) >= 35) SELECT p_partkey, coalesce(k, 'other') AS group_name FROM p LEFT JOIN b ON kind = k WHERE NOT seen")
def feat_names_fitted(t):
    train, rest = _parts(t)
    names = _kept(t, encoders.fit_names(train, "kind", "p_retailprice", 950, 35))
    return encoders.top_or_other(rest, names, "kind").select("p_partkey", "group_name")


# Phrases ---------------------------------------------------------------------------------------------------------------

PHRASES = [("the", 0.5), ("of", -1.0), ("and", 1.5), ("of the", 1.2), ("The Of", -0.4), ("in the", -2.0), ("and the of", 2.5), ("of of the", -3.0), ("que", 0.0), ("de la", 1.0), ("der", -0.7)]
_ENTRIES = "(VALUES " + ", ".join(f"('{'  '.join(p.lower().split())}', CAST({v} AS DOUBLE))" for p, v in PHRASES) + ") AS v(token, valence)"
#: Longer entries first; words stand between blanks of their own, so that a match begins and ends with whole words.
_PATTERN = " (" + "|".join("  ".join(p.lower().split()) for p, _ in sorted(PHRASES, key=lambda x: -len(x[0].split()))) + ") "


@query(
    f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT doc_id, len(w) AS n, unnest(regexp_extract_all(' ' || array_to_string(w, '  ') || ' ', '{_PATTERN}', 1)) AS token FROM d),
h AS (SELECT doc_id, count(*) AS n_hits, sum(valence) AS total, sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0 END) AS p, sum(CASE WHEN valence < 0 THEN 1 - valence ELSE 0 END) AS m,
  max(n) - sum(len(string_split(token, '  ')) - 1) - count(*) FILTER (valence <> 0) AS z FROM m JOIN {_ENTRIES} USING (token) GROUP BY doc_id)
SELECT doc_id, n_hits, round(total, 6) AS total, round(m / (p + m + z), 3) AS neg, round(z / (p + m + z), 3) AS neu, round(p / (p + m + z), 3) AS pos, round(total / sqrt(total * total + 15), 4) AS compound FROM h"""
)
def text_phrase_score(t):
    return phrases.score(t.documents, "doc_id", "text", t.spark.createDataFrame(PHRASES, "token string, valence double"))


@query(
    f"""WITH d AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT DISTINCT array_to_string(w[k : k + 1], ' ') AS phrase, len(w[k : k + 1]) AS n FROM (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM d)),
m AS (SELECT phrase, n, unnest(regexp_extract_all(' ' || replace(phrase, ' ', '  ') || ' ', '{_PATTERN}', 1)) AS token FROM f),
h AS (SELECT phrase, count(*) AS n_hits, sum(valence) AS total, sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0 END) AS p, sum(CASE WHEN valence < 0 THEN 1 - valence ELSE 0 END) AS m,
  max(n) - sum(len(string_split(token, '  ')) - 1) - count(*) FILTER (valence <> 0) AS z FROM m JOIN {_ENTRIES} USING (token) GROUP BY phrase)
SELECT phrase, n_hits, round(total, 6) AS total, round(m / (p + m + z), 3) AS neg, round(z / (p + m + z), 3) AS neu, round(p / (p + m + z), 3) AS pos, round(total / sqrt(total * total + 15), 4) AS compound FROM h"""
)
def text_phrase_probe(t):
    """Every run of two words of the texts, and what it would score on its own."""
    words = t.documents.select(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "").alias("w"))
    runs = words.select(F.explode(F.transform("w", lambda x, i: F.array_join(F.slice("w", i + 1, F.lit(2)), " "))).alias("phrase"))
    return phrases.probe(runs, "phrase", t.spark.createDataFrame(PHRASES, "token string, valence double"))


# A lexicon of more words -------------------------------------------------------------------------------------------------

#: Frequent words of the corpus's four languages with signs, so that most texts have several of either.
WORDS = [
    ("the", 0.5), ("of", -1.0), ("and", 1.5), ("that", -0.25), ("with", 1.0), ("from", -0.5), ("this", 0.75), ("was", -0.75), ("by", 0.25), ("are", 1.25), ("at", -1.25), ("it", 0.0),
    ("der", 0.75), ("die", -0.75), ("das", 1.0), ("und", 1.25), ("den", -0.5), ("von", 0.25), ("zu", -1.0), ("mit", 0.5), ("sich", -0.25), ("auf", 1.75), ("nicht", -2.5), ("ist", 0.5),
    ("de", 0.25), ("la", -0.5), ("le", 0.5), ("des", -0.25), ("et", 0.5), ("les", -1.5), ("une", -0.75), ("pour", -1.75), ("dans", 0.25), ("pas", -2.25), ("qui", 1.0), ("sur", -1.0),
    ("que", -1.25), ("el", 1.0), ("los", 2.0), ("las", -2.0), ("del", 1.75), ("por", -0.75), ("un", 0.75),
]
_MORE = "(VALUES " + ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in WORDS) + ") AS v(token, valence)"


@query(catalog.ORACLES["text_lexicon_score"].replace(catalog._VALUES, _MORE))
def text_polarity_words(t):
    return sentiment.lexicon_score(t.documents, "doc_id", "text", t.spark.createDataFrame(WORDS, "token string, valence double"))


@query(catalog.ORACLES["text_lexicon_context"].replace(catalog._VALUES, _MORE))
def text_polarity_context(t):
    return sentiment.context_score(t.documents, "doc_id", "text", t.spark.createDataFrame(WORDS, "token string, valence double"), ["not", "is"], {"in": 1, "for": -1})
