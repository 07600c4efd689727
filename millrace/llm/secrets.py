"""Secret scan with a random forest that removes false positives, in DataFrame and ML operations only.

Candidates are values that stand after a secret's name and = or :, whatever their length and characters, and any other run of
at least ``MIN_LENGTH`` letters, digits and _ + / -, with or without digits.  Each gets features: its length, the shares of
transitions between lower case, capitals, digits and the rest, the share of its letters in dictionary words, how many of its
characters differ, whether the path (the documents' ``source``) names tests or examples, and what the neighbouring words say.
A forest fitted to labelled findings scores them.

The dictionary holds the words of letters that stand ``LEAST`` times or more in all documents; a candidate is cut into words at
everything but letters and where capitals follow small letters.

Findings are labelled by the caller, or made by ``generated``: texts of dictionary words around keys, passwords and tokens of
many formats (label 1), and around digests, identifiers, numbers, dates, paths, camel-case names, placeholders and long words
(label 0), which go through the same search as the documents.  Their number is a parameter.  A fit to labelled findings of the
caller reads ``most`` of them or nearly so, chosen by hash.

Defined cases: null and empty texts have no findings; null ids and paths stay; texts of any length are searched whole, a value
ends at white space or a quotation mark; equal rows give equal findings, and equal candidates with equal neighbours get equal
scores; without labels of both kinds the score is the share of label 1; other columns, whatever their names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.scratch import stored

MOST, MIN_LENGTH, LEAST = 20_000, 16, 3
#: Generated findings for a fit, and dictionary words that they are made with.
GENERATED, VOCABULARY = 12_000, 512
_CHARS = r"A-Za-z0-9_+/\-"
#: The start of a run is anchored and its characters are never given back, so a long word costs one pass.
_RUN = rf"(?<![{_CHARS}])[{_CHARS}]{{{MIN_LENGTH},}}+"
_CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9"}
#: Words that name a secret when they stand before it, and such as name a digest or an identifier.
_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer"
_DIGESTS = "commit|sha|md5|digest|checksum|hash|etag|uuid|guid|rev|blob|version|id"
_ASSIGN = rf"(?i)(?:(?:{_NAMES})[\w\-.]*[\"'`\])]*\s*(?:=>|:=|[=:])|\bbearer(?=\s))"
_VALUE = _ASSIGN + r"\s*[\"'`(\[{<]*([^\s\"'`]+)[\"'`]?\S*$"
_NOT_END = r"[,;)\]}>.]+$"


def findings(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, path, position, word, candidate, before, before2, after, columns to keep): ``position`` counts the words of the text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("path"), F.col("text").cast("string").alias("text"), *keep)
    some = texts.filter(F.regexp_like("text", F.lit(_RUN)) | F.regexp_like("text", F.lit(_ASSIGN)))
    words = some.withColumn("w", F.split("text", r"[\x20\x09-\x0D]+")).drop("text")
    near = lambda i, k: F.coalesce(F.get(F.col("w"), i + k), F.lit(""))
    # words with their neighbours, chosen before they become rows: a row never carries its whole text
    beside = F.transform("w", lambda x, i: F.struct(i.alias("position"), x.alias("word"), near(i, -1).alias("before"), near(i, -2).alias("before2"), near(i, 1).alias("after")))
    value = lambda x: F.regexp_extract(F.concat_ws(" ", x["before2"], x["before"], x["word"]), _VALUE, 1)
    likely = F.filter(beside, lambda x: ((F.length(x["word"]) >= MIN_LENGTH) & F.regexp_like(x["word"], F.lit(_RUN))) | (value(x) != ""))
    at = words.select("doc_id", "path", *keep, F.explode(likely).alias("x")).select("doc_id", "path", *keep, "x.*", F.regexp_replace(value(F.col("x")), _NOT_END, "").alias("value"))
    rest = F.when(F.col("value") == "", F.col("word")).otherwise(F.replace(F.col("word"), F.col("value"), F.lit(" ")))
    runs = F.regexp_extract_all(rest, F.lit(f"({_RUN})"), F.lit(1))
    every = F.array_distinct(F.filter(F.concat(F.array("value"), runs), lambda x: x != ""))
    return at.select("doc_id", "path", "position", "word", "before", "before2", "after", *keep, F.explode(every).alias("candidate"))


def dictionary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(fragment): the lower-cased words of three letters or more that stand in the texts ``least`` times or more."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}]+")).alias("fragment"))
    counts = words.filter(F.length("fragment").between(3, 40) & ~F.regexp_like("fragment", F.lit(r"\p{N}"))).groupBy("fragment").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least).select("fragment")


def _fragments(candidates: DataFrame) -> DataFrame:
    apart = F.regexp_replace("candidate", "([a-z])([A-Z])", "$1 $2")
    return candidates.select("candidate", F.explode(F.split(F.lower(apart), "[^a-z]+")).alias("fragment")).filter(F.length("fragment") >= 3)


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.greatest(F.length("candidate") - 1, F.lit(1))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The findings with their features; ``words`` is the dictionary (column ``fragment``, distinct)."""
    known = _fragments(found.select("candidate").distinct()).join(words, "fragment").groupBy("candidate").agg(F.sum(F.length("fragment")).alias("known"))
    shares = {f"{a}_{b}": _share(f"[{x}](?=[{y}])") for a, x in _CLASSES.items() for b, y in _CLASSES.items()}
    counts = {f"{a}s": F.regexp_count("candidate", F.lit(f"[{x}]")) / F.length("candidate") for a, x in _CLASSES.items()}
    left = F.lower(F.concat_ws(" ", "before2", "before", F.expr("substring_index(word, candidate, 1)")))
    out = found.join(known, "candidate", "left").withColumns(
        {
            "length": F.length("candidate").cast("double"),
            **{k: v.cast("double") for k, v in {**shares, **counts}.items()},
            "known_share": F.coalesce(F.col("known"), F.lit(0)) / F.length("candidate"),
            "distinct_share": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
            "hex_only": F.regexp_like("candidate", F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")).cast("double"),
            "parts": F.regexp_count("candidate", F.lit(r"[_+/\-.:]")).cast("double"),
            "named": F.regexp_like(left, F.lit(rf"(?:{_NAMES})")).cast("double"),
            "digest": F.regexp_like(left, F.lit(rf"(?:^|[^a-z])(?:{_DIGESTS})")).cast("double"),
            "assigned": F.regexp_like(left, F.lit("[=:]")).cast("double"),
            "quoted": F.regexp_like("word", F.lit("[\"'`]")).cast("double"),
            "test_path": F.coalesce(F.regexp_like("path", F.lit("(?i)test|example|sample|fixture")), F.lit(False)).cast("double"),
        }
    )
    return out.drop("known")


def feature_names() -> list[str]:
    return ["length", *[f"{a}_{b}" for a in _CLASSES for b in _CLASSES], *[f"{a}s" for a in _CLASSES], "known_share", "distinct_share", "hex_only", "parts", "named", "digest", "assigned", "quoted", "test_path"]


def _formats(words: Column, n_words: int) -> tuple[dict[str, tuple[Column, Column]], dict[str, tuple[Column, Column]]]:
    """name -> (the string, what stands around it, ``{}`` for the string) of secrets, and of others, as functions of id and seed."""
    number = lambda salt, m: F.pmod(F.xxhash64("id", "seed", F.lit(salt)), F.lit(m)).cast("int")
    word = lambda salt: F.get(words, number(f"w{salt}", n_words))
    name = lambda salt: F.initcap(word(salt))
    hexes = lambda salt: F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.col("seed").cast("string"), F.lit(salt)), 256)
    mixed = lambda salt: F.translate(F.base64(F.unhex(hexes(salt))), "+/=", "")
    cut = lambda c, low, high: F.substring(c, F.lit(1), low + number(f"n{low}{high}", high - low + 1))
    one = lambda *x: F.get(F.array(*map(F.lit, x)), number("o" + x[0], len(x)))
    capitals = F.translate(F.upper(F.concat(hexes("k"), hexes("l"))), "0123456789ABCDEF", "Q2R3S4T5U6V7WXYZ")
    key = one("token", "api_key", "API_KEY", "secret", "access_key", "auth_token", "SECRET_KEY", "client_secret", "credential")
    login = one("password", "passwd", "pwd", "DB_PASSWORD", "password")
    set_to = lambda k: F.concat(k, one(' = "{}"', " = '{}'", "={}", ": {}", ' := "{}"', '": "{}",'))
    letters = F.translate(mixed("a"), "0123456789", "kQzWxJvYbH")
    date = F.date_format(F.timestamp_seconds(F.lit(1_300_000_000) + number("t", 400_000_000)), "yyyy-MM-dd'T'HH-mm-ss")
    secrets = {
        "hex": (cut(hexes("a"), 24, 64), set_to(key)),
        "hex 40": (F.substring(hexes("b"), 1, 40), set_to(key)),
        "capital hex": (F.upper(cut(hexes("c"), 24, 64)), set_to(F.upper(key))),
        "mixed": (cut(mixed("d"), 16, 43), set_to(key)),
        "letters": (cut(letters, 16, 40), set_to(key)),
        "key id": (F.concat(one("AKIA", "ASIA"), F.substring(capitals, 1, 16)), one("{}", "key {}", "aws_access_key_id = {}", '"{}"')),
        "prefixed": (F.concat(one("ghp_", "sk-", "xoxb-", "glpat-", "pat_"), cut(mixed("e"), 24, 40)), one("{}", "use {}", "token: {}", '"{}",')),
        "bearer": (F.concat(cut(mixed("f"), 16, 30), F.lit("."), cut(mixed("g"), 16, 40)), F.lit("Authorization: Bearer {}")),
        "password": (F.concat(name(1), number("y", 9000).cast("string"), one("!", "#", "$", "?", "%", "")), set_to(login)),
        "password of signs": (F.concat(cut(mixed("h"), 5, 14), one("!", "@x", "#", "$7", "%", "^")), set_to(login)),
    }
    plain = {
        "commit": (F.substring(hexes("m"), 1, 40), one("commit {}", "rev: {}", "blob {}", "sha1 = {}")),
        "digest": (cut(hexes("n"), 32, 64), one("sha256:{}", "md5 {}", "checksum: {}", 'etag = "{}"', "hash {}")),
        "uuid": (F.regexp_replace(hexes("o"), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"), one("{}", "uuid {}", "id: {}", "request {}")),
        "number": (F.regexp_replace(F.conv(F.substring(hexes("p"), 1, 15), 16, 10), "^0+", ""), one("{}", "{}.", "number {}", "order: {}")),
        "card": (F.lpad(F.conv(F.substring(hexes("q"), 1, 12), 16, 10), 16, "4"), one("{}", "{},", "card {}")),
        "date": (date, one("{}", "at {}", "version: {}")),
        "path": (F.concat_ws("/", word(2), word(3), word(4), F.concat_ws("-", word(5), number("s", 9).cast("string"))), one("{}", "see {}", "file: {}")),
        "camel case": (F.concat(word(6), name(7), name(8), name(9), number("u", 20).cast("string")), one("{}", "call {}", "{}()", "x = {}")),
        "snake case": (F.concat_ws("_", word(10), word(11), word(12), word(13)), one("{}", "{} = 1", "field: {}")),
        "long word": (F.concat(word(14), word(15), word(16)), F.lit("{}")),
        "long capitals": (F.upper(F.concat(word(17), word(18), word(19))), one("{}", "{}!!")),
        "placeholder": (one("your_token_here", "changeme", "xxxxxxxxxxxxxxxx", "********", "example", "${TOKEN}", "null", "None", "REPLACE_ME", "<secret>", "dummy", "0000000000000000"), set_to(key)),
        "word after name": (word(20), one("token: {}", "the secret: {}", "password: {}", "auth = {}")),
        "test key": (cut(hexes("r"), 24, 40), set_to(key)),
    }
    return secrets, plain


def generated(spark: SparkSession, words: DataFrame, n: int = GENERATED, seed: int = 1) -> DataFrame:
    """(doc_id, source, text, planted, label, kind): ``n`` texts with one string each, half of them secrets (label 1).

    Secrets' kinds and those of others follow one another by id.  ``words`` is the dictionary; the texts use the VOCABULARY ones
    with the least hashes, fewer if there are fewer.  Of "test key" the source names tests: secrets in them are none.
    """
    chosen = [r[0] for r in words.orderBy(F.xxhash64("fragment"), "fragment").limit(VOCABULARY).collect()] or ["word"]
    listed = F.array(*map(F.lit, chosen))
    rows = spark.range(n).withColumn("seed", F.lit(seed))
    secrets, plain = _formats(listed, len(chosen))
    half = F.floor(F.col("id") / 2).cast("int")
    choice = lambda formats: F.get(F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("planted"), around.alias("around")) for k, (s, around) in formats.items()]), F.pmod(half, F.lit(len(formats))))
    label = F.pmod(F.col("id"), F.lit(2)).cast("int")
    made = rows.select("id", "seed", label.alias("label"), F.when(label == 1, choice(secrets)).otherwise(choice(plain)).alias("x")).select("id", "seed", "label", "x.*")
    prose = lambda salt: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.get(listed, F.pmod(F.xxhash64("id", "seed", F.lit(salt), k), F.lit(len(chosen))).cast("int"))), " ")
    source = F.when(F.col("kind") == "test key", F.lit("tests/fixtures/keys")).when(F.pmod(F.xxhash64("id", F.lit("src")), F.lit(10)) == 0, F.lit("examples")).otherwise(F.lit("web"))
    return made.select(F.col("id").alias("doc_id"), source.alias("source"), F.concat_ws(" ", prose("before"), F.replace(F.col("around"), F.lit("{}"), F.col("planted")), prose("after")).alias("text"), "planted", "label", "kind")


def labelled_findings(texts: DataFrame) -> DataFrame:
    """The findings of ``generated`` texts with (planted, label, kind): what isn't the planted string has label 0."""
    found = findings(texts, "planted", "label", "kind")
    hit = (F.col("candidate") == F.col("planted")) | F.col("candidate").contains(F.col("planted"))
    return found.withColumn("label", F.when(hit, F.col("label")).otherwise(0).cast("double"))


class Forest:
    def __init__(self, model, rate: float):
        self.model, self.rate = model, rate

    def score(self, found: DataFrame) -> DataFrame:
        if self.model is None:
            return found.withColumn("score", F.lit(self.rate))
        scored = self.model.transform(_assembled(found))
        return scored.withColumn("score", vector_to_array("probability")[1]).drop("vector", "probability", "rawPrediction", "prediction")


def _assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=feature_names(), outputCol="vector").transform(found)


def fit(labelled: DataFrame, most: int = MOST, trees: int = 40, depth: int = 10) -> Forest:
    """A forest from findings with features and ``label``; equal candidates with equal neighbours count once."""
    known = labelled.filter(F.col("label").isNotNull()).dropDuplicates(["candidate", "named", "assigned", "digest", "test_path"])
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Forest(None, float(next(iter(counts), 0.0)) if counts else 0.0)
    share = most / total
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("candidate"), F.lit(1 << 32)) < int(share * (1 << 32)))
    rows = stored(_assembled(known).select("vector", "label"), "labelled-findings")
    model = RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, seed=42, maxMemoryInMB=64).fit(rows)
    return Forest(model, counts.get(1.0, 0) / total)


def fit_generated(spark: SparkSession, words: DataFrame, n: int = GENERATED, seed: int = 1) -> Forest:
    """A forest fitted to ``n`` generated findings."""
    found = stored(labelled_findings(generated(spark, words, n, seed)), "generated")
    return fit(features(found, words), most=max(n * 2, MOST))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Findings with features and ``score``, the chance that a finding is a secret.

    ``labelled`` are findings of the caller with ``label``, as ``findings`` gives them; without them the forest is fitted to
    ``generated`` ones.
    """
    found = stored(findings(docs), "findings")
    words = stored(dictionary(docs), "dictionary")
    rows = stored(features(found, words), "secret-features")
    forest = fit_generated(docs.sparkSession, words) if labelled is None else fit(features(labelled, words))
    return forest.score(rows)


def report(docs: DataFrame, cut: float = 0.5) -> DataFrame:
    """(doc_id, position, candidate_sha256, length, score, is_secret) of each finding; the secret itself is not repeated."""
    return scan(docs).select("doc_id", "position", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), F.col("length").cast("int").alias("length"), "score", (F.col("score") >= cut).alias("is_secret"))
