"""Queries of this subpackage over the driver's tables: name -> function(spark, sf_dir), and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, kneser_ney, linededup, negatives, ranking, resampling, rules, secrets, sharding, simhash, tokenfiles, toxicity
from millrace.llm.labelled import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.files_and_back(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    model = kneser_ney.train(docs.filter(~held_out))
    scored = kneser_ney.score(docs, model)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return toxicity.apply(docs, index).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = rules.apply(docs, rules.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    counts = ranking.counted(docs)
    model = ranking.fit_counted(counts, labels.filter(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return ranking.apply_counted(counts, model, at=0.7).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_files, op3_language_model, op4_byte_bpe, op5_toxicity, op6_secret_scan, op7_quality_rules, op8_line_dedup, op9_quality_ranking, op10_simhash, op11_importance_resampling, op12_hilbert_sharding, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op1_decontamination": decontaminate.SQL, "op8_line_dedup": linededup.SQL, "op13_hard_negatives": negatives.SQL}
