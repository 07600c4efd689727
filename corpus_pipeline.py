"""A corpus pipeline: toxic documents, boilerplate lines, near copies and benchmark leaks go, and what stays is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``.  A stage that removes documents keeps those it finds
clean as they are; line dedup changes ``text``, and ``n_chars`` with it.

Defined cases: rows with a null id, text, source or other column go through all stages like others (a null text is empty and
stays null, a null source is no site, a null id is the last choice of its group); of repeated rows, and of all empty texts, one
stays as of any group of copies; of rows that tie for a group by id the one with the least hash of id and text stays; texts of
any length are worked on whole; further columns of ``documents``, whatever their names, are kept by all stages but the last;
without labels no document is toxic, without benchmark items none is contaminated, and without documents there are no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, linededup, simhash, toxicity
from millrace.llm.scratch import stored

#: 35 of the 36 pairs of different texts on sf0.1 with similarity >= 0.8 have fingerprints within as many bits, the last within 14.
NEAR_BITS = 13


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose toxicity score is below one half; labels come from the table ``labels``."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, index)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on five or more sources stay in their first document only; a document that held nothing else goes."""
    return linededup.remove(docs, keep_emptied=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that is linked by four fifths of five-word shingles in common, within ``NEAR_BITS``."""
    return simhash.one_of_each(docs, shingle=5, distance=NEAR_BITS, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that hold no ten consecutive words of an item of the table ``benchmark``."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and what they decode to, as digests."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", boilerplate_lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", token_ids),
]

#: No SQL has nearest neighbours by block bounds, fingerprint components or merge replay; tests hold run() against plain forms of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
