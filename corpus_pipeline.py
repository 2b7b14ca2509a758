"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import byte_bpe, decontamination, line_dedup, quality_rules, simhash
from panelspark.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v2 rejects, with the columns of documents.

    A null or empty text has no words and goes, as too short; a text of any length is measured whole; repeated rows are
    judged alike and stay or go together; an empty table stays empty; columns beside those of documents are dropped, whatever
    their names.
    """
    return quality_rules.verdicts(quality_rules.ledger(docs), "v2").where("kept").select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines of later occurrences of three-line windows; those left without any word go.

    A null text, and one without repeated lines, stays as it is; a text of any length is read whole; rows equal in id and text
    are one document, and what one keeps all keep; ties of equal windows go by doc_id, nulls first, then by a hash of the text;
    an empty table stays empty; other columns are dropped. n_chars is counted anew where lines went.
    """
    kept = line_dedup.dedup_lines(docs)
    kept = kept.where(F.col("n_removed").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles with fingerprints within 2 bits
    or a Jaccard similarity of 0.8 or more.

    Null, empty and blank texts are copies of each other: of several one stays. Rows without doc_id stay only where their
    group has no id; repeated rows with the smallest id all stay; texts of any length are compared whole; an empty table
    stays empty; other columns are dropped.
    """
    return simhash.keep_one(docs, distance=2, width=5, jaccard=0.8).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item (a shorter item is one window).

    Null and empty texts hold none and stay; null items take no part, without items all stay; texts of any length are
    searched whole; repeated rows stay or go together; an empty table stays empty; other columns are dropped.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10).select(COLUMNS)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, round_trip, ids_le): each document's ids, and whether they decode to its text.

    A null text is as empty: no ids; a text of any length is encoded whole; repeated rows each have a row; an empty table stays
    empty; other columns are dropped.
    """
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern, decoded=True)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return back.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), same.alias("round_trip"), "ids_le")


STAGES = [
    ("quality_rules", by_rules),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", as_tokens),
]

#: Hashes of shingles and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
