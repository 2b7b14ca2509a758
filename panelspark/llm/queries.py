"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import byte_bpe, conversation_repair, decontamination, jaccard_join, language_id, lexical_search, license_scan, line_dedup, quality_classifier, quality_rules, simhash, substring_dedup, token_counts
from panelspark.llm.common import written
from panelspark.llm.oracles import ORACLE_SQL  # noqa: F401


RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is the file <source>/<lang>/<doc_id>."""
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "/", "_"), F.lit("none"))
    files = docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
    return license_scan.licences(files).drop("text")


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), langs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", F.size("languages").cast("long").alias("n_languages"))


def quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 good; a document is kept if it is more likely good than not.

    Rated documents whose crc32 of the id leaves 2 by 4 are held out of the fit.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    ratings = labels.where(~language_id.held_out()).select("doc_id", F.expr("case when toxic = 1 then 0 when quality = 0 then 1 when quality = 1 then 2 end").alias("grade"))
    graded = quality_classifier.grade(docs, *quality_classifier.learn(docs, ratings, grades=3))
    tails = [F.col("tails")[k].alias(f"p_grade_{k + 1}_up") for k in range(2)]
    return graded.select("doc_id", language_id.held_out().alias("held_out"), "expected_grade", *tails, (F.col("tails")[1] >= 0.5).alias("kept"))


def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = byte_bpe.encode(docs, ranks, pattern, decoded=True)
    return back.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(table(spark, sf_dir, "documents"), length=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v2")
    base = (F.col("failed").bitwiseAND(F.lit(quality_rules.BASE)) != 0).alias("base_failed")
    return kept.select("doc_id", *quality_rules.MEASURES, "failed", base, "kept")


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), distance=2, width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


def lexical_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of each row's conversation and turn; `gone` marks rows that are dropped."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    kept = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), times.alias("_copy")).drop("_copy")


def conversation_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = damaged(table(spark, sf_dir, "conversations"))
    rows = every.where("not gone").drop("gone")
    found = written(conversation_repair.assess(rows))
    digests = conversation_repair.digests(conversation_repair.repaired(rows, found))
    turn = F.when(~F.col("gone"), F.col("turn"))
    gaps = every.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    same = lambda x, y: x.conv_id.eqNullSafe(y.conv_id)
    all_three = gaps.join(found, same(gaps, found), "left").drop(found.conv_id)
    all_three = all_three.join(digests, same(all_three, digests), "left").drop(digests.conv_id)
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return all_three.select("conv_id", "gaps", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes_of_near_sets(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=90, width=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan_query,
    "op2_language_id": language_id_query,
    "op3_byte_bpe": byte_bpe_query,
    "op4_token_counts": token_counts_query,
    "op5_quality_classifier": quality_classifier_query,
    "op6_substring_dedup": substring_dedup_query,
    "op7_line_dedup": line_dedup_query,
    "op8_quality_rules": quality_rules_query,
    "op9_simhash_near_dedup": simhash_query,
    "op10_benchmark_decontamination": decontamination_query,
    "op11_ranked_lexical_search": lexical_search_query,
    "op12_conversation_repair": conversation_repair_query,
    "op13_ngram_jaccard_join": jaccard_query,
}
