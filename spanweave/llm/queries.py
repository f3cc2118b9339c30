"""The ``opN_`` queries: each operator over its whole table, and the SQL that gives the same rows."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .chat import adjacent_pairs, other_endings, preference_pairs, tagged_turns
from .decontaminate import benchmark_hits, hit_digest
from .jaccard import jaccard_groups
from .licenses import license_scan
from .maxent import lm_scores
from .middle import fill_in_middle, middle_digest
from .near import near_groups
from .negatives import hard_negatives
from .oracles import ORACLES
from .quality import quality_verdicts
from .spans import span_report
from .staging import table
from .toxicity import toxicity_scores
from .urls import RULES, url_verdicts


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return hit_digest(benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    turns, endings = other_endings(conversations)
    # Pairs of whole conversations, and pairs of a conversation with one made from it, which differ at the end.
    pairs = preference_pairs(tagged_turns(conversations).unionByName(turns), adjacent_pairs(conversations).unionByName(endings))
    pairs = pairs.withColumns({"made": F.col("rejected_id.made"), "chosen_id": F.col("chosen_id.id"), "rejected_id": F.col("rejected_id.id")})
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["stop"])), ",")
    return pairs.withColumns({c: shown(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, folder, "pages"), rules)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_verdicts(table(spark, folder, "documents")).select(*columns)


def op7_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return span_report(table(spark, folder, "documents"))


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(table(spark, folder, "documents"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return middle_digest(fill_in_middle(table(spark, folder, "documents")))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    # Every seventh vector gets another label, the next of ten.
    mixed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", mixed), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_license_scan": op3_license_scan,
    "op4_url_filters": op4_url_filters,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_span_dedup": op7_span_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_bpe": op9_bpe,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLES", "QUERIES"]
