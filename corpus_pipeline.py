"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before
kept; all but the last return the columns of ``docs``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanweave.llm.bpe import bpe_encode
from spanweave.llm.decontaminate import decontaminate
from spanweave.llm.near import near_dedup
from spanweave.llm.quality import quality_filter
from spanweave.llm.spans import span_dedup
from spanweave.llm.staging import staged, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the adaptive thresholds keep."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates."""
    return near_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated sentence spans but for the first occurrence; documents of which nothing is left go."""
    return span_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark windows; documents with windows of two or more items go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text that they decode to, beside its columns."""
    return bpe_encode(docs, TOKENIZER, keep=tuple(docs.columns))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("token_ids", token_ids),
]

#: MinHash candidates and BPE merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else staged(docs), sf_dir)
    return docs
