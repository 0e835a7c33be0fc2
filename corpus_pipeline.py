"""The corpus pipeline: classifier, rules, near-duplicates, personal data, packing.

Each stage takes all that its predecessor kept. The first four return the
columns of ``documents``; the last returns packed sequences. Null and empty
texts go at the rules (under 20 words), repeated rows at the near-duplicates;
extra columns pass through the first four stages; an empty table gives no rows
at any stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near_dedup, packing, pii, quality_mil, quality_rules
from tessera.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on these documents' labels, predicts as good."""
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    return quality_mil.keep(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules keep, with their failing lines removed."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return near_dedup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; ids as little-endian bytes."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("packing", pack),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if i + 1 < len(STAGES) else docs
    return docs
