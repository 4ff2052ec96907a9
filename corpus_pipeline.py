"""From raw documents to packed training sequences: five stages over the whole table.

Every stage takes all rows its predecessor kept. All but the last return the
columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import line_dedup, ngram_join, packing, pii, quality
from quillframe.llm.common import discard, stored

# Near-duplicate documents: shingles of so many words, and the similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _counted(df: DataFrame) -> DataFrame:
    kind = df.schema["n_chars"].dataType
    return df.withColumn("n_chars", F.length("text").cast(kind))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line kept at its first occurrence only."""
    return _counted(line_dedup.dedup(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4,096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("pii", without_personal_data),
    ("packing", packed),
]

# SimHash, the fitted model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
