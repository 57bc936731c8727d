"""From raw documents to packed training windows, one stage after the other.

Each stage gets the documents that the one before kept, as a table read back from Parquet; all but the last return
the columns of documents. Language ID drops documents in no language of the model; toxicity drops those scored 0.5
or more, learning from labels; of each group of near duplicates (SimHash over five-word shingles, links of an exact
Jaccard of 0.8 or more) the one with the smallest id stays; personal data is replaced by its kind; what is left is cut into windows of 2048 tokens.

Null and empty texts go at the first stage (they have no language). Empty tables give empty tables.
"""

from __future__ import annotations

from candor.llm import langid, packing, pii, simhash, toxicity
from candor.llm.common import written
from candor.llm.queries import vocabulary
from pyspark.sql import DataFrame, SparkSession


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.with_language(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", windows)]

# No stage but the redaction could be said in SQL: models, hashes of shingles and tokenizers decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
