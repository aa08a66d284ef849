"""From raw documents to packed training sequences: five stages, each one of the corpus operators.

Every stage takes (spark, documents, folder of the tables) and works on all that the stage before has kept; its result is written as
Parquet below spark.checkpoint.dir and read again as the next stage's documents. All stages but the last return the columns of
documents.

Null and empty texts are of one kind: the classifier scores them as empty, they are no near duplicates and not contaminated, and pack as their
end id. Rows without an id, or that share one, pass as the operators say (near_duplicates keeps rows without an id). Empty tables give an empty
result, and further columns of documents come through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barweave.llm import decontaminate, jaccard, pack, quality, surrogates
from barweave.session import configure, stored


#: Key of the surrogates; own data need a key of their own, kept secret.
KEY = "key for the provided synthetic tables"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return jaccard.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more lies in benchmark windows."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    return surrogates.anonymised(docs, KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2,048 ids: one row a piece of a document."""
    return pack.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("decontaminate", uncontaminated),
    ("personal_data", without_personal_data),
    ("pack", packed),
]

#: The classifier, the keyed surrogates and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
