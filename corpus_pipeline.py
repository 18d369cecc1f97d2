"""The corpus pipeline: language, quality, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet in the
shared folder and read again as the next stage's ``docs``. All but the last return the columns of
``documents``, and every row that they keep, unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, packing, quality, simhash
from lodestone.llm.common import free, stored

#: A document whose language is no likelier than this is of no language the model knows.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without letters, texts that no learned language clearly codes best.

    Learns from the documents' own language labels, on a bounded sample (see langid.fit).
    """
    model = langid.fit(docs)
    name = free(docs, "_told")
    told = docs.withColumn(name, langid.predict(F.col("text"), model))
    keep = (F.col(name)["lang"] != langid.UNKNOWN) & (F.col(name)["score"] >= LEAST_SCORE)
    return told.where(keep).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are outliers of their language and source."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (0.8 or more of five-word shingles): that with the smallest doc_id, and of equal ones any one."""
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece with its sequence and offset."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("quality", rules), ("near_copies", near_copies), ("packing", pack)]

#: SQL can express neither the language model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, the last one's table being returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
