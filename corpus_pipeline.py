"""Corpus pipeline: language, toxicity, near duplicates, mix of sources, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns the columns of docs, the last one packed pieces. run() writes every
stage's result to the shared folder and reads it back, so a lost executor repeats
at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.llm import language, mixing, near_duplicates, packing, toxicity
from glossloom.llm.common import if_small, stored, table, text_or_empty

#: A document stays if its words are of its best language with at least this mean probability.
LEAST_LANGUAGE = 0.5
#: A document goes if it is toxic with at least this probability.
MOST_TOXIC = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, hold no letter or belong to no language that the documents teach."""
    found = language.language(F.col("text"), language.fit(docs), spark)
    rows = docs.select(F.struct("*").alias("row"), found.alias("found"))
    return rows.filter((F.col("found.lang") != language.UNKNOWN) & (F.col("found.score") >= LEAST_LANGUAGE)).select("row.*")


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; learned from the labels of the documents that are left."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), toxicity.toxicity(text_or_empty(), model, spark).alias("score"))
    return rows.filter(F.col("score") < MOST_TOXIC).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays; rows are numbered, so repeated or missing ids do no harm.

    The numbers of dropped rows, the fewer ones, go to the texts while they are few; only beyond that are texts shuffled.
    """
    numbered = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered", "zstd")
    groups = near_duplicates.near_duplicates(numbered.select("number", F.col("row.text").alias("text")), doc_id="number")
    dropped = stored(groups.filter("NOT kept").select(F.col("doc_id").alias("number")), "dropped")
    return numbered.join(if_small(dropped, near_duplicates.FEW_IDS), "number", "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequence and place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("near_duplicates", without_near_duplicates),
    ("mix", mixed),
    ("packing", packed),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
