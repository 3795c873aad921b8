"""A corpus pipeline: language ID, exact and near dedup, mixing and packing, each stage on what the one before kept.

No stage moves whole texts between tasks to drop rows: a row that is judged by itself is filtered where it is read, and the
ids that dedup drops are broadcast, up to a checked number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.llm import exact_dedup, language_id, mixing, near_dedup, packing
from weftmark.llm.common import Workspace, keyed, table

#: Below this share of the vote no language is the likely one; a text without letters has score 0.
LEAST_SCORE = 0.4
CLEAN = "quality1_toxic0"
#: Factors on what a domain holds: all of the clean, half of the low quality, none of the toxic.
MULTIPLES = {CLEAN: 1.0, "quality0_toxic0": 0.5, "quality1_toxic1": 0.0, "quality0_toxic1": 0.0}


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that are null or without letters or a likely language go.

    Each row is judged on its own text, whatever its id; repeated rows stay as often as they come.
    """
    return language_id.known(docs, language_id.train(docs), LEAST_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id, null last; of repeated rows, one."""
    return exact_dedup.unique(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard similarity 0.8 or more), the document with the smallest id.

    Rows that share an id stay or go together; those with a null id, and texts without words, stay.
    """
    dropped = near_dedup.near_dedup(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return keyed(docs, Workspace(spark, "stage-near").write(dropped, "dropped", "snappy"), {"doc_id": F.col("doc_id").cast("long")}, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates of the mix, which are capped at one, and all whose likeliest domain is clean.

    A row is kept or not by its own text and id; a null text is an empty document, repeated rows fare alike.
    """
    plan = mixing.plan(docs, table(spark, sf_dir, "labels"), multiples=MULTIPLES, cap=1.0)
    return docs.where(plan.decide(F.col("text"), F.col("doc_id"), lambda domain, copies: (copies > 0) | (domain == CLEAN)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Classifiers, shingles and tokenisation can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
