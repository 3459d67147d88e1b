"""The corpus pipeline: each stage is one of the operators in shelfmark.llm, applied to all that the last one kept.

Stages get (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each result as Parquet to the shared folder and
reads it again as the next stage's documents, so that a lost executor costs a stage at most.

Stages that join an operator's results back to the documents join rows, not ids: a null doc_id, ids that repeat and
repeated rows are documents like all others, each with its own result. A null or empty text has too few words for the
quality rules and goes there; the stages after it, given one, keep it, except for the mix, which takes no words of it.
Texts of any length are read whole. Of equal texts the duplicate stage keeps one, with the least id, then the least row
number. Extra columns stay, but for those with the names of the mix's own columns, which replace them. An empty table
passes all stages and stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import common, decontamination, jaccard_join, mixing, pii, repetition


ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of their own for each row, which every read gives again."""
    return common.numbered(docs, ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition.repetition_rules(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join stays: the one with the least id, one without an id last.

    Documents without words stay.
    """
    rows = numbered(docs)
    classes = jaccard_join.jaccard_classes(rows, key=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    placed = classes.join(rows.select(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW).alias("place")), ROW)
    first = placed.groupBy("component_id").agg(F.min("place")[ROW].alias(ROW)).select(ROW)
    return rows.join(first, ROW, "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of ``benchmark`` go."""
    rows = numbered(docs)
    held = decontamination.contaminated(rows, common.table(spark, sf_dir, "benchmark"), key=ROW).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(held, ROW, "left_anti").select(*docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A tag stands in place of each personal detail; n_chars follows the text."""
    return pii.redacted(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with the words that it takes of each (repeats counted); what it does not take goes."""
    rows = numbered(docs)
    own = ("size", "source_size", "target", "taken")
    taken = mixing.mix(rows, row=ROW).where("taken > 0").select(ROW, *own)
    return rows.drop(*own).join(taken, ROW).select(*(c for c in docs.columns if c not in own), *own)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", without_pii),
    ("mixing", mixed),
]

#: SQL can express neither the repetition verdict nor the search; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        with common.temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            common.remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(path)
    return docs
