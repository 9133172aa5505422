"""A corpus pipeline of five stages, each one of the training-data operators over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents`` (and others that docs has, whatever their names).

In every stage an empty table gives no rows and repeated rows are treated alike. Rows without a doc_id are scored and
deduplicated by nothing (they stay) and mixed and packed like others. A null text has no words: it is no toxic document
or copy, keeps its null, is mixed with size 0 and packed as the end id alone. Of tied copies the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import harmonic_packing, line_templates, lsh_forest_join, pivotal_mixing, toxicity_neighbours
from strandline.llm.common import free_name, stored, table


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among those of rows."""
    gone = free_name(docs, "gone_id")
    return docs.join(rows.select(F.col("doc_id").alias(gone)).distinct(), F.col("doc_id") == F.col(gone), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not reject. Labels are learned from rows of docs alone."""
    scores = toxicity_neighbours.score(docs, toxicity_neighbours.training_rows(spark, docs, sf_dir))
    return _without(docs, scores.where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates; n_chars follows."""
    return line_templates.drop_templates(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest doc_id."""
    classes = lsh_forest_join.join(docs)
    return _without(docs, classes.where(F.col("class_id") < F.col("doc_id")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document's row comes as often as it is taken."""
    return pivotal_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences."""
    return harmonic_packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: SQL cannot state the nearest examples, the template tree, the random transfers or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
